"""Names, prompts and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Task names by target shape and coordinate mode (fixed values).
TASKS = {
    ("bbox", "grid"): "seat_contact_bounding_box_grid",
    ("bbox", None): "seat_contact_bounding_box",
    ("quad", None): "seat_contact_quad_points",
    (None, None): "seat_contact_segmentation_points",
}
#: Media types by file extension (fixed values).
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp"}


def task_name(shape: Column, mode: Column) -> Column:
    out = F.lit(TASKS[None, None])
    for (wanted, kind), name in reversed([(k, v) for k, v in TASKS.items() if k[0]]):
        out = F.when((shape == wanted) & ((mode == kind) if kind else F.lit(True)), F.lit(name)).otherwise(out)
    return out


def target_key(shape: Column) -> Column:
    return F.when(shape == "bbox", "seat_contact_box").otherwise("seat_contact_polygon")


def first_filled(*values: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def stem(path: Column) -> Column:
    """The last part of a path without its last extension."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The last extension in lower case with its dot, or an empty text."""
    return F.lower(F.regexp_extract(path, r"[^/]+(\.[^./]*)/*$", 1))


def media_type(path: Column) -> Column:
    """By extension; an unknown one is null."""
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.try_element_at(known, F.substring(suffix(path), 2, 10))


def version_number(path: Column) -> Column:
    """The number that ends a path, for an order by version."""
    return F.regexp_extract(path, r"([0-9]+)[^0-9]*$", 1).try_cast("int")


def last_by_version(df: DataFrame, by: list[str], path: str) -> DataFrame:
    """Of each group the path that an order by version puts last: by the number that ends it, then by name; one without a number comes first."""
    order = F.struct(F.coalesce(version_number(F.col(path)), F.lit(-1)).alias("v"), F.col(path).alias("p"))
    return df.groupBy(*by).agg(F.max(order).alias("_last")).select(*by, F.col("_last.p").alias(path), F.col("_last.v").alias("version"))


def serialised(df: DataFrame, name: str) -> Column:
    """A column of any type as JSON can hold it: numbers, booleans and texts as they are, nested values as JSON, all else as text."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType, T.StringType)) and not isinstance(kind, T.DecimalType):
        return F.col(name)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(name, {"ignoreNullFields": "false"})
    return F.col(name).cast("string")


def schedule(text: Column) -> Column:
    """Positive whole numbers from a comma-separated list; others are left out."""
    steps = F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("int"))
    return F.filter(steps, lambda n: n > 0)


def lora_targets(text: Column) -> Column:
    """Names of a comma-separated list without blank ones; `all-linear` alone where the text is blank."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    names = F.filter(F.transform(F.split(text, ","), bare), lambda s: s != "")
    return F.when(bare(text) == "", F.array(F.lit("all-linear"))).otherwise(names)


def assembled(system: Column, inputs: Column, issues: Column) -> Column:
    """A prompt of its parts with blank lines between; missing parts leave none."""
    return F.concat_ws("\n\n", system, F.concat(F.lit("Input JSON:\n"), inputs), F.concat(F.lit("Previous issues:\n"), issues))
