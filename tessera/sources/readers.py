"""Sources: annotation documents, images, chat lines, JSON documents, prompt texts, evaluation summaries, recorded model outputs."""

from __future__ import annotations

import os
import struct
from collections.abc import Mapping
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import media_type, stem, suffix
from tessera.operators.chat import MESSAGES

#: Schemas of what is read (fixed formats).
ANNOTATION = "imagePath string, shapes array<struct<label:string,shape_type:string,points:array<array<double>>>>"
CHAT = f"id string, images array<string>, messages {MESSAGES}, meta map<string,string>"
SUMMARY = (
    "num_samples long, valid_json_rate double, schema_valid_rate double, placeholder_rate double, mean_iou_all double, "
    "mean_iou_schema_valid_only double, median_iou_schema_valid_only double"
)
DETECTIONS = "image string, det_idx int, conf double, x0 double, y0 double, x1 double, y1 double, mask_area long"
PREDICTIONS = "id string, pred_text string"


@dataclass(frozen=True)
class Config:
    """Settings of a dataset build; unusable combinations are refused when it is made.

    from_environment() takes what is set there under a prefix, in capitals, over the defaults.
    """

    min_area: float = 8.0
    grid: int = 16
    points: int = 12
    train: float = 0.85
    val: float = 0.10
    max_retries: int = 2
    target_shape: str = "polygon"
    coord_mode: str = "pixel"
    crop_mode: str = "none"
    gate_steps: tuple[int, ...] = (10, 20, 30)
    gate_delta: int = 10
    gate_most: int = 60

    @classmethod
    def from_environment(cls, prefix: str = "TESSERA_", env: Mapping[str, str] | None = None, **told: object) -> Config:
        env = os.environ if env is None else env
        found: dict[str, object] = {}
        for field in fields(cls):
            if text := env.get(prefix + field.name.upper(), "").strip():
                kind = type(field.default)
                found[field.name] = tuple(int(part) for part in text.split(",") if part.strip()) if kind is tuple else kind(text)
        return cls(**(found | told))

    def __post_init__(self) -> None:
        if self.target_shape not in ("bbox", "quad", "polygon") or self.coord_mode not in ("pixel", "grid") or self.crop_mode not in ("none", "chair"):
            raise ValueError("target_shape, coord_mode and crop_mode must be known ones")
        if self.coord_mode == "grid" and self.target_shape != "bbox":
            raise ValueError("a grid goes with boxes only")
        if not self.gate_steps or any(a >= b for a, b in zip(self.gate_steps, self.gate_steps[1:])) or self.gate_steps[0] < 1:
            raise ValueError("gate_steps must be positive and rise")
        if self.max_retries < 1:
            raise ValueError("max_retries must be at least 1")
        if self.grid < 2 or self.points < 3:
            raise ValueError("grid must be at least 2 and points at least 3")
        if not (0 < self.train < 1 and 0 <= self.val < 1 and self.train + self.val <= 1):
            raise ValueError("train and val must be shares that leave no more than everything")


def annotations(spark: SparkSession, *folders: str) -> DataFrame:
    """One row per JSON file of the folders, which rank in the order given: path, stem, source_rank, the document, is_bad.

    A file that does not parse is a row with is_bad, to be counted and left out.
    """
    out = None
    for rank, folder in enumerate(folders):
        schema = T.StructType([*_ddl(ANNOTATION).fields, T.StructField("_corrupt", T.StringType())])
        read = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        rows = read.option("pathGlobFilter", "*.json").json(folder).select("*", F.col("_metadata.file_path").alias("path"))
        # a size is never negative: the term only names a column, as reading nothing but the corrupt text is refused
        bad = F.coalesce(F.col("_corrupt").isNotNull() | (F.size("shapes") < -1), F.lit(False))
        rows = rows.select("path", stem(F.col("path")).alias("stem"), F.lit(rank).alias("source_rank"), "imagePath", "shapes", bad.alias("is_bad"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _ddl(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def labelled_polygons(docs: DataFrame, label: str) -> DataFrame:
    """Shapes of a label with at least three points: path, stem, source_rank, idx, points as struct<x,y>."""
    shapes = docs.where("NOT is_bad").select("path", "stem", "source_rank", F.posexplode("shapes").alias("idx", "shape"))
    good = F.filter("shape.points", lambda p: F.size(p) >= 2)
    points = F.transform(good, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return shapes.where(F.col("shape.label") == label).select("path", "stem", "source_rank", "idx", points.alias("points")).where("size(points) >= 3")


def header_size(content: bytes) -> tuple[int, int] | None:
    """Width and height from an image's header: PNG, GIF, BMP, or the frame header of a JPEG."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return struct.unpack("<HH", content[6:10])
    if content[:2] == b"BM" and len(content) >= 26:
        width, height = struct.unpack("<ii", content[18:26])
        return abs(width), abs(height)
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content):
            if content[at] != 0xFF:
                return None
            marker = content[at + 1]
            if marker == 0xFF:
                at += 1
            elif marker == 0x01 or 0xD0 <= marker <= 0xD9:
                at += 2
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", content[at + 5 : at + 9])
                return width, height
            else:
                at += 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
    return None


def _whole(content: Column, first: int, n: int, little: bool) -> Column:
    """n bytes of a binary column as a whole number, from byte `first` (from 0)."""
    text = F.hex(F.substring(content, first + 1, n))
    if little:
        text = F.concat(*[F.substring(text, 2 * k + 1, 2) for k in reversed(range(n))])
    return F.conv(text, 16, 10).cast("long")


def _signed(value: Column) -> Column:
    return F.abs(F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value))


def image_size(content: Column) -> Column:
    """struct<width,height> of a binary column, null where the header is not known.

    PNG, GIF and BMP headers are read by expressions from their first 26 bytes; only a JPEG, whose frame header may
    stand anywhere, goes to Python.
    """

    @F.pandas_udf("struct<width:int,height:int>")
    def walked(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header_size(bytes(c)) or (None, None) if c is not None else (None, None) for c in contents], columns=["width", "height"]).astype("Int32")

    magic, n = F.hex(F.substring(content, 1, 8)), F.octet_length(content)
    size = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    jpeg = walked(F.when(magic.startswith("FFD8"), content))
    return (
        F.when((magic == "89504E470D0A1A0A") & (n >= 24), size(_whole(content, 16, 4, False), _whole(content, 20, 4, False)))
        .when(magic.startswith("474946383761") | magic.startswith("474946383961"), F.when(n >= 10, size(_whole(content, 6, 2, True), _whole(content, 8, 2, True))))
        .when(magic.startswith("424D"), F.when(n >= 26, size(_signed(_whole(content, 18, 4, True)), _signed(_whole(content, 22, 4, True)))))
        .when(magic.startswith("FFD8") & jpeg["width"].isNotNull(), jpeg)
    )


def images(spark: SparkSession, folder: str) -> DataFrame:
    """An index of image files: path, stem, ext, media, width, height."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = rows.where(media_type(F.col("path")).isNotNull())
    rows = rows.select("path", stem(F.col("path")).alias("stem"), suffix(F.col("path")).alias("ext"), media_type(F.col("path")).alias("media"), image_size(F.col("content")).alias("s"))
    return rows.select("path", "stem", "ext", "media", "s.width", "s.height")


def fitted_size(width: Column, height: Column, longest: int) -> Column:
    """The size after scaling the longer side down to `longest`, and whether that changes it; null for an unknown size."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    side = lambda n: F.greatest(F.rint(n * scale).cast("int"), F.lit(1))
    return F.when(width.isNotNull() & height.isNotNull(), F.struct(side(width).alias("width"), side(height).alias("height"), (scale < 1).alias("resized")))


def image_payload(spark: SparkSession, folder: str, longest: int = 1024) -> DataFrame:
    """Images as they are sent to a model: path, media type, base64 content, their size, and the size they would have with the longer side at most `longest`.

    Content stays as it is: images are not decoded here, so one that is `to_resize` is left to the caller.
    """
    rows = spark.read.format("binaryFile").load(folder)
    rows = rows.select("path", media_type(F.col("path")).alias("media"), F.base64("content").alias("data"), image_size(F.col("content")).alias("s"))
    rows = rows.select("*", fitted_size(F.col("s.width"), F.col("s.height"), longest).alias("f"))
    return rows.select("path", "media", "data", "s.width", "s.height", F.col("f.width").alias("fitted_width"), F.col("f.height").alias("fitted_height"), F.col("f.resized").alias("to_resize"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files with their numbers: file, lineno from 1, value. Blank lines count and are left out.

    A large file is read in splits, whose lines have no number of their own. A first pass that reads no text but counts lines
    by file and split gives each split its offset in the file; a line's place in its split comes from the order
    in which a task reads it, in either pass. The offsets are one row a split.
    """
    read = spark.read.text(path)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), "value")
    splits = lines.groupBy("file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    splits = splits.withColumn("_before", F.sum("_n").over(Window.partitionBy("file").orderBy("_start")) - F.col("_n")).drop("_n")
    numbered = lines.join(splits, ["file", "_start"]).withColumn("lineno", F.col("_at") - F.col("_first") + F.col("_before") + 1)
    return numbered.where(F.trim(F.col("value")) != "").select("file", "lineno", "value")


def chat_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chat rows of JSON lines with file, lineno and is_bad; blank lines are left out.

    A line that is no JSON object of this shape is a row with is_bad and nulls, to be told by its file and number (targets.checked_lines).
    """
    lines = numbered_lines(spark, path)
    told = F.from_json("value", f"struct<{_fields(CHAT)},_corrupt:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select("file", "lineno", "value", F.explode(F.array(told)).alias("row"))
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull() | ~F.ltrim("value").startswith("{")
    names = [f.name for f in _ddl(CHAT).fields]
    return rows.select("file", "lineno", bad.alias("is_bad"), *[F.when(~bad, F.col(f"row.{c}")).alias(c) for c in names])


def _fields(ddl: str) -> str:
    """Fields of a table as those of a struct."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in _ddl(ddl).fields)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document whose root must be an object; anything else is an error when it is read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def prompt_text(spark: SparkSession, path: str) -> DataFrame:
    """A text file as one value, without the white space around it."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))


def summaries(spark: SparkSession, folder: str, pattern: str = "val_*.json") -> DataFrame:
    """The summaries of evaluation documents with their file names."""
    rows = spark.read.schema(f"summary struct<{SUMMARY.replace(' long', ':long').replace(' double', ':double')}>").option("multiLine", True).option("pathGlobFilter", pattern).json(folder)
    return rows.select(F.col("_metadata.file_name").alias("file"), "summary.*")


def recorded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Outputs of models or detectors, recorded as Parquet with a known schema; extra columns are not read."""
    return spark.read.schema(schema).parquet(path)
