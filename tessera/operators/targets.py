"""Training targets: the annotation of a document in a wanted shape, prompts from templates, chat rows, and the check of lines of chat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import geometry as G
from tessera.functions import text as X
from tessera.functions.hull import quadrilateral
from tessera.operators import chat as C
from tessera.operators import validate as V

POINTS = "array<struct<x:double,y:double>>"
#: Wording of prompts by shape and coordinate mode: a parameter. {grid} is the number of cells, {hint} what a crop needs to be told.
SYSTEM = {
    ("bbox", "grid"): "{hint}Answer with one JSON object of task, image_size and seat_contact_box, whose sides are whole cells of a {grid} by {grid} grid.",
    ("bbox", None): "{hint}Answer with one JSON object of task, image_size and seat_contact_box, whose sides are whole pixels.",
    ("quad", None): "{hint}Answer with one JSON object of task, image_size and seat_contact_polygon, four corners in clockwise order.",
    (None, None): "{hint}Answer with one JSON object of task, image_size and seat_contact_polygon, six points or more.",
}
USER = {
    ("bbox", "grid"): "{hint}Box the seat on the {grid} by {grid} grid.",
    ("bbox", None): "{hint}Box the seat in pixels.",
    ("quad", None): "{hint}Mark the four corners of the seat.",
    (None, None): "{hint}Outline the seat.",
}
HINT = "The image shows one chair. "


def from_template(templates: dict[tuple[str | None, str | None], str], shape: Column, mode: Column, crop: Column, grid: Column, hint: str = HINT) -> Column:
    """The wording for a shape and a mode: the most special template that fits, with the grid's size and, for crops, the hint filled in."""
    out = F.lit(templates[None, None])
    for wanted, kind in sorted((k for k in templates if k[0]), key=lambda k: (k[1] is not None, str(k))):
        out = F.when((shape == wanted) & ((mode == kind) if kind else F.lit(True)), F.lit(templates[wanted, kind])).otherwise(out)
    out = F.replace(out, F.lit("{grid}"), grid.cast("string"))
    return F.replace(out, F.lit("{hint}"), F.when(F.coalesce(crop == "chair", F.lit(False)), F.lit(hint)).otherwise(F.lit("")))


def formatted(points: Column, width: int, height: int, whole: bool) -> Column:
    """Points clamped to the frame, as whole numbers or to two places; halves go to even."""
    side = (lambda v, n: F.rint(G.clamp(v, 0.0, n - 1.0))) if whole else (lambda v, n: F.bround(G.clamp(v, 0.0, n - 1.0), 2))
    return F.transform(points, lambda p: G.point(side(p["x"], width), side(p["y"], height)))


def in_shape(df: DataFrame, points: str, shape: str, width: int, height: int, n: int = 12, whole: bool = True, out: str = "target") -> DataFrame:
    """Adds a polygon in the wanted shape and how many numbers of points it has: bbox (two opposite corners, 4), quad (4) or polygon (n).

    The count is 0, and the target empty, where a polygon has under three points or no such shape; those are to be left out.
    """
    given = F.size(points) >= 3
    if shape == "bbox":
        b = G.bounding_box(F.col(points))
        df = df.withColumn("_t", F.when(given, F.array(G.point(b["x_min"], b["y_min"]), G.point(b["x_max"], b["y_max"]))))
    elif shape == "quad":
        df = quadrilateral(df, points, "_t")
        df = df.withColumn("_t", F.when(given & (F.size("_t") == 4), F.col("_t")))
    else:
        df = A.resample_ring(df, points, n, "_t")
        df = df.withColumn("_t", F.when(given & (F.size("_t") >= 3), F.col("_t")))
    count = F.when(F.col("_t").isNull(), 0).otherwise(4 if shape == "bbox" else F.size("_t"))
    made = F.coalesce(formatted(F.col("_t"), width, height, whole), F.array().cast(POINTS))
    return df.withColumns({out: made, f"{out}_count": count}).drop("_t")


def assistant_text(task: Column, width: Column, height: Column, shape: Column, points: Column) -> Column:
    """The answer that a model is to learn: compact JSON of task, image_size and the box or polygon, in whole numbers."""
    number = lambda v: v.cast("long").cast("string")
    box = F.concat(F.lit('"seat_contact_box":{"x_min":'), number(points[0]["x"]), F.lit(',"y_min":'), number(points[0]["y"]), F.lit(',"x_max":'), number(points[1]["x"]), F.lit(',"y_max":'), number(points[1]["y"]), F.lit("}"))
    each = F.transform(points, lambda p: F.concat(F.lit('{"x":'), number(p["x"]), F.lit(',"y":'), number(p["y"]), F.lit("}")))
    polygon = F.concat(F.lit('"seat_contact_polygon":['), F.array_join(each, ","), F.lit("]"))
    head = F.concat(F.lit('{"task":"'), task, F.lit('","image_size":{"width":'), number(width), F.lit(',"height":'), number(height), F.lit("},"))
    return F.concat(head, F.when(shape == "bbox", box).otherwise(polygon), F.lit("}"))


def target_messages(system: Column, user: Column, assistant: Column) -> Column:
    """Three messages: the system's, the user's with the image before the text, and the answer."""
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    message = lambda role, *blocks: F.struct(F.lit(role).alias("role"), F.array(*blocks).alias("content"))
    none = F.lit(None).cast("string")
    return F.array(message("system", block("text", system)), message("user", block("image", none), block("text", user)), message("assistant", block("text", assistant))).cast(C.MESSAGES)


def chat_rows_of(df: DataFrame, shape: Column, mode: Column, crop: Column, grid: Column, width: Column, height: Column, target: str = "target") -> DataFrame:
    """Adds messages and task_name to rows with a target; rows without one are left out."""
    task = X.task_name(shape, mode)
    prompt = lambda templates: from_template(templates, shape, mode, crop, grid)
    made = target_messages(prompt(SYSTEM), prompt(USER), assistant_text(task, width, height, shape, F.col(target)))
    return df.where(F.col(f"{target}_count") > 0).withColumns({"messages": made, "task_name": task})


TARGET = f"struct<task:string,image_size:struct<width:int,height:int>,seat_contact_box:struct<x_min:double,y_min:double,x_max:double,y_max:double>,seat_contact_polygon:{POINTS},_corrupt:string>"


def checked_lines(rows: DataFrame, images: DataFrame, task: str, shape: str, points: int = 0) -> DataFrame:
    """file, lineno and the first error of every chat row, null for a good one.

    rows has file, lineno, images and messages, and may have is_bad for lines that were no JSON; images is an index with a path for each image that exists, of any
    size: it is joined by path. The answer is the last assistant message's first text.
    """
    index = images.select(F.col("path").alias("_path"), F.lit(True).alias("_exists")).distinct()
    told = rows.withColumn("_path", F.get("images", F.lit(0))).join(index, "_path", "left")
    text = C.last_assistant_text(F.col("messages"))
    told = told.withColumn("_target", F.from_json(text, TARGET, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    target = F.when(F.col("_target._corrupt").isNull(), F.col("_target"))
    no_list = lambda c: F.col(c).isNull() | (F.size(c) == 0)
    error = V.first_error(
        (F.col("is_bad") if "is_bad" in rows.columns else F.lit(False), "invalid JSON"),
        (no_list("images"), "images missing"),
        (no_list("messages"), "messages missing"),
        (F.col("_exists").isNull(), "image does not exist"),
        (text.isNull(), "assistant message missing"),
    )
    return told.select("file", "lineno", F.coalesce(error, V.target_error(target, text, task, shape, points)).alias("error"))
