"""2-D geometry as column expressions: points are struct<x,y>, polygons arrays of them, boxes struct<x_min,y_min,x_max,y_max>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
EPS = 1e-8


def lit(value: Column | float | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def point(x: Column | float, y: Column | float) -> Column:
    return F.struct(lit(x).cast("double").alias("x"), lit(y).cast("double").alias("y"))


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    """max(low, min(high, value)): low wins where low > high."""
    return F.greatest(lit(low), F.least(lit(high), value))


def at(points: Column, i: Column | int) -> Column:
    """The i-th point from 0, cyclically."""
    return F.element_at(points, (F.pmod(lit(i), F.size(points)) + 1).cast("int"))


def edges(points: Column) -> Column:
    """Every side of a polygon, the closing one included: struct<a,b,i>."""
    return F.transform(points, lambda p, i: F.struct(p.alias("a"), at(points, i + 1).alias("b"), i.alias("i")))


def indexes(points: Column) -> Column:
    return F.sequence(F.lit(0), F.size(points) - 1)


def fold_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def polygon_area(points: Column) -> Column:
    """Shoelace area; fewer than three points have none."""
    cross = F.transform(edges(points), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(F.abs(fold_sum(cross)) * 0.5)


def centroid(points: Column) -> Column:
    """Mean of the vertices."""
    n = F.size(points)
    return point(fold_sum(F.transform(points, lambda p: p["x"])) / n, fold_sum(F.transform(points, lambda p: p["y"])) / n)


def point_in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd ray cast, half-open in y."""
    crossed = F.filter(
        edges(points),
        lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y))
        # the side is walked from the later vertex to the earlier one, which fixes the sign of the small number
        & (x < (e["a"]["x"] - e["b"]["x"]) * (y - e["b"]["y"]) / ((e["a"]["y"] - e["b"]["y"]) + EPS) + e["b"]["x"]),
    )
    return F.size(crossed) % 2 == 1


def segment_distance(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Distance to a segment; a segment without length counts as its first point."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length2 = dx * dx + dy * dy
    t = F.when(length2 < EPS, F.lit(0.0)).otherwise(clamp(((x - a["x"]) * dx + (y - a["y"]) * dy) / F.greatest(length2, F.lit(EPS)), 0.0, 1.0))
    return F.hypot(x - (a["x"] + t * dx), y - (a["y"] + t * dy))


def edge_distance(x: Column, y: Column, points: Column) -> Column:
    """Distance to the nearest side of a polygon."""
    return F.array_min(F.transform(edges(points), lambda e: segment_distance(x, y, e["a"], e["b"])))


def xs(points: Column) -> Column:
    return F.transform(points, lambda p: p["x"])


def ys(points: Column) -> Column:
    return F.transform(points, lambda p: p["y"])


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x_min"), y0.alias("y_min"), x1.alias("x_max"), y1.alias("y_max"))


def bounding_box(points: Column) -> Column:
    """Null for an empty array."""
    made = box(F.array_min(xs(points)), F.array_min(ys(points)), F.array_max(xs(points)), F.array_max(ys(points)))
    return F.when(F.size(points) > 0, made)


def clamp_points(points: Column, width: int, height: int) -> Column:
    return F.transform(points, lambda p: point(clamp(p["x"], 0.0, width - 1.0), clamp(p["y"], 0.0, height - 1.0)))


def scale_pixels(value: Column, src: Column | int, dst: Column | int) -> Column:
    """Rescales by (dst - 1) / (src - 1), then clamps; the same value where a side is at most 1."""
    src, dst = lit(src), lit(dst)
    scaled = clamp(value * ((dst - 1) / (src - 1).cast("double")), 0.0, dst - 1.0)
    return F.when((src <= 1) | (dst <= 1), value).otherwise(scaled)


def scale_ratio(value: Column, src: Column | int, dst: Column | int) -> Column:
    """Rescales by dst / src, then clamps; the same value where a side is not positive."""
    src, dst = lit(src), lit(dst)
    scaled = clamp(value * (dst.cast("double") / src), 0.0, F.greatest(dst - 1.0, F.lit(0.0)))
    return F.when((src <= 0) | (dst <= 0), value).otherwise(scaled)


def scale_box(b: Column, src_w: int, src_h: int, dst_w: int, dst_h: int) -> Column:
    return box(*(b[k] * (d / s) for k, s, d in (("x_min", src_w, dst_w), ("y_min", src_h, dst_h), ("x_max", src_w, dst_w), ("y_max", src_h, dst_h))))


def grid_box(b: Column, width: int, height: int) -> Column:
    """Quantises a box to whole cells: swapped sides are put right, minima go down and maxima up, each side spans a step."""

    def side(low: Column, high: Column, n: int) -> tuple[Column, Column]:
        low, high = clamp(low, 0.0, n - 1.0), clamp(high, 0.0, n - 1.0)
        a, b = F.floor(F.least(low, high)).cast("int"), F.ceil(F.greatest(low, high)).cast("int")
        if n < 2:
            return a, b
        flat = b <= a
        return F.when(flat & (a >= n - 1), F.greatest(a - 1, F.lit(0))).otherwise(a), F.when(flat & (a < n - 1), a + 1).otherwise(b)

    (x0, x1), (y0, y1) = side(b["x_min"], b["x_max"], width), side(b["y_min"], b["y_max"], height)
    return box(x0, y0, x1, y1)


def expand_crop(b: Column, width: int, height: int, margin: float) -> Column:
    """A box with a margin on every side, in whole pixels; the whole image where nothing is left."""
    mx, my = F.greatest(b["x_max"] - b["x_min"], F.lit(2.0)) * margin, F.greatest(b["y_max"] - b["y_min"], F.lit(2.0)) * margin
    low = lambda v: F.greatest(F.rint(v).cast("int"), F.lit(0))
    high = lambda v, n: F.least(F.rint(v).cast("int"), F.lit(n))
    x0, y0, x1, y1 = low(b["x_min"] - mx), low(b["y_min"] - my), high(b["x_max"] + mx, width), high(b["y_max"] + my, height)
    empty = (x1 <= x0 + 1) | (y1 <= y0 + 1)
    whole = box(F.lit(0), F.lit(0), F.lit(width), F.lit(height))
    return F.when(empty, whole).otherwise(box(x0, y0, x1, y1))


def expand_box(b: Column, width: int, height: int, side: float, top: float, bottom: float) -> Column:
    """A box with a margin for its sides, its top and its bottom; the box itself where nothing is left."""
    w, h = b["x_max"] - b["x_min"], b["y_max"] - b["y_min"]
    made = box(
        clamp(b["x_min"] - w * side, 0.0, width - 1.0), clamp(b["y_min"] - h * top, 0.0, height - 1.0),
        clamp(b["x_max"] + w * side, 0.0, width - 1.0), clamp(b["y_max"] + h * bottom, 0.0, height - 1.0),
    )
    return F.when((made["x_max"] > made["x_min"]) & (made["y_max"] > made["y_min"]), made).otherwise(b)


def shift_box(b: Column, crop: Column) -> Column:
    """A box in the frame of a crop."""
    return box(b["x_min"] - crop["x_min"], b["y_min"] - crop["y_min"], b["x_max"] - crop["x_min"], b["y_max"] - crop["y_min"])


def box_points(b: Column) -> Column:
    return F.array(point(b["x_min"], b["y_min"]), point(b["x_max"], b["y_min"]), point(b["x_max"], b["y_max"]), point(b["x_min"], b["y_max"]))


def cells(b: Column) -> Column:
    """Cells of a whole-number box whose maxima are inside it."""
    return ((b["x_max"] - b["x_min"] + 1) * (b["y_max"] - b["y_min"] + 1)).cast("double")


def cell_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two whole-number boxes by cells."""
    w = F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"]) + 1
    h = F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"]) + 1
    common = (F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))).cast("double")
    union = cells(a) + cells(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def unique_rounded(points: Column, digits: int = 0) -> Column:
    """How many distinct points there are after rounding, halves to even."""
    return F.size(F.array_distinct(F.transform(points, lambda p: F.struct(F.bround(p["x"], digits).alias("x"), F.bround(p["y"], digits).alias("y")))))
