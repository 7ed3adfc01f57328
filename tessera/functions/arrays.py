"""Order-dependent operations on arrays of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import POINT, at, centroid, edges, fold_sum, point


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later expressions read and never evaluate again.

    The optimizer merges projections and so puts an expression into every lambda that
    names it, where it would run once per element. A generator of one row stops that.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _drop_closing(points: Column, same) -> Column:
    closed = (F.size(points) > 1) & same(F.element_at(points, 1), F.element_at(points, -1))
    return F.when(closed, F.slice(points, 1, F.size(points) - 1)).otherwise(points)


def _keep(points: Column, same) -> Column:
    """Drops each point that is the same as the last one kept, and a last one that is the same as the first."""
    kept = F.aggregate(
        points,
        F.array().cast(f"array<{POINT}>"),
        lambda done, p: F.when((F.size(done) > 0) & same(F.element_at(done, -1), p), done).otherwise(F.concat(done, F.array(p))),
    )
    return F.when(F.size(points) > 0, _drop_closing(kept, same)).otherwise(points)


def dedupe_points(points: Column, eps: float = 1e-6) -> Column:
    return _keep(points, lambda a, b: (F.abs(a["x"] - b["x"]) <= eps) & (F.abs(a["y"] - b["y"]) <= eps))


def dedupe_by_distance(points: Column, least: float = 1.25) -> Column:
    return _keep(points, lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]) < least)


def resample_ring(df: DataFrame, points: str, n: int, out: str) -> DataFrame:
    """Adds n points at equal distances along the closed ring, from its first vertex; empty for fewer than three vertices.

    Works in steps over helper columns, as each is used many times.
    """
    ring, lengths, ends = F.col("_ring"), F.col("_lengths"), F.col("_ends")
    df = fixed(df, "_ring", dedupe_points(F.col(points)))
    df = fixed(df, "_lengths", F.transform(edges(ring), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))
    df = fixed(df, "_ends", F.transform(F.sequence(F.lit(1), F.size(ring)), lambda k: fold_sum(F.slice(lengths, 1, k))))
    df = fixed(df, "_total", F.element_at(ends, -1))

    def place(i: Column) -> Column:
        target = F.col("_total") * i / F.lit(float(n))
        passed = F.least(F.size(F.filter(ends, lambda e: e < target)), F.size(ring) - 1)
        return F.struct(passed.alias("k"), target.alias("t"))

    def interpolated(s: Column) -> Column:
        length = F.element_at(lengths, s["k"] + 1)
        a, b = at(ring, s["k"]), at(ring, s["k"] + 1)
        t = F.when(length > 1e-6, (s["t"] - (F.element_at(ends, s["k"] + 1) - length)) / F.greatest(length, F.lit(1e-6))).otherwise(F.lit(0.0))
        return point(a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t)

    df = fixed(df, "_places", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), place))
    none = F.array().cast(f"array<{POINT}>")
    made = F.when(F.size(ring) < 3, none).when(F.col("_total") <= 1e-6, F.slice(ring, 1, n)).otherwise(F.transform("_places", interpolated))
    return df.withColumn(out, made).drop("_ring", "_lengths", "_ends", "_total", "_places")


def rotate_to_top_left(df: DataFrame, points: str, out: str) -> DataFrame:
    """Adds the points by falling angle about their centroid, beginning with the smallest x + y."""
    df = fixed(df, "_c", centroid(F.col(points)))
    angled = F.transform(points, lambda p, i: F.struct((-F.atan2(p["y"] - F.col("_c.y"), p["x"] - F.col("_c.x"))).alias("k"), i.alias("i"), p.alias("p")))
    df = fixed(df, "_ordered", F.transform(F.array_sort(angled), lambda s: s["p"]))
    first = F.array_min(F.transform("_ordered", lambda p, i: F.struct((p["x"] + p["y"]).alias("k"), i.alias("i"))))["i"]
    df = fixed(df, "_first", first)
    n = F.size(points)
    turned = F.concat(F.slice("_ordered", F.col("_first") + 1, n), F.slice("_ordered", F.lit(1), F.col("_first")))
    return df.withColumn(out, F.when(n <= 1, F.col(points)).otherwise(turned)).drop("_c", "_ordered", "_first")


def stride_indexes(n: Column, most: int) -> Column:
    """Which of n ordered rows a systematic sample of at most `most` takes, from 0; halves go to even."""
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.least(F.rint(i * (n / F.lit(float(most)))).cast("long"), n - 1))
    return F.when(n > most, picked).otherwise(F.sequence(F.lit(0).cast("long"), n - 1))


def sorted_distinct(points: Column, digits: int = 6) -> Column:
    return F.array_sort(F.array_distinct(F.transform(points, lambda p: point(F.bround(p["x"], digits), F.bround(p["y"], digits)))))
