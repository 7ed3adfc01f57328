"""Convex hulls and quadrilaterals of polygons: as expressions over columns, and in numpy for masks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import dedupe_points, fixed, rotate_to_top_left
from tessera.functions.geometry import POINT, at, bounding_box, box_points, point, polygon_area, unique_rounded


def hull_of(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull of rows (x, y), without points on its sides (gift of a monotone chain)."""
    rows = np.unique(np.round(points, 6), axis=0)
    if len(rows) < 3:
        return rows

    def chain(ordered: np.ndarray) -> list[np.ndarray]:
        done: list[np.ndarray] = []
        for p in ordered:
            while len(done) > 1:
                (ax, ay), (bx, by) = done[-1] - done[-2], p - done[-2]
                if ax * by - ay * bx > 0:
                    break
                done.pop()
            done.append(p)
        return done[:-1]

    return np.array(chain(rows) + chain(rows[::-1]))


def _chain(points: Column) -> Column:
    """One side of a hull of sorted points: a stack as an array, cut before each point to where the turn is to the left."""
    turns = lambda done, j, p: (F.get(done, j - 1)["x"] - F.get(done, j - 2)["x"]) * (p["y"] - F.get(done, j - 2)["y"]) - (F.get(done, j - 1)["y"] - F.get(done, j - 2)["y"]) * (p["x"] - F.get(done, j - 2)["x"])

    def pushed(done: Column, p: Column) -> Column:
        left = F.filter(F.sequence(F.lit(1), F.size(done)), lambda j: (j == 1) | (turns(done, j, p) > 0))
        return F.when(F.size(done) == 0, F.array(p)).otherwise(F.concat(F.slice(done, F.lit(1), F.array_max(left)), F.array(p)))

    return F.aggregate(points, F.array().cast(f"array<{POINT}>"), pushed)


def convex_hull(points: Column) -> Column:
    """Counter-clockwise hull of an array of points, without points on its sides, as two folds over the sorted points.

    The work is in proportion to the points times those of the hull, which are few for an annotation.
    """
    rows = F.array_sort(F.array_distinct(F.transform(points, lambda p: point(F.bround(p["x"], 6), F.bround(p["y"], 6)))))

    def both(sorted_: Column) -> Column:
        sides = F.transform(F.array(F.struct(_chain(sorted_).alias("a"), _chain(F.reverse(sorted_)).alias("b"))), lambda s: F.concat(F.slice(s["a"], F.lit(1), F.size(s["a"]) - 1), F.slice(s["b"], F.lit(1), F.size(s["b"]) - 1)))
        return F.when(F.size(sorted_) < 3, sorted_).otherwise(sides[0])

    return F.transform(F.array(rows), both)[0]


def quadrilateral(df: DataFrame, points: str, out: str) -> DataFrame:
    """Adds the four extreme points of the hull in angular order; the bounding box's where they are not distinct; empty for a flat shape."""
    df = fixed(df, "_ring", dedupe_points(F.col(points)))
    df = fixed(df, "_hull", convex_hull(F.col("_ring")))
    df = fixed(df, "_src", F.when(F.size("_hull") >= 4, F.col("_hull")).otherwise(F.col("_ring")))
    src = F.col("_src")
    first = lambda key: at(src, F.array_min(F.transform(src, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"))))["i"])
    corners = F.array(
        first(lambda p: p["x"] + p["y"]), first(lambda p: p["y"] - p["x"]), first(lambda p: -(p["x"] + p["y"])), first(lambda p: p["x"] - p["y"])
    )
    df = fixed(df, "_extreme", corners)
    df = fixed(df, "_corners", F.when(unique_rounded(F.col("_extreme"), 3) < 4, box_points(bounding_box(src))).otherwise(F.col("_extreme")))
    df = rotate_to_top_left(df, "_corners", "_quad")
    quad = F.col("_quad")
    good = (F.size("_ring") >= 4) & (unique_rounded(quad, 3) >= 4) & (polygon_area(quad) > 1e-3)
    return df.withColumn(out, F.when(good, quad).otherwise(F.array().cast(f"array<{POINT}>"))).drop("_ring", "_hull", "_src", "_extreme", "_corners", "_quad")
