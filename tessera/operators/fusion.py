"""Masks of one image fused: the best one and those that agree with it enough to belong to it and too little to repeat it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import fixed
from tessera.operators import widemask as W
from tessera.operators.widemask import Grid

#: Limits for partners of the best mask (fixed values): least confidence and areas as shares of the best one's, overlap, masks fused.
LEAST_CONFIDENCE, AREAS, OVERLAPS, MOST = 0.25, (0.30, 10.0), (0.02, 0.70), 4


def fuse_masks(rows: DataFrame, by: str, mask: str, confidence: str, order: str, grid: Grid, areas: tuple[float, float] = AREAS, overlaps: tuple[float, float] = OVERLAPS, least: float = LEAST_CONFIDENCE, most: int = MOST) -> DataFrame:
    """One row per image: by, the best mask's `order` as best, n_fused, and fused, the union of the masks.

    Masks of one pixel or none do not count. The best one has the highest product of confidence and area, ties
    going to the smallest `order`. The next in this order join it, up to `most` masks in all, if their confidence, area
    and true overlap with the best mask are within the limits. The best mask of an image is found by an
    aggregate that is combined before its shuffle, and partners are ranked with a limit before theirs, so an image with any number
    of masks is not gathered; only the few that are fused meet. An image without a mask that counts has no row.
    """
    told = fixed(rows.select(by, order, confidence, mask), "_area", W.count(F.col(mask))).where("_area > 1")
    place = F.struct((-(F.col(confidence) * F.col("_area"))).alias("score"), F.col(order).alias("order"))
    told = told.withColumn("_place", place)
    best = told.groupBy(by).agg(F.min_by(F.struct(F.col(mask).alias("mask"), F.col("_area").alias("area"), F.col(confidence).alias("confidence"), F.col("_place").alias("place")), "_place").alias("_best"))
    met = told.join(best.select(F.col(by).alias("_by"), "_best"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    fits = (F.col(confidence) >= least * F.col("_best.confidence")) & F.col("_area").between(areas[0] * F.col("_best.area"), areas[1] * F.col("_best.area"))
    partners = met.where((F.col("_place") != F.col("_best.place")) & fits)
    partners = partners.where(W.overlap(F.col(mask), F.col("_best.mask")).between(*overlaps))
    ranked = partners.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy("_place"))).where(F.col("_rank") < most)
    joined = ranked.select(by, F.col(mask).alias("_mask")).unionByName(best.select(by, F.col("_best.mask").alias("_mask")))
    fused = joined.groupBy(by).agg(F.count("*").alias("n_fused"), F.collect_list("_mask").alias("_masks"))
    named = best.select(F.col(by).alias("_by"), F.col("_best.place.order").alias("best"))
    fused = fused.join(named, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    return fused.select(by, "best", "n_fused", W.union_of(F.col("_masks"), grid).alias("fused"))


def any_of(rows: DataFrame, by: str, mask: str) -> DataFrame:
    """The union of any number of masks of each group, as words: by, at (the word's place) and bits.

    Words are combined before the shuffle, so a group of any size costs one word each.
    """
    words = rows.select(by, F.posexplode(mask).alias("at", "bits"))
    return words.groupBy(by, "at").agg(F.bit_or("bits").alias("bits"))


def band_gate(mask: Column, first: Column, last: Column, above: float, below: float, grid: Grid) -> Column:
    """The mask within the rows from `first` to `last`, widened by shares of their number, where these are two rows at least."""
    tall = F.greatest(F.lit(1), last - first + 1)
    top = F.greatest(F.lit(0), F.rint(first - tall * above).cast("int"))
    bottom = F.least(F.lit(grid.height - 1), F.rint(last + tall * below).cast("int"))
    return F.when(F.coalesce(bottom > top, F.lit(False)), grid.band(mask, top, bottom)).otherwise(mask)
