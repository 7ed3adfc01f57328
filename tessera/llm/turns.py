"""Rows of conversations in order: places within a group that may hold any share of all rows, and sums over rows that stream by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a role and a text that tells them apart: the role's length comes first."""
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.sha2(told.cast("binary"), 256))


def placed(rows: DataFrame, group: str, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """The rows with place, from 1, and total, the number of rows of their group.

    The rows are sorted over all groups by ranges, written down, and counted by group and range. So a
    group of any size is spread over many ranges, and no task ever holds it; rows that are equal in all
    are told apart by where they were read, so they are split as well. Null groups are one group.
    """
    tie = F.monotonically_increasing_id()
    ranged = rows.withColumn("_tie", tie)
    keys = [F.col(group).asc_nulls_first(), *order, F.col("_tie")]
    ranged = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    ranged = scratch.stage(ranged, f"{name}-sorted").withColumn("_range", F.shiftright("_at", 33))
    counts = ranged.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_of")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = "sum(_n) OVER (PARTITION BY _group ORDER BY _of) - _n AS _before"
    counts = counts.selectExpr("_group", "_of", "_first", before, "sum(_n) OVER (PARTITION BY _group) AS total")
    found = ranged.join(counts, ranged[group].eqNullSafe(counts["_group"]) & (ranged["_range"] == counts["_of"]))
    return found.withColumn("place", F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_range", "_group", "_of", "_first", "_before")
