"""Joins, de-duplication, ordering and sampling that stand for the loops of a file-based dataset builder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def first_match(left: DataFrame, right: DataFrame, key: str, rank: Column, *order: str) -> DataFrame:
    """Inner join on key with the right row of the smallest rank; right columns but the key must not clash."""
    best = right.groupBy(key).agg(F.min_by(F.struct(*[c for c in right.columns if c != key]), F.struct(rank.alias("r"), *order)).alias("_best"))
    return left.join(best.select(key, "_best.*"), key)


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows whose key the right side does not have."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def keep_one(df: DataFrame, key: str | list[str], order: list[Column], last: bool) -> DataFrame:
    """One row per key: the last or first by an explicit order, combined before the shuffle; with n, the rows there were."""
    keys = [key] if isinstance(key, str) else key
    rest = F.struct(*[c for c in df.columns if c not in keys])
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    pick = (F.max_by if last else F.min_by)(rest, place)
    return df.groupBy(*keys).agg(pick.alias("_row"), F.count("*").alias("n")).select(*keys, "_row.*", "n")


def with_position(df: DataFrame, block: Column, order: list[Column], out: str = "position") -> tuple[DataFrame, Column]:
    """Adds each row's place from 0 in a global order, and gives the number of rows as a column over it.

    block must rise with the order, be null for no row and take a bounded number of values, some ten thousand at most. Rows are numbered
    within their block; the blocks' offsets are a small table and broadcast.
    """
    keyed = df.withColumn("_block", block)
    sizes = keyed.groupBy("_block").agg(F.count("*").alias("_size"))
    offsets = sizes.selectExpr("_block", "sum(_size) OVER (ORDER BY _block) - _size AS _before", "sum(_size) OVER () AS _total")
    inner = F.row_number().over(Window.partitionBy("_block").orderBy(*order)) - 1
    placed = keyed.withColumn("_inner", inner).join(F.broadcast(offsets), "_block")
    placed = placed.withColumn(out, (F.col("_before") + F.col("_inner")).cast("long"))
    return placed.drop("_block", "_inner", "_before"), F.col("_total")


def hash_order(key: str) -> tuple[Column, list[Column]]:
    """A shuffled order that is the same everywhere: by md5 of the key, then the key; with its 65,536 blocks, by the first four digits. A null key comes first."""
    digest = F.coalesce(F.md5(F.col(key).cast("string")), F.lit(""))
    return F.substring(digest, 1, 4), [digest, F.col(key)]


def range_block(df: DataFrame, key: str, blocks: int = 64) -> Column:
    """Blocks of a numeric order, by approximate quantiles of the key."""
    cuts = sorted(set(df.approxQuantile(key, [i / blocks for i in range(1, blocks)], 0.005)))
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    return F.coalesce(F.size(F.filter(bounds, lambda c: c <= F.col(key))), F.lit(0))


def assign_split(df: DataFrame, key: str, train: float = 0.85, val: float = 0.10) -> DataFrame:
    """Adds split: shares of the rows in hash order, halves to even, what is left is the test split."""
    block, order = hash_order(key)
    placed, total = with_position(df, block, order)
    n_train = F.least(F.rint(total * train).cast("long"), total)
    n_val = F.least(F.rint(total * val).cast("long"), total - n_train)
    split = F.when(F.col("position") < n_train, "train").when(F.col("position") < n_train + n_val, "val").otherwise("test")
    return placed.withColumn("split", split).drop("position", "_total")


def stride_sample(df: DataFrame, block: Column, order: list[Column], most: int) -> DataFrame:
    """A systematic sample: the rows at rint(i * n / most), or all rows where there are no more than `most`.

    Whether a place is taken is worked out from the place itself: no table of places is made.
    """
    placed, total = with_position(df, block, order)
    step = total / F.lit(float(most))
    guess = F.floor(F.col("position") / step)
    taken = F.lit(False)
    for d in (-1, 0, 1, 2):
        i = guess + d
        taken = taken | ((i >= 0) & (i < most) & (F.least(F.rint(i * step).cast("long"), total - 1) == F.col("position")))
    return placed.where((total <= most) | taken).drop("_total")


def ranked_best(df: DataFrame, by: list[str], score: Column, *ties: Column) -> DataFrame:
    """The row of the highest score of each group; of equal scores the first by the tie columns."""
    rest = F.struct(*[c for c in df.columns if c not in by])
    place = F.struct((-score).alias("s"), *[t.alias(f"t{i}") for i, t in enumerate(ties)])
    return df.groupBy(*by).agg(F.min_by(rest, place).alias("_row")).select(*by, "_row.*")
