"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CLASS, Scratch, text_of


def normalised(text: Column) -> Column:
    """The text without its white space (the six ASCII characters of the contract)."""
    return F.regexp_replace(text, SPACE_CLASS + "+", "")


def exact_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", head: int = 64, digest_all: bool = False, row: str | None = None
) -> DataFrame:
    """Groups of rows whose normalised texts are equal, and the row of each group that stays.

    Returns one row per input row: key, keep_id, group_size, kept and digest (binary
    SHA-256 of the normalised text). Three levels narrow the rows down: lengths held by
    more than one row, then (length, hash of the first `head` characters), then the
    full hash. With digest_all=False the full hash is taken of the survivors of the
    first two levels only, by a second read of their texts, and digest is null for the
    rest. With digest_all=True the caller wants every row's digest, so it is taken in
    the one scan and the second read is saved.

    Of a group, the row with the most code points in its original text stays, then the
    one with the smallest key. A null text counts as empty, and all empty texts are
    equal. Rows that repeat with one key and text form a group, of which one stays
    (the first in scan order); a null key loses every tie. An empty table gives an
    empty result. Other columns of the input are not read.

    Every level is a narrow table: counts are combined before their shuffle, so a group
    of a third of all rows is one row there. Rows meet the surviving groups, read back
    from a staged table, in a join at the end of its own job: there adaptive execution
    can split a hot key.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(F.col(key).alias("_id"), text_of(docs, text).alias("_text"), *([number.alias("_row")] if row else []))
    rows = rows.select("_id", F.length("_text").alias("_points"), normalised(F.col("_text")).alias("_norm"), *(["_row"] if row else []))
    shape = [
        *(["_row"] if row else []),
        "_id",
        "_points",
        F.length("_norm").alias("_len"),
        F.xxhash64(F.substring("_norm", 1, head)).alias("_head"),
    ]
    full = F.unhex(F.sha2("_norm", 256)).alias("_sha")
    seen = rows.select(*shape, full) if digest_all else rows.select(*shape, F.lit(None).cast("binary").alias("_sha"))
    seen = scratch.stage(seen if row else seen.withColumn("_row", number), "rows")

    lengths = seen.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1").select("_len")
    lengths = scratch.stage(lengths, "repeated-lengths")
    same_length = scratch.stage(seen.join(lengths, "_len", "left_semi"), "lengths")
    heads = same_length.groupBy("_len", "_head").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    heads = scratch.stage(heads, "repeated-heads")
    same_head = scratch.stage(same_length.join(heads, ["_len", "_head"], "left_semi"), "heads")
    if not digest_all:
        again = rows.select(*shape, full)
        wanted = same_head.select("_id", "_len", "_head").distinct()
        digests = again.join(wanted, [again["_id"].eqNullSafe(wanted["_id"]), again["_len"] == wanted["_len"], again["_head"] == wanted["_head"]], "left_semi")
        same_head = scratch.stage(digests if row else digests.withColumn("_row", number), "digests")

    level = ["_len", "_head", "_sha"]
    best = F.min(F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("z"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = same_head.groupBy(*level).agg(F.count("*").alias("_n"), best.alias("_best")).where("_n > 1")
    groups = groups.select(*level, "_n", F.col("_best.id").alias("_keep"), F.col("_best.row").alias("_keep_row"))
    groups = scratch.stage(groups, "groups")
    if digest_all:
        found = seen.join(groups, level, "left")
    else:
        alone = seen.join(heads, ["_len", "_head"], "left_anti")
        found = same_head.join(groups, level, "left").unionByName(
            alone.select(*same_head.columns).withColumns(
                {"_n": F.lit(None).cast("long"), "_keep": F.lit(None).cast(docs.schema[key].dataType), "_keep_row": F.lit(None).cast(seen.schema["_row"].dataType)}
            )
        )
    scratch.keep_only("rows", "groups", *([] if digest_all else ["repeated-heads", "heads", "digests"]))
    in_group = F.col("_n").isNotNull()
    return found.select(
        F.col("_id").alias(key),
        F.when(in_group, F.col("_keep")).otherwise(F.col("_id")).alias("keep_id"),
        F.when(in_group, F.col("_n")).otherwise(F.lit(1).cast("long")).alias("group_size"),
        F.when(in_group, F.col("_row") == F.col("_keep_row")).otherwise(F.lit(True)).alias("kept"),
        F.col("_sha").alias("digest"),
        *([F.col("_row").alias(row)] if row else []),
    )
