"""Sharding by jump consistent hashing: stable keys, no ring table, minimal movement when a shard is appended."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of

#: Multiplier of the linear congruential generator in the published jump consistent hash.
JUMP_MULTIPLIER = np.uint64(2862933555777941757)
#: Rows of a shard are numbered in this many blocks, so that numbering never puts a shard into one task.
BLOCKS = 1024
#: A block of more rows than this, and than eight times the mean, holds keys that repeat very often: each of these is numbered by itself, in PARTS parts.
HOT_ROWS, PARTS = 100_000, 64


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys: each key's shard in [0, shards)."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = keys.astype(np.uint64)
    at = np.full(len(state), -1, np.int64)
    ahead = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    while len(going):
        at[going] = ahead[going]
        state[going] = state[going] * JUMP_MULTIPLIER + np.uint64(1)
        step = float(1 << 31) / ((state[going] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[going] = ((at[going] + 1).astype(np.float64) * step).astype(np.int64)
        going = going[ahead[going] < shards]
    return at


def digest_of(column: Column) -> Column:
    """The md5 of any column's text, the same in every engine that has md5; null counts as empty text."""
    return F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def stable_key(column: Column) -> Column:
    """A 60-bit key: the first 15 digits of the digest."""
    return F.conv(F.substring(digest_of(column), 1, 15), 16, 10).cast("long")


def block_of(column: Column) -> Column:
    """One of BLOCKS blocks, by the three digits after those of the key."""
    return F.floor(F.conv(F.substring(digest_of(column), 16, 3), 16, 10).cast("int") / (4096 // BLOCKS)).cast("int")


def jump_shard(column: Column, shards: int) -> Column:
    """The shard of a stable key, as an int column."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return shard(stable_key(column))


def _segment(own: DataFrame, told: DataFrame, hot: list[int], least: int) -> Column:
    """A row's place among the keys of its block that hold more than `least` rows: odd for such a key, even between two; 0 in all other blocks."""
    if not hot:
        return F.lit(0)
    counted = told.where(F.col("_block").isin(hot)).groupBy("_block", "_key").agg(F.count("*").alias("_n")).where(F.col("_n") > least).collect()
    kind = own.schema["_key"].dataType
    found = F.lit(0)
    for block in sorted({r["_block"] for r in counted}):
        keys = [F.lit(r["_key"]).cast(kind) for r in counted if r["_block"] == block]
        before = [F.when((k.isNull() & F.col("_key").isNotNull()) | F.coalesce(k < F.col("_key"), F.lit(False)), 2).when(k.eqNullSafe(F.col("_key")), 1).otherwise(0) for k in keys]
        found = F.when(F.col("_block") == block, sum(before[1:], before[0])).otherwise(found)
    return found


def shard_documents(
    docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", overhead: int = 8
) -> DataFrame:
    """Places every row by the law `key`: the key and the number of shards decide.

    Returns key, size (UTF-8 bytes of the text, null as none, plus `overhead`),
    text_crc32, law, shard, slot and grown_shard (the shard with one shard more: the
    same, or the new one). Equal texts with different keys may go to different shards.

    slot numbers the rows of a shard from 0 without gaps, by block, then by key (null first), a hash of the text, size
    and checksum, at every size of the table. A block is a hash of the key; block sizes are counted in a first
    pass that reads only the key column, and the shards x BLOCKS offsets, a table of
    fixed size, are broadcast. So no task ever holds a whole shard. In a block that is far
    larger than the others, keys that hold half of that bound or more (a few thousand at most, whatever the size of the table) are numbered
    by themselves and by parts of the hash, between the other keys of their block. Rows that repeat with one key get slots of
    their own. A null key counts as empty text; an empty table gives an empty result;
    other columns of the input are not read.
    """
    own = docs.select(F.col(key).alias("_key"), text_of(docs, text).alias("_text"))
    block = block_of(F.col("_key")).alias("_block")
    shard = jump_shard(F.col("_key"), shards).alias("shard")
    counts = own.select(shard, block).groupBy("shard", "_block").agg(F.count("*").alias("_n")).collect()
    limit = max(HOT_ROWS, 8 * sum(r["_n"] for r in counts) // (shards * BLOCKS))
    hot = sorted({r["_block"] for r in counts if r["_n"] > limit})
    told = own.withColumns({"_block": block_of(F.col("_key")), "_part": F.pmod(F.xxhash64("_text"), F.lit(PARTS)).cast("int")})
    told = told.withColumn("_segment", _segment(own, told, hot, limit // 2)).withColumn("_split", F.when(F.col("_segment") % 2 == 1, F.col("_part")).otherwise(0))
    sizes = [(r["shard"], r["_block"], 0, 0, r["_n"]) for r in counts if r["_block"] not in hot]
    if hot:
        again = told.where(F.col("_block").isin(hot)).groupBy(shard, "_block", "_segment", "_split").agg(F.count("*"))
        sizes += [tuple(r) for r in again.collect()]
    bases, reached = [], {}
    for at, b, segment, split, n in sorted(sizes):
        bases.append((at, b, segment, split, reached.get(at, 0)))
        reached[at] = reached.get(at, 0) + n
    offsets = F.broadcast(docs.sparkSession.createDataFrame(bases, "shard int, _block int, _segment int, _split int, _base long"))
    rows = told.select(
        "_key",
        (F.octet_length("_text") + overhead).cast("long").alias("size"),
        F.crc32(F.col("_text").cast("binary")).alias("text_crc32"),
        shard,
        jump_shard(F.col("_key"), shards + 1).alias("grown_shard"),
        "_block",
        "_segment",
        "_split",
        "_part",
    )
    inner = "row_number() OVER (PARTITION BY shard, _block, _segment, _split ORDER BY _key, _part, size, text_crc32) - 1 AS _inner"
    numbered = rows.selectExpr("*", inner).join(offsets, ["shard", "_block", "_segment", "_split"], "left")
    return numbered.select(
        F.col("_key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_base") + F.col("_inner")).cast("long").alias("slot"),
        "grown_shard",
    )
