"""The prefix trie of conversations, built level by level: group by (parent node, next turn) going down, join and sum going up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, lean, small_batches
from tessera.llm.turns import placed, turn_digest

#: Turns that a conversation takes over from its donor at most, and conversations that share a donor (the contract's figures).
FOLDS, SHARING = 9, 5
#: Bits of a conversation's number that one list of members spans: a list has at most two to this power.
LIST_BITS = 14


def rebuilt_turns(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Every conversation c as the first h turns of conversation c - c % 5 and its own turns after its first h.

    Returns turns (conv_id, depth from 1, digest of role and text, bytes of the text, length of the
    rebuilt conversation) and lengths (conv_id, length, 0 for a conversation without turns).
    h is the unsigned crc32 of the decimal conv_id modulo 9.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    own = scratch.stage(placed(own, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], scratch, "own"), "own")
    scratch.drop("own-sorted")
    sizes = own.where("place = 1").select("conv_id", F.col("total").alias("n"))
    told = sizes.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % FOLDS)).withColumn("donor", F.col("conv_id") - F.col("conv_id") % SHARING)
    donors = sizes.select(F.col("conv_id").alias("donor"), F.col("n").alias("n_donor"))
    told = told.join(donors, "donor", "left").withColumn("taken", F.least("h", F.coalesce("n_donor", F.lit(0))))
    told = told.select("conv_id", "donor", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    told = scratch.stage(told, "lengths")
    kept = own.join(told, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "bytes", "length")
    given = own.where(f"place < {FOLDS}").select(F.col("conv_id").alias("donor"), "place", "digest", "bytes")
    taken = told.where("taken > 0").join(given, "donor").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "digest", "bytes", "length")
    turns = scratch.stage(kept.unionByName(taken).sortWithinPartitions("depth"), "turns")
    scratch.drop("own")
    return turns, told.select("conv_id", "length")


def digest_of_members(members: DataFrame, node: list[str]) -> DataFrame:
    """For each node, the SHA-256 of its members' decimal conv_ids, ascending and joined by commas, as ends_sha256.

    Members are joined to lists that span a fixed range of numbers, so no list is longer than
    that range; a node's lists then stream through one task, which holds one of them at a time: a digest of a
    sequence can only be taken in order.
    """
    spans = members.groupBy(*node, F.shiftright("conv_id", LIST_BITS).alias("_span")).agg(F.array_sort(F.collect_list("conv_id")).alias("_ids"))
    lists = spans.select(*node, "_span", F.array_join(F.col("_ids").cast("array<string>"), ",").alias("_list"))
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in node) + ", ends_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []

        def flushed() -> pa.RecordBatch:
            columns = [pa.array([d[0][i] for d in done], pa.int64()) for i in range(len(node))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], pa.string())], [*node, "ends_sha256"])

        for batch in batches:
            for row in zip(*[batch.column(batch.schema.names.index(c)).to_pylist() for c in (*node, "_list")]):
                if row[:-1] != at:
                    if state is not None:
                        done.append((at, state.hexdigest()))
                    at, state = row[:-1], hashlib.sha256(row[-1].encode())
                else:
                    state.update(b"," + row[-1].encode())
            if len(done) >= 1024:
                yield flushed()
                done = []
        if state is not None:
            done.append((at, state.hexdigest()))
        yield flushed()

    dealt = lists.repartition(*node).sortWithinPartitions(*node, "_span")
    return dealt.mapInArrow(lean(run), schema)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, all numbers long.

    conversations has conv_id (a whole number), turn, role and text; further columns are not read. A
    null role or text counts as empty; turns come in the order of turn, null first, and equal ones by a digest of
    role and text. Rows without a conv_id belong to no conversation. Returns conv_id (the smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 as
    the contract has them. An empty table gives an empty result; a table whose conversations are all
    turnless once rebuilt gives the root alone.

    Going down, each level groups the live conversations, those at a node with two or more
    members, by (node, digest of the next turn), with counts and minima combined before the shuffle; live
    conversations meet their new node by a join, where adaptive execution can split a hot one. A
    node of one member starts a chain of its conversation's other turns that no other shares: its
    nodes are written out at once, so levels go on only as deep as texts are shared. Going up, each level's
    leaves and savings are summed by parent and joined to the level above. Each level is
    a staged table, so a lost executor costs tasks of one level only.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "prefix-trie")
    turns, lengths = rebuilt_turns(conversations, scratch)
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.selectExpr("conv_id", "CAST(NULL AS LONG) AS parent", "n_convs", "CAST(0 AS LONG) AS bytes")
    levels = [scratch.stage(root, "level-0")]
    first = levels[0].first()
    live = lengths.withColumn("node", F.lit(first["conv_id"] if first else None).cast("long"))
    ends = [live.where("length = 0").select(F.lit(0).cast("long").alias("depth"), "node", "conv_id")]
    alone = []
    depth, going = 0, first is not None
    while going:
        depth += 1
        here = turns.where(F.col("depth") == depth).select("conv_id", "digest", "bytes")
        met = live.where(F.col("length") >= depth).join(here, "conv_id")
        met = scratch.stage(met.select("conv_id", "length", F.col("node").alias("parent"), "digest", "bytes"), f"met-{depth}")
        groups = met.groupBy("parent", "digest").agg(
            F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("length").alias("length")
        )
        groups = scratch.stage(groups, f"groups-{depth}")
        levels.append(groups.select(F.col("node").alias("conv_id"), "parent", "n_convs", "bytes"))
        alone.append(groups.where("n_convs = 1").select("node", F.lit(depth).cast("long").alias("depth"), "parent", "length"))
        shared = groups.where("n_convs > 1").select("parent", "digest", "node")
        live = scratch.stage(met.join(shared, ["parent", "digest"]).select("conv_id", "length", "node"), f"live-{depth}")
        ends.append(live.where(F.col("length") == depth).select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id"))
        scratch.drop(f"met-{depth}")
        going = bool(live.where(F.col("length") > depth).limit(1).count())

    nodes, below = [], None
    for at in range(depth, -1, -1):
        level = levels[at].where("n_convs > 1 OR parent IS NULL")
        summed = F.lit(0).cast("long")
        if below is None:
            level = level.withColumns({"n_children": summed, "_leaves": summed, "_saved": summed})
        else:
            level = level.join(below, level["conv_id"] == below["_parent"], "left").drop("_parent")
        own = (F.col("n_convs") - 1) * F.col("bytes")
        level = level.select(
            "conv_id",
            "parent",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.when(F.coalesce("n_children", F.lit(0)) == 0, F.lit(1)).otherwise(F.col("_leaves")).cast("long").alias("n_leaves"),
            (own + F.coalesce("_saved", F.lit(0))).cast("long").alias("saved_tokens"),
        )
        level = scratch.stage(level, f"up-{at}")
        nodes.append(level.withColumn("depth", F.lit(at).cast("long")))
        if at:
            parts = level.select("parent", "n_leaves", "saved_tokens")
            single = levels[at].where("n_convs = 1").select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
            below = parts.unionByName(single).groupBy(F.col("parent").alias("_parent")).agg(
                F.count("*").alias("n_children"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved")
            )

    union = lambda frames: _stacked(frames)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    members = digest_of_members(union(ends), ["depth", "node"])
    shared = union(nodes).join(members.withColumnRenamed("node", "conv_id"), ["depth", "conv_id"], "left")
    shared = shared.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
    if not alone:
        return shared
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    chain = union(alone).select("*", F.explode(F.sequence("depth", "length")).alias("_depth"))
    last = F.col("_depth") == F.col("length")
    chain = chain.select(
        F.col("node").alias("conv_id"),
        F.col("_depth").alias("depth"),
        F.when(F.col("_depth") == F.col("depth"), F.col("parent")).otherwise(F.col("node")).alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(last, none).otherwise(one).alias("n_children"),
        one.alias("n_leaves"),
        none.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("node").cast("string").cast("binary"), 256)).otherwise(empty).alias("ends_sha256"),
    )
    return shared.unionByName(chain)


def _stacked(frames: list[DataFrame]) -> DataFrame:
    """The rows of all, paired off so that many levels do not make a deep plan."""
    while len(frames) > 1:
        frames = [a.unionByName(b) for a, b in zip(frames[::2], frames[1::2])] + ([frames[-1]] if len(frames) % 2 else [])
    return frames[0]
