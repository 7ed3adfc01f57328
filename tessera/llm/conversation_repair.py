"""Repair of conversations by cheapest edits: a time-major dynamic program over roles, for many conversations at a time.

A repaired conversation's role initials are nothing, or an optional s and then pairs of u and a. That is an
automaton of four states: nothing yet, after s, after u, after a. The program's tensors have an axis for
turns, one for states and one for conversations of about one length; what it costs to end well from each is stored going
backwards in time, and edits are traced going forwards, for all conversations of a bucket at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CLASS, Scratch, lean, small_batches
from tessera.llm.turns import placed, turn_digest

#: Costs of edits (the contract's figures): another role, a deletion, an insertion, and a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Bits of a turn's code: its role (0 any other, 1 s, 2 u, 3 a) in the lowest two, then its first fault.
ROLE, BLANK, REPEAT, CUT = 3, 4, 8, 16
#: No turn: what fills up a bucket.
PAD = 255
#: States of the automaton, the state that an inserted or re-roled turn leads to from each, and a cost that nothing reaches.
STATES, STEP, NEVER = 4, np.array([2, 2, 3, 2]), 1 << 28
#: What it costs to end in each state.
ENDING = np.array([0, NEVER, NEVER, 0], np.int32)
#: Turns that are worked on together; a longer conversation goes in segments, joined by costs of getting through them.
SEGMENT = 1024
#: Turns times conversations of one tensor.
CELLS = 1 << 19

D, I, K, R = b"DIKR"


def keep_step(role: np.ndarray, state: int) -> np.ndarray:
    """The state after a kept turn of a role, -1 where the automaton does not allow it."""
    allowed = {0: {1: 1, 2: 2}, 1: {2: 2}, 2: {3: 3}, 3: {2: 2}}[state]
    return np.array([allowed.get(r, -1) for r in range(4)])[role]


def relaxed(costs: np.ndarray) -> np.ndarray:
    """Costs by state (first axis) once turns may be inserted; more than two insertions in a row never pay."""
    once = np.minimum(costs, INSERT + costs[STEP])
    return np.minimum(once, INSERT + once[STEP])


def backward(codes: np.ndarray, ending: np.ndarray) -> np.ndarray:
    """Costs to end by turn, state and conversation: codes is turns by conversations, ending states by conversations."""
    turns, many = codes.shape
    costs = np.empty((turns + 1, STATES, many), np.int32)
    costs[turns] = ending
    role, must, cut = codes & ROLE, (codes & (BLANK | REPEAT)) > 0, np.where(codes & CUT, TRUNCATED, 0)
    for t in range(turns - 1, -1, -1):
        after = costs[t + 1]
        best = DELETE + after
        for state in range(STATES):
            to = keep_step(role[t], state)
            kept = np.where(to >= 0, after[np.maximum(to, 0), np.arange(many)], NEVER)
            stays = cut[t] + np.minimum(kept, REROLE + after[STEP[state]])
            best[state] = np.where(must[t], best[state], np.minimum(best[state], stays))
        costs[t] = np.where(codes[t] == PAD, after, np.minimum(relaxed(best), NEVER))
    return costs


def forward(codes: np.ndarray, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits (steps by conversations, 0 for none) of the cheapest ways from a state, the ASCII-least of equal ones, and the states they end in.

    Turns may be inserted before each turn, and after the last one where `last` says that the conversation ends there.
    """
    turns, many = codes.shape
    edits = np.zeros((3 * turns + 2, many), np.uint8)
    every, state = np.arange(many), state.copy()
    for t in range(turns + 1):
        open_ = last & (costs[t, state, every] != ENDING[state]) if t == turns else codes[t] != PAD
        for again in range(3 if t < turns else 2):
            now, inserted = costs[t, state, every], STEP[state]
            chosen = np.zeros(many, np.uint8)
            following = state
            if t < turns:
                role, cut = codes[t] & ROLE, np.where(codes[t] & CUT, TRUNCATED, 0)
                free = (codes[t] & (BLANK | REPEAT)) == 0
                to = np.choose(state, [keep_step(role, s) for s in range(STATES)])
                kept = np.where(to >= 0, costs[t + 1, np.maximum(to, 0), every], NEVER)
                ways = [
                    (D, DELETE + costs[t + 1, state, every] == now, state),
                    (I, INSERT + costs[t, inserted, every] == now, inserted),
                    (K, free & (cut + kept == now), to),
                    (R, free & (cut + REROLE + costs[t + 1, inserted, every] == now), inserted),
                ]
            else:
                ways = [(I, INSERT + costs[t, inserted, every] == now, inserted)]
            for letter, holds, where in ways:
                takes = open_ & (chosen == 0) & holds
                chosen[takes] = letter
                following = np.where(takes, where, following)
            edits[3 * t + again] = chosen
            state = following
            open_ = open_ & ((chosen == I) if t < turns else (chosen == I) & (costs[t, state, every] != ENDING[state]))
    return edits, state


def letters(edits: np.ndarray) -> list[str]:
    """Each conversation's edits as text."""
    return [bytes(column[column > 0]).decode() for column in np.ascontiguousarray(edits.T)]


def buckets(codes: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of conversations and their codes, turns by conversations, in buckets whose lengths differ by less than a half or eight."""
    lengths = np.fromiter(map(len, codes), np.int64, len(codes))
    rank = np.where(lengths <= 8, 3, np.ceil(2 * np.log2(np.maximum(lengths, 1))).astype(int) + 3)
    for r in np.unique(rank):
        own = np.flatnonzero(rank == r)
        tall = int(lengths[own].max())
        for part in np.array_split(own, max(1, -(-len(own) * max(1, tall) // CELLS))):
            block = np.full((tall, len(part)), PAD, np.uint8)
            for column, i in enumerate(part):
                block[: lengths[i], column] = np.frombuffer(codes[i], np.uint8)
            yield part, block


def solve(codes: list[bytes]) -> tuple[np.ndarray, list[str]]:
    """Cost and edits of whole conversations."""
    costs, audits = np.zeros(len(codes), np.int64), [""] * len(codes)
    for part, block in buckets(codes):
        back = backward(block, relaxed(np.repeat(ENDING[:, None], len(part), 1)))
        edits, _ = forward(block, back, np.zeros(len(part), np.int64), np.ones(len(part), bool))
        costs[part] = back[0, 0]
        for i, audit in zip(part, letters(edits)):
            audits[i] = audit
    return costs, audits


def crossings(codes: list[bytes]) -> np.ndarray:
    """What it costs to get through each segment: by segment, state before and state after."""
    out = np.zeros((len(codes), STATES, STATES), np.int64)
    for part, block in buckets(codes):
        for after in range(STATES):
            ending = np.full((STATES, len(part)), NEVER, np.int32)
            ending[after] = 0
            out[part, :, after] = backward(block, ending)[0].T
    return out


def traced(codes: list[bytes], ending: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
    """For each segment, by the state before it: the state after it and the edits, given costs to end after it."""
    states, audits = np.zeros((len(codes), STATES), np.int64), [[""] * STATES for _ in codes]
    for part, block in buckets(codes):
        back = backward(block, ending[part].T.astype(np.int32))
        for before in range(STATES):
            edits, after = forward(block, back, np.full(len(part), before), last[part])
            states[part, before] = after
            for i, audit in zip(part, letters(edits)):
                audits[i][before] = audit
    return states, audits


def counts_of(codes: bytes, before: int | None) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated turns, and adjacent initials that are not su, ua or au; before is the role ahead of the first turn."""
    told = np.frombuffer(codes, np.uint8)
    role = told & ROLE
    first, second = role[:-1], role[1:]
    fits = lambda a, b: ((a == 1) & (b == 2)) | ((a == 2) & (b == 3)) | ((a == 3) & (b == 2))
    illegal = int((~fits(first, second)).sum()) + int(before is not None and not fits(np.uint8(before), role[0]))
    return int(((told & BLANK) > 0).sum()), int(((told & REPEAT) > 0).sum()), int(((told & CUT) > 0).sum()), illegal


# -- Spark ---------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: conv_id, turn, role, text, by crc32 of `conv_id:turn` modulo 20; a null counts as one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _codes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, place, total and code of every row after damage, without its text."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    bare = F.regexp_replace("text", SPACE_CLASS + "+$", "")
    blank = F.regexp_replace("text", "^" + SPACE_CLASS + "+", "") == ""
    fault = F.when(blank, BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(0)
    narrow = rows.select("conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), role.alias("role"), fault.alias("fault"))
    narrow = scratch.stage(placed(narrow, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], scratch, "rows"), "rows")
    scratch.drop("rows-sorted")
    seen = narrow.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min("place").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    met = narrow.join(seen, narrow["conv_id"].eqNullSafe(seen["_conv"]) & (narrow["digest"] == seen["_digest"]), "left")
    repeat = (F.col("fault") != BLANK) & F.coalesce(F.col("place") > F.col("_first"), F.lit(False))
    code = F.col("role") + F.when(repeat, REPEAT).otherwise(F.col("fault"))
    return met.select("conv_id", "turn", "place", "total", code.cast("int").alias("code"))


def _segments(codes: DataFrame) -> DataFrame:
    """conv_id, segment, segments, before (the role ahead of a segment, null for the first) and codes as an array by place."""
    number = F.floor((F.col("place") - 1) / SEGMENT).cast("long")
    ends = (F.col("place") % SEGMENT == 0) & (F.col("place") < F.col("total"))
    own = F.struct(number.alias("segment"), F.lit(False).alias("ahead"))
    rows = codes.withColumn("_to", F.explode(F.when(ends, F.array(own, F.struct((number + 1).alias("segment"), F.lit(True).alias("ahead")))).otherwise(F.array(own))))
    listed = F.array_sort(F.collect_list(F.struct("place", "code")))
    rows = rows.groupBy("conv_id", F.col("_to.segment").alias("segment"), F.ceil(F.col("total") / SEGMENT).alias("segments")).agg(
        F.max(F.when(F.col("_to.ahead"), F.col("code"))).alias("before"), listed.alias("_listed"), F.max(F.col("_to.ahead")).alias("_ahead")
    )
    own = F.when(F.col("_ahead"), F.slice("_listed", 2, SEGMENT)).otherwise(F.col("_listed"))
    return rows.select("conv_id", "segment", "segments", F.col("before").bitwiseAND(F.lit(ROLE)).alias("before"), F.transform(own, lambda x: x["code"].cast("byte")).alias("codes"))


def _bytes_of(column: pa.ListArray) -> list[bytes]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.uint8), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    return [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, cost and edits of conversations of one segment."""
    for batch in batches:
        codes = _bytes_of(batch.column("codes"))
        costs, audits = solve(codes)
        told = np.array([counts_of(c, None) for c in codes], np.int64).reshape(-1, 4)
        columns = [batch.column("conv_id"), *[pa.array(told[:, i]) for i in range(4)], pa.array(costs), pa.array(audits, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of segments, and costs of getting through them."""
    for batch in batches:
        codes = _bytes_of(batch.column("codes"))
        told = np.array([counts_of(c, b) for c, b in zip(codes, batch.column("before").to_pylist())], np.int64).reshape(-1, 4)
        through = pa.array([m.ravel().tolist() for m in crossings(codes)], pa.list_(pa.int64()))
        columns = [batch.column("conv_id"), batch.column("segment"), *[pa.array(told[:, i]) for i in range(4)], through]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "segment", "blank", "duplicate", "truncated", "illegal", "through"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every segment of a conversation, costs to end after it, from the last segment backwards."""
    for batch in batches:
        rows = []
        for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist()):
            ending = relaxed(ENDING.astype(np.int64))
            for part in sorted(parts, key=lambda p: -p["segment"]):
                rows.append((conv, part["segment"], ending.tolist()))
                ending = np.minimum(NEVER, (np.array(part["through"]).reshape(STATES, STATES) + ending).min(axis=1))
        conv, segment, ending = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(conv, batch.schema.field("conv_id").type), pa.array(segment, pa.int64()), pa.array(ending, pa.list_(pa.int64()))], ["conv_id", "segment", "ending"])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of every segment by the state before it, and the states after it."""
    for batch in batches:
        ending = np.array(batch.column("ending").to_pylist(), np.int64).reshape(-1, STATES)
        last = np.array(batch.column("last").to_pylist(), bool)
        states, audits = traced(_bytes_of(batch.column("codes")), ending, last)
        columns = [batch.column("conv_id"), batch.column("segment"), pa.array(states.tolist(), pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "segment", "states", "audits"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's edits from those of its segments, from the first on, and what they cost."""
    for batch in batches:
        audits, costs = [], []
        for parts in batch.column("parts").to_pylist():
            state, told, parts = 0, [], sorted(parts, key=lambda p: p["segment"])
            for part in parts:
                told.append(part["audits"][state])
                state = part["states"][state]
            audits.append("".join(told))
            cost = relaxed(ENDING.astype(np.int64))
            for part in reversed(parts):
                cost = np.minimum(NEVER, (np.array(part["through"]).reshape(STATES, STATES) + cost).min(axis=1))
            costs.append(int(cost[0]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["conv_id", "cost", "audit"])


def _solved(segments: DataFrame, kind: str, scratch: Scratch) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost and audit of every conversation that has rows."""
    counts = "blank long, duplicate long, truncated long, illegal long"
    found = segments.where("segments = 1").select("conv_id", "codes").mapInArrow(lean(_whole), f"conv_id {kind}, {counts}, cost long, audit string")
    if not segments.where("segments > 1").limit(1).count():
        return found
    long = segments.where("segments > 1")
    crossed = long.select("conv_id", "segment", "before", "codes").mapInArrow(lean(_crossed), f"conv_id {kind}, segment long, {counts}, through array<long>")
    crossed = scratch.stage(crossed, "crossed")
    parts = crossed.groupBy("conv_id").agg(F.collect_list(F.struct("segment", "through")).alias("parts"))
    ending = parts.mapInArrow(lean(_joined), f"conv_id {kind}, segment long, ending array<long>")
    own = ending.select(F.col("conv_id").alias("_conv"), F.col("segment").alias("_segment"), "ending")
    met = long.join(own, long["conv_id"].eqNullSafe(own["_conv"]) & (long["segment"] == own["_segment"]))
    met = met.select("conv_id", "segment", "codes", "ending", (F.col("segment") == F.col("segments") - 1).alias("last"))
    edited = met.mapInArrow(lean(_edited), f"conv_id {kind}, segment long, states array<long>, audits array<string>")
    through = crossed.select(F.col("conv_id").alias("_conv"), F.col("segment").alias("_segment"), "through")
    edited = edited.join(through, edited["conv_id"].eqNullSafe(through["_conv"]) & (edited["segment"] == through["_segment"]))
    parts = edited.groupBy("conv_id").agg(F.collect_list(F.struct("segment", "states", "audits", "through")).alias("parts"))
    chained = parts.mapInArrow(lean(_chained), f"conv_id {kind}, cost long, audit string")
    summed = crossed.groupBy(F.col("conv_id").alias("_conv")).agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    chained = summed.join(chained, summed["_conv"].eqNullSafe(chained["conv_id"])).drop("_conv")
    return found.unionByName(chained)


class Repairer:
    """Applies a conversation's edits to its rows as they come, and digests the lines that stay."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0
        self.digest, self.empty = hashlib.sha256(), True

    def line(self, text: str) -> None:
        self.digest.update((text if self.empty else "\n" + text).encode())
        self.empty = False

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = int(STEP[self.state])
            self.line("user:" if self.state == 2 else "assistant:")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
            self.line(f"{role}:{text}")
        elif edit == "R":
            self.state = int(STEP[self.state])
            self.line(("user:" if self.state == 2 else "assistant:") + text)

    def finished(self) -> str:
        self.inserted()
        return self.digest.hexdigest()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams a conversation's edits and then its rows: digests of what they become; no conversation is held."""
    now, repairer, done, kind = None, None, [], None

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], ["conv_id", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, head, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "head", "role", "text")]):
            if head:
                if repairer is not None:
                    done.append((now, repairer.finished()))
                now, repairer = conv, Repairer(text)
            else:
                repairer.row(role, text)
        if len(done) >= 1 << 12:
            yield flushed()
            done = []
    if repairer is not None:
        done.append((now, repairer.finished()))
    if done:
        yield flushed()


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair, and a digest of what it becomes.

    conversations has conv_id, turn, role and text; further columns are not read. Returns conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 as the contract has them. A
    null role or text counts as one space, and so does a null conv_id or turn in the damage's checksum; rows
    without a conv_id are one conversation, whose conv_id is null. Turns come by turn, null first, and equal ones by a digest of
    role and text, so repeated rows are neighbours. An empty table gives an empty result.

    Rows get their places by a sort over ranges that splits a conversation of any size, without
    their texts. Codes of one byte a turn are put together by segments of SEGMENT turns, and segments of about one length are
    solved together; a longer conversation's segments are crossed one by one for each
    state, joined backwards by their costs and forwards by their states. Its edits are one text of
    the result, so its segments meet in one row at last. The texts are shuffled once, to stream past their edits.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "conversation-repair")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = damaged(conversations)
    codes = scratch.stage(_codes(rows, scratch), "codes")
    scratch.drop("rows")
    segments = scratch.stage(_segments(codes), "segments")
    solved = _solved(segments, kind, scratch)
    turns = codes.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).where("turn IS NOT NULL")
    gaps = turns.groupBy(F.col("conv_id").alias("_conv")).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    every = conversations.select(F.col("conv_id").alias("_id")).distinct()
    told = every.join(solved, every["_id"].eqNullSafe(solved["conv_id"]), "left").drop("conv_id").join(gaps, F.col("_id").eqNullSafe(gaps["_conv"]), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    told = scratch.stage(told.select(F.col("_id").alias("conv_id"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit")), "told")

    heads = told.select("conv_id", F.lit(True).alias("head"), F.lit(None).cast(conversations.schema["turn"].dataType).alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit("").alias("role"), F.col("audit").alias("text"))
    bodies = rows.select("conv_id", F.lit(False).alias("head"), "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), "role", "text")
    stream = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("head").desc(), F.col("turn").asc_nulls_first(), "digest")
    final = stream.select("conv_id", "head", "role", "text").mapInArrow(lean(_repaired), f"conv_id {kind}, repaired_sha256 string")
    final = final.withColumnRenamed("conv_id", "_conv")
    return told.join(final, told["conv_id"].eqNullSafe(final["_conv"])).drop("_conv")
