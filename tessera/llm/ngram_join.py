"""N-gram Jaccard join: all pairs of texts whose sets of word shingles overlap enough, and their components.

T-occurrence search: two sets can only be similar if one is found in enough of the
other's inverted lists. The search is distributed in two steps, which together are
DivideSkip:

1. Of a set's lists, the T - 1 longest can never be decisive alone, so a similar partner
   is in one of the remaining short ones: the prefix. Prefix entries are shuffled by
   shingle and merged into lists; entries of common shingles, whose lists may be of any
   length, are spread by set instead. The order that makes common shingles long lists comes
   from their counts in a hashed share of the texts; any order gives the same result, a
   good one gives short lists.
2. Sets that meet in a list, and whose sizes and places in the order allow the required
   overlap, are brought together whole in small groups. Of two such sets the smaller must
   hold the shared shingle early enough for a partner of its own size or more: so a passage
   that very many otherwise different texts share makes long lists, and no pairs. In a group the sets' inverted
   lists are searched with DivideSkip: short lists are merged by a heap, long ones are
   probed by binary search, and sets that reach the required overlap are links.

Lists longer than LONG first go through two rounds of random subgroups, whose links
already join a large group of near copies; after that only pairs between different
components are searched, so such a group is never expanded into all its pairs.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, lean, slices, small_batches
from tessera.llm.components import connected_components

WORDS = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: One in SAMPLE texts, by a hash of its set, is counted for the order of shingles.
SAMPLE = 16
#: At most this many common shingles are set apart; the most common ones are.
COMMON = 1 << 20
#: Lists up to this length are searched directly; a group of sets searched together is about as large.
LONG = 64
#: Rows up to which a table of groups by document, of about 100 bytes a row, is broadcast to the scan of the texts.
BROADCAST_ROWS = 200_000
#: Prefix entries (of 20 bytes) that one bucket holds on average; a task merges one or a few buckets in memory.
BUCKET_ENTRIES = 1 << 20
#: Bytes of whole sets that are sent on together, or one set alone.
SET_BYTES = 1 << 23

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_ENTRY = np.dtype([("token", "<u8"), ("key", "<i8"), ("place", "<u4")])


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as long as the longest slice so far."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15) -> None:
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (self.base, self.inverse))
        return self.up, self.down


_POWERS = _Powers()
#: A 64-bit number for each byte, spread by multiplication.
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(40))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LONG_WORD = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[1]
    x = (x ^ (x >> np.uint64(29))) * _ODD[2]
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the first byte's place of every word of lower-cased bytes.

    A word's hash is a polynomial in its bytes modulo 2**64, taken for all words at once
    from running sums, then mixed with its length. A word over 256 bytes, where such
    polynomials can be made to collide, is hashed by itself.
    """
    raw = np.frombuffer(data, np.uint8)
    space = _IS_SPACE[raw]
    edges = np.flatnonzero(np.diff(np.r_[True, space, True]))
    starts, ends = edges[::2], edges[1::2]
    up, down = _POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * down[: len(raw)], out=sums[1:])
    hashes = _mixed((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64) * _ODD[4])
    for i in np.flatnonzero(ends - starts > _LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return hashes, starts


def shingle_sets(texts: list[str], width: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles.

    A-Z are lower-cased, and words end at the six ASCII white-space characters. Fewer
    words than a shingle make one shingle, which no longer text's shingle equals.
    """
    for a, b in slices(texts):
        parts = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts[a:b]]
        hashes, starts = word_hashes(b" ".join(parts))
        ends = np.cumsum([len(p) + 1 for p in parts])
        stops = np.searchsorted(starts, ends)
        n = max(0, len(hashes) - width + 1)
        rolled = hashes[:n] * _ODD[0]
        for i in range(1, width):
            rolled ^= rolled >> np.uint64(29)
            rolled = rolled * _ODD[1] + hashes[i : n + i] * _ODD[i % 5]
        rolled = _mixed(rolled)
        first = 0
        for last in stops.tolist():
            words = last - first
            if words >= width:
                yield np.unique(rolled[first : last - width + 1])
            elif words:
                yield np.array([xxhash.xxh3_64_intdigest(hashes[first:last].tobytes(), seed=words)], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
            first = last


def set_key(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


def short_key(key: bytes) -> int:
    """64 of the 128 bits, by which lists refer to a set; two sets with equal ones only cost a search."""
    return int.from_bytes(key[8:], "little", signed=True)


def required(n: int, m: int, percent: int = PERCENT) -> int:
    """The smallest overlap with which sets of n and m shingles link."""
    return -(-percent * (n + m) // (100 + percent))


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return (((values.astype(np.uint64) * _ODD[3]) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def packed_by_bucket(rows: np.ndarray, by: str, buckets: int) -> tuple[list[int], list[bytes]]:
    """Entries as one packed value per bucket, by the hash of their token or their key."""
    bucket = bucket_of(rows[by], buckets)
    order = np.argsort(bucket, kind="stable")
    found, start = np.unique(bucket[order], return_index=True)
    ends = [*start[1:].tolist(), len(rows)]
    ordered = rows[order]
    return found.tolist(), [ordered[a:b].tobytes() for a, b in zip(start.tolist(), ends)]


def in_order(tokens: np.ndarray, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """Sorted shingles in the global order, the common ones last and by their counts, and how many are not common."""
    if not len(common):
        return tokens, len(tokens)
    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    is_common = common[at] == tokens
    last = tokens[is_common][np.argsort(rank[at[is_common]])]
    return np.concatenate([tokens[~is_common], last]), len(tokens) - len(last)


# -- search within a group -----------------------------------------------------------


def divide_skip(lists: list[tuple[list[int], int]], need: int) -> dict[int, int]:
    """T-occurrence search: the members found in lists of a total weight of at least `need`, with that weight.

    lists holds (sorted members, weight): lists with equal members are given once. The
    longest lists, of a total weight under `need`, are set aside; the short ones are
    merged by a heap, in which lists whose weight cannot suffice skip ahead; what the
    short ones leave open is settled by binary search in the long ones.
    """
    ordered = sorted(lists, key=lambda x: -len(x[0]))
    if not ordered:
        return {}
    spare = need / (0.5 * np.log2(len(ordered[0][0]) + 2) + 1)
    long, weight = 0, 0
    while long < len(ordered) and weight + ordered[long][1] <= min(spare, need - 1):
        weight += ordered[long][1]
        long += 1
    probed, short = ordered[:long], ordered[long:]
    least = need - weight
    heap = [(members[0], i) for i, (members, _) in enumerate(short)]
    heapq.heapify(heap)
    at = [0] * len(short)
    found: dict[int, int] = {}

    def forward(i: int, to: int) -> None:
        members = short[i][0]
        at[i] = bisect_left(members, to, at[i])
        if at[i] < len(members):
            heapq.heappush(heap, (members[at[i]], i))

    while heap:
        member, total, popped = heap[0][0], 0, []
        while heap and heap[0][0] == member:
            i = heapq.heappop(heap)[1]
            total += short[i][1]
            popped.append(i)
        if total >= least:
            for members, w in probed:
                k = bisect_left(members, member)
                if k < len(members) and members[k] == member:
                    total += w
            if total >= need:
                found[member] = total
            for i in popped:
                forward(i, member + 1)
        else:
            while heap and total + short[heap[0][1]][1] < least:
                i = heapq.heappop(heap)[1]
                total += short[i][1]
                popped.append(i)
            if not heap:
                break
            to = max(member + 1, heap[0][0])
            for i in popped:
                forward(i, to)
    return found


def search_group(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """All linked pairs (i < j) of a group of at most 64 sets, by DivideSkip over their inverted lists."""
    sizes = [len(s) for s in sets]
    tokens = np.concatenate(sets)
    bits = np.repeat(np.uint64(1) << np.arange(len(sets), dtype=np.uint64), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, bits = tokens[order], bits[order]
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    masks, weights = np.unique(np.bitwise_or.reduceat(bits, starts), return_counts=True)
    lists = [([k for k in range(len(sets)) if m >> k & 1], w) for m, w in zip(masks.tolist(), weights.tolist()) if m & (m - 1)]
    out = []
    for i, n in enumerate(sizes):
        own = [([k for k in members if k > i], w) for members, w in lists if i in members and members[-1] > i]
        least = required(n, -(-percent * n // 100), percent)
        for j, common in divide_skip(own, least).items():
            if common >= required(n, sizes[j], percent):
                out.append((i, j))
    return out


def search_large(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """As search_group() for any number of sets, by pairs of blocks."""
    if len(sets) <= 64:
        return search_group(sets, percent) if len(sets) > 1 else []
    found: set[tuple[int, int]] = set()
    cuts = [range(a, min(a + 32, len(sets))) for a in range(0, len(sets), 32)]
    for x in range(len(cuts)):
        for y in range(x + 1, len(cuts)):
            some = [*cuts[x], *cuts[y]]
            found.update((some[i], some[j]) for i, j in search_group([sets[k] for k in some], percent))
    return sorted(found)


def forest(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """As many of the pairs as tie their members together, and no more: fewer than n."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


# -- distributed steps ---------------------------------------------------------------


def _scan(rows: DataFrame, carry: list[str]) -> DataFrame:
    """A row for each text: id, n, set (128 bits), key (64 of them), counted (the set itself, in the counted share) and carried columns."""
    names = ["id", "n", "set", "key", "counted", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, SET_BYTES):
                ns, keys, sets = [], [], []
                for tokens in shingle_sets(texts[a:b]):
                    ns.append(len(tokens))
                    key = set_key(tokens) if len(tokens) else None
                    keys.append(key)
                    new = key is not None and key[0] % SAMPLE == 0 and key not in counted
                    sets.append(tokens.tobytes() if new else None)
                    if new:
                        counted.add(key)
                own = [c.slice(a, b - a) for c in batch.columns]
                columns = [own[0], pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array([k and short_key(k) for k in keys], pa.int64()), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *own[2:]], names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    told = [f"id {kinds['_id']}", "n long", "set binary", "key long", "counted binary", *[f"`{c}` {kinds[c]}" for c in carry]]
    return rows.mapInArrow(lean(run), ", ".join(told))


def _slice_of(token: str) -> Column:
    """One of 65,536 slices of a hash of a shingle."""
    return F.pmod(F.xxhash64(token), F.lit(1 << 16))


def _common_shingles(counted: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that two or more sets of the counted share hold, sorted, and their ranks by count.

    They are the COMMON most common ones, whatever their counts are: levels of counts are taken from the highest on, and of the last
    level, which would be too many, as many slices of a hash as fit. Counts are combined before their shuffle, and
    what the driver sees of them is two histograms of fixed size.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(0)[i].as_py(), "<i8"))], ["token"])

    once = counted.groupBy("set").agg(F.first("counted").alias("counted")).select("counted")
    counts = once.mapInArrow(lean(tokens), "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    counts = scratch.stage(counts, "counts")
    few = 4096
    level = F.when(F.col("n") < few, F.col("n")).otherwise(few + F.floor(F.log2(F.col("n") / few) * 256)).cast("int")
    histogram = sorted((r[0], r[1]) for r in counts.groupBy(level.alias("c")).count().collect())
    total, least, cut = 0, histogram[-1][0] + 1 if histogram else 0, 0
    for c, many in reversed(histogram):
        if total + many > COMMON:
            slices_of = counts.where(level == c).groupBy(_slice_of("token").alias("s")).count().collect()
            for s, held in sorted((r[0], r[1]) for r in slices_of):
                if total + held > COMMON:
                    break
                total, cut = total + held, s + 1
            break
        total, least = total + many, c
    below = max((c for c, _ in histogram if c < least), default=-1)
    kept = (level >= least) | ((level == below) & (_slice_of("token") < cut))
    found = counts.where(kept).select("token", "n").collect() if total else []
    told = np.array([r[0] for r in found], np.int64).astype(np.uint64)
    n = np.array([r[1] for r in found], np.int64)
    order = np.argsort(told)
    told, n = told[order], n[order]
    rank = np.empty(len(told), np.int32)
    rank[np.lexsort((told, n))] = np.arange(len(told))
    return told, rank


def _lists(rows: DataFrame, common: np.ndarray, rank: np.ndarray, buckets: int, percent: int) -> DataFrame:
    """The inverted lists of prefix shingles: token, key (64 bits of a set), place; without lists of one set.

    Entries of common shingles, which two or more sets are known to hold, go to buckets by set.
    All others go by shingle, and their lists are merged in one task each: those are short, as
    a shingle of many sets is held by two of the counted share.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((common, rank))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, parts, held = set(), ([], []), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part, by in zip(parts, ("token", "key")):
                if part:
                    found, packed = packed_by_bucket(np.concatenate(part), by, buckets)
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([by == "key"] * len(found), pa.bool_()), pa.array(packed, pa.binary())], ["bucket", "is_common", "packed"])
                    part.clear()

        for batch in batches:
            for tokens in shingle_sets(batch.column(0).to_pylist()):
                key = set_key(tokens)
                if not len(tokens) or key in done:  # copies in one task are entered once
                    continue
                done.add(key)
                n = len(tokens)
                length = n - -(-percent * n // 100) + 1
                ordered, first = in_order(tokens, *shared.value)
                part = np.empty(length, _ENTRY)
                part["token"], part["key"], part["place"] = ordered[:length], short_key(key), np.arange(length)
                parts[0].append(part[:first])
                parts[1].append(part[first:])
                held += length
                if held > 1 << 20:
                    yield from flush()
                    held = 0
        yield from flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: tuple[list[bytes], list[bytes]] = ([], [])
        for batch in batches:
            for is_common, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blobs[is_common].append(packed)
        for is_common in (0, 1):
            rows = np.frombuffer(b"".join(blobs[is_common]), _ENTRY)
            blobs[is_common].clear()
            rows = rows[np.lexsort((rows["key"], rows["token"]))]
            if len(rows):
                rows = rows[np.r_[True, (rows["token"][1:] != rows["token"][:-1]) | (rows["key"][1:] != rows["key"][:-1])]]
            if len(rows) and not is_common:
                starts = np.flatnonzero(np.r_[True, rows["token"][1:] != rows["token"][:-1]])
                length = np.diff(np.r_[starts, len(rows)])
                rows = rows[np.repeat(length > 1, length)]
            for k in range(0, len(rows), 1 << 18):
                some = rows[k : k + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(some["token"].astype(np.int64)), pa.array(some["key"]), pa.array(some["place"].astype(np.int64))], ["token", "key", "place"])

    packed = rows.select("_text").mapInArrow(lean(entries), "bucket int, is_common boolean, packed binary").repartition(buckets, "bucket")
    return packed.select("is_common", "packed").mapInArrow(lean(merged), "token long, key long, place long")


def _wanted(members: DataFrame, classes: DataFrame, most: int = 1024) -> DataFrame:
    """The groups of each set, with its representative's id: at most about `most` in one array, in more arrays where there are more."""
    many = members.groupBy("node").agg(F.count("*").alias("_k")).where(F.col("_k") > most)
    salted = members.join(many, "node", "left").withColumn("_s", F.when(F.col("_k").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("gid"), F.ceil(F.col("_k") / most))))
    packed = salted.groupBy("node", "_s").agg(F.collect_set("gid").alias("gids")).select("node", "gids")
    return packed.join(classes.select("node", "rep", "set"), "node")


def _search(rows: DataFrame, classes: DataFrame, members: DataFrame, parts: int, percent: int) -> DataFrame:
    """Links (a, b) that tie together what is linked within groups of sets: members has gid and node, rows the texts by _id.

    Each set is computed once and sent to its groups; a group's sets meet in one task. Of the
    rows with a representative's id, those with another set are left out.
    """
    wanted = _wanted(members, classes)
    if members.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, rows["_id"].eqNullSafe(wanted["rep"])).select("_text", "set", "node", "gids")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, tokens in enumerate(shingle_sets(batch.column(0).to_pylist())):
                if not len(tokens) or set_key(tokens) != batch.column(1)[i].as_py():
                    continue
                packed, node, gids = tokens.tobytes(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                step = max(1, SET_BYTES // len(packed))
                for k in range(0, len(gids), step):
                    some = gids[k : k + step]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([node] * len(some), pa.int64()), pa.array([packed] * len(some), pa.binary())], ["gid", "node", "packed"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, nodes, sets = None, [], []

        def links() -> pa.RecordBatch:
            pairs = forest(search_large(sets, percent), len(sets))
            return pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for k in range(batch.num_rows):
                g, node = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if g != gid:
                    if len(sets) > 1:
                        yield links()
                    gid, nodes, sets = g, [], []
                if not nodes or nodes[-1] != node:  # a text that repeats in the input comes once
                    nodes.append(node)
                    sets.append(np.frombuffer(batch.column(2)[k].as_py(), np.uint64))
        if len(sets) > 1:
            yield links()

    grouped = texts.mapInArrow(lean(spread), "gid string, node long, packed binary")
    grouped = grouped.repartition(parts, "gid").sortWithinPartitions("gid", "node")
    return grouped.mapInArrow(lean(found), "a long, b long")


def _candidates(tagged: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of one list, not yet in one component, whose sizes and places allow the required overlap: token, length, node1, node2.

    A pair's overlap is at most what comes from its first shared shingle on, so an entry
    has partners up to a size, `reach`. A pair is made from its smaller set's entry, whose
    reach must be its own size at least, and its larger set's. Lists are joined by size class as
    well: sizes of a pair are of one class or of adjacent ones.
    """
    mixed = tagged.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("length"))
    open_lists = tagged.join(mixed.where("lo <> hi").select("token", "length"), "token")
    # n + m may be at most (100 + percent) / percent of what is left from the place on
    open_lists = open_lists.withColumn("reach", F.expr(f"(n - place) * {100 + percent} div {percent} - n"))
    open_lists = open_lists.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent + 0.01))))
    own = ("node", "n", "c", "reach")
    smaller = open_lists.where("reach >= n").select("token", "length", F.explode(F.array("size", F.col("size") + 1)).alias("size"), *[F.col(x).alias(f"{x}1") for x in own])
    larger = open_lists.select("token", "size", *[F.col(x).alias(f"{x}2") for x in own])
    fit = f"c1 <> c2 AND (n1 < n2 OR n1 = n2 AND node1 < node2) AND n2 <= reach1 AND n1 <= reach2 AND 100 * n1 >= {percent} * n2"
    pairs = smaller.join(larger, ["token", "size"]).where(fit)
    return pairs.groupBy("node1", "node2").agg(F.min(F.struct("token", "length")).alias("x")).select("x.token", "x.length", "node1", "node2")


def ngram_jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Sets, links and components of all texts.

    Returns one row per input row: key, n_shingles, component_id (the smallest key
    reachable by links), rep (the smallest key of the rows with the same set), component (a
    number that the rows of one component share; null for an empty set) and the columns
    named in `carry`. A null or empty text, or one of white space alone, has an empty set and
    is linked with nothing, not even with another empty one. Fewer than five words make one
    shingle. Rows that repeat share their set; a key that repeats with different texts has
    a row for each, and links are those of each text. A null key gets its component's
    smallest key, and null if there is none. Other columns are not read.

    Exact but for collisions of 64-bit hashes of shingles: no cap on partners, lists or
    candidates. Copies are collapsed into one set before any search, by partial minima.
    What is broadcast is bounded: common shingles by COMMON, group tables by a count.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ngram-join")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    carried = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), *[F.col(c).alias(f"_own_{i}") for i, c in enumerate(carry)])

    sets = scratch.stage(_scan(carried, carried.columns[2:]), "sets")
    common, rank = _common_shingles(sets.where("counted IS NOT NULL").select("set", "counted"), scratch)
    sets = sets.drop("counted")
    classes = sets.where("set IS NOT NULL").groupBy("set").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("key").alias("key"))
    classes = scratch.stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    entries = classes.agg(F.sum(F.expr(f"n - ceil({percent} * n / 100) + 1"))).first()[0] or 0
    buckets = max(4 * parts, -(-int(entries) // BUCKET_ENTRIES))

    lists = scratch.stage(_lists(rows, common, rank, buckets, percent), "lists")
    lists = scratch.stage(lists.join(classes.select("key", "node", "n"), "key").select("token", "node", "n", "place"), "entries")
    scratch.drop("lists")
    sizes = scratch.stage(lists.groupBy("token").agg(F.count("*").alias("length")).where(f"length > {LONG}"), "long")

    # two rounds of random subgroups of long lists: each set goes to its longest list
    links = None
    for turn in range(2):
        longest = lists.join(sizes, "token").groupBy("node").agg(F.max(F.struct("length", "token")).alias("x"))
        sub = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("x.length") / (LONG // 2)))
        members = longest.select(F.concat_ws(":", "x.token", sub.cast("string")).alias("gid"), "node")
        members = scratch.stage(members, f"members-{turn}")
        some = scratch.stage(_search(rows, classes, members, parts, percent), f"links-{turn}")
        links = some if links is None else links.unionByName(some)
    joined = scratch.stage(connected_components(links, scratch, "first"), "joined").withColumnRenamed("component", "c")

    # what is not yet in one component and can reach the required overlap
    tagged = lists.join(joined, "node", "left").select("token", "node", "n", "place", F.coalesce("c", "node").alias("c"))
    tagged = scratch.stage(tagged, "tagged")
    scratch.drop("entries")
    pairs = _candidates(tagged, percent)
    blocks = F.ceil(F.col("length") / (LONG // 2))
    cut = lambda node: F.when(F.col("length") <= LONG, F.lit(0)).otherwise(F.pmod(F.xxhash64(node), blocks)).cast("string")
    pairs = scratch.stage(pairs.select(F.concat_ws(":", "token", cut("node1"), cut("node2")).alias("gid"), "node1", "node2"), "pairs")
    scratch.drop("tagged")
    members = pairs.selectExpr("gid", "node1 AS node").unionByName(pairs.selectExpr("gid", "node2 AS node")).distinct()
    members = scratch.stage(members, "members")
    links = links.unionByName(scratch.stage(_search(rows, classes, members, parts, percent), "links"))

    components = connected_components(links, scratch, "last")
    placed = classes.join(components, "node", "left").select("set", "rep", F.coalesce("component", "node").alias("component"))
    placed = scratch.stage(placed, "grouped")
    least = placed.groupBy("component").agg(F.min("rep").alias("least"))
    placed = scratch.stage(placed.join(least, "component"), "placed")
    scratch.keep_only("sets", "placed")
    found = sets.drop("key").join(placed, "set", "left")
    return found.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("least", "id").alias("component_id"),
        F.coalesce("rep", "id").alias("rep"),
        "component",
        *[F.col(f"_own_{i}").alias(c) for i, c in enumerate(carry)],
    )
