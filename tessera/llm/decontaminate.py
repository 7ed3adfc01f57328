"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

The index is over whole items, and every passage of every training text is a query. What the
search retrieves is verified in windows of the item's own length times WINDOW, which begin at
any word: some window must hold the item's question, by five-word shingles, and its answer.
So whether a text holds an item depends on these two alone, whatever other items there are.
An item is retrieved by the least share of its own BM25 weight that a window which passes can
have, so the search loses none. A passage is STEPS + 1 adjacent blocks of words, as long as it takes
for each window to lie whole in one; items of over SHORT words have indexes of their own, by
length, so that they do not stretch the others' passages.
"""

from __future__ import annotations

import math
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, WordMemo, lean, slices, small_batches, text_of, word_groups

SHINGLE = 5
#: A window's words for each word of an item, and the blocks of words that make one window of an index's longest item.
WINDOW, STEPS = 1.5, 1
POSTINGS_BLOCK = 8
SHORT = 256
#: Sums that are held at a time, and the items up to which they are held for every item of a block.
CELLS, DENSE_ENTRIES = 1 << 21, 1024
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_ANSWER = re.compile(r"(?:^|\n)\s*(?:answer|a)\s*[:.]\s+", re.IGNORECASE)
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def plain(word: str) -> str:
    """A lower-case word without the marks at its ends; the common forms are told without the pattern."""
    word = word.lower()
    if word.isalnum() or (word := word.rstrip(string.punctuation)).isalnum():
        return word
    return _EDGE.sub("", word)


def words_of(text: str) -> list[str]:
    return [w for w in map(plain, text.split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's two parts: at an answer's heading, else its last sentence is the answer."""
    marked = list(_ANSWER.finditer(text))
    if marked:
        return words_of(text[: marked[-1].start()]), words_of(text[marked[-1].end() :])
    sentences = [s for s in _SENTENCE.split(text.strip()) if words_of(s)]
    if len(sentences) < 2:
        return words_of(text), []
    return words_of(" ".join(sentences[:-1])), words_of(sentences[-1])


def runs(words: list, n: int) -> Iterator[tuple]:
    """All runs of n words, in order."""
    return zip(*(words[i:] for i in range(n)))


class Part:
    """A question or an answer: its distinct shingles; one of fewer words than a shingle is one run."""

    def __init__(self, terms: list[int], overlap: float) -> None:
        self.n = min(SHINGLE, len(terms))
        self.number = {run: i for i, run in enumerate(dict.fromkeys(runs(terms, self.n)))} if terms else {}
        #: how many of them a window must hold
        self.least = min(len(self.number), max(1, math.ceil(overlap * len(self.number) - 1e-9)))

    def places(self, passage: list[int]) -> list[int]:
        """The number of the shingle that begins at each word of a passage, -1 where none does."""
        found = [self.number.get(run, -1) for run in runs(passage, self.n)] if self.number else []
        return found + [-1] * (len(passage) - len(found))

    def covered(self, places: list[int], width: int) -> np.ndarray:
        """The share of the part that the window from each word on holds; a part without words is held whole."""
        if not self.number:
            return np.ones(len(places))
        return in_windows(np.array(places), self.n, width) / len(self.number)


def in_windows(ids: np.ndarray, n: int, width: int) -> np.ndarray:
    """For the window of `width` words from each place on, how many distinct ids begin in it and reach, n words long, no further than it.

    Place p counts for the windows that begin after the place before it with the same id, and reach to its end.
    """
    at = np.flatnonzero(ids >= 0)
    at = at[np.argsort(ids[at], kind="stable")]
    before = np.full(len(at), -1)
    again = ids[at][1:] == ids[at][:-1]
    before[1:][again] = at[:-1][again]
    first = np.maximum(np.maximum(before + 1, at + n - width), 0)
    at, first = at[first <= at], first[first <= at]
    size = len(ids) + 1
    return np.cumsum(np.bincount(first, minlength=size) - np.bincount(at + 1, minlength=size))[:-1]


@dataclass
class Posting:
    """A term's entries in order, the shares they get from it, and the largest share in each block."""

    entries: list[int]
    shares: list[float]
    last: list[int]
    block_max: list[float]
    most: float


def least_share(parts: list[Part], share: dict[int, float]) -> float:
    """A bound from below on the share of its weight that an item has in a window that holds enough of its parts.

    A word's share is dealt out evenly to the shingles that it is in. Any shingles together then have no more
    than their words' shares, and enough of them have no less than as many of the smallest.
    """
    often = Counter(t for part in parts for run in part.number for t in set(run))
    return sum(sum(sorted(math.fsum(share[t] / often[t] for t in set(run)) for run in part.number)[: part.least]) for part in parts)


def length_class(n: int) -> int:
    """0 up to SHORT words, then one more each time the number doubles."""
    return max(0, (n - 1).bit_length() - (SHORT - 1).bit_length())


@dataclass
class ItemCounts:
    """What BM25 needs to know of all items: how many have a word, their words, items by word."""

    n: int
    words: int
    df: dict[str, int]

    @staticmethod
    def of(texts: list[str]) -> ItemCounts:
        bags = [Counter(words) for words in map(words_of, texts) if words]
        return ItemCounts(len(bags), sum(sum(bag.values()) for bag in bags), Counter(w for bag in bags for w in bag))


class ItemIndex:
    """BM25 index of test items, each whole; counts are of all items, by default of these.

    Shares in the lists are of what an item needs to be retrieved (self.least), so 1 is the threshold of every item.
    """

    def __init__(self, items: list[tuple[object, str]], overlap: float = 0.5, k1: float = 1.2, b: float = 0.75, counts: ItemCounts | None = None) -> None:
        counts = counts or ItemCounts.of([text or "" for _, text in items])
        self.overlap = overlap
        told = [(item, text, Counter(words_of(text))) for item, text in items if text and any(question_and_answer(text))]
        self.items = [item for item, _, _ in told]
        bags = [bag for _, _, bag in told]
        n, mean = counts.n, counts.words / max(1, counts.n)
        df = {w: counts.df[w] for bag in bags for w in bag}
        idf = {w: math.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
        self.term = {w: i for i, w in enumerate(sorted(df))}
        self.width = [math.ceil(WINDOW * max(SHINGLE, bag.total())) for bag in bags]
        self.block = -(-max(self.width, default=SHINGLE) // STEPS)
        self.parts = [[Part([self.term[w] for w in part], overlap) for part in question_and_answer(text)] for _, text, _ in told]
        self.share: list[dict[int, float]] = []
        self.least: list[float] = []
        lists: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for e, bag in enumerate(bags):
            length = k1 * (1 - b + b * bag.total() / mean)
            weight = {self.term[w]: idf[w] * tf * (k1 + 1) / (tf + length) for w, tf in bag.items()}
            whole = sum(weight.values())
            share = {t: x / whole for t, x in weight.items()}
            self.share.append(share)
            self.least.append(least_share(self.parts[e], share))
            for t, x in share.items():
                lists[t].append((e, x / self.least[e]))
        self.postings = []
        for found in lists:
            entries, shares = [e for e, _ in found], [x for _, x in found]
            cuts = range(0, len(found), POSTINGS_BLOCK)
            self.postings.append(Posting(entries, shares, [entries[min(c + POSTINGS_BLOCK, len(found)) - 1] for c in cuts], [max(shares[c : c + POSTINGS_BLOCK]) for c in cuts], max(shares)))
        self._set_common_apart(df, len(bags))

    def _set_common_apart(self, df: dict[str, int], n: int, spare: float = 0.12) -> None:
        """Splits the terms as in WAND's bound: common ones give no entry more than `spare` of its weight.

        So a passage can reach a threshold only for an entry to which its rare terms give
        at least the threshold less what common terms can give that entry (self.given).
        """
        self.given = np.zeros(n)
        common = set()
        for word in sorted(self.term, key=lambda w: (-df[w], w)):
            posting = self.postings[self.term[word]]
            more = self.given.copy()
            more[posting.entries] += posting.shares
            if df[word] < 2 or more.max() > spare:
                break
            self.given = more
            common.add(self.term[word])
        lists = [([], []) if t in common else (p.entries, p.shares) for t, p in enumerate(self.postings)]
        self.length = np.array([len(e) for e, _ in lists] + [0])
        self.start = np.cumsum(self.length) - self.length
        self.rare_entries = np.array([e for entries, _ in lists for e in entries], np.int64)
        self.rare_shares = np.array([x for _, shares in lists for x in shares])

    def open_passages(self, at: np.ndarray, term: np.ndarray, count: int) -> np.ndarray:
        """The passages, in order, in which some entry can reach its threshold.

        at and term are the distinct (passage, term) pairs in order, of `count` passages. The sums are of
        rare terms, and of what common ones can give at most. Sums are held for some passages
        at a time: for each entry where these are few, else only for the (passage, entry) pairs
        that rare terms give anything, so the work is in proportion to the rare terms' lists
        however many items there are.
        """
        n = len(self.given)
        need = 1 - self.given - 1e-9
        length = self.length[term]
        total = np.concatenate([[0], np.cumsum(length)])[np.searchsorted(at, np.arange(count + 1))]
        found = [np.zeros(0, np.int64)]
        a = 0
        while a < count:
            # as many passages as have CELLS postings together, or one
            b = max(int(np.searchsorted(total, total[a] + CELLS, "right")) - 1, a + 1)
            b = min(b, a + max(1, CELLS // n) if n <= DENSE_ENTRIES else count, count)
            lo, hi = np.searchsorted(at, [a, b])
            some = length[lo:hi]
            where = np.repeat(self.start[term[lo:hi]] - np.cumsum(some) + some, some) + np.arange(some.sum())
            cell, share = np.repeat(at[lo:hi] - a, some) * n + self.rare_entries[where], self.rare_shares[where]
            if n <= DENSE_ENTRIES:
                is_open = (np.bincount(cell, share, (b - a) * n).reshape(-1, n) >= need).any(1)
                found.append(a + np.flatnonzero(is_open))
            elif len(cell):
                order = np.argsort(cell, kind="stable")
                cell, share = cell[order], share[order]
                first = np.flatnonzero(np.diff(cell, prepend=-1))
                cell = cell[first]
                found.append(a + np.unique(cell[np.add.reduceat(share, first) >= need[cell % n]] // n))
            a = b
        return np.concatenate(found)

    def terms_of(self, words: list[str]) -> np.ndarray:
        """The term number of each raw word, the number of terms where it has none, -1 where the word is marks alone."""
        none = len(self.term)
        return np.fromiter((self.term.get(p, none) if (p := plain(w)) else -1 for w in words), np.int64, len(words))[:, None]

    def search(self, terms: list[int], threshold: float = 1.0) -> list[tuple[int, float]]:
        """Block-max WAND: (entry, score) of every entry whose score, of what it needs, is at least the threshold."""
        cursors = [[self.postings[t].entries[0], 0, self.postings[t]] for t in terms]
        found = []
        slack = threshold - 1e-9

        def advance(cursor: list, to: int) -> None:
            """Moves to the first entry not before `to`."""
            entries = cursor[2].entries
            at = cursor[1] = bisect_left(entries, to, cursor[1])
            cursor[0] = entries[at] if at < len(entries) else -1

        while cursors:
            cursors.sort(key=itemgetter(0))
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[2].most
                if bound >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            entry = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == entry:
                pivot += 1
            limit, bound = math.inf, 0.0
            for c in cursors[: pivot + 1]:
                posting = c[2]
                block = bisect_left(posting.last, entry, c[1] // POSTINGS_BLOCK)
                if block < len(posting.last):
                    bound += posting.block_max[block]
                    limit = min(limit, posting.last[block] + 1)
            if bound < slack:  # no entry before the first block's end can reach the threshold
                if pivot + 1 < len(cursors):
                    limit = min(limit, cursors[pivot + 1][0])
                limit = max(entry + 1, limit) if limit < math.inf else entry + 1
                for c in cursors[: pivot + 1]:
                    advance(c, limit)
            elif cursors[0][0] == entry:
                score = math.fsum(c[2].shares[c[1]] for c in cursors[: pivot + 1])
                for c in cursors[: pivot + 1]:
                    advance(c, entry + 1)
                if score >= slack:
                    found.append((entry, score))
            else:
                for c in cursors[:pivot]:
                    if c[0] < entry:
                        advance(c, entry)
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def best_window(self, entry: int, passage: np.ndarray) -> tuple[int, float, float, float] | None:
        """Of the windows of an item that begin in the passage's first block and hold enough of it, the first that holds the most.

        Returns its first word, score, question and answer. A window begins at a word of the item: no other holds more.
        """
        share, width = self.share[entry], self.width[entry]
        words = passage[: self.block + width].tolist()
        places = [part.places(words) for part in self.parts[entry]]
        if any(len({*at, -1}) - 1 < part.least for part, at in zip(self.parts[entry], places)):
            return None
        question, answer = (part.covered(at, width) for part, at in zip(self.parts[entry], places))
        passes = np.array([t in share for t in words]) & (question >= self.overlap) & (answer >= self.overlap)
        passes[self.block :] = False
        if not passes.any():
            return None
        at = int(np.argmax(np.where(passes, question + answer, -1.0)))
        score = math.fsum(share[t] for t in share.keys() & set(words[at : at + width]))
        return at, min(1.0, score), float(question[at]), float(answer[at])

    def leaks(self, memo: WordMemo, texts: list[str]) -> list[tuple[int, object, int, float, float, float]]:
        """(text number, item, first word of the window, score, question, answer) of each verified item, once per text and item.

        Only the passages that open_passages() leaves are searched. A text is held as numbers of terms and cut into words in pieces.
        """
        none = len(self.term)
        if not none:
            return []
        told, sizes = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for group in word_groups(texts):
            words = [piece.lower().split() for _, piece in group]
            found = memo([w for ws in words for w in ws])[:, 0]
            held = found >= 0  # marks alone are no words: a table's bars do not stretch a passage
            told.append(found[held].astype(np.int32))
            sizes += np.bincount(np.repeat(np.array([i for i, _ in group]), list(map(len, words)))[held], minlength=len(texts))
        terms = np.concatenate(told)
        blocks = -(-sizes // self.block)
        first = np.cumsum(blocks) - blocks
        offset = np.cumsum(sizes) - sizes
        hit = np.flatnonzero(terms < none)
        place = hit - np.repeat(offset, sizes)[hit]
        block = np.repeat(first, sizes)[hit] + place // self.block
        pairs = np.unique(block * (none + 1) + terms[hit])
        owner = np.repeat(np.arange(len(texts)), blocks)
        # a passage is named by its first block, so the terms of a block are in the passages of those before it too
        block, before = pairs // (none + 1), [pairs]
        for step in range(1, STEPS + 1):
            before.append(pairs[block - step >= first[owner[block]]] - step * (none + 1))
        pairs = np.sort(np.concatenate(before), kind="stable")
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        at, term = pairs // (none + 1), pairs % (none + 1)
        best: dict[tuple[int, object], tuple] = {}
        starts = np.searchsorted(at, np.arange(len(owner) + 1))
        for b in self.open_passages(at, term, len(owner)).tolist():
            i = int(owner[b])
            found = self.search(term[starts[b] : starts[b + 1]].tolist())
            begin = (b - int(first[i])) * self.block
            passage = terms[offset[i] + begin : offset[i] + min(begin + (STEPS + 1) * self.block, int(sizes[i]))]
            for entry, _ in found:
                key = i, self.items[entry]
                window = self.best_window(entry, passage)
                if window and (key not in best or sum(best[key][4:]) < sum(window[2:])):
                    best[key] = (*key, begin + window[0], *window[1:])
        return list(best.values())


def item_indexes(items: list[tuple[object, str]], overlap: float = 0.5, counts: ItemCounts | None = None) -> list[ItemIndex]:
    """An index for each class of length among the items."""
    counts = counts or ItemCounts.of([text for _, text in items])
    classes: dict[int, list[tuple[object, str]]] = {}
    for item, text in items:
        classes.setdefault(length_class(len(words_of(text))), []).append((item, text))
    return [ItemIndex(classes[c], overlap, counts=counts) for c in sorted(classes)]


def shard_counts(told: DataFrame) -> Callable[[DataFrame], ItemCounts]:
    """Counts over all items, for one shard at a time: the driver gets the words of that shard only."""
    scratch = Scratch(told.sparkSession, "items")

    def told_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(len, words)), pa.int64()), pa.array([sorted(set(ws)) for ws in words], pa.list_(pa.string()))], names=["n", "words"])

    words = lambda items: items.select("_text").mapInArrow(lean(told_words), "n long, words array<string>")
    each = scratch.stage(words(told), "words").where("n > 0")
    df = scratch.stage(each.select(F.explode("words").alias("word")).groupBy("word").count(), "df")
    many, total = each.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def counts(own: DataFrame) -> ItemCounts:
        held = df.join(words(own).select(F.explode("words").alias("word")).distinct(), "word", "left_semi").collect()
        return ItemCounts(many, total, {r["word"]: r["count"] for r in held})

    return counts


def leak_searches(
    items: DataFrame, item: str = "item_id", item_text: str = "text", overlap: float = 0.5, shard_items: int = 50_000, shard_chars: int = 1 << 26
) -> Iterator[Callable[[Column], Column]]:
    """For each shard of the items in turn, a function that gives the verified items a text contains, as an array; see find_leaks()."""
    spark = items.sparkSession
    small_batches(spark)
    told = items.where(F.col(item_text).isNotNull()).select(F.col(item).alias("_item"), F.col(item_text).alias("_text"))
    many, chars = told.agg(F.count("*"), F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()
    shards = max(1, -(-many // shard_items), -(-chars // shard_chars))
    kind = T.StructType(
        [T.StructField(item, items.schema[item].dataType), T.StructField("passage", T.LongType())]
        + [T.StructField(name, T.DoubleType()) for name in ("score", "question", "answer")]
    )

    def searched(indexes: list[ItemIndex]) -> Callable[[Column], Column]:
        shared = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            from pyspark.sql.pandas.types import to_arrow_schema

            own = [(index, WordMemo(index.terms_of)) for index in shared.value]
            item_type = to_arrow_schema(kind).field(0).type
            for batch in batches:
                texts = batch.to_pylist()
                found: list[tuple] = []
                for a, b in slices(texts):
                    rows = [(a + i, *rest) for index, memo in own for i, *rest in index.leaks(memo, texts[a:b])]
                    found += sorted(rows, key=lambda r: r[0])
                at, ids, passage, score, q, an = zip(*found) if found else ([],) * 6
                rows = pa.StructArray.from_arrays(
                    [pa.array(ids, item_type), pa.array(passage, pa.int64()), *(pa.array(x, pa.float64()) for x in (score, q, an))], kind.fieldNames()
                )
                ends = np.cumsum(np.bincount(np.asarray(at, np.int64), minlength=len(texts)))
                yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), rows)

        run = lean(run)

        @F.arrow_udf(T.ArrayType(kind))
        def leaks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from run(batches)

        return leaks

    counts_of = shard_counts(told) if shards > 1 else lambda own: None
    for shard in range(shards):
        own = told if shards == 1 else told.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(shards)) == shard)
        rows_of = sorted(((r[0], r[1]) for r in own.collect()), key=lambda r: (str(r[0]), r[1]))
        yield searched(item_indexes(rows_of, overlap, counts_of(own)))


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", overlap: float = 0.5, shard_items: int = 50_000
) -> DataFrame:
    """Test items that training texts contain: one row per text and item.

    Returns key, item, passage (number of its first word), score (share of the item's
    BM25 weight), question and answer (shares of their shingles in the passage). A passage
    is half as long again as the item. Items both of whose shares reach `overlap` in some passage are
    returned, all of them; an item of one sentence has no answer part, and its answer share is 1, and
    one that has nothing but a heading is in no text. Of several passages that hold an item, the first
    of those that hold most of both shares is told. Other items have a part in the score alone, by BM25's counts.

    The items are collected and broadcast in shards of about `shard_items` rows or 64 Mi
    characters, so a benchmark of any size is searched with bounded memory, one scan per shard. Word
    counts are those of all items in any number of shards, so scores do not depend on it. An item
    of any length is indexed and verified whole. Null and
    empty texts and items match nothing; a text or a passage that repeats is found each
    time; rows that repeat give repeated rows; an empty table gives an empty result; other
    columns are not read.
    """
    out = None
    for search in leak_searches(items, item, item_text, overlap, shard_items):
        part = docs.select(F.col(key).alias("_key"), F.explode(search(text_of(docs, text))).alias("_leak"))
        part = part.select(F.col("_key").alias(key), "_leak.*")
        out = part if out is None else out.unionByName(part)
    return out
