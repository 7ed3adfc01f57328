"""Byte-level BPE encoding and decoding.

Merging a word keeps a segment tree over its adjacent pairs. A leaf holds
rank * leaves + position, or nothing when the pair has no merge; an inner node holds
the smaller of its two. So the root is the leftmost pair of the lowest rank, and a
merge updates three leaves and the paths above them, in logarithmic time, until the
root holds nothing. Words up to 64 pairs are merged many at a time, with one tree per
row of a numpy array; a longer word has a tree of its own.
"""

from __future__ import annotations

import json
import re
import string
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import lean, slices, small_batches, text_of

NOTHING = np.int64(1 << 62)
#: Words and chunks up to this length are remembered, so that memos are bounded in bytes as well.
LONGEST_KEPT = 64
#: Letters and numbers that Unicode 16.0 added to 15.1, as ranges (fixed values): the
#: vocabulary's library splits by 16.0, and Python's tables may be older.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)
_ODD_SPACE = re.compile(r"\s (?:\s|\Z)")


def _char_class(kind: str, more: tuple[tuple[int, int], ...]) -> str:
    """The code points of a general category, as the inside of a character class."""
    member = [unicodedata.category(chr(c))[0] == kind for c in range(0x110000)]
    for first, last in more:
        member[first : last + 1] = [True] * (last - first + 1)
    edges = np.flatnonzero(np.diff(np.array([False, *member, False], np.int8)))
    return "".join(f"\\U{a:08X}-\\U{b - 1:08X}" for a, b in zip(edges[::2], edges[1::2]))


@lru_cache(1)
def word_pattern() -> regex.Pattern:
    """Splits a text before its merges: contractions, letters, numbers, the rest, white space."""
    letters, numbers = _char_class("L", LETTERS_16), _char_class("N", NUMBERS_16)
    return regex.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+"
    )


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def cuts_of(text: str) -> list[str] | None:
    """A text cut before each space; None where a run of white space reaches over such a cut.

    A word never reaches over a space that follows a non-space or precedes one, so each
    chunk can be split by itself and remembered.
    """
    if _ODD_SPACE.search(text):
        return None
    first, *rest = text.split(" ")
    return [first, *[" " + c for c in rest]]


def words_of_chunk(chunk: str) -> list[bytes]:
    """The words of a chunk as the pattern has them; the common forms are told apart without it.

    These are letters, marks, letters and then marks, and such parts with single line
    feeds between them. An apostrophe after letters matters only before letters.
    """
    body = chunk[1:] if chunk[:1] == " " else chunk
    if body.isalpha():
        return [chunk.encode()]
    letters = body.rstrip(string.punctuation)
    if not letters and body:
        return [chunk.encode()]
    if letters.isalpha():
        cut = len(chunk) - len(body) + len(letters)
        return [chunk[:cut].encode(), chunk[cut:].encode()]
    parts = body.split("\n")
    if len(parts) > 1 and all(p and not p[0].isspace() and not p[-1].isspace() for p in parts):
        out = words_of_chunk(chunk[: len(chunk) - len(body) + len(parts[0])])
        for part in parts[1:]:
            out.append(b"\n")
            out += words_of_chunk(part)
        return out
    return [w.encode() for w in word_pattern().findall(chunk)]


@dataclass
class Vocabulary:
    """Merges and tokens of a byte-level BPE file; its size is fixed by the file, so it may be broadcast."""

    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    made_by_rank: np.ndarray
    token_bytes: list[bytes]
    special: dict[str, int]
    words: dict[bytes, bytes] = field(default_factory=dict)
    chunks: dict[str, bytes] = field(default_factory=dict)
    most: int = 200_000

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        ids, symbols = told["model"]["vocab"], byte_symbols()
        special = {t["content"]: t["id"] for t in told.get("added_tokens", ())}
        token_bytes = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in ids.items():
            token_bytes[i] = token.encode() if token in special else bytes(symbols[c] for c in token)
        for token, i in special.items():
            token_bytes[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        byte_ids = np.zeros(256, np.int64)
        for c, b in symbols.items():
            byte_ids[b] = ids[c]
        return cls(byte_ids, keys[order], order.astype(np.int64), made, token_bytes, special)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or -1."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": {}, "chunks": {}}

    # -- merging ---------------------------------------------------------------

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_leaves: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            pairs = len(word) - 1
            by_leaves.setdefault(1 << max(1, (pairs - 1).bit_length()) if 0 < pairs <= 64 else 0, []).append(i)
        for i in by_leaves.pop(0, ()):
            out[i] = self.merge_long(words[i])
        for leaves, rows in by_leaves.items():
            for start in range(0, len(rows), 1 << 15):
                part = rows[start : start + (1 << 15)]
                for i, ids in zip(part, self._merge_rows([words[i] for i in part], leaves)):
                    out[i] = ids
        return out

    def _merge_rows(self, words: list[bytes], leaves: int) -> list[bytes]:
        """Merges words of 2 to leaves + 1 bytes, one segment tree per row."""
        count, bits = len(words), leaves.bit_length() - 1
        size = np.fromiter(map(len, words), np.int64, count)
        place = np.arange(leaves + 1)
        used = place < size[:, None]
        symbol = np.full((count, leaves + 1), -1, np.int64)
        symbol[used] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.where(place + 1 < size[:, None], place + 1, -1)
        before = np.where(used, place - 1, -1)
        tree = np.full((count, 2 * leaves), NOTHING, np.int64)
        rank = self.ranks(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(count, leaves)
        tree[:, leaves:] = np.where(rank >= 0, (rank << bits) | place[:-1], NOTHING)
        for node in range(leaves - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + leaves
            tree[rows, node] = value
            for _ in range(bits):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def pair_value(left: np.ndarray, right: np.ndarray, leaf: np.ndarray) -> np.ndarray:
            rank = self.ranks(left, right)
            return np.where(rank >= 0, (rank << bits) | leaf, NOTHING)

        rows = np.arange(count)
        while len(rows):
            root = tree[rows, 1]
            going = root < NOTHING
            rows, root = rows[going], root[going]
            if not len(rows):
                break
            here = root & (leaves - 1)
            symbol[rows, here] = self.made_by_rank[root >> bits]
            gone = after[rows, here]
            used[rows, gone] = False
            beyond = after[rows, gone]
            after[rows, here] = beyond
            some = beyond >= 0
            before[rows[some], beyond[some]] = here[some]
            inner = gone < leaves
            put(rows[inner], gone[inner], NOTHING)
            right = np.where(some, symbol[rows, beyond], -1)
            put(rows, here, pair_value(symbol[rows, here], right, here))
            left = before[rows, here]
            some = left >= 0
            some_rows, left = rows[some], left[some]
            put(some_rows, left, pair_value(symbol[some_rows, left], symbol[some_rows, here[some]], left))
        packed = symbol[used].astype("<u4").tobytes()
        ends = (4 * np.cumsum(used.sum(axis=1))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def merge_long(self, word: bytes) -> bytes:
        """Merges one word of any length with a segment tree of its own."""
        if len(word) < 2:
            return self.byte_ids[list(word)].astype("<u4").tobytes()
        start = self.byte_ids[np.frombuffer(word, np.uint8)]
        count = len(start)
        leaves = 1 << (count - 2).bit_length()
        bits = leaves.bit_length() - 1
        none = int(NOTHING)
        rank = self.ranks(start[:-1], start[1:])
        level = np.full(leaves, NOTHING, np.int64)
        level[: count - 1] = np.where(rank >= 0, (rank << bits) | np.arange(count - 1), NOTHING)
        levels = [level]
        while len(level) > 1:
            level = np.minimum(level[::2], level[1::2])
            levels.append(level)
        tree = [none, *np.concatenate(levels[::-1]).tolist()]
        symbol, made = start.tolist(), self.made_by_rank
        after, before = [*range(1, count), -1], list(range(-1, count - 1))
        alive = bytearray(b"\x01") * count
        known: dict[int, int] = {}

        def value(left: int, right: int, leaf: int) -> int:
            key = (left << 32) | right
            rank = known.get(key)
            if rank is None:
                at = int(np.searchsorted(self.pair_keys, key))
                hit = at < len(self.pair_keys) and int(self.pair_keys[at]) == key
                rank = known[key] = int(self.pair_ranks[at]) if hit else -1
            return (rank << bits) | leaf if rank >= 0 else none

        def put(leaf: int, what: int) -> None:
            node = leaf + leaves
            tree[node] = what
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b
                node >>= 1

        while tree[1] < none:
            here = tree[1] & (leaves - 1)
            symbol[here] = int(made[tree[1] >> bits])
            gone = after[here]
            alive[gone] = 0
            beyond = after[here] = after[gone]
            if gone < leaves:
                put(gone, none)
            if beyond >= 0:
                before[beyond] = here
                put(here, value(symbol[here], symbol[beyond], here))
            else:
                put(here, none)
            if before[here] >= 0:
                put(before[here], value(symbol[before[here]], symbol[here], before[here]))
        return np.array([s for s, a in zip(symbol, alive) if a], "<u4").tobytes()

    # -- texts -----------------------------------------------------------------

    def _encode_pieces(self, pieces: list[list[bytes]]) -> list[bytes]:
        """The packed ids of lists of words, through the bounded memo of words."""
        new = list({w for words in pieces for w in words}.difference(self.words))
        if len(self.words) + len(new) > self.most:
            self.words.clear()
            new = list({w for words in pieces for w in words})
        made = dict(zip(new, self.merge_words(new)))
        self.words.update((w, ids) for w, ids in made.items() if len(w) <= LONGEST_KEPT)
        known = self.words

        def get(word: bytes) -> bytes:
            ids = known.get(word)
            return made[word] if ids is None else ids

        return [get(words[0]) if len(words) == 1 else b"".join(map(get, words)) for words in pieces]

    def _learn(self, cuts: set[str]) -> Callable[[str], bytes]:
        """Encodes chunks that the memo does not hold, all together, and returns what gives each one's ids.

        The memo is bounded: it takes `most` chunks, none over LONGEST_KEPT characters.
        """
        new = list(cuts.difference(self.chunks))
        if len(self.chunks) + len(new) > self.most:
            self.chunks.clear()
            new = list(cuts)
        made = dict(zip(new, self._encode_pieces([words_of_chunk(c) for c in new])))
        long = {c: ids for c, ids in made.items() if len(c) > LONGEST_KEPT}
        self.chunks.update((c, ids) for c, ids in made.items() if len(c) <= LONGEST_KEPT)
        if not long:
            return self.chunks.__getitem__
        return lambda c: long[c] if len(c) > LONGEST_KEPT else self.chunks[c]

    def _encode_plain(self, text: str) -> bytes:
        """A text without special tokens."""
        cuts = cuts_of(text)
        if cuts is None:
            return self._encode_pieces([[w.encode() for w in word_pattern().findall(text)]])[0]
        return b"".join(map(self._learn(set(cuts)), cuts))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode() of several texts; their new words are merged together, which is much faster."""
        cuts = [None if any(s in text for s in self.special) else cuts_of(text) for text in texts]
        get = self._learn({c for cut in cuts if cut is not None for c in cut})
        out = [b"" if cut is None else b"".join(map(get, cut)) for cut in cuts]
        for i, cut in enumerate(cuts):  # these may empty the memo
            if cut is None:
                out[i] = self.encode(texts[i])
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed as little-endian unsigned 32-bit integers; special tokens in it have their ids."""
        if not any(s in text for s in self.special):
            return self._encode_plain(text)
        out = []
        for part in re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text):
            out.append(self.special[part].to_bytes(4, "little") if part in self.special else self._encode_plain(part))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def bpe_round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns key, ids (binary: little-endian unsigned 32-bit integers) and decoded. A
    null or empty text has no ids and decodes to an empty text. Rows are independent:
    ties, repeated rows and null keys pass through, an empty table gives an empty
    result, and other columns of the input are not read. The vocabulary, of the size
    of its file, is broadcast; memos of words and chunks are bounded in each worker, in
    number and in length. A very long word is merged by a tree of its own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))
    rows = docs.select(docs[key], text_of(docs, text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = vocabulary.encode_all(texts[a:b])
                back = [vocabulary.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(back, pa.string())],
                    names=[key, "ids", "decoded"],
                )
        vocabulary.words.clear()
        vocabulary.chunks.clear()

    schema = T.StructType([docs.schema[key], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(lean(run), schema)
