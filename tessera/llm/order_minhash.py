"""Document fingerprints by Order MinHash: minimal occurrence-numbered k-mers, in text order, hashed as tuples.

DataFrame operations only. Every text becomes an array of whole numbers, one for each k-mer, that
holds the k-mer's hash and its place; sorting it numbers the occurrences and finds the minima.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import fixed
from tessera.llm.common import SPACE_CLASS, text_of, unused

#: A word of more bytes than this is cut: ideographs, kana and Hangul syllables alone, and runs of as many other characters at most.
LONG = 16
PARTS = rf"[⺀-鿿가-힯]|[^⺀-鿿가-힯]{{1,{LONG}}}"
#: Bits of a packed number that hold a place in the text; the others hold the hash.
PLACE_BITS = 31
PLACE = (1 << PLACE_BITS) - 1
#: Characters of text that a block of documents, sorted by one task, is to hold; the number of blocks is at most BLOCKS.
BLOCK_CHARS, BLOCKS = 1 << 22, 1 << 14


@dataclass(frozen=True)
class Scheme:
    """How texts are fingerprinted: units in a k-mer, minimal k-mers in a tuple, and bits of a hash that choose one of the tuples."""

    k: int = 2
    tuple_size: int = 2
    bin_bits: int = 6

    def bin_of(self, packed: Column) -> Column:
        return F.shiftright(packed, 64 - self.bin_bits)


def units_of(text: Column) -> Column:
    """Hashes of a text's units in order: words between the contracts' white space, long ones in parts."""
    words = F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")
    hashes = lambda parts: F.transform(parts, lambda w: F.xxhash64(w))
    parts = lambda w: F.when(F.octet_length(w) <= LONG, F.array(w)).otherwise(F.regexp_extract_all(w, F.lit(f"(?s){PARTS}"), 0))
    return hashes(F.flatten(F.transform(words, parts)))


def _packed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~PLACE)).bitwiseOR(place.cast("long"))


def _hash_of(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def _place_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(PLACE))


def fingerprinted(df: DataFrame, text: str, out: str, scheme: Scheme = Scheme()) -> DataFrame:
    """Adds the signature of a text column as an array of whole numbers: a tuple's bin and 32 bits of its hash, by bin.

    A k-mer is k consecutive units (fewer in a shorter text, none in a text without any). Each
    is numbered among its equals in text order, and k-mer and number are hashed together; the first
    of equals keeps the k-mer's own hash. One permutation serves all tuples: the first bits of a hash
    deal the k-mers into bins, and each bin's minimal ones (all, where it has fewer) are put back into
    text order and hashed as a tuple. Equal texts have equal signatures; a bin without k-mers has no tuple.

    The arrays take some 30 bytes a unit while a text is worked on, and each step is linear but for sorting.
    """
    k, per = scheme.k, scheme.tuple_size
    name = lambda step: unused(f"_{out}_{step}", df)
    words, sorted_, more, merged, chosen = used = [name(step) for step in ("words", "sorted", "more", "merged", "chosen")]
    df = fixed(df, words, units_of(F.col(text)))

    at = lambda array, i: F.get(F.col(array), i)
    n = F.size(words)
    mers = F.transform(
        F.sequence(F.lit(1), n - (k - 1)),
        lambda i: _packed(F.xxhash64(*[at(words, i + d) for d in range(-1, k - 1)]), i),
    )
    short = F.array(_packed(F.xxhash64(F.col(words)), F.lit(1)))
    df = fixed(df, sorted_, F.sort_array(F.when(n >= k, mers).when(n > 0, short).otherwise(F.array().cast("array<long>"))))

    again = lambda array, x, i: (i > 0) & (_hash_of(at(array, i - 1)) == _hash_of(x))
    df = fixed(df, more, F.filter(F.col(sorted_), lambda x, i: again(sorted_, x, i)))
    steps = F.filter(F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1), b)), lambda b: b < F.size(more))

    def before(x: Column, j: Column) -> Column:
        """How many of its equals come before the j-th of the repeats: the largest distance at which the hash is the same, bit by bit."""
        same = lambda far: (j >= far) & (_hash_of(at(more, j - far)) == _hash_of(x))
        found = F.aggregate(steps, F.lit(0), lambda held, b: F.when(same(held + b), held + b).otherwise(held))
        return F.when(same(F.lit(1)), found).otherwise(F.lit(0))

    numbered = F.transform(F.col(more), lambda x, j: _packed(F.xxhash64(_hash_of(x), before(x, j) + 1), _place_of(x)))
    own_bin = lambda array, x, i, away: scheme.bin_of(at(array, i + away)) == scheme.bin_of(x)

    def may_be_least(x: Column, i: Column) -> Column:
        """Whether fewer than `per` different k-mers come before in the bin, as far as the last `per` places tell; merging decides."""
        held = lambda d: _hash_of(at(sorted_, i - d))
        repeated = F.lit(False)
        for d in range(1, per):
            repeated = repeated | (held(d) == held(d + 1))
        return ((i < per) | ~own_bin(sorted_, x, i, -per) | repeated) & ~again(sorted_, x, i)

    df = fixed(df, merged, F.sort_array(F.concat(F.filter(F.col(sorted_), may_be_least), numbered)))
    least = lambda x, i: (i < per) | ~own_bin(merged, x, i, -per)
    df = fixed(df, chosen, F.filter(F.col(merged), least))

    def tuple_from(x: Column, i: Column) -> Column:
        members = F.filter(F.slice(F.col(chosen), i + 1, per), lambda y: scheme.bin_of(y) == scheme.bin_of(x))
        ordered = F.sort_array(F.transform(members, lambda y: F.shiftleft(_place_of(y), 32).bitwiseOR(F.shiftrightunsigned(y, 32))))
        hashed = F.xxhash64(F.transform(ordered, lambda y: y.bitwiseAND(F.lit(0xFFFFFFFF)))).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(scheme.bin_of(x) + (1 << (scheme.bin_bits - 1)), 32).bitwiseOR(hashed)

    starts = F.transform(F.col(chosen), lambda x, i: F.when((i == 0) | ~own_bin(chosen, x, i, -1), tuple_from(x, i)))
    df = fixed(df, out, F.filter(starts, lambda v: v.isNotNull()))
    return df.drop(*used)


def likeness(a: Column, b: Column) -> Column:
    """The share of tuples that two signatures have in common, of the bins that either fills; 1 for two without any tuple."""
    bins = lambda signature: F.transform(signature, lambda v: F.shiftright(v, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(signature: Column) -> Column:
    """Ten hexadecimal digits a tuple: two for its bin, eight for its hash."""
    return F.array_join(F.transform(signature, lambda v: F.lower(F.lpad(F.hex(v), 10, "0"))), "")


def _place(key: Column, text: Column) -> Column:
    """What the order of documents goes by, from the largest to the smallest: the key, one without last, and then a hash of the text."""
    return F.struct(key.isNotNull().alias("some"), key.alias("key"), F.xxhash64(text).alias("mark"))


def _first_places(told: DataFrame, size: int) -> list[list[str]]:
    """The first place of every block of the order, as JSON, in groups whose length is about their number."""
    blocks = max(1, min(BLOCKS, math.ceil(size / BLOCK_CHARS)))
    dealt = told.select("_place").repartitionByRange(blocks, F.col("_place").desc()).groupBy(F.spark_partition_id().alias("_block"))
    firsts = dealt.agg(F.max("_place").alias("_first")).orderBy(F.col("_first").desc()).select(F.to_json("_first", {"ignoreNullFields": "false"})).collect()
    most = max(1, math.isqrt(len(firsts)))
    return [[r[0] for r in firsts[i : i + most]] for i in range(0, len(firsts), most)]


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", scheme: Scheme = Scheme()) -> DataFrame:
    """Every row's key, text and signature, and the text and signature of the document after it, keys descending; the first comes after the last.

    The texts are shuffled once, to blocks of the order of bounded numbers of characters, of which each
    is sorted by a task; the first row of a block is sent to the one before it as well. Where
    blocks begin is a table of at most BLOCKS rows that a pass over keys and hashes of texts finds. Rows
    with one key are ordered by a hash of their texts, so a key that repeats with many texts is split
    among blocks; rows that are equal in key and text are neighbours in one block. A null text counts as
    empty, a null key comes last, and a single document comes after itself. An empty table gives an empty result.
    """
    told = docs.select(F.col(key).alias("_key"), text_of(docs, text).alias("_text"))
    told = told.withColumn("_place", _place(F.col("_key"), F.col("_text")))
    size = told.agg(F.sum(F.length("_text").cast("long"))).first()[0] or 0
    groups = _first_places(told, size)
    kind = told.schema["_place"].dataType.simpleString()
    literal = "[" + ",".join("[" + ",".join(group) + "]" for group in groups) + "]"
    firsts = F.from_json(F.lit(literal), f"array<array<{kind}>>")
    rows = fingerprinted(told, "_text", "_signature", scheme)
    here = F.col("_place")
    rows = fixed(rows, "_group", F.size(F.filter(firsts, lambda g: g[0] >= here)) - 1)
    inner = F.get(firsts, F.col("_group"))
    rows = fixed(rows, "_inner", F.size(F.filter(inner, lambda p: p >= here)) - 1)
    wide, many = len(groups[0]) if groups else 1, sum(map(len, groups))
    block = F.col("_group") * wide + F.col("_inner")
    sent = F.struct(block.alias("block"), F.lit(False).alias("again"))
    again = F.struct(F.pmod(block - 1, F.lit(max(1, many))).alias("block"), F.lit(True).alias("again"))
    is_first = F.get(inner, F.col("_inner")) == here
    rows = rows.withColumn("_to", F.explode(F.when(is_first, F.array(sent, again)).otherwise(F.array(sent))))
    rows = rows.select("_key", "_text", "_signature", "_place", F.col("_to.block").alias("_block"), F.col("_to.again").alias("_again"))
    after = Window.partitionBy("_block").orderBy("_again", F.col("_place").desc())
    rows = rows.withColumn("_next", F.lead(F.struct("_text", "_signature")).over(after)).where("NOT _again")
    return rows.select(F.col("_key").alias(key), F.col("_text").alias("text"), F.col("_signature").alias("signature"), F.col("_next._text").alias("next_text"), F.col("_next._signature").alias("next_signature"))


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", scheme: Scheme = Scheme()) -> DataFrame:
    """The fingerprint of every text, of the text with its last third replaced by the start of the next document, and how alike they are.

    Returns key, n_chars, edited (the edited text), fingerprint, edited_fingerprint (as_text of the
    signatures), near_edited and near_next. The last floor(n_chars / 3) code points give way to as many first ones
    of the next document, or all it has; see with_next() for the order and fingerprinted() for signatures.
    Texts without any unit (null, empty, white space) have an empty fingerprint, and two of them are alike.
    Other columns of the input are not read; repeated rows have a result each.
    """
    rows = with_next(docs, key, text, scheme)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - CAST(floor(length(text) / 3) AS INT))"), F.substring(F.col("next_text"), F.lit(1), third))
    rows = fingerprinted(fixed(rows, "edited", edited), "edited", "edited_signature", scheme)
    return rows.select(
        F.col(f"`{key}`"),
        F.length("text").cast("long").alias("n_chars"),
        "edited",
        as_text(F.col("signature")).alias("fingerprint"),
        as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
