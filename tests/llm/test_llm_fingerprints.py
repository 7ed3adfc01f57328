"""Order MinHash against a plain version from the published steps, with the same hash function from another library."""

from __future__ import annotations

import re
import struct

import pytest
import xxhash

from tessera.llm import order_minhash as O

LOW = (1 << 64) - 1


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def hash_longs(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def plain_signature(text, k=2, per=2, bits=6):
    units = []
    for word in filter(None, re.split(r"[\x20\x09-\x0D]+", text or "")):
        whole = len(word.encode()) <= 16
        units += [word] if whole else re.findall(r"[⺀-鿿가-힯]|[^⺀-鿿가-힯]{1,16}", word, re.DOTALL)
    hashed = [signed(xxhash.xxh64_intdigest(u.encode(), 42)) for u in units]
    mers = [hash_longs(*hashed[i : i + k]) for i in range(len(hashed) - k + 1)] if len(hashed) >= k else [hash_longs(*hashed)] if hashed else []
    seen, elements = {}, []
    for place, mer in enumerate(mers, 1):
        cut = mer >> 31
        number = seen.get(cut, 0)
        seen[cut] = number + 1
        elements.append((cut if number == 0 else hash_longs_int(cut, number) >> 31, place))
    bins = {}
    for h, place in sorted(elements):
        bins.setdefault(h >> (33 - bits), []).append((place, h))
    out = []
    for b in sorted(bins):
        chosen = sorted(bins[b][:per])
        parts = [(((h << 31 | place) & LOW) >> 32) for place, h in chosen]
        out.append((b + (1 << (bits - 1))) << 32 | hash_longs(*parts) & 0xFFFFFFFF)
    return out


def hash_longs_int(value, number):
    seed = xxhash.xxh64_intdigest(struct.pack("<q", value), 42)
    return signed(xxhash.xxh64_intdigest(struct.pack("<i", number), seed))


TEXTS = [
    None,
    "",
    " \n\t",
    "one",
    "two words",
    "a b a b a b a b c a b",
    "again " * 400,
    "日本語のテキストは空白なしで書かれています。とても長い文です",
    "x" * 5000,
    "the quick brown fox jumps over the lazy dog and the quick brown fox sleeps",
    "  leading and trailing  ",
    "\u0085next line em space",
    "😀😁 emoji 😀😁 emoji",
]


def test_signatures_equal_plain_version(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    found = {r.doc_id: r.s for r in O.fingerprinted(df.selectExpr("doc_id", "coalesce(text, '') AS text"), "text", "s").collect()}
    assert found == {i: plain_signature(t) for i, t in enumerate(TEXTS)}


def test_other_schemes(spark):
    text = "to be or not to be that is the question whether tis nobler in the mind to suffer to be or not"
    df = spark.createDataFrame([(text,)], "text string")
    for k, per, bits in ((1, 1, 3), (3, 3, 2), (2, 4, 1)):
        assert O.fingerprinted(df, "text", "s", O.Scheme(k, per, bits)).first().s == plain_signature(text, k, per, bits)


def likeness(a, b):
    bins = {v >> 32 for v in a} | {v >> 32 for v in b}
    return len(set(a) & set(b)) / len(bins) if bins else 1.0


def plain_rows(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))
    ordered, out = sorted(rows, key=key, reverse=True), []
    hexed = lambda s: "".join(f"{v:010x}" for v in s)
    for i, (doc, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other, following = map(plain_signature, (text, edited, after))
        out.append((doc, len(text), edited, hexed(own), hexed(other), likeness(own, other), likeness(own, following)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_chars", [1 << 22, 40])
def test_documents_equal_plain_version(spark, monkeypatch, block_chars):
    monkeypatch.setattr(O, "BLOCK_CHARS", block_chars)
    rows = [(7 * i % 13, t) for i, t in enumerate(TEXTS)] + [(3, "hot key " + str(i)) for i in range(30)] + [(None, "no key"), (5, "twice"), (5, "twice"), (-4, "minus four")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS edited", "1 AS signature", "2 AS _place", "3 AS _block").repartition(4)
    found = O.fingerprint_documents(df)
    assert found.columns == ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_rows(rows)


def test_small_tables_and_other_keys(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert O.fingerprint_documents(empty).count() == 0
    alone = O.fingerprint_documents(spark.createDataFrame([(1, "abcdef ghi")], "doc_id long, text string")).first()
    assert alone.edited == "abcdef abc"
    named = spark.createDataFrame([("a", "first text"), ("b", "second"), (None, "third")], "name string, body string")
    found = {r.name: r.edited for r in O.fingerprint_documents(named, "name", "body").collect()}
    assert found == {"b": "secofi", "a": "first tthi", None: "thirs"}


def test_order_tells_texts_apart(spark):
    words = [f"w{i}" for i in range(400)]
    swapped = [w for i in range(0, 400, 20) for w in words[380 - i : 400 - i]]
    near = [*words[:200], "new", *words[200:]]
    df = spark.createDataFrame([(" ".join(t),) for t in (words, swapped, near)], "text string")
    own, moved, edited = [r.s for r in O.fingerprinted(df, "text", "s").collect()]
    assert likeness(own, edited) > 0.9 > 0.7 > likeness(own, moved)
