"""Operators on small tables with awkward rows, against brute force; queries against SQL; the pipeline step by step."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ngram_join, queries, sharding, url_filters
from tessera.llm.bpe import bpe_round_trip
from tessera.llm.components import connected_components
from tessera.llm.common import Scratch
from tessera.llm.decontaminate import find_leaks
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.langid import identify_language
from tessera.llm.pii import find_personal_data
from tessera.llm.quality import classify_quality
from tessera.llm.sharding import shard_documents
from tessera.llm.toxicity import classify_toxicity
from tessera.llm.url_filters import filter_urls, host_of, validity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators add, as columns of the input.
CLASH = ("kept", "keep_id", "group_size", "digest", "shard", "slot", "size", "score", "held_out", "predicted", "ids", "spans", "n", "rep", "component_id", "host", "decision", "set", "key", "_row", "component", "_found", "_text", "_key", "_leak", "node", "passage", "lang_pred")


def text_rows():
    rng = random.Random(8)
    words = "the cat sat on a mat while dogs ran over green hills and rivers near old towns".split()
    long = [" ".join(rng.choice(words) + str(rng.randint(0, 60)) for _ in range(rng.randint(8, 70))) for _ in range(25)]
    texts = [None, "", " \t\n", "a", "a", " A  b", "ab", "e-mail me@example.org, 10.0.0.1 +1 (555) 555-0199", "<|endoftext|> x", "word " * 4000, "x" * 30_000, *long]
    for t in long[:12]:
        for _ in range(3):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [long[0], long[0] + "\n", long[1].replace(" ", "  ")]
    return [(i, t, ["en", "de", None][i % 3], "src", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return text_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("own") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(i, int(i % 4 != 0), int(i % 5 == 0)) for i, *_ in rows] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_dedup(docs, clashing, rows, digest_all):
    by = {}
    for i, t, *_ in rows:
        by.setdefault(normal(t), []).append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), i == min(g)[1]) for g in by.values() for _, i in g}
    for df in (docs, clashing):
        got = exact_dedup(df, digest_all=digest_all, head=4).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == want and len(got) == len(rows)
        told = {r.doc_id: r.digest for r in got}
        for i, t, *_ in rows:
            sure = digest_all or want[i][1] > 1
            assert told[i] == (hashlib.sha256(normal(t).encode()).digest() if sure else told[i])


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_dedup_of_repeated_rows_and_null_keys(spark, digest_all):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "other"), (None, "a  b"), (None, "z")], "doc_id long, text string")
    got = exact_dedup(df, digest_all=digest_all).collect()
    assert sorted((r.group_size, r.kept) for r in got) == [(1, True), (1, True), (3, False), (3, False), (3, True)]
    assert [r.doc_id for r in got if r.group_size == 3 and r.kept] == [None]  # it has the most code points
    assert exact_dedup(df.where("false"), digest_all=digest_all).count() == 0
    rows = [(9, "x  y", 4), (9, "x y", 1), (9, "x y", 0), (8, "x\ty ", 2), (7, "z", 3), (None, None, 5), (None, "", 6)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, n long"), digest_all=digest_all, row="n").collect()
    assert {r.n: (r.keep_id, r.group_size, r.kept) for r in got} == {4: (8, 4, False), 1: (8, 4, False), 0: (8, 4, False), 2: (8, 4, True), 3: (7, 1, True), 5: (None, 2, True), 6: (None, 2, False)}


def test_sharding(spark, docs, clashing, none, rows):
    for df in (docs, clashing):
        got = shard_documents(df, 5).collect()
        assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows}
        for s in range(5):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        assert all(r.grown_shard in (r.shard, 5) and r.law == "key" for r in got)
    assert shard_documents(none, 5).count() == 0
    again = shard_documents(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string"), 3).collect()
    assert len(again) == 3 and len({(r.shard, r.slot) for r in again}) == 3


def test_sharding_of_a_key_that_repeats(spark, monkeypatch):
    """A third of the rows have one key: slots are the same as without splitting its block, gapless and the same on every run."""
    rows = [(5, f"text {i % 70}") for i in range(150)] + [(i, "other") for i in range(300)] + [(None, None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    whole = sorted(map(tuple, shard_documents(df, 3).collect()), key=str)
    monkeypatch.setattr(sharding, "HOT_ROWS", 20)
    monkeypatch.setattr(sharding, "BLOCKS", 32)  # other keys share the hot one's block
    few = [sorted(map(tuple, shard_documents(df, 3).collect()), key=str)]
    for bound in (60, 100_000):
        monkeypatch.setattr(sharding, "HOT_ROWS", bound)
        few.append(sorted(map(tuple, shard_documents(df, 3).collect()), key=str))
    assert few[0] == few[1] == few[2] and len(whole) == len(few[0]) == len(rows)
    for got in (whole, few[0]):
        for shard in range(3):
            assert sorted(r[5] for r in got if r[4] == shard) == list(range(sum(r[4] == shard for r in got)))


@pytest.mark.parametrize("most", [3, 7, 1 << 20])
def test_common_shingles_are_the_most_common(spark, monkeypatch, most):
    """However high the counts are, as many of the most common shingles are told as the bound allows, but for a slice of a hash."""
    monkeypatch.setattr(ngram_join, "COMMON", most)
    sets = [np.array([k for k in range(12) if n < 9000 - 600 * k], "<u8") for n in range(9000)]
    rows = [(bytearray(n.to_bytes(4, "big")), bytearray(s.tobytes())) for n, s in enumerate(sets)]
    told, rank = ngram_join._common_shingles(spark.createDataFrame(rows, "set binary, counted binary"), Scratch(spark, "test"))
    assert sorted(told.tolist()) == list(range(min(most, 12))) and rank.tolist() == [min(most, 12) - 1 - int(t) for t in told]


def test_hosts(spark):
    cases = {
        "http://[2001:db8::1]/x": "[2001:db8::1]",
        "https://[2001:DB8::1]:8080/x": "[2001:db8::1]",
        "http://user:p@ss@example.com/a": "example.com",
        "http://example.com\\@evil.com/": "example.com",
        "http://Example.COM.:80?q": "example.com",
        "http://a@b#c": "b",
        "http:///x": None,
        "http://[broken/x": None,
        "no url": None,
        None: None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.h for r in df.select("url", host_of(F.col("url")).alias("h")).collect()} == cases


def test_bpe(docs, clashing, none, rows):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.VOCABULARY)
    for df in (docs, clashing):
        got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe_round_trip(df, queries.VOCABULARY).collect()}
        assert got == {i: (library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, *_ in rows}
    assert bpe_round_trip(none, queries.VOCABULARY).count() == 0


def links_of(texts):
    """Brute force: shingle sets as tuples of words, all pairs, components by smallest id."""
    sets = {}
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("long", [64, 4])
def test_ngram_join(monkeypatch, docs, clashing, none, rows, long):
    monkeypatch.setattr(ngram_join, "LONG", long)
    want = links_of([(i, t) for i, t, *_ in rows])
    assert len({c for _, c in want.values()}) < len(want)
    for df in (docs, clashing) if long == 64 else (docs,):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(df).collect()}
        assert got == want
    assert ngram_join.ngram_jaccard_join(none).count() == 0


def test_ngram_join_of_a_large_group(spark, monkeypatch):
    """Near copies of one text, which are never expanded into all pairs, and texts that share a long passage."""
    monkeypatch.setattr(ngram_join, "LONG", 8)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 10)
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 999)}" for _ in range(80)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(80)] = f"x{i}"
        rows.append((1000 - i, " ".join(w)))
    shared = " ".join(f"s{k}" for k in range(30))
    rows += [(2000 + i, shared + " " + " ".join(f"u{i}y{k}" for k in range(60))) for i in range(40)]
    rows += [(3000, None), (3001, None), (None, shared), (5, " ".join(base)), (5, " ".join(base))]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = links_of([(i, t) for i, t in rows if i is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want and len(got) == len(rows)


def test_ngram_join_by_row(spark):
    """One key with different texts has links for each of them; keys that are null have the component's smallest key."""
    base = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    near = lambda t, x: t + f" {x}"
    rows = [(7, base), (7, other), (9, near(base, "a")), (3, near(other, "b")), (None, near(base, "c")), (None, near(other, "d")), (None, "alone here"), (None, None), (7, None)]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, number long"), carry=("number",)).collect()
    told = {r.number: r for r in got}
    assert [told[i].component_id for i in range(9)] == [7, 3, 7, 3, 7, 3, None, None, 7]
    assert told[0].component == told[2].component == told[4].component != told[1].component == told[3].component == told[5].component
    assert told[7].component is None and told[8].component is None and told[6].component is not None


def test_ngram_join_of_very_long_texts(spark, tmp_path):
    """Sets of over a million shingles, in many groups, and near copies of them."""
    words = np.char.add("w", np.arange(1_100_000).astype(str))
    long = " ".join(words)
    rows = [(1, long), (2, long + " more"), (3, " ".join(words[: 900_000])), (4, " ".join(words[:700_000])), (5, long.upper())]
    rows += [(10 + i, " ".join(words[20_000 * i : 20_000 * i + 60])) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert [got[i] for i in range(1, 6)] == [(1_099_996, 1), (1_099_997, 1), (899_996, 1), (699_996, 1), (1_099_996, 1)]  # 4 by way of 3
    assert all(got[10 + i] == (56, 10 + i) for i in range(40))


def test_shared_passages_make_no_pairs(spark):
    """Unlinked texts that share 81 % of their shingles: no candidate pair is made, however many they are."""
    rng = random.Random(3)
    common = " ".join(f"b{rng.randrange(999)}" for _ in range(174))
    df = spark.createDataFrame([(i, common + " " + " ".join(f"u{i}x{k}" for k in range(40))) for i in range(600)], "doc_id long, text string")
    lists = [(t, i, 214, 40 + t) for t in range(14) for i in range(600)]  # their first shared shingles stand after the 40 of their own
    tagged = spark.createDataFrame(lists, "token long, node long, n long, place long").withColumn("c", F.col("node"))
    assert ngram_join._candidates(tagged, 75).count() == 0
    assert ngram_join.ngram_jaccard_join(df).where("component_id <> doc_id").count() == 0
    near = tagged.withColumn("place", F.col("place") - 12)
    assert ngram_join._candidates(near.where("node < 20"), 75).count() == 190


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(50, 99), rng.randint(50, 99)) for _ in range(30)] + [(200, x) for x in range(201, 260)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_classifiers_take_any_rows(docs, clashing, none, labels, rows):
    for run in (identify_language, lambda d: classify_quality(d, labels), lambda d: classify_toxicity(d, labels)):
        plain = sorted(map(tuple, run(docs).collect()))
        assert len(plain) == len(rows) and plain == sorted(map(tuple, run(clashing).collect()))
        assert run(none).count() == 0
        repeated = run(docs.unionByName(docs)).count()
        assert repeated == 2 * len(rows)
    got = {r.doc_id: r for r in identify_language(docs).collect()}
    assert got[0].lang_pred == got[1].lang_pred == "und" and got[0].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    for run, threshold in ((classify_quality, 0.3), (classify_toxicity, 0.5)):
        for r in run(docs, labels).collect():
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert run(docs, labels.where("false")).agg(F.max("score")).first()[0] == 0


def test_scores_do_not_depend_on_labels_of_held_out_rows(docs, labels):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumns({c: F.when(held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for run in (classify_quality, classify_toxicity):
        assert sorted(map(tuple, run(docs, labels).collect())) == sorted(map(tuple, run(docs, flipped).collect()))


def test_personal_data(docs, clashing, none):
    got = {r.doc_id: r.spans for r in find_personal_data(docs).collect()}
    assert [(s.kind, s.start, s.end) for s in got[7] if s.base] == [("email", 7, 21), ("ip", 23, 31), ("phone", 32, 49)] and got[0] == []
    assert {r.doc_id: r.spans for r in find_personal_data(clashing).collect()} == got and find_personal_data(none).count() == 0


def test_leaks(spark, docs, none, rows):
    long = [t for _, t, *_ in rows if t and len(t) > 200][3]
    words = long.split()
    items = spark.createDataFrame([(1, " ".join(words[2:20]) + ". yes indeed."), (2, " ".join(words[:12])), (3, None), (4, ""), (5, "nothing like this here. no.")], "item_id long, text string")
    holders = {i for i, t, *_ in rows if t and " ".join(words[:12]) in t}
    for shard in (50_000, 1):
        found = find_leaks(docs, items, shard_items=shard).collect()
        assert {r.doc_id for r in found if r.item_id == 2} >= holders and not any(r.item_id in (3, 4, 5) for r in found)
        assert all(r.score > 0.3 and r.question >= 0.5 and r.answer >= 0.5 for r in found)
    assert find_leaks(none, items).count() == 0 and find_leaks(docs, items.where("false")).count() == 0


@pytest.mark.parametrize("n", [257, 600])
def test_leaks_of_long_items(spark, n):
    rng = random.Random(n)
    noise = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    item = f"{noise(n - 2)}. answer the"
    docs = spark.createDataFrame([(1, f"the {noise(400)}"), (2, f"{noise(99)} {item} {noise(99)}"), (3, f"the answer {noise(50)}"), (4, " ".join(item.split()[: n // 3]) + f" the {noise(99)}")], "doc_id long, text string")
    found = find_leaks(docs, spark.createDataFrame([(7, item), (8, noise(12))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.question, r.answer) for r in found] == [(2, 7, 1.0, 1.0)] and abs(found[0].score - 1) < 1e-9


def test_leaks_do_not_depend_on_shards(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(70)]
    made = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, f"{made(rng.randint(3, 30))}. {made(2)}.") for i in range(30)] + [(30, made(300)), (31, made(700)), (31, made(9)), (32, ""), (33, None), (34, "..."), (35, "one. two"), (36, "A: ."), (37, "Answer: w1")]
    docs = [(i, f"{made(40)} {' '.join((w := items[i % 32][1].split())[len(w) * (i % 4) // 8 :])} {made(rng.randint(0, 90))}") for i in range(90)]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, few, many = (sorted(map(tuple, find_leaks(docs, items, shard_items=n).collect())) for n in (50_000, 13, 2))
    assert len(one) > 50 and any(r[3] < 1 for r in one) and one == few == many


#: Dated changes of filter lists: list, action, pattern, change, date.
LIST_CHANGES = """
('gambling', 'block', 'casino-win.example.com', 'add', DATE '2024-01-10'),
('gambling', 'block', 'free-bets.example.com', 'add', DATE '2024-02-01'),
('gambling', 'block', 'free-bets.example.com', 'remove', DATE '2024-06-15'),
('gambling', 'block', 'free-bets.example.com', 'add', DATE '2024-09-01'),
('pharma', 'block', 'cheap-pills.example.com', 'add', DATE '2024-03-20'),
('pharma', 'block', 'cheap-pills.example.com/de', 'add', DATE '2024-05-05'),
('pharma', 'allow', 'cheap-pills.example.com/fr', 'add', DATE '2024-04-01'),
('pharma', 'allow', 'cheap-pills.example.com/fr', 'remove', DATE '2024-08-01'),
('spam', 'block', 'tionble.example.org', 'add', DATE '2024-02-10'),
('spam', 'block', 'tionble.example.org', 'remove', DATE '2024-02-10')
"""


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_url_filters(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filters, "BROADCAST_ROWS", broadcast)
    entries = spark.sql(f"SELECT * FROM VALUES {LIST_CHANGES} AS t(list_name, action, pattern, change, dated)")
    assert validity(entries).where("pattern = 'tionble.example.org'").count() == 0
    deep = "https://cheap-pills.example.com/fr/" + "x/" * 20_000
    told = [
        (1, "https://casino-win.example.com/x", "2024-01-09", "none"), (2, "https://a.CASINO-win.example.com:8080/x", "2024-01-10", "block"), (3, "http://free-bets.example.com", "2024-07-01", "none"),
        (4, "http://free-bets.example.com", "2024-09-01", "block"), (5, "https://cheap-pills.example.com/fr/9?x#y", "2024-05-01", "allow"), (6, "https://cheap-pills.example.com/fr/9", "2024-08-01", "block"),
        (7, "not a url", "2024-08-01", "invalid"), (8, None, "2024-08-01", "invalid"), (9, "https://x.example.org/", None, "invalid"), (10, "https://notcasino-win.example.com/", "2024-08-01", "none"), (2, "https://a.CASINO-win.example.com:8080/x", "2024-01-10", "block"),
        (11, deep, "2024-05-01", "allow"), (12, "https://" + "a." * 2000 + "casino-win.example.com/", "2024-05-01", "block"), (None, "", "2024-05-01", "invalid"),
    ]
    own = ["host", "_n", "_best", "_url", "_day", "valid_from", "day", "Pattern", "list_name", "action"]
    df = spark.createDataFrame([(*t[:3], *own) for t in told], "page_id long, url string, fetched_at string, " + ", ".join(f"{c} string" for c in own))
    got = filter_urls(df, entries).collect()
    assert sorted((str(r.page_id), r.decision) for r in got) == sorted((str(t[0]), t[3]) for t in told)
    kept = ("_n", "_best", "_url", "_day", "valid_from", "day", "action")
    assert all(getattr(r, c) == c for r in got for c in ("valid_from", "day", "action")) and all(r[c] == c for r in got for c in kept)
    assert {r.decision for r in filter_urls(df, entries.where("false")).collect()} == {"none", "invalid"} and filter_urls(df.where("false"), entries).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df, told = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(told.columns)
    plain = lambda r, at: tuple(str(r[i]) for i in at)
    got = sorted(plain(r, [df.columns.index(c) for c in order]) for r in df.collect())
    assert got == sorted(plain(r, [told.columns.index(c) for c in order]) for r in told.fetchall())


def test_pipeline(spark, tmp_path, rows):
    """Each stage against brute force on its own input; run() gives the last stage's rows."""
    clean = "These are plain words of a longer passage about many towns and rivers of the north. The answer is green."
    more = [(500, f"before {clean} after it all comes more text", "en", "s", 1), (501, "12345 !!", "en", "s", 1), (502, "12345 !!", "en", "s", 1)]
    spark.createDataFrame([*rows, *more, rows[15]], DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, clean)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    scratch, kept = Scratch(spark, "t"), []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = scratch.stage(stage(spark, docs, str(tmp_path)), name)
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        if name == "language_id":
            want = sorted(i for i, t in before if t and any(c.isalpha() for c in t))
        elif name == "exact_dedup":
            groups = {}
            for i, t in before:
                groups.setdefault(normal(t), []).append((-len(t or ""), i))
            want = sorted(min(g)[1] for g in groups.values())
        elif name == "ngram_jaccard":
            want = sorted(i for i, (_, c) in links_of(before).items() if i == c)
        elif name == "decontaminate":
            want = sorted(i for i, t in before if clean not in t)
        else:
            want = sorted(i for i, _ in before)
        assert ids == want, name
        if name != "bpe":
            assert out.columns == docs.columns
            docs = out
        kept.append(len(ids))
    assert kept[0] < len(rows) + 4 and kept[3] < kept[2]
    got = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted((r.doc_id, r.ids_sha256) for r in out.collect())


def test_pipeline_decides_by_row(spark, tmp_path):
    """Null keys, one key with a good and a bad text, rows that repeat: what one row deserves happens to no other."""
    item = "these are the words of a question that stands in the test about rivers. the answer is green."
    prose = lambda x: " ".join(f"{x}{k}" for k in range(30))
    rows = [
        (7, "12 34"), (7, prose("kept")), (None, "56 78 !"), (None, prose("nokey")), (None, prose("nokey")), (8, prose("twice")), (8, prose("twice")), (9, prose("twice")),
        (10, prose("near") + " x"), (None, prose("near") + " y"), (11, f"{prose('leak')} {item}"), (11, prose("clean")), (None, f"{item} {prose('other')}"), (12, None), (12, ""), (12, prose("last")),
    ]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    wants = [
        sorted((str(i), t) for i, t in rows if t and any(c.isalpha() for c in t)),
        sorted([("7", prose("kept")), ("None", prose("nokey")), ("8", prose("twice")), ("10", prose("near") + " x"), ("None", prose("near") + " y"), ("11", f"{prose('leak')} {item}"), ("11", prose("clean")), ("None", f"{item} {prose('other')}"), ("12", prose("last"))]),
    ]
    wants.append([r for r in wants[1] if not r[1].endswith(" y")])
    wants.append([r for r in wants[2] if item not in r[1]])
    read, scratch = spark.read.parquet(str(tmp_path / "documents.parquet")), Scratch(spark, "t")
    for source in (read, spark.createDataFrame(read.collect(), DOCS)):  # rows of files, and rows without a place
        docs = source.withColumn("_row", F.lit("own")).withColumn("_found", F.lit("own"))
        for (name, stage), want in zip(corpus_pipeline.STAGES, wants):
            out = scratch.stage(stage(spark, docs, str(tmp_path)), name)
            assert out.columns == docs.columns
            assert sorted((str(r.doc_id), r.text) for r in out.collect()) == want, name
            docs = out
    staged = lambda: {p.name for p in Path(scratch.path.removeprefix("file://")).parent.iterdir()}
    before = staged()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(wants[3])
    assert [name.startswith("tessera-pipeline-") for name in staged() - before] == [True]  # the table that the last stage reads


@pytest.mark.parametrize("labelled", ["none", "held_out", "und"])
def test_language_stage_without_labels(spark, tmp_path, rows, labelled):
    """Only texts without a letter go when there is nothing to learn from, or when `und` is all there is to learn."""
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    lang = {"none": lambda i: None, "held_out": lambda i: "en" if held(i) else None, "und": lambda i: "und"}[labelled]
    docs = spark.createDataFrame([(i, t, lang(i), s, n) for i, t, _, s, n in [*rows, (501, "12345 !!", None, "s", 8)]], DOCS)
    kept = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t, *_ in rows if t and any(c.isalpha() for c in t))
    if labelled == "none":
        docs.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame([(1, "nothing like this here. no.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
        assert {r.lang_pred for r in identify_language(docs).collect()} == {"und"}
