"""The registered queries over whole tables, against brute force, the public library, and held-out labels."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import decontaminate, queries
from tests.llm.brute import components_of, leaks_of, normal

SF = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return {i: t or "" for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}


def test_op2_equals_library(spark, texts):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.VOCABULARY)
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op2_bpe(spark, SF).collect()}
    want = {}
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert got == want


def plain_spans(text):
    kinds = [[m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]]
    kinds.append([m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))])

    def luhn(digits):
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0

    cards = [(m.span(), re.sub("[ -]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    kinds.append([s for s, digits in cards if 13 <= len(digits) <= 19 and luhn(digits)])
    kinds.append([m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15])
    return kinds


def test_op6_base_spans_and_counts(spark, texts):
    names = ("email", "ip", "card", "phone")
    rows = queries.op6_pii(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        kinds = plain_spans(texts[r.doc_id])
        packed = [f"{name}:{a}:{b}" for name, spans in zip(names, kinds) for a, b in spans]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, kinds))
        assert r.base_sha256 == hashlib.sha256(",".join(packed).encode()).hexdigest()
        found = r.spans.split(",") if r.spans else []
        assert set(packed) <= set(found)
        assert found == sorted(found, key=lambda s: (names.index(s.split(":")[0]), int(s.split(":")[1])))


@pytest.mark.parametrize(("name", "label", "recall", "precision"), [("op3_toxicity", "toxic", 0.65, 0.95), ("op10_quality", "quality", 0.95, 0.95)])
def test_scores_on_held_out_labels(spark, duck, texts, name, label, recall, precision):
    told = dict(duck.sql(f"SELECT doc_id, {label} FROM labels WHERE {label} IS NOT NULL").fetchall())
    rows = queries.QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [(told[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in told]
    right = sum(y and p for y, p in held)
    assert right >= recall * sum(y for y, _ in held) and right >= precision * sum(p for _, p in held) and right > 3


def test_op3_on_more_labels(spark, duck):
    """At ten times the labels the recall on held-out rows is at least 0.9."""
    large = str(Path(SF).parent / "sf0.1")
    if not Path(large).exists():
        pytest.skip("no larger tables")
    told = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{large}/labels.parquet' WHERE toxic IS NOT NULL").fetchall())
    held = [(told[r.doc_id], r.predicted) for r in queries.op3_toxicity(spark, large).collect() if r.held_out and r.doc_id in told]
    right = sum(y and p for y, p in held)
    assert right >= 0.9 * sum(y for y, _ in held) and right >= 0.95 * sum(p for _, p in held)


def test_op8_on_held_out_rows(spark, duck, texts):
    told = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = queries.op8_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    lettered = {i: any(c.isalpha() for c in t) for i, t in texts.items()}
    assert all((r.lang_pred == "und") == (not lettered[r.doc_id]) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [told[r.doc_id] == r.lang_pred for r in rows if r.held_out and told[r.doc_id] and lettered[r.doc_id]]
    assert sum(held) >= 0.99 * len(held)


def test_op9_equals_all_pairs(spark, duck, texts):
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    got = {(r.doc_id, r.item_id): (r.passage, round(r.score, 6), r.question, r.answer) for r in queries.op9_decontaminate(spark, SF).collect()}
    want = leaks_of(texts.items(), items)
    assert got == want and len(want) > 10


def test_pipeline_equals_brute_force(spark, duck, texts):
    """The rows of run(), from its learned stage's own decisions and brute force for the rest."""
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    kept = {i: t for i, t in rows if t and any(c.isalpha() for c in t)}
    groups: dict[str, list] = {}
    for i, t in kept.items():
        groups.setdefault(normal(t), []).append((-len(t), i))
    kept = {i: kept[i] for _, i in map(min, groups.values())}
    kept = {i: kept[i] for i, (_, c) in components_of(kept.items()).items() if i == c}
    leaked = {i for i, _ in leaks_of(kept.items(), items)}
    got = corpus_pipeline.run(spark, SF).select("doc_id", "decoded_sha256").collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items() if i not in leaked}


def test_many_items_take_time_by_their_rare_words(spark):
    """8,000 items, more than are summed one by one: the planted ones are found."""
    rng = np.random.default_rng(4)
    vocab = np.array([f"w{i}" for i in range(40_000)])
    draw = lambda n: " ".join(vocab[(rng.zipf(1.3, n) - 1) % len(vocab)])
    items = [(i, f"{draw(25)}. {draw(6)}.") for i in range(8_000)]
    index = decontaminate.ItemIndex(items)
    planted = [3, 777, 7_999]
    texts = [f"{draw(200)} {items[i][1]} {draw(200)}" for i in planted] + [draw(400) for _ in range(20)]
    found = index.leaks(decontaminate.WordMemo(index.terms_of), texts)
    assert {(r[0], r[1]) for r in found if r[3] > 0.99} == set(enumerate(planted))
