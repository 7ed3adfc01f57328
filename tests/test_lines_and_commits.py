"""Line numbers of files that are read in splits, and sinks that commit as a whole."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chat as C
from tessera.operators import targets as TG
from tessera.sources import readers, writers

TASK = X.TASKS[None, None]


def chat_line(k):
    target = {"task": TASK, "image_size": {"width": 100, "height": 100}, "seat_contact_polygon": [{"x": 1, "y": 2}, {"x": 9, "y": 2}, {"x": 5, "y": 200 if k % 11 == 0 else 8}]}
    messages = [{"role": "user", "content": [{"type": "text", "text": "where?"}]}, {"role": "assistant", "content": [{"type": "text", "text": json.dumps(target)}]}]
    return json.dumps({"id": str(k), "images": [f"{k % 10}.png"], "messages": messages, "meta": {}})


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_of_split_files(spark, tmp_path, small_splits):
    """Files much larger than a split, with blank lines, lines that are no JSON, arrays and numbers: each error has its file and line."""
    want = {}
    for name, n in (("a", 900), ("b", 7), ("empty", 0)):
        lines = [chat_line(k) for k in range(n)]
        for k in range(0, n, 50):
            lines[k] = ("", "   ", "{broken", "[1, 2]", "17", '{"images": "text"}')[k // 50 % 6]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n" * bool(lines))
        for k, line in enumerate(lines):
            if line.strip():
                bad = not line.startswith("{") or line.startswith("{broken") or "text\"}" in line[-8:]
                error = "invalid JSON" if bad else "image does not exist" if k % 10 == 3 else "point out of image boundary" if k % 11 == 0 else None
                want[f"{name}.jsonl", k + 1] = error
    rows = readers.chat_lines(spark, str(tmp_path))
    assert rows.select(F.spark_partition_id()).distinct().count() > 5
    images = spark.createDataFrame([(f"{k}.png",) for k in range(10) if k != 3], "path string")
    lines = TG.checked_lines(rows, images, TASK, "polygon", 3)
    assert {(Path(r.file).name, r.lineno): r.error for r in lines.collect()} == want
    for r in C.file_report(lines).collect():
        own = {k[1]: e for k, e in want.items() if k[0] == Path(r.file).name}
        assert (r.n_lines, r.n_bad) == (len(own), sum(e is not None for e in own.values()))
        assert [e.lineno for e in r.errors] == sorted(k for k, e in own.items() if e)[:20]


def files_of(folder):
    return {p.name: p.read_text() for p in Path(folder).iterdir()} if Path(folder).exists() else None


def test_label_texts_commit_as_a_whole(spark, tmp_path):
    out, kind = str(tmp_path / "labels"), "sample_id string, text string"
    first = spark.createDataFrame([("a", "0 0.1"), ("b", None)], kind)
    assert writers.write_label_texts(first, out) == 2 and files_of(out) == {"a.txt": "0 0.1", "b.txt": ""}
    # a later task fails when others have written their files: the old ones stay, and nothing else is left
    many = spark.range(40).repartition(8).selectExpr("CAST(id AS STRING) AS sample_id", "CASE WHEN id = 33 THEN raise_error('lost') ELSE 'new' END AS text")
    with pytest.raises(Exception, match="lost"):
        writers.write_label_texts(many, out)
    assert files_of(out) == {"a.txt": "0 0.1", "b.txt": ""} and [p.name for p in tmp_path.iterdir()] == ["labels"]
    for name in ("../x", "", "a/b", "..", None):
        with pytest.raises(Exception, match="no name of a file"):
            writers.write_label_texts(spark.createDataFrame([("ok", "1"), (name, "2")], kind), out)
        assert files_of(out) == {"a.txt": "0 0.1", "b.txt": ""} and [p.name for p in tmp_path.iterdir()] == ["labels"]
    assert writers.write_label_texts(spark.createDataFrame([("b", "again"), ("c", "3")], kind), out, overwrite=False) == 2
    assert files_of(out) == {"a.txt": "0 0.1", "b.txt": "again", "c.txt": "3"}
    assert writers.write_label_texts(spark.createDataFrame([("d", "4")], kind), f"file://{out}") == 1 and files_of(out) == {"d.txt": "4"}
    assert writers.write_label_texts(first.where("false"), out) == 0 and files_of(out) == {}


def test_folders_are_replaced_when_the_job_is_done(spark, tmp_path):
    out = str(tmp_path / "results")
    writers.write_results(spark.createDataFrame([(1, None)], "a int, b string"), out)
    read = lambda: sorted(r.value for r in spark.read.text(out).collect())
    assert read() == ['{"a":1,"b":null}']
    with pytest.raises(Exception, match="lost"):
        writers.write_results(spark.range(20).repartition(4).selectExpr("CASE WHEN id = 13 THEN raise_error('lost') ELSE id END AS a"), out)
    assert read() == ['{"a":1,"b":null}'] and [p.name for p in tmp_path.iterdir()] == ["results"]
    writers.write_results(spark.createDataFrame([(2, "x")], "a int, b string"), out)
    assert read() == ['{"a":2,"b":"x"}'] and [p.name for p in tmp_path.iterdir()] == ["results"]
