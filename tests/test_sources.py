"""Image headers by expressions, label files, settings, lines against images, summaries, serialised values, percentiles, gates, deep JSON."""

from __future__ import annotations

import base64
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import jsonx
from tessera.functions import text as X
from tessera.operators import chat as C
from tessera.operators import metrics as M
from tessera.operators import targets as TG
from tessera.sources import readers, writers


def test_image_size_equals_header_size(spark):
    jpeg = lambda extra: b"\xff\xd8" + extra + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\0" * 12
    told = [
        b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480), b"\x89PNG\r\n\x1a\n\0\0", b"GIF89a" + struct.pack("<HH", 700, 9), b"GIF87a" + struct.pack("<HH", 1, 65535), b"GIF89a\0",
        b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -600), b"BM" + b"\0" * 16 + struct.pack("<ii", -70000, 3), b"BM", jpeg(b"\xff\xe0\x00\x04ab"), jpeg(b"\xff\xe1\xff\xf0" + b"x" * 0xFFEE), b"\xff\xd8\x00", b"\xff\xd8", b"?", b"", None,
    ]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(told)], "i int, c binary").select("i", readers.image_size(F.col("c")).alias("s")).collect()
    assert {r.i: r.s and tuple(r.s) for r in rows} == {i: c and readers.header_size(c) or None for i, c in enumerate(told)}


def test_label_files(spark, tmp_path):
    texts = spark.createDataFrame([(f"s{i}", f"0 0.5 {i}" if i % 3 else None) for i in range(30)], "sample_id string, text string").repartition(4)
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "old.txt").write_text("x")
    for _ in range(2):
        assert writers.write_label_texts(texts, str(tmp_path / "labels")) == 30
        assert {p.name: p.read_text() for p in (tmp_path / "labels").iterdir()} == {f"s{i}.txt": f"0 0.5 {i}" if i % 3 else "" for i in range(30)}
    assert writers.write_label_texts(texts.where("false"), str(tmp_path / "none")) == 0


def test_results_and_exit_code(spark):
    rows = spark.createDataFrame([("a", "ok"), ("b", "failed")], "id string, status string")
    assert [writers.exit_code(r) for r in (rows, rows.where("id = 'a'"), rows.where("false"))] == [2, 0, 2]


def test_settings_from_the_environment():
    env = {"TESSERA_MIN_AREA": "3.5", "TESSERA_GATE_STEPS": " 5, 15 ,", "TESSERA_TARGET_SHAPE": "bbox", "TESSERA_COORD_MODE": "grid", "TESSERA_GRID": "", "OTHER_GRID": "9"}
    got = readers.Config.from_environment(env=env, points=7)
    assert (got.min_area, got.gate_steps, got.target_shape, got.grid, got.points) == (3.5, (5, 15), "bbox", 16, 7)
    for wrong in ({"coord_mode": "grid"}, {"target_shape": "circle"}, {"gate_steps": ()}, {"gate_steps": (3, 3)}, {"grid": 1}):
        with pytest.raises(ValueError):
            readers.Config(**wrong)


def test_lines_against_images(spark):
    good = '{"task":"t","image_size":{"width":10,"height":10},"seat_contact_box":{"x_min":1,"y_min":1,"x_max":5,"y_max":5}}'
    told = lambda text: [("system", [("text", "s")]), ("assistant", [("text", text)])]
    cases = [
        (["a.png"], told(good), None), (None, told(good), "images missing"), ([], told(good), "images missing"), (["a.png"], [], "messages missing"), (["a.png"], None, "messages missing"), (["b.png"], told(good), "image does not exist"),
        ([None], told(good), "image does not exist"), (["a.png"], [("user", [("text", good)])], "assistant message missing"), (["a.png"], told("{"), "assistant target must be a JSON object"), (["a.png"], told(good.replace('"t"', '"u"')), "task must be t"),
        (["a.png"], told(good.replace('"x_max":5', '"x_max":0.5')), "seat_contact_box must satisfy x_max>x_min and y_max>y_min"),
    ]
    rows = spark.createDataFrame([("f", i, im, ms) for i, (im, ms, _) in enumerate(cases)], f"file string, lineno int, images array<string>, messages {C.MESSAGES}")
    images = spark.createDataFrame([("a.png",), ("a.png",)], "path string")
    got = {r.lineno: r.error for r in TG.checked_lines(rows, images, "t", "bbox").collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(cases)}


def test_targets_that_have_no_shape(spark):
    square = [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)]
    df = spark.createDataFrame([(0, square), (1, square[:2]), (2, [(1.0, 1.0)] * 5), (3, [(0.0, 0.0), (4.0, 4.0), (8.0, 8.0), (2.0, 2.0)]), (4, None)], "i int, p array<struct<x:double,y:double>>")
    got = {shape: {r.i: (r.target_count, [(p.x, p.y) for p in r.target]) for r in TG.in_shape(df, "p", shape, 8, 8, 4).collect()} for shape in ("bbox", "quad", "polygon")}
    assert got["bbox"][0] == (4, [(0.0, 0.0), (7.0, 7.0)]) and got["quad"][0][0] == got["polygon"][0][0] == 4
    assert all(got[s][i] == (0, []) for s in got for i in (1, 4)) and got["quad"][2][0] == got["polygon"][2][0] == 0 and got["bbox"][3][0] == 4


def test_summary_and_serialised_values(spark):
    rows = spark.createDataFrame([("b", ["x.png"]), ("a", None), ("c", [])], "id string, images array<string>")
    assert tuple(C.dataset_summary(rows).first()) == (3, ["id", "images"], "a", "")
    assert tuple(C.dataset_summary(rows.where("id = 'b'")).first()) == (1, ["id", "images"], "b", "x.png")
    assert tuple(C.dataset_summary(rows.where("false")).first()) == (0, None, "", "")
    df = spark.sql("SELECT 1 AS i, 2.5d AS d, true AS b, 's' AS s, DATE '2024-01-02' AS t, array(1, null) AS a, map('k', named_struct('x', cast(null AS int))) AS m, cast(1.50 AS decimal(5,2)) AS c, cast(null AS date) AS n")
    assert tuple(df.select(*[X.serialised(df, c).alias(c) for c in df.columns]).first()) == (1, 2.5, True, "s", "2024-01-02", "[1,null]", '{"k":{"x":null}}', "1.50", None)


def test_last_by_version(spark):
    df = spark.createDataFrame([("g", "run-9"), ("g", "run-10"), ("g", "run"), ("h", "b"), ("h", "a"), ("i", "x-1"), ("i", "y-1")], "g string, p string")
    assert {r.g: (r.p, r.version) for r in X.last_by_version(df, ["g"], "p").collect()} == {"g": ("run-10", 10), "h": ("b", -1), "i": ("y-1", 1)}


@pytest.mark.parametrize("most", [40, 1 << 16])
def test_exact_percentiles(spark, most):
    rng = np.random.default_rng(most)
    groups = {"a": rng.normal(size=301), "b": np.round(rng.exponential(size=200), 1), "c": np.array([4.0]), "d": np.full(50, 2.0), None: rng.random(10) ** 9, "e": np.array([])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("e", None), ("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.p, r.q, r.r) for r in M.exact_percentiles(df, ["g"], "v", {"p": 0.015, "q": 0.5, "r": 1.0}, most).collect()}
    assert got.keys() == groups.keys() - {"e"}
    for g, found in got.items():
        assert found == pytest.approx(np.quantile(groups[g], [0.015, 0.5, 1.0]))
    whole = M.exact_percentiles(df, [], "v", {"q": 0.5}, most).first()
    assert whole.q == pytest.approx(np.median(np.concatenate(list(groups.values()))))
    assert M.exact_percentiles(df.where("false"), ["g"], "v", {"q": 0.5}).count() == 0


def test_percentiles_with_an_outlier(spark):
    """One value far off, a fifth of equal ones and a long tail: rounds of narrowing leave few values to put in order, and the result is exact."""
    v = F.when(F.col("id") == 7, 1e300).when(F.col("id") % 5 == 0, F.lit(0.25)).otherwise((F.xxhash64("id") / 2.0**63) ** 9)
    df = spark.range(60001).select((F.col("id") % 2).alias("k"), v.alias("v"))
    held = df.toPandas()
    told = df.select(F.struct("k").alias("g"), "v")
    wanted = told.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).selectExpr("g", "CAST(15000 AS LONG) AS r", "n", "low", "high", "0L AS before", "n AS held")
    assert all(r.held < 1000 or r.low == r.high for r in M._narrowed(told, wanted).collect())
    got = {r.k: (r.a, r.b) for r in M.exact_percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.985}, 2000).collect()}
    for k, g in held.groupby("k"):
        assert got[k] == pytest.approx(np.percentile(g.v, [50, 98.5]), rel=1e-12)


def test_gate_runs(spark):
    """Passes at a step, after an extension, after a retry, not at all, or fails to train."""
    good, bad = (0.9, 0.9, 0.0, 0.5, 0.5), (0.9, 0.9, 0.5, 0.5, 0.5)
    told = {"first": {10: (good, [True])}, "retry": {10: (bad, [False, True]), 20: (good, [True])}, "extended": {10: (bad, [True]), 20: (bad, [True]), 35: (good, [True])}, "never": {s: (bad, [True]) for s in (10, 20, 35, 50)}, "broken": {10: (bad, [True]), 20: (good, [False, False, True])}, "silent": {}}
    names = [n for n, _, _ in M.GATE]
    metrics = spark.createDataFrame([(r, s, *m) for r, steps in told.items() for s, (m, _) in steps.items()], "run string, step int, " + ", ".join(f"{n} double" for n in ("valid_json_rate", "schema_valid_rate", "placeholder_rate", "mean_iou_schema_valid_only", "mean_iou_all")))
    assert set(names) <= set(metrics.columns)
    attempts = spark.createDataFrame([(r, s, i + 1, t) for r, steps in told.items() for s, (_, ts) in steps.items() for i, t in enumerate(ts)] + [("silent", 99, 1, True)], "run string, step int, attempt int, trained boolean")
    got = {r.run: tuple(r)[1:] for r in M.gate_runs(metrics, attempts, [10, 20], 15, 50, 1).collect()}
    assert got == {
        "first": ("passed", 10, 1, 1, None), "retry": ("passed", 20, 2, 3, 10), "extended": ("passed", 35, 3, 3, 20), "never": ("exhausted", None, 4, 4, 50),
        "broken": ("failed", None, 1, 3, 10), "silent": ("failed", None, 0, 0, None),
    }


def test_deep_json_is_no_object(spark):
    deep = "[" * 100_000
    nested = '{"a":' * 50_000
    wanted = '{"task": 1, "image_size": 2, "t": 3}'
    assert jsonx.last_object(deep) is None and jsonx.last_object(nested) is None and jsonx.best_object(deep, "t") is None and jsonx.best_object(nested, "t") is None
    assert jsonx.best_object(f"{deep} {wanted}", "t") == {"task": 1, "image_size": 2, "t": 3} and jsonx.last_object(f"{deep} {wanted}")["t"] == 3
    row = spark.createDataFrame([(deep,), (nested,)], "t string").select(jsonx.recovered(F.col("t"), "t", "seat_contact_box").alias("r")).collect()
    assert not any(r.r.valid_json for r in row)


def test_lenient_number_equals_python(spark):
    import json

    texts = ["1", "-2.5", "1e3", "01", "+1", ".5", "1.", "NaN", "Infinity", "1e999", "true", "null", '"12px"', '" 1,024 px "', '"+3.5"', '".5"', '"5."', '"1e2"', '"nan"', '"inf"', '"px"', '""', '"1 2"', '"1_000"', '"0x10"', "[1]", '{"a":1}', "", " 7 ", '"12', None]
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", jsonx.lenient_number(F.col("t")).alias("n")).collect()}

    def plain(t):
        try:
            return None if t is None else jsonx.number(json.loads(t))
        except ValueError:
            return None

    assert got == {t: plain(t) for t in texts}


def test_documents_lines_and_payloads(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"id":"a","images":["x.png"],"messages":[{"role":"user","content":[{"type":"text","text":"hi"}]}]}\n\n{"id":"b"}\n')
    assert [(r.id, r.images) for r in readers.chat_lines(spark, str(tmp_path / "rows.jsonl")).collect()] == [("a", ["x.png"]), ("b", None)]
    (tmp_path / "doc.json").write_text('{"a": {"b": 2}}')
    (tmp_path / "bad.json").write_text("{oops")
    assert readers.json_document(spark, str(tmp_path / "doc.json"), "a struct<b:int>").first().a.b == 2
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        readers.json_document(spark, str(tmp_path / "bad.json"), "a int").collect()
    folder = tmp_path / "images"
    folder.mkdir()
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 2000, 500)
    (folder / "a.png").write_bytes(png)
    (folder / "b.jpg").write_bytes(b"?")
    rows = {r.path.rsplit("/", 1)[1]: r for r in readers.image_payload(spark, str(folder), 1000).collect()}
    a, b = rows["a.png"], rows["b.jpg"]
    assert base64.b64decode(a.data) == png and (a.media, a.width, a.height, a.fitted_width, a.fitted_height, a.to_resize) == ("image/png", 2000, 500, 1000, 250, True)
    assert (b.media, b.width, b.fitted_width) == ("image/jpeg", None, None)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train", None), ("b", "val", "x")], "id string, split string, note string")
    for _ in range(2):
        writers.write_chat(rows, str(tmp_path / "chat"))
    lines = [p.read_text().strip() for p in sorted((tmp_path / "chat" / "split=train").glob("*.json"))]
    assert lines == ['{"id":"a","note":null}'] and spark.read.json(str(tmp_path / "chat")).count() == 2
    writers.write_results(rows, str(tmp_path / "results"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "results")).collect()) == ['{"id":"a","split":"train","note":null}', '{"id":"b","split":"val","note":"x"}']
    writers.write_report(rows, str(tmp_path / "report"), "split", seed=1)
    assert spark.read.text(str(tmp_path / "report")).first().value == '{"total":2,"counts":{"train":1,"val":1},"settings":{"seed":1}}'
    for frame in (rows, rows.limit(1)):
        writers.write_if_absent(frame, str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 2
    assert writers.dataset_description("/d", ["seat", "back"]).splitlines() == ["path: /d", "train: images/train", "val: images/val", "test: images/test", "names:", "  0: seat", "  1: back"]
