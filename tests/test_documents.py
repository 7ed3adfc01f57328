"""Geometry documents: every row of the queries against plain Python, and documents with missing parts by hand."""

from __future__ import annotations

import math
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests import plain_geometry as plain
from tessera.operators import documents as D
from tessera.operators import validate as V
from tessera.plans import pose_plans as Q
from tessera.plans.common import FRAME

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
has_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def points(told):
    return [(p["x"], p["y"]) for p in told]


def geometry(row):
    return [points(row["seat_region"]), points(row["floor_line"]), points(row["backrest_region"])]


def near(got, want, within=0.0101):
    """Equal but for the last of two places: a tie is rounded by the decimal form here, and by the binary one in plain Python."""
    return got == want or (got is not None and want is not None and got == pytest.approx(want, abs=within))


@has_tables
def test_sanitize_repair_of_every_row(spark):
    told = {r.vec_id: [points(r.seat), points(r.floor), points(r.back)] for r in Q.geometries(spark, SF, loose=True).collect()}
    fine = 0
    for r in Q.sanitize_repair(spark, SF).collect():
        got, notes = plain.repair(told[r.vec_id], FRAME, FRAME)
        assert r.ok == (got is not None) and set(filter(None, r.notes.split("; "))) == set(notes), r
        if got:
            fine += 1
            assert near(r.seat_area, plain.area(got[0]), 2) and near(r.floor_y, got[1][0][1]) and near(r.back_y, got[2][0][1])
    assert 0 < fine


@pytest.fixture(scope="module")
def documents(spark):
    return {r.vec_id: r.doc.asDict(recursive=True) for r in Q.part_documents(spark, SF).collect()}


@has_tables
def test_part_geometry_of_every_row(spark, documents):
    rows = {r.vec_id: r for r in Q.part_geometry(spark, SF).collect()}
    want = {i: d for i, d in documents.items() if d["image_width"] and len(d["seat_region"]) == 4}
    assert rows.keys() == documents.keys() and len(want) < len(documents)
    for i in documents.keys() - want.keys():
        assert not rows[i].ok and rows[i].seat_area is None and rows[i].floor_y is None and rows[i].notes == Q.INCOMPLETE
    for i, d in want.items():
        got, notes = plain.from_parts(geometry(d), d["parts"], FRAME, FRAME, 0.35)
        assert rows[i].ok == (got is not None) and set(filter(None, rows[i].notes.split("; "))) == set(notes), i
        if got:
            assert near(rows[i].seat_area, plain.area(got[0]), 2) and near(rows[i].floor_y, got[1][0][1])
    assert {r.ok for r in rows.values()} == {True, False}


@has_tables
def test_geometry_recovery_of_every_row(spark, documents):
    seen = set()
    for r in Q.geometry_recovery(spark, SF).collect():
        d = documents[r.vec_id]
        w, whole = d["image_width"], len(d["seat_region"]) == 4
        g = geometry(d)
        part = plain.from_parts(g, d["parts"], FRAME, FRAME, 0.35)[0] if w and whole else None
        stage_ok = bool(w and whole and plain.is_valid(g, w, w) and r.vec_id % 2 == 0)
        scaled = bool(w and whole and w <= 200 and max(v for ps in g for p in ps for v in p) <= w + 1)
        told = g
        if w and whole and (stage_ok and w != FRAME or scaled and not stage_ok):
            told = [plain.moved(ps, w, w, FRAME, FRAME) for ps in g]
        elif not (w == FRAME and whole):
            told = None
        cleaned = plain.sanitize(told, FRAME, FRAME)[0] if told else None
        if stage_ok:
            source, use = "stage", told
        elif cleaned:
            source, use = "stage_a_output", cleaned
        elif part:
            source, use = "stage_0_part_segmentation", part
        else:
            source, use = "deterministic_fallback", plain.canonical(FRAME, FRAME)
        broken, prior = plain.issues(use, FRAME), None
        if broken:
            better = plain.repair(use, FRAME, FRAME)[0]
            prior, use = ("stage_a_prior_repair", better) if better else ("stage_0_part_segmentation", part) if part else ("deterministic_fallback", plain.canonical(FRAME, FRAME))
        assert (r.source, r.denormalised, r.prior_source, r.n_issues) == (source, bool(not stage_ok and scaled), prior, len(broken)), r
        assert near(r.seat_area, plain.area(use[0]), 2) and near(r.floor_y, use[1][0][1]) and near(r.back_y, use[2][0][1])
        seen |= {source, prior}
    assert {"stage", "stage_a_output", "deterministic_fallback", "stage_a_prior_repair", None} <= seen


@has_tables
def test_document_rescale_of_every_row(spark, documents):
    seen = set()
    for r in Q.document_rescale(spark, SF).collect():
        d = documents[r.vec_id]
        w, g, parts = d["image_width"], geometry(d), d["parts"]
        usable = lambda items, n: [i for i in (items or [])[:n] if i["line"] is not None and len(i["line"]) == 2]
        line = (parts or {}).get("legs") and parts["legs"][0]["line"]
        contact = None if not line else [*g[1], *[(x if r.vec_id % 10 != 3 else None, y) for x, y in points(line)]]
        kept = [p for p in contact or [] if p[0] is not None]
        if not w:
            assert r.width is None and not r.geometry_scaled and not r.parts_scaled and near(r.seat_y, g[0][1][1])
            continue
        assert r.width == 640 and near(r.seat_y, plain.moved(g[0], w, w, 640, 480)[1][1] if len(g[0]) == 4 else g[0][1][1])
        assert (r.n_contact if r.n_contact != -1 else None) == (len(kept) if len(kept) >= 3 else None)
        if parts:
            assert (r.n_arms, r.n_legs, r.seat_visible) == (len(usable(parts["armrests"], 2)), len(usable(parts["legs"], 8)), bool(parts["seat_visible"]))
            assert near(r.floor_confidence, plain.cut(parts["floor_confidence"] if parts["floor_confidence"] is not None else 0.0, 0, 1))
        scaled = len(g[0]) == 4 and w <= 200 and all(v <= w + 1 for ps in g for p in ps for v in p)
        assert r.geometry_scaled == scaled and near(r.geometry_floor_y, plain.moved(g[1], w, w, 640, 480)[1][1] if scaled else g[1][1][1])
        every = [p for ps in g for p in ps] + [p for k, n in (("armrests", 2), ("legs", 8)) for i in usable((parts or {}).get(k), n) for p in points(i["line"])]
        ew, eh = (max(w, math.ceil(max(p[k] for p in every)) + 1) for k in (0, 1))
        compact = len(g[0]) == 4 and not (abs(ew - 640) <= 2 and abs(eh - 480) <= 2) and ew <= 500 and eh <= 500
        assert r.parts_scaled == compact and near(r.parts_back_y, plain.moved(g[2], ew, eh, 640, 480)[1][1] if compact else g[2][1][1])
        first = (usable(parts["legs"], 8) if compact else parts["legs"]) if parts else None
        if first and first[0]["line"]:
            x, y = points(first[0]["line"])[0]
            assert near(r.leg_x, plain.moved([(x, y)], ew, eh, 640, 480)[0][0] if compact else x)
        seen.add((scaled, compact))
    assert len(seen) > 2


@has_tables
def test_parts_sanitize_of_every_row(spark, documents):
    limits = {"armrests": 2, "legs": 8}
    rows = Q.parts_sanitize(spark, SF).collect()
    assert {r.vec_id for r in rows} == documents.keys()
    for r in rows:
        d = documents[r.vec_id]
        if not d["image_width"] or len(d["seat_region"]) != 4:
            assert not r.ok and r.seat_confidence is None and r.n_arms is None and r.n_legs is None and r.notes == Q.INCOMPLETE
            continue
        clean, notes = plain.sanitize(geometry(d), FRAME, FRAME)
        notes, parts, kept = set(notes), d["parts"], {}
        if parts is None:
            notes.add("parts metadata missing, filled defaults")
        share = lambda v, default: default if v is None else round(plain.cut(v, 0, 1), 4)
        for k in ("seat_confidence", "backrest_confidence", "floor_confidence") if parts else ():
            notes |= {f"defaulted parts.{k}"} if parts[k] is None else {f"clamped parts.{k} into [0,1]"} if not 0 <= parts[k] <= 1 else set()
        notes |= {f"defaulted parts.{k}" for k in ("seat_visible", "backrest_visible", "floor_visible") if parts and parts[k] is None}
        for k, most in limits.items():
            told = (parts or {}).get(k) or []
            kept[k] = 0
            for i, item in enumerate(told[:most]):
                name = f"parts.{k}[{i}]"
                if item["line"] is None or len(item["line"]) != 2:
                    notes.add(f"dropped {name} with invalid line")
                    continue
                kept[k] += 1
                for j, (x, y) in enumerate(points(item["line"])):
                    if not (0 <= x <= FRAME - 1 and 0 <= y <= FRAME - 1):
                        notes.add(f"clamped out-of-bounds point in {name}.line[{j}]")
                if item["confidence"] is None:
                    notes.add(f"defaulted {name}.confidence")
                elif not 0 <= item["confidence"] <= 1:
                    notes.add(f"clamped {name}.confidence into [0,1]")
                if item["visible"] is None:
                    notes.add(f"defaulted {name}.visible")
            if len(told) > most:
                notes.add(f"truncated parts.{k} to {most} items")
        assert set(filter(None, r.notes.split("; "))) == notes, r.vec_id
        assert (r.n_arms, r.n_legs, r.ok) == (kept["armrests"], kept["legs"], clean is not None)
        assert near(r.seat_confidence, share(parts["seat_confidence"] if parts else None, 0.5))


def test_documents_with_missing_parts(spark):
    """Nothing fails on null documents, regions, points and numbers."""
    one = "named_struct('x', 1d, 'y', 2d)"
    cases = [
        "NULL",
        "named_struct('image_width', 10, 'image_height', NULL, 'seat_region', NULL, 'floor_line', array(NULL), 'backrest_region', array(), 'parts', NULL)",
        f"named_struct('image_width', 10, 'image_height', 10, 'seat_region', array({one}, {one}, {one}, named_struct('x', NULL, 'y', 2d)), 'floor_line', array({one}, {one}), 'backrest_region', array({one}, {one}), 'parts', named_struct('seat_confidence', double('nan'), 'backrest_confidence', 3d, 'floor_confidence', NULL, 'seat_visible', NULL, 'backrest_visible', true, 'floor_visible', true, 'armrests', array(NULL, named_struct('line', NULL, 'confidence', NULL, 'visible', NULL)), 'legs', NULL))",
    ]
    df = spark.createDataFrame([(i,) for i in range(len(cases))], "i int")
    doc = F.expr(f"CASE {' '.join(f'WHEN i = {i} THEN cast({c} AS {D.PART_DOCUMENT})' for i, c in enumerate(cases))} END")
    df = df.select("i", doc.alias("d"))
    geometry_of = F.struct(*[F.col(f"d.{k}") for k in ("image_width", "image_height", "seat_region", "floor_line", "backrest_region")], F.lit(None).alias("seat_contact_region")).cast(D.GEOMETRY)
    rows = df.select("i", D.rescale_parts(F.col("d"), 20, 20).alias("p"), D.denormalise_parts(F.col("d"), 20, 20).alias("q"), D.rescale_geometry(geometry_of, 20, 20).alias("g"), D.denormalise_geometry(geometry_of, 20, 20).alias("h")).orderBy("i").collect()
    assert not any(r.q.scaled or r.h.scaled for r in rows)
    assert rows[0].p is None and rows[1].p.image_width == 10 and rows[2].p.image_width == 20
    told = rows[2].p.parts
    assert (told.seat_confidence, told.backrest_confidence, told.floor_confidence, told.seat_visible, told.armrests, told.legs) == (0.0, 1.0, 0.0, False, [], [])


def test_pose_errors_of_nulls(spark):
    """What is not there is an error, as a number that is not one is."""
    kind = "map<string,struct<x:double,y:double,confidence:double,visible:boolean>>"
    cases = [
        ("NULL", ["image_width mismatch", "keypoints must be an object"]),
        ("map('hip', NULL)", ["image_width mismatch", "missing keypoint: knee", "hip must be an object"]),
        ("map('hip', named_struct('x', NULL, 'y', 1d, 'confidence', NULL, 'visible', NULL), 'knee', named_struct('x', double('nan'), 'y', -1d, 'confidence', 2d, 'visible', true))",
         ["image_width mismatch", "hip.x and hip.y must be numeric", "hip.confidence must be numeric", "hip.visible must be boolean", "knee.x and knee.y must be numeric", "knee.confidence out of range"]),
    ]
    for told, want in cases:
        df = spark.range(1).select(F.expr(f"cast({told} AS {kind})").alias("k"), F.lit(None).cast("int").alias("w"))
        assert df.select(V.pose_errors(F.col("k"), F.col("w"), F.lit(5), 5, 5, ["hip", "knee"]).alias("e")).first().e == want


def test_rejections_in_order(spark):
    point = lambda x, y: f"named_struct('x', {x}d, 'y', {y}d)"
    good = f"array({point(60, 110)}, {point(160, 110)}, {point(160, 150)}, {point(60, 150)})"
    cases = [("false", "true", good, ["invalid_json"]), ("NULL", "true", good, ["invalid_json"]), ("true", "false", good, ["schema_invalid"]), ("true", "true", "NULL", ["empty_polygon"]), ("true", "true", "array()", ["empty_polygon"]), ("true", "true", good, [])]
    for valid, schema, polygon, want in cases:
        row = spark.range(1).select(V.prediction_rejections(F.expr(f"cast({valid} AS boolean)"), F.expr(schema), F.expr(f"cast({polygon} AS array<struct<x:double,y:double>>)"), 224, 224).alias("e")).first()
        assert row.e == want


def plain_seat(chair):
    """seat_geometry() by rows of sets."""
    ys = [y for y in range(chair.shape[0]) if chair[y].any()]
    if not ys:
        return None
    tall, wide, y0, h = chair.shape[0], chair.shape[1], ys[0], ys[-1] - ys[0] + 1
    row = {y - y0: [x for x in range(wide) if chair[y, x]] for y in range(ys[0], ys[-1] + 1)}
    xs = [x for r in row.values() for x in r]
    cut = plain.cut

    def ends(r):
        r = int(cut(r, 0, h - 1))
        for d in range(max(8, h // 6) + 1):
            for at in (r - d, r + d):
                if row.get(at):
                    return row[at][0], row[at][-1]
        return min(xs), max(xs)

    low, high = int(0.30 * h), int(0.82 * h)
    low, high = (0, h) if high <= low else (low, high)
    peak = max(range(low, high), key=lambda r: (len(row[r]), -r))
    drop = next((r for r in range(peak, h) if len(row[r]) < max(5, int(0.55 * max(1, len(row[peak]))))), int(cut(0.78 * h, 0, h - 1)))
    bottom = int(cut(drop - int(0.02 * h), int(0.46 * h), int(0.90 * h)))
    top = max(int(0.18 * h), bottom - int(cut(int(0.15 * h), max(6, int(0.07 * h)), max(10, int(0.24 * h)))))
    if top >= bottom:
        top = max(0, bottom - max(6, int(0.07 * h)))
    a, b = ends(int((top + bottom) * 0.5))
    a, b = (min(xs), max(xs)) if b <= a else (a, b)
    m = max(2, int(0.11 * max(12, b - a)))
    sx0 = int(cut(a + m, 0, wide - 1))
    sx1 = max(int(min(b - m, wide - 1)), sx0 + 2)
    back = max(int(0.08 * h), top - max(8, int(0.18 * h)))
    a, b = ends(back)
    a, b = (sx0, sx1) if b <= a else (a, b)
    m = max(2, int(0.08 * max(1, b - a)))
    bx0 = int(cut(a + m, 0, wide - 1))
    bx1 = max(int(min(b - m, wide - 1)), bx0 + 2)
    floor = min(max(ys[-1] + int(0.06 * tall), y0 + bottom + int(0.12 * tall)), tall - 1)
    fx0 = int(cut(sx0 - 0.65 * (sx1 - sx0), 0, wide - 1))
    fx1 = max(int(min(sx1 + 0.65 * (sx1 - sx0), wide - 1)), fx0 + 2)
    up, lo = y0 + top, y0 + bottom
    return {"seat": [(sx0, up), (sx1, up), (sx1, lo), (sx0, lo)], "floor": [(fx0, floor), (fx1, floor)], "back": [(bx0, y0 + back), (bx1, y0 + back)]}


@pytest.mark.parametrize("shape", [(60, 70), (90, 33), (9, 12)])
def test_seat_geometry_of_masks(spark, shape):
    """Seat bands against rows of sets, and each later step of the plan against the same step on a boolean grid."""
    import numpy as np

    from tessera.functions.arrays import fixed
    from tessera.operators import raster as R
    from tessera.operators import seat as S
    from tessera.operators.widemask import Grid

    rng, grid = np.random.default_rng(5), Grid(*shape)
    chairs = [R.fill(rng.random((6, 2)) * (shape[1], shape[0]), *shape) & (rng.random(shape) < (0.8 if k % 3 else 1)) for k in range(30)]
    chairs.append(np.zeros(shape, bool))
    df = spark.createDataFrame([(k, S.packed(c)) for k, c in enumerate(chairs)], "k int, chair array<bigint>")
    df = fixed(S.contact_rows(S.seat_bands(df, "chair", grid), "chair", grid), "axis", S.seat_axis(F.col("seat"), F.col("back")))
    df = df.withColumn("traced", S.traced(F.col("area"), F.col("axis"), grid))
    for r in df.withColumn("polygon", S.contact_polygon(F.col("traced.ring"), F.col("seat"), grid)).collect():
        chair, want = chairs[r.k], plain_seat(chairs[r.k])
        got = {name: [tuple(p) for p in r[name]] for name in ("seat", "floor", "back")} if r.seat is not None else None
        assert got == want
        if want is None:
            assert r.area is None and r.traced.n is None
            continue
        area, found = np.zeros(shape, bool), 0
        for y in range(want["seat"][0][1], min(want["seat"][2][1], shape[0] - 1) + 1):
            xs = np.flatnonzero(chair[y])
            if len(xs) >= 4:
                left, right = (int(v) for v in np.percentile(xs, (1.5, 98.5)))
                if right > left:
                    m = max(1, int(0.025 * (right - left + 1)))
                    left, found = min(left + m, shape[1] - 1), found + 1
                    area[y, left : max(min(right - m, shape[1] - 1), left + 2) + 1] = True
        if found < 8:
            area[want["seat"][0][1] : want["seat"][2][1] + 1, want["seat"][0][0] : want["seat"][1][0] + 1] = True
        used = np.flatnonzero(chair.any(axis=1))
        k = max(3, int(0.012 * (used[-1] - used[0] + 1))) // 2 * 2 + 1
        area = R.open_(R.close(area, k), 3)
        assert (S.unpacked(r.area, grid) == area).all()
        sides = [tuple(np.mean([want["seat"][i], want["seat"][(i + 1) % 4]], axis=0)) for i in range(4)]
        middle = np.mean(want["back"], axis=0)
        back, front = tuple(r.axis.back), tuple(r.axis.front)
        assert math.dist(back, middle) == min(math.dist(s, middle) for s in sides) and front == sides[(sides.index(back) + 2) % 4]
        assert r.traced.n == R.trim_depth(R.largest_component(area), back, front).sum() and len(r.polygon) >= 3


def test_resized_masks():
    import numpy as np

    from tessera.operators import raster as R

    mask = np.random.default_rng(1).random((7, 5)) < 0.5
    for h, w in ((7, 5), (14, 10), (3, 2), (1, 1), (20, 3)):
        assert (R.resized(mask, h, w) == [[mask[y * 7 // h, x * 5 // w] for x in range(w)] for y in range(h)]).all()


def test_seat_geometry_sends_small_batches_to_python(spark):
    """A worker that follows borders holds some megabytes of masks at a time, not 10,000 rows of them."""
    from tessera.plans.mask_plans import mask_seat_geometry

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(1 << 30))
    try:
        mask_seat_geometry(spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(name)) <= 4 << 20
    finally:
        spark.conf.set(name, before)
