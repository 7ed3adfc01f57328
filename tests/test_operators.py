"""Relational operators, JSON recovery, chat rows, rasters, sources and sinks."""

from __future__ import annotations

import json
import math
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import jsonx
from tessera.functions import text as X
from tessera.functions.arrays import fixed
from tessera.functions.hull import convex_hull, hull_of
from tessera.operators import chat as C
from tessera.operators import metrics as M
from tessera.operators import pose
from tessera.operators import raster as R
from tessera.operators import relational as Rel
from tessera.operators import seat as S
from tessera.operators import widemask as W
from tessera.operators.fusion import any_of
from tessera.sources import readers, writers
from tessera.streaming import arrivals


def test_split_rounds_half_even(spark):
    for n, want in ((10, {"train": 8, "val": 1, "test": 1}), (5, {"train": 4, "test": 1}), (0, {})):
        rows = Rel.assign_split(spark.range(n).withColumnRenamed("id", "k"), "k").groupBy("split").count().collect()
        assert {r["split"]: r["count"] for r in rows} == want


def test_positions_keep_rows_with_null_keys(spark):
    df = spark.createDataFrame([(None,), (1,), (2,), (2,)], "k long")
    assert Rel.assign_split(df, "k").count() == 4
    assert Rel.stride_sample(df, Rel.range_block(df, "k", 2), [F.col("k")], 9).count() == 4


def test_keep_one_last_and_first(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 0, 3)], "k string, r int, v int")
    last = {r.k: (r.v, r.n) for r in Rel.keep_one(df, "k", [F.col("r")], True).collect()}
    first = {r.k: (r.v, r.n) for r in Rel.keep_one(df, "k", [F.col("r")], False).collect()}
    assert last == {"a": (2, 2), "b": (3, 1)} and first == {"a": (1, 2), "b": (3, 1)}


def test_first_match_and_unmatched(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    right = spark.createDataFrame([("a", ".png", 2), ("a", ".jpg", 1), ("b", ".bmp", 4)], "stem string, ext string, r int")
    got = {r.stem: r.ext for r in Rel.first_match(left, right, "stem", F.col("r"), "ext").collect()}
    assert got == {"a": ".jpg", "b": ".bmp"} and [r.stem for r in Rel.unmatched(left, right, "stem").collect()] == ["c"]


@pytest.mark.parametrize(("n", "most"), [(5, 2), (100, 7), (101, 10), (3, 9), (1000, 999)])
def test_stride_sample_matches_plain_python(spark, n, most):
    df = spark.range(n)
    got = sorted(r.id for r in Rel.stride_sample(df, Rel.range_block(df, "id", 4), [F.col("id")], most).collect())
    want = list(range(n)) if n <= most else sorted({min(round(i * n / most), n - 1) for i in range(most)})
    assert got == want


def test_metrics(spark):
    rows = spark.createDataFrame([(True, True, False, x) for x in (1.0, 2.0, 4.0, 10.0)] + [(False, False, True, 0.0)], "valid_json boolean, schema_valid boolean, placeholder boolean, iou double")
    row = M.evaluation_summary(rows).first()
    assert row.median_iou_schema_valid_only == 3.0 and row.valid_json_rate == 0.8 and row.mean_iou_all == 3.4
    none = M.evaluation_summary(rows.where("iou > 100")).first()
    assert none.num_samples == 0 and none.mean_iou_all == 0.0
    told = dict(valid_json_rate=0.5556, schema_valid_rate=0.5, placeholder_rate=0.0, mean_iou_all=0.0935, mean_iou_schema_valid_only=0.1871)
    one = spark.createDataFrame([tuple(told.values())], ",".join(f"{k} double" for k in told))
    got = one.select(M.selection_score().alias("s"), M.first_gate_failure().alias("f")).first()
    assert got.s == pytest.approx(0.218095) and got.f == "valid_json_rate < 0.80"


def test_json_recovery():
    assert jsonx.last_object('x {"a":1} y {"b":2}') == {"b": 2}
    assert jsonx.best_object('x {"a":1} y {"b":2}', "seat_contact_box") is None
    assert jsonx.last_object("{'a': 1}") is None
    assert jsonx.last_object('```json\n{"a": "}{"}\n```') == {"a": "}{"}
    assert jsonx.last_object('{"a": 1') is None and jsonx.last_object("") is None
    assert jsonx.best_object('{"any": 1}', "t") == {"any": 1}
    assert jsonx.best_object('no {"task": 1, "t": {"task": 2, "image_size": 3, "t": 4}} x', "t")["t"] == 4
    assert [jsonx.number(v) for v in ("1,024px", True, " ", "nan", 0.4, None)] == [1024.0, None, None, None, 0.4, None]
    assert [jsonx.positive_int(v) for v in (0.4, "2.5", -3, "3.5px")] == [None, 2, None, 4]
    good = {"task": "t", "image_size": {"width": 10, "height": "10"}, "seat_contact_box": {"x_min": 1, "y_min": 1, "x_max": 99, "y_max": "5px"}}
    assert jsonx.matches_schema(good, "t", "seat_contact_box") and not jsonx.matches_schema(good | {"more": 1}, "t", "seat_contact_box")
    assert jsonx.box_of(good["seat_contact_box"], 10, 10) == (1.0, 1.0, 9.0, 5.0)


def test_recovered_column(spark):
    df = spark.createDataFrame([('{"task": 1}',), ("nothing",), (None,)], "t string")
    rows = df.select(jsonx.recovered(F.col("t"), "t", "seat_contact_box").alias("r")).collect()
    assert [(r.r.valid_json, r.r.schema_valid, r.r.last) for r in rows] == [(True, False, '{"task":1}'), (False, False, None), (False, False, None)]


@pytest.mark.parametrize(("roles", "n"), [("sua", 2), ("a", 1), ("au", 1), ("su", 1), ("sus", 2), ("u", 1)])
def test_prompt_completion(spark, roles, n):
    names = {"s": "system", "u": "user", "a": "assistant"}
    turns = spark.createDataFrame([(1, i, names[c], c) for i, c in enumerate(roles)], "conv_id long, turn long, role string, text string")
    row = C.conversation_rows(turns).select(C.prompt_of(F.col("messages")).alias("p"), C.completion_of(F.col("messages")).alias("c")).first()
    assert len(row.p) == n and len(row.c) == max(1, len(roles) - n)


def test_text_functions(spark):
    df = spark.createDataFrame([("a/b/c.v2.PNG", "4, x, 10,-1, 7"), ("/x/run-12/", "")], "p string, s string")
    rows = df.select(X.stem(F.col("p")), X.suffix(F.col("p")), X.media_type(F.col("p")), X.version_number(F.col("p")), X.schedule(F.col("s"))).collect()
    assert tuple(rows[0]) == ("c.v2", ".png", "image/png", 2, [4, 10, 7]) and tuple(rows[1])[0] == "run-12" and rows[1][3] == 12 and rows[1][4] == []


def test_raster_components_and_morphology():
    rng = np.random.default_rng(1)
    for _ in range(60):
        mask = rng.random((9, 11)) < 0.45
        labels = R.components(mask)
        todo, count = {tuple(p) for p in np.argwhere(mask).tolist()}, 0
        while todo:  # flood fill
            stack, own = [min(todo)], set()
            while stack:
                y, x = stack.pop()
                if (y, x) in todo:
                    todo.discard((y, x))
                    own.add((y, x))
                    stack += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
            count += 1
            assert {int(labels[p]) for p in own} == {count}
        assert labels.max(initial=0) == count
        assert not (R.open_(mask, 3) & ~mask).any() and not (mask & ~R.close(mask, 3)).any()
        assert (R.erode(mask, 3) == ~R.dilate(~mask, 3)).all()


def test_raster_shapes():
    square = np.array([(2, 2), (8, 2), (8, 8), (2, 8)], float)
    mask = R.fill(square, 12, 12)
    assert mask.sum() == 36 and R.bbox(mask) == (2, 2, 7, 7) and R.fill(square[:2], 12, 12).sum() == 0
    assert (R.hull_mask(mask) == mask).all() and R.edge_distance(mask)[4, 4] == 3
    assert len(R.outline(mask)) == 4 and len(R.outline(np.zeros((3, 3), bool))) == 0
    clipped = R.clip_polygon(square, 0, 0, 5, 5)
    assert {tuple(p) for p in clipped.tolist()} == {(2, 2), (5, 2), (5, 5), (2, 5)} and len(R.clip_polygon(square, 20, 20, 30, 30)) == 0
    assert R.hip_zone(np.ones((30, 30), bool)).any() and not R.hip_zone(np.zeros((30, 30), bool)).any()
    mask = R.fill(square + 8, 28, 28)
    for f in (lambda m: R.trim_sides(m, 0.1, 1), lambda m: R.trim_rows(m, 0.68, 1), R.seat_prior, lambda m: R.front_style(m, 0.5)):
        assert not (f(mask) & ~mask).any() and not f(np.zeros((4, 4), bool)).any()


def pixels_of(mask):
    return {tuple(p) for p in np.argwhere(mask).tolist()}


def parts_of(pixels):
    """Sets of pixels that hang together by eight neighbours, the largest first, of equal ones that with the first pixel."""
    left, parts = set(pixels), []
    while left:
        stack, own = [min(left)], set()
        while stack:
            p = stack.pop()
            if p in left:
                left.discard(p)
                own.add(p)
                stack += [(p[0] + dy, p[1] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        parts.append(own)
    return sorted(parts, key=lambda s: (-len(s), min(s)))


def largest(pixels):
    return parts_of(pixels)[0] if pixels else set()


def spans_of(pixels):
    return {y: (min(x for yy, x in pixels if yy == y), max(x for yy, x in pixels if yy == y)) for y in {y for y, _ in pixels}}


def grown_by(pixels, tall, wide, shape):
    return {(y + dy, x + dx) for y, x in pixels for dy in range(-tall, tall + 1) for dx in range(-wide, wide + 1) if 0 <= y + dy < shape[0] and 0 <= x + dx < shape[1]}


def closed(pixels, half, shape):
    wide = grown_by(pixels, half, half, shape)
    inside = lambda y, x: all((y + dy, x + dx) in wide for dy in range(-half, half + 1) for dx in range(-half, half + 1) if 0 <= y + dy < shape[0] and 0 <= x + dx < shape[1])
    return {p for p in wide if inside(*p)}


def masks(n, seed):
    """Random shapes: blobs with holes, thin ones, several parts, and nothing."""
    rng = np.random.default_rng(seed)
    for k in range(n):
        shape = (int(rng.integers(18, 30)), int(rng.integers(18, 30)))
        mask = np.zeros(shape, bool)
        for _ in range(int(rng.integers(0, 4))):
            y, x, h, w = (int(rng.integers(0, m)) for m in (*shape, 16, 16))
            mask[y : y + h, x : x + w] = True
        yield mask & (rng.random(shape) < (1.0 if k % 2 else 0.93))


def test_masks_against_plain_sets():
    """Seat prior, backfill, hip zone, deep and front style, depth trim and distances, each against sets of pixels."""
    shown = 0
    for mask, other in zip(masks(60, 1), masks(60, 2)):
        shape = mask.shape
        chair = np.zeros(shape, bool)
        chair[: other.shape[0], : other.shape[1]] = other[: shape[0], : shape[1]]
        chair |= mask
        own, whole, spans = pixels_of(mask), pixels_of(chair), spans_of(pixels_of(chair))
        prior: set = set()
        if len(whole) >= 20:
            y0, y1 = min(spans), max(spans)
            low, high = y0 + round(0.34 * (y1 - y0 + 1)), min(y1, y0 + round(0.70 * (y1 - y0 + 1)))
            for y in range(low, high + 1) if high > low else ():
                if y in spans:
                    a, b = spans[y]
                    m = round(0.12 * (b - a + 1))
                    left = min(a + m, shape[1] - 1)
                    prior |= {(y, x) for x in range(left, max(min(shape[1] - 1, b - m), left) + 1)}
        prior = largest(prior)
        assert pixels_of(R.seat_prior(chair)) == prior

        got, want, start = pixels_of(R.backfill(mask, R.seat_prior(chair), 0.2, 0.2, 0.1, 3)), largest(own), largest(own)
        if want and prior:
            box = lambda p: (min(x for _, x in p), min(y for y, _ in p), max(x for _, x in p), max(y for y, _ in p))
            (px0, py0, px1, py1), (sx0, sy0, sx1, sy1) = box(start), box(prior)
            w, h = sx1 - sx0 + 1, sy1 - sy0 + 1
            ax0, ax1 = max(sx0, px0 - max(2, round(0.2 * w))), min(sx1, px1 + max(2, round(0.2 * w)))
            ay0, ay1 = max(sy0, py0 - max(2, round(0.2 * h))), min(sy1, py1 + max(1, round(0.1 * h)))
            target = {(y, x) for y, x in prior if ax0 <= x <= ax1 and ay0 <= y <= ay1}
            if ax1 > ax0 and ay1 > ay0 and start & target:
                reached = start & target
                for _ in range(3):
                    reached = grown_by(reached, 1, 1, shape) & target
                want = largest(reached)
                shown += want != start
        assert got == want

        distance = R.edge_distance(chair)
        out = [(y, x) for y in range(-1, shape[0] + 1) for x in range(-1, shape[1] + 1) if (y, x) not in whole]
        for y, x in whole:
            assert distance[y, x] == pytest.approx(min(math.hypot(y - v, x - u) for v, u in out))
        assert not distance[~chair].any()

        zone: set = set()
        if len(whole) >= 20:
            (bx, by), (fx, fy), depth = R.depth_axis(chair)
            y0, tall = min(y for y, _ in whole), max(4.0, max(y for y, _ in whole) - min(y for y, _ in whole))
            for (ex, ey), far in (((bx, by), False), ((fx, fy), True)):
                for share in (0.18, 0.25):
                    end = [(y, x) for y, x in whole if (y >= y0 + (1 - share) * tall if far else y <= y0 + share * tall)]
                    if len(end) >= 20:
                        break
                end = end or [(y, x) for y, x in whole if y == max(v for v, _ in whole)]
                assert (ex, ey) == pytest.approx((sum(x for _, x in end) / len(end), sum(y for y, _ in end) / len(end)))
            n2 = (fx - bx) ** 2 + (fy - by) ** 2
            assert all(depth[y, x] == pytest.approx(((x - bx) * (fx - bx) + (y - by) * (fy - by)) / n2, abs=1e-9) for y, x in whole)
            t = lambda y, x: depth[y, x]  # noqa: B023, E731
            margin = max(4.0, min(30.0, 0.045 * math.sqrt(len(whole))))
            zone = largest({p for p in whole if distance[p] >= margin and 0.30 <= t(*p) <= 0.86})
            if len(zone) < 80:
                zone = largest({p for p in whole if distance[p] >= max(2.0, margin / 2) and 0.22 <= t(*p) <= 0.92})
        assert pixels_of(R.hip_zone(chair)) == zone

        start, deep = largest(own), set()
        if start:
            y0, y1 = min(y for y, _ in start), max(y for y, _ in start)
            h = y1 - y0 + 1
            k = max(3, round(0.42 * h))
            k += k % 2 == 0
            deep = {(y, x) for y, x in grown_by(start, k // 2, 2, shape) & whole if round(y0 - 1.1 * h) <= y <= round(y1 + 0.35 * h)}
            deep = largest(closed(deep, 2, shape))
        assert pixels_of(R.deep_style(mask, chair, 0.42)) == deep
        front = set()
        if deep:
            y0, y1 = min(y for y, _ in deep), max(y for y, _ in deep)
            front = largest(closed({(y, x) for y, x in deep if y > y1 - max(1, round(0.5 * (y1 - y0 + 1)))}, 2, shape))
        assert pixels_of(R.front_style(R.deep_style(mask, chair, 0.42), 0.5)) == front
    assert shown > 5


def test_trims_against_plain_sets():
    """Rows around the peak and margins of rows, each against spans of sets of pixels."""
    for mask in masks(80, 7):
        own, spans = pixels_of(mask), spans_of(pixels_of(mask))
        widths = {y: b - a + 1 for y, (a, b) in spans.items()}
        assert R.row_widths(mask).tolist() == [widths.get(y, 0) for y in range(mask.shape[0])]
        want = set(own)
        if own and max(widths.values()) > 1:
            peak = min(y for y, w in widths.items() if w == max(widths.values()))
            least = max(1, round(0.68 * widths[peak]))
            top = bottom = peak
            while widths.get(top - 1, 0) >= least:
                top -= 1
            while widths.get(bottom + 1, 0) >= least:
                bottom += 1
            want = largest({(y, x) for y, x in own if top - 1 <= y <= bottom + 1})
        assert pixels_of(R.trim_rows(mask, 0.68, 1)) == want
        want = set()
        for y, (a, b) in spans.items():
            w = b - a + 1
            trim = max(1, round(0.1 * w))
            trim = max(0, (w - 3) // 2) if 2 * trim >= w - 2 else trim
            left, right = (a, b) if b - trim <= a + trim else (a + trim, b - trim)
            want |= {(y, x) for x in range(left, right + 1)}
        assert pixels_of(R.trim_sides(mask, 0.1, 1)) == largest(want)
        assert (R.trim_sides(mask, 0.0, 1) == mask).all()


def test_hull_smoothing_against_half_planes():
    """A pixel is in the hull unless a line through two corners has it on one side and all corners on the other; on a line it may be either."""
    rng = np.random.default_rng(4)
    for k in range(25):
        mask, gate = rng.random((9, 9)) < 0.35, rng.random((9, 9)) < (1.0 if k % 2 else 0.8)
        own = largest(pixels_of(mask))
        corners = sorted({(x + dx, y + dy) for y, x in own for dx in (0, 1) for dy in (0, 1)})
        side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        borders = [(a, b) for a in corners for b in corners if a != b and all(side(a, b, c) >= 0 for c in corners)]
        within = lambda least: {(y, x) for y in range(9) for x in range(9) if own and all(side(a, b, (x + 0.5, y + 0.5)) >= least for a, b in borders)}  # noqa: B023, E731
        hull = pixels_of(R.hull_mask(R.largest_component(mask)))
        assert within(1e-9) <= hull <= within(0)
        gated = hull & pixels_of(gate)
        for least in (3, 20):
            want = own if len(own) < least or not 0 < len(gated) <= 1.35 * len(own) else largest(gated)
            assert pixels_of(R.smooth_by_hull(mask, gate, least)) == want


def filled_ring(ring, shape):
    """The pixels that a closed walk goes through, and those it goes around: what a walk from outside does not reach."""
    walk = {(int(y), int(x)) for x, y in ring}
    seen, todo = set(), [(-1, -1)]
    while todo:
        y, x = todo.pop()
        if (y, x) in seen or (y, x) in walk or not (-1 <= y <= shape[0] and -1 <= x <= shape[1]):
            continue
        seen.add((y, x))
        todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return {(y, x) for y in range(shape[0]) for x in range(shape[1])} - seen


def test_borders_go_all_around():
    """A border walks from neighbour to neighbour and, filled, is its component with the holes: thin shapes, tips and cut pixels included."""
    v = np.zeros((12, 21), bool)
    for k in range(10):
        v[1 + k, 10 - k] = v[1 + k, 10 + k] = True
    bars = np.zeros((9, 9), bool)
    bars[4, :] = bars[:, 4] = True
    corner = np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1]], bool)
    shown = [v, bars, corner, np.ones((1, 6), bool), np.ones((1, 1), bool), np.zeros((3, 3), bool), *masks(120, 9)]
    for mask in shown:
        own = R.largest_component(mask)
        ring = R.border(own)
        if not own.any():
            assert len(ring) == 0
            continue
        outside = filled_ring([(x, y) for y, x in pixels_of(own)], mask.shape)
        assert filled_ring(ring, mask.shape) == outside and {(int(y), int(x)) for x, y in ring} <= pixels_of(own)
        if len(ring) > 1:
            assert np.abs(ring - np.roll(ring, -1, axis=0)).max(axis=1).tolist() == [1] * len(ring)
        assert (0 if len(ring) == 1 else len(ring)) == 2 * (len(outside) - R.ring_area(ring) - 1)
        assert len(R.outline(mask, 1.5, 5)) <= 5
    assert R.outline(v, 0.5).tolist() == [[10, 1], [19, 10], [10, 1], [1, 10]]


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_borders_of_all_polygons():
    """Every polygon of the larger tables on two grids: the box of the border is that of the component, and Pick's theorem holds."""
    import pyarrow.parquet as pq

    vectors = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["embedding"])["embedding"].to_pylist(), float)
    for side in (56, 16):
        for points in np.clip((vectors[:, :12] + 0.5) * side, 0, side - side / 224).reshape(-1, 6, 2):
            own = R.largest_component(R.fill(points, side, side))
            if own.any():
                ring = R.border(own)
                assert (*ring.min(axis=0), *ring.max(axis=0)) == R.bbox(own)
                assert 2 * (own.sum() - R.ring_area(ring) - 1) <= max(len(ring), 0) or len(ring) == 1


def test_components_and_distances_at_image_size():
    """A serpentine, noise and blobs of photograph size: labels as flooding gives them, distances as brute force gives them on a part."""
    snake = np.zeros((480, 640), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    assert R.components(snake).max() == 1
    rng = np.random.default_rng(8)
    for mask in (snake[:41, :37], rng.random((40, 50)) < 0.45, rng.random((40, 50)) < 0.6, np.zeros((4, 5), bool), np.ones((4, 5), bool)):
        labels, left, n = R.components(mask), pixels_of(mask), 0
        for y, x in sorted(left):
            if (y, x) in left:
                n, todo = n + 1, [(y, x)]
                while todo:
                    p = todo.pop()
                    if p in left:
                        left.remove(p)
                        assert labels[p] == n
                        todo += [(p[0] + dy, p[1] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        assert labels.max() == n and (labels > 0).sum() == mask.sum()
        away = np.pad(mask, 1)
        zero = np.argwhere(~away) - 1
        want = np.array([[np.sqrt(((zero - (y, x)) ** 2).sum(axis=1).min()) for x in range(mask.shape[1])] for y in range(mask.shape[0])])
        assert np.allclose(R.edge_distance(mask), want)
    assert R.edge_distance(np.ones((480, 640), bool)).max() == 240


@pytest.mark.parametrize("shape", [(20, 70), (9, 64), (13, 130), (12, 30)])
def test_wide_masks_equal_grids(spark, shape):
    """Bit words over several words a row, one full word and less, against boolean grids."""
    rng, g = np.random.default_rng(0), W.Grid(*shape)
    (h, w), draw = shape, lambda n: rng.random((n, 2)) * [shape[1], shape[0]]
    shown = [(draw(int(rng.integers(3, 8))), draw(5)) for _ in range(12)]
    kind = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(i, *[[tuple(map(float, p)) for p in polygon] for polygon in pair]) for i, pair in enumerate(shown)], f"i int, p {kind}, q {kind}")
    df = fixed(fixed(df, "a", g.fill(F.col("p"))), "b", g.fill(F.col("q")))
    a, b, lit = F.col("a"), F.col("b"), F.lit
    seed = W.common(a, g.rectangle(lit(0), lit(0), lit(20), lit(5)))
    wide = {"d": g.dilate(a, 2), "e": g.erode(a, 1), "c": g.close(a, lit(1)), "o": g.open(a, 2), "f": g.flip(a), "u": W.union(a, b), "m": W.without(a, b), "n": g.band(a, lit(3), lit(7)), "r": g.rectangle(lit(3), lit(2), lit(66), lit(8)), "l": g.flood(seed, a, 6), "x": W.union_of(F.array(a, b), g)}
    rows = df.select("i", "a", "b", *[c.alias(k) for k, c in wide.items()], W.overlap(a, b).alias("iou"), W.count(a).alias("pixels"), g.row_table(a).alias("t"), g.columns_of(a, lit(5)).alias("five")).collect()
    for row in rows:
        m, o = (R.fill(points, h, w) for points in shown[row.i])
        ys, xs = np.ogrid[:h, :w]
        corner = (ys < 6) & (xs < 21)
        want = {"a": m, "b": o, "d": R.dilate(m, 5), "e": R.erode(m, 3), "c": R.close(m, 3), "o": R.open_(m, 5), "f": m[:, ::-1], "u": m | o, "m": m & ~o, "n": R.only_rows(m, 3, 7), "r": (ys > 1) & (ys < 9) & (xs > 2) & (xs < 67), "l": R.flood(m & corner, m, 6), "x": m | o}
        for k, grid in want.items():
            assert (S.unpacked(row[k], g) == grid).all(), k
        assert row.pixels == m.sum() and row.iou == pytest.approx((m & o).sum() / max(1, (m | o).sum())) and row.five == np.flatnonzero(m[5]).tolist()
        for y, told in enumerate(row.t):
            on = np.flatnonzero(m[y])
            assert tuple(told) == ((len(on), on[0], on[-1]) if len(on) else (0, None, None))
        assert S.packed(m) == row.a
    words = {(r.i, r.at): r.bits for r in any_of(df.select((F.col("i") % 2).alias("i"), "a"), "i", "a").collect()}
    for half in (0, 1):
        every = np.any([R.fill(p, h, w) for i, (p, _) in enumerate(shown) if i % 2 == half], axis=0)
        assert [words[half, k] for k in range(h * g.words)] == S.packed(every)


def test_hulls_are_folds(spark):
    rng = np.random.default_rng(2)
    shown = [rng.integers(-6, 7, (int(n), 2)).astype(float) for n in rng.integers(1, 25, 60)]
    df = spark.createDataFrame([(i, [tuple(map(float, p)) for p in points]) for i, points in enumerate(shown)], "i int, p array<struct<x:double,y:double>>")
    for r in df.select("i", convex_hull(F.col("p")).alias("h")).collect():
        assert [tuple(p) for p in r.h] == [tuple(p) for p in hull_of(shown[r.i]).tolist()]


def test_depth_trim():
    """The strictest range that leaves 36 % of the pixels and 64 of them, by how upright the axis is."""
    mask = np.ones((50, 40), bool)
    for (back, front), ranges in {((20.0, 0.0), (20.0, 49.0)): ((0.32, 0.86),), ((0.0, 10.0), (39.0, 40.0)): ((0.26, 0.90),), ((0.0, 25.0), (39.0, 25.0)): ((0.20, 0.95),)}.items():
        chosen, kept = R.depth_range(mask, back, front)
        n2 = (front[0] - back[0]) ** 2 + (front[1] - back[1]) ** 2
        t = lambda y, x: ((x - back[0]) * (front[0] - back[0]) + (y - back[1]) * (front[1] - back[1])) / n2  # noqa: B023, E731
        assert chosen == ranges[0] and pixels_of(kept) == {(y, x) for y in range(50) for x in range(40) if chosen[0] <= t(y, x) <= chosen[1]}
        assert pixels_of(R.trim_depth(mask, back, front)) == closed(pixels_of(kept), 1, mask.shape)
    top = mask & (np.arange(50) < 14)[:, None]  # all but the loosest range leave too little
    assert R.depth_range(top, (20.0, 0.0), (20.0, 49.0))[0] is None and (R.trim_depth(top, (20.0, 0.0), (20.0, 49.0)) == top).all()
    assert R.depth_range(mask & (np.arange(50) < 20)[:, None], (20.0, 0.0), (20.0, 49.0))[0] == (0.24, 0.92)
    assert R.depth_range(mask, (3.0, 3.0), (3.0, 3.0))[0] is None and not R.trim_depth(np.zeros((4, 4), bool), (0.0, 0.0), (0.0, 4.0)).any()


def test_bit_rows_equal_masks(spark):
    rng = np.random.default_rng(3)
    polygons = [rng.random((int(rng.integers(3, 8)), 2)) * 16 for _ in range(60)]
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in p]) for i, p in enumerate(polygons)], "i int, p array<struct<x:double,y:double>>")
    rows = df.select("i", R.bit_rows(F.col("p"), 16, 1.0).alias("a"))
    rows = rows.select("i", "a", R.bit_dilate(F.col("a"), 16).alias("d"), R.bit_erode(F.col("a"), 16).alias("e"), R.bit_flip(F.col("a"), 16).alias("f")).collect()
    grid = lambda bits: np.array([[b >> k & 1 for k in range(16)] for b in bits], bool)
    for r in rows:
        mask = R.fill(polygons[r.i], 16, 16)
        assert (grid(r.a) == mask).all() and (grid(r.d) == R.dilate(mask, 3)).all() and (grid(r.e) == R.erode(mask, 3)).all() and (grid(r.f) == mask[:, ::-1]).all()


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 7, 9)
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\0" * 12
    assert [readers.header_size(c) for c in (png, gif, bmp, jpeg, b"?", b"")] == [(640, 480), (7, 9), (5, 6), (40, 30), None, None]


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    doc = {"imagePath": "a.png", "shapes": [{"label": "seat", "shape_type": "polygon", "points": [[0, 0], [4, 0], [4, 3]]}, {"label": "seat", "points": [[0, 0]]}, {"label": "x", "points": [[0, 0], [1, 0], [1, 1]]}]}
    (folder / "a.json").write_text(json.dumps(doc))
    (folder / "b.json").write_text("{not json")
    (folder / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 8, 6))
    docs = readers.annotations(spark, str(folder))
    assert sorted((r.stem, r.is_bad) for r in docs.collect()) == [("a", False), ("b", True)]
    polygons = readers.labelled_polygons(docs, "seat")
    assert [(r.stem, r.idx, len(r.points)) for r in polygons.collect()] == [("a", 0, 3)]
    index = readers.images(spark, str(folder)).collect()
    assert [(r.stem, r.ext, r.media, r.width, r.height) for r in index] == [("a", ".png", "image/png", 8, 6)]
    rows = polygons.select(F.col("stem").alias("sample_id"), "idx", "points", F.lit(8).alias("width"), F.lit(6).alias("height"))
    texts = {r.sample_id: r.text for r in writers.label_texts(rows, docs.select(F.col("stem").alias("sample_id"))).collect()}
    assert texts == {"a": "0 0.000000 0.000000 0.500000 0.000000 0.500000 0.500000", "b": ""}
    writers.write_manifest(docs.select("stem", F.lit('x,"y"').alias("v")), str(tmp_path / "m"))
    assert {r.v for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "m")).collect()} == {'x,"y"'}
    told = json.loads(writers.report(docs.select(F.when(F.col("is_bad"), "bad").otherwise("ok").alias("reason")), seed=42).first().value)
    assert told == {"total": 2, "counts": {"bad": 1, "ok": 1}, "settings": {"seed": 42}}
    (tmp_path / "p.txt").write_text("  hi\n")
    assert readers.prompt_text(spark, str(tmp_path / "p.txt")).first().text == "hi"
    (folder / "val_1.json").write_text(json.dumps({"summary": {"num_samples": 3, "mean_iou_all": 0.5}, "samples": []}))
    assert [(r.file, r.num_samples, r.mean_iou_all) for r in readers.summaries(spark, str(folder)).collect()] == [("val_1.json", 3, 0.5)]
    with pytest.raises(ValueError):
        readers.Config(max_retries=0)


def test_stream_of_arrivals(spark, tmp_path):
    rows = [(f"k{i % 5}", f"2024-01-01 00:{i:02d}:00", float(i)) for i in range(20)]
    spark.createDataFrame(rows, "k string, t string, v double").selectExpr("k", "CAST(t AS TIMESTAMP) AS ts", "v").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(tmp_path / "s"))
    for name, df in (("firsts", arrivals.first_arrivals(stream, "k", "ts")), ("counts", arrivals.windowed_counts(stream, "ts", "k", "v"))):
        query = df.writeStream.outputMode("append" if name == "firsts" else "complete").format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("firsts").count() == 5
    assert {(r.k, r.n, r.total) for r in spark.table("counts").collect()} == {(f"k{i}", 4, float(4 * i + 30)) for i in range(5)}
    assert {r.s for r in spark.range(300).select(arrivals.split_of("id").alias("s")).collect()} == {"train", "val", "test"}


def candidates_by_hand(seat, back, contact, w, h, step, most):
    """All candidates of one seat, one point at a time."""
    area = lambda p: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2
    own = contact is not None and len(contact) >= 3 and area(contact) > 1.0
    poly = contact if own else seat
    mid = lambda a, b: ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
    k = min(range(4), key=lambda i: math.dist(mid(seat[i], seat[(i + 1) % 4]), mid(*back)))
    a, b, c, d = (seat[(k + i) % 4] for i in range(4))
    m, f = mid(a, b), mid(c, d)
    share = lambda p, q, x, y: ((x - p[0]) * (q[0] - p[0]) + (y - p[1]) * (q[1] - p[1])) / math.dist(p, q) ** 2
    upright = abs(f[1] - m[1]) / math.dist(m, f)
    low, high, at, sigma = (0.08, 0.92, 0.35, 0.23) if not own else (0.34, 0.84, 0.54, 0.16) if upright >= 0.75 else (0.27, 0.88, 0.49, 0.18) if upright >= 0.55 else (0.2, 0.9, 0.46, 0.2)
    edges, found = list(zip(poly, poly[1:] + poly[:1])), []
    xs, ys = [p[0] for p in poly], [p[1] for p in poly]
    margin = max(4.0, min(30.0, 0.04 * math.sqrt(max(area(poly), 1.0))))

    def away(x, y, p, q):
        t = max(0.0, min(1.0, share(p, q, x, y)))
        return math.dist((x, y), (p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))

    for y in range(max(0, math.floor(min(ys))), min(h - 1, math.ceil(max(ys))) + 1, step):
        for x in range(max(0, math.floor(min(xs))), min(w - 1, math.ceil(max(xs))) + 1, step):
            inside = sum((p[1] > y) != (q[1] > y) and x < (p[0] - q[0]) * (y - q[1]) / (p[1] - q[1]) + q[0] for p, q in edges) % 2
            t, u = share(m, f, x, y), share(a, b, x, y)
            if inside and min(away(x, y, p, q) for p, q in edges) >= margin and low <= t <= high:
                weight = math.exp(-0.5 * ((t - at) / sigma) ** 2) * math.exp(-0.5 * ((u - 0.5) / 0.33) ** 2)
                found.append((float(x), float(y), round(weight, 4), round(t, 4)))
    if not found:
        found = [(round(max(0.0, min(w - 1.0, sum(xs) / len(xs))), 2), round(max(0.0, min(h - 1.0, sum(ys) / len(ys))), 2), 1.0, 0.5)]
    found.sort(key=lambda p: -p[2])
    if len(found) > most:
        found = [found[min(round(i * len(found) / most), len(found) - 1)] for i in range(most)]
    return found


@pytest.mark.parametrize(("step", "most"), [(12, 1500), (3, 1500), (5, 40)])
def test_ranked_candidates(spark, step, most):
    """Whole seats, tiny ones, ones outside the frame, contact regions at three slants and ones that are no area."""
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    wide, region = box(20.3, 30.7, 181.0, 170.0), [(41.0, 52.0), (180.5, 61.0), (171.0, 183.0), (60.0, 170.5)]
    slant = [(30.0, 30.0), (150.0, 110.0), (190.0, 190.0), (20.0, 150.0)]
    turned = [(41.0, 20.0), (130.0, 95.0), (70.0, 170.0), (20.0, 100.0)]
    above, aside, corner = [(100.0, 10.0), (120.0, 10.0)], [(2.0, 100.0), (2.0, 120.0)], [(190.0, 10.0), (200.0, 20.0)]
    seats = [(wide, above, None), (wide, above, region), (wide, aside, region), (turned, corner, turned[::-1]), (slant, aside, region[:3]), (wide, above, region[:2]), (wide, above, [(1.0, 1.0)] * 3), (box(50.0, 50.0, 6.0, 5.0), above, None), (box(300.0, 300.0, 40.0, 40.0), above, None)]
    kind = "array<struct<x: double, y: double>>"
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(seats)], f"id int, seat {kind}, back {kind}, contact {kind}")
    got = {}
    for r in pose.ranked_candidates(df, 224, 224, step, most).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r["rank"], r.x, r.y, r.weight, r.depth_t))
    assert sorted(got) == list(range(len(seats)))
    for i, (seat, back, contact) in enumerate(seats):
        want = candidates_by_hand(seat, back, contact, 224, 224, step, most)
        assert [g[0] for g in got[i]] == list(range(1, len(want) + 1))
        assert np.abs(np.array([g[1:] for g in got[i]]) - np.array(want)).max() < 1.1e-4, i
    assert len(got[0]) > 5 and [len(got[i]) for i in (7, 8)] == [1, 1]


def test_zone_candidates():
    chair = np.zeros((90, 120), bool)
    chair[10:80, 15:110] = True
    zone, (back, front, depth) = R.hip_zone(chair), R.depth_axis(chair)
    assert zone.any() and back == (62.0, 16.0) and front == (62.0, 73.0)
    ys, xs = np.nonzero(zone)
    want = []
    for y in range(ys.min(), ys.max() + 1, 5):
        for x in range(xs.min(), xs.max() + 1, 5):
            if zone[y, x]:
                t, u = (y - 16) / 57, (xs.max() - x) / (xs.max() - xs.min())
                want.append((float(x), float(y), round(math.exp(-0.5 * ((t - 0.52) / 0.2) ** 2) * math.exp(-0.5 * ((u - 0.5) / 0.33) ** 2), 4), round(t, 4)))
    want.sort(key=lambda p: -p[2])
    told = lambda found: [tuple(p.values()) for p in found]
    assert len(want) > 40 and told(R.zone_candidates(zone, back, front, depth, 5)) == want
    assert told(R.zone_candidates(zone, back, front, depth, 5, 40)) == [want[round(i * len(want) / 40)] for i in range(40)]
    assert told(R.zone_candidates(np.zeros((30, 41), bool), back, front, depth)) == [(20.5, 15.0, 1.0, None)]
    odd = np.zeros((30, 41), bool)
    odd[3, 5] = odd[4, 4] = True  # the grid starts at their corner and meets neither
    assert told(R.zone_candidates(odd, back, front, depth)) == [(4.5, 3.5, 1.0, None)]


def test_lora_targets(spark):
    told = {"": ["all-linear"], " \t": ["all-linear"], " all-linear ": ["all-linear"], "q_proj, v_proj\t,,k": ["q_proj", "v_proj", "k"], ",": []}
    rows = spark.createDataFrame([(t,) for t in told], "t string").select("t", X.lora_targets(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == told


def test_fallback_projection(spark):
    """Base local score, hip and ankle checks, fallback's local score, checker, the fallback's checker -> tried, accepted, effective."""
    cases = [
        (4, 1, 1, 4, 3, None, False, False, 3), (2, 1, 1, 4, 3, None, True, True, 3), (3, 0, 1, 4, 3, None, True, True, 3), (3, 1, 0, 3, 4, None, True, False, 3),
        (3, 1, 0, 2, 4, None, True, False, 3), (2, 0, 0, 4, 1, None, True, True, 1), (2, 0, 0, 4, 3, 1, True, False, 2), (2, 0, 0, 4, 3, 4, True, True, 4), (4, None, None, 4, 4, None, False, False, 4),
    ]
    df = spark.createDataFrame(cases, "l int, hip int, ankles int, f int, c int, again int, tried boolean, taken boolean, effective int")
    checks = {"hip_on_seat": F.col("hip"), "ankles_below_seat_near_floor": F.col("ankles")}
    got = df.select("*", pose.project_fallback(F.col("l"), checks, F.col("f"), F.col("c"), F.lit(3), F.col("again")).alias("p")).collect()
    assert [(r.p.must_project, r.p.accepted, r.p.effective) for r in got] == [c[6:] for c in cases]
    assert all((r.p.local, r.p.checker) == ((r.f, r.again or r.c) if r.taken else (r.l, r.c)) for r in got)


def test_batches_of_wide_masks_are_the_expressions_masks(spark):
    """Masks of many polygons at once, in numpy, have the pixels of Grid's expressions, in part words, at borders and for polygons of any number of points."""
    rng = np.random.default_rng(8)
    polygons = [[], [(3.0, 3.0)], [(-9.0, -9.0), (200.0, -5.0), (200.0, 90.0), (-9.0, 90.0)]]
    polygons += [[tuple(p) for p in rng.uniform(-10, 160, (n, 2)).tolist()] for n in (3, 4, 6, 9) for _ in range(5)]
    rows = [[{"x": x, "y": y} for x, y in p] for p in polygons]
    for g in (W.Grid(20, 150), W.Grid(9, 64), W.Grid(7, 30)):
        df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, p array<struct<x:double,y:double>>")
        df = fixed(df, "m", g.fill(F.col("p"))).select("m", g.dilate(F.col("m")).alias("d"), g.erode(F.col("m")).alias("e"), "k").orderBy("k")
        told = [[np.array(r[c], np.int64).view(np.uint64) for r in df.collect()] for c in ("m", "d", "e")]
        made = W.Batch(g)
        masks = made.fill(W.ring_batch(pa.array(rows, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))
        for want, got in zip(told, (masks, made.dilate(masks), made.erode(masks))):
            assert (np.array(want) == got.reshape(len(rows), -1)).all()
        assert made.count(masks).tolist() == np.bitwise_count(np.array(told[0])).sum(axis=1).tolist()


def test_wide_masks_of_a_query_are_made_many_at_once(spark):
    """mask_wide evaluates no expression for each word of a mask: its plan has no aggregate or zip over arrays."""
    from tessera.plans.mask_plans import mask_wide

    plan = mask_wide(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "zip_with" not in plan and "aggregate(" not in plan
