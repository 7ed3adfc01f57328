"""Column expressions against hand-computed cases and plain Python."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import geometry as G
from tessera.functions.hull import hull_of, quadrilateral
from tessera.operators import pose as P
from tessera.operators import validate as V


def pts(*xy):
    return F.array(*[G.point(float(x), float(y)) for x, y in xy])


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_area_inside_and_distance(spark):
    rect = pts((0, 0), (4, 0), (4, 3), (0, 3))
    row = one(
        spark, G.polygon_area(rect), G.polygon_area(pts((0, 0), (1, 1))), G.point_in_polygon(F.lit(1.0), F.lit(1.0), rect), G.point_in_polygon(F.lit(5.0), F.lit(1.0), rect),
        G.segment_distance(F.lit(2.0), F.lit(5.0), G.point(0, 0), G.point(4, 0)), G.segment_distance(F.lit(7.0), F.lit(4.0), G.point(0, 0), G.point(4, 0)), G.segment_distance(F.lit(3.0), F.lit(4.0), G.point(0, 0), G.point(0, 0)),
    )
    assert list(row) == [12.0, 0.0, True, False, 5.0, 5.0, 5.0]


def test_grid_box(spark):
    told = F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("x_min", "y_min", "x_max", "y_max"), (48, 100, 170, 140))])
    flat = F.struct(*[F.lit(15.0).alias(k) for k in ("x_min", "y_min", "x_max", "y_max")])
    row = one(spark, G.grid_box(G.scale_box(told, 224, 224, 16, 16), 16, 16), G.grid_box(flat, 16, 16))
    assert tuple(row.c0) == (3, 7, 13, 10) and tuple(row.c1) == (14, 14, 15, 15)


def test_scaling_laws(spark):
    row = one(spark, G.scale_pixels(F.lit(223.0), 224, 640), G.scale_ratio(F.lit(223.0), 224, 640), G.scale_pixels(F.lit(7.0), 1, 640), G.scale_ratio(F.lit(7.0), 0, 640))
    assert row.c0 == pytest.approx(639) and row.c1 == pytest.approx(223 * 640 / 224) and row.c2 == 7 and row.c3 == 7


def test_dedupe_and_resample(spark):
    df = spark.range(1).select(pts((0, 0), (0, 0), (4, 0), (4, 4), (0, 0)).alias("p"), pts((0, 0), (4, 0), (4, 4), (0, 4)).alias("q"), pts((0, 0), (1, 1)).alias("s"))
    row = df.select(A.dedupe_points(F.col("p")).alias("d"), A.dedupe_points(F.array().cast(f"array<{G.POINT}>")).alias("none")).first()
    assert [tuple(p) for p in row.d] == [(0, 0), (4, 0), (4, 4)] and row.none == []
    even = A.resample_ring(df, "q", 8, "even").first().even
    assert [tuple(p) for p in even] == [(0, 0), (2, 0), (4, 0), (4, 2), (4, 4), (2, 4), (0, 4), (0, 2)]
    assert A.resample_ring(df, "s", 8, "even").first().even == []


def test_distance_dedupe_and_order(spark):
    df = spark.range(1).select(pts((0, 0), (1, 0), (2, 0), (2.5, 0), (9, 9), (0.5, 0)).alias("p"), pts((4, 4), (0, 4), (0, 0), (4, 0)).alias("q"))
    assert [tuple(p) for p in df.select(A.dedupe_by_distance(F.col("p")).alias("d")).first().d] == [(0, 0), (2, 0), (9, 9)]
    turned = A.rotate_to_top_left(df, "q", "t").first().t
    assert tuple(turned[0]) == (0, 0) and {tuple(p) for p in turned} == {(0, 0), (4, 0), (4, 4), (0, 4)}


def test_stride(spark):
    row = one(spark, A.stride_indexes(F.lit(5).cast("long"), 2), A.stride_indexes(F.lit(2).cast("long"), 5))
    assert list(row.c0) == [0, 2] and list(row.c1) == [0, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=25))
def test_hull_holds_every_point(points):
    import numpy as np

    hull = hull_of(np.array(points, float))
    assert {tuple(p) for p in hull.tolist()} <= {(float(x), float(y)) for x, y in points}
    if len(hull) >= 3:
        for (ax, ay), (bx, by) in zip(hull, np.roll(hull, -1, axis=0)):
            assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-9 for x, y in points)


def test_quadrilateral(spark):
    df = spark.range(1).select(pts((0, 0), (2, -1), (4, 0), (5, 2), (4, 4), (0, 4)).alias("p"), pts((0, 0), (1, 0), (2, 0), (3, 0)).alias("flat"))
    got = quadrilateral(df, "p", "q").first().q
    assert len(got) == 4 and {tuple(p) for p in got} <= {(0, 0), (2, -1), (4, 0), (5, 2), (4, 4), (0, 4)}
    assert quadrilateral(df, "flat", "q").first().q == []


def seat(top=52, bottom=62):
    return pts((28, top), (72, top), (72, bottom), (28, bottom))


def test_prior_issues(spark):
    floor, back = (lambda y: pts((10, y), (90, y))), pts((28, 30), (72, 30))
    row = one(spark, V.prior_issues(seat(), floor(88), back, F.lit(100)), V.prior_issues(seat(), floor(65), back, F.lit(100)))
    assert row.c0 == [] and row.c1 == ["floor line is not sufficiently below seat"]


def test_geometry_errors_stop_at_the_first_kind(spark):
    floor, back = pts((10, 88), (90, 88)), pts((28, 30), (72, 30))
    w = F.lit(100)
    row = one(
        spark, V.geometry_errors(seat(), floor, back, w, w), V.geometry_errors(seat(), floor, back, F.lit(0), w), V.geometry_errors(pts((1, 1)), floor, back, w, w),
        V.geometry_errors(pts((-1, 0), (72, 52), (72, 62), (28, 62)), floor, back, w, w), V.geometry_errors(pts((1, 1), (1, 1), (1, 1), (1, 1)), floor, back, w, w),
    )
    assert row.c0 == [] and row.c1 == ["image_width must be a positive integer"] and row.c2 == ["seat_region must be a list of 4 points"]
    assert row.c3 == ["seat_region[0].x out of bounds"] and row.c4 == ["seat_region is degenerate"]


def test_rejections(spark):
    whole = pts((0, 0), (223, 0), (223, 223), (0, 223))
    assert one(spark, V.polygon_rejections(whole, 224, 224)).c0 == ["area_too_large", "bbox_too_tall", "touches_multiple_corners"]


def test_canonical_and_fallback_pose_pass_the_local_check(spark):
    s, f, b = P.canonical(100, 100)
    row = one(spark, G.xs(s), G.ys(s), f[0]["y"], b[0]["y"], V.geometry_errors(s, f, b, F.lit(100), F.lit(100)), V.prior_issues(s, f, b, F.lit(100)))
    assert row.c0 == [28, 72, 72, 28] and row.c1 == [52, 52, 62, 62] and row.c2 == 88 and row.c3 == 30 and row.c4 == [] and row.c5 == []
    pose = P.fallback_pose(s, f, 300, 300)
    checks = P.local_checks(s, f, pose, 300)
    assert set(pose) == set(P.KEYPOINTS) and set(one(spark, *checks.values())) <= {0, 1}


def test_repair_moves_floor_and_back(spark):
    df = spark.range(1).select(F.col("id"), seat(20, 90).alias("seat"), pts((10, 50), (90, 50)).alias("floor"), pts((28, 80), (72, 80)).alias("back"))
    row = P.repair(df, 100, 100).first()
    assert row.ok and "moved floor_line below seat to satisfy sitting prior" in row.notes and row.floor[0].y > max(p.y for p in row.seat)


def test_placeholder_lists_differ(spark):
    row = one(spark, V.has_any(F.lit("<X>"), V.PLACEHOLDERS), V.has_any(F.lit("ok"), V.PLACEHOLDERS), V.has_any(F.lit("a:int"), V.PLACEHOLDERS), V.has_any(F.lit("a:int"), V.BANNED))
    assert list(row) == [True, False, False, True]


def test_cell_iou_is_symmetric(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(40):
        b = [sorted(rng.sample(range(16), 2)) for _ in range(4)]
        rows.append(tuple((b[k][0], b[k + 1][0], b[k][1], b[k + 1][1]) for k in (0, 2)))
    kind = "struct<x_min:int,y_min:int,x_max:int,y_max:int>"
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    for r in df.select("a", "b", G.cell_iou(F.col("a"), F.col("b")).alias("x"), G.cell_iou(F.col("b"), F.col("a")).alias("y"), G.cell_iou(F.col("a"), F.col("a")).alias("own")).collect():
        cells = lambda q: {(x, y) for x in range(q[0], q[2] + 1) for y in range(q[1], q[3] + 1)}
        assert r.own == 1 and r.x == r.y and math.isclose(r.x, len(cells(r.a) & cells(r.b)) / len(cells(r.a) | cells(r.b)))
