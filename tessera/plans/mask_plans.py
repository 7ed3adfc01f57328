"""Queries over masks: polygons of the embeddings rasterised on small grids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.arrays import fixed
from tessera.functions.geometry import point
from tessera.functions.hull import convex_hull
from tessera.operators import pose as P
from tessera.operators import raster as R
from tessera.operators import seat as S
from tessera.operators import widemask as W
from tessera.operators.fusion import band_gate, fuse_masks
from tessera.operators.widemask import Grid
from tessera.plans.common import FRAME, dim, polygons, r4, sql_edges, sql_points
from tessera.session import small_batches, table

SIDE = 16
CELL = FRAME / SIDE
FINE = 56
PHOTO, WIDE = Grid(FRAME, FRAME), Grid(480, 640)


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, a and b: ground truth and prediction as bit rows, made once for each row."""
    both = F.struct(R.bit_rows(F.col("gt"), SIDE, CELL).alias("a"), R.bit_rows(F.col("pred"), SIDE, CELL).alias("b"))
    return fixed(polygons(spark, sf_dir).select("vec_id", "gt", "pred"), "m", both).select("vec_id", "m.a", "m.b")


def _by_op(rows: DataFrame, counts: dict) -> DataFrame:
    """A row for each operation whose result has pixels: vec_id, op, n."""
    told = F.array(*[F.struct(F.lit(name).alias("op"), n.alias("n")) for name, n in counts.items()])
    return rows.select("vec_id", F.explode(told).alias("x")).select("vec_id", "x.op", "x.n").where("n > 0")


def _sql_pixels(name: str, points: str, first: int, side: int = SIDE) -> str:
    cell = FRAME / side
    return f"""{sql_points(points, first)}, {sql_edges(points + "e", points)},
{name} AS (SELECT vec_id, y, x FROM (SELECT vec_id, gy.g AS y, gx.g AS x, sum(CASE WHEN (sy>(gy.g+0.5)*{cell}) <> (ey>(gy.g+0.5)*{cell}) AND (gx.g+0.5)*{cell} < (sx-ex)*((gy.g+0.5)*{cell}-ey)/((sy-ey)+1e-8)+ex THEN 1 ELSE 0 END) AS n
  FROM {points}e, range({side}) gy(g), range({side}) gx(g) GROUP BY vec_id, gy.g, gx.g) WHERE n%2=1)"""


BOTH = f"{_sql_pixels('a', 'v', 0)}, {_sql_pixels('b', 'w', 12)}"


def mask_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection over union of ground truth and prediction, by bits of rows."""
    a, b = F.col("a"), F.col("b")
    rows = _masks(spark, sf_dir).select("vec_id", R.bit_count(R.bit_and(a, b)).alias("common"), R.bit_count(R.bit_or(a, b)).alias("either"))
    return rows.where("either > 0").select("*", r4(F.col("common") / F.col("either")).alias("iou"))


MASK_IOU = f"""WITH {BOTH} SELECT vec_id, count(*) FILTER (na=1 AND nb=1) AS common, count(*) AS either, round(count(*) FILTER (na=1 AND nb=1)/count(*)::DOUBLE,4) AS iou
FROM (SELECT vec_id, y, x, max(s=1)::INT AS na, max(s=2)::INT AS nb FROM (SELECT *, 1 AS s FROM a UNION ALL SELECT *, 2 FROM b) GROUP BY vec_id, y, x) GROUP BY vec_id"""


def mask_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection, a band of rows and the flip of a prediction, as counts of pixels."""
    a, b = F.col("a"), F.col("b")
    parts = {"a_or_b": R.bit_or(a, b), "a_and_b": R.bit_and(a, b), "a_in_band": F.slice(a, 5, 8), "a_and_flip": R.bit_and(a, R.bit_flip(b, SIDE)), "a_not_b": R.bit_minus(a, b)}
    return _by_op(_masks(spark, sf_dir), {name: R.bit_count(rows) for name, rows in parts.items()})


MASK_SET_OPS = f"""WITH {BOTH} SELECT vec_id, 'a_or_b' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY vec_id
UNION ALL SELECT vec_id, 'a_and_b', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY vec_id UNION ALL SELECT vec_id, 'a_in_band', count(*) FROM a WHERE y BETWEEN 4 AND 11 GROUP BY vec_id
UNION ALL SELECT vec_id, 'a_and_flip', count(*) FROM (SELECT * FROM a INTERSECT SELECT vec_id, y, {SIDE - 1}-x FROM b) GROUP BY vec_id UNION ALL SELECT vec_id, 'a_not_b', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY vec_id"""


def mask_morph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dilation, erosion, closing and opening by a square of three, as counts of pixels."""
    rows = fixed(_masks(spark, sf_dir).select("vec_id", "a"), "m", F.struct(R.bit_dilate(F.col("a"), SIDE).alias("d"), R.bit_erode(F.col("a"), SIDE).alias("e")))
    d, e = F.col("m.d"), F.col("m.e")
    parts = {"dilate": d, "erode": e, "close": R.bit_erode(d, SIDE), "open": R.bit_dilate(e, SIDE)}
    return _by_op(rows, {name: R.bit_count(m) for name, m in parts.items()})


def _sql_grow(name: str, src: str) -> str:
    return f"{name} AS (SELECT DISTINCT vec_id, y+dy.d-1 AS y, x+dx.d-1 AS x FROM {src}, range(3) dy(d), range(3) dx(d) WHERE y+dy.d-1 BETWEEN 0 AND {SIDE - 1} AND x+dx.d-1 BETWEEN 0 AND {SIDE - 1})"


def _sql_shrink(name: str, src: str) -> str:
    return f"""{name} AS (SELECT vec_id, y, x FROM {src} p WHERE NOT EXISTS (SELECT 1 FROM range(3) dy(d), range(3) dx(d) WHERE p.y+dy.d-1 BETWEEN 0 AND {SIDE - 1} AND p.x+dx.d-1 BETWEEN 0 AND {SIDE - 1}
 AND NOT EXISTS (SELECT 1 FROM {src} q WHERE q.vec_id=p.vec_id AND q.y=p.y+dy.d-1 AND q.x=p.x+dx.d-1)))"""


MASK_MORPH = f"""WITH {_sql_pixels("a", "v", 0)}, {_sql_grow("d", "a")}, {_sql_shrink("e", "a")}, {_sql_shrink("c", "d")}, {_sql_grow("o", "e")}
SELECT vec_id, 'dilate' AS op, count(*) AS n FROM d GROUP BY vec_id UNION ALL SELECT vec_id, 'erode', count(*) FROM e GROUP BY vec_id UNION ALL SELECT vec_id, 'close', count(*) FROM c GROUP BY vec_id UNION ALL SELECT vec_id, 'open', count(*) FROM o GROUP BY vec_id"""


def mask_largest_cc(spark: SparkSession, sf_dir: str) -> DataFrame:
    def measure(a: np.ndarray) -> dict:
        mask = R.fill(a / CELL, SIDE, SIDE)
        own = R.largest_component(mask)
        box = R.bbox(own) or (-1, -1, -1, -1)
        return {"n_set": int(mask.sum()), "n_components": int(R.components(mask).max()), "n_largest": int(own.sum()), "x_min": box[0], "y_min": box[1], "x_max": box[2], "y_max": box[3]}

    schema = "struct<n_set:int,n_components:int,n_largest:int,x_min:int,y_min:int,x_max:int,y_max:int>"
    return polygons(spark, sf_dir).select("vec_id", R.measured([F.col("gt")], measure, schema).alias("m")).select("vec_id", "m.*")


MASK_CC = f"""WITH RECURSIVE {_sql_pixels("a", "v", 0)}, l AS (SELECT vec_id, y, x, y*{SIDE}+x AS r FROM a
 UNION SELECT q.vec_id, q.y, q.x, l.r FROM l JOIN a q ON q.vec_id=l.vec_id AND abs(q.y-l.y)<=1 AND abs(q.x-l.x)<=1),
m AS (SELECT vec_id, y, x, min(r) AS r FROM l GROUP BY vec_id, y, x),
c AS (SELECT vec_id, r, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM m GROUP BY vec_id, r),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, r) AS k, count(*) OVER (PARTITION BY vec_id) AS nc, sum(n) OVER (PARTITION BY vec_id) AS total FROM c)
SELECT e.vec_id, coalesce(total,0)::INTEGER AS n_set, coalesce(nc,0)::INTEGER AS n_components, coalesce(n,0)::INTEGER AS n_largest, coalesce(x0,-1)::INTEGER AS x_min, coalesce(y0,-1)::INTEGER AS y_min, coalesce(x1,-1)::INTEGER AS x_max, coalesce(y1,-1)::INTEGER AS y_max
FROM embeddings e LEFT JOIN b ON b.vec_id=e.vec_id AND k=1"""


def mask_profile_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    def measure(a: np.ndarray) -> dict:
        mask = R.fill(a / CELL * 2, 2 * SIDE, 2 * SIDE)
        widths = R.row_widths(mask)
        return {"n_set": int(mask.sum()), "peak_row": int(widths.argmax()), "peak_width": int(widths.max()), "n_prior": int(R.seat_prior(mask).sum()), "n_sides": int(R.trim_sides(mask, 0.1, 1).sum()), "n_rows": int(R.trim_rows(mask, 0.68, 1).sum())}

    schema = "struct<n_set:int,peak_row:int,peak_width:int,n_prior:int,n_sides:int,n_rows:int>"
    return polygons(spark, sf_dir).select("vec_id", R.measured([F.col("gt")], measure, schema).alias("m")).select("vec_id", "m.*")


def _measured(spark: SparkSession, sf_dir: str, measure, *names: str) -> DataFrame:
    """A number of each name for every pair of polygons on the fine grid: measure gets the mask and the chair, a hull around both polygons."""

    def run(a: np.ndarray, b: np.ndarray) -> dict:
        scale = FINE / FRAME
        mask = R.fill(a * scale, FINE, FINE)
        return dict(zip(names, map(int, measure(mask, R.hull_mask(mask | R.fill(b * scale, FINE, FINE)), a))))

    schema = "struct<" + ",".join(f"{name}:int" for name in names) + ">"
    return polygons(spark, sf_dir).select("vec_id", R.measured([F.col("gt"), F.col("pred")], run, schema).alias("m")).select("vec_id", "m.*")


def mask_hull_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir, lambda m, chair, _: (m.sum(), chair.sum(), R.smooth_by_hull(m, chair).sum()), "n_set", "n_chair", "n_hull")


def mask_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seat's prior from the chair, and the mask flooded into it."""

    def measure(m: np.ndarray, chair: np.ndarray, _: np.ndarray) -> tuple:
        prior = R.seat_prior(chair)
        return prior.sum(), R.backfill(m, prior, 0.2, 0.2, 0.1).sum()

    return _measured(spark, sf_dir, measure, "n_prior", "n_backfill")


def mask_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    def measure(m: np.ndarray, chair: np.ndarray, _: np.ndarray) -> tuple:
        deep = R.deep_style(m, chair, 0.42)
        return deep.sum(), R.front_style(deep, 0.5).sum()

    return _measured(spark, sf_dir, measure, "n_deep", "n_front")


def mask_hip_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hip zone of a chair and how many candidates it gives; a chair under 20 pixels has neither."""

    def measure(m: np.ndarray, chair: np.ndarray, _: np.ndarray) -> tuple:
        zone = R.hip_zone(chair)
        return zone.sum(), len(R.zone_candidates(zone, *R.depth_axis(chair), 3)) if chair.sum() >= 20 else 0

    return _measured(spark, sf_dir, measure, "n_zone", "n_candidates")


def mask_seat_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a chair's mask to a geometry that sitting priors allow, and its contact polygon: rows, band, depth trim, outline, clean-up, repair."""
    small_batches(spark)
    rows = polygons(spark, sf_dir).select("vec_id", F.concat("gt", "pred").alias("points"))
    rows = fixed(fixed(rows, "hull", convex_hull(F.col("points"))), "chair", PHOTO.fill(F.col("hull")))
    rows = S.seat_bands(rows, "chair", PHOTO).where("seat IS NOT NULL")
    rows = fixed(S.contact_rows(rows, "chair", PHOTO), "axis", S.seat_axis(F.col("seat"), F.col("back")))
    rows = rows.withColumn("traced", S.traced(F.col("area"), F.col("axis"), PHOTO))
    rows = rows.withColumn("polygon", S.contact_polygon(F.col("traced.ring"), F.col("seat"), PHOTO))
    rows = fixed(rows, "told", F.struct(F.col("traced.n").alias("n_contact"), F.size("polygon").alias("n_polygon"))).select("vec_id", "seat", "floor", "back", "told.*")
    rows = P.repair(rows, FRAME, FRAME)
    return rows.select("vec_id", "ok", "n_contact", "n_polygon", r4(F.col("seat")[0]["x"]).alias("seat_x"), r4(F.col("seat")[0]["y"]).alias("seat_y"), r4(F.col("floor")[0]["y"]).alias("floor_y"), r4(F.col("back")[0]["y"]).alias("back_y"))


def mask_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outer border of a mask's largest part, whole and of the mask cut to a rectangle: its steps, the area it encloses, its box."""

    def measure(a: np.ndarray) -> dict:
        mask = R.fill(a / CELL, SIDE, SIDE)
        out = {}
        for kind, part in (("whole", mask), ("cut", R.Box(3, 4, 12, 11).cut(mask))):
            ring = R.border(R.largest_component(part))
            box = (*ring.min(axis=0).tolist(), *ring.max(axis=0).tolist()) if len(ring) else (0, 0, 0, 0)
            out[kind] = (len(ring), R.ring_area(ring), *box)
        return out

    told = "struct<n_pixels:int,ring_area:double,x_min:int,y_min:int,x_max:int,y_max:int>"
    rows = fixed(polygons(spark, sf_dir).select("vec_id", "gt"), "m", R.measured([F.col("gt")], measure, f"struct<whole:{told},cut:{told}>"))
    kinds = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"m.{kind}").alias("m")) for kind in ("whole", "cut")])).alias("k")
    rows = rows.select("vec_id", kinds).select("vec_id", "k.kind", "k.m.*").where("n_pixels > 0")
    steps = F.when(F.col("n_pixels") > 1, F.col("n_pixels")).otherwise(0).alias("n_steps")
    return rows.select("vec_id", "kind", steps, "ring_area", "x_min", "y_min", "x_max", "y_max")


# A border's area is what its pixels' centres enclose: of every two by two pixels, one where all are inside, a half where three are. By Pick's
# theorem its steps are twice the pixels inside and on it less twice the area less two.
MASK_OUTLINE = f"""WITH RECURSIVE {_sql_pixels("a", "v", 0)}, p AS (SELECT vec_id, 'whole' AS kind, y, x FROM a UNION ALL SELECT vec_id, 'cut', y, x FROM a WHERE y BETWEEN 4 AND 11 AND x BETWEEN 3 AND 12),
l AS (SELECT vec_id, kind, y, x, y*{SIDE}+x AS r FROM p UNION SELECT q.vec_id, q.kind, q.y, q.x, l.r FROM l JOIN p q ON q.vec_id=l.vec_id AND q.kind=l.kind AND abs(q.y-l.y)<=1 AND abs(q.x-l.x)<=1),
m AS (SELECT vec_id, kind, y, x, min(r) AS r FROM l GROUP BY ALL),
s AS (SELECT vec_id, kind, r, row_number() OVER (PARTITION BY vec_id, kind ORDER BY count(*) DESC, r) AS k FROM m GROUP BY vec_id, kind, r),
o AS (SELECT m.vec_id, m.kind, m.y, m.x FROM m JOIN s USING (vec_id, kind, r) WHERE k=1),
g AS (SELECT c.vec_id, c.kind, gy.g-1 AS y, gx.g-1 AS x FROM (SELECT DISTINCT vec_id, kind FROM o) c, range({SIDE + 2}) gy(g), range({SIDE + 2}) gx(g)),
f AS (SELECT g.* FROM g ANTI JOIN o USING (vec_id, kind, y, x)),
w AS (SELECT * FROM f WHERE y=-1 AND x=-1 UNION SELECT f.vec_id, f.kind, f.y, f.x FROM w JOIN f ON f.vec_id=w.vec_id AND f.kind=w.kind AND abs(f.y-w.y)+abs(f.x-w.x)=1),
i AS (SELECT g.* FROM g ANTI JOIN w USING (vec_id, kind, y, x)),
b AS (SELECT vec_id, kind, y-dy.d AS y, x-dx.d AS x, count(*) AS n FROM i, range(2) dy(d), range(2) dx(d) GROUP BY ALL),
e AS (SELECT vec_id, kind, sum(CASE n WHEN 4 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0 END)::DOUBLE AS ring_area FROM b GROUP BY ALL),
t AS (SELECT vec_id, kind, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM i GROUP BY ALL)
SELECT t.vec_id, t.kind, (2*(n-ring_area-1))::INTEGER AS n_steps, ring_area, x0::INTEGER AS x_min, y0::INTEGER AS y_min, x1::INTEGER AS x_max, y1::INTEGER AS y_max FROM t JOIN e USING (vec_id, kind)"""


def mask_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of whole photographs, 640 by 480, as bit words: areas, overlap, and dilated and eroded by a square of three."""
    stretched = lambda points: F.transform(points, lambda p: point(p["x"] * (WIDE.width / FRAME), p["y"] * (WIDE.height / FRAME)))
    rows = polygons(spark, sf_dir).select("vec_id", stretched(F.col("gt")).alias("p"), stretched(F.col("pred")).alias("q"))
    numbers = {
        "n_a": lambda make, a, _: make.count(a),
        "n_b": lambda make, _, b: make.count(b),
        "n_common": lambda make, a, b: make.count(a & b),
        "n_only_a": lambda make, a, b: make.count(a & ~b),
        "n_either": lambda make, a, b: make.count(a | b),
        "n_dilated": lambda make, a, _: make.count(make.dilate(a)),
        "n_eroded": lambda make, a, _: make.count(make.erode(a)),
    }
    rows = rows.select("vec_id", W.compared(F.col("p"), F.col("q"), WIDE, numbers).alias("m")).select("vec_id", "m.*")
    iou = r4(F.col("n_common") / F.greatest(F.lit(1), F.col("n_either"))).alias("iou")
    return rows.select("vec_id", "n_a", "n_b", "n_common", "n_only_a", iou, "n_dilated", "n_eroded")


def _sql_runs(name: str, points: str, first: int) -> str:
    """Runs [s, e) of set pixels by row of a polygon at full size, from pairs of crossings."""
    w, h = WIDE.width, WIDE.height
    return f"""{sql_points(points, first)}, {points}s AS (SELECT vec_id, label, i, x*({w}/{FRAME}::DOUBLE) AS x, y*({h}/{FRAME}::DOUBLE) AS y FROM {points}), {sql_edges(points + "e", points + "s")},
{points}c AS (SELECT vec_id, g AS y, greatest(0,least({w},ceil((sx-ex)*((g+0.5)-ey)/((sy-ey)+1e-8)+ex-0.5)))::INTEGER AS x FROM {points}e, range({h}) t(g) WHERE (sy>g+0.5) <> (ey>g+0.5)),
{points}n AS (SELECT *, row_number() OVER (PARTITION BY vec_id, y ORDER BY x) AS k, lead(x) OVER (PARTITION BY vec_id, y ORDER BY x) AS nx FROM {points}c),
{name} AS (SELECT vec_id, y, x AS s, nx AS e FROM {points}n WHERE k%2=1 AND nx>x)"""


def _sql_grown_runs(name: str, runs: str) -> str:
    """Runs grown by a pixel to all sides and merged."""
    w, h = WIDE.width, WIDE.height
    return f"""{name}r AS (SELECT vec_id, y+d.d-1 AS y, greatest(0,s-1) AS s, least({w},e+1) AS e FROM {runs}, range(3) d(d) WHERE y+d.d-1 BETWEEN 0 AND {h - 1}),
{name}m AS (SELECT *, max(e) OVER (PARTITION BY vec_id, y ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {name}r),
{name} AS (SELECT vec_id, sum(e-greatest(s,coalesce(reached,0))) FILTER (e>coalesce(reached,0)) AS n FROM {name}m GROUP BY vec_id)"""


MASK_WIDE = f"""WITH {_sql_runs("a", "v", 0)}, {_sql_runs("b", "w", 12)}, {_sql_grown_runs("d", "a")},
ends AS (SELECT vec_id, y, s, e FROM a UNION ALL SELECT vec_id, g, 0, 0 FROM embeddings, range({WIDE.height}) t(g)),
gaps AS (SELECT vec_id, y, e AS s, coalesce(lead(s) OVER (PARTITION BY vec_id, y ORDER BY s, e), {WIDE.width}) AS e FROM ends),
none AS (SELECT * FROM gaps WHERE e>s), {_sql_grown_runs("x", "none")},
na AS (SELECT vec_id, sum(e-s) AS n FROM a GROUP BY vec_id), nb AS (SELECT vec_id, sum(e-s) AS n FROM b GROUP BY vec_id),
c AS (SELECT a.vec_id, sum(least(a.e,b.e)-greatest(a.s,b.s)) AS n FROM a JOIN b ON a.vec_id=b.vec_id AND a.y=b.y AND a.s<b.e AND b.s<a.e GROUP BY a.vec_id)
SELECT vec_id, coalesce(na.n,0)::BIGINT AS n_a, coalesce(nb.n,0)::BIGINT AS n_b, coalesce(c.n,0)::BIGINT AS n_common, (coalesce(na.n,0)-coalesce(c.n,0))::BIGINT AS n_only_a,
  round(coalesce(c.n,0)/greatest(1,coalesce(na.n,0)+coalesce(nb.n,0)-coalesce(c.n,0))::DOUBLE,4) AS iou, coalesce(d.n,0)::BIGINT AS n_dilated, ({WIDE.width * WIDE.height}-coalesce(x.n,0))::BIGINT AS n_eroded
FROM embeddings LEFT JOIN na USING (vec_id) LEFT JOIN nb USING (vec_id) LEFT JOIN c USING (vec_id) LEFT JOIN d USING (vec_id) LEFT JOIN x USING (vec_id)"""

FUSED = 70


def mask_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of six masks: the best one, up to three partners by true overlap, their union, and what a band around the best one's prior leaves of it."""
    grid = Grid(FUSED, FUSED)
    rows = polygons(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 6).cast("long").alias("image"), "gt", "pred")
    rows = rows.join(table(spark, sf_dir, "embeddings").select("vec_id", F.greatest(F.lit(0.05), F.round(dim(24) + 0.5, 6)).alias("confidence")), "vec_id")
    masks = fixed(rows, "mask", grid.fill(F.col("gt"), FRAME / FUSED))
    fused = fuse_masks(masks, "image", "mask", "confidence", "vec_id", grid)
    priors = fixed(rows.select(F.col("vec_id").alias("best"), "pred"), "prior", grid.fill(F.col("pred"), FRAME / FUSED))
    used = F.filter(F.transform(grid.row_table(F.col("prior")), lambda r, y: F.when(r["n"] > 0, y)), lambda y: y.isNotNull())
    priors = fixed(priors, "rows", used).select("best", F.array_min("rows").alias("first"), F.array_max("rows").alias("last"))
    gated = fixed(fused.join(priors, "best"), "gated", band_gate(F.col("fused"), F.col("first"), F.col("last"), 0.18, 0.1, grid))
    lines = fixed(gated, "lines", F.filter(F.transform(grid.row_table(F.col("gated")), lambda r, y: F.struct(r["n"].alias("n"), r["first"].alias("first"), r["last"].alias("last"), y.alias("y"))), lambda r: r["n"] > 0))
    total = lambda value, name: F.aggregate("lines", F.lit(0).cast("long"), lambda n, r: n + value(r)).alias(name)
    return lines.select(
        "image", "best", "n_fused", W.count(F.col("fused")).alias("n_union"), W.count(F.col("gated")).alias("n_gated"), total(lambda r: r["y"] * r["n"], "y_sum"), total(lambda r: r["first"], "first_sum"), total(lambda r: r["last"], "last_sum")
    )


MASK_FUSION = f"""WITH {_sql_pixels("a", "v", 0, FUSED)}, {_sql_pixels("b", "w", 12, FUSED)},
n AS (SELECT a.vec_id, a.vec_id//6 AS image, count(*) AS area, greatest(0.05, round(any_value(embedding[25])::DOUBLE+0.5,6)) AS conf FROM a JOIN embeddings e USING (vec_id) GROUP BY a.vec_id HAVING count(*)>1),
o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY conf*area DESC, vec_id) AS k FROM n),
t AS (SELECT o.*, p.vec_id AS best, p.area AS b_area, p.conf AS b_conf FROM o JOIN o p ON p.image=o.image AND p.k=1),
c AS (SELECT t.vec_id, count(*) AS n FROM t JOIN a x ON x.vec_id=t.vec_id JOIN a y ON y.vec_id=t.best AND y.y=x.y AND y.x=x.x GROUP BY t.vec_id),
f AS (SELECT t.*, coalesce(c.n,0)/(area+b_area-coalesce(c.n,0))::DOUBLE AS iou FROM t LEFT JOIN c USING (vec_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY k) AS r FROM f WHERE k=1 OR (conf>=0.25*b_conf AND area BETWEEN 0.30*b_area AND 10.0*b_area AND iou BETWEEN 0.02 AND 0.70)),
u AS (SELECT DISTINCT image, best, y, x FROM h JOIN a USING (vec_id) WHERE r<=4),
z AS (SELECT vec_id AS best, min(y) AS y0, max(y) AS y1 FROM b GROUP BY vec_id),
q AS (SELECT best, greatest(0,round_even(y0-(y1-y0+1)*0.18,0))::INTEGER AS lo, least({FUSED - 1},round_even(y1+(y1-y0+1)*0.1,0))::INTEGER AS hi FROM z),
k AS (SELECT u.* FROM u LEFT JOIN q USING (best) WHERE NOT coalesce(hi>lo,false) OR y BETWEEN lo AND hi),
s AS (SELECT image, sum(n)::BIGINT AS n_gated, sum(y*n)::BIGINT AS y_sum, sum(x0)::BIGINT AS first_sum, sum(x1)::BIGINT AS last_sum FROM (SELECT image, y, count(*) AS n, min(x) AS x0, max(x) AS x1 FROM k GROUP BY image, y) GROUP BY image),
m AS (SELECT image, best, count(*) AS n_fused FROM h WHERE r<=4 GROUP BY ALL), w2 AS (SELECT image, count(*) AS n_union FROM u GROUP BY image)
SELECT image::BIGINT AS image, best, n_fused, n_union, coalesce(n_gated,0) AS n_gated, coalesce(y_sum,0) AS y_sum, coalesce(first_sum,0) AS first_sum, coalesce(last_sum,0) AS last_sum
FROM m JOIN w2 USING (image) LEFT JOIN s USING (image)"""


def mask_depth_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of depth that a mask is cut to, from the middle of the polygon's first side to that of its fourth, and the pixels left."""

    def run(a: np.ndarray) -> dict:
        mask = R.fill(a / CELL, SIDE, SIDE)
        back, front = (tuple((a[i] + a[i + 1]) / 2 / CELL) for i in (0, 3))
        chosen, kept = R.depth_range(mask, back, front, least=8)
        return {"n_set": int(mask.sum()), "low": chosen[0] if chosen else -1.0, "n_kept": int(kept.sum())}

    return polygons(spark, sf_dir).select("vec_id", R.measured([F.col("gt")], run, "struct<n_set:int,low:double,n_kept:int>").alias("m")).select("vec_id", "m.*")


MASK_DEPTH = f"""WITH {_sql_pixels("a", "v", 0)}, s AS (SELECT vec_id, (max(x) FILTER (i=0)+max(x) FILTER (i=1))/2/{CELL} AS bx, (max(y) FILTER (i=0)+max(y) FILTER (i=1))/2/{CELL} AS b_y,
  (max(x) FILTER (i=3)+max(x) FILTER (i=4))/2/{CELL} AS fx, (max(y) FILTER (i=3)+max(y) FILTER (i=4))/2/{CELL} AS f_y FROM v GROUP BY vec_id),
w AS (SELECT *, fx-bx AS dx, f_y-b_y AS dy, (fx-bx)*(fx-bx)+(f_y-b_y)*(f_y-b_y) AS n2 FROM s),
r AS (SELECT vec_id, bx, b_y, dx, dy, n2, unnest(CASE WHEN abs(dy)/sqrt(greatest(n2,1e-8))>=0.75 THEN [[0.32,0.86],[0.28,0.90],[0.24,0.92]] WHEN abs(dy)/sqrt(greatest(n2,1e-8))>=0.55 THEN [[0.26,0.90],[0.22,0.93],[0.18,0.95]] ELSE [[0.20,0.95],[0.16,0.96]] END)::DOUBLE[] AS lim FROM w),
t AS (SELECT vec_id, count(*) AS n FROM a GROUP BY vec_id),
k AS (SELECT r.vec_id, lim[1] AS low, count(*) FILTER (((x-bx)*dx+(y-b_y)*dy)/n2 >= lim[1] AND ((x-bx)*dx+(y-b_y)*dy)/n2 <= lim[2]) AS kept FROM r JOIN a USING (vec_id) GROUP BY r.vec_id, lim[1], lim[2]),
f AS (SELECT vec_id, low, kept, row_number() OVER (PARTITION BY vec_id ORDER BY low DESC) AS o FROM k JOIN t USING (vec_id) WHERE kept >= greatest(8, floor(0.36*n)))
SELECT e.vec_id, coalesce(t.n,0)::INTEGER AS n_set, coalesce(f.low,-1.0)::DOUBLE AS low, coalesce(f.kept,t.n,0)::INTEGER AS n_kept FROM embeddings e LEFT JOIN t USING (vec_id) LEFT JOIN f ON f.vec_id=e.vec_id AND f.o=1"""


BANDS = ("own", "prior", "sides", "rows", "filled")


def mask_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks cut by the widths of their rows: the largest part, the seat's prior of a chair painted from end to end of its rows, margins off the sides,
    the run of rows around the widest with a row beside it, and the prior filled from the mask; pixels and the sum of their numbers, for each that has any."""

    def measure(a: np.ndarray, b: np.ndarray) -> dict:
        mask = R.fill(a / CELL, SIDE, SIDE)
        either = mask | R.fill(b / CELL, SIDE, SIDE)
        first, widths = either.argmax(axis=1), R.row_widths(either)
        prior = R.seat_prior(R.painted(first, first + widths - 1, SIDE))
        made = (R.largest_component(mask), prior, R.trim_sides(mask, 0.1, 1), R.trim_rows(mask, 0.68, 1), R.backfill(mask, prior, 0.2, 0.2, 0.1))
        return {op: (int(m.sum()), int(np.flatnonzero(m).sum())) for op, m in zip(BANDS, made)}

    told = "struct<n:int,digest:long>"
    rows = fixed(polygons(spark, sf_dir).select("vec_id", "gt", "pred"), "m", R.measured([F.col("gt"), F.col("pred")], measure, f"struct<{','.join(f'{op}:{told}' for op in BANDS)}>"))
    kinds = F.explode(F.array(*[F.struct(F.lit(op).alias("op"), F.col(f"m.{op}.n").alias("n"), F.col(f"m.{op}.digest").alias("digest")) for op in BANDS])).alias("k")
    return rows.select("vec_id", kinds).select("vec_id", "k.*").where("n > 0")


def _sql_largest(name: str, pixels: str, groups: str = "vec_id, op") -> str:
    """The largest eight-neighbour component of each group's pixels, the first on a tie."""
    keys = groups.split(", ")
    same = " AND ".join(f"q.{k}={name}_l.{k}" for k in keys)
    return f"""{name}_l AS (SELECT {groups}, y, x, y*{SIDE}+x AS r FROM {pixels} UNION SELECT {", ".join(f"q.{k}" for k in keys)}, q.y, q.x, {name}_l.r FROM {name}_l JOIN {pixels} q ON {same} AND abs(q.y-{name}_l.y)<=1 AND abs(q.x-{name}_l.x)<=1),
{name}_m AS (SELECT {groups}, y, x, min(r) AS r FROM {name}_l GROUP BY ALL), {name}_s AS (SELECT {groups}, r, row_number() OVER (PARTITION BY {groups} ORDER BY count(*) DESC, r) AS k FROM {name}_m GROUP BY {groups}, r),
{name} AS (SELECT {groups}, y, x FROM {name}_m JOIN {name}_s USING ({groups}, r) WHERE k=1)"""


MASK_BANDS = f"""WITH RECURSIVE {BOTH}, s AS (SELECT vec_id, y, min(x) AS l, max(x) AS r, max(x)-min(x)+1 AS w FROM a GROUP BY vec_id, y),
c AS (SELECT vec_id, y, min(x) AS l, max(x) AS r, max(x)-min(x)+1 AS w FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY vec_id, y),
h AS (SELECT vec_id, min(y) AS y0, max(y) AS y1, max(y)-min(y)+1 AS h FROM c GROUP BY vec_id HAVING sum(w)>=20),
pb AS (SELECT vec_id, y0+round_even(0.34*h,0) AS lo, least(y1, y0+round_even(0.70*h,0)) AS hi FROM h),
pr AS (SELECT vec_id, y, least(l+round_even(0.12*w,0),{SIDE - 1})::INTEGER AS l, greatest(r-round_even(0.12*w,0), least(l+round_even(0.12*w,0),{SIDE - 1}))::INTEGER AS r FROM c JOIN pb USING (vec_id) WHERE hi>lo AND y BETWEEN lo AND hi),
st AS (SELECT *, greatest(1,round_even(0.1*w,0))::INTEGER AS t0 FROM s), su AS (SELECT *, CASE WHEN t0*2>=w-2 THEN greatest(0,floor((w-3)/2.0))::INTEGER ELSE t0 END AS t FROM st),
sd AS (SELECT vec_id, y, CASE WHEN r-t<=l+t THEN l ELSE l+t END AS l, CASE WHEN r-t<=l+t THEN r ELSE r-t END AS r FROM su),
f AS (SELECT e.vec_id, g.g AS y, coalesce(s.w,0) AS w FROM (SELECT DISTINCT vec_id FROM a) e CROSS JOIN range({SIDE}) g(g) LEFT JOIN s ON s.vec_id=e.vec_id AND s.y=g.g),
pk AS (SELECT vec_id, max(w) AS w, arg_max(y, (w, -y)) AS peak FROM f GROUP BY vec_id),
nr AS (SELECT f.vec_id, any_value(pk.w) AS w, coalesce(max(f.y) FILTER (f.y<peak AND f.w<greatest(1,round_even(0.68*pk.w,0)))+1, 0)-1 AS lo, coalesce(min(f.y) FILTER (f.y>peak AND f.w<greatest(1,round_even(0.68*pk.w,0)))-1, {SIDE - 1})+1 AS hi FROM f JOIN pk USING (vec_id) GROUP BY f.vec_id),
p AS (SELECT vec_id, 'own' AS op, y, x FROM a UNION ALL SELECT vec_id, 'prior', y, g FROM pr, range({SIDE}) t(g) WHERE g BETWEEN l AND r UNION ALL SELECT vec_id, 'sides', y, g FROM sd, range({SIDE}) t(g) WHERE g BETWEEN l AND r
 UNION ALL SELECT a.vec_id, 'rows', y, x FROM a JOIN nr USING (vec_id) WHERE w>1 AND y BETWEEN lo AND hi),
{_sql_largest("o", "p")},
bx AS (SELECT vec_id, op, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM o WHERE op IN ('own','prior') GROUP BY ALL),
br AS (SELECT m.vec_id, greatest(m.x0-greatest(2,round_even(0.2*(q.x1-q.x0+1),0)),q.x0) AS x0, least(m.x1+greatest(2,round_even(0.2*(q.x1-q.x0+1),0)),q.x1) AS x1,
  greatest(m.y0-greatest(2,round_even(0.2*(q.y1-q.y0+1),0)),q.y0) AS y0, least(m.y1+greatest(1,round_even(0.1*(q.y1-q.y0+1),0)),q.y1) AS y1 FROM bx m JOIN bx q ON q.vec_id=m.vec_id AND q.op='prior' WHERE m.op='own'),
re AS (SELECT o.vec_id, o.y, o.x FROM o JOIN br USING (vec_id) WHERE op='prior' AND br.x1>br.x0 AND br.y1>br.y0 AND x BETWEEN br.x0 AND br.x1 AND y BETWEEN br.y0 AND br.y1),
fl AS (SELECT re.vec_id, re.y, re.x, 0 AS n FROM re JOIN o USING (vec_id, y, x) WHERE op='own' UNION SELECT re.vec_id, re.y, re.x, n+1 FROM fl JOIN re ON re.vec_id=fl.vec_id AND abs(re.y-fl.y)<=1 AND abs(re.x-fl.x)<=1 WHERE n<40),
fp AS (SELECT DISTINCT vec_id, y, x FROM fl), {_sql_largest("k", "fp", "vec_id")},
z AS (SELECT * FROM o UNION ALL SELECT vec_id, 'rows', y, x FROM a JOIN nr USING (vec_id) WHERE w<=1 UNION ALL SELECT vec_id, 'filled', y, x FROM k UNION ALL SELECT vec_id, 'filled', y, x FROM o WHERE op='own' AND vec_id NOT IN (SELECT vec_id FROM fp))
SELECT vec_id, op, count(*)::INTEGER AS n, sum(y*{SIDE}+x)::BIGINT AS digest FROM z GROUP BY vec_id, op"""


def mask_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hip zone of every mask, by distance to its edge and depth, with the weights of the points sampled from it; and its deep and front styles."""

    def measure(a: np.ndarray, b: np.ndarray) -> dict:
        mask = R.fill(a / CELL, SIDE, SIDE)
        either = mask | R.fill(b / CELL, SIDE, SIDE)
        first, widths = either.argmax(axis=1), R.row_widths(either)
        zone = R.hip_zone(mask)
        told = R.zone_candidates(zone, *R.depth_axis(mask), 3) if zone.any() else []
        deep = R.deep_style(mask, R.painted(first, first + widths - 1, SIDE), 0.42)
        out = {"n_points": len(told), "weight": sum(p["weight"] for p in told)}
        for name, m in (("zone", zone), ("deep", deep), ("front", R.front_style(deep, 0.5))):
            out |= {f"n_{name}": int(m.sum()), f"{name}_sum": int(np.flatnonzero(m).sum())}
        return out

    schema = "struct<n_points:int,weight:double,n_zone:int,zone_sum:long,n_deep:int,deep_sum:long,n_front:int,front_sum:long>"
    rows = fixed(polygons(spark, sf_dir).select("vec_id", "gt", "pred"), "m", R.measured([F.col("gt"), F.col("pred")], measure, schema))
    return rows.select("vec_id", "m.*").withColumn("weight", F.round("weight", 2))


def _sql_mended(name: str, src: str) -> str:
    """A mask closed by a square of five, and its largest part."""
    near = "abs(q.y-p.y)<=2 AND abs(q.x-p.x)<=2"
    cells = f"(SELECT gy.g AS y, gx.g AS x FROM range({SIDE}) gy(g), range({SIDE}) gx(g))"
    return f"""{name}_d AS (SELECT DISTINCT q0.vec_id, p.y, p.x FROM {src} q0 JOIN {cells} p ON abs(q0.y-p.y)<=2 AND abs(q0.x-p.x)<=2),
{name}_c AS (SELECT k.vec_id, k.y, k.x FROM (SELECT p.vec_id, p.y, p.x, count(*) AS n FROM {name}_d p JOIN {name}_d q ON q.vec_id=p.vec_id AND {near} GROUP BY ALL) k
  WHERE n=(least({SIDE - 1},k.y+2)-greatest(0,k.y-2)+1)*(least({SIDE - 1},k.x+2)-greatest(0,k.x-2)+1)), {_sql_largest(name, name + "_c", "vec_id")}"""


MASK_ZONES = f"""WITH RECURSIVE {BOTH},
c AS (SELECT vec_id, y, min(x) AS l, max(x) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY vec_id, y),
rw AS (SELECT vec_id, y, count(*) AS n, sum(x) AS sx FROM a GROUP BY vec_id, y),
u AS (SELECT vec_id, min(y) AS y0, max(y) AS y1, sum(n) AS n, greatest(4.0,max(y)-min(y))::DOUBLE AS tall FROM rw GROUP BY vec_id),
sh AS (SELECT vec_id, any_value(y0) AS y0, any_value(y1) AS y1, any_value(tall) AS tall, CASE WHEN coalesce(sum(rw.n) FILTER (y<=y0+0.18::DOUBLE*tall),0)>=20 THEN 0.18::DOUBLE ELSE 0.25::DOUBLE END AS sb,
  CASE WHEN coalesce(sum(rw.n) FILTER (y>=y0+(1-0.18::DOUBLE)*tall),0)>=20 THEN 0.18::DOUBLE ELSE 0.25::DOUBLE END AS sf FROM rw JOIN u USING (vec_id) GROUP BY vec_id),
en AS (SELECT vec_id, sum(sx) FILTER (y<=y0+sb*tall)/sum(n) FILTER (y<=y0+sb*tall)::DOUBLE AS bx, sum(n*y) FILTER (y<=y0+sb*tall)/sum(n) FILTER (y<=y0+sb*tall)::DOUBLE AS b_y,
  coalesce(sum(sx) FILTER (y>=y0+(1-sf)*tall)/sum(n) FILTER (y>=y0+(1-sf)*tall)::DOUBLE, sum(sx) FILTER (y=y1)/sum(n) FILTER (y=y1)::DOUBLE) AS fx,
  coalesce(sum(n*y) FILTER (y>=y0+(1-sf)*tall)/sum(n) FILTER (y>=y0+(1-sf)*tall)::DOUBLE, sum(n*y) FILTER (y=y1)/sum(n) FILTER (y=y1)::DOUBLE) AS f_y FROM rw JOIN sh USING (vec_id) GROUP BY vec_id),
ax AS (SELECT vec_id, bx, b_y, fx-bx AS wx, f_y-b_y AS wy, CASE WHEN power(fx-bx,2)+power(f_y-b_y,2)<1e-6 THEN 0.0 ELSE fx-bx END AS dx, CASE WHEN power(fx-bx,2)+power(f_y-b_y,2)<1e-6 THEN 1.0 ELSE f_y-b_y END AS dy FROM en),
gr AS (SELECT gy.g-1 AS y, gx.g-1 AS x FROM range({SIDE + 2}) gy(g), range({SIDE + 2}) gx(g)),
off AS (SELECT e.vec_id, gr.y, gr.x FROM (SELECT DISTINCT vec_id FROM a) e, gr WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.vec_id=e.vec_id AND a.y=gr.y AND a.x=gr.x)),
ed AS (SELECT a.vec_id, a.y, a.x, min(power(a.y-off.y,2)+power(a.x-off.x,2)) AS d2 FROM a JOIN off USING (vec_id) GROUP BY a.vec_id, a.y, a.x),
pt AS (SELECT ed.vec_id, ed.y, ed.x, sqrt(d2) AS away, ((x-bx)*dx+(y-b_y)*dy)/(dx*dx+dy*dy) AS t, least(greatest(0.045*sqrt(u.n),4.0),30.0) AS margin FROM ed JOIN ax USING (vec_id) JOIN u USING (vec_id) WHERE u.n>=20),
li(op, share, least_, lo, hi) AS (VALUES (1, 1.0::DOUBLE, 4.0::DOUBLE, 0.30::DOUBLE, 0.86::DOUBLE), (2, 0.5::DOUBLE, 2.0::DOUBLE, 0.22::DOUBLE, 0.92::DOUBLE)),
zp AS (SELECT vec_id, op, y, x FROM pt, li WHERE away>=greatest(least_, share*margin) AND t BETWEEN lo AND hi), {_sql_largest("zl", "zp")},
zc AS (SELECT vec_id, op, count(*) AS n FROM zl GROUP BY ALL), zo AS (SELECT vec_id, CASE WHEN max(n) FILTER (op=1)>=80 THEN 1 ELSE 2 END AS op FROM zc GROUP BY vec_id),
zn AS (SELECT zl.vec_id, y, x FROM zl JOIN zo USING (vec_id, op)),
za AS (SELECT zn.vec_id, y, x, ((x-bx)*dx+(y-b_y)*dy)/(dx*dx+dy*dy) AS t, CASE WHEN sqrt(wx*wx+wy*wy)>=1e-6 THEN (-wy*(x-bx)+wx*(y-b_y))/sqrt(wx*wx+wy*wy) ELSE x-bx END AS p, min(x) OVER v AS x0, min(y) OVER v AS y0 FROM zn JOIN ax USING (vec_id) WINDOW v AS (PARTITION BY zn.vec_id)),
zb AS (SELECT *, min(p) OVER v AS lo, max(p) OVER v AS hi FROM za WINDOW v AS (PARTITION BY vec_id)),
zw AS (SELECT vec_id, count(*) AS k, sum(round(least(1.0,greatest(0.0,exp(-0.5*power((t-0.52)/0.20,2))*exp(-0.5*power(((p-lo)/greatest(1e-6,hi-lo)-0.50)/0.33,2)))),4)) AS w FROM zb WHERE (x-x0)%3=0 AND (y-y0)%3=0 GROUP BY vec_id),
zt AS (SELECT vec_id, count(*) AS n, sum(y*{SIDE}+x) AS d FROM zn GROUP BY vec_id),
{_sql_largest("o", "a", "vec_id")},
oh AS (SELECT vec_id, min(y) AS y0, max(y) AS y1, max(y)-min(y)+1 AS h FROM o GROUP BY vec_id),
ok AS (SELECT *, floor(greatest(3,round_even(0.42*h,0))/2)::INTEGER AS half FROM oh),
dl AS (SELECT DISTINCT o.vec_id, c.y, g.g AS x FROM o JOIN ok USING (vec_id) JOIN c ON c.vec_id=o.vec_id AND abs(c.y-o.y)<=ok.half, range({SIDE}) g(g) WHERE abs(g.g-o.x)<=2 AND g.g BETWEEN c.l AND c.r AND c.y BETWEEN round_even(ok.y0-1.1*ok.h,0) AND round_even(ok.y1+0.35*ok.h,0)),
{_sql_mended("dp", "dl")},
dh AS (SELECT vec_id, max(y) AS y1, greatest(1,round_even(0.5*(max(y)-min(y)+1),0)) AS keep FROM dp GROUP BY vec_id), fr AS (SELECT dp.* FROM dp JOIN dh USING (vec_id) WHERE y>=y1-keep+1),
{_sql_mended("ft", "fr")},
dt AS (SELECT vec_id, count(*) AS n, sum(y*{SIDE}+x) AS d FROM dp GROUP BY vec_id), tt AS (SELECT vec_id, count(*) AS n, sum(y*{SIDE}+x) AS d FROM ft GROUP BY vec_id)
SELECT e.vec_id, CASE WHEN zt.n IS NULL THEN 0 ELSE coalesce(zw.k,1) END::INTEGER AS n_points, round(CASE WHEN zt.n IS NULL THEN 0.0 ELSE coalesce(zw.w,1.0) END,2)::DOUBLE AS weight, coalesce(zt.n,0)::INTEGER AS n_zone, coalesce(zt.d,0)::BIGINT AS zone_sum,
 coalesce(dt.n,0)::INTEGER AS n_deep, coalesce(dt.d,0)::BIGINT AS deep_sum, coalesce(tt.n,0)::INTEGER AS n_front, coalesce(tt.d,0)::BIGINT AS front_sum
FROM embeddings e LEFT JOIN zt USING (vec_id) LEFT JOIN zw USING (vec_id) LEFT JOIN dt USING (vec_id) LEFT JOIN tt USING (vec_id)"""


QUERIES = {
    "mask_iou": (mask_iou, MASK_IOU),
    "mask_set_ops": (mask_set_ops, MASK_SET_OPS),
    "mask_morph": (mask_morph, MASK_MORPH),
    "mask_largest_cc": (mask_largest_cc, MASK_CC),
    "mask_profile_trim": (mask_profile_trim, None),
    "mask_hull_smooth": (mask_hull_smooth, None),
    "mask_backfill": (mask_backfill, None),
    "mask_styles": (mask_styles, None),
    "mask_depth_trim": (mask_depth_trim, MASK_DEPTH),
    "mask_hip_zone": (mask_hip_zone, None),
    "mask_seat_geometry": (mask_seat_geometry, None),
    "mask_outline": (mask_outline, MASK_OUTLINE),
    "mask_bands": (mask_bands, MASK_BANDS),
    "mask_zones": (mask_zones, MASK_ZONES),
    "mask_wide": (mask_wide, MASK_WIDE),
    "mask_fusion": (mask_fusion, MASK_FUSION),
}
