"""Queries over seat geometries and poses made of the embeddings: seat, floor and back from dimensions 0-7, 8-11 and 12-15."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions.arrays import fixed
from tessera.operators import documents as D
from tessera.operators import pose as P
from tessera.operators import validate as V
from tessera.plans.common import FRAME, dim, polygon, r4, sql_edges, sql_points
from tessera.session import table


def geometries(spark: SparkSession, sf_dir: str, loose: bool = False) -> DataFrame:
    """vec_id, seat, floor, back; loose ones may leave the frame."""
    fit = {"spread": 300.0, "shift": -38.0, "low": None} if loose else {}
    g = F.struct(polygon(0, 4, **fit).alias("seat"), polygon(8, 2, **fit).alias("floor"), polygon(12, 2, **fit).alias("back"))
    return fixed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "g", g).select("vec_id", "g.*")


def sql_geometry(loose: bool = False) -> str:
    more = {"spread": 300.0, "shift": -38.0, "clamped": False} if loose else {}
    return f"{sql_points('v', 0, 4, **more)}, {sql_points('f', 8, 2, **more)}, {sql_points('k', 12, 2, **more)}, {sql_edges('e', 'v')}"


def geometry_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geometries(spark, sf_dir, loose=True)
    width = F.when(F.col("vec_id") % 50 == 7, 0).otherwise(FRAME)
    rows = fixed(rows, "errors", V.geometry_errors(F.col("seat"), F.col("floor"), F.col("back"), width, F.lit(FRAME)))
    return rows.select("vec_id", F.size("errors").alias("n_errors"), F.concat_ws("; ", "errors").alias("errors"))


def _sql_bounds(name: str, label: str, at: int) -> str:
    return f"""SELECT vec_id, {at}+i*2 AS o, '{label}['||i||'].x out of bounds' AS m FROM {name} WHERE x<0 OR x>223
 UNION ALL SELECT vec_id, {at}+i*2+1, '{label}['||i||'].y out of bounds' FROM {name} WHERE y<0 OR y>223"""


GEOMETRY_VALIDATE = f"""WITH {sql_geometry(True)}, p AS ({_sql_bounds("v", "seat_region", 0)} UNION ALL {_sql_bounds("f", "floor_line", 10)} UNION ALL {_sql_bounds("k", "backrest_region", 20)}),
s AS (SELECT vec_id, abs(sum(sx*ey-ex*sy))*0.5 AS area FROM e GROUP BY vec_id),
l AS (SELECT a.vec_id, sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)) AS n FROM f a JOIN f b ON a.vec_id=b.vec_id AND a.i=0 AND b.i=1),
q AS (SELECT a.vec_id, sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)) AS n FROM k a JOIN k b ON a.vec_id=b.vec_id AND a.i=0 AND b.i=1),
t AS (SELECT s.vec_id, (SELECT string_agg(m,'; ' ORDER BY o) FROM p WHERE p.vec_id=s.vec_id) AS ms, (SELECT count(*) FROM p WHERE p.vec_id=s.vec_id) AS c, area, l.n AS fl, q.n AS bl FROM s JOIN l USING (vec_id) JOIN q USING (vec_id)),
u AS (SELECT vec_id, c, CASE WHEN vec_id%50=7 THEN 'image_width must be a positive integer' WHEN c>0 THEN ms WHEN area<100.352 THEN 'seat_region is degenerate' WHEN fl<11.2 THEN 'floor_line too short' WHEN bl<10 THEN 'backrest_region too short' ELSE '' END AS errors FROM t)
SELECT vec_id, (CASE WHEN errors='' THEN 0 WHEN vec_id%50=7 THEN 1 ELSE greatest(c,1) END)::INTEGER AS n_errors, errors FROM u"""


def prior_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geometries(spark, sf_dir)
    issues = V.prior_issues(F.col("seat"), F.col("floor"), F.col("back"), F.lit(FRAME))
    return rows.select("vec_id", issues.alias("i")).select("vec_id", F.size("i").alias("n_issues"), F.concat_ws("; ", "i").alias("issues"))


SQL_ISSUES = f"""{sql_geometry()}, m AS (SELECT vec_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, greatest(1.0,max(y)-min(y)) AS th FROM v GROUP BY vec_id),
fl AS (SELECT vec_id, max(x) FILTER (i=0) AS ax, max(y) FILTER (i=0) AS ay, max(x) FILTER (i=1) AS bx, max(y) FILTER (i=1) AS "by", (max(y) FILTER (i=0)+max(y) FILTER (i=1))*0.5 AS fy FROM f GROUP BY vec_id),
bk AS (SELECT vec_id, (max(x) FILTER (i=0)+max(x) FILTER (i=1))*0.5 AS kx, (max(y) FILTER (i=0)+max(y) FILTER (i=1))*0.5 AS ky FROM k GROUP BY vec_id),
i AS (SELECT vec_id, concat_ws('; ', CASE WHEN th<0.04*224 THEN 'seat height too small for a usable seat' END, CASE WHEN th>0.28*224 THEN 'seat height too large for a realistic seat slab' END,
 CASE WHEN y0>0.74*224 THEN 'seat top is unrealistically close to bottom of image' END, CASE WHEN y1>0.90*224 THEN 'seat bottom is unrealistically low' END,
 CASE WHEN fy<=y1+0.08*224 THEN 'floor line is not sufficiently below seat' END, CASE WHEN fy<0.62*224 THEN 'floor line is unrealistically high' END,
 CASE WHEN ky>y0+0.06*224 THEN 'backrest is not above seat region' END) AS issues FROM m JOIN fl USING (vec_id) JOIN bk USING (vec_id))"""
PRIOR_ISSUES = f"WITH {SQL_ISSUES} SELECT vec_id, (CASE WHEN issues='' THEN 0 ELSE len(string_split(issues,'; ')) END)::INTEGER AS n_issues, issues FROM i"


def local_check_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local checks of the fallback pose, and the lesser of their sum and a recorded score."""
    rows = geometries(spark, sf_dir)
    pose = P.fallback_pose(F.col("seat"), F.col("floor"), FRAME, FRAME, F.col("vec_id") % 3 == 0)
    rows = fixed(rows, "p", F.struct(*[p.alias(n) for n, p in pose.items()]))
    checks = P.local_checks(F.col("seat"), F.col("floor"), {n: F.col(f"p.{n}") for n in pose}, FRAME)
    rows = fixed(rows, "c", F.struct(*[c.alias(n) for n, c in checks.items()]))
    total = sum((F.col(f"c.{n}") for n in P.CHECKS[1:]), F.col(f"c.{P.CHECKS[0]}"))
    told = (F.col("vec_id") % 5).cast("int")
    return rows.select("vec_id", r4(F.col("p.hip_center.x")).alias("hip_x"), r4(F.col("p.left_ankle.y")).alias("left_ankle_y"), r4(F.col("p.right_wrist.x")).alias("right_wrist_x"),
                       "c.*", total.alias("local_score"), F.least(total, told).alias("effective_score"))


_C = lambda v, lo, hi: f"greatest({lo},least({hi},{v}))"


def _sql_foot(sign: str) -> str:
    want = _C(f"hx{sign}18.0", "0.0", "223.0")
    t = _C(f"(({want}-ax)*(bx-ax)+(fy-ay)*(\"by\"-ay))/greatest(power(bx-ax,2)+power(\"by\"-ay,2),1e-8)", "0.08", "0.92")
    fy = f"CASE WHEN power(bx-ax,2)+power(\"by\"-ay,2)<1e-8 THEN fy ELSE {_C(f'ay+{t}*(\"by\"-ay)', '0.0', '223.0')} END"
    return f"round_even(CASE WHEN power(bx-ax,2)+power(\"by\"-ay,2)<1e-8 THEN {want} ELSE {_C(f'ax+{t}*(bx-ax)', '0.0', '223.0')} END,2) AS fx{'l' if sign == '-' else 'r'}, round_even({_C(f'greatest({fy},y1+0.04*224)', '0.0', '223.0')},2) AS fy{'l' if sign == '-' else 'r'}"


SQL_DIST = lambda x, y: f"CASE WHEN power(bx-ax,2)+power(\"by\"-ay,2)<1e-8 THEN sqrt(power({x}-ax,2)+power({y}-ay,2)) ELSE sqrt(power({x}-(ax+{_C(f'(({x}-ax)*(bx-ax)+({y}-ay)*(\"by\"-ay))/(power(bx-ax,2)+power(\"by\"-ay,2))', '0.0', '1.0')}*(bx-ax)),2)+power({y}-(ay+{_C(f'(({x}-ax)*(bx-ax)+({y}-ay)*(\"by\"-ay))/(power(bx-ax,2)+power(\"by\"-ay,2))', '0.0', '1.0')}*(\"by\"-ay)),2)) END"
LOCAL_CHECK = f"""WITH {SQL_ISSUES}, h AS (SELECT vec_id, m.*, fl.*, (x0+x1)*0.5 AS hx, {_C("y0+0.55*(y1-y0)", "0.0", "223.0")} AS hy0 FROM m JOIN fl USING (vec_id)),
g AS (SELECT *, CASE WHEN vec_id%3=0 THEN {_C("hy0+0.02*224", "0.0", "223.0")} ELSE hy0 END AS hy FROM h),
p AS (SELECT *, round_even(hx,2) AS px, round_even(hy,2) AS py, round_even({_C("hy+0.20*224", "y1+0.04*224", "fy-0.12*224")},2) AS kny, round_even({_C("hy-0.22*224", "0.0", "223.0")},2) AS shy, {_sql_foot("-")}, {_sql_foot("+")},
   round_even({_C(_C(_C("hx+24.0", "0.0", "223.0") + "+8.0", "0.0", "223.0") + "+8.0", "0.0", "223.0")},2) AS rw FROM g),
hit AS (SELECT p.vec_id, sum(CASE WHEN (sy>py) <> (ey>py) AND px < (sx-ex)*(py-ey)/((sy-ey)+1e-8)+ex THEN 1 ELSE 0 END)%2=1 AS inside FROM p JOIN e USING (vec_id) GROUP BY p.vec_id),
c AS (SELECT vec_id, px, fyl, rw, inside::INTEGER AS c1, (kny>=py-11.2)::INTEGER AS c2,
  (fyl>y1+4.48 AND fyr>y1+4.48 AND {SQL_DIST("fxl", "fyl")}<=33.6 AND {SQL_DIST("fxr", "fyr")}<=33.6)::INTEGER AS c3,
  (kny BETWEEN least(py,fyl)-11.2 AND greatest(py,fyl)+11.2 AND kny BETWEEN least(py,fyr)-11.2 AND greatest(py,fyr)+11.2 AND shy<=py+11.2)::INTEGER AS c4 FROM p JOIN hit USING (vec_id))
SELECT vec_id, px AS hip_x, fyl AS left_ankle_y, rw AS right_wrist_x, c1 AS hip_on_seat, c2 AS knees_in_front_of_hip, c3 AS ankles_below_seat_near_floor, c4 AS limb_ordering_consistent,
 c1+c2+c3+c4 AS local_score, least(c1+c2+c3+c4,(vec_id%5)::INTEGER) AS effective_score FROM c"""


def fallback_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's geometry if it is valid and plausible, one from parts if the model's is valid, else the canonical one."""
    rows = geometries(spark, sf_dir)
    told = F.col("seat"), F.col("floor"), F.col("back")
    rows = fixed(rows, "e", V.geometry_errors(*told, F.lit(FRAME), F.lit(FRAME)))
    rows = fixed(rows, "i", V.prior_issues(*told, F.lit(FRAME)))
    seat, floor, back = P.canonical(FRAME, FRAME)
    valid, good = F.size("e") == 0, F.size("i") == 0
    source = F.when(valid & good, "model").when(valid & (F.size("i") <= 2), "parts").otherwise("canonical")
    rows = rows.select("vec_id", source.alias("source"), *told)
    pick = lambda own, other: F.when(F.col("source") == "canonical", other).otherwise(own)
    rows = rows.select("vec_id", "source", pick(told[0], seat).alias("s"), pick(told[1], floor).alias("f"))
    status = F.when(F.col("source") == "model", "ok").when(F.col("source") == "parts", "low_score").otherwise("failed")
    return rows.select("vec_id", "source", status.alias("status"), r4(G.polygon_area(F.col("s"))).alias("seat_area"), r4((F.col("f")[0]["y"] + F.col("f")[1]["y"]) * 0.5).alias("floor_y"))


FALLBACK = f"""WITH {SQL_ISSUES}, a AS (SELECT vec_id, abs(sum(sx*ey-ex*sy))*0.5 AS area FROM e GROUP BY vec_id),
bl AS (SELECT a.vec_id, sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)) AS n FROM k a JOIN k b ON a.vec_id=b.vec_id AND a.i=0 AND b.i=1),
s AS (SELECT vec_id, area, fy, CASE WHEN issues='' THEN 0 ELSE len(string_split(issues,'; ')) END AS n, area>=100.352 AND sqrt(power(ax-bx,2)+power(ay-"by",2))>=11.2 AND bl.n>=10 AS valid
  FROM i JOIN a USING (vec_id) JOIN fl USING (vec_id) JOIN bl USING (vec_id)),
t AS (SELECT *, CASE WHEN valid AND n=0 THEN 'model' WHEN valid AND n<=2 THEN 'parts' ELSE 'canonical' END AS source FROM s)
SELECT vec_id, source, CASE source WHEN 'model' THEN 'ok' WHEN 'parts' THEN 'low_score' ELSE 'failed' END AS status,
 round(CASE WHEN source='canonical' THEN (161.28-62.72)*(138.88-116.48) ELSE area END,4) AS seat_area, round(CASE WHEN source='canonical' THEN 197.12 ELSE fy END,4) AS floor_y FROM t"""


def hip_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the five heaviest contact points of each seat, by rounded weight and then in scan order, with a row for a seat that has none; seat_candidates has all."""
    seats = geometries(spark, sf_dir).select("vec_id", "seat", "back")
    rows = P.contact_candidates(seats, FRAME, FRAME)
    order = Window.partitionBy("vec_id").orderBy(F.col("weight").desc(), "y", "x")
    best = rows.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("vec_id", "rank", "x", "y", "weight", "depth_t")
    return seats.select("vec_id").join(best, "vec_id", "left")


def seat_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contact points of each seat, by rounded weight and then in scan order; every second seat has a contact region of its own."""
    rows = geometries(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    contact = F.when(F.col("vec_id") % 2 == 1, polygon(16, 3))
    return P.ranked_candidates(rows.select("vec_id", "seat", "back", contact.alias("contact")), FRAME, FRAME)


HIP = f"""WITH {SQL_ISSUES}, a AS (SELECT vec_id, greatest(4.0,least(30.0,0.04*sqrt(greatest(abs(sum(sx*ey-ex*sy))*0.5,1.0)))) AS margin FROM e GROUP BY vec_id),
n AS (SELECT vec_id, e.i, row_number() OVER (PARTITION BY vec_id ORDER BY sqrt(power((sx+ex)*0.5-kx,2)+power((sy+ey)*0.5-ky,2)), e.i) AS r FROM e JOIN bk USING (vec_id)),
q AS (SELECT n.vec_id, p.x, p.y, (p.i-n.i+4)%4 AS o FROM n JOIN v p ON p.vec_id=n.vec_id WHERE r=1),
s AS (SELECT vec_id, max(x) FILTER (o=0) AS ax, max(y) FILTER (o=0) AS ay, max(x) FILTER (o=1) AS bx, max(y) FILTER (o=1) AS b_y,
  (max(x) FILTER (o=0)+max(x) FILTER (o=1))*0.5 AS mx, (max(y) FILTER (o=0)+max(y) FILTER (o=1))*0.5 AS my, (max(x) FILTER (o=2)+max(x) FILTER (o=3))*0.5 AS fx, (max(y) FILTER (o=2)+max(y) FILTER (o=3))*0.5 AS f_y FROM q GROUP BY vec_id),
gy AS (SELECT vec_id, unnest(range(greatest(floor(y0),0)::INTEGER, least(ceil(y1),223)::INTEGER+1, 12)) AS gy FROM m), gx AS (SELECT vec_id, unnest(range(greatest(floor(x0),0)::INTEGER, least(ceil(x1),223)::INTEGER+1, 12)) AS gx FROM m),
g AS (SELECT vec_id, gx::DOUBLE AS px, gy::DOUBLE AS py FROM gy JOIN gx USING (vec_id)),
d AS (SELECT g.vec_id, px, py, sum(CASE WHEN (sy>py) <> (ey>py) AND px < (sx-ex)*(py-ey)/((sy-ey)+1e-8)+ex THEN 1 ELSE 0 END)%2=1 AS inside,
  min(CASE WHEN power(ex-sx,2)+power(ey-sy,2)<1e-8 THEN sqrt(power(px-sx,2)+power(py-sy,2)) ELSE sqrt(power(px-(sx+greatest(0.0,least(1.0,((px-sx)*(ex-sx)+(py-sy)*(ey-sy))/(power(ex-sx,2)+power(ey-sy,2))))*(ex-sx)),2)
   +power(py-(sy+greatest(0.0,least(1.0,((px-sx)*(ex-sx)+(py-sy)*(ey-sy))/(power(ex-sx,2)+power(ey-sy,2))))*(ey-sy)),2)) END) AS dist FROM g JOIN e USING (vec_id) GROUP BY g.vec_id, px, py),
w AS (SELECT vec_id, px, py, ((px-mx)*(fx-mx)+(py-my)*(f_y-my))/(power(fx-mx,2)+power(f_y-my,2)) AS t, ((px-ax)*(bx-ax)+(py-ay)*(b_y-ay))/(power(bx-ax,2)+power(b_y-ay,2)) AS u
  FROM d JOIN a USING (vec_id) JOIN s USING (vec_id) WHERE inside AND dist>=margin),
z AS (SELECT vec_id, px AS x, py AS y, round(exp(-0.5*power((t-0.35)/0.23,2))*exp(-0.5*power((u-0.5)/0.33,2)),4) AS weight, round(t,4) AS depth_t FROM w WHERE t BETWEEN 0.08 AND 0.92)
SELECT vec_id, rank::INTEGER AS rank, x, y, weight, depth_t FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY weight DESC, y, x) AS rank FROM z) WHERE rank<=5"""


SEAT_CANDIDATES = f"""WITH {SQL_ISSUES}, {sql_points("c", 16, 3)}, {sql_edges("ce", "c")},
ca AS (SELECT vec_id, vec_id%2=1 AND abs(sum(sx*ey-ex*sy))*0.5>1.0 AS given FROM ce GROUP BY vec_id),
o AS (SELECT vec_id, i, x, y FROM v JOIN ca USING (vec_id) WHERE NOT given UNION ALL SELECT vec_id, i, x, y FROM c JOIN ca USING (vec_id) WHERE given),
oe AS (SELECT vec_id, sx, sy, ex, ey FROM e JOIN ca USING (vec_id) WHERE NOT given UNION ALL SELECT vec_id, sx, sy, ex, ey FROM ce JOIN ca USING (vec_id) WHERE given),
a AS (SELECT vec_id, greatest(4.0,least(30.0,0.04*sqrt(greatest(abs(sum(sx*ey-ex*sy))*0.5,1.0)))) AS margin FROM oe GROUP BY vec_id),
ob AS (SELECT vec_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(x) AS mx, avg(y) AS my FROM o GROUP BY vec_id),
n AS (SELECT vec_id, e.i, row_number() OVER (PARTITION BY vec_id ORDER BY sqrt(power((sx+ex)*0.5-kx,2)+power((sy+ey)*0.5-ky,2)), e.i) AS r FROM e JOIN bk USING (vec_id)),
q AS (SELECT n.vec_id, p.x, p.y, (p.i-n.i+4)%4 AS o FROM n JOIN v p ON p.vec_id=n.vec_id WHERE r=1),
s0 AS (SELECT vec_id, max(x) FILTER (o=0) AS ax, max(y) FILTER (o=0) AS ay, max(x) FILTER (o=1) AS bx, max(y) FILTER (o=1) AS b_y,
  (max(x) FILTER (o=0)+max(x) FILTER (o=1))*0.5 AS mx, (max(y) FILTER (o=0)+max(y) FILTER (o=1))*0.5 AS my, (max(x) FILTER (o=2)+max(x) FILTER (o=3))*0.5 AS fx, (max(y) FILTER (o=2)+max(y) FILTER (o=3))*0.5 AS f_y FROM q GROUP BY vec_id),
s AS (SELECT *, CASE WHEN NOT given THEN [0.08,0.92,0.35,0.23] WHEN up>=0.75 THEN [0.34,0.84,0.54,0.16] WHEN up>=0.55 THEN [0.27,0.88,0.49,0.18] ELSE [0.2,0.9,0.46,0.2] END::DOUBLE[] AS band
  FROM (SELECT s0.*, given, abs(f_y-my)/sqrt(greatest((fx-mx)*(fx-mx)+(f_y-my)*(f_y-my),1e-8)) AS up FROM s0 JOIN ca USING (vec_id))),
gy AS (SELECT vec_id, unnest(range(greatest(floor(y0),0)::INTEGER, least(ceil(y1),223)::INTEGER+1, 12)) AS gy FROM ob), gx AS (SELECT vec_id, unnest(range(greatest(floor(x0),0)::INTEGER, least(ceil(x1),223)::INTEGER+1, 12)) AS gx FROM ob),
g AS (SELECT vec_id, gx::DOUBLE AS px, gy::DOUBLE AS py FROM gy JOIN gx USING (vec_id)),
d AS (SELECT g.vec_id, px, py, sum(CASE WHEN (sy>py) <> (ey>py) AND px < (sx-ex)*(py-ey)/((sy-ey)+1e-8)+ex THEN 1 ELSE 0 END)%2=1 AS inside,
  min(CASE WHEN power(ex-sx,2)+power(ey-sy,2)<1e-8 THEN sqrt(power(px-sx,2)+power(py-sy,2)) ELSE sqrt(power(px-(sx+greatest(0.0,least(1.0,((px-sx)*(ex-sx)+(py-sy)*(ey-sy))/(power(ex-sx,2)+power(ey-sy,2))))*(ex-sx)),2)
   +power(py-(sy+greatest(0.0,least(1.0,((px-sx)*(ex-sx)+(py-sy)*(ey-sy))/(power(ex-sx,2)+power(ey-sy,2))))*(ey-sy)),2)) END) AS dist FROM g JOIN oe USING (vec_id) GROUP BY g.vec_id, px, py),
w AS (SELECT vec_id, px, py, band, ((px-mx)*(fx-mx)+(py-my)*(f_y-my))/(power(fx-mx,2)+power(f_y-my,2)) AS t, ((px-ax)*(bx-ax)+(py-ay)*(b_y-ay))/(power(bx-ax,2)+power(b_y-ay,2)) AS u
  FROM d JOIN a USING (vec_id) JOIN s USING (vec_id) WHERE inside AND dist>=margin),
z AS (SELECT vec_id, px AS x, py AS y, round(exp(-0.5*power((t-band[3])/band[4],2))*exp(-0.5*power((u-0.5)/0.33,2)),4) AS weight, round(t,4) AS depth_t FROM w WHERE t BETWEEN band[1] AND band[2]),
r AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY weight DESC, y, x)::INTEGER AS rank, x, y, weight, depth_t FROM z)
SELECT * FROM r UNION ALL SELECT vec_id, 1, round_even(mx,2), round_even(my,2), 1.0, 0.5 FROM ob WHERE vec_id NOT IN (SELECT vec_id FROM z)"""


def denormalise_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometries told on a grid of 100 cells, scaled to a frame of 640 x 480; those of other frames stay."""
    points = F.concat(polygon(0, 4, 110.0, -5.0, 0.0), polygon(8, 2, 110.0, -5.0, 0.0))
    rows = fixed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "p", points)
    told = F.when(F.col("vec_id") % 7 == 0, 640).otherwise(100)
    rows = fixed(rows, "s", F.struct(P.effective_size(F.col("p"), "x", told).alias("w"), P.effective_size(F.col("p"), "y", told).alias("h")))
    same = (F.abs(F.col("s.w") - 640) <= 2) & (F.abs(F.col("s.h") - 480) <= 2)
    rows = rows.withColumn("scaled", ~same & (F.col("s.w") <= 500) & (F.col("s.h") <= 500))
    first = F.col("p")[0]
    pick = lambda v, side, n: F.when(F.col("scaled"), F.round(G.scale_pixels(v, F.col(side), n), 2)).otherwise(F.round(v, 2))
    return rows.select("vec_id", F.col("s.w").alias("eff_w"), F.col("s.h").alias("eff_h"), "scaled", pick(first["x"], "s.w", 640).alias("x"), pick(first["y"], "s.h", 480).alias("y"))


DENORMALISE = f"""WITH {sql_points("v", 0, 4, 110.0, -5.0)}, {sql_points("f", 8, 2, 110.0, -5.0)}, u AS (SELECT * FROM v UNION ALL SELECT * FROM f),
s AS (SELECT vec_id, greatest(CASE WHEN vec_id%7=0 THEN 640 ELSE 100 END, ceil(max(x))::INTEGER+1) AS w, greatest(CASE WHEN vec_id%7=0 THEN 640 ELSE 100 END, ceil(max(y))::INTEGER+1) AS h FROM u GROUP BY vec_id),
t AS (SELECT *, NOT (abs(w-640)<=2 AND abs(h-480)<=2) AND w<=500 AND h<=500 AS scaled FROM s)
SELECT vec_id, w AS eff_w, h AS eff_h, scaled, round(CASE WHEN scaled THEN greatest(0.0,least(639.0,x*(639/(w-1)::DOUBLE))) ELSE x END,2) AS x, round(CASE WHEN scaled THEN greatest(0.0,least(479.0,y*(479/(h-1)::DOUBLE))) ELSE y END,2) AS y
FROM t JOIN v USING (vec_id) WHERE i=0"""


def sanitize_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.repair(geometries(spark, sf_dir, loose=True), FRAME, FRAME)
    return rows.select("vec_id", "ok", F.concat_ws("; ", F.array_distinct("notes")).alias("notes"), r4(G.polygon_area(F.col("seat"))).alias("seat_area"), r4(F.col("floor")[0]["y"]).alias("floor_y"), r4(F.col("back")[0]["y"]).alias("back_y"))


def _line_items(kind: str, most: str, seed: int) -> str:
    """Items of a list of parts made of a document's numbers: some have a line of one point, no confidence or flag, or leave the frame."""
    point = lambda k: f"named_struct('x', cast((n_chars * (i + {k + 1}) + {seed}) % 260 - 10 AS double), 'y', cast((n_chars * (i + {k + 2}) + {seed}) % 240 - 5 AS double))"
    line = f"IF((doc_id + i) % 7 = 0, array({point(0)}), array({point(0)}, {point(1)}))"
    told = f"IF((doc_id + i + {seed}) % 11 = 0, NULL, cast((i * 37 + n_chars) % 130 AS double) / 100)"
    item = f"named_struct('line', {line}, 'confidence', {told}, 'visible', IF((doc_id + i) % 13 = 0, NULL, (doc_id + i) % 2 = 0))"
    return f"IF({most} = 0, cast(array() AS {kind}), transform(sequence(0, cast({most} AS int) - 1), i -> {item}))"


def parts_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parts: confidences and lines from their length, flags from their labels."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    seat, floor, back = ((F.col("n_chars") % n) / float(n) for n in (101, 103, 107))
    seat = F.when(F.col("doc_id") % 11 != 0, seat)
    over = F.when(F.col("doc_id") % 13 == 0, back + 1).otherwise(back)
    seen, below = F.col("quality") == 1, F.when(F.col("doc_id") % 29 != 0, F.col("toxic") == 0)
    rows = rows.select("*", F.expr(_line_items(D.ITEMS, "n_chars % 4", 3)).cast(D.ITEMS).alias("arms"), F.expr(_line_items(D.ITEMS, "n_chars % 10", 5)).cast(D.ITEMS).alias("legs"))
    issues = V.part_issues(seat, floor, back, seen, below, 0.2)
    lists = {"armrests": (F.col("arms"), 2), "legs": (F.when(F.col("doc_id") % 5 != 0, F.col("legs")), 8)}
    errors = V.part_errors({"seat_confidence": seat, "backrest_confidence": over, "floor_confidence": floor}, {"seat_visible": seen, "floor_visible": below}, lists, F.lit(FRAME), F.lit(FRAME))
    return rows.select("doc_id", F.concat_ws("; ", issues).alias("issues"), F.concat_ws("; ", errors).alias("errors"))


def _sql_items(name: str, label: str, count: str, most: int, seed: int, where: str = "true") -> str:
    x = lambda k: f"((n_chars*(i+{k + 1})+{seed})%260-10)"
    y = lambda k: f"((n_chars*(i+{k + 2})+{seed})%240-5)"
    head = f"'parts.{label}['||i||']"
    full = "(doc_id+i)%7<>0"
    conf = f"CASE WHEN (doc_id+i+{seed})%11<>0 THEN ((i*37+n_chars)%130)/100.0::DOUBLE END"
    parts = [
        ("0", f"{head}.line must be a list of 2 points'", "(doc_id+i)%7=0"),
        *[(f"1{k}0", f"{head}.line[{k}].x out of bounds'", f"{full} AND ({x(k)}<0 OR {x(k)}>223)") for k in (0, 1)],
        *[(f"1{k}1", f"{head}.line[{k}].y out of bounds'", f"{full} AND ({y(k)}<0 OR {y(k)}>223)") for k in (0, 1)],
        ("2", f"{head}.confidence must be numeric'", f"({conf}) IS NULL"), ("3", f"{head}.confidence must be in [0,1]'", f"({conf})>1"), ("4", f"{head}.visible must be boolean'", "(doc_id+i)%13=0"),
    ]
    each = " UNION ALL ".join(f"SELECT doc_id, i, '{o}' AS o, {text} AS m FROM {name}_i WHERE {cond}" for o, text, cond in parts)
    return f"""{name}_i AS (SELECT doc_id, n_chars, unnest(range({count})) AS i FROM r WHERE {where}), {name}_m AS ({each}),
{name} AS (SELECT doc_id, string_agg(m, '; ' ORDER BY i, o) AS t FROM {name}_m GROUP BY doc_id)"""


PARTS = f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id%11<>0 THEN (n_chars%101)/101.0::DOUBLE END AS s, (n_chars%103)/103.0::DOUBLE AS f, (n_chars%107)/107.0::DOUBLE AS b, quality=1 AS sv, CASE WHEN doc_id%29<>0 THEN toxic=0 END AS fv, n_chars
FROM documents JOIN labels USING (doc_id)), {_sql_items("arms", "armrests", "n_chars%4", 2, 3)}, {_sql_items("legs", "legs", "n_chars%10", 8, 5, "doc_id%5<>0")}
SELECT r.doc_id, concat_ws('; ', CASE WHEN s IS NULL THEN 'seat_confidence missing' END, CASE WHEN s<0.2 THEN 'seat_confidence='||printf('%.3f',s)||' below threshold 0.200' END,
 CASE WHEN f<0.2 THEN 'floor_confidence='||printf('%.3f',f)||' below threshold 0.200' END, CASE WHEN NOT sv THEN 'seat_visible is false' END, CASE WHEN NOT coalesce(fv,false) THEN 'floor_visible is false' END,
 CASE WHEN b<0.1 THEN 'backrest_confidence too low for stable torso anchoring ('||printf('%.3f',b)||')' END) AS issues,
 concat_ws('; ', CASE WHEN s IS NULL THEN 'parts.seat_confidence must be numeric' END, CASE WHEN r.doc_id%13=0 AND b>0 THEN 'parts.backrest_confidence must be in [0,1]' END,
 CASE WHEN fv IS NULL THEN 'parts.floor_visible must be boolean' END, CASE WHEN n_chars%4>2 THEN 'parts.armrests has too many items (>2)' END, arms.t, CASE WHEN n_chars%10>8 AND r.doc_id%5<>0 THEN 'parts.legs has too many items (>8)' END, legs.t) AS errors
FROM r LEFT JOIN arms USING (doc_id) LEFT JOIN legs USING (doc_id)"""


def _told_points(first: int, n: int, spread: float, shift: float) -> Column:
    return polygon(first, n, spread, shift, None).cast(D.POINTS)


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and a part document: told on a grid of 100 or in pixels, some of it out of the frame, missing or too long."""
    small = F.col("vec_id") % 3 == 0
    region = lambda first, n: F.when(small, _told_points(first, n, 104.0, -4.0)).otherwise(_told_points(first, n, 240.0, -8.0))
    item = lambda j: F.struct(F.when((F.col("vec_id") + j) % 7 != 0, region(16 + 4 * j, 2)).alias("line"), F.when((F.col("vec_id") + j) % 5 != 0, dim(20 + j) + 0.7).alias("confidence"), F.when((F.col("vec_id") + j) % 9 != 0, dim(21 + j) > 0).alias("visible"))
    items = lambda first, n, every: F.when(F.col("vec_id") % every != 0, F.array(*[item(first + j) for j in range(n)])).cast(D.ITEMS)
    values = [F.when(F.col("vec_id") % (17 + j) != 0, dim(40 + j) + 0.75).alias(k) for j, k in enumerate(D.CONFIDENCES)] + [F.when(F.col("vec_id") % (23 + j) != 0, dim(43 + j) > -0.45).alias(k) for j, k in enumerate(D.FLAGS)]
    parts = F.when(F.col("vec_id") % 41 != 0, F.struct(*values, items(0, 3, 6).alias("armrests"), items(2, 9, 8).alias("legs")).cast(D.PARTS))
    seat = F.when(F.col("vec_id") % 31 == 0, region(0, 3)).otherwise(region(0, 4))
    side = lambda n: F.when(F.col("vec_id") % 37 == 0, None).when(small, 100).otherwise(n).cast("int")
    doc = F.struct(side(FRAME).alias("image_width"), side(FRAME).alias("image_height"), seat.alias("seat_region"), region(8, 2).alias("floor_line"), region(12, 2).alias("backrest_region"), parts.alias("parts"))
    return fixed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "doc", doc.cast(D.PART_DOCUMENT)).select("vec_id", "doc")


def document_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry and part documents brought to a frame of 640 x 480, by rescaling and by the rules for compact grids."""
    rows = part_documents(spark, sf_dir)
    doc, w, h = F.col("doc"), 640, 480
    contact = F.transform(F.get(F.col("doc.parts.legs"), F.lit(0))["line"], lambda p: F.struct(F.when(F.col("vec_id") % 10 != 3, p["x"]).alias("x"), p["y"].alias("y")))
    geometry = F.struct(doc["image_width"], doc["image_height"], doc["seat_region"], doc["floor_line"], doc["backrest_region"], F.concat(doc["floor_line"], contact).alias("seat_contact_region")).cast(D.GEOMETRY)
    made = F.struct(
        D.rescale_geometry(geometry, w, h).alias("g"), D.rescale_parts(doc, w, h).alias("p"), D.denormalise_geometry(geometry, w, h).alias("dg"), D.denormalise_parts(doc, w, h).alias("dp"),
    )
    rows = fixed(rows, "m", made)
    y = lambda path: r4(F.get(F.col(path), F.lit(1))["y"])
    return rows.select(
        "vec_id", F.col("m.g.image_width").alias("width"), y("m.g.seat_region").alias("seat_y"), F.size("m.g.seat_contact_region").alias("n_contact"), F.size("m.p.parts.armrests").alias("n_arms"), F.size("m.p.parts.legs").alias("n_legs"),
        F.col("m.p.parts.seat_visible").alias("seat_visible"), r4(F.col("m.p.parts.floor_confidence")).alias("floor_confidence"), F.col("m.dg.scaled").alias("geometry_scaled"), y("m.dg.doc.floor_line").alias("geometry_floor_y"),
        F.col("m.dp.scaled").alias("parts_scaled"), y("m.dp.doc.backrest_region").alias("parts_back_y"), r4(F.get(F.get(F.col("m.dp.doc.parts.legs"), F.lit(0))["line"], F.lit(0))["x"]).alias("leg_x"),
    )


def _part_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and parts of every part document, and whether it is complete; one that is not has the canonical regions, which nothing is told of."""
    whole = (F.size("doc.seat_region") == 4) & F.col("doc.image_width").isNotNull()
    rows = part_documents(spark, sf_dir).withColumn("complete", F.coalesce(whole, F.lit(False)))
    regions = zip(("seat", "floor", "back"), ("seat_region", "floor_line", "backrest_region"), P.canonical(FRAME, FRAME))
    return rows.select("vec_id", "complete", *[F.when(F.col("complete"), F.col(f"doc.{own}")).otherwise(instead).alias(name) for name, own, instead in regions], F.col("doc.parts").alias("parts"))


def _if_complete(value, instead=None):
    return F.when(F.col("complete"), value).otherwise(F.lit(instead))


def parts_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part documents cleaned up: whether they are valid then, their values, and what was done; an incomplete one is not valid and has no values."""
    rows = D.sanitize_parts(_part_regions(spark, sf_dir), FRAME, FRAME)
    told = F.concat_ws("; ", F.array_distinct("notes"))
    values = {"seat_confidence": r4(F.col("parts.seat_confidence")), "n_arms": F.size("parts.armrests"), "n_legs": F.size("parts.legs")}
    return rows.select("vec_id", _if_complete(F.col("ok"), False).alias("ok"), *[_if_complete(v).alias(k) for k, v in values.items()], _if_complete(told, INCOMPLETE).alias("notes"))


#: The note of a document without a frame or with too few corners of its seat.
INCOMPLETE = "geometry document is incomplete"


def _part_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.geometry_from_parts(_part_regions(spark, sf_dir), FRAME, FRAME, 0.35)
    return rows.withColumns({"ok": _if_complete(F.col("ok"), False), "notes": F.when(F.col("complete"), F.col("notes")).otherwise(F.array(F.lit(INCOMPLETE)))})


def part_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geometry that a part document gives, or why it gives none."""
    rows = _part_geometry(spark, sf_dir)
    area = F.when(F.col("ok"), r4(G.polygon_area(F.col("seat"))))
    return rows.select("vec_id", "ok", area.alias("seat_area"), F.when(F.col("ok"), r4(F.col("floor")[0]["y"])).alias("floor_y"), F.concat_ws("; ", F.array_distinct("notes")).alias("notes"))


def geometry_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade: the stage's geometry or what it told, the parts' geometry, the canonical one; then repair, parts, canonical."""
    doc = F.col("doc")
    told = F.struct(doc["image_width"], doc["image_height"], doc["seat_region"], doc["floor_line"], doc["backrest_region"], F.lit(None).alias("seat_contact_region")).cast(D.GEOMETRY)
    rows = part_documents(spark, sf_dir).select("vec_id", told.alias("doc"))
    valid = F.size(V.geometry_errors(F.col("doc.seat_region"), F.col("doc.floor_line"), F.col("doc.backrest_region"), F.col("doc.image_width"), F.col("doc.image_height"))) == 0
    rows = rows.withColumn("stage_ok", valid & (F.col("vec_id") % 2 == 0))
    parts = _part_geometry(spark, sf_dir).select("vec_id", F.col("ok").alias("part_ok"), F.col("seat").alias("part_seat"), F.col("floor").alias("part_floor"), F.col("back").alias("part_back"))
    rows = rows.join(parts, "vec_id", "left").withColumn("part_ok", F.coalesce("part_ok", F.lit(False)))
    rows = D.recover_geometry(rows, FRAME, FRAME)
    return rows.select("vec_id", "source", "denormalised", "prior_source", "n_issues", r4(G.polygon_area(F.col("seat"))).alias("seat_area"), r4(F.col("floor")[0]["y"]).alias("floor_y"), r4(F.col("back")[0]["y"]).alias("back_y"))


def pose_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions as named points: some are missing, one name is unknown, and some values are out of range."""
    kind = "struct<x:double,y:double,confidence:double,visible:boolean>"
    names = [*P.KEYPOINTS, "tail"]

    def keypoint(j: int):
        value = F.struct(((dim(j * 3) + 0.5) * 260 - 18).alias("x"), ((dim(j * 3 + 1) + 0.5) * 260 - 18).alias("y"), (dim(j * 3 + 2) + 0.4).alias("confidence"), F.when(F.col("vec_id") % (j + 20) != 0, F.lit(True)).alias("visible"))
        value = value.withField("x", F.when((F.col("vec_id") + 3 * j) % 43 != 0, value["x"])).withField("confidence", F.when((F.col("vec_id") + 5 * j) % 47 != 0, value["confidence"]))
        return F.struct(F.lit(names[j]).alias("key"), F.when((F.col("vec_id") + j) % 17 != 0, value.cast(kind)).alias("value"))

    entries = F.filter(F.array(*[keypoint(j) for j in range(len(names))]), lambda e: e["value"].isNotNull())
    rows = fixed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "k", F.map_from_entries(entries))
    errors = V.pose_errors(F.col("k"), F.when(F.col("vec_id") % 31 == 0, 100).when(F.col("vec_id") % 37 != 0, FRAME), F.lit(FRAME), FRAME, FRAME, P.KEYPOINTS)
    marks = [((F.col("vec_id") % (3 + j) > 0).cast("int")).alias(n) for j, n in enumerate(P.CHECKS)]
    checks = F.create_map(*[x for n, c in zip(P.CHECKS, marks) for x in (F.lit(n), c)])
    told = (F.col("vec_id") % 6).cast("int")
    checker = V.checker_errors(told, checks, F.when(F.col("vec_id") % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), P.CHECKS)
    return rows.select("vec_id", F.concat_ws("; ", errors).alias("pose_errors"), F.concat_ws("; ", checker).alias("checker_errors"))


NAMES = [*P.KEYPOINTS, "tail"]
POSE_VALIDATE = f"""WITH n AS (SELECT unnest({NAMES!r}) AS name, unnest(range({len(NAMES)})) AS j),
p AS (SELECT vec_id, name, j, CASE WHEN (vec_id+3*j)%43<>0 THEN (embedding[j*3+1]::DOUBLE+0.5)*260-18 END AS x, (embedding[j*3+2]::DOUBLE+0.5)*260-18 AS y, CASE WHEN (vec_id+5*j)%47<>0 THEN embedding[j*3+3]::DOUBLE+0.4 END AS c, vec_id%(j+20)=0 AS blind, (vec_id+j)%17=0 AS missing FROM embeddings, n),
m AS (SELECT vec_id, '0' AS o, 'image_width mismatch' AS t FROM embeddings WHERE vec_id%31=0 OR vec_id%37=0 UNION ALL SELECT vec_id, '1'||name, 'missing keypoint: '||name FROM p WHERE missing AND name<>'tail'
 UNION ALL SELECT vec_id, '2'||name, 'unknown keypoint: '||name FROM p WHERE NOT missing AND name='tail'
 UNION ALL SELECT vec_id, '3'||name||'0', name||'.x out of bounds' FROM p WHERE NOT missing AND name<>'tail' AND (x<0 OR x>223) UNION ALL SELECT vec_id, '3'||name||'1', name||'.y out of bounds' FROM p WHERE NOT missing AND name<>'tail' AND x IS NOT NULL AND (y<0 OR y>223)
 UNION ALL SELECT vec_id, '3'||name||'0', name||'.x and '||name||'.y must be numeric' FROM p WHERE NOT missing AND name<>'tail' AND x IS NULL UNION ALL SELECT vec_id, '3'||name||'2', name||'.confidence must be numeric' FROM p WHERE NOT missing AND name<>'tail' AND c IS NULL
 UNION ALL SELECT vec_id, '3'||name||'2', name||'.confidence out of range' FROM p WHERE NOT missing AND name<>'tail' AND (c<0 OR c>1) UNION ALL SELECT vec_id, '3'||name||'3', name||'.visible must be boolean' FROM p WHERE NOT missing AND name<>'tail' AND blind)
SELECT e.vec_id, coalesce((SELECT string_agg(t,'; ' ORDER BY o) FROM m WHERE m.vec_id=e.vec_id),'') AS pose_errors,
 concat_ws('; ', CASE WHEN vec_id%6>4 THEN 'score must be an integer in [0, 4]' END, CASE WHEN (vec_id%3>0)::INT+(vec_id%4>0)::INT+(vec_id%5>0)::INT+(vec_id%6>0)::INT<>vec_id%6 THEN 'score mismatch' END,
  CASE WHEN vec_id%6=4 AND vec_id%4=0 THEN 'failures must be empty when score is 4' END) AS checker_errors FROM embeddings e"""



def project_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as base poses with a fallback each: scores and checks from sizes and priorities, some without a check or a second opinion."""
    n = lambda k, m: ((F.col("o_orderkey") * k) % m).cast("int")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", n(7, 5).alias("local"), n(11, 5).alias("fallback"), n(13, 5).alias("checker"), F.when(n(17, 3) > 0, n(19, 5)).alias("again"), F.when(n(23, 4) > 0, n(29, 2)).alias("hip"), F.when(n(31, 5) > 0, n(37, 2)).alias("ankles"))
    checks = {"hip_on_seat": F.col("hip"), "ankles_below_seat_near_floor": F.col("ankles")}
    told = P.project_fallback(F.col("local"), checks, F.col("fallback"), F.col("checker"), F.lit(3), F.col("again"))
    return fixed(rows, "t", told).select("o_orderkey", "t.must_project", "t.accepted", "t.checker", "t.local", "t.effective")


PROJECT_FALLBACK = """WITH r AS (SELECT o_orderkey, (o_orderkey*7%5)::INTEGER AS l, (o_orderkey*11%5)::INTEGER AS f, (o_orderkey*13%5)::INTEGER AS c, CASE WHEN o_orderkey*17%3>0 THEN (o_orderkey*19%5)::INTEGER END AS g,
  CASE WHEN o_orderkey*23%4>0 THEN o_orderkey*29%2 END AS h, CASE WHEN o_orderkey*31%5>0 THEN o_orderkey*37%2 END AS a FROM orders),
m AS (SELECT *, l<3 OR coalesce(h,1)=0 OR coalesce(a,1)=0 AS must, coalesce(g,c) AS gc FROM r), t AS (SELECT *, must AND f>l AND least(gc,f)>=least(c,l) AS ok FROM m)
SELECT o_orderkey, must AS must_project, ok AS accepted, CASE WHEN ok THEN gc ELSE c END AS checker, CASE WHEN ok THEN f ELSE l END AS local, CASE WHEN ok THEN least(gc,f) ELSE least(c,l) END AS effective FROM t"""

QUERIES = {
    "geometry_validate": (geometry_validate, GEOMETRY_VALIDATE),
    "prior_issues": (prior_issues, PRIOR_ISSUES),
    "local_check_score": (local_check_score, LOCAL_CHECK),
    "fallback_cascade": (fallback_cascade, FALLBACK),
    "hip_candidates": (hip_candidates, f"SELECT e.vec_id, h.rank, h.x, h.y, h.weight, h.depth_t FROM embeddings e LEFT JOIN ({HIP}) h ON h.vec_id=e.vec_id"),
    "project_fallback": (project_fallback, PROJECT_FALLBACK),
    "seat_candidates": (seat_candidates, SEAT_CANDIDATES),
    "denormalise_grid": (denormalise_grid, DENORMALISE),
    "sanitize_repair": (sanitize_repair, None),
    "parts_quality": (parts_quality, PARTS),
    "document_rescale": (document_rescale, None),
    "parts_sanitize": (parts_sanitize, None),
    "part_geometry": (part_geometry, None),
    "geometry_recovery": (geometry_recovery, None),
    "pose_validate": (pose_validate, POSE_VALIDATE),
}
