"""Queries over polygons and boxes made of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import geometry as G
from tessera.functions.hull import quadrilateral
from tessera.operators import targets as TG
from tessera.plans.common import FRAME, GRID, polygon, polygons, r4, sql_bbox, sql_edges, sql_grid, sql_points
from tessera.session import table

GT = sql_points("v", 0)
EDGES = sql_edges("e", "v")
AREA = "a AS (SELECT vec_id, label, abs(sum(sx*ey-ex*sy))*0.5 AS area FROM e GROUP BY vec_id, label)"


def poly_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons(spark, sf_dir).select("vec_id", r4(G.polygon_area(F.col("gt"))).alias("area"))


POLY_AREA = f"WITH {GT}, {EDGES}, {AREA} SELECT vec_id, round(area,4) AS area FROM a"


def poly_bbox_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = polygons(spark, sf_dir).select("vec_id", G.bounding_box(F.col("gt")).alias("b"))
    rows = rows.select("vec_id", "b", G.grid_box(G.scale_box(F.col("b"), FRAME, FRAME, GRID, GRID), GRID, GRID).alias("g"))
    return rows.select("vec_id", *[r4(F.col(f"b.{k}")).alias(f"px_{k}") for k in ("x_min", "y_min", "x_max", "y_max")], *[F.col(f"g.{k}").alias(k) for k in ("x_min", "y_min", "x_max", "y_max")])


POLY_BBOX_GRID = f"""WITH {GT}, {sql_bbox("b", "v")}, {sql_grid("g", "b")}
SELECT vec_id, round(x0,4) AS px_x_min, round(y0,4) AS px_y_min, round(x1,4) AS px_x_max, round(y1,4) AS px_y_max,
       a0 AS x_min, b0 AS y_min, a1 AS x_max, b1 AS y_max FROM b JOIN g USING (vec_id)"""


def poly_summary_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = polygons(spark, sf_dir).select("label", G.polygon_area(F.col("gt")).alias("area"), F.size("gt").alias("n"))
    return rows.groupBy("label").agg(
        F.count("*").alias("n_polygons"),
        F.sum("n").alias("n_points"),
        r4(F.sum("area")).alias("area_sum"),
        r4(F.coalesce(F.min("area"), F.lit(0.0))).alias("area_min"),
        r4(F.coalesce(F.max("area"), F.lit(0.0))).alias("area_max"),
        r4(F.avg("area")).alias("area_mean"),
    )


POLY_SUMMARY = f"""WITH {GT}, {EDGES}, {AREA}
SELECT label, count(*) AS n_polygons, (6*count(*))::BIGINT AS n_points, round(sum(area),4) AS area_sum, round(min(area),4) AS area_min,
       round(max(area),4) AS area_max, round(avg(area),4) AS area_mean FROM a GROUP BY label"""


def poly_point_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of a grid that each polygon holds, counted in its own row."""
    grid = F.array(*[G.point(float(x), float(y)) for y in range(0, FRAME, 16) for x in range(0, FRAME, 16)])
    inside = F.filter(grid, lambda p: G.point_in_polygon(p["x"], p["y"], F.col("gt")))
    return polygons(spark, sf_dir).select("vec_id", F.size(grid).cast("long").alias("n_grid"), F.size(inside).cast("long").alias("n_inside"))


POLY_POINT_IN = f"""WITH {GT}, {EDGES}, grid AS (SELECT x.g*16.0 AS gx, y.g*16.0 AS gy FROM range(14) x(g), range(14) y(g)),
c AS (SELECT e.vec_id, gx, gy, sum(CASE WHEN (sy>gy) <> (ey>gy) AND gx < (sx-ex)*(gy-ey)/((sy-ey)+1e-8)+ex THEN 1 ELSE 0 END) AS n
      FROM e, grid GROUP BY ALL)
SELECT vec_id, count(*) AS n_grid, count(*) FILTER (n % 2 = 1) AS n_inside FROM c GROUP BY vec_id"""

SQL_SEGMENT = """CASE WHEN dx*dx+dy*dy < 1e-8 THEN sqrt((px-sx)*(px-sx)+(py-sy)*(py-sy)) ELSE
 sqrt(power(px-(sx+greatest(0.0,least(1.0,((px-sx)*dx+(py-sy)*dy)/(dx*dx+dy*dy)))*dx),2)+power(py-(sy+greatest(0.0,least(1.0,((px-sx)*dx+(py-sy)*dy)/(dx*dx+dy*dy)))*dy),2)) END"""


def poly_edge_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.lit(112.0), F.lit(100.0)
    gt = F.col("gt")
    return polygons(spark, sf_dir).select("vec_id", r4(G.edge_distance(x, y, gt)).alias("distance"), G.point_in_polygon(x, y, gt).alias("inside"))


POLY_EDGE_DISTANCE = f"""WITH {GT}, {EDGES}, d AS (SELECT *, ex-sx AS dx, ey-sy AS dy, 112.0::DOUBLE AS px, 100.0::DOUBLE AS py FROM e)
SELECT vec_id, round(min({SQL_SEGMENT}),4) AS distance,
       sum(CASE WHEN (sy>py) <> (ey>py) AND px < (sx-ex)*(py-ey)/((sy-ey)+1e-8)+ex THEN 1 ELSE 0 END) % 2 = 1 AS inside
FROM d GROUP BY vec_id"""


def poly_dedupe_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    repeated = F.flatten(F.transform("gt", lambda p: F.array(p, p)))
    rows = polygons(spark, sf_dir).select("vec_id", A.dedupe_points(repeated).alias("ring"))
    rows = A.resample_ring(rows, "ring", 12, "even")
    rows = rows.select("vec_id", F.size("ring").alias("n_kept"), F.posexplode("even").alias("i", "p"))
    return rows.select("vec_id", "n_kept", "i", r4(F.col("p.x")).alias("x"), r4(F.col("p.y")).alias("y"))


POLY_RESAMPLE = f"""WITH {GT}, {EDGES}, s AS (SELECT *, sqrt((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy)) AS len FROM e),
c AS (SELECT *, sum(len) OVER (PARTITION BY vec_id ORDER BY i) AS stop, sum(len) OVER (PARTITION BY vec_id) AS total FROM s),
t AS (SELECT c.*, k, total*k/12.0 AS target, row_number() OVER (PARTITION BY vec_id, k ORDER BY c.i) AS rank
      FROM c, range(12) r(k) WHERE stop >= total*k/12.0 OR c.i = 5)
SELECT vec_id, 6 AS n_kept, k::INTEGER AS i, round(sx+(ex-sx)*(target-(stop-len))/len,4) AS x, round(sy+(ey-sy)*(target-(stop-len))/len,4) AS y
FROM t WHERE rank = 1"""


def poly_convex_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quadrilateral(polygons(spark, sf_dir).select("vec_id", "gt"), "gt", "q")
    return rows.select("vec_id", F.size("q").alias("n"), F.posexplode_outer("q").alias("i", "p")).select("vec_id", "n", "i", F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"))


CONVEX_QUAD = f"""WITH {GT}, c AS (SELECT vec_id, arg_min(ROW(x,y),x+y) AS p0, arg_min(ROW(x,y),y-x) AS p1, arg_max(ROW(x,y),x+y) AS p2, arg_min(ROW(x,y),x-y) AS p3, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v GROUP BY vec_id),
l AS (SELECT vec_id, CASE WHEN len(list_distinct([p0,p1,p2,p3]))<4 THEN [ROW(x0,y0),ROW(x1,y0),ROW(x1,y1),ROW(x0,y1)] ELSE [p0,p1,p2,p3] END AS ps FROM c),
q AS (SELECT vec_id, p[1] AS x, p[2] AS y FROM (SELECT vec_id, unnest(ps) AS p FROM l)),
a AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY -atan2(y-my, x-mx)) AS k FROM (SELECT *, avg(x) OVER (PARTITION BY vec_id) AS mx, avg(y) OVER (PARTITION BY vec_id) AS my FROM q)),
s AS (SELECT vec_id, arg_min(k, x+y) AS first FROM a GROUP BY vec_id)
SELECT vec_id, 4 AS n, ((k-first+4)%4)::INTEGER AS i, round(round_even(x,6),2) AS x, round(round_even(y,6),2) AS y FROM a JOIN s USING (vec_id)"""


def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("vec_id", r4(G.cell_iou(F.col("g"), F.col("p"))).alias("iou"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth and prediction as boxes on the grid; both are told in one row, so there is nothing to join."""
    grid = lambda c: G.grid_box(G.scale_box(G.bounding_box(F.col(c)), FRAME, FRAME, GRID, GRID), GRID, GRID)
    rows = polygons(spark, sf_dir).select("vec_id", "label", "gt", "pred")
    return A.fixed(rows, "b", F.struct(grid("gt").alias("g"), grid("pred").alias("p"))).select("vec_id", "label", "b.g", "b.p")


IOU = f"""{GT}, {sql_points("w", 12)}, {sql_bbox("bv", "v")}, {sql_bbox("bw", "w")}, {sql_grid("g", "bv")}, {sql_grid("p", "bw")},
o AS (SELECT vec_id, g.label, greatest(least(g.a1,p.a1)-greatest(g.a0,p.a0)+1,0)*greatest(least(g.b1,p.b1)-greatest(g.b0,p.b0)+1,0)::DOUBLE AS common,
             ((g.a1-g.a0+1)*(g.b1-g.b0+1)+(p.a1-p.a0+1)*(p.b1-p.b0+1))::DOUBLE AS cells FROM g JOIN p USING (vec_id)),
iou AS (SELECT vec_id, label, common/(cells-common) AS iou FROM o)"""
BOX_IOU = f"WITH {IOU} SELECT vec_id, round(iou,4) AS iou FROM iou"


def iou_eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.metrics import evaluation_summary

    rows = boxes(spark, sf_dir).select(
        (F.col("vec_id") % 9 != 0).alias("valid_json"),
        ((F.col("vec_id") % 9 != 0) & (F.col("vec_id") % 4 != 1)).alias("schema_valid"),
        (F.col("vec_id") % 11 == 3).alias("placeholder"),
        G.cell_iou(F.col("g"), F.col("p")).alias("iou"),
    )
    return evaluation_summary(rows)


IOU_EVAL = f"""WITH {IOU}, s AS (SELECT iou, vec_id%9<>0 AS j, vec_id%9<>0 AND vec_id%4<>1 AS ok, vec_id%11=3 AS ph FROM iou)
SELECT count(*) AS num_samples, round(avg(j::INT),4) AS valid_json_rate, round(avg(ok::INT),4) AS schema_valid_rate, round(avg(ph::INT),4) AS placeholder_rate,
       round(coalesce(avg(iou),0),4) AS mean_iou_all, round(coalesce(avg(iou) FILTER (ok),0),4) AS mean_iou_schema_valid_only,
       round(coalesce(median(iou) FILTER (ok),0),4) AS median_iou_schema_valid_only FROM s"""


def reject_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a predicted polygon is rejected: reasons of its shape, and the outcome, for which an answer that is no JSON or breaks the schema comes first."""
    from tessera.operators.validate import polygon_rejections, prediction_rejections

    told = F.struct(polygon_rejections(F.col("gt"), FRAME, FRAME).alias("shape"), prediction_rejections(F.col("vec_id") % 13 != 0, F.col("vec_id") % 7 != 0, F.col("gt"), FRAME, FRAME).alias("all"))
    rows = polygons(spark, sf_dir).select("vec_id", told.alias("r"))
    return rows.select("vec_id", F.concat_ws("|", "r.shape").alias("reasons"), F.coalesce(F.get("r.all", F.lit(0)), F.lit("accepted")).alias("outcome"))


REJECT = f"""WITH {GT}, {EDGES}, {AREA}, {sql_bbox("b", "v")},
u AS (SELECT vec_id, count(DISTINCT (round_even(x,0), round_even(y,0))) AS n,
        (max((x<=6.72 AND y<=6.72)::INT)+max((x>=223-6.72 AND y<=6.72)::INT)+max((x<=6.72 AND y>=223-6.72)::INT)+max((x>=223-6.72 AND y>=223-6.72)::INT)) AS corners
      FROM v GROUP BY vec_id),
r AS (SELECT vec_id, concat_ws('|', CASE WHEN n<3 THEN 'too_few_unique_points' END, CASE WHEN area/50176>0.35 THEN 'area_too_large' END,
   CASE WHEN area/50176<0.003 THEN 'area_too_small' END, CASE WHEN (y1-y0)/224>0.45 THEN 'bbox_too_tall' END, CASE WHEN y1<0.45*224 THEN 'bbox_too_high' END,
   CASE WHEN y0>0.80*224 THEN 'bbox_too_low' END, CASE WHEN x1-x0<0.08*224 OR y1-y0<0.08*224 THEN 'collapsed_extent' END,
   CASE WHEN corners>=2 THEN 'touches_multiple_corners' END) AS reasons FROM a JOIN b USING (vec_id) JOIN u USING (vec_id))
SELECT vec_id, reasons, CASE WHEN vec_id%13=0 THEN 'invalid_json' WHEN vec_id%7=0 THEN 'schema_invalid' WHEN reasons='' THEN 'accepted' ELSE split_part(reasons,'|',1) END AS outcome FROM r"""


def hard_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).select("vec_id", G.cell_iou(F.col("g"), F.col("p")).alias("iou")).where("iou < 0.75")
    hard = rows.orderBy("iou", "vec_id").limit(40)
    variants = F.explode(F.array(*map(F.lit, ("orig", "front", "deep")))).alias("variant")
    return hard.select("vec_id", r4(F.col("iou")).alias("mining_iou"), variants).withColumn("sample_id", F.concat_ws("_", F.lit("hard"), F.col("vec_id").cast("string"), "variant"))


HARD_CASES = f"""WITH {IOU}, h AS (SELECT vec_id, iou FROM iou WHERE iou<0.75 ORDER BY iou, vec_id LIMIT 40)
SELECT vec_id, round(iou,4) AS mining_iou, variant, 'hard_'||vec_id||'_'||variant AS sample_id FROM h, unnest(['orig','front','deep']) t(variant)"""


def scale_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = polygons(spark, sf_dir).select("vec_id", F.posexplode("gt").alias("i", "p"))
    x, y = F.col("p.x"), F.col("p.y")
    return rows.select(
        "vec_id", "i",
        r4(G.scale_pixels(x, FRAME, 640)).alias("x_pixels"), r4(G.scale_pixels(y, FRAME, 480)).alias("y_pixels"),
        r4(G.scale_ratio(x, FRAME, 640)).alias("x_ratio"), r4(G.scale_ratio(y, FRAME, 480)).alias("y_ratio"),
        F.rint(G.clamp(x, 0.0, 223.0)).cast("int").alias("x_int"), F.rint(G.clamp(y, 0.0, 223.0)).cast("int").alias("y_int"),
        r4(G.clamp(x, 60.0, 160.0)).alias("x_clamped"),
    )


SCALE_LAWS = f"""WITH {GT} SELECT vec_id, i::INTEGER AS i, round(least(greatest(x*(639/223.0::DOUBLE),0),639),4) AS x_pixels, round(least(greatest(y*(479/223.0::DOUBLE),0),479),4) AS y_pixels,
round(least(greatest(x*(640::DOUBLE/224),0),639),4) AS x_ratio, round(least(greatest(y*(480::DOUBLE/224),0),479),4) AS y_ratio,
round_even(x,0)::INTEGER AS x_int, round_even(y,0)::INTEGER AS y_int, round(greatest(60.0,least(160.0,x)),4) AS x_clamped FROM v"""


def crop_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = polygons(spark, sf_dir).select("vec_id", G.bounding_box(F.col("gt")).alias("b"), G.bounding_box(F.col("pred")).alias("chair"))
    rows = rows.select("*", G.expand_crop(F.col("chair"), FRAME, FRAME, 0.1).alias("crop"), G.expand_box(F.col("b"), FRAME, FRAME, 0.55, 1.35, 0.70).alias("roi"))
    moved = G.grid_box(G.shift_box(F.col("b"), F.col("crop")), FRAME, FRAME)
    sides = ("x_min", "y_min", "x_max", "y_max")
    rows = rows.withColumn("s", moved)
    return rows.select("vec_id", F.concat_ws("|", *[F.col(f"crop.{k}").cast("string") for k in sides]).alias("crop_box"), *[r4(F.col(f"roi.{k}")).alias(f"roi_{k}") for k in sides], *[F.col(f"s.{k}").alias(k) for k in sides])


def _sql_crop() -> str:
    low = lambda c, s: f"greatest(round_even({c}-greatest({s},2.0)*0.1,0)::INTEGER,0)"
    high = lambda c, s: f"least(round_even({c}+greatest({s},2.0)*0.1,0)::INTEGER,224)"
    return f"""k AS (SELECT vec_id, label, {low("x0", "x1-x0")} AS k0, {low("y0", "y1-y0")} AS l0, {high("x1", "x1-x0")} AS k1, {high("y1", "y1-y0")} AS l1 FROM bw),
kk AS (SELECT vec_id, CASE WHEN z THEN 0 ELSE k0 END AS k0, CASE WHEN z THEN 0 ELSE l0 END AS l0, CASE WHEN z THEN 224 ELSE k1 END AS k1, CASE WHEN z THEN 224 ELSE l1 END AS l1
       FROM (SELECT *, k1<=k0+1 OR l1<=l0+1 AS z FROM k)),
m AS (SELECT vec_id, b.label, x0-k0 AS x0, y0-l0 AS y0, x1-k0 AS x1, y1-l0 AS y1 FROM bv b JOIN kk USING (vec_id)), {sql_grid("s", "m", 1, FRAME)},
roi AS (SELECT vec_id, least(greatest(x0-(x1-x0)*0.55,0),223) AS r0, least(greatest(y0-(y1-y0)*1.35,0),223) AS t0, least(greatest(x1+(x1-x0)*0.55,0),223) AS r1, least(greatest(y1+(y1-y0)*0.70,0),223) AS t1 FROM bv)"""


CROP_SHIFT = f"""WITH {GT}, {sql_points("w", 12)}, {sql_bbox("bv", "v")}, {sql_bbox("bw", "w")}, {_sql_crop()}
SELECT vec_id, concat_ws('|',k0,l0,k1,l1) AS crop_box, round(r0,4) AS roi_x_min, round(t0,4) AS roi_y_min, round(r1,4) AS roi_x_max, round(t1,4) AS roi_y_max,
       a0 AS x_min, b0 AS y_min, a1 AS x_max, b1 AS y_max FROM kk JOIN s USING (vec_id) JOIN roi USING (vec_id)"""


def target_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label's polygons within a block of ids, the largest one as a box on the grid."""
    rows = polygons(spark, sf_dir).select("vec_id", "label", F.floor(F.col("vec_id") / 10).alias("doc"), "gt", G.polygon_area(F.col("gt")).alias("area"))
    best = rows.where("area >= 8").groupBy("doc", "label").agg(F.max_by(F.struct("vec_id", "gt", "area"), F.struct("area", (-F.col("vec_id")).alias("k"))).alias("s"))
    best = best.select("doc", "label", "s.vec_id", "s.area", G.grid_box(G.scale_box(G.bounding_box(F.col("s.gt")), FRAME, FRAME, GRID, GRID), GRID, GRID).alias("g"))
    return best.select("doc", "label", "vec_id", r4(F.col("area")).alias("area"), F.lit(4).alias("target_count"), *[F.col(f"g.{k}").alias(k) for k in ("x_min", "y_min", "x_max", "y_max")])


TARGET_ANNOTATION = f"""WITH {GT}, {EDGES}, {AREA}, {sql_bbox("b", "v")}, {sql_grid("g", "b")},
r AS (SELECT vec_id//10 AS doc, label, vec_id, area, row_number() OVER (PARTITION BY vec_id//10, label ORDER BY area DESC, vec_id) AS k FROM a WHERE area>=8)
SELECT doc, r.label, vec_id, round(area,4) AS area, 4 AS target_count, a0 AS x_min, b0 AS y_min, a1 AS x_max, b1 AS y_max FROM r JOIN g USING (vec_id) WHERE k=1"""


def target_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest polygon of each label within a block of ids as a box, a quadrilateral and twelve points; what has no such shape is left out."""
    rows = polygons(spark, sf_dir).select("vec_id", "label", F.floor(F.col("vec_id") / 10).alias("doc"), "gt", G.polygon_area(F.col("gt")).alias("area"))
    best = rows.where("area >= 8").groupBy("doc", "label").agg(F.max_by(F.struct("vec_id", "gt"), F.struct("area", (-F.col("vec_id")).alias("k"))).alias("s"))
    best = best.select("doc", "label", "s.vec_id", "s.gt")
    out = None
    for shape in ("bbox", "quad", "polygon"):
        part = TG.in_shape(best, "gt", shape, FRAME, FRAME, whole=False).where("target_count > 0")
        part = part.select("doc", "label", "vec_id", F.lit(shape).alias("shape"), F.col("target_count").alias("n"), F.posexplode("target").alias("i", "p"))
        out = part if out is None else out.unionByName(part)
    return out.select("doc", "label", "vec_id", "shape", "n", "i", F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"))


TARGET_SHAPES = f"""WITH {GT}, {EDGES}, {AREA}, r AS (SELECT vec_id//10 AS doc, label, vec_id, row_number() OVER (PARTITION BY vec_id//10, label ORDER BY area DESC, vec_id) AS k FROM a WHERE area>=8),
q AS ({CONVEX_QUAD}), s AS ({POLY_RESAMPLE.replace(",4) AS x", ",2) AS x").replace(",4) AS y", ",2) AS y")}),
t AS (SELECT vec_id, 'bbox' AS shape, 4 AS n, 0 AS i, round(min(x),2) AS x, round(min(y),2) AS y FROM v GROUP BY vec_id UNION ALL SELECT vec_id, 'bbox', 4, 1, round(max(x),2), round(max(y),2) FROM v GROUP BY vec_id
 UNION ALL SELECT vec_id, 'quad', 4, i, x, y FROM q UNION ALL SELECT vec_id, 'polygon', 12, i, x, y FROM s)
SELECT doc, label, vec_id, shape, n::INTEGER AS n, i::INTEGER AS i, x, y FROM r JOIN t USING (vec_id) WHERE k=1"""


def target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat rows of annotations: prompts by shape, mode and crop, and the answer as compact JSON on the grid or in pixels."""
    mode, crop = F.when(F.col("vec_id") % 2 == 0, "grid").otherwise("pixel"), F.when(F.col("vec_id") % 3 == 0, "chair").otherwise("none")
    on_grid = G.grid_box(G.scale_box(G.bounding_box(F.col("gt")), FRAME, FRAME, GRID, GRID), GRID, GRID)
    rows = TG.in_shape(polygons(spark, sf_dir).select("vec_id", "gt"), "gt", "bbox", FRAME, FRAME)
    grid = F.transform(F.array(F.struct(on_grid["x_min"].alias("x"), on_grid["y_min"].alias("y")), F.struct(on_grid["x_max"].alias("x"), on_grid["y_max"].alias("y"))), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    rows = rows.withColumn("target", F.when(mode == "grid", grid).otherwise(F.col("target")))
    side = F.when(mode == "grid", GRID).otherwise(FRAME)
    rows = TG.chat_rows_of(rows, F.lit("bbox"), mode, crop, F.lit(GRID), side, side)
    text = lambda k, b: F.col("messages")[k]["content"][b]["text"]
    return rows.select(
        "vec_id", "task_name", F.concat_ws(",", F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.size(m["content"]).cast("string")))).alias("roles"),
        text(0, 0).alias("system"), text(1, 1).alias("user"), text(2, 0).alias("answer"),
    )


def _sql_text(template: str) -> str:
    return "'" + template.replace("'", "''").replace("{grid}", str(GRID)).replace("{hint}", f"'||CASE WHEN vec_id%3=0 THEN '{TG.HINT}' ELSE '' END||'") + "'"


TARGET_CHAT = f"""WITH {GT}, {sql_bbox("b", "v")}, {sql_grid("g", "b")}
SELECT vec_id, CASE WHEN vec_id%2=0 THEN 'seat_contact_bounding_box_grid' ELSE 'seat_contact_bounding_box' END AS task_name, 'system:1,user:2,assistant:1' AS roles,
 CASE WHEN vec_id%2=0 THEN {_sql_text(TG.SYSTEM["bbox", "grid"])} ELSE {_sql_text(TG.SYSTEM["bbox", None])} END AS system, CASE WHEN vec_id%2=0 THEN {_sql_text(TG.USER["bbox", "grid"])} ELSE {_sql_text(TG.USER["bbox", None])} END AS user,
 CASE WHEN vec_id%2=0 THEN '{{"task":"seat_contact_bounding_box_grid","image_size":{{"width":{GRID},"height":{GRID}}},"seat_contact_box":{{"x_min":'||a0||',"y_min":'||b0||',"x_max":'||a1||',"y_max":'||b1||'}}}}'
  ELSE '{{"task":"seat_contact_bounding_box","image_size":{{"width":{FRAME},"height":{FRAME}}},"seat_contact_box":{{"x_min":'||round_even(x0,0)::INT||',"y_min":'||round_even(y0,0)::INT||',"x_max":'||round_even(x1,0)::INT||',"y_max":'||round_even(y1,0)::INT||'}}}}' END AS answer
FROM b JOIN g USING (vec_id)"""


def depth_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seat's side nearest to the back's centre, and where the seat's centroid lies in depth and across."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", polygon(0, 4).alias("seat"), polygon(8, 2).alias("back"))
    c, side = G.centroid(F.col("back")), G.edges(F.col("seat"))
    near = F.array_min(F.transform(side, lambda e: F.struct(F.hypot((e["a"]["x"] + e["b"]["x"]) * 0.5 - c["x"], (e["a"]["y"] + e["b"]["y"]) * 0.5 - c["y"]).alias("d"), e["i"].alias("i"))))
    rows = rows.withColumn("k", near["i"])
    mid = lambda i, j: G.point((G.at(F.col("seat"), F.col("k") + i)["x"] + G.at(F.col("seat"), F.col("k") + j)["x"]) * 0.5, (G.at(F.col("seat"), F.col("k") + i)["y"] + G.at(F.col("seat"), F.col("k") + j)["y"]) * 0.5)
    rows = rows.select("vec_id", "k", mid(0, 1).alias("m"), mid(2, 3).alias("f"), G.at(F.col("seat"), F.col("k")).alias("a"), G.at(F.col("seat"), F.col("k") + 1).alias("b"), G.centroid(F.col("seat")).alias("c"))
    share = lambda p, q, o: ((o["x"] - p["x"]) * (q["x"] - p["x"]) + (o["y"] - p["y"]) * (q["y"] - p["y"])) / (F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2))
    return rows.select("vec_id", F.col("k").alias("back_edge"), r4(share(F.col("m"), F.col("f"), F.col("c"))).alias("depth_t"), r4(share(F.col("a"), F.col("b"), F.col("c"))).alias("lateral_u"))


DEPTH = f"""WITH {sql_points("v", 0, 4)}, {sql_points("w", 8, 2)}, {EDGES}, c AS (SELECT vec_id, avg(x) AS cx, avg(y) AS cy FROM w GROUP BY vec_id),
n AS (SELECT vec_id, e.i, row_number() OVER (PARTITION BY vec_id ORDER BY sqrt(power((sx+ex)*0.5-cx,2)+power((sy+ey)*0.5-cy,2)), e.i) AS k FROM e JOIN c USING (vec_id)),
q AS (SELECT n.vec_id, n.i AS back_edge, p.x, p.y, (p.i-n.i+4)%4 AS o FROM n JOIN v p ON p.vec_id=n.vec_id WHERE k=1),
s AS (SELECT vec_id, back_edge, max(x) FILTER (o=0) AS sx, max(y) FILTER (o=0) AS sy, max(x) FILTER (o=1) AS ex, max(y) FILTER (o=1) AS ey,
      (max(x) FILTER (o=0)+max(x) FILTER (o=1))*0.5 AS mx, (max(y) FILTER (o=0)+max(y) FILTER (o=1))*0.5 AS my,
      (max(x) FILTER (o=2)+max(x) FILTER (o=3))*0.5 AS fx, (max(y) FILTER (o=2)+max(y) FILTER (o=3))*0.5 AS fy, avg(x) AS px, avg(y) AS py FROM q GROUP BY vec_id, back_edge)
SELECT vec_id, back_edge::INTEGER AS back_edge, round(((px-mx)*(fx-mx)+(py-my)*(fy-my))/(power(fx-mx,2)+power(fy-my,2)),4) AS depth_t,
       round(((px-sx)*(ex-sx)+(py-sy)*(ey-sy))/(power(ex-sx,2)+power(ey-sy,2)),4) AS lateral_u FROM s"""


def distance_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = F.transform("gt", lambda p: G.point(F.round(p["x"] / 40.0, 0) * 3.0, F.round(p["y"] / 40.0, 0) * 0.5))
    rows = polygons(spark, sf_dir).select("vec_id", A.dedupe_by_distance(dense).alias("kept"), A.sorted_distinct(F.col("gt")).alias("hull_input"))
    return rows.select("vec_id", F.size("kept").alias("n_kept"), r4(G.fold_sum(G.xs(F.col("kept")))).alias("x_sum"), F.size("hull_input").alias("n_distinct"), r4(F.col("hull_input")[0]["x"]).alias("first_x"))


DISTANCE_DEDUPE = f"""WITH RECURSIVE {GT}, d AS (SELECT vec_id, i, round(x/40.0)*3.0 AS dx, round(y/40.0)*0.5 AS dy FROM v),
f AS (SELECT vec_id, i, dx AS lx, dy AS ly, dx AS fx, dy AS fy, 1 AS n, dx AS total FROM d WHERE i=0
 UNION ALL SELECT f.vec_id, d.i, CASE WHEN keep THEN dx ELSE lx END, CASE WHEN keep THEN dy ELSE ly END, fx, fy, n+keep::INT, total+CASE WHEN keep THEN dx ELSE 0 END
 FROM f JOIN d ON d.vec_id=f.vec_id AND d.i=f.i+1, LATERAL (SELECT sqrt(power(dx-lx,2)+power(dy-ly,2))>=1.25 AS keep)),
e AS (SELECT *, n>1 AND sqrt(power(fx-lx,2)+power(fy-ly,2))<1.25 AS closed FROM f WHERE i=5)
SELECT vec_id, (n-closed::INT)::INTEGER AS n_kept, round(total-CASE WHEN closed THEN lx ELSE 0 END,4) AS x_sum, 6 AS n_distinct, round(round_even((SELECT min(x) FROM v WHERE v.vec_id=e.vec_id),6),4) AS first_x FROM e"""

QUERIES = {
    "poly_area": (poly_area, POLY_AREA),
    "poly_bbox_grid": (poly_bbox_grid, POLY_BBOX_GRID),
    "poly_summary_by_label": (poly_summary_by_label, POLY_SUMMARY),
    "poly_point_in": (poly_point_in, POLY_POINT_IN),
    "poly_edge_distance": (poly_edge_distance, POLY_EDGE_DISTANCE),
    "poly_dedupe_resample": (poly_dedupe_resample, POLY_RESAMPLE),
    "poly_convex_quad": (poly_convex_quad, CONVEX_QUAD),
    "box_iou": (box_iou, BOX_IOU),
    "iou_eval_summary": (iou_eval_summary, IOU_EVAL),
    "reject_rules": (reject_rules, REJECT),
    "hard_cases": (hard_cases, HARD_CASES),
    "scale_laws": (scale_laws, SCALE_LAWS),
    "crop_shift": (crop_shift, CROP_SHIFT),
    "target_annotation": (target_annotation, TARGET_ANNOTATION),
    "target_shapes": (target_shapes, TARGET_SHAPES),
    "target_chat": (target_chat, TARGET_CHAT),
    "depth_projection": (depth_projection, DEPTH),
    "distance_dedupe": (distance_dedupe, DISTANCE_DEDUPE),
}
