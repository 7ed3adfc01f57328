"""Queries over the relational tables: joins, de-duplication, splits, rankings and row profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import relational as R
from tessera.session import table


def largest_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N' AND l_extendedprice >= 8")
    return shapes.groupBy("l_orderkey").agg(
        F.min_by("l_linenumber", F.struct((-F.col("l_extendedprice")).alias("a"), "l_linenumber", "l_partkey")).alias("shape"),
        F.max("l_extendedprice").alias("area"),
        F.count("*").alias("n_shapes"),
    )


LARGEST_SHAPE = """SELECT l_orderkey, min_by(l_linenumber, ROW(-l_extendedprice, l_linenumber, l_partkey)) AS shape, max(l_extendedprice) AS area, count(*) AS n_shapes
FROM lineitem WHERE l_returnflag='N' AND l_extendedprice>=8 GROUP BY l_orderkey"""


def best_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") * F.greatest("l_extendedprice", F.lit(1.0))).alias("score"))
    best = R.ranked_best(rows, ["l_orderkey"], F.col("score"), F.col("l_linenumber"), F.col("l_partkey"))
    return best.withColumn("score", F.round("score", 4))


BEST_DETECTION = """SELECT l_orderkey, l_linenumber, l_partkey, round(score,4) AS score FROM (
SELECT l_orderkey, l_linenumber, l_partkey, l_discount*greatest(l_extendedprice,1.0) AS score,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount*greatest(l_extendedprice,1.0) DESC, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k=1"""


def detection_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence, size and closeness to the centre in one score, in a frame of a million pixels; small ones are left out."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("conf"), (F.col("l_extendedprice") / 1e5).alias("ratio"), (F.col("l_quantity") / 50 - 0.5).alias("off")
    ).where("ratio >= 0.002")
    score = F.col("conf") + 0.5 * F.least(F.col("ratio") / 0.25, F.lit(1.0)) - 0.45 * F.col("off") * F.col("off")
    rows = rows.withColumn("score", score)
    place = F.struct((-F.col("score")).alias("s"), "l_linenumber", "l_partkey")
    best = rows.groupBy("l_orderkey").agg(
        F.min(place).alias("b"), F.avg("off").alias("centre"), F.max(F.col("conf") * F.greatest(F.col("ratio") * 1e5, F.lit(1.0))).alias("mask_score")
    ).select("l_orderkey", "b.l_linenumber", "b.l_partkey", (-F.col("b.s")).alias("score"), "centre", "mask_score")
    return best.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 4).alias(c) for c in ("score", "centre", "mask_score")])


DETECTION_COMPOSITE = """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS conf, l_extendedprice/1e5 AS ratio, l_quantity/50-0.5 AS off_ FROM lineitem WHERE l_extendedprice/1e5>=0.002),
s AS (SELECT *, conf+0.5*least(ratio/0.25,1.0)-0.45*off_*off_ AS score FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, l_partkey) AS k, avg(off_) OVER (PARTITION BY l_orderkey) AS centre,
      max(conf*greatest(ratio*1e5,1.0)) OVER (PARTITION BY l_orderkey) AS mask_score FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, round(score,4) AS score, round(centre,4) AS centre, round(mask_score,4) AS mask_score FROM b WHERE k=1"""


def shape_sum_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = table(spark, sf_dir, "lineitem").where("l_extendedprice >= 6").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("area_sum"), F.count("*").alias("num_polygons"))
    return shapes.where("area_sum >= 40000")


SHAPE_SUM = """SELECT * FROM (SELECT l_orderkey, round(sum(l_extendedprice),2) AS area_sum, count(*) AS num_polygons FROM lineitem WHERE l_extendedprice>=6 GROUP BY l_orderkey) WHERE area_sum>=40000"""

EXTENSIONS = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END"


def stem_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as annotations, orders as images: of a customer's orders the one of the best priority, then the first."""
    images = table(spark, sf_dir, "orders").selectExpr("o_custkey AS c_custkey", "o_orderkey", "o_orderpriority")
    notes = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return R.first_match(notes, images, "c_custkey", F.expr(EXTENSIONS), "o_orderkey")


STEM_JOIN = f"""SELECT c_custkey, c_name, o_orderkey, o_orderpriority FROM (SELECT c_custkey, c_name, o_orderkey, o_orderpriority,
row_number() OVER (PARTITION BY c_custkey ORDER BY {EXTENSIONS}, o_orderkey) AS k FROM customer JOIN orders ON o_custkey=c_custkey) WHERE k=1"""


def anti_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_custkey AS c_custkey")
    return R.unmatched(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


ANTI_LEFT = "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderpriority='1-URGENT')"


def anti_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unmatched(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


ANTI_RIGHT = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("quality").isNotNull().alias("is_labelled"))


LEFT_DEFAULT = "SELECT d.doc_id, coalesce(quality,-1) AS quality, quality IS NOT NULL AS is_labelled FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id"


def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.assign_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


SPLIT = """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id)-1 AS p, count(*) OVER () AS n FROM documents),
s AS (SELECT doc_id, CASE WHEN p < round_even(n*0.85::DOUBLE,0) THEN 'train' WHEN p < round_even(n*0.85::DOUBLE,0)+round_even(n*0.10::DOUBLE,0) THEN 'val' ELSE 'test' END AS split FROM r)"""


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_assign(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


def dedupe(last: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Two sources of events, the even and the odd days, in one; one row per user and type stays."""
        events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", (F.dayofmonth("ts") % 2).alias("source_rank"))
        both = events.where("source_rank = 0").unionByName(events.where("source_rank = 1"))
        kept = R.keep_one(both, ["user_id", "event_type"], [F.col("source_rank"), F.col("event_id")], last)
        return kept.select("user_id", "event_type", "event_id", "value", "source_rank", (F.col("n") - 1).alias("duplicates"))

    return query


def sql_dedupe(order: str) -> str:
    return f"""SELECT user_id, event_type, event_id, value, source_rank, duplicates FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY source_rank {order}, event_id {order}) AS k,
count(*) OVER (PARTITION BY user_id, event_type)-1 AS duplicates FROM (SELECT user_id, event_type, event_id, value, (day(ts)%2)::INTEGER AS source_rank FROM events)) WHERE k=1"""


def topk_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best line of each order and at most three that go with it: near in score, size and position."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") + 0.01).alias("conf"), F.col("l_extendedprice").alias("area"))
    rows = rows.withColumn("score", F.col("conf") * F.col("area"))
    order = Window.partitionBy("l_orderkey").orderBy(F.col("score").desc(), "l_linenumber", "l_partkey")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("best", F.first(F.struct("conf", "area")).over(order))
    overlap = F.least("area", "best.area") / (F.greatest("area", "best.area") * 1.5)
    fits = (F.col("conf") >= 0.25 * F.col("best.conf")) & F.col("area").between(0.30 * F.col("best.area"), 10 * F.col("best.area")) & overlap.between(0.02, 0.70)
    # the best line comes first in the same order, so one exchange and one sort serve both windows
    fused = rows.where((F.col("place") == 1) | fits).withColumn("rank", F.row_number().over(order)).where("rank <= 4")
    return fused.select("l_orderkey", "l_linenumber", "l_partkey", "rank", F.round("score", 4).alias("score"))


TOPK = """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount+0.01 AS conf, l_extendedprice AS area, (l_discount+0.01)*l_extendedprice AS score,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_discount+0.01)*l_extendedprice DESC, l_linenumber, l_partkey) AS k FROM lineitem),
j AS (SELECT r.*, r.conf>=0.25*b.conf AND r.area BETWEEN 0.30*b.area AND 10*b.area AND least(r.area,b.area)/(greatest(r.area,b.area)*1.5) BETWEEN 0.02 AND 0.70 AS fits
  FROM r JOIN r b ON b.l_orderkey=r.l_orderkey AND b.k=1)
SELECT l_orderkey, l_linenumber, l_partkey, rank::INTEGER AS rank, round(score,4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) AS rank FROM j WHERE k=1 OR fits) WHERE rank<=4"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evaluated samples of a run per event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("adapter"),
        (F.col("event_id") % 9 != 0).alias("valid_json"),
        ((F.col("event_id") % 9 != 0) & (F.col("event_id") % 7 != 1)).alias("schema_valid"),
        (F.col("user_id") % 13 == 0).alias("placeholder"),
        F.least(F.col("value") / 200.0, F.lit(1.0)).alias("iou"),
    )


def adapter_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.evaluation_summary(_runs(spark, sf_dir), "adapter", digits=6).withColumn("score", F.round(M.selection_score(), 6))
    return rows.select("adapter", "score", F.row_number().over(Window.orderBy(F.col("score").desc(), "adapter")).alias("rank"))


SQL_RUNS = """s AS (SELECT event_type AS adapter, event_id%9<>0 AS j, event_id%9<>0 AND event_id%7<>1 AS ok, user_id%13=0 AS ph, least(value/200.0,1.0)::DOUBLE AS iou FROM events),
m AS (SELECT adapter, round(avg(j::INT),6) AS valid_json_rate, round(avg(ok::INT),6) AS schema_valid_rate, round(avg(ph::INT),6) AS placeholder_rate,
  round(coalesce(avg(iou),0),6) AS mean_iou_all, round(coalesce(avg(iou) FILTER (ok),0),6) AS mean_iou_schema_valid_only FROM s GROUP BY adapter)"""
ADAPTER_RANK = f"""WITH {SQL_RUNS}, t AS (SELECT adapter, round(0.65*mean_iou_schema_valid_only+0.20*mean_iou_all+0.10*schema_valid_rate+0.05*valid_json_rate-0.20*placeholder_rate,6) AS score FROM m)
SELECT adapter, score, row_number() OVER (ORDER BY score DESC, adapter)::INTEGER AS rank FROM t"""


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.evaluation_summary(_runs(spark, sf_dir), "adapter", digits=6).withColumn("first_failure", M.first_gate_failure())
    return rows.select("adapter", "first_failure", F.col("first_failure").isNull().alias("passed"))


QUALITY_GATE = f"""WITH {SQL_RUNS}, f AS (SELECT adapter, CASE WHEN valid_json_rate<0.80 THEN 'valid_json_rate < 0.80' WHEN schema_valid_rate<0.70 THEN 'schema_valid_rate < 0.70'
WHEN placeholder_rate>0.10 THEN 'placeholder_rate > 0.10' WHEN mean_iou_schema_valid_only<0.18 THEN 'mean_iou_schema_valid_only < 0.18' WHEN mean_iou_all<0.12 THEN 'mean_iou_all < 0.12' END AS first_failure FROM m)
SELECT adapter, first_failure, first_failure IS NULL AS passed FROM f"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as set pixels: the event type is the image, the day the row and the value the column."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("img"), F.dayofmonth("ts").alias("y"), F.col("value").alias("x"))


def row_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).groupBy("img", "y").agg(F.count("*").alias("width"), F.min("x").alias("x_min"), F.max("x").alias("x_max"))


ROW_PROFILE = "SELECT event_type AS img, day(ts)::INTEGER AS y, count(*) AS width, min(value) AS x_min, max(value) AS x_max FROM events GROUP BY 1,2"


def row_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.exact_percentiles(_pixels(spark, sf_dir), ["img", "y"], "x", {"left": 0.015, "right": 0.985})
    return rows.select("img", "y", F.col("left").cast("int").alias("left"), F.col("right").cast("int").alias("right"))


ROW_PERCENTILE = """SELECT event_type AS img, day(ts)::INTEGER AS y, trunc(quantile_cont(value,0.015))::INTEGER AS "left", trunc(quantile_cont(value,0.985))::INTEGER AS "right" FROM events GROUP BY 1,2"""


def peak_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each image: the widest row of the middle band, the first later row under 55 % of it, and the run around it."""
    rows = row_profile(spark, sf_dir).select("img", "y", "width")
    peaks = rows.where("y BETWEEN 9 AND 25").groupBy("img").agg(F.min_by("y", F.struct((-F.col("width")).alias("w"), "y")).alias("peak"), F.max("width").alias("top"))
    joined = rows.join(peaks, "img")
    drop = F.greatest(F.lit(5), (F.col("top") * 0.55).cast("int"))
    low = F.col("width") < F.rint(F.col("top") * 0.68)
    found = joined.groupBy("img", "peak", "top").agg(
        F.min(F.when((F.col("y") > F.col("peak")) & (F.col("width") < drop), F.col("y"))).alias("drop_row"),
        F.max(F.when((F.col("y") < F.col("peak")) & low, F.col("y"))).alias("before"),
        F.min(F.when((F.col("y") > F.col("peak")) & low, F.col("y"))).alias("after"),
        F.min("y").alias("first"), F.max("y").alias("last"),
    )
    return found.select("img", "peak", "top", F.coalesce("drop_row", F.lit(24)).alias("drop_row"), F.coalesce(F.col("before") + 1, "first").alias("run_start"), F.coalesce(F.col("after") - 1, "last").alias("run_end"))


PEAK_RUN = """WITH r AS (SELECT event_type AS img, day(ts)::INTEGER AS y, count(*) AS width FROM events GROUP BY 1,2),
p AS (SELECT img, arg_min(y, ROW(-width,y)) AS peak, max(width) AS top FROM r WHERE y BETWEEN 9 AND 25 GROUP BY img)
SELECT img, peak, top, coalesce(min(y) FILTER (y>peak AND width<greatest(5,trunc(top*0.55::DOUBLE))),24) AS drop_row,
 coalesce(max(y) FILTER (y<peak AND width<round_even(top*0.68::DOUBLE,0))+1,min(y)) AS run_start, coalesce(min(y) FILTER (y>peak AND width<round_even(top*0.68::DOUBLE,0))-1,max(y)) AS run_end
FROM r JOIN p USING (img) GROUP BY img, peak, top"""


def nearest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each image and day: the nearest day with a span of errors within eight days, the earlier one first, else the full span."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("img"), F.dayofmonth("ts").alias("y"), "value", "event_type")
    spans = rows.where("event_type = 'error' AND value > 60").groupBy("img", "y").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    wanted = rows.select("img").distinct().select("img", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("row_y"))
    near = wanted.join(spans, "img", "left").where("y IS NULL OR abs(y - row_y) <= 8").groupBy("img", "row_y").agg(F.min_by(F.struct("y", "lo", "hi"), F.struct(F.abs(F.col("y") - F.col("row_y")).alias("d"), "y")).alias("s"))
    return wanted.join(near, ["img", "row_y"], "left").select("img", "row_y", F.col("s.y").alias("source_row"), F.coalesce("s.lo", F.lit(0.0)).alias("lo"), F.coalesce("s.hi", F.lit(500.0)).alias("hi"))


NEAREST_ROW = """WITH r AS (SELECT user_id%20 AS img, day(ts)::INTEGER AS y, value, event_type FROM events), s AS (SELECT img, y, min(value) AS lo, max(value) AS hi FROM r WHERE event_type='error' AND value>60 GROUP BY 1,2),
w AS (SELECT img, k::INTEGER AS row_y FROM (SELECT DISTINCT img FROM r), range(1,31) t(k)),
n AS (SELECT w.img, row_y, y, lo, hi, row_number() OVER (PARTITION BY w.img, row_y ORDER BY abs(y-row_y), y) AS k FROM w JOIN s ON w.img=s.img AND abs(y-row_y)<=8)
SELECT w.img, w.row_y, y AS source_row, coalesce(lo,0.0) AS lo, coalesce(hi,500.0) AS hi FROM w LEFT JOIN n ON w.img=n.img AND w.row_y=n.row_y AND k=1"""


def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    ends = rows.groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = (F.col("value") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))
    return rows.join(ends, "user_id").select("event_id", F.round(scaled, 4).alias("u"))


MINMAX = "SELECT event_id, round((value-min(value) OVER w)/greatest(max(value) OVER w-min(value) OVER w,1e-6),4) AS u FROM events WINDOW w AS (PARTITION BY user_id)"


def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return R.stride_sample(rows, R.range_block(rows, "p_partkey"), [F.col("p_partkey")], 150)


STRIDE = """WITH r AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey)-1 AS position, count(*) OVER () AS n FROM part)
SELECT p_partkey, p_name, position FROM r WHERE n<=150 OR position IN (SELECT least(round_even(i*((SELECT count(*) FROM part)/150.0::DOUBLE),0)::BIGINT,(SELECT count(*) FROM part)-1) FROM range(150) t(i))"""


def limit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows, and a preview of rows in hash order."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    head = rows.orderBy("doc_id").limit(20).withColumn("part", F.lit("head"))
    _, order = R.hash_order("doc_id")
    preview = rows.orderBy(*order).limit(12).withColumn("part", F.lit("preview"))
    return head.unionByName(preview)


LIMIT_SAMPLE = """(SELECT doc_id, source, 'head' AS part FROM documents ORDER BY doc_id LIMIT 20) UNION ALL (SELECT doc_id, source, 'preview' FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 12)"""


def skip_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why orders are skipped as samples: no shapes, none of the label, all too small; else kept."""
    shapes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("labelled"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("largest")
    )
    rows = table(spark, sf_dir, "orders").join(shapes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    reason = F.when(F.col("l_orderkey").isNull(), "no_shapes").when(F.col("labelled") == 0, "no_label").when(F.col("largest") < 30000, "too_small").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


SKIP = """WITH s AS (SELECT l_orderkey, count(*) FILTER (l_returnflag='R') AS n, max(l_extendedprice) FILTER (l_returnflag='R') AS m FROM lineitem GROUP BY 1)
SELECT CASE WHEN l_orderkey IS NULL THEN 'no_shapes' WHEN s.n=0 THEN 'no_label' WHEN m<30000 THEN 'too_small' ELSE 'kept' END AS reason, count(*) AS n FROM orders LEFT JOIN s ON o_orderkey=l_orderkey GROUP BY 1"""


def fallback_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a prediction is replaced: missing, unsure, or too little overlap or area."""
    rows = table(spark, sf_dir, "lineitem").where("l_extendedprice >= 0.002 * 1000000")
    conf, overlap, ratio = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50
    missing = F.col("l_linestatus") == "X"
    use = missing | (conf < 0.02) | (overlap < 0.01) | (F.col("l_tax") < 0.005) | ((F.col("l_quantity") > 0) & (ratio < 0.1))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(use).alias("n_fallback"))


FALLBACK_DECISION = """SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus='X' OR l_discount<0.02 OR l_tax<0.01 OR l_tax<0.005 OR (l_quantity>0 AND l_quantity/50<0.1)) AS n_fallback
FROM lineitem WHERE l_extendedprice>=2000 GROUP BY l_returnflag"""


def gate_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as training runs: their orders are evaluated steps, and an order's lines the attempts to train it."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    step = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) * 10
    share = lambda n: (F.col("o_totalprice").cast("long") % n) / float(n)
    told = orders.select(F.col("o_custkey").alias("run"), step.alias("step"), "o_orderkey", (0.7 + share(31) * 0.3).alias("valid_json_rate"), (0.6 + share(37) * 0.4).alias("schema_valid_rate"),
                         (share(41) * 0.15).alias("placeholder_rate"), (0.1 + share(43) * 0.3).alias("mean_iou_schema_valid_only"), (0.08 + share(47) * 0.3).alias("mean_iou_all"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("attempt"), (F.col("l_returnflag") != "R").alias("trained"))
    attempts = lines.join(told.select("run", "step", "o_orderkey"), "o_orderkey").select("run", "step", "attempt", "trained")
    return M.gate_runs(told.drop("o_orderkey"), attempts, schedule=[10, 30], delta=20, most=90, retries=1)


GATE_SCHEDULE = """WITH e AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)*10 AS step, o_orderkey, o_totalprice::BIGINT AS p0, trunc(o_totalprice)::BIGINT AS p FROM orders),
s AS (SELECT run, step, step AS s, 0.7+(p%31)/31.0::DOUBLE*0.3>=0.80 AND 0.6+(p%37)/37.0::DOUBLE*0.4>=0.70 AND (p%41)/41.0::DOUBLE*0.15<=0.10 AND 0.1+(p%43)/43.0::DOUBLE*0.3>=0.18 AND 0.08+(p%47)/47.0::DOUBLE*0.3>=0.12 AS passed,
  (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey=o_orderkey AND l_returnflag<>'R') AS first_good, (SELECT count(*) FROM lineitem WHERE l_orderkey=o_orderkey) AS n FROM e WHERE step IN (10,30,50,70,90)),
w AS (SELECT run, unnest([10,30,50,70,90]) AS step FROM (SELECT DISTINCT run FROM e)),
j AS (SELECT w.run, w.step, passed, coalesce(first_good<=2,false) AS trained, CASE WHEN first_good<=2 THEN first_good ELSE least(2,coalesce(n,0)) END AS used FROM w LEFT JOIN s ON s.run=w.run AND s.step=w.step),
f AS (SELECT *, min(CASE WHEN NOT trained OR passed THEN step END) OVER (PARTITION BY run) AS stop FROM j)
SELECT run, CASE WHEN max(CASE WHEN step=stop AND trained AND passed THEN 1 ELSE 0 END)=1 THEN 'passed' WHEN max(stop) IS NULL THEN 'exhausted' ELSE 'failed' END AS status,
 max(CASE WHEN step=stop AND trained AND passed THEN step END)::INTEGER AS pass_step, count(*) FILTER (trained AND (stop IS NULL OR step<=stop)) AS n_evaluated, sum(CASE WHEN stop IS NULL OR step<=stop THEN used ELSE 0 END)::BIGINT AS n_attempts,
 max(CASE WHEN trained AND NOT passed AND (stop IS NULL OR step<stop) THEN step END)::INTEGER AS resume_step FROM f GROUP BY run"""


def gate_first_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each run: the first step whose score passes, after how many tries, with steps in order of time."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("run"), "event_id", "value")
    return rows.groupBy("run").agg(
        F.min(F.when(F.col("value") >= 120, F.col("event_id"))).alias("first_pass"),
        F.count("*").alias("n_steps"),
        F.count_if(F.col("value") < 20).alias("n_failed"),
    ).withColumn("status", F.when(F.col("first_pass").isNotNull(), "passed").otherwise("exhausted"))


GATE_FIRST = """SELECT user_id%50 AS run, min(event_id) FILTER (value>=120) AS first_pass, count(*) AS n_steps, count(*) FILTER (value<20) AS n_failed,
CASE WHEN min(event_id) FILTER (value>=120) IS NULL THEN 'exhausted' ELSE 'passed' END AS status FROM events GROUP BY 1"""


def repair_attempts(spark: SparkSession, sf_dir: str, run: Column, attempt: Column) -> DataFrame:
    """Events as recorded repair attempts: run, attempt, score and whether the stage went through."""
    return table(spark, sf_dir, "events").select(run.alias("run"), attempt.alias("attempt"), (F.floor(F.col("value")) % 5).cast("int").alias("score"), (F.col("event_type") != "error").alias("ok"))


def folded(rows: DataFrame) -> DataFrame:
    """Attempts folded in order within their run: stop at a score of 3 or a failed stage, accept what is no worse."""
    runs = rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("attempt", "score", "ok"))).alias("tries"))
    start = F.struct(F.lit(1).alias("score"), F.lit(0).alias("used"), F.lit(0).alias("accepted"), F.lit(False).alias("stopped"))

    def step(s, t):
        done = s["stopped"] | (s["score"] >= 3)
        better = t["ok"] & (t["score"] >= s["score"])
        return F.when(done, s).otherwise(
            F.struct(F.when(better, t["score"]).otherwise(s["score"]).alias("score"), (s["used"] + 1).alias("used"), (s["accepted"] + better.cast("int")).alias("accepted"), (~t["ok"]).alias("stopped"))
        )

    state = F.aggregate("tries", start, step)
    out = runs.select("run", state.alias("s")).select("run", "s.*")
    status = F.when(F.col("score") >= 3, "ok").when(F.col("stopped"), "failed").otherwise("low_score")
    return out.select("run", "score", "used", "accepted", status.alias("status"))


def repair_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an attempt of a run of six ids, folded: the runs grow with the table."""
    return folded(repair_attempts(spark, sf_dir, F.floor(F.col("event_id") / 6), F.col("event_id")))


REPAIR_FOLD = """WITH RECURSIVE t AS (SELECT event_id//6 AS run, row_number() OVER (PARTITION BY event_id//6 ORDER BY event_id, floor(value)::BIGINT%5, event_type<>'error') AS k, (floor(value)::BIGINT%5)::INTEGER AS score, event_type<>'error' AS ok FROM events),
f AS (SELECT run, 0::BIGINT AS k, 1 AS score, 0 AS used, 0 AS accepted, false AS stopped FROM (SELECT DISTINCT run FROM t)
 UNION ALL SELECT f.run, t.k, CASE WHEN t.ok AND t.score>=f.score THEN t.score ELSE f.score END, f.used+1, f.accepted+(t.ok AND t.score>=f.score)::INTEGER, NOT t.ok
  FROM f JOIN t ON t.run=f.run AND t.k=f.k+1 WHERE NOT f.stopped AND f.score<3)
SELECT run, score, used, accepted, CASE WHEN score>=3 THEN 'ok' WHEN stopped THEN 'failed' ELSE 'low_score' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k DESC) AS r FROM f) WHERE r=1"""

QUERIES = {
    "largest_shape": (largest_shape, LARGEST_SHAPE),
    "best_detection": (best_detection, BEST_DETECTION),
    "detection_composite": (detection_composite, DETECTION_COMPOSITE),
    "shape_sum_filter": (shape_sum_filter, SHAPE_SUM),
    "stem_join": (stem_join, STEM_JOIN),
    "anti_left": (anti_left, ANTI_LEFT),
    "anti_right": (anti_right, ANTI_RIGHT),
    "left_default": (left_default, LEFT_DEFAULT),
    "split_assign": (split_assign, f"{SPLIT} SELECT * FROM s"),
    "split_counts": (split_counts, f"{SPLIT} SELECT split, count(*) AS n FROM s GROUP BY split"),
    "dedupe_last": (dedupe(True), sql_dedupe("DESC")),
    "dedupe_first": (dedupe(False), sql_dedupe("ASC")),
    "topk_fusion": (topk_fusion, TOPK),
    "adapter_rank": (adapter_rank, ADAPTER_RANK),
    "quality_gate": (quality_gate, QUALITY_GATE),
    "row_profile": (row_profile, ROW_PROFILE),
    "row_percentile": (row_percentile, ROW_PERCENTILE),
    "peak_run": (peak_run, PEAK_RUN),
    "nearest_row": (nearest_row, NEAREST_ROW),
    "minmax_norm": (minmax_norm, MINMAX),
    "stride_sample": (stride_sample, STRIDE),
    "limit_sample": (limit_sample, LIMIT_SAMPLE),
    "skip_counters": (skip_counters, SKIP),
    "fallback_decision": (fallback_decision, FALLBACK_DECISION),
    "gate_schedule": (gate_schedule, GATE_SCHEDULE),
    "gate_first_pass": (gate_first_pass, GATE_FIRST),
    "repair_fold": (repair_fold, REPAIR_FOLD),
}
