"""Aggregates of evaluations: rates, means, medians, gates, ranking scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gate thresholds: metric, whether it must not fall below (else not exceed), bound.
GATE = (
    ("valid_json_rate", True, 0.80),
    ("schema_valid_rate", True, 0.70),
    ("placeholder_rate", False, 0.10),
    ("mean_iou_schema_valid_only", True, 0.18),
    ("mean_iou_all", True, 0.12),
)
#: Weights of the selection score.
SELECTION = (
    ("mean_iou_schema_valid_only", 0.65),
    ("mean_iou_all", 0.20),
    ("schema_valid_rate", 0.10),
    ("valid_json_rate", 0.05),
    ("placeholder_rate", -0.20),
)


def rate(flag: str | Column) -> Column:
    """The share of rows for which a flag holds."""
    return F.avg(F.col(flag).cast("int") if isinstance(flag, str) else flag.cast("int"))


#: Values that a task may put in order to find one rank; more are narrowed down first.
ORDERED_MOST = 1 << 16
#: Quantiles that a round of narrowing compares a rank with, and the accuracy of their sketch, eight steps within each.
QUANTILES = 256


def _narrowed(told: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same ranks between nearer bounds, from a sketch of the values between the old ones.

    A sketch's ranks are wrong by an eighth of a quantile at most, and a whole one is left on both sides; values are counted
    again between the new bounds, and bounds that the count does not confirm stay as they were.
    """
    inside = told.join(wanted, "g").where("v BETWEEN low AND high")
    steps = F.array(*[F.lit(i / QUANTILES) for i in range(1, QUANTILES)])
    cuts = inside.groupBy("g", "r").agg(F.percentile_approx("v", steps, F.lit(8 * QUANTILES)).alias("cuts"))
    met = wanted.join(cuts, ["g", "r"])
    at = F.floor((F.col("r") - F.col("before")) / F.col("held") * QUANTILES).cast("int")
    near = met.withColumn("near_low", F.coalesce(F.get("cuts", at - 2), "low")).withColumn("near_high", F.coalesce(F.get("cuts", at + 1), "high")).drop("cuts")
    near = near.withColumn("near_low", F.greatest("near_low", "low")).withColumn("near_high", F.least("near_high", "high"))
    counted = told.join(near, "g").where("v BETWEEN low AND near_high").groupBy("g", "r").agg(
        F.count_if(F.col("v") < F.col("near_low")).alias("less"), F.count_if(F.col("v") >= F.col("near_low")).alias("kept")
    )
    near = near.join(counted, ["g", "r"])
    good = (F.col("before") + F.col("less") <= F.col("r")) & (F.col("r") < F.col("before") + F.col("less") + F.col("kept"))
    pick = lambda new, old: F.when(good, new).otherwise(F.col(old)).alias(old)
    return near.select("g", "r", "n", pick(F.col("near_low"), "low"), pick(F.col("near_high"), "high"), pick(F.col("before") + F.col("less"), "before"), pick(F.col("kept"), "held"))


def exact_percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], most: int = ORDERED_MOST) -> DataFrame:
    """Exact interpolated percentiles of each group, by name of share, with no more than `most` values of a group in one task.

    Bounds around each wanted rank start as the group's least and greatest value. While they hold more than `most` rows,
    a mergeable sketch of the values between them gives nearer ones: bounds follow ranks and not values, so outliers and
    other odd distributions change nothing, and each round leaves about an eightieth. Between the
    bounds, the distinct values are put in order. Nulls and NaN are left out, and so is a group without values.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    told = rows.select(group.alias("g"), F.explode(F.array(F.col(value).cast("double"))).alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    place = {name: F.lit(share) * (F.col("n") - 1) for name, share in shares.items()}
    ranks = F.array_distinct(F.array(*[rank for p in place.values() for rank in (F.floor(p), F.ceil(p))]))
    values = told.groupBy("g", "v").agg(F.count("*").alias("m"))  # one exchange, which both uses below share
    wanted = values.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("m").alias("n"))
    wanted = wanted.select("g", F.explode(ranks).alias("r"), "n", "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("held"))
    if (rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > most:  # counted without working the values out
        open_ = (F.col("held") > most) & (F.col("low") < F.col("high"))
        left = None
        while (now := wanted.where(open_).agg(F.sum("held")).first()[0]) and now != left:
            left, wanted = now, _narrowed(told, wanted)
    within = values.join(wanted, "g").where("v BETWEEN low AND high")
    first = F.col("before") + F.sum("m").over(Window.partitionBy("g", "r").orderBy("v")) - F.col("m")
    hits = within.withColumn("first", first).where("r >= first AND r < first + m").groupBy("g").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("at"))
    between = lambda p: F.col("at")[F.floor(p)] + (F.col("at")[F.ceil(p)] - F.col("at")[F.floor(p)]) * (p - F.floor(p))
    return hits.select(*[F.col(f"g.{c}").alias(c) for c in by], *[between(p).alias(name) for name, p in place.items()])


def evaluation_summary(rows: DataFrame, *by: str, digits: int = 4) -> DataFrame:
    """Rates and IoU summaries of rows with valid_json, schema_valid, placeholder and iou; means of nothing are 0."""
    valid = F.when(F.col("schema_valid"), F.col("iou"))
    told = rows.groupBy(*by).agg(
        F.count("*").alias("num_samples"),
        *[F.round(rate(c), digits).alias(f"{c}_rate") for c in ("valid_json", "schema_valid", "placeholder")],
        F.round(F.coalesce(F.avg("iou"), F.lit(0.0)), digits).alias("mean_iou_all"),
        F.round(F.coalesce(F.avg(valid), F.lit(0.0)), digits).alias("mean_iou_schema_valid_only"),
    )
    medians = exact_percentiles(rows.select(*by, valid.alias("iou")), list(by), "iou", {"_median": 0.5})
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by]
    joined = told.alias("t").join(medians.alias("m"), same or F.lit(True), "left")
    return joined.select("t.*", F.round(F.coalesce("_median", F.lit(0.0)), digits).alias("median_iou_schema_valid_only"))


def selection_score() -> Column:
    total = F.lit(0.0)
    for name, weight in SELECTION:
        total = total + F.col(name) * weight
    return total


def first_gate_failure() -> Column:
    """The first threshold that a row of metrics misses, or null."""
    return F.coalesce(*[F.when(F.col(n) < t if low else F.col(n) > t, F.lit(f"{n} {'<' if low else '>'} {t:.2f}")) for n, low, t in GATE])


def gate_runs(told: DataFrame, attempts: DataFrame, schedule: list[int], delta: int, most: int, retries: int) -> DataFrame:
    """How each run goes through a gate that trains to a step, evaluates it, and goes on from it until one passes.

    told has run, step and the metrics of GATE; attempts has run, step, attempt (from 1) and trained. The steps are the
    schedule, then on by `delta` up to `most`. A step is tried `retries` times more; if none trains it, or nothing is
    told of it, the run has failed. Returns run, status (passed, failed, exhausted), pass_step, n_evaluated, n_attempts and
    resume_step, the last step that was evaluated and did not pass.
    """
    steps = [*schedule, *range(schedule[-1] + delta, most + 1, delta)] if delta > 0 else list(schedule)
    plan = told.unionByName(attempts.select("run"), allowMissingColumns=True).select("run").distinct().select("run", F.explode(F.array(*map(F.lit, steps))).alias("step"))
    tried = attempts.where(F.col("step").isin(steps)).groupBy("run", "step").agg(F.min(F.when(F.col("trained"), F.col("attempt"))).alias("good"), F.count("*").alias("n"))
    graded = told.where(F.col("step").isin(steps)).select("run", "step", first_gate_failure().isNull().alias("passed"))
    rows = plan.join(tried, ["run", "step"], "left").join(graded, ["run", "step"], "left")
    trained = F.coalesce(F.col("good") <= retries + 1, F.lit(False)) & F.col("passed").isNotNull()
    used = F.when(F.col("good") <= retries + 1, F.col("good")).otherwise(F.least(F.lit(retries + 1), F.coalesce("n", F.lit(0))))
    each = F.array_sort(F.collect_list(F.struct("step", trained.alias("trained"), F.coalesce("passed", F.lit(False)).alias("passed"), used.cast("long").alias("used"))))
    runs = rows.groupBy("run").agg(each.alias("s"))
    stop = F.array_min(F.transform(F.filter("s", lambda x: ~x["trained"] | x["passed"]), lambda x: x["step"]))
    runs = runs.select("run", "s", stop.alias("stop"))
    done = F.filter("s", lambda x: F.col("stop").isNull() | (x["step"] <= F.col("stop")))
    at_stop = F.exists("s", lambda x: (x["step"] == F.col("stop")) & x["trained"] & x["passed"])
    passed = F.coalesce(at_stop, F.lit(False))
    return runs.select(
        "run",
        F.when(passed, "passed").when(F.col("stop").isNull(), "exhausted").otherwise("failed").alias("status"),
        F.when(passed, F.col("stop")).alias("pass_step"),
        F.size(F.filter(done, lambda x: x["trained"])).cast("long").alias("n_evaluated"),
        F.aggregate(done, F.lit(0).cast("long"), lambda n, x: n + x["used"]).alias("n_attempts"),
        F.array_max(F.transform(F.filter(done, lambda x: x["trained"] & ~x["passed"]), lambda x: x["step"])).alias("resume_step"),
    )
