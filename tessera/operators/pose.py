"""Seat geometry: clean-up, repair by sitting priors, canonical fallbacks, fallback poses, the local check, contact candidates.

A geometry is three columns: seat (4 points), floor (2) and back (2). Steps add columns
and pin them with fixed(), as each is read many times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions.arrays import fixed
from tessera.operators import validate as V

#: Names of a pose's points (fixed values).
KEYPOINTS = ["hip_center"] + [f"{side}_{joint}" for joint in ("knee", "ankle", "shoulder", "elbow", "wrist") for side in ("left", "right")]
#: Names of the local checks (fixed values).
CHECKS = ["hip_on_seat", "knees_in_front_of_hip", "ankles_below_seat_near_floor", "limb_ordering_consistent"]


def _two(value: Column) -> Column:
    return F.bround(value, 2)


def canonical(width: int, height: int) -> tuple[Column, Column, Column]:
    """Seat, floor and back at usual places of a frame."""
    x = lambda share: _two(G.clamp(F.lit(share * width), 0.0, width - 1.0))
    y = lambda share: _two(G.clamp(F.lit(share * height), 0.0, height - 1.0))
    seat = F.array(G.point(x(0.28), y(0.52)), G.point(x(0.72), y(0.52)), G.point(x(0.72), y(0.62)), G.point(x(0.28), y(0.62)))
    return seat, F.array(G.point(x(0.10), y(0.88)), G.point(x(0.90), y(0.88))), F.array(G.point(x(0.28), y(0.30)), G.point(x(0.72), y(0.30)))


def sanitize(df: DataFrame, width: int, height: int) -> DataFrame:
    """Clamps seat, floor and back, replaces what is too small, adds notes and ok (whether the result is valid)."""
    limits = F.lit(width), F.lit(height)
    for name in ("seat", "floor", "back"):
        df = fixed(df, f"_{name}", G.clamp_points(F.col(name), width, height))
    moved = F.lit(False)
    for name in ("seat", "floor", "back"):
        moved = moved | (F.col(f"_{name}") != F.col(name))
    seat, floor, back = F.col("_seat"), F.col("_floor"), F.col("_back")
    df = df.select("*", G.centroid(seat).alias("_c"))
    flat = G.polygon_area(seat) < max(20.0, 0.002 * width * height)
    half_w, half_h = max(0.08 * width, 24.0), max(0.05 * height, 16.0)
    around = [(-half_w, -half_h), (half_w, -half_h), (half_w, half_h), (-half_w, half_h)]
    block = F.array(*[G.point(G.clamp(F.col("_c.x") + dx, 0.0, width - 1.0), G.clamp(F.col("_c.y") + dy, 0.0, height - 1.0)) for dx, dy in around])
    short = V.line_length(floor) < max(10.0, 0.05 * width)
    floor_y = G.clamp(F.greatest(floor[0]["y"], floor[1]["y"]), 0.75 * height, height - 1.0)
    low = V.line_length(back) < max(10.0, 0.03 * width)
    back_y = G.clamp(F.least(back[0]["y"], back[1]["y"]), 0.15 * height, 0.6 * height)
    line = lambda a, b, y: F.array(G.point(G.clamp(F.lit(a * width), 0.0, width - 1.0), y), G.point(G.clamp(F.lit(b * width), 0.0, width - 1.0), y))
    notes = V.errors((moved, "clamped out-of-bounds geometry point(s)"), (flat, "repaired degenerate seat_region"), (short, "repaired short floor_line"), (low, "repaired short backrest_region"))
    made = F.struct(
        F.when(flat, block).otherwise(seat).alias("seat"), F.when(short, line(0.15, 0.85, floor_y)).otherwise(floor).alias("floor"),
        F.when(low, line(0.25, 0.75, back_y)).otherwise(back).alias("back"), F.concat(F.col("notes"), notes).alias("notes") if "notes" in df.columns else notes.alias("notes"),
    )
    keep = [c for c in df.columns if c not in ("seat", "floor", "back", "notes", "ok", "_seat", "_floor", "_back", "_c")]
    df = fixed(df.select(*keep, made.alias("_m")), "_g", F.col("_m")).select(*keep, "_g.*")
    return df.withColumn("ok", F.size(V.geometry_errors(F.col("seat"), F.col("floor"), F.col("back"), *limits)) == 0)


def _move_y(points: Column, to) -> Column:
    return F.transform(points, lambda p: G.point(p["x"], to(p["y"])))


def repair(df: DataFrame, width: int, height: int) -> DataFrame:
    """sanitize(), then moves seat, floor and back where sitting priors want them; ok tells whether none is broken any more."""
    h, y_max = float(height), height - 1.0
    df = sanitize(df, width, height)
    df = fixed(df, "_issues", V.prior_issues(F.col("seat"), F.col("floor"), F.col("back"), F.lit(height)))
    broken = F.size("_issues") > 0

    def step(df: DataFrame, bad: Column, points: Column, note: str) -> DataFrame:
        df = fixed(df, "_s", F.struct(F.when(bad & broken, points).otherwise(F.col("seat")).alias("seat"), F.when(bad & broken, F.concat("notes", F.array(F.lit(note)))).otherwise(F.col("notes")).alias("notes")))
        return df.withColumn("seat", F.col("_s.seat")).withColumn("notes", F.col("_s.notes")).drop("_s")

    top, bottom = F.array_min(G.ys(F.col("seat"))), F.array_max(G.ys(F.col("seat")))
    thick = F.greatest(bottom - top, F.lit(1.0))
    middle = (top + bottom) * 0.5

    def spread(share: float) -> Column:
        new_top = G.clamp(middle - share * h / 2, 0.18 * h, y_max - share * h)
        new_bottom = G.clamp(new_top + share * h, 0.0, y_max)
        return F.transform("seat", lambda p: G.point(p["x"], F.when(p["y"] <= middle, new_top).otherwise(new_bottom)))

    thin, fat = thick < 0.06 * h, thick > 0.22 * h
    note = F.when(thin, "expanded seat vertical thickness to meet sitting prior").when(fat, "compressed seat vertical thickness to meet sitting prior")
    spreads = F.when(thin, spread(0.06)).when(fat, spread(0.22)).otherwise(F.col("seat"))
    df = fixed(df, "_s", F.struct(F.when(broken, spreads).otherwise(F.col("seat")).alias("seat"), F.when(broken & note.isNotNull(), F.concat("notes", F.array(note))).otherwise(F.col("notes")).alias("notes")))
    df = df.withColumn("seat", F.col("_s.seat")).withColumn("notes", F.col("_s.notes")).drop("_s")
    up = lambda by: _move_y(F.col("seat"), lambda y: G.clamp(y - by, 0.0, y_max))
    df = step(df, top > 0.70 * h, up(top - 0.66 * h), "shifted seat upward to plausible height")
    df = step(df, bottom > 0.86 * h, up(bottom - 0.84 * h), "raised low seat bottom to plausible range")

    floor, back = F.col("floor"), F.col("back")
    floor_y, back_y = (floor[0]["y"] + floor[1]["y"]) * 0.5, (back[0]["y"] + back[1]["y"]) * 0.5
    least = F.greatest(bottom + 0.14 * h, F.lit(0.72 * h))
    high = broken & (floor_y < least)
    target = G.clamp(top - 0.12 * h, 0.12 * h, top - 0.02 * h)
    target = F.when(target >= top, G.clamp(top - 0.05 * h, 0.0, y_max)).otherwise(target)
    sunk = broken & (back_y > top + 0.06 * h)
    level = lambda line, y: F.transform(line, lambda p: G.point(G.clamp(p["x"], 0.0, width - 1.0), y))
    rounded = lambda c: F.transform(c, lambda p: G.point(_two(p["x"]), _two(p["y"])))
    made = F.struct(
        F.when(broken, rounded(F.col("seat"))).otherwise(F.col("seat")).alias("seat"),
        F.when(broken, rounded(F.when(high, level(floor, G.clamp(least, 0.0, y_max))).otherwise(floor))).otherwise(floor).alias("floor"),
        F.when(broken, rounded(F.when(sunk, level(back, target)).otherwise(back))).otherwise(back).alias("back"),
        F.concat("notes", V.errors((high, "moved floor_line below seat to satisfy sitting prior"), (sunk, "moved backrest_region above seat to satisfy sitting prior"))).alias("notes"),
        F.col("ok").alias("was_ok"),
    )
    keep = [c for c in df.columns if c not in ("seat", "floor", "back", "notes", "ok", "_issues")]
    df = fixed(df.select(*keep, made.alias("_m")), "_g", F.col("_m")).select(*keep, "_g.*")
    df = sanitize(df, width, height)
    left = V.prior_issues(F.col("seat"), F.col("floor"), F.col("back"), F.lit(height))
    return df.withColumn("ok", F.col("was_ok") & F.col("ok") & (F.size(left) == 0)).drop("was_ok")


def fallback_pose(seat: Column, floor: Column, width: int, height: int, tired: Column | None = None) -> dict[str, Column]:
    """A seated pose from seat and floor: hip at 55 % of the seat's depth, limbs at usual offsets, ankles on the floor line."""
    w, h, x_max, y_max = float(width), float(height), width - 1.0, height - 1.0
    in_x, in_y = (lambda v: G.clamp(v, 0.0, x_max)), (lambda v: G.clamp(v, 0.0, y_max))
    top, bottom = F.array_min(G.ys(seat)), F.array_max(G.ys(seat))
    a, b = floor[0], floor[1]
    floor_y = in_y((a["y"] + b["y"]) * 0.5)
    hip_x = (F.array_min(G.xs(seat)) + F.array_max(G.xs(seat))) * 0.5
    hip_y = in_y(top + 0.55 * (bottom - top))
    if tired is not None:
        hip_y = F.when(tired, in_y(hip_y + 0.02 * h)).otherwise(hip_y)
    legs, shoulders, arms = max(0.06 * w, 20.0), max(0.10 * w, 24.0), max(0.05 * w, 16.0)
    knee_y = G.clamp(hip_y + 0.20 * h, bottom + 0.04 * h, floor_y - 0.12 * h)
    shoulder_y = in_y(hip_y - 0.22 * h)
    elbow_y = in_y(shoulder_y + 0.11 * h)
    out = {"hip_center": (in_x(hip_x), hip_y)}
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length2 = dx * dx + dy * dy
    for side, s in (("left", -1.0), ("right", 1.0)):
        want = in_x(hip_x + s * 0.9 * legs)
        t = G.clamp(((want - a["x"]) * dx + (floor_y - a["y"]) * dy) / F.greatest(length2, F.lit(1e-8)), 0.08, 0.92)
        point = length2 < 1e-8
        foot_x = F.when(point, want).otherwise(in_x(a["x"] + t * dx))
        foot_y = F.when(point, floor_y).otherwise(in_y(a["y"] + t * dy))
        shoulder_x = in_x(hip_x + s * shoulders)
        elbow_x = in_x(shoulder_x + s * arms * 0.5)
        out |= {
            f"{side}_knee": (in_x(hip_x + s * legs), knee_y),
            f"{side}_ankle": (foot_x, in_y(F.greatest(foot_y, bottom + 0.04 * h))),
            f"{side}_shoulder": (shoulder_x, shoulder_y),
            f"{side}_elbow": (elbow_x, elbow_y),
            f"{side}_wrist": (in_x(elbow_x + s * arms * 0.5), in_y(elbow_y + 0.10 * h)),
        }
    return {name: G.point(_two(x), _two(y)) for name, (x, y) in out.items()}


def local_checks(seat: Column, floor: Column, pose: dict[str, Column], height: int) -> dict[str, Column]:
    """Four checks, each 0 or 1, of a pose against seat and floor."""
    margin = 0.05 * height
    y = {name: p["y"] for name, p in pose.items()}
    bottom, hip = F.array_max(G.ys(seat)), pose["hip_center"]
    near = lambda p: G.segment_distance(p["x"], p["y"], floor[0], floor[1]) <= 0.15 * height
    between = lambda k, a: y[k].between(F.least(hip["y"], y[a]) - margin, F.greatest(hip["y"], y[a]) + margin)
    sides = ("left", "right")
    every = lambda parts: parts[0] & parts[1]
    found = [
        G.point_in_polygon(hip["x"], hip["y"], seat),
        every([y[f"{s}_knee"] >= hip["y"] - margin for s in sides]),
        every([(y[f"{s}_ankle"] > bottom + 0.02 * height) & near(pose[f"{s}_ankle"]) for s in sides]),
        every([between(f"{s}_knee", f"{s}_ankle") & (y[f"{s}_shoulder"] <= hip["y"] + margin) for s in sides]),
    ]
    return {name: check.cast("int") for name, check in zip(CHECKS, found)}


def project_fallback(local: Column, checks: dict[str, Column], fallback: Column, checker: Column, least: Column, rechecked: Column | None = None) -> Column:
    """Whether a fallback pose must be tried and is accepted, and the scores after that: must_project, accepted, checker, local, effective.

    local and checks are of the base pose (a check that is null counts as passed), fallback is the fallback's local
    score, checker the recorded one, rechecked the fallback's own where there is one. A fallback is accepted when its
    local score is higher and its effective score, the lesser of both, is no lower.
    """
    again = checker if rechecked is None else F.coalesce(rechecked, checker)
    failed = lambda name: F.coalesce(checks.get(name, F.lit(1)), F.lit(1)) == 0
    must = (local < least) | failed("hip_on_seat") | failed("ankles_below_seat_near_floor")
    accepted = must & (fallback > local) & (F.least(again, fallback) >= F.least(checker, local))
    pick = lambda a, b: F.when(accepted, a).otherwise(b)
    return F.struct(
        must.alias("must_project"), accepted.alias("accepted"), pick(again, checker).alias("checker"),
        pick(fallback, local).alias("local"), pick(F.least(again, fallback), F.least(checker, local)).alias("effective"),
    )


def contact_candidates(df: DataFrame, width: int, height: int, step: int = 12) -> DataFrame:
    """Points of a grid on the seat, away from its sides and in the middle of its depth, with their weights.

    df has seat and back and whatever identifies a row; each row becomes its candidates: x, y, weight, depth_t.
    It may have contact, the points of a contact region: one with an area is used instead of the seat, with a
    band of depths that depends on how upright the seat's depth is in the frame.
    """
    own = [c for c in df.columns if c not in ("seat", "back", "contact")]
    seat = F.col("seat")
    df = fixed(df, "_area", contact_area(df))
    on, use = F.col("_area.points"), F.col("_area.given")
    df = fixed(df, "_b", G.bounding_box(on))
    df = fixed(df, "_margin", G.clamp(0.04 * F.sqrt(F.greatest(G.polygon_area(on), F.lit(1.0))), 4.0, 30.0))
    cx, cy = (F.col("back")[0]["x"] + F.col("back")[1]["x"]) * 0.5, (F.col("back")[0]["y"] + F.col("back")[1]["y"]) * 0.5
    away = F.transform(G.edges(seat), lambda e: F.struct(F.hypot((e["a"]["x"] + e["b"]["x"]) * 0.5 - cx, (e["a"]["y"] + e["b"]["y"]) * 0.5 - cy).alias("d"), e["i"].alias("i")))
    df = fixed(df, "_k", F.array_min(away)["i"])
    corner = lambda i: G.at(seat, F.col("_k") + i)
    middle = lambda i, j: G.point((corner(i)["x"] + corner(j)["x"]) * 0.5, (corner(i)["y"] + corner(j)["y"]) * 0.5)
    df = fixed(df, "_e", F.struct(corner(0).alias("a"), corner(1).alias("b"), middle(0, 1).alias("m"), middle(2, 3).alias("f")))
    depth = lambda of: F.col(f"_e.f.{of}") - F.col(f"_e.m.{of}")
    upright = F.abs(depth("y")) / F.sqrt(F.greatest(depth("x") * depth("x") + depth("y") * depth("y"), F.lit(1e-8)))
    names = ("least", "most", "at", "sigma")
    band = lambda *told: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, told)])
    steep, slanted, flat = band(0.34, 0.84, 0.54, 0.16), band(0.27, 0.88, 0.49, 0.18), band(0.2, 0.9, 0.46, 0.2)
    df = fixed(df, "_band", F.when(~use, band(0.08, 0.92, 0.35, 0.23)).when(upright >= 0.75, steep).when(upright >= 0.55, slanted).otherwise(flat))

    def axis(low: Column, high: Column, n: int) -> Column:
        a, b = F.greatest(F.floor(low), F.lit(0)).cast("int"), F.least(F.ceil(high), F.lit(n - 1)).cast("int")
        return F.when(a <= b, F.sequence(a, F.greatest(a, b), F.lit(step)))

    df = df.withColumn("_y", F.explode(axis(F.col("_b.y_min"), F.col("_b.y_max"), height)))
    df = df.withColumn("_x", F.explode(axis(F.col("_b.x_min"), F.col("_b.x_max"), width)))
    x, y = F.col("_x").cast("double"), F.col("_y").cast("double")
    df = df.where(G.point_in_polygon(x, y, on)).where(G.edge_distance(x, y, on) >= F.col("_margin"))

    def share(p: str, q: str) -> Column:
        a, b = F.col(f"_e.{p}"), F.col(f"_e.{q}")
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        n = dx * dx + dy * dy
        return F.when(n > 1e-8, ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.greatest(n, F.lit(1e-8))).otherwise(F.lit(0.5))

    df = df.select(*own, x.alias("x"), y.alias("y"), share("m", "f").alias("t"), share("a", "b").alias("u"), "_band").where("t BETWEEN _band.least AND _band.most")
    bell = lambda c, at, sigma: F.exp(-0.5 * F.pow((F.col(c) - at) / sigma, 2))
    weight = G.clamp(bell("t", F.col("_band.at"), F.col("_band.sigma")) * bell("u", 0.5, 0.33), 0.0, 1.0)
    return df.select(*own, "x", "y", F.round(weight, 4).alias("weight"), F.round("t", 4).alias("depth_t"))


def contact_area(df: DataFrame) -> Column:
    """points, and given: those of contact that are numbers, if they are three at least and have an area, else the seat's."""
    if "contact" not in df.columns:
        return F.struct(F.col("seat").alias("points"), F.lit(False).alias("given"))
    told = F.filter(F.coalesce("contact", F.array().cast(df.schema["contact"].dataType)), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    given = F.when(F.size(told) >= 3, G.polygon_area(told) > 1.0).otherwise(F.lit(False))
    return F.struct(F.when(given, told).otherwise(F.col("seat")).alias("points"), given.alias("given"))


def ranked_candidates(df: DataFrame, width: int, height: int, step: int = 12, most: int = 1500) -> DataFrame:
    """All contact candidates by falling weight and then in scan order: a stride over them beyond `most`, the centroid where there is none.

    What identifies a row must be unique; rank starts at 1.
    """
    own = [c for c in df.columns if c not in ("seat", "back", "contact")]
    found = contact_candidates(df, width, height, step).withColumn("_found", F.lit(1))
    area = fixed(df, "_area", contact_area(df)).select(*own, F.col("_area.points").alias("_p"))
    mean = lambda of: F.aggregate(of(F.col("_p")), F.lit(0.0), lambda a, v: a + v) / F.size("_p")
    place = lambda of, n: _two(G.clamp(mean(of), 0.0, n - 1.0))
    none = area.select(*own, place(G.xs, width).alias("x"), place(G.ys, height).alias("y"), F.lit(1.0).alias("weight"), F.lit(0.5).alias("depth_t"), F.lit(0).alias("_found"))
    whole = Window.partitionBy(*own)
    rows = found.unionByName(none).withColumn("_n", F.sum("_found").over(whole)).where("_found = 1 OR _n = 0")
    rows = rows.withColumn("_r", F.row_number().over(whole.orderBy(F.col("weight").desc(), "y", "x")) - 1)
    stride = F.col("_n") / F.lit(float(most))
    near = F.floor(F.col("_r") / stride).cast("int")
    taken = F.filter(F.sequence(near - 1, near + 1), lambda i: (i >= 0) & (i < most) & (F.rint(i * stride) == F.col("_r")))
    rows = rows.withColumn("rank", F.when(F.col("_n") <= most, F.col("_r")).otherwise(F.get(taken, F.lit(0))) + 1).where("rank IS NOT NULL")
    return rows.select(*own, "rank", "x", "y", "weight", "depth_t")


def effective_size(points: Column, side: str, told: Column) -> Column:
    """A frame's side as told, or as large as its points need."""
    most = F.array_max(F.transform(points, lambda p: p[side]))
    return F.greatest(told, F.ceil(most).cast("int") + 1)
