"""Geometry and part documents of any frame: rescaling, compact grids, clean-up of parts, and what to use where a model failed.

A document is a struct of image_width, image_height and the point arrays seat_region (4 points),
floor_line (2) and backrest_region (2); a geometry may have seat_contact_region, and a part document
has parts. Any of these may be null, and a point's x and y as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions.arrays import fixed
from tessera.operators import pose as P
from tessera.operators import validate as V

POINTS = "array<struct<x:double,y:double>>"
ITEMS = f"array<struct<line:{POINTS},confidence:double,visible:boolean>>"
PARTS = (
    "struct<seat_confidence:double,backrest_confidence:double,floor_confidence:double,"
    f"seat_visible:boolean,backrest_visible:boolean,floor_visible:boolean,armrests:{ITEMS},legs:{ITEMS}>"
)
GEOMETRY = f"struct<image_width:int,image_height:int,seat_region:{POINTS},floor_line:{POINTS},backrest_region:{POINTS},seat_contact_region:{POINTS}>"
PART_DOCUMENT = f"struct<image_width:int,image_height:int,seat_region:{POINTS},floor_line:{POINTS},backrest_region:{POINTS},parts:{PARTS}>"
#: The regions every document has, with the number of their points, and the lists of a part document with their longest length (fixed values).
REGIONS = (("seat_region", 4), ("floor_line", 2), ("backrest_region", 2))
LISTS = (("armrests", 2), ("legs", 8))
CONFIDENCES = ("seat_confidence", "backrest_confidence", "floor_confidence")
FLAGS = ("seat_visible", "backrest_visible", "floor_visible")
#: What a part has where nothing usable is told.
DEFAULT_CONFIDENCE, DEFAULT_ITEM_CONFIDENCE = 0.5, 0.35


def is_number(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def _are_numbers(points: Column) -> Column:
    return F.forall(points, lambda p: p.isNotNull() & is_number(p["x"]) & is_number(p["y"]))


def _whole(doc: Column, key: str, n: int) -> Column:
    """Whether a region has its number of points."""
    return F.coalesce(F.size(doc[key]) == n, F.lit(False))


def _scaled(points: Column, src_w: Column, src_h: Column, width: int, height: int) -> Column:
    """Points of one frame in another, to two places."""
    move = lambda v, src, dst: F.bround(G.scale_pixels(v, src, dst), 2)
    return F.transform(points, lambda p: G.point(move(F.coalesce(p["x"], F.lit(0.0)), src_w, width), move(F.coalesce(p["y"], F.lit(0.0)), src_h, height)))


def _lines(items: Column, most: int, src_w: Column, src_h: Column, width: int, height: int) -> Column:
    """The usable ones of the first `most` items, scaled: confidences are cut to 0 to 1, and 0 or false where they are missing."""
    usable = F.filter(F.slice(F.coalesce(items, F.array().cast(ITEMS)), 1, most), lambda i: F.coalesce((F.size(i["line"]) == 2) & _are_numbers(i["line"]), F.lit(False)))
    return F.transform(
        usable,
        lambda i: F.struct(
            _scaled(i["line"], src_w, src_h, width, height).alias("line"), _share(i["confidence"], 0.0).alias("confidence"), F.coalesce(i["visible"], F.lit(False)).alias("visible")
        ),
    ).cast(ITEMS)


def _share(value: Column, default: float) -> Column:
    return F.when(is_number(value), G.clamp(value, 0.0, 1.0)).otherwise(F.lit(default))


def _scaled_parts(parts: Column, src_w: Column, src_h: Column, width: int, height: int) -> Column:
    told = [_share(parts[k], 0.0).alias(k) for k in CONFIDENCES] + [F.coalesce(parts[k], F.lit(False)).alias(k) for k in FLAGS]
    return F.struct(*told, *[_lines(parts[k], most, src_w, src_h, width, height).alias(k) for k, most in LISTS]).cast(PARTS)


def _document(doc: Column, width: int, height: int, region: Callable[[str, int], Column], last: Column, kind: str) -> Column:
    return F.struct(F.lit(width).alias("image_width"), F.lit(height).alias("image_height"), *[region(k, n).alias(k) for k, n in REGIONS], last).cast(kind)


def _other_frame(doc: Column, width: int, height: int) -> Column:
    w, h = doc["image_width"], doc["image_height"]
    return F.coalesce((w > 0) & (h > 0) & ~((w == width) & (h == height)), F.lit(False))


def rescale_geometry(doc: Column, width: int, height: int) -> Column:
    """A geometry in another frame; one of that frame, or of none, stays as it is.

    A region with another number of points passes through. The contact region keeps its numeric
    points, and is left out if fewer than three are left.
    """
    w, h = doc["image_width"], doc["image_height"]
    region = lambda k, n: F.when(_whole(doc, k, n), _scaled(doc[k], w, h, width, height)).otherwise(doc[k])
    told = F.filter(doc["seat_contact_region"], lambda p: p.isNotNull() & is_number(p["x"]) & is_number(p["y"]))
    contact = F.when((F.size(doc["seat_contact_region"]) >= 3) & (F.size(told) >= 3), _scaled(told, w, h, width, height))
    made = _document(doc, width, height, region, contact.alias("seat_contact_region"), GEOMETRY)
    return F.when(_other_frame(doc, width, height), made).otherwise(doc.cast(GEOMETRY))


def rescale_parts(doc: Column, width: int, height: int) -> Column:
    """A part document in another frame; one of that frame, or of none, stays as it is."""
    w, h = doc["image_width"], doc["image_height"]
    region = lambda k, n: F.when(_whole(doc, k, n), _scaled(doc[k], w, h, width, height)).otherwise(doc[k])
    parts = F.when(doc["parts"].isNotNull(), _scaled_parts(doc["parts"], w, h, width, height))
    made = _document(doc, width, height, region, parts.alias("parts"), PART_DOCUMENT)
    return F.when(_other_frame(doc, width, height), made).otherwise(doc.cast(PART_DOCUMENT))


def _regions_usable(doc: Column) -> Column:
    good = (doc["image_width"] > 0) & (doc["image_height"] > 0)
    for key, n in REGIONS:
        good = good & _whole(doc, key, n) & _are_numbers(doc[key])
    return F.coalesce(good, F.lit(False))


def _most(points: Column, side: str) -> Column:
    return F.array_max(F.transform(points, lambda p: p[side]))


def denormalise_geometry(doc: Column, width: int, height: int, most: int = 200) -> Column:
    """struct<doc, scaled>: a geometry told on a grid of at most `most` cells, scaled to the frame.

    One that is incomplete, in a larger frame, or with points beyond its own frame stays as it is.
    """
    w, h = doc["image_width"], doc["image_height"]
    points = F.concat(*[doc[k] for k, _ in REGIONS])
    fits = _regions_usable(doc) & (w <= most) & (h <= most) & (_most(points, "x") <= w + 1) & (_most(points, "y") <= h + 1)
    made = _document(doc, width, height, lambda k, n: _scaled(doc[k], w, h, width, height), F.lit(None).alias("seat_contact_region"), GEOMETRY)
    fits = F.coalesce(fits, F.lit(False))
    return F.struct(F.when(fits, made).otherwise(doc.cast(GEOMETRY)).alias("doc"), fits.alias("scaled"))


def denormalise_parts(doc: Column, width: int, height: int, near: int = 2, most: int = 500) -> Column:
    """struct<doc, scaled>: a part document told on a compact grid, scaled to the frame.

    Its frame is as large as its points, those of usable lines included, need. One that is incomplete,
    within `near` pixels of the frame, or larger than `most` stays as it is.
    """
    lines = lambda k, n: F.flatten(F.transform(F.filter(F.slice(F.coalesce(doc["parts"][k], F.array().cast(ITEMS)), 1, n), lambda i: F.coalesce(F.size(i["line"]) == 2, F.lit(False))), lambda i: F.filter(i["line"], lambda p: p.isNotNull() & is_number(p["x"]) & is_number(p["y"]))))
    points = F.concat(*[doc[k] for k, _ in REGIONS], *[F.coalesce(lines(k, n), F.array().cast(POINTS)) for k, n in LISTS])
    w, h = (F.greatest(doc[side], F.ceil(_most(points, axis)).cast("int") + 1) for side, axis in (("image_width", "x"), ("image_height", "y")))
    fits = _regions_usable(doc) & ~((F.abs(w - width) <= near) & (F.abs(h - height) <= near)) & (w <= most) & (h <= most)
    fits = F.coalesce(fits, F.lit(False))
    parts = _scaled_parts(doc["parts"], w, h, width, height)
    made = _document(doc, width, height, lambda k, n: _scaled(doc[k], w, h, width, height), parts.alias("parts"), PART_DOCUMENT)
    return F.struct(F.when(fits, made).otherwise(doc.cast(PART_DOCUMENT)).alias("doc"), fits.alias("scaled"))


def sanitize_parts(df: DataFrame, width: int, height: int) -> DataFrame:
    """sanitize() of seat, floor and back, and parts with every value filled, cut and rounded; notes tell what was done.

    df has seat, floor, back and parts, a PARTS struct or null. ok tells whether the result is valid.
    """
    df = P.sanitize(df, width, height)
    none, parts = F.col("parts").isNull(), F.col("parts")
    lists = {k: F.coalesce(parts[k], F.array().cast(ITEMS)) for k, _ in LISTS}

    def share(value: Column, default: float) -> Column:
        return F.when(is_number(value), F.bround(G.clamp(value, 0.0, 1.0), 4)).otherwise(F.lit(default))

    def outside(value: Column) -> Column:
        return is_number(value) & (G.clamp(value, 0.0, 1.0) != value)

    def point(p: Column) -> Column:
        return G.point(F.bround(G.clamp(p["x"], 0.0, width - 1.0), 2), F.bround(G.clamp(p["y"], 0.0, height - 1.0), 2))

    def usable(item: Column) -> Column:
        return F.coalesce((F.size(item["line"]) == 2) & _are_numbers(item["line"]), F.lit(False))

    def cleaned(key: str, most: int) -> Column:
        kept = F.filter(F.slice(lists[key], 1, most), usable)
        return F.transform(kept, lambda i: F.struct(F.transform(i["line"], point).alias("line"), share(i["confidence"], DEFAULT_ITEM_CONFIDENCE).alias("confidence"), F.coalesce(i["visible"], F.lit(False)).alias("visible"))).cast(ITEMS)

    def item_notes(key: str, most: int) -> Column:
        def of(item: Column, at: Column) -> Column:
            name = F.concat(F.lit(f"parts.{key}["), at.cast("string"), F.lit("]"))
            wrong_line = ~F.coalesce(F.size(item["line"]) == 2, F.lit(False))
            end = lambda k: F.get(item["line"], F.lit(k))
            far = lambda k: F.coalesce((end(k)["x"] < 0) | (end(k)["x"] > width - 1) | (end(k)["y"] < 0) | (end(k)["y"] > height - 1), F.lit(False))
            line = lambda k: F.concat(F.lit("clamped out-of-bounds point in "), name, F.lit(f".line[{k}]"))
            told = V.errors(
                (far(0), line(0)), (far(1), line(1)),
                (~is_number(item["confidence"]), F.concat(F.lit("defaulted "), name, F.lit(".confidence"))),
                (outside(item["confidence"]), F.concat(F.lit("clamped "), name, F.lit(".confidence into [0,1]"))),
                (item["visible"].isNull(), F.concat(F.lit("defaulted "), name, F.lit(".visible"))),
            )
            return F.when(wrong_line, F.array(F.concat(F.lit("dropped "), name, F.lit(" with invalid line")))).when(~usable(item), F.array(F.concat(F.lit("dropped "), name, F.lit(" due to point parse failure")))).otherwise(told)

        cut = V.errors((F.size(lists[key]) > most, f"truncated parts.{key} to {most} items"))
        return F.concat(F.flatten(F.transform(F.slice(lists[key], 1, most), of)), cut)

    notes = V.errors(
        (none, "parts metadata missing, filled defaults"),
        *[x for k in CONFIDENCES for x in ((~none & ~is_number(parts[k]), f"defaulted parts.{k}"), (outside(parts[k]), f"clamped parts.{k} into [0,1]"))],
        *[(~none & parts[k].isNull(), f"defaulted parts.{k}") for k in FLAGS],
    )
    values = [share(parts[k], DEFAULT_CONFIDENCE).alias(k) for k in CONFIDENCES] + [F.coalesce(parts[k], F.lit(True)).alias(k) for k in FLAGS]
    made = F.struct(*values, *[cleaned(k, most).alias(k) for k, most in LISTS]).cast(PARTS)
    told = F.concat(F.col("notes"), notes, *[item_notes(k, most) for k, most in LISTS])
    keep = [c for c in df.columns if c not in ("parts", "notes")]
    return fixed(df, "_p", F.struct(made.alias("parts"), told.alias("notes"))).select(*keep, "_p.parts", "_p.notes")


def geometry_from_parts(df: DataFrame, width: int, height: int, least: float) -> DataFrame:
    """A geometry built on a part document: ok, seat, floor, back, and notes on how it came about or why there is none.

    df has seat, floor, back and parts. Parts must be good enough; what is told is cleaned up, and repaired where it
    breaks a sitting prior.
    """
    told = F.col("parts")
    issues = V.part_issues(told["seat_confidence"], told["floor_confidence"], told["backrest_confidence"], told["seat_visible"], told["floor_visible"], least)
    df = fixed(df, "_weak", issues)
    own = [c for c in df.columns if c not in ("seat", "floor", "back", "notes", "ok")]
    clean = P.sanitize(df, width, height)
    clean = fixed(clean, "_priors", V.prior_issues(F.col("seat"), F.col("floor"), F.col("back"), F.lit(height)))
    clean = clean.select(*own, F.col("ok").alias("_clean"), "_priors", F.col("notes").alias("_told"), "seat", "floor", "back")
    fixed_up = P.repair(clean.withColumn("notes", F.array().cast("array<string>")), width, height)
    weak, broken = F.size("_weak") > 0, F.size("_priors") > 0
    ok = ~weak & F.col("_clean") & (~broken | F.col("ok"))
    notes = (
        F.when(weak, F.col("_weak"))
        .when(~F.col("_clean"), F.concat("_told", F.array(F.lit("failed to sanitize geometry derived from part segmentation"))))
        .when(broken & F.col("ok"), F.concat("_told", "notes", F.array(F.lit("repaired geometry derived from part segmentation priors"))))
        .when(broken, F.concat("_told", "notes", "_priors"))
        .otherwise(F.col("_told"))
    )
    keep = [c for c in own if c not in ("_weak",)]
    return fixed_up.select(*keep, ok.alias("ok"), "seat", "floor", "back", notes.alias("notes"))


def recover_geometry(df: DataFrame, width: int, height: int) -> DataFrame:
    """What to use of a model's geometry that may have failed, and where it comes from: first what it told, then its parts, then the canonical one.

    df has doc (a GEOMETRY struct), stage_ok (whether the model's stage accepted it), and the parts' geometry: part_ok,
    part_seat, part_floor, part_back. A failed stage's document is denormalised and cleaned up. Whatever is used is
    rescaled to the frame; where it breaks a sitting prior it is repaired, else replaced in the same order. Adds
    seat, floor, back, source, denormalised, prior_source (null where no prior was broken) and n_issues.
    """
    own = df.columns
    df = fixed(df, "_d", denormalise_geometry(F.col("doc"), width, height))
    doc, use = F.col("doc"), F.col("_d.doc")
    seat, floor, back = P.canonical(width, height)
    start = df.withColumn("_use", F.when(F.col("stage_ok"), rescale_geometry(doc, width, height)).otherwise(use))
    told = _regions_usable(F.col("_use")) & (F.col("_use.image_width") == width) & (F.col("_use.image_height") == height)
    start = start.withColumn("_told", F.coalesce(told, F.lit(False)))
    pick = lambda key, none: F.when(F.col("_told"), F.col(f"_use.{key}")).otherwise(none)
    start = start.withColumns({"seat": pick("seat_region", seat), "floor": pick("floor_line", floor), "back": pick("backrest_region", back)})
    start = start.withColumns({"_seat0": F.col("seat"), "_floor0": F.col("floor"), "_back0": F.col("back")})
    clean = P.sanitize(start, width, height)
    good = F.col("_told") & F.col("ok")
    source = F.when(F.col("stage_ok"), "stage").when(good, "stage_a_output").when(F.col("part_ok"), "stage_0_part_segmentation").otherwise("deterministic_fallback")
    clean = clean.withColumn("source", source)

    def chosen(clean_one: str, first: str, part: str, last: Column) -> Column:
        return F.when(F.col("source") == "stage", F.col(first)).when(F.col("source") == "stage_a_output", F.col(clean_one)).when(F.col("part_ok"), F.col(part)).otherwise(last)

    made = F.struct(chosen("seat", "_seat0", "part_seat", seat).alias("seat"), chosen("floor", "_floor0", "part_floor", floor).alias("floor"), chosen("back", "_back0", "part_back", back).alias("back"))
    clean = fixed(clean.select(*own, "source", (~F.col("stage_ok") & F.col("_d.scaled")).alias("denormalised"), made.alias("_m")), "_g", F.col("_m"))
    clean = clean.select(*own, "source", "denormalised", "_g.seat", "_g.floor", "_g.back")
    clean = fixed(clean, "_priors", V.prior_issues(F.col("seat"), F.col("floor"), F.col("back"), F.lit(height)))
    clean = clean.withColumns({"_used_seat": F.col("seat"), "_used_floor": F.col("floor"), "_used_back": F.col("back")})
    done = P.repair(clean, width, height)
    broken = F.size("_priors") > 0
    prior = F.when(broken, F.when(F.col("ok"), "stage_a_prior_repair").when(F.col("part_ok"), "stage_0_part_segmentation").otherwise("deterministic_fallback"))
    done = done.withColumn("prior_source", prior)
    end = lambda repaired, first, part, last: F.when(~broken, F.col(first)).when(F.col("ok"), F.col(repaired)).when(F.col("part_ok"), F.col(part)).otherwise(last)
    return done.select(
        *own, "source", "denormalised", "prior_source", F.size("_priors").alias("n_issues"),
        end("seat", "_used_seat", "part_seat", seat).alias("seat"), end("floor", "_used_floor", "part_floor", floor).alias("floor"), end("back", "_used_back", "part_back", back).alias("back"),
    )
