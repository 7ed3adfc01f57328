"""Validators: ordered lists of error texts as array columns; a row is valid where the array is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import geometry as G

NO_ERRORS = "array<string>"


def errors(*checks: tuple[Column, str | Column]) -> Column:
    """The messages of the checks that fail, in order; a null condition counts as passed."""
    told = F.array(*[F.when(bad, m if isinstance(m, Column) else F.lit(m)) for bad, m in checks])
    return F.filter(told, lambda e: e.isNotNull())


def first_error(*checks: tuple[Column, str]) -> Column:
    """The message of the first check that fails, or null."""
    return F.coalesce(*[F.when(bad, F.lit(m)) for bad, m in checks])


def then(done: Column, more: Column) -> Column:
    """Further errors, looked for only where there are none so far."""
    return F.when(F.size(done) == 0, more).otherwise(done)


def point_errors(points: Column, label: str | Column, width: Column, height: Column) -> Column:
    """For each point: numbers must be there, and lie in the frame."""
    prefix = F.lit(label) if isinstance(label, str) else label

    def of(p: Column, i: Column) -> Column:
        name = F.concat(prefix, F.lit("["), i.cast("string"), F.lit("]"))
        missing = p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"])
        out_x, out_y = (p["x"] < 0) | (p["x"] > width - 1), (p["y"] < 0) | (p["y"] > height - 1)
        bounds = errors((out_x, F.concat(name, F.lit(".x out of bounds"))), (out_y, F.concat(name, F.lit(".y out of bounds"))))
        told = F.when(missing, F.array(F.concat(name, F.lit(".x and "), name, F.lit(".y must be numeric")))).otherwise(bounds)
        return F.when(p.isNull(), F.array(F.concat(name, F.lit(" must be an object")))).otherwise(told)

    return F.flatten(F.transform(points, of))


def line_length(line: Column) -> Column:
    return F.hypot(line[0]["x"] - line[1]["x"], line[0]["y"] - line[1]["y"])


def geometry_errors(seat: Column, floor: Column, back: Column, width: Column, height: Column) -> Column:
    """Dimensions first; then counts and points; then shapes too small to use, one after the other."""
    frame = errors((width.isNull() | (width <= 0), "image_width must be a positive integer"), (height.isNull() | (height <= 0), "image_height must be a positive integer"))

    def region(points: Column, label: str, n: int) -> Column:
        wrong = points.isNull() | (F.size(points) != n)
        return F.when(wrong, F.array(F.lit(f"{label} must be a list of {n} points"))).otherwise(point_errors(points, label, width, height))

    points = F.concat(region(seat, "seat_region", 4), region(floor, "floor_line", 2), region(back, "backrest_region", 2))
    small = errors((G.polygon_area(seat) < F.greatest(F.lit(20.0), 0.002 * width * height), "seat_region is degenerate"))
    short = errors((line_length(floor) < F.greatest(F.lit(10.0), 0.05 * width), "floor_line too short"))
    low = errors((line_length(back) < F.greatest(F.lit(10.0), 0.03 * width), "backrest_region too short"))
    return then(then(then(then(frame, points), small), short), low)


def prior_issues(seat: Column, floor: Column, back: Column, height: Column) -> Column:
    """What makes a geometry implausible for sitting."""
    top, bottom = F.array_min(G.ys(seat)), F.array_max(G.ys(seat))
    floor_y, back_y = (floor[0]["y"] + floor[1]["y"]) * 0.5, (back[0]["y"] + back[1]["y"]) * 0.5
    thick = F.greatest(F.lit(1.0), bottom - top)
    return errors(
        (thick < 0.04 * height, "seat height too small for a usable seat"),
        (thick > 0.28 * height, "seat height too large for a realistic seat slab"),
        (top > 0.74 * height, "seat top is unrealistically close to bottom of image"),
        (bottom > 0.90 * height, "seat bottom is unrealistically low"),
        (floor_y <= bottom + 0.08 * height, "floor line is not sufficiently below seat"),
        (floor_y < 0.62 * height, "floor line is unrealistically high"),
        (back_y > top + 0.06 * height, "backrest is not above seat region"),
    )


def part_issues(seat_conf: Column, floor_conf: Column, back_conf: Column, seat_seen: Column, floor_seen: Column, least: float) -> Column:
    """Whether part confidences and visibility suffice to build on."""

    def confidence(value: Column, name: str) -> list[tuple[Column, str | Column]]:
        low = F.concat(F.lit(f"{name}="), F.format_string("%.3f", value), F.lit(f" below threshold {least:.3f}"))
        return [(value.isNull(), f"{name} missing"), (value < least, low)]

    floor_of_back = max(0.05, least * 0.5)
    weak = F.concat(F.lit("backrest_confidence too low for stable torso anchoring ("), F.format_string("%.3f", back_conf), F.lit(")"))
    return errors(
        *confidence(seat_conf, "seat_confidence"),
        *confidence(floor_conf, "floor_confidence"),
        (~F.coalesce(seat_seen, F.lit(False)), "seat_visible is false"),
        (~F.coalesce(floor_seen, F.lit(False)), "floor_visible is false"),
        (back_conf < floor_of_back, weak),
    )


def part_errors(confidences: dict[str, Column], flags: dict[str, Column], lists: dict[str, tuple[Column, int]], width: Column, height: Column) -> Column:
    """Confidences and flags of parts, and the items of their lists (by name: items and the most there may be), without repeats.

    An item is struct<line, confidence, visible>; a null list is an empty one.
    """

    def share(value: Column, name: str | Column) -> list[tuple[Column, Column]]:
        name = F.lit(name) if isinstance(name, str) else name
        missing = value.isNull() | F.isnan(value)
        return [(missing, F.concat(name, F.lit(" must be numeric"))), (~missing & ((value < 0) | (value > 1)), F.concat(name, F.lit(" must be in [0,1]")))]

    def items(name: str, told: Column, most: int) -> Column:
        def of(item: Column, i: Column) -> Column:
            label = F.concat(F.lit(f"parts.{name}["), i.cast("string"), F.lit("]"))
            wrong = item["line"].isNull() | (F.size(item["line"]) != 2)
            line = F.when(wrong, F.array(F.concat(label, F.lit(".line must be a list of 2 points")))).otherwise(point_errors(item["line"], F.concat(label, F.lit(".line")), width, height))
            rest = errors(*share(item["confidence"], F.concat(label, F.lit(".confidence"))), (item["visible"].isNull(), F.concat(label, F.lit(".visible must be boolean"))))
            return F.when(item.isNull(), F.array(F.concat(label, F.lit(" must be an object")))).otherwise(F.concat(line, rest))

        return F.when(told.isNull(), F.array().cast(NO_ERRORS)).otherwise(F.concat(errors((F.size(told) > most, f"parts.{name} has too many items (>{most})")), F.flatten(F.transform(told, of))))

    found = [x for name, value in confidences.items() for x in share(value, f"parts.{name}")]
    found += [(flag.isNull(), f"parts.{name} must be boolean") for name, flag in flags.items()]
    return F.array_distinct(F.concat(errors(*found), *[items(name, told, most) for name, (told, most) in lists.items()]))


def pose_errors(keypoints: Column, width: Column, height: Column, expected_w: int, expected_h: int, names: list[str]) -> Column:
    """keypoints is map<string, struct<x,y,confidence,visible>>: sizes, names, and every known point in order of name.

    What is null is missing: a size that does not match, no keypoints at all, a point or a number that is not there.
    """
    known = F.array(*map(F.lit, names))
    missing = F.transform(F.array_sort(F.array_except(known, F.map_keys(keypoints))), lambda n: F.concat(F.lit("missing keypoint: "), n))
    unknown = F.transform(F.array_sort(F.array_except(F.map_keys(keypoints), known)), lambda n: F.concat(F.lit("unknown keypoint: "), n))
    no_number = lambda v: v.isNull() | F.isnan(v)

    def of(name: Column) -> Column:
        p = keypoints[name]
        x, y, confidence = p["x"], p["y"], p["confidence"]
        nowhere = no_number(x) | no_number(y)
        told = errors(
            (nowhere, F.concat(name, F.lit(".x and "), name, F.lit(".y must be numeric"))),
            (~nowhere & ((x < 0) | (x > expected_w - 1)), F.concat(name, F.lit(".x out of bounds"))),
            (~nowhere & ((y < 0) | (y > expected_h - 1)), F.concat(name, F.lit(".y out of bounds"))),
            (no_number(confidence), F.concat(name, F.lit(".confidence must be numeric"))),
            (~no_number(confidence) & ((confidence < 0) | (confidence > 1)), F.concat(name, F.lit(".confidence out of range"))),
            (p["visible"].isNull(), F.concat(name, F.lit(".visible must be boolean"))),
        )
        return F.when(p.isNull(), F.array(F.concat(name, F.lit(" must be an object")))).otherwise(told)

    points = F.flatten(F.transform(F.array_sort(F.array_intersect(known, F.map_keys(keypoints))), of))
    size = lambda told, expected, name: (~told.eqNullSafe(F.lit(expected)), f"{name} mismatch")
    sizes = errors(size(width, expected_w, "image_width"), size(height, expected_h, "image_height"))
    return F.when(keypoints.isNull(), F.concat(sizes, F.array(F.lit("keypoints must be an object")))).otherwise(F.concat(sizes, missing, unknown, points))


def checker_errors(score: Column, checks: Column, failures: Column, names: list[str]) -> Column:
    """checks is map<string,int>: each 0 or 1, their sum the score, and no failures with a full score."""
    bad = lambda n: checks[n].isNull() | ~checks[n].isin(0, 1)
    any_bad = F.exists(F.array(*[bad(n) for n in names]), lambda b: b)
    total = F.aggregate(F.array(*[F.coalesce(checks[n], F.lit(0)) for n in names]), F.lit(0), lambda a, b: a + b)
    return errors(
        (score.isNull() | (score < 0) | (score > len(names)), f"score must be an integer in [0, {len(names)}]"),
        *[(bad(n), f"checks.{n} must be 0 or 1") for n in names],
        (~any_bad & (total != score), "score mismatch"),
        ((score == len(names)) & (F.size(failures) > 0), f"failures must be empty when score is {len(names)}"),
    )


#: Texts that mark a prediction as a copied template.
PLACEHOLDERS = ("...", "100%", '"int"', '"float"', "<x>", "<y>")
#: Texts that a training target must not hold.
BANNED = ("...", "<x>", "<y>", "100%", '"int"', '"float"', ":int", ":float")


def has_any(text: Column, tokens: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for token in tokens:
        found = found | F.contains(F.lower(text), F.lit(token))
    return found


def polygon_rejections(points: Column, width: int, height: int) -> Column:
    """Why a predicted polygon is not credible, in order."""
    if width <= 0 or height <= 0:
        return F.array(F.lit("invalid_image_size"))
    ratio = G.polygon_area(points) / float(width * height)
    b = G.bounding_box(points)
    w, h = F.coalesce(b["x_max"] - b["x_min"], F.lit(0.0)), F.coalesce(b["y_max"] - b["y_min"], F.lit(0.0))
    top, bottom = F.coalesce(b["y_min"], F.lit(0.0)), F.coalesce(b["y_max"], F.lit(0.0))
    margin = 0.03 * min(width, height)
    corners = F.array(*[G.point(float(x), float(y)) for y in (0, height - 1) for x in (0, width - 1)])
    touched = F.filter(corners, lambda c: F.exists(points, lambda p: (F.abs(p["x"] - c["x"]) <= margin) & (F.abs(p["y"] - c["y"]) <= margin)))
    return errors(
        (F.size(points) < 3, "too_few_points"),
        (G.unique_rounded(points) < 3, "too_few_unique_points"),
        (ratio > 0.35, "area_too_large"),
        (ratio < 0.003, "area_too_small"),
        (h / float(height) > 0.45, "bbox_too_tall"),
        (bottom < 0.45 * height, "bbox_too_high"),
        (top > 0.80 * height, "bbox_too_low"),
        ((w < 0.08 * width) | (h < 0.08 * height), "collapsed_extent"),
        (F.size(touched) >= 2, "touches_multiple_corners"),
    )


def prediction_rejections(valid_json: Column, schema_valid: Column, points: Column, width: int, height: int) -> Column:
    """Why a prediction is not used: no JSON, not of the schema, no polygon, or what makes its polygon not credible."""
    only = lambda reason: F.array(F.lit(reason))
    told = lambda flag: F.coalesce(flag, F.lit(False))
    return F.when(~told(valid_json), only("invalid_json")).when(~told(schema_valid), only("schema_invalid")).when(points.isNull() | (F.size(points) == 0), only("empty_polygon")).otherwise(polygon_rejections(points, width, height))


def target_error(target: Column, text: Column, task: str, shape: str, points: int = 0) -> Column:
    """The first fault of a training target, or null.

    target is struct<task, image_size<width,height>, seat_contact_box<...>, seat_contact_polygon array<point>>.
    """
    size = target["image_size"]
    w, h = size["width"], size["height"]
    checks = [
        (target.isNull(), "assistant target must be a JSON object"),
        (target["task"].isNull() | (target["task"] != task), f"task must be {task}"),
        (w.isNull() | h.isNull(), "image_size.width/height must be integers"),
        ((w <= 0) | (h <= 0), "image_size.width/height must be positive"),
    ]
    if shape == "bbox":
        b = target["seat_contact_box"]
        missing = b.isNull() | b["x_min"].isNull() | b["y_min"].isNull() | b["x_max"].isNull() | b["y_max"].isNull()
        checks += [
            (missing, "seat_contact_box must contain four numbers"),
            ((b["x_min"] < 0) | (b["x_max"] > w - 1) | (b["y_min"] < 0) | (b["y_max"] > h - 1), "seat_contact_box out of image boundary"),
            ((b["x_max"] <= b["x_min"]) | (b["y_max"] <= b["y_min"]), "seat_contact_box must satisfy x_max>x_min and y_max>y_min"),
        ]
    else:
        p = target["seat_contact_polygon"]
        checks += [(p.isNull() | (F.size(p) < 3), "seat_contact_polygon must contain >=3 points")]
        if points:
            checks.append((F.size(p) != points, f"seat_contact_polygon must contain exactly {points} points"))
        checks += [
            (F.exists(p, lambda q: q["x"].isNull() | q["y"].isNull()), "point x/y must be finite numbers"),
            (F.exists(p, lambda q: (q["x"] < 0) | (q["x"] > w - 1) | (q["y"] < 0) | (q["y"] > h - 1)), "point out of image boundary"),
        ]
    return first_error(*checks, (has_any(text, BANNED), "assistant text contains placeholder-like tokens"))
