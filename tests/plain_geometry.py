"""Seat geometries in plain Python, written from the description of the rules: what the column expressions are held to."""

from __future__ import annotations

import math


def cut(v, low, high):
    return max(low, min(high, v))


def area(points):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2


def span(line):
    return math.dist(line[0], line[1])


def is_valid(g, w, h):
    inside = all(0 <= x <= w - 1 and 0 <= y <= h - 1 for part in g for x, y in part)
    seat, floor, back = g
    return inside and area(seat) >= max(20, 0.002 * w * h) and span(floor) >= max(10, 0.05 * w) and span(back) >= max(10, 0.03 * w)


def issues(g, h):
    seat, floor, back = g
    top, bottom = min(y for _, y in seat), max(y for _, y in seat)
    thick, floor_y, back_y = max(1, bottom - top), (floor[0][1] + floor[1][1]) / 2, (back[0][1] + back[1][1]) / 2
    told = {
        "seat height too small for a usable seat": thick < 0.04 * h,
        "seat height too large for a realistic seat slab": thick > 0.28 * h,
        "seat top is unrealistically close to bottom of image": top > 0.74 * h,
        "seat bottom is unrealistically low": bottom > 0.90 * h,
        "floor line is not sufficiently below seat": floor_y <= bottom + 0.08 * h,
        "floor line is unrealistically high": floor_y < 0.62 * h,
        "backrest is not above seat region": back_y > top + 0.06 * h,
    }
    return [m for m, broken in told.items() if broken]


def sanitize(g, w, h):
    """(geometry or None, notes)."""
    clamped = [[(cut(x, 0, w - 1), cut(y, 0, h - 1)) for x, y in part] for part in g]
    notes = ["clamped out-of-bounds geometry point(s)"] if clamped != [list(map(tuple, part)) for part in g] else []
    seat, floor, back = clamped
    if area(seat) < max(20, 0.002 * w * h):
        mx, my, dx, dy = sum(x for x, _ in seat) / 4, sum(y for _, y in seat) / 4, max(0.08 * w, 24), max(0.05 * h, 16)
        seat = [(cut(mx + a * dx, 0, w - 1), cut(my + b * dy, 0, h - 1)) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        notes.append("repaired degenerate seat_region")
    if span(floor) < max(10, 0.05 * w):
        y = cut(max(floor[0][1], floor[1][1]), 0.75 * h, h - 1)
        floor = [(cut(0.15 * w, 0, w - 1), y), (cut(0.85 * w, 0, w - 1), y)]
        notes.append("repaired short floor_line")
    if span(back) < max(10, 0.03 * w):
        y = cut(min(back[0][1], back[1][1]), 0.15 * h, 0.6 * h)
        back = [(cut(0.25 * w, 0, w - 1), y), (cut(0.75 * w, 0, w - 1), y)]
        notes.append("repaired short backrest_region")
    made = [seat, floor, back]
    return (made if is_valid(made, w, h) else None), notes


def repair(g, w, h):
    """(geometry or None, notes of what was moved)."""
    clean, notes = sanitize(g, w, h)
    if clean is None or not issues(clean, h):
        return clean, notes
    seat, floor, back = ([list(p) for p in part] for part in clean)
    low, high = (lambda: min(p[1] for p in seat)), (lambda: max(p[1] for p in seat))
    top, bottom = low(), high()
    for share, is_off, word in ((0.06, max(1, bottom - top) < 0.06 * h, "expanded"), (0.22, max(1, bottom - top) > 0.22 * h, "compressed")):
        if is_off:
            middle = (top + bottom) / 2
            new_top = cut(middle - share * h / 2, 0.18 * h, h - 1 - share * h)
            new_bottom = cut(new_top + share * h, 0, h - 1)
            for p in seat:
                p[1] = new_top if p[1] <= middle else new_bottom
            top, bottom = new_top, new_bottom
            notes.append(f"{word} seat vertical thickness to meet sitting prior")
            break
    for is_off, by, note in ((lambda: top > 0.70 * h, lambda: top - 0.66 * h, "shifted seat upward to plausible height"), (lambda: bottom > 0.86 * h, lambda: bottom - 0.84 * h, "raised low seat bottom to plausible range")):
        if is_off():
            shift = by()
            for p in seat:
                p[1] = cut(p[1] - shift, 0, h - 1)
            top, bottom = low(), high()
            notes.append(note)
    least = max(bottom + 0.14 * h, 0.72 * h)
    if (floor[0][1] + floor[1][1]) / 2 < least:
        floor = [[cut(x, 0, w - 1), cut(least, 0, h - 1)] for x, _ in floor]
        notes.append("moved floor_line below seat to satisfy sitting prior")
    if (back[0][1] + back[1][1]) / 2 > top + 0.06 * h:
        y = cut(top - 0.12 * h, 0.12 * h, top - 0.02 * h)
        y = cut(top - 0.05 * h, 0, h - 1) if y >= top else y
        back = [[cut(x, 0, w - 1), y] for x, _ in back]
        notes.append("moved backrest_region above seat to satisfy sitting prior")
    again, more = sanitize([[(round(x, 2), round(y, 2)) for x, y in part] for part in (seat, floor, back)], w, h)
    return (again if again is not None and not issues(again, h) else None), notes + more


def canonical(w, h):
    at = lambda x, y: (round(cut(x * w, 0, w - 1), 2), round(cut(y * h, 0, h - 1), 2))
    return [[at(0.28, 0.52), at(0.72, 0.52), at(0.72, 0.62), at(0.28, 0.62)], [at(0.10, 0.88), at(0.90, 0.88)], [at(0.28, 0.30), at(0.72, 0.30)]]


def weak_parts(parts, least):
    told = []
    for k in ("seat_confidence", "floor_confidence"):
        v = parts and parts[k]
        if v is None:
            told.append(f"{k} missing")
        elif v < least:
            told.append(f"{k}={v:.3f} below threshold {least:.3f}")
    told += [f"{k} is false" for k in ("seat_visible", "floor_visible") if not (parts and parts[k])]
    back = parts and parts["backrest_confidence"]
    if back is not None and back < max(0.05, least / 2):
        told.append(f"backrest_confidence too low for stable torso anchoring ({back:.3f})")
    return told


def from_parts(g, parts, w, h, least):
    """(geometry or None, notes)."""
    if weak := weak_parts(parts, least):
        return None, weak
    clean, notes = sanitize(g, w, h)
    if clean is None:
        return None, [*notes, "failed to sanitize geometry derived from part segmentation"]
    if not (broken := issues(clean, h)):
        return clean, notes
    better, moved = repair(clean, w, h)
    if better is None:
        return None, notes + moved + broken
    return better, notes + moved + ["repaired geometry derived from part segmentation priors"]


def moved(points, w, h, to_w, to_h):
    at = lambda v, n, m: cut(v * (m - 1) / max(1, n - 1), 0, m - 1)
    return [(round(at(x, w, to_w), 2), round(at(y, h, to_h), 2)) for x, y in points]
