"""From a chair's mask to a sitting geometry and its contact polygon, as a plan over the mask's table of rows.

The table of rows (functions of widemask) is an array with the number of set pixels, the first and the last of every
row. Peaks, drops, nearest rows and percentiles of rows are expressions over it; Python only follows borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions.arrays import dedupe_by_distance, fixed
from tessera.operators import raster as R
from tessera.operators.widemask import WORD, Grid
from tessera.session import lean

#: Where a seat is looked for, as shares of a chair's height or of a span's width (fixed values).
PEAK_BAND, DROP_SHARE, DROP_LEAST, NO_DROP = (0.30, 0.82), 0.55, 5, 0.78
LOWER_LIFT, LOWER_LIMITS, UPPER_LEAST = 0.02, (0.46, 0.90), 0.18
SEAT_HEIGHT, SEAT_HEIGHT_MOST, SEAT_HEIGHT_LEAST = 0.15, 0.24, 0.07
SEAT_MARGIN, BACK_MARGIN, BACK_RISE, BACK_LEAST = 0.11, 0.08, 0.18, 0.08
FLOOR_BELOW_CHAIR, FLOOR_BELOW_SEAT, FLOOR_WIDER = 0.06, 0.12, 0.65
ROW_SHARES, ROW_MARGIN, ROWS_LEAST, CLOSING = (0.015, 0.985), 0.025, 8, 0.012
OUTLINE_SHARE, OUTLINE_LEAST, OUTLINE_MOST, POINT_GAP, AREA_LEAST, AREA_SHARE = 0.0045, 6, 140, 1.25, 20.0, 0.0012


def part(share: float, of: Column) -> Column:
    """A share of a length, cut to a whole number."""
    return (of * share).cast("int")


def between(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def peak_row(counts: Column, low: Column, high: Column) -> Column:
    """The first row with the most pixels among the rows from `low` up to, and without, `high`."""
    rows = F.slice(counts, low + 1, high - low)
    return low + F.array_position(rows, F.array_max(rows)).cast("int") - 1


def first_below(counts: Column, start: Column, limit: Column) -> Column:
    """The first row from `start` on with fewer pixels than `limit`, or null."""
    rows = F.sequence(start, F.size(counts) - 1)
    return F.array_min(F.filter(rows, lambda y: F.get(counts, y) < limit))


def nearest_span(rows: Column, row: Column) -> Column:
    """The span of a row, or of the nearest one with pixels, above before below, at most a sixth of the rows (or eight) away; null where none is."""
    h = F.size(rows)
    at = between(row, F.lit(0), h - 1)
    reach = F.greatest(F.lit(8), F.floor(h / 6).cast("int"))
    near = F.filter(F.sequence(F.greatest(F.lit(0), at - reach), F.least(h - 1, at + reach)), lambda y: F.get(rows, y)["n"] > 0)
    told = F.transform(near, lambda y: F.struct(F.abs(y - at).alias("away"), y.alias("y"), F.get(rows, y)["first"].alias("first"), F.get(rows, y)["last"].alias("last")))
    return F.array_min(told)


def percentile(values: Column, share: float) -> Column:
    """An interpolated percentile of an ascending array."""
    place = (F.size(values) - 1) * share
    low = F.floor(place).cast("int")
    at = lambda i: F.get(values, F.least(i, F.size(values) - 1)).cast("double")
    return at(low) + (at(low + 1) - at(low)) * (place - low)


def span_at(rows: Column, row: Column, around: Column, instead: Column) -> Column:
    """struct<x0,x1> of the nearest span; the whole width `around` where no row is near, and `instead` for a span of one pixel."""
    whole = F.struct(around["x0"].alias("x0"), around["x1"].alias("x1"))
    told = F.transform(F.array(nearest_span(rows, row)), lambda s: F.coalesce(F.when(s.isNotNull(), F.struct(s["first"].alias("x0"), s["last"].alias("x1"))), whole))
    return F.transform(told, lambda s: F.when(s["x1"] > s["x0"], s).otherwise(F.struct(instead["x0"].alias("x0"), instead["x1"].alias("x1"))))[0]


def narrowed(span: Column, share: float, least: int, width: int) -> Column:
    """A span without a margin at both ends, a share of its length, and two pixels wide at least."""
    margin = F.greatest(F.lit(2), part(share, F.greatest(F.lit(least), span["x1"] - span["x0"])))
    low = between(span["x0"] + margin, F.lit(0), F.lit(width - 1))
    return F.struct(low.alias("x0"), F.greatest(F.least(span["x1"] - margin, F.lit(width - 1)), low + 2).alias("x1"))


def seat_bands(df: DataFrame, mask: str, grid: Grid) -> DataFrame:
    """Adds seat, floor and back, arrays of points, that a chair's mask suggests by its rows; null for an empty mask.

    The seat's lower edge is where rows below the widest one of the middle get narrow, and its height is a share
    of the chair's. The back stands above it, the floor below the chair.
    """
    names = [*df.columns, "seat", "floor", "back"]
    df = fixed(df, "_table", grid.row_table(F.col(mask)))
    used = F.filter(F.sequence(F.lit(0), F.lit(grid.height - 1)), lambda y: F.get("_table", y)["n"] > 0)
    ends = lambda pick, name: pick(F.transform(F.col("_table"), lambda r: r[name]))
    box = F.struct(F.array_min(used).alias("y0"), F.array_max(used).alias("y1"), ends(F.array_min, "first").alias("x0"), ends(F.array_max, "last").alias("x1"))
    df = fixed(df, "_box", box)
    some = F.col("_box.y0").isNotNull()
    only = lambda value: F.when(some, value)
    df = fixed(df, "_rows", only(F.slice("_table", F.col("_box.y0") + 1, F.col("_box.y1") - F.col("_box.y0") + 1)))
    df = fixed(df, "_counts", F.transform("_rows", lambda r: r["n"]))

    rows, counts, whole = F.col("_rows"), F.col("_counts"), F.col("_box")
    h = F.size(rows)
    low, high = (part(share, h) for share in PEAK_BAND)
    df = fixed(df, "_peak", only(F.when(high > low, peak_row(counts, low, high)).otherwise(peak_row(counts, F.lit(0), h))))
    limit = F.greatest(F.lit(DROP_LEAST), part(DROP_SHARE, F.greatest(F.lit(1), F.get(counts, F.col("_peak")))))
    drop = F.coalesce(first_below(counts, F.col("_peak"), limit), F.least(part(NO_DROP, h), h - 1))
    df = fixed(df, "_lower", only(between(drop - part(LOWER_LIFT, h), *(part(share, h) for share in LOWER_LIMITS))))
    lower = F.col("_lower")
    thin = F.greatest(F.lit(6), part(SEAT_HEIGHT_LEAST, h))
    tall = F.least(F.greatest(part(SEAT_HEIGHT, h), thin), F.greatest(F.lit(10), part(SEAT_HEIGHT_MOST, h)))
    upper = F.greatest(part(UPPER_LEAST, h), lower - tall)
    df = fixed(df, "_upper", only(F.when(upper < lower, upper).otherwise(F.greatest(F.lit(0), lower - thin))))
    upper = F.col("_upper")

    df = fixed(df, "_seat", only(narrowed(span_at(rows, F.floor((upper + lower) / 2).cast("int"), whole, whole), SEAT_MARGIN, 12, grid.width)))
    seat = F.col("_seat")
    df = fixed(df, "_back_row", only(F.greatest(part(BACK_LEAST, h), upper - F.greatest(F.lit(8), part(BACK_RISE, h)))))
    df = fixed(df, "_back", only(narrowed(span_at(rows, F.col("_back_row"), whole, seat), BACK_MARGIN, 1, grid.width)))
    back, top, wide = F.col("_back"), F.col("_box.y0"), seat["x1"] - seat["x0"]
    floor = between(F.col("_box.y1") + int(FLOOR_BELOW_CHAIR * grid.height), top + lower + int(FLOOR_BELOW_SEAT * grid.height), F.lit(grid.height - 1))
    f0 = between(seat["x0"] - wide * FLOOR_WIDER, F.lit(0), F.lit(grid.width - 1)).cast("int")
    f1 = F.greatest(F.least(seat["x1"] + wide * FLOOR_WIDER, F.lit(grid.width - 1)).cast("int"), f0 + 2)
    at = lambda x, y: G.point(x.cast("double"), y.cast("double"))
    corners = F.array(at(seat["x0"], top + upper), at(seat["x1"], top + upper), at(seat["x1"], top + lower), at(seat["x0"], top + lower))
    df = df.withColumn("seat", only(corners)).withColumn("floor", only(F.array(at(f0, floor), at(f1, floor))))
    df = df.withColumn("back", only(F.array(at(back["x0"], top + F.col("_back_row")), at(back["x1"], top + F.col("_back_row")))))
    return df.select(*names)


def contact_rows(df: DataFrame, mask: str, grid: Grid, out: str = "area") -> DataFrame:
    """Adds a mask of the contact area within a seat's rows: the middle 97 % of each row's pixels less a margin, closed and opened.

    Where fewer than ROWS_LEAST rows have such a middle, the seat's whole rectangle counts as well. df has a column seat; null gives null.
    """
    seat = F.col("seat")
    x0, upper, x1, lower = (seat[i][axis].cast("int") for i, axis in ((0, "x"), (0, "y"), (1, "x"), (2, "y")))

    def middle(y: Column) -> Column:
        columns = F.transform(F.array(grid.columns_of(F.col(mask), y)), lambda c: F.struct(F.size(c).alias("n"), *[percentile(c, s).cast("int").alias(e) for s, e in zip(ROW_SHARES, ("left", "right"))]))
        margin = lambda s: F.greatest(F.lit(1), part(ROW_MARGIN, s["right"] - s["left"] + 1))
        low = lambda s: F.least(s["left"] + margin(s), F.lit(grid.width - 1))
        high = lambda s: F.greatest(F.least(s["right"] - margin(s), F.lit(grid.width - 1)), low(s) + 2)
        return F.transform(columns, lambda s: F.when((s["n"] >= 4) & (s["right"] > s["left"]), F.struct(low(s).alias("first"), F.least(high(s), F.lit(grid.width - 1)).alias("last"))))[0]

    inside = lambda y: (y >= upper) & (y <= lower)
    spans = F.transform(F.sequence(F.lit(0), F.lit(grid.height - 1)), lambda y: F.when(inside(y), middle(y)))
    df = fixed(df, "_spans", F.when(seat.isNotNull(), spans))
    few = F.size(F.filter("_spans", lambda s: s.isNotNull())) < ROWS_LEAST
    painted = grid.of_spans(F.col("_spans"))
    df = fixed(df, "_painted", F.when(seat.isNotNull(), F.when(few, F.transform(F.array(grid.rectangle(x0, upper, x1, lower)), lambda r: F.zip_with(r, painted, lambda a, b: a.bitwiseOR(b)))[0]).otherwise(painted)))
    used = F.filter(F.sequence(F.lit(0), F.lit(grid.height - 1)), lambda y: F.exists(F.slice(mask, y * grid.words + 1, grid.words), lambda bits: bits != 0))
    df = fixed(df, "_radius", F.floor(F.greatest(F.lit(3), part(CLOSING, F.array_max(used) - F.array_min(used) + 1)) / 2).cast("int"))
    df = fixed(df, out, F.when(seat.isNotNull(), grid.open(grid.close(F.col("_painted"), F.col("_radius")), 1)))
    return df.drop("_spans", "_painted", "_radius")


def seat_axis(seat: Column, back: Column) -> Column:
    """struct<back,front>: the middles of the seat's side nearest to the back's middle and of the side across."""
    mid = lambda a, b: G.point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)
    sides = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: mid(F.get(seat, i), F.get(seat, (i + 1) % 4)))
    middle = mid(back[0], back[1])
    away = F.transform(F.transform(F.array(sides), lambda s: F.transform(s, lambda p, i: F.struct(F.hypot(p["x"] - middle["x"], p["y"] - middle["y"]).alias("d"), i.alias("i"), p.alias("p"), F.get(s, (i + 2) % 4).alias("q"))))[0], lambda x: x)
    return F.transform(F.array(F.array_min(away)), lambda x: F.struct(x["p"].alias("back"), x["q"].alias("front")))[0]


def unpacked(words: np.ndarray, grid: Grid) -> np.ndarray:
    """A mask of bit words as a boolean grid."""
    bits = np.unpackbits(np.asarray(words, "<i8").view(np.uint8).reshape(grid.height, -1), axis=1, bitorder="little")
    return bits[:, : grid.width].astype(bool)


def packed(mask: np.ndarray) -> list[int]:
    """A boolean grid as bit words."""
    wide = np.pad(mask, ((0, 0), (0, -mask.shape[1] % WORD)))
    return np.packbits(wide, axis=1, bitorder="little").view("<i8").ravel().tolist()


def trace_batch(areas: pa.ListArray, axes: pa.StructArray, grid: Grid) -> pa.StructArray:
    """struct<n,ring> of each area and axis of an Arrow batch; the rings' points are in two flat arrays, not in an object each."""
    words, ends = areas.values.to_numpy(zero_copy_only=False), areas.offsets.to_numpy()
    counts, rings = [], []
    for i, there in enumerate(areas.is_valid().to_pylist()):
        if not there:
            counts.append(None)
            rings.append(np.zeros((0, 2)))
            continue
        axis = axes[i].as_py()
        kept = R.trim_depth(R.largest_component(unpacked(words[ends[i] : ends[i + 1]], grid)), *[(axis[e]["x"], axis[e]["y"]) for e in ("back", "front")])
        ring = R.border(R.largest_component(kept)).astype(float)
        around = float(np.hypot(*(np.roll(ring, -1, axis=0) - ring).T).sum())
        simple = R.outline(kept, max(1.0, OUTLINE_SHARE * around), 10**9)
        counts.append(int(kept.sum()))
        rings.append(np.asarray(simple if len(simple) >= OUTLINE_LEAST else ring, float).reshape(-1, 2))
    points = np.concatenate([np.zeros((0, 2)), *rings])
    flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, k])) for k in (0, 1)], ["x", "y"])
    offsets = pa.array(np.cumsum([0, *map(len, rings)]), pa.int32())
    told = pa.ListArray.from_arrays(offsets, flat, mask=pa.array([n is None for n in counts], pa.bool_()))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), told], ["n", "ring"])


def traced(area: Column, axis: Column, grid: Grid) -> Column:
    """struct<n,ring>: the pixels of an area's largest part between back and front, and the border around them, simplified by its length.

    The one step in Python: it follows the border of a mask that comes in bit words. A worker holds a batch of masks at a
    time, which session.small_batches bounds.
    """
    run = lean(lambda batches: (trace_batch(areas, axes, grid) for areas, axes in batches))

    @F.arrow_udf("struct<n:int,ring:array<struct<x:double,y:double>>>")
    def rings(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from run(batches)

    return rings(area, axis)


def contact_polygon(ring: Column, seat: Column, grid: Grid) -> Column:
    """A border as a polygon of some 140 points, none nearer than POINT_GAP to the one before; the seat where that is too small."""
    step = F.when(F.size(ring) >= OUTLINE_LEAST, F.greatest(F.lit(1), F.floor(F.size(ring) / OUTLINE_MOST).cast("int"))).otherwise(F.lit(1))
    spread = F.filter(ring, lambda p, i: i % step == 0)
    told = F.transform(F.array(dedupe_by_distance(spread, POINT_GAP)), lambda p: F.when((F.size(p) >= 3) & (G.polygon_area(p) >= max(AREA_LEAST, AREA_SHARE * grid.height * grid.width)), p))
    return F.coalesce(told[0], seat)
