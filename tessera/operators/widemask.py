"""Masks of any width as arrays of whole numbers: 64 pixels each, row after row, so that set operations, morphology and counts are bit operations.

The words of a row follow each other, and the k-th bit of the w-th is column 64 w + k. The functions give expressions
over such arrays. A mask that an expression reads at many places must be a column of its own (functions.arrays.fixed).
Expressions over arrays go word by word and are slow on masks of thousands of words; Batch does the same operations on
many masks at once, in Arrow batches, where only numbers of the masks are wanted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import geometry as G

WORD = 64


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _ones(n: Column) -> Column:
    """A word with its lowest n bits set, n from 0 to 64."""
    return F.when(n > 0, F.call_function("shiftrightunsigned", _long(-1), F.greatest(WORD - n, F.lit(0)).cast("int"))).otherwise(_long(0))


def count(mask: Column) -> Column:
    """How many pixels are set."""
    return F.aggregate(mask, _long(0), lambda n, word: n + F.bit_count(word))


def union(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def common(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def without(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for two empty masks. The pixels are counted without making either mask."""
    counted = lambda op: F.aggregate(F.arrays_zip(a.alias("x"), b.alias("y")), _long(0), lambda n, w: n + F.bit_count(op(w["x"], w["y"])))
    return counted(lambda x, y: x.bitwiseAND(y)) / F.greatest(_long(1), counted(lambda x, y: x.bitwiseOR(y)))


def union_of(masks: Column, grid: Grid) -> Column:
    """The pixels that any mask of an array of masks has."""
    return F.aggregate(masks, grid.empty(), union)


@dataclass(frozen=True)
class Grid:
    """The size of masks, in pixels."""

    height: int
    width: int

    @property
    def words(self) -> int:
        """Words in a row."""
        return -(-self.width // WORD)

    def _row(self, i: Column) -> Column:
        return F.floor(i / self.words).cast("int")

    def _word(self, i: Column) -> Column:
        return (i % self.words).cast("int")

    def _each(self, make) -> Column:
        """A mask of make(row, word) for every word."""
        return F.transform(F.sequence(F.lit(0), F.lit(self.height * self.words - 1)), lambda i: make(self._row(i), self._word(i)))

    def empty(self) -> Column:
        return F.array_repeat(_long(0), self.height * self.words)

    def _span(self, w: Column, first: Column, end: Column) -> Column:
        """The bits of the w-th word of a row that is set from column `first` up to, and without, `end`."""
        return _ones(end - w * WORD).bitwiseAND(F.bitwise_not(_ones(first - w * WORD)))

    def rectangle(self, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        """All pixels from (x0, y0) to (x1, y1), both included."""
        inside = lambda r: (r >= y0) & (r <= y1)
        return self._each(lambda r, w: F.when(inside(r), self._span(w, F.greatest(x0, F.lit(0)), F.least(x1 + 1, F.lit(self.width)))).otherwise(_long(0)))

    def of_spans(self, spans: Column) -> Column:
        """A mask of an array with a struct<first,last> for every row, null for a row without pixels."""
        rows = F.transform(spans, lambda s: F.struct(F.coalesce(s["first"], F.lit(0)).alias("first"), (F.coalesce(s["last"], F.lit(-1)) + 1).alias("end")))
        line = lambda s: F.transform(F.sequence(F.lit(0), F.lit(self.words - 1)), lambda w: self._span(w, s["first"], s["end"]))
        return F.flatten(F.transform(rows, line))

    def fill(self, points: Column, cell: float = 1.0) -> Column:
        """The pixels whose centres are inside a polygon by the even-odd rule: each side that a row's middle crosses flips all pixels before the crossing."""

        def line(r: Column) -> Column:
            y = (r + 0.5) * cell
            crossed = F.filter(G.edges(points), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
            at = lambda e: (e["a"]["x"] - e["b"]["x"]) * (y - e["b"]["y"]) / ((e["a"]["y"] - e["b"]["y"]) + G.EPS) + e["b"]["x"]
            before = F.transform(crossed, lambda e: F.greatest(F.lit(0), F.least(F.lit(self.width), F.ceil(at(e) / cell - 0.5))).cast("int"))
            flipped = lambda w: lambda bits, n: bits.bitwiseXOR(_ones(n - w * WORD))
            pinned = F.transform(F.array(before), lambda xs: F.transform(F.sequence(F.lit(0), F.lit(self.words - 1)), lambda w: F.aggregate(xs, _long(0), flipped(w))))
            return pinned[0]

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(self.height - 1)), line))

    def band(self, mask: Column, first: Column, last: Column) -> Column:
        """The mask without the rows before `first` and after `last`."""
        return F.transform(mask, lambda bits, i: F.when((self._row(i) >= first) & (self._row(i) <= last), bits).otherwise(_long(0)))

    def complement(self, mask: Column) -> Column:
        full = lambda i: _ones(F.lit(self.width) - self._word(i) * WORD)
        return F.transform(mask, lambda bits, i: F.bitwise_not(bits).bitwiseAND(full(i)))

    def flip(self, mask: Column) -> Column:
        """Left and right exchanged: the bits of each word are reversed, then a row's words, then the empty end is shifted off."""
        spare = self.words * WORD - self.width
        turned = lambda bits: F.conv(F.reverse(F.lpad(F.bin(bits), WORD, "0")), 2, -10).cast("long")
        at = lambda i: F.coalesce(F.get(mask, i), _long(0))

        def word(i: Column) -> Column:
            r, w = self._row(i), self._word(i)
            source = lambda k: turned(at(r * self.words + (self.words - 1) - k))
            if not spare:
                return source(w)
            after = F.when(w + 1 < self.words, source(w + 1)).otherwise(_long(0))
            return F.shiftrightunsigned(source(w), spare).bitwiseOR(F.shiftleft(after, WORD - spare))

        return F.transform(F.sequence(F.lit(0), F.lit(self.height * self.words - 1)), word)

    def _grown(self, mask: Column) -> Column:
        """Every set pixel's eight neighbours, with carries from word to word."""
        beside = lambda m, i, by: F.when((self._word(i) + by >= 0) & (self._word(i) + by < self.words), F.coalesce(F.get(m, i + by), _long(0))).otherwise(_long(0))
        near = lambda m, i: F.coalesce(F.get(m, i), _long(0))

        def wide(m: Column) -> Column:
            own = lambda bits, i: bits.bitwiseOR(F.shiftleft(bits, 1)).bitwiseOR(F.shiftrightunsigned(bits, 1))
            if self.words == 1:
                return F.transform(m, own)
            carried = lambda i: F.shiftrightunsigned(beside(m, i, -1), WORD - 1).bitwiseOR(F.shiftleft(beside(m, i, 1), WORD - 1))
            return F.transform(m, lambda bits, i: own(bits, i).bitwiseOR(carried(i)))

        def tall(m: Column) -> Column:
            full = lambda i: _ones(F.lit(self.width) - self._word(i) * WORD)
            return F.transform(m, lambda bits, i: bits.bitwiseOR(near(m, i - self.words)).bitwiseOR(near(m, i + self.words)).bitwiseAND(full(i)))

        # bound as lambda variables, so that the mask is made once and read at many places
        widened = F.transform(F.array(mask), wide)
        return F.transform(widened, tall)[0]

    def dilate(self, mask: Column, radius: int | Column = 1) -> Column:
        """Sets every pixel with a set one in the square of 2 radius + 1 around it; radius may differ from row to row of a table."""
        if isinstance(radius, int):
            for _ in range(radius):
                mask = self._grown(mask)
            return mask
        rounds = F.when(radius > 0, F.sequence(F.lit(1), radius)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(rounds, mask, lambda m, _: self._grown(m))

    def erode(self, mask: Column, radius: int | Column = 1) -> Column:
        """Keeps the pixels whose square is set as far as it lies in the grid."""
        return self.complement(self.dilate(self.complement(mask), radius))

    def close(self, mask: Column, radius: int | Column = 1) -> Column:
        return self.erode(self.dilate(mask, radius), radius)

    def open(self, mask: Column, radius: int | Column = 1) -> Column:
        return self.dilate(self.erode(mask, radius), radius)

    def flood(self, seed: Column, within: Column, steps: int = 64) -> Column:
        """What a walk of at most `steps` pixels inside a mask reaches from a seed."""
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), common(seed, within), lambda m, _: common(self._grown(m), within))

    def row_table(self, mask: Column) -> Column:
        """For every row: n, first and last set column, null where there is none."""
        numbers = F.sequence(F.lit(0), F.lit(self.words - 1))
        low = lambda bits: F.length(F.bin(bits)) - F.length(F.rtrim(F.bin(bits), F.lit("0")))
        high = lambda bits: F.length(F.bin(bits)) - 1

        def line(r: Column) -> Column:
            words = F.slice(mask, r * self.words + 1, self.words)
            told = F.filter(F.zip_with(words, numbers, lambda bits, w: F.struct(bits.alias("bits"), w.alias("w"))), lambda x: x["bits"] != 0)
            row = F.transform(
                F.array(told),
                lambda t: F.struct(
                    F.aggregate(t, F.lit(0), lambda n, x: n + F.bit_count(x["bits"])).alias("n"),
                    (F.get(t, F.lit(0))["w"] * WORD + low(F.get(t, F.lit(0))["bits"])).alias("first"),
                    (F.get(t, F.size(t) - 1)["w"] * WORD + high(F.get(t, F.size(t) - 1)["bits"])).alias("last"),
                ),
            )
            return row[0]

        return F.transform(F.sequence(F.lit(0), F.lit(self.height - 1)), line)

    def columns_of(self, mask: Column, row: Column) -> Column:
        """The set columns of one row, ascending."""
        is_set = lambda x: F.get(mask, row * self.words + F.floor(x / WORD).cast("int"))
        bit = lambda x: F.call_function("shiftrightunsigned", is_set(x), (x % WORD).cast("int")).bitwiseAND(_long(1))
        return F.filter(F.sequence(F.lit(0), F.lit(self.width - 1)), lambda x: bit(x) == 1)


def _ends(n: np.ndarray) -> np.ndarray:
    """Words with their lowest n bits set; none for n below 0, all from 64 on."""
    return np.where(n > 0, np.uint64(0xFFFFFFFFFFFFFFFF) >> (WORD - np.clip(n, 1, WORD)).astype(np.uint64), np.uint64(0))


@dataclass(frozen=True)
class Batch:
    """Operations on many masks of one grid: numpy arrays of words by mask, row and word, with the results of Grid's expressions."""

    grid: Grid

    @property
    def full(self) -> np.ndarray:
        """The words of a row with all pixels set."""
        return _ends(self.grid.width - WORD * np.arange(self.grid.words))

    def fill(self, points: np.ndarray, cell: float = 1.0) -> np.ndarray:
        """The masks of polygons, an array by polygon, point and axis; a point may be repeated."""
        y = (np.arange(self.grid.height) + 0.5) * cell
        starts = WORD * np.arange(self.grid.words)
        masks = np.zeros((len(points), self.grid.height, self.grid.words), np.uint64)
        for k in range(points.shape[1]):
            (ax, ay), (bx, by) = (points[:, j % points.shape[1], :, None].swapaxes(0, 1) for j in (k, k + 1))
            which, row = np.nonzero((ay > y) != (by > y))
            ax, ay, bx, by = (v[which, 0] for v in (ax, ay, bx, by))
            at = (ax - bx) * (y[row] - by) / ((ay - by) + G.EPS) + bx
            before = np.clip(np.ceil(at / cell - 0.5), 0, self.grid.width).astype(np.int64)
            masks[which, row] ^= _ends(before[:, None] - starts)
        return masks

    def count(self, masks: np.ndarray) -> np.ndarray:
        return np.bitwise_count(masks).sum(axis=(1, 2), dtype=np.int64)

    def dilate(self, masks: np.ndarray) -> np.ndarray:
        """Every set pixel's eight neighbours, with carries from word to word."""
        one, last = np.uint64(1), np.uint64(WORD - 1)
        wide = masks | (masks << one) | (masks >> one)
        wide[..., 1:] |= masks[..., :-1] >> last
        wide[..., :-1] |= masks[..., 1:] << last
        tall = wide.copy()
        tall[:, 1:] |= wide[:, :-1]
        tall[:, :-1] |= wide[:, 1:]
        return tall & self.full

    def complement(self, masks: np.ndarray) -> np.ndarray:
        return ~masks & self.full

    def erode(self, masks: np.ndarray) -> np.ndarray:
        return self.complement(self.dilate(self.complement(masks)))


def ring_batch(polygons: pa.ListArray) -> np.ndarray:
    """Polygons of an Arrow batch by polygon, point and axis; shorter ones repeat their last point, which adds no side. One without points is a point at 0."""
    sizes = np.diff(polygons.offsets.to_numpy())
    flat = polygons.flatten()
    points = np.stack([np.append(flat.field(axis).to_numpy(zero_copy_only=False), 0.0) for axis in ("x", "y")], axis=1)
    most = max(1, int(sizes.max(initial=0)))
    at = np.minimum(np.arange(most), np.maximum(sizes - 1, 0)[:, None]) + (np.cumsum(sizes) - sizes)[:, None]
    return points[np.where(sizes[:, None] > 0, at, len(points) - 1)]


def compared(a: Column, b: Column, grid: Grid, measures: dict[str, Callable[[Batch, np.ndarray, np.ndarray], np.ndarray]], at_once: int = 16) -> Column:
    """struct of whole numbers that measures give of the masks of two columns of polygons; `at_once` pairs of masks are in memory."""
    told = ",".join(f"{name}:bigint" for name in measures)

    @F.arrow_udf(f"struct<{told}>")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        make, out = Batch(grid), {name: np.zeros(len(left), np.int64) for name in measures}
        for k in range(0, len(left), at_once):
            m, n = (make.fill(ring_batch(side.slice(k, at_once))) for side in (left, right))
            for name, measure in measures.items():
                out[name][k : k + at_once] = measure(make, m, n)
        return pa.StructArray.from_arrays([pa.array(v) for v in out.values()], list(out))

    return run(a, b)
