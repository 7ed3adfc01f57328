"""What the query catalogue shares: stand-in polygons made of the driver's embeddings, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.geometry import clamp, point
from tessera.session import table

FRAME = 224
GRID = 16


def dim(k: int | Column) -> Column:
    """The k-th number of an embedding from 0, as a double."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.element_at("embedding", (k + 1).cast("int")).cast("double")


def polygon(first: int, n: int = 6, spread: float = FRAME - 1.0, shift: float = 0.0, low: float | None = 0.0) -> Column:
    """n points from consecutive dimensions, mapped from [-0.5, 0.5] to the frame; clamped unless low is None."""
    fit = (lambda v: clamp(v, low, FRAME - 1.0)) if low is not None else (lambda v: v)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda k: point(fit((dim(k * 2 + first) + 0.5) * spread + shift), fit((dim(k * 2 + first + 1) + 0.5) * spread + shift)),
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, gt and pred: polygons of six points in a 224-pixel frame."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", polygon(0).alias("gt"), polygon(12).alias("pred"))
    return rows.select("vec_id", "label", F.explode(F.array(F.struct("gt", "pred"))).alias("p")).select("vec_id", "label", "p.gt", "p.pred")


def sql_points(name: str, first: int, n: int = 6, spread: float = FRAME - 1.0, shift: float = 0.0, clamped: bool = True) -> str:
    """A DuckDB common table with a row for each point: vec_id, label, i, x, y."""
    value = lambda k: f"((embedding[2*k+{first}+{k}]::DOUBLE+0.5)*{spread}+{shift})"
    if clamped:
        value = lambda k: f"least(greatest((embedding[2*k+{first}+{k}]::DOUBLE+0.5)*{spread}+{shift},0.0),{FRAME - 1.0})"
    return f"{name} AS (SELECT vec_id, label, k AS i, {value(1)} AS x, {value(2)} AS y FROM embeddings, range({n}) t(k))"


def sql_edges(name: str, points: str) -> str:
    """A DuckDB common table with a row for each side: vec_id, label, i, start (sx, sy), end (ex, ey)."""
    first = lambda c: f"first_value({c}) OVER (PARTITION BY vec_id ORDER BY i)"
    lead = lambda c: f"coalesce(lead({c}) OVER (PARTITION BY vec_id ORDER BY i), {first(c)})"
    return f"{name} AS (SELECT vec_id, label, i, x AS sx, y AS sy, {lead('x')} AS ex, {lead('y')} AS ey FROM {points})"


def sql_bbox(name: str, points: str) -> str:
    return f"{name} AS (SELECT vec_id, label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM {points} GROUP BY vec_id, label)"


def sql_grid(name: str, boxes: str, scale: float = GRID / FRAME, n: int = GRID) -> str:
    """A DuckDB common table of whole-number boxes on a grid, each side spanning a step."""
    low = lambda c: f"floor(least(greatest({c}*{scale},0.0),{n - 1.0}))::INTEGER"
    high = lambda c: f"ceil(least(greatest({c}*{scale},0.0),{n - 1.0}))::INTEGER"
    raw = f"SELECT vec_id, label, {low('x0')} AS a0, {low('y0')} AS b0, {high('x1')} AS a1, {high('y1')} AS b1 FROM {boxes}"
    fix = lambda lo, hi: f"CASE WHEN {hi}<={lo} AND {lo}>={n - 1} THEN greatest({lo}-1,0) ELSE {lo} END AS {lo}, CASE WHEN {hi}<={lo} AND {lo}<{n - 1} THEN {lo}+1 ELSE {hi} END AS {hi}"
    return f"{name} AS (SELECT vec_id, label, {fix('a0', 'a1')}, {fix('b0', 'b1')} FROM ({raw}))"


def r4(column: Column) -> Column:
    """Rounded to four places, without negative zero."""
    return F.round(column, 4) + 0.0
