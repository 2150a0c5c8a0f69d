"""Regular grids as DataFrames, and line positions for plots."""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions.geometry import AXES
from pointweave.functions.text import num


def _per_axis(value, dim: int, what: str) -> list:
    out = list(value) if hasattr(value, "__iter__") else [value]
    out = out * dim if len(out) == 1 else out
    if len(out) != dim:
        raise ValueError(f"{what} must have one value or {dim}, not {len(out)}")
    return out


def create_grid(spark: SparkSession, n_cells, boxsize, dim: int) -> DataFrame:
    """Cell centres (i + 1/2) L / n with their indices and a running id, the last axis fastest."""
    counts = [int(n) for n in _per_axis(n_cells, dim, "n_cells")]
    box = [float(b) for b in _per_axis(boxsize, dim, "boxsize")]
    if any(n <= 0 for n in counts):
        raise ValueError("n_cells must be positive")
    rows = spark.range(prod(counts))
    columns, stride = ["id AS qid"], prod(counts)
    for axis, n, length in zip(AXES, counts, box, strict=False):
        stride //= n
        index = f"CAST((id div {stride}) % {n} AS INT)"
        columns += [f"{index} AS i{axis}", f"({index} + 0.5e0) * {num(length / n)} AS {axis}"]
    return rows.selectExpr(*columns)


def create_grid_1d(spark, n_cells, boxsize):
    return create_grid(spark, n_cells, boxsize, 1)


def create_grid_2d(spark, n_cells, boxsize):
    return create_grid(spark, n_cells, boxsize, 2)


def create_grid_3d(spark, n_cells, boxsize):
    return create_grid(spark, n_cells, boxsize, 3)


def grid_lines(edges, nx: int, ny: int | None = None, include_edges: bool = True):
    """(vertical positions, horizontal positions, (ymin, ymax, xmin, xmax)) for plots.

    ``edges`` is (xmin, xmax, ymin, ymax). Without the edges the interior lines
    remain, and a single line stands in the middle. The last tuple is swapped on purpose.
    """
    ny = nx if ny is None else ny
    if nx < 0 or ny < 0:
        raise ValueError("nx and ny must not be negative")
    xmin, xmax, ymin, ymax = edges

    def lines(low: float, high: float, n: int) -> list[float]:
        inner = [low + (high - low) * k / n for k in range(1, n)]
        if n == 0:
            return []
        if include_edges:
            return [float(low), *inner, float(high)]
        return [(low + high) / 2.0] if n == 1 else inner

    return lines(xmin, xmax, int(nx)), lines(ymin, ymax, int(ny)), (ymin, ymax, xmin, xmax)


def grid_lines_frame(spark: SparkSession, edges, nx: int, ny: int | None = None, include_edges: bool = True) -> DataFrame:
    """The lines as rows: ``orientation`` (v or h), ``line`` (from 0) and ``position``."""
    v, h, _ = grid_lines(edges, nx, ny, include_edges)
    rows = [(o, k, p) for o, found in (("v", v), ("h", h)) for k, p in enumerate(found)]
    return spark.createDataFrame(rows, "orientation string, line int, position double")


def shift_coordinates(points: DataFrame, dim: int) -> DataFrame:
    """Coordinates less their minimum on each axis; one small aggregate, broadcast back."""
    axes = AXES[:dim]
    low = points.agg(*[F.min(a).alias(f"_low_{a}") for a in axes])
    out = points.crossJoin(F.broadcast(low))  # one row
    return out.withColumns({a: F.col(a) - F.col(f"_low_{a}") for a in axes}).drop(*[f"_low_{a}" for a in axes])
