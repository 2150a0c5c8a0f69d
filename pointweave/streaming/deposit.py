"""A running deposit: the cell sums of a stream of particles.

Deposits are additive, so the same plan works on a stream in update or complete
mode; the state is one row of sums a cell. With an event time and a watermark,
each window keeps its own grid and old ones are closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.geometry import AXES, floor_int, wrapped
from pointweave.functions.text import num


def streaming_deposit(
    particles: DataFrame,
    fields: list[str],
    grid: tuple[int, ...],
    box: tuple[float, ...],
    time_col: str | None = None,
    window: str = "1 hour",
    watermark: str = "1 hour",
) -> DataFrame:
    """Nearest-cell sums of w and w * field by cell, and by window if ``time_col`` is given."""
    axes = AXES[: len(grid)]
    rows = particles
    keys = []
    if time_col is not None:
        rows = rows.withWatermark(time_col, watermark)
        keys.append(F.window(time_col, window).alias("window"))
    for a, n, length in zip(axes, grid, box, strict=True):
        rows = rows.withColumn(f"i{a}", F.expr(wrapped(floor_int(f"{a} * {num(n / length)}"), n)))
    sums = [F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(f)).alias(f"f{k}") for k, f in enumerate(fields)]]
    return rows.groupBy(*keys, *[f"i{a}" for a in axes]).agg(*sums)
