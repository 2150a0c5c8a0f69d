"""Symmetric 2 x 2 and 3 x 3 tensors: entries as columns, eigensystems where needed.

With S = H H a density or an interpolation needs only S's inverse and determinant,
which are closed forms. Eigenvectors are needed for sample points and projections;
in 3-D they come from numpy in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.geometry import AXES


def entries(dim: int) -> list[str]:
    """The unique entries' suffixes: xx, xy, yy or xx, xy, yy, xz, yz, zz."""
    return {1: ["xx"], 2: ["xx", "xy", "yy"], 3: ["xx", "xy", "yy", "xz", "yz", "zz"]}[dim]


def entry(a: str, b: str) -> str:
    return min(a, b) + max(a, b)


def determinant(dim: int, p: str = "s") -> str:
    if dim == 1:
        return f"{p}xx"
    if dim == 2:
        return f"({p}xx * {p}yy - {p}xy * {p}xy)"
    return (
        f"({p}xx * ({p}yy * {p}zz - {p}yz * {p}yz) - {p}xy * ({p}xy * {p}zz - {p}yz * {p}xz)"
        f" + {p}xz * ({p}xy * {p}yz - {p}yy * {p}xz))"
    )


def adjugate(dim: int, p: str = "s") -> dict[str, str]:
    """The entries of the inverse times the determinant."""
    if dim == 2:
        return {"xx": f"{p}yy", "xy": f"(-{p}xy)", "yy": f"{p}xx"}
    return {
        "xx": f"({p}yy * {p}zz - {p}yz * {p}yz)",
        "xy": f"({p}xz * {p}yz - {p}xy * {p}zz)",
        "yy": f"({p}xx * {p}zz - {p}xz * {p}xz)",
        "xz": f"({p}xy * {p}yz - {p}xz * {p}yy)",
        "yz": f"({p}xy * {p}xz - {p}xx * {p}yz)",
        "zz": f"({p}xx * {p}yy - {p}xy * {p}xy)",
    }


def eigenvalues_2d(p: str = "s") -> tuple[str, str]:
    """Ascending."""
    half = f"(0.5e0 * ({p}xx + {p}yy))"
    root = f"sqrt(0.25e0 * ({p}xx - {p}yy) * ({p}xx - {p}yy) + {p}xy * {p}xy)"
    return f"({half} - {root})", f"({half} + {root})"


def sign_fixed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the component of largest magnitude is positive."""
    at = np.abs(vectors).argmax(axis=-2)[..., None, :]
    return vectors * np.where(np.take_along_axis(vectors, at, axis=-2) < 0, -1.0, 1.0)


def _full(columns: list[pd.Series], dim: int) -> np.ndarray:
    out = np.empty((len(columns[0]), dim, dim))
    for name, series in zip(entries(dim), columns, strict=True):
        a, b = (AXES.index(c) for c in name)
        out[:, a, b] = out[:, b, a] = series.to_numpy(float)
    return out


def _system_fields(dim: int) -> list[str]:
    axes = AXES[:dim]
    return [
        *[f"l{k}" for k in range(dim)],
        *[f"v{a}{k}" for k in range(dim) for a in axes],
        *[f"h{e}" for e in entries(dim)],
        *[f"g{e}" for e in entries(dim)],
        *[f"r{a}" for a in axes],
    ]


def _system_frame(values: np.ndarray, vectors: np.ndarray, dim: int) -> pd.DataFrame:
    """Of H = V diag(values) V^T: the system, H, the inverse of H H, and H's reach along each axis."""
    axes = range(dim)
    h = np.einsum("nij,nj,nkj->nik", vectors, values, vectors)
    inverse = np.einsum("nij,nj,nkj->nik", vectors, np.where(values > 0, 1.0, 0.0) / np.where(values > 0, values, 1.0) ** 2, vectors)
    reach = np.sqrt(np.einsum("nij,nj,nij->ni", vectors, values**2, vectors))
    at = lambda m, e: m[:, AXES.index(e[0]), AXES.index(e[1])]
    data = {f"l{k}": values[:, k] for k in axes}
    data |= {f"v{AXES[a]}{k}": vectors[:, a, k] for k in axes for a in axes}
    data |= {f"h{e}": at(h, e) for e in entries(dim)} | {f"g{e}": at(inverse, e) for e in entries(dim)}
    data |= {f"r{AXES[a]}": reach[:, a] for a in axes}
    return pd.DataFrame(data)[_system_fields(dim)]


def with_eigensystem(df: DataFrame, dim: int, limit: float | None = None) -> DataFrame:
    """Adds, of H with S = H H (``sxx``, ...): eigenvalues ``l?`` ascending, unit vectors ``v??``,
    H's entries ``h??``, the inverse of S ``g??`` (0 along null directions) and the reach ``r?``
    along each axis. ``limit`` shrinks an H whose largest eigenvalue is above it."""

    @F.pandas_udf(", ".join(f"{f} double" for f in _system_fields(dim)))
    def solve(*columns: pd.Series) -> pd.DataFrame:
        values, vectors = np.linalg.eigh(_full(list(columns), dim))
        values = np.sqrt(np.clip(values, 0.0, None))
        if limit is not None:
            top = values.max(axis=1, keepdims=True)
            values = values * np.where(top > limit, limit / np.where(top > 0, top, 1.0), 1.0)
        return _system_frame(values, sign_fixed(vectors), dim)

    return df.withColumn("_e", solve(*[F.col(f"s{e}") for e in entries(dim)])).select("*", "_e.*").drop("_e")


def project_2d(df: DataFrame, plane: tuple[int, int] = (0, 1)) -> DataFrame:
    """H of 3-D seen in a plane: H2 = (P H^-1 P^T)^-1 with its eigensystem.

    ``df`` has the six entries of S = H H. Adds l0, l1, vx0, vy0, vx1, vy1 and
    hxx, hxy, hyy of the plane (its axes are called x and y).
    """
    a, b = plane

    @F.pandas_udf(", ".join(f"{f} double" for f in _system_fields(2)))
    def solve(*columns: pd.Series) -> pd.DataFrame:
        values, vectors = np.linalg.eigh(_full(list(columns), 3))
        inverse = np.einsum("nij,nj,nkj->nik", vectors, 1.0 / np.sqrt(np.clip(values, 1e-300, None)), vectors)
        flat = np.linalg.inv(inverse[:, [a, b]][:, :, [a, b]])
        values, vectors = np.linalg.eigh(flat)
        return _system_frame(values, sign_fixed(vectors), 2)

    return df.withColumn("_e", solve(*[F.col(f"s{e}") for e in entries(3)])).select("*", "_e.*").drop("_e")
