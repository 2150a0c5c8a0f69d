"""Smoothing lengths and tensors, densities and interpolation over neighbour edges.

All are aggregates by query. The edges carry the neighbours' columns, so one
exchange on qid serves the top-k window and every aggregate after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.functions.geometry import AXES
from pointweave.functions.kernels import get_kernel
from pointweave.functions.tensors import adjugate, determinant, entries, entry
from pointweave.functions.text import num

EPS = 1e-7
#: Added to a neighbour's density before dividing by it.
DENSITY_EPS = 1e-8
MODES = ("field", "gradient", "divergence", "curl")


def smoothing_length(edges: DataFrame) -> DataFrame:
    """(id, h): the distance to the farthest of the neighbours, oneself counted."""
    return edges.groupBy(F.col("qid").alias("id")).agg(F.max("dist").alias("h"))


def smoothing_tensor(edges: DataFrame, dim: int) -> DataFrame:
    """(id, sxx, ..., det): the neighbours' weighted second moments about the query, slightly rounded.

    S + 1e-7 tr(S) I; H is its square root. Needs the neighbours' weights (n_w).
    """
    if dim not in (2, 3):
        raise ValueError("smoothing tensors need two or three dimensions")
    sums = [F.sum(F.expr(f"n_w * d{e[0]} * d{e[1]}")).alias(f"m{e}") for e in entries(dim)]
    raw = edges.groupBy(F.col("qid").alias("id")).agg(F.sum("n_w").alias("mw"), *sums)
    trace = " + ".join(f"m{a}{a} / mw" for a in AXES[:dim])
    cells = [
        F.expr(f"m{e} / mw" + (f" + {num(EPS)} * ({trace})" if e[0] == e[1] else "")).alias(f"s{e}") for e in entries(dim)
    ]
    return raw.select("id", *cells).withColumn("det", F.expr(determinant(dim)))


def quadratic_form(dim: int, p: str = "s", det: str = "det") -> str:
    """d S^-1 d for the separation d."""
    cofactors = adjugate(dim, p)
    parts = []
    for e in entries(dim):
        twice = "" if e[0] == e[1] else "2e0 * "
        parts.append(f"{twice}{cofactors[e]} * d{e[0]} * d{e[1]}")
    return f"(({' + '.join(parts)}) / {det})"


def density(edges: DataFrame, kernel_name: str, dim: int, structure: str = "isotropic", smoothing: DataFrame | None = None) -> DataFrame:
    """(id, rho): sum of w K over the neighbours, with the query's own smoothing.

    Without ``smoothing`` it is taken from the edges themselves, over the window
    that they are already partitioned by.
    """
    if structure == "separable":
        raise ValueError("a density needs an isotropic or covariant structure")
    kernel = get_kernel(kernel_name, dim)
    if structure == "covariant":
        own = smoothing if smoothing is not None else smoothing_tensor(edges, dim)
        rows = edges.join(own.withColumnRenamed("id", "qid"), "qid")
        rows = rows.withColumn("q", F.sqrt(F.greatest(F.lit(0.0), F.expr(quadratic_form(dim)))))
        scale = f"{num(kernel.sigma(dim))} / sqrt(det)"
    else:
        if smoothing is None:
            rows = edges.withColumn("h", F.max("dist").over(Window.partitionBy("qid")))
        else:
            rows = edges.join(smoothing.withColumnRenamed("id", "qid"), "qid")
        rows = rows.withColumn("q", F.expr(f"dist / (h + {num(EPS)})"))
        scale = f"{num(kernel.sigma(dim))} / ({' * '.join(['h'] * dim)})"
    value = F.expr(f"n_w * ({kernel.value('q', dim)}) * ({scale})")
    return rows.groupBy(F.col("qid").alias("id")).agg(F.sum(value).alias("rho"))


def _gradient(kernel, dim: int, structure: str) -> tuple[str, dict[str, str]]:
    """The scale of the kernel and its gradient's components, in columns q, d?, h or s??, det."""
    if structure == "covariant":
        cofactors = adjugate(dim, "n_s")
        scale = f"({num(kernel.sigma(dim))} / sqrt(n_det))"
        lift = {
            a: "((" + " + ".join(f"{cofactors[entry(a, b)]} * d{b}" for b in AXES[:dim]) + f") / n_det / (q + {num(EPS)}))"
            for a in AXES[:dim]
        }
    else:
        scale = f"({num(kernel.sigma(dim))} / ({' * '.join(['n_h'] * dim)}))"
        lift = {
            a: f"(CASE WHEN dist > 0e0 THEN d{a} / ((dist + {num(EPS)}) * (n_h + {num(EPS)})) ELSE 0e0 END)"
            for a in AXES[:dim]
        }
    return scale, {a: f"({scale} * kq * {lift[a]})" for a in AXES[:dim]}


def interpolate(
    edges: DataFrame,
    fields: list[list[str]],
    kernel_name: str,
    dim: int,
    mode: str = "field",
    structure: str = "isotropic",
) -> DataFrame:
    """Fields, gradients, divergences or curls at the queries of ``edges``.

    The edges carry the neighbours' weight, density, smoothing (n_w, n_rho and n_h
    or n_s?? and n_det) and the fields' components (``n_<component>``). ``fields``
    lists each field's components. Result columns: ``<component>`` for a field,
    ``<component>_d<axis>`` for a gradient, ``div_<k>``, and ``curl_<k>`` or
    ``curl_<k>_<axis>``; a curl is f x grad W, its sign as such sums have it.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: expected one of {', '.join(MODES)}")
    if structure not in ("isotropic", "covariant"):
        raise ValueError("interpolation needs an isotropic or covariant structure")
    if mode in ("divergence", "curl"):
        for f in fields:
            if len(f) != dim:
                raise ValueError(f"{mode} needs fields of {dim} components, not {len(f)}")
    if mode == "curl" and dim == 1:
        raise NotImplementedError("a curl needs two or three dimensions")
    kernel = get_kernel(kernel_name, dim)
    if structure == "covariant":
        rows = edges.withColumn("q", F.sqrt(F.greatest(F.lit(0.0), F.expr(quadratic_form(dim, "n_s", "n_det")))))
    else:
        rows = edges.withColumn("q", F.expr(f"dist / (n_h + {num(EPS)})"))
    scale, gradient = _gradient(kernel, dim, structure)
    rows = rows.withColumn("share", F.expr(f"n_w / (n_rho + {num(DENSITY_EPS)})"))
    axes = AXES[:dim]
    sums: dict[str, str] = {}
    if mode == "field":
        rows = rows.withColumn("kq", F.expr(kernel.value("q", dim)))
        sums = {c: f"share * n_{c} * kq * {scale}" for f in fields for c in f}
    else:
        rows = rows.withColumn("kq", F.expr(kernel.slope("q", dim)))
        rows = rows.withColumns({f"g{a}": F.expr(gradient[a]) for a in axes})
        if mode == "gradient":
            sums = {f"{c}_d{a}": f"share * n_{c} * g{a}" for f in fields for c in f for a in axes}
        elif mode == "divergence":
            for k, f in enumerate(fields):
                parts = " + ".join(f"n_{c} * g{a}" for c, a in zip(f, axes, strict=True))
                sums[f"div_{k}"] = f"share * ({parts})"
        else:
            for k, f in enumerate(fields):
                if dim == 2:
                    sums[f"curl_{k}"] = f"share * (n_{f[0]} * gy - n_{f[1]} * gx)"
                    continue
                for j, a in enumerate(axes):
                    b, c = (j + 1) % 3, (j + 2) % 3
                    sums[f"curl_{k}_{a}"] = f"share * (n_{f[b]} * g{axes[c]} - n_{f[c]} * g{axes[b]})"
    return rows.groupBy("qid").agg(*[F.sum(F.expr(text)).alias(name) for name, text in sums.items()])
