"""DuckDB SQL for the catalogue: brute-force plans of the same quantities."""

from __future__ import annotations

import math

from pointweave.functions.geometry import AXES, difference, quadrature
from pointweave.functions.kernels import erf, get_kernel
from pointweave.functions.samples import sample_table
from pointweave.functions.tensors import adjugate, determinant, eigenvalues_2d, entries, entry
from pointweave.functions.text import num, total
from pointweave.plans.clouds import cloud_sql

EPS = "1e-7"

#: Per scheme the cell that offsets count from, the offsets, and the weight at
#: distance {x} from a cell's centre, as published.
SCHEMES: dict[str, tuple[str, range, str]] = {
    "ngp": ("floor({s})", range(1), "1e0"),
    "cic": ("floor({s} - 0.5e0)", range(2), "greatest(0e0, 1e0 - {x})"),
    "tsc": ("floor({s})", range(-1, 2), "CASE WHEN {x} <= 0.5e0 THEN 0.75e0 - {x} ** 2 ELSE 0.5e0 * (1.5e0 - {x}) ** 2 END"),
    "pcs": (
        "floor({s} - 0.5e0)",
        range(-1, 3),
        "CASE WHEN {x} <= 1e0 THEN (4e0 - 6e0 * {x} ** 2 + 3e0 * {x} ** 3) / 6e0 ELSE (2e0 - {x}) ** 3 / 6e0 END",
    ),
    "pqs": (
        "floor({s} - 0.5e0)",
        range(-2, 4),
        "((3e0 - {x}) ** 5 - 6e0 * greatest(0e0, 2e0 - {x}) ** 5 + 15e0 * greatest(0e0, 1e0 - {x}) ** 5) / 120e0",
    ),
}

#: Kernels as published. Support; value and slope at {q} in one dimension and in more; the
#: factors that normalise them in one, two and three dimensions.
_C2 = ("(1e0 - 0.5e0 * {q}) ** 3 * (1e0 + 1.5e0 * {q})", "-3e0 * {q} * (1e0 - 0.5e0 * {q}) ** 2")
_C2_SPACE = ("(1e0 - 0.5e0 * {q}) ** 4 * (1e0 + 2e0 * {q})", "-5e0 * {q} * (1e0 - 0.5e0 * {q}) ** 3")
_C4 = (
    "(1e0 - 0.5e0 * {q}) ** 5 * (1e0 + 2.5e0 * {q} + 2e0 * {q} ** 2)",
    "-3.5e0 * {q} * (1e0 - 0.5e0 * {q}) ** 4 * (1e0 + 2e0 * {q})",
)
_C4_SPACE = (
    "(1e0 - 0.5e0 * {q}) ** 6 * (1e0 + 3e0 * {q} + 35e0 / 12e0 * {q} ** 2)",
    "-14e0 / 3e0 * {q} * (1e0 - 0.5e0 * {q}) ** 5 * (1e0 + 2.5e0 * {q})",
)
_C6 = (
    "(1e0 - 0.5e0 * {q}) ** 7 * (1e0 + 3.5e0 * {q} + 4.75e0 * {q} ** 2 + 2.625e0 * {q} ** 3)",
    "-1.5e0 * {q} * (1e0 - 0.5e0 * {q}) ** 6 * (3e0 + 9e0 * {q} + 8.75e0 * {q} ** 2)",
)
_C6_SPACE = (
    "(1e0 - 0.5e0 * {q}) ** 8 * (1e0 + 4e0 * {q} + 6.25e0 * {q} ** 2 + 4e0 * {q} ** 3)",
    "-5.5e0 * {q} * (1e0 - 0.5e0 * {q}) ** 7 * (1e0 + 3.5e0 * {q} + 4e0 * {q} ** 2)",
)
_CUBIC = (
    "CASE WHEN {q} <= 0.5e0 THEN 1e0 - 6e0 * {q} ** 2 + 6e0 * {q} ** 3 ELSE 2e0 * (1e0 - {q}) ** 3 END",
    "CASE WHEN {q} <= 0.5e0 THEN -12e0 * {q} + 18e0 * {q} ** 2 ELSE -6e0 * (1e0 - {q}) ** 2 END",
)
_QUINTIC = (
    "(3e0 - {q}) ** 5 - 6e0 * greatest(0e0, 2e0 - {q}) ** 5 + 15e0 * greatest(0e0, 1e0 - {q}) ** 5",
    "-5e0 * (3e0 - {q}) ** 4 + 30e0 * greatest(0e0, 2e0 - {q}) ** 4 - 75e0 * greatest(0e0, 1e0 - {q}) ** 4",
)
_LUCY = ("(1e0 + 3e0 * {q}) * (1e0 - {q}) ** 3", "-12e0 * {q} * (1e0 - {q}) ** 2")
_GAUSS = ("exp(-({q} ** 2))", "-2e0 * {q} * exp(-({q} ** 2))")
_TENT = ("1e0 - {q} / 1.5e0", "-1e0 / 1.5e0")
_FLAT = ("1e0", "0e0")
_PI = math.pi
KERNELS: dict[str, tuple[float, tuple[str, str], tuple[str, str], tuple[float, float, float]]] = {
    "tophat": (0.5, _FLAT, _FLAT, (1.0, 4 / _PI, 6 / _PI)),
    "tsc": (1.5, _TENT, _TENT, (2 / 3, 4 / (3 * _PI), 8 / (9 * _PI))),
    "gaussian": (3.0, _GAUSS, _GAUSS, (_PI**-0.5, 1 / _PI, _PI**-1.5)),
    "lucy": (1.0, _LUCY, _LUCY, (5 / 4, 5 / _PI, 105 / (16 * _PI))),
    "cubic_spline": (1.0, _CUBIC, _CUBIC, (4 / 3, 40 / (7 * _PI), 8 / _PI)),
    "quintic_spline": (3.0, _QUINTIC, _QUINTIC, (1 / 120, 7 / (478 * _PI), 1 / (120 * _PI))),
    "wendland_c2": (2.0, _C2, _C2_SPACE, (5 / 8, 7 / (4 * _PI), 21 / (16 * _PI))),
    "wendland_c4": (2.0, _C4, _C4_SPACE, (3 / 4, 9 / (4 * _PI), 495 / (256 * _PI))),
    "wendland_c6": (2.0, _C6, _C6_SPACE, (55 / 64, 39 / (14 * _PI), 1365 / (512 * _PI))),
}


class Published:
    """A kernel of the table above as SQL text."""

    def __init__(self, name: str):
        self.support, self._line, self._space, self._sigma = KERNELS[name]
        self.name = name

    def sigma(self, dim: int) -> float:
        return self._sigma[dim - 1]

    def _inside(self, text: str, q: str) -> str:
        sign = "<=" if self.name == "tophat" else "<"
        return f"CASE WHEN {q} {sign} {num(self.support)} THEN {text.format(q=f'({q})')} ELSE 0e0 END"

    def value(self, q: str, dim: int) -> str:
        return self._inside((self._line if dim == 1 else self._space)[0], q)

    def slope(self, q: str, dim: int) -> str:
        return self._inside((self._line if dim == 1 else self._space)[1], q)

    def along(self, q: str) -> str:
        """The integral from 0 to q >= 0 of the separable kernels, in one dimension."""
        if self.name == "tophat":
            return f"({q})"
        if self.name == "tsc":
            return f"(({q}) - ({q}) ** 2 / 3e0)"
        return f"({num(math.sqrt(_PI) / 2)} * {erf(f'({q})')})"


def _between(kernel: Published, low: str, high: str) -> str:
    """The integral between two bounds of any sign within the support."""
    one = lambda x: f"(CASE WHEN {x} < 0e0 THEN -{kernel.along(f'(-({x}))')} ELSE {kernel.along(x)} END)"
    return f"({one(high)} - {one(low)})"


def _index(x: str) -> str:
    return f"CAST(floor({x}) AS INTEGER)"


def _pmod(i: str, n: int) -> str:
    return f"((({i}) % {n} + {n}) % {n})"


def _rounded(value: str) -> str:
    """To six decimals, without a negative zero."""
    return f"CASE WHEN round({value}, 6) = 0 THEN 0e0 ELSE round({value}, 6) END"


def _finish(body: str, dim: int, values: dict[str, str], averaged: list[bool], weights: bool) -> str:
    """Group shares by cell; ``body`` has i?, share and the fields f?."""
    cells = ", ".join(f"i{a}" for a in AXES[:dim])
    sums = [f"sum({f} * share) AS {f}" for f in values]
    out = [f"{f} / (w + 1e-10)" if mean else f for f, mean in zip(values, averaged, strict=True)]
    picked = [f"{_rounded(t)} AS {f}" for t, f in zip(out, values, strict=True)]
    picked += [f"{_rounded('w')} AS w"] if weights else []
    return (
        f"SELECT {cells}, {', '.join(picked)} FROM (SELECT {cells}, sum(share) AS w"
        f"{''.join(', ' + s for s in sums)} FROM ({body}) GROUP BY {cells})"
    )


def fixed_deposit(
    name: str, dim: int, scheme: str, grid: list[int], periodic: bool, fields: dict[str, str],
    averaged: list[bool] | None = None, box: list[float] | None = None, weights: bool = True,
    axes: tuple[str, ...] | None = None, where: str = "", shift: list[float] | None = None,
) -> str:
    """Each offset of each axis is a row of a VALUES list; weights follow from the distance."""
    base, table, weight = SCHEMES[scheme]
    box = box or [1.0] * dim
    axes = axes or AXES[:dim]
    shift = shift or [0.0] * dim
    pos = ", ".join(
        f"({source} - {num(s)}) * {num(n / length)} AS s{a}"
        for a, source, n, length, s in zip(AXES, axes, grid, box, shift, strict=False)
    )
    values = ", ".join(f"{text} AS {f}" for f, text in fields.items())
    inner = f"SELECT w, {pos}, {values} FROM ({cloud_sql(name)}) {where}"
    bases = ", ".join(f"CAST({base.format(s=f's{a}')} AS INTEGER) AS base_{a}" for a in AXES[:dim])
    inner = f"SELECT *, {bases} FROM ({inner})"
    ds = ", ".join(f"s{a} - 0.5e0 - base_{a} AS d{a}" for a in AXES[:dim])
    inner = f"SELECT *, {ds} FROM ({inner})"
    lists = ", ".join(f"(VALUES {', '.join(f'({o})' for o in table)}) t{a}(o{a})" for a in AXES[:dim])
    parts = []
    for a in AXES[:dim]:
        parts.append(f"({weight.format(x=f'abs(o{a} - d{a})')})")
    cells = ", ".join(
        f"{_pmod(f'base_{a} + o{a}', n) if periodic else f'base_{a} + o{a}'} AS i{a}" for a, n in zip(AXES, grid, strict=False)
    )
    body = f"SELECT {cells}, w * {' * '.join(parts)} AS share, {', '.join(fields)} FROM ({inner}) p, {lists}"
    if not periodic:
        inside = " AND ".join(f"i{a} BETWEEN 0 AND {n - 1}" for a, n in zip(AXES, grid, strict=False))
        body = f"SELECT * FROM ({body}) WHERE {inside}"
    return _finish(body, dim, fields, averaged or [False] * len(fields), weights)


def edges_cte(name: str, dim: int, k: int, periodic: bool, queries: str | None = None, box: float = 1.0) -> str:
    """CTEs p (points) and e (edges with separations, distance and rank)."""
    ds = [difference(f"q.{a}", f"n.{a}", box if periodic else None) for a in AXES[:dim]]
    asked = queries or "SELECT id AS qid, * FROM p"
    return (
        f"p AS ({cloud_sql(name)}), asked AS ({asked}), pairs AS (SELECT q.qid, n.id AS nid, "
        + ", ".join(f"{d} AS d{a}" for d, a in zip(ds, AXES, strict=False))
        + " FROM asked q, p n), measured AS (SELECT *, "
        + " + ".join(f"d{a} * d{a}" for a in AXES[:dim])
        + " AS d2 FROM pairs), e AS (SELECT *, sqrt(d2) AS dist FROM (SELECT *, CAST(row_number() OVER "
        + f"(PARTITION BY qid ORDER BY d2, nid) AS INTEGER) AS rank FROM measured) WHERE rank <= {k})"
    )


def knn_of_many(name: str, dim: int, k: int) -> str:
    """The same for clouds whose pairs are too many to sort: each query keeps its k least (distance, id)."""
    d2 = " + ".join(f"(q.{a} - n.{a}) * (q.{a} - n.{a})" for a in AXES[:dim])
    return (
        f"WITH p AS ({cloud_sql(name)}), best AS (SELECT q.id AS qid, min({{'d2': {d2}, 'nid': n.id}}, {k}) AS near "
        f"FROM p q, p n GROUP BY q.id) SELECT qid, near[i].nid AS nid, CAST(i AS INTEGER) AS rank, "
        f"round(sqrt(near[i].d2), 6) AS dist FROM best, range(1, {k + 1}) t(i)"
    )


def knn(name: str, dim: int, k: int, periodic: bool, queries: str | None = None) -> str:
    return f"WITH {edges_cte(name, dim, k, periodic, queries)} SELECT qid, nid, rank, round(dist, 6) AS dist FROM e"


def lengths_cte() -> str:
    return "h AS (SELECT qid AS id, max(dist) AS h FROM e GROUP BY qid)"


def tensors_cte(dim: int) -> str:
    sums = ", ".join(f"sum(n.w * d{e[0]} * d{e[1]}) AS m{e}" for e in entries(dim))
    trace = " + ".join(f"m{a}{a} / mw" for a in AXES[:dim])
    cells = ", ".join(
        f"m{e} / mw" + (f" + {EPS} * ({trace})" if e[0] == e[1] else "") + f" AS s{e}" for e in entries(dim)
    )
    return (
        f"m AS (SELECT qid AS id, sum(n.w) AS mw, {sums} FROM e JOIN p n ON n.id = e.nid GROUP BY qid), "
        f"t0 AS (SELECT id, {cells} FROM m), t AS (SELECT *, {determinant(dim)} AS det FROM t0)"
    )


def _form(dim: int, alias: str) -> str:
    cofactors = adjugate(dim, f"{alias}.s")
    parts = [("" if e[0] == e[1] else "2e0 * ") + f"{cofactors[e]} * e.d{e[0]} * e.d{e[1]}" for e in entries(dim)]
    return f"sqrt(greatest(0e0, ({' + '.join(parts)}) / {alias}.det))"


def density_cte(kernel_name: str, dim: int, structure: str) -> str:
    kernel = Published(kernel_name)
    sigma = num(kernel.sigma(dim))
    if structure == "covariant":
        q, own, scale = _form(dim, "g"), "t", f"{sigma} / sqrt(g.det)"
    else:
        q, own, scale = f"e.dist / (g.h + {EPS})", "h", f"{sigma} / ({' * '.join(['g.h'] * dim)})"
    return (
        f"dq AS (SELECT e.qid, n.w, {q} AS q, {scale} AS scale FROM e JOIN p n ON n.id = e.nid JOIN {own} g ON g.id = e.qid), "
        f"r AS (SELECT qid AS id, sum(w * ({kernel.value('q', dim)}) * scale) AS rho FROM dq GROUP BY qid)"
    )


def smoothing(name: str, dim: int, k: int, periodic: bool, structure: str) -> str:
    head = f"WITH {edges_cte(name, dim, k, periodic)}, "
    if structure == "isotropic":
        return head + lengths_cte() + " SELECT id, round(h, 6) AS h FROM h"
    cells = ", ".join(f"round({c}, 8) AS {c}" for c in [f"s{e}" for e in entries(dim)])
    extra = ""
    if dim == 2:
        low, high = eigenvalues_2d()
        extra = f", round(sqrt(greatest({low}, 0e0)), 6) AS l0, round(sqrt({high}), 6) AS l1"
    return head + tensors_cte(dim) + f" SELECT id, {cells}{extra} FROM t"


def density(name: str, dim: int, k: int, periodic: bool, kernel: str, structure: str) -> str:
    own = tensors_cte(dim) if structure == "covariant" else lengths_cte()
    return (
        f"WITH {edges_cte(name, dim, k, periodic)}, {own}, {density_cte(kernel, dim, structure)} "
        "SELECT id, round(rho / 1000e0, 6) AS rho FROM r"
    )


def interpolate(
    name: str, dim: int, k: int, periodic: bool, kernel_name: str, structure: str, mode: str,
    fields: list[list[str]], scale: float, queries: str | None = None,
) -> str:
    kernel = Published(kernel_name)
    sigma = num(kernel.sigma(dim))
    own = tensors_cte(dim) if structure == "covariant" else lengths_cte()
    head = f"WITH {edges_cte(name, dim, k, periodic)}, {own}, {density_cte(kernel_name, dim, structure)}"
    e = "e"
    if queries:
        more = edges_cte(name, dim, k, periodic, queries).split(", asked AS ", 1)[1]
        more = more.replace("asked q", "asked2 q").replace("FROM pairs", "FROM pairs2").replace("pairs AS (", "pairs2 AS (")
        more = more.replace("measured AS (", "measured2 AS (").replace("FROM measured", "FROM measured2").replace("e AS (SELECT *, sqrt", "e2 AS (SELECT *, sqrt")
        head += ", asked2 AS " + more
        e = "e2"
    g = "t" if structure == "covariant" else "h"
    axes = AXES[:dim]
    if structure == "covariant":
        q = _form(dim, "g")
        cofactors = adjugate(dim, "s")
        lift = {a: "((" + " + ".join(f"{cofactors[entry(a, b)]} * d{b}" for b in axes) + f") / det / (q + {EPS}))" for a in axes}
        size = f"({sigma} / sqrt(det))"
    else:
        q = f"e.dist / (g.h + {EPS})"
        lift = {a: f"(CASE WHEN dist > 0e0 THEN d{a} / ((dist + {EPS}) * (h + {EPS})) ELSE 0e0 END)" for a in axes}
        size = f"({sigma} / ({' * '.join(['h'] * dim)}))"
    components = [c for f in fields for c in f]
    ds = ", ".join(f"e.d{a}" for a in axes)
    own_columns = ", ".join(f"g.{c}" for c in ([f"s{x}" for x in entries(dim)] + ["det"] if structure == "covariant" else ["h"]))
    values = ", ".join(f"n.{c}" for c in components)
    head += (
        f", iq AS (SELECT e.qid, e.dist, {ds}, {own_columns}, {values}, n.w / (r.rho + 1e-8) AS share, {q} AS q "
        f"FROM {e} e JOIN p n ON n.id = e.nid JOIN r ON r.id = e.nid JOIN {g} g ON g.id = e.nid)"
    )
    sums: dict[str, str] = {}
    if mode == "field":
        head += f", iw AS (SELECT *, ({kernel.value('q', dim)}) AS kq FROM iq)"
        sums = {c: f"share * {c} * kq * {size}" for c in components}
    else:
        gradients = ", ".join(f"{size} * kq * {lift[a]} AS g{a}" for a in axes)
        head += f", ik AS (SELECT *, ({kernel.slope('q', dim)}) AS kq FROM iq), iw AS (SELECT *, {gradients} FROM ik)"
        if mode == "gradient":
            sums = {f"{c}_d{a}": f"share * {c} * g{a}" for c in components for a in axes}
        elif mode == "divergence":
            sums = {f"div_{j}": "share * (" + " + ".join(f"{c} * g{a}" for c, a in zip(f, axes, strict=True)) + ")" for j, f in enumerate(fields)}
        elif dim == 2:
            sums = {f"curl_{j}": f"share * ({f[0]} * gy - {f[1]} * gx)" for j, f in enumerate(fields)}
        else:
            for j, f in enumerate(fields):
                sums[f"curl_{j}_x"] = f"share * ({f[1]} * gz - {f[2]} * gy)"
                sums[f"curl_{j}_y"] = f"share * ({f[2]} * gx - {f[0]} * gz)"
                sums[f"curl_{j}_z"] = f"share * ({f[0]} * gy - {f[1]} * gx)"
    totals = ", ".join(f"sum({t}) / {num(scale)} AS {c}" for c, t in sums.items())
    out = ", ".join(f"{_rounded(c)} AS {c}" for c in sums)
    return f"{head} SELECT qid, {out} FROM (SELECT qid, {totals} FROM iw GROUP BY qid)"


def separable_deposit(name: str, dim: int, k: int, kernel_name: str, grid: list[int]) -> str:
    """h from the neighbours in the unit box; one row per covered cell of each axis."""
    kernel = Published(kernel_name)
    support = num(kernel.support)
    limit = num(0.5 / kernel.support)
    head = f"WITH {edges_cte(name, dim, k, True)}, {lengths_cte()}, b AS (SELECT p.*, least(h.h, {limit}) AS h FROM p JOIN h USING (id))"
    last = "b"
    for a, n in zip(AXES, grid, strict=False):
        x, r = f"{a} * {num(n)}", f"{support} * (h * {num(n)})"
        head += (
            f", c{a} AS (SELECT *, unnest(range(CAST(floor({x} - {r}) AS BIGINT), CAST(ceil({x} + {r}) AS BIGINT))) AS j{a} FROM {last})"
            f", d{a} AS (SELECT *, greatest((j{a} - {x}) / (h * {num(n)}), -({support})) AS lo{a}, "
            f"least((j{a} + 1 - {x}) / (h * {num(n)}), {support}) AS hi{a} FROM c{a})"
        )
        last = f"d{a}"
    share = " * ".join(["w", num(kernel.sigma(1) ** dim), *[_between(kernel, f"lo{a}", f"hi{a}") for a in AXES[:dim]]])
    cells = ", ".join(f"CAST({_pmod(f'j{a}', n)} AS INTEGER) AS i{a}" for a, n in zip(AXES, grid, strict=False))
    return f"{head} " + _finish(f"SELECT {cells}, {share} AS share, s AS f0 FROM {last}", dim, {"f0": "s"}, [False], True)


def eigen_ctes(dim: int, source: str, name: str) -> str:
    """CTE ``name``: ``source`` (id, s??) with roots of eigenvalues l? ascending and unit vectors v??.

    Eigenvalues are in closed form. The projector on an eigenvector is the product of
    (S - l_j) / (l_i - l_j) over the others; its column of largest diagonal, over that
    diagonal's root, is the vector whose largest component is positive.
    """
    axes = AXES[:dim]
    if dim == 2:
        root = "sqrt(0.25e0 * (sxx - syy) * (sxx - syy) + sxy * sxy)"
        values = f", {name}_1 AS (SELECT *, 0.5e0 * (sxx + syy) - {root} AS e0, 0.5e0 * (sxx + syy) + {root} AS e1 FROM {source})"
    else:
        mean = "((sxx + syy + szz) / 3e0)"
        square = f"((sxx - {mean}) ** 2 + (syy - {mean}) ** 2 + (szz - {mean}) ** 2 + 2e0 * (sxy ** 2 + sxz ** 2 + syz ** 2))"
        turned = (
            "((sxx - q) * ((syy - q) * (szz - q) - syz * syz) - sxy * (sxy * (szz - q) - syz * sxz)"
            " + sxz * (sxy * syz - (syy - q) * sxz)) / (2e0 * p * p * p)"
        )
        values = (
            f", {name}_a AS (SELECT *, {mean} AS q, sqrt({square} / 6e0) AS p FROM {source})"
            f", {name}_b AS (SELECT *, acos(greatest(-1e0, least(1e0, {turned}))) / 3e0 AS turn FROM {name}_a)"
            f", {name}_1 AS (SELECT * EXCLUDE (q, p, turn), q + 2e0 * p * cos(turn + 2e0 * pi() / 3e0) AS e0, "
            "3e0 * q - (q + 2e0 * p * cos(turn + 2e0 * pi() / 3e0)) - (q + 2e0 * p * cos(turn)) AS e1, "
            f"q + 2e0 * p * cos(turn) AS e2 FROM {name}_b)"
        )

    def cell(a: str, b: str, j: int) -> str:
        return f"(s{entry(a, b)} - e{j})" if a == b else f"s{entry(a, b)}"

    def projector(i: int, a: str, b: str) -> str:
        j, *more = [x for x in range(dim) if x != i]
        if not more:
            return f"({cell(a, b, j)} / (e{i} - e{j}))"
        k = more[0]
        product = " + ".join(f"{cell(a, c, j)} * {cell(c, b, k)}" for c in axes)
        return f"(({product}) / ((e{i} - e{j}) * (e{i} - e{k})))"

    cells = ", ".join(f"{projector(i, a, b)} AS p{i}{a}{b}" for i in range(dim) for a in axes for b in axes)
    vectors = []
    for i in range(dim):
        top = f"greatest({', '.join(f'p{i}{a}{a}' for a in axes)})"
        for a in axes:
            cases = " ".join(f"WHEN p{i}{b}{b} = {top} THEN p{i}{a}{b} / sqrt(p{i}{b}{b})" for b in axes)
            vectors.append(f"CASE {cases} END AS v{a}{i}")
    # the quotient of Rayleigh: its error is the square of the vector's
    refined = []
    for i in range(dim):
        form = " + ".join(("" if a == b else "2e0 * ") + f"s{a}{b} * v{a}{i} * v{b}{i}" for a, b in entries(dim))
        length = " + ".join(f"v{a}{i} * v{a}{i}" for a in axes)
        refined.append(f"sqrt(greatest(0e0, ({form}) / ({length}))) AS l{i}")
    gone = ", ".join([*[f"e{i}" for i in range(dim)], *[f"p{i}{a}{b}" for i in range(dim) for a in axes for b in axes]])
    return (
        f"{values}, {name}_2 AS (SELECT *, {cells} FROM {name}_1)"
        f", {name}_3 AS (SELECT * EXCLUDE ({gone}), {', '.join(vectors)} FROM {name}_2)"
        f", {name} AS (SELECT *, {', '.join(refined)} FROM {name}_3)"
    )


def plane_ctes(plane: tuple[int, int]) -> str:
    """CTE t2: (id, sxx, sxy, syy) of H seen in a plane, (P H^-1 P^T)^-1, from t in three dimensions; h?? too."""
    a, b = (AXES[p] for p in plane)
    inverse = lambda c, d: " + ".join(f"v{c}{j} * v{d}{j} / l{j}" for j in range(3))
    return (
        eigen_ctes(3, "t", "w3")
        + f", flat AS (SELECT id, {inverse(a, a)} AS kxx, {inverse(a, b)} AS kxy, {inverse(b, b)} AS kyy FROM w3)"
        + ", turned AS (SELECT id, kyy / (kxx * kyy - kxy * kxy) AS hxx, -kxy / (kxx * kyy - kxy * kxy) AS hxy, "
        + "kxx / (kxx * kyy - kxy * kxy) AS hyy FROM flat)"
        + ", t2 AS (SELECT *, hxx * hxx + hxy * hxy AS sxx, hxy * (hxx + hyy) AS sxy, hxy * hxy + hyy * hyy AS syy FROM turned)"
    )


def projected(name: str, k: int, plane: tuple[int, int]) -> str:
    head = f"WITH {edges_cte(name, 3, k, True)}, {tensors_cte(3)}{plane_ctes(plane)}{eigen_ctes(2, 't2', 'w2')}"
    return f"{head} SELECT id, {', '.join(f'{_rounded(c)} AS {c}' for c in ('hxx', 'hxy', 'hyy', 'l0', 'l1'))} FROM w2"


def eigensystem(name: str, dim: int, k: int) -> str:
    """H with its eigenvalues and vectors."""
    head = f"WITH {edges_cte(name, dim, k, True)}, {tensors_cte(dim)}{eigen_ctes(dim, 't', 'e9')}"
    out = [f"{_rounded(' + '.join(f'v{e[0]}{j} * l{j} * v{e[1]}{j}' for j in range(dim)))} AS h{e}" for e in entries(dim)]
    out += [f"{_rounded(f'l{j}')} AS l{j}" for j in range(dim)]
    out += [f"{_rounded(f'v{a}{j}')} AS v{a}{j}" for j in range(dim) for a in AXES[:dim]]
    return f"{head} SELECT id, {', '.join(out)} FROM e9"


def radial_deposit(
    name: str, dim: int, k: int, kernel_name: str, structure: str, rule: str, eta: float, grid: list[int],
    plane: tuple[int, int] | None = None, extent: list[tuple[float, float]] | None = None,
    lengths: str | None = None, periodic: bool = True,
) -> str:
    """Samples for small particles, quadrature with a window total for the others.

    The box is periodic and of unit sides, or with ``extent`` open. ``plane`` takes two of three
    axes. ``lengths`` is the text of a smoothing length that stands for the neighbours'.
    """
    kernel = Published(kernel_name)
    axes = AXES[:dim]
    support, limit = num(kernel.support), num(0.5 / kernel.support)
    source = 3 if plane else dim
    low = [0.0 if extent is None else extent[j][0] for j in range(dim)]
    side = [1.0 if extent is None else extent[j][1] - extent[j][0] for j in range(dim)]
    moved = ", ".join(f"p.{AXES[(plane or range(dim))[j]]} - {num(low[j])} AS {a}" for j, a in enumerate(axes))
    inside = "" if extent is None else " WHERE " + " AND ".join(
        f"p.{a} BETWEEN {num(lo)} AND {num(hi)}" for a, (lo, hi) in zip(axes, extent, strict=True)
    )
    edges = edges_cte(name, source, k, periodic)
    if structure == "covariant":
        own = "t2" if plane else "t"
        head = f"WITH {edges}, {tensors_cte(source)}{plane_ctes(plane) if plane else ''}{eigen_ctes(dim, own, 'e8')}"
        top = f"l{dim - 1}"
        shrink = f"CASE WHEN {top} > {limit} THEN {limit} / {top} ELSE 1e0 END" if extent is None else "1e0"
        head += f", e9 AS (SELECT *, {shrink} AS f FROM e8)"
        cells = [f"s{e} * f * f AS s{e}" for e in entries(dim)] + [f"l{j} * f AS l{j}" for j in range(dim)]
        cells += [f"v{a}{j}" for j in range(dim) for a in axes]
        head += f", b1 AS (SELECT p.id, p.w, p.s, {moved}, {', '.join(cells)} FROM p JOIN e9 USING (id){inside})"
        head += f", b0 AS (SELECT *, {determinant(dim)} AS det FROM b1)"
        reach = {a: f"{support} * sqrt(s{a}{a})" for a in axes}
        cofactors = adjugate(dim)
        form = total([("" if e[0] == e[1] else "2e0 * ") + f"{cofactors[e]} * u{e[0]} * u{e[1]}" for e in entries(dim)])
        q = f"sqrt(greatest(0e0, ({form}) / det))"
        offset = {a: "(" + " + ".join(f"v{a}{j} * l{j} * c{j}" for j in range(dim)) + ")" for a in axes}
    else:
        own = f"least(h.h, {limit})" if extent is None else "h.h"
        head = f"WITH {edges}, "
        head += f"h AS (SELECT id, {lengths} AS h FROM p)" if lengths else lengths_cte()
        head += f", b0 AS (SELECT p.id, p.w, p.s, {moved}, {own} AS h FROM p JOIN h USING (id){inside})"
        reach = {a: f"{support} * h" for a in axes}
        q = f"sqrt({' + '.join(f'u{a} * u{a}' for a in axes)}) / h"
        offset = {a: f"c{j} * h" for j, a in enumerate(axes)}
    per = {a: n / length for a, n, length in zip(axes, grid, side, strict=True)}
    widths = [f"({reach[a]}) * {num(per[a])}" for a in axes]
    least = widths[0] if dim == 1 else f"least({', '.join(widths)})"
    head += f", b AS (SELECT *, 2e0 * {least} AS eta FROM b0)"
    keep = "" if extent is None else " WHERE " + " AND ".join(f"i{a} BETWEEN 0 AND {n - 1}" for a, n in zip(axes, grid, strict=True))
    wrap = (lambda i, n: _pmod(i, n)) if extent is None else (lambda i, n: i)
    table = sample_table(get_kernel(kernel_name), dim, eta) if eta > 0 else []
    parts = []
    if table:
        names = ", ".join([*[f"c{j}" for j in range(dim)], "mass"])
        head += f", samples({names}) AS (VALUES " + ", ".join("(" + ", ".join(map(num, row)) + ")" for row in table) + ")"
        cells = ", ".join(f"{wrap(_index(f'({a} + {offset[a]}) * {num(per[a])}'), n)} AS i{a}" for a, n in zip(axes, grid, strict=True))
        parts.append(f"SELECT * FROM (SELECT {cells}, w * mass AS share, s AS f0 FROM b, samples WHERE eta < {num(eta)}){keep}")
    last = f"(SELECT * FROM b WHERE NOT eta < {num(eta)})"
    for a, n in zip(axes, grid, strict=True):
        x, r = f"{a} * {num(per[a])}", f"({reach[a]}) * {num(per[a])}"
        first, after = f"CAST(floor({x} - {r}) AS BIGINT)", f"CAST(ceil({x} + {r}) AS BIGINT) + 1"
        if extent is not None:
            first, after = f"greatest({first}, 0)", f"least({after}, {n})"
        head += f", c{a} AS (SELECT *, unnest(range({first}, {after})) AS j{a} FROM {last})"
        last = f"c{a}"
    points = quadrature(rule, dim)
    sums = []
    for j, (point, c) in enumerate(points):
        us = ", ".join(f"{a} - (j{a} + {num(o)}) * {num(1 / per[a])} AS u{a}" for a, o in zip(axes, point, strict=True))
        head += f", u{j} AS (SELECT *, {us} FROM {last}), q{j} AS (SELECT * EXCLUDE ({', '.join('u' + a for a in axes)}), {q} AS q{j} FROM u{j})"
        last = f"q{j}"
        sums.append(f"{num(c)} * ({kernel.value(f'q{j}', dim)})")
    head += f", mass AS (SELECT *, {' + '.join(sums)} AS m FROM {last}), part AS (SELECT *, sum(m) OVER (PARTITION BY id) AS whole FROM mass)"
    cells = ", ".join(f"CAST({wrap(f'j{a}', n)} AS INTEGER) AS i{a}" for a, n in zip(axes, grid, strict=True))
    parts.append(f"SELECT {cells}, w * m / whole AS share, s AS f0 FROM part WHERE whole > 0 AND m <> 0e0")
    return f"{head} " + _finish(" UNION ALL ".join(parts), dim, {"f0": "s"}, [False], True)
