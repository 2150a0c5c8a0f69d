"""Deposits of particles onto regular grids: explode to cells, then sum by cell.

Every deposit is scan, filter, project, generator, partial sums, one exchange on
the cell, final sums. Grids are sparse: a row for each cell that got something.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.geometry import AXES, STENCILS, ceil_int, floor_int, quadrature, wrapped
from pointweave.functions.kernels import axis_integral, get_kernel, separable_sigma
from pointweave.functions.samples import sample_table
from pointweave.functions.tensors import entries, with_eigensystem
from pointweave.functions.text import num, total

#: Added to a cell's weight before a sum is divided by it.
MEAN_EPS = 1e-10
STRUCTURES = ("separable", "isotropic", "covariant")
#: Grids of up to so many cells are summed by the last axis's base cell first.
FOLDED_CELLS = 1 << 24


def _sum_cells(rows: DataFrame, dim: int, fields: list[str], averaged: list[bool]) -> DataFrame:
    """rows: i?, share (w times the cell's part) and fields; one aggregate by cell."""
    sums = [F.sum("share").alias("w")]
    sums += [F.sum(F.col(f) * F.col("share")).alias(f"f{k}") for k, f in enumerate(fields)]
    return _means(rows.groupBy(*[f"i{a}" for a in AXES[:dim]]).agg(*sums), averaged)


def _means(cells: DataFrame, averaged: list[bool]) -> DataFrame:
    for k, mean in enumerate(averaged):
        if mean:
            cells = cells.withColumn(f"f{k}", F.expr(f"f{k} / (w + {num(MEAN_EPS)})"))
    return cells


def _inside(rows: DataFrame, axes, grid, periodic: bool) -> DataFrame:
    for a, n in zip(axes, grid, strict=True):
        if periodic:
            rows = rows.withColumn(f"i{a}", F.expr(wrapped(f"i{a}", n)))
        else:
            rows = rows.filter((F.col(f"i{a}") >= 0) & (F.col(f"i{a}") < n))
    return rows


def deposit_fixed(
    particles: DataFrame,
    fields: list[str],
    averaged: list[bool],
    grid: tuple[int, ...],
    box: tuple[float, ...],
    scheme: str,
    periodic: bool,
    clip: bool = False,
) -> DataFrame:
    """ngp, cic, tsc, pcs or pqs weights, the product over axes.

    Cells outside an open box are dropped with their weight; ``clip`` moves a cic
    particle inside instead, which keeps it. Per axis the cell and its weight come
    from one small array, so weights are computed once before the axes multiply.
    On grids of up to FOLDED_CELLS cells particles are not spread along the last axis:
    the sums for its offsets are taken by base cell, and these few rows are spread.
    """
    if scheme not in STENCILS:
        raise ValueError(f"unknown stencil {scheme!r}: expected one of {', '.join(STENCILS)}")
    dim = len(grid)
    axes = AXES[:dim]
    base, weights = STENCILS[scheme]
    folded = math.prod(grid) <= FOLDED_CELLS
    rows = particles
    for a, n, length in zip(axes, grid, box, strict=True):
        rows = rows.withColumn("_s", F.expr(f"{a} * {num(n / length)}"))
        if clip and scheme == "cic" and not periodic:
            rows = rows.withColumn("_s", F.expr(f"least(greatest(_s - 0.5e0, 0e0), {num(n - 1 - 1e-6)}) + 0.5e0"))
        rows = rows.withColumn("_b", F.expr(f"CAST({base.format(s='_s')} AS INT)"))
        rows = rows.withColumn("_d", F.expr("_s - 0.5e0 - _b"))
        if folded and a == axes[-1]:
            rows = rows.withColumns({f"_w{k}": F.expr(w.format(d="_d")) for k, w in enumerate(weights.values())})
            rows = rows.withColumnRenamed("_b", "_last").drop("_s", "_d")
            continue
        cells = ", ".join(f"named_struct('i', _b + ({o}), 'w', {w.format(d='_d')})" for o, w in weights.items())
        rows = rows.withColumn(f"_c{a}", F.expr(f"array({cells})")).drop("_s", "_b", "_d")
    spread = axes[:-1] if folded else axes
    for a, n in zip(spread, grid, strict=False):
        # the outer form: of any other one the optimizer makes a filter that computes all weights once more
        rows = rows.withColumn(f"_c{a}", F.explode_outer(f"_c{a}"))
        rows = rows.withColumns({f"i{a}": F.col(f"_c{a}.i"), f"_w{a}": F.col(f"_c{a}.w")}).drop(f"_c{a}")
        rows = _inside(rows, [a], [n], periodic)
    share = F.expr(" * ".join(["w", *[f"_w{a}" for a in spread]]))
    rows = rows.withColumn("share", share)
    if not folded:
        return _sum_cells(rows, dim, fields, averaged)
    # sums for each offset of the last axis, by its base cell; then its cells from few rows
    count = len(weights)
    sums = [F.sum(F.col("share") * F.col(f"_w{k}")).alias(f"w_{k}") for k in range(count)]
    for j, f in enumerate(fields):
        sums += [F.sum(F.col(f) * F.col("share") * F.col(f"_w{k}")).alias(f"f{j}_{k}") for k in range(count)]
    base = rows.groupBy(*[f"i{a}" for a in spread], "_last").agg(*sums)
    names = ["w", *[f"f{j}" for j in range(len(fields))]]
    cells = ", ".join(
        f"named_struct('i', _last + ({o}), " + ", ".join(f"'{c}', {c}_{k}" for c in names) + ")" for k, o in enumerate(weights)
    )
    last = f"i{axes[-1]}"
    cells = base.select(*[f"i{a}" for a in spread], F.explode_outer(F.expr(f"array({cells})")).alias("_c"))
    cells = cells.select(*[f"i{a}" for a in spread], F.col("_c.i").alias(last), *[F.col(f"_c.{c}").alias(c) for c in names])
    cells = _inside(cells, [axes[-1]], [grid[-1]], periodic)
    return _means(cells.groupBy(*[f"i{a}" for a in axes]).agg(*[F.sum(c).alias(c) for c in names]), averaged)


def _support_limit(box: tuple[float, ...], support: float) -> float:
    """The largest smoothing that doesn't reach around a periodic box."""
    return min(length / 2.0 for length in box) / support


def _deposit_separable(rows, fields, averaged, grid, box, kernel, periodic):
    """Exact cell integrals of the product kernel; h holds for every axis."""
    dim = len(grid)
    axes = AXES[:dim]
    if periodic:
        rows = rows.withColumn("h", F.least("h", F.lit(_support_limit(box, kernel.support))))
    for a, n, length in zip(axes, grid, box, strict=True):
        rows = rows.withColumns({"_x": F.expr(f"{a} * {num(n / length)}"), "_h": F.expr(f"h * {num(n / length)}")})
        low, high = floor_int(f"_x - {num(kernel.support)} * _h"), ceil_int(f"_x + {num(kernel.support)} * _h") + " - 1"
        if not periodic:
            low, high = f"greatest({low}, 0)", f"least({high}, {n - 1})"
        rows = rows.withColumns({"_lo": F.expr(low), "_hi": F.expr(high)}).filter("_lo <= _hi")
        rows = rows.withColumn(f"i{a}", F.explode_outer(F.expr("sequence(_lo, _hi)")))
        limit = num(kernel.support)
        rows = rows.withColumns(
            {
                "_q0": F.expr(f"greatest((i{a} - _x) / _h, -({limit}))"),
                "_q1": F.expr(f"least((i{a} + 1 - _x) / _h, {limit})"),
            }
        )
        rows = rows.withColumn(f"_w{a}", F.expr(axis_integral(kernel, "_q0", "_q1")))
        rows = rows.drop("_x", "_h", "_lo", "_hi", "_q0", "_q1")
    parts = ["w", num(separable_sigma(kernel, dim)), *[f"_w{a}" for a in axes]]
    rows = rows.withColumn("share", F.expr(" * ".join(parts)))
    return _sum_cells(_inside(rows, axes, grid, periodic), dim, fields, averaged)


def _sampled(rows, grid, box, kernel, periodic, eta_crit, offset):
    """Particles below the grid's resolution: each sample's mass goes to its cell.

    The sample table is a literal of the plan; its size follows from eta_crit (samples.py), not from data.
    """
    dim = len(grid)
    axes = AXES[:dim]
    names = [*[f"c{k}" for k in range(dim)], "mass"]
    columns = [", ".join(num(row[k]) for row in sample_table(kernel, dim, eta_crit)) for k in range(dim + 1)]
    table = ", ".join(f"array({values})" for values in columns)
    rows = rows.withColumn("_sample", F.explode_outer(F.expr(f"arrays_zip({table})")))
    rows = rows.withColumns({c: F.col("_sample").getField(str(k)) for k, c in enumerate(names)}).drop("_sample")
    cells = {
        f"i{a}": F.expr(floor_int(f"({a} + {offset[a]}) * {num(n / length)}"))
        for a, n, length in zip(axes, grid, box, strict=True)
    }
    rows = rows.withColumns(cells).withColumn("share", F.expr("w * mass"))
    return _inside(rows, axes, grid, periodic)


def _integrated(rows, grid, box, kernel, periodic, rule, reach, q):
    """Particles that span cells: quadrature over each cell, scaled to the particle's whole weight.

    ``reach`` gives the support along an axis; ``q`` the kernel's argument for
    separations dx, dy, dz. Cells, their total and the scaling stay in one row.
    """
    dim = len(grid)
    axes = AXES[:dim]
    limits = {}
    for a, n, length in zip(axes, grid, box, strict=True):
        x, r = f"{a} * {num(n / length)}", f"({reach[a]}) * {num(n / length)}"
        low, high = floor_int(f"{x} - {r}"), ceil_int(f"{x} + {r}")
        if not periodic:
            low, high = f"greatest({low}, 0)", f"least({high}, {n - 1})"
        limits |= {f"_lo{a}": F.expr(low), f"_hi{a}": F.expr(high)}
    rows = rows.withColumns(limits).filter(" AND ".join(f"_lo{a} <= _hi{a}" for a in axes))
    points = ", ".join(
        "named_struct(" + ", ".join(f"'o{a}', {num(p)}" for a, p in zip(axes, point, strict=True)) + f", 'c', {num(c)})"
        for point, c in quadrature(rule, dim)
    )
    # a one-element transform binds a name to a value that is used more than once
    separation = ", ".join(
        f"'d{a}', {a} - (j{a} + p.o{a}) * {num(length / n)}" for a, n, length in zip(axes, grid, box, strict=True)
    )
    text = f"transform(array(named_struct({separation})), s -> {q})[0]"
    value = f"transform(array({text}), q -> {kernel.value('q', dim)})[0]"
    mass = f"aggregate(array({points}), 0e0, (m, p) -> m + p.c * {value})"
    cell = ", ".join(f"'i{a}', j{a}" for a in axes)
    cells = f"named_struct({cell}, 'm', {mass})"
    for a in reversed(axes):
        cells = f"transform(sequence(_lo{a}, _hi{a}), j{a} -> {cells})"
    for _ in range(dim - 1):
        cells = f"flatten({cells})"
    rows = rows.withColumn("_cells", F.expr(cells)).drop(*limits)
    rows = rows.withColumn("_total", F.expr("aggregate(_cells, 0e0, (m, c) -> m + c.m)"))
    # an inner explode, or a filter on _total alone, would be pushed down and compute all cells once more
    rows = rows.withColumn("_cell", F.explode_outer("_cells")).drop("_cells")
    rows = rows.filter("CASE WHEN _total > 0e0 THEN _cell.m <> 0e0 ELSE false END")
    rows = rows.withColumns({f"i{a}": F.col(f"_cell.i{a}") for a in axes})
    rows = rows.withColumn("share", F.expr("w * _cell.m / _total"))
    return _inside(rows, axes, grid, periodic)


def _deposit_radial(rows, fields, averaged, grid, box, kernel, periodic, structure, rule, eta_crit):
    dim = len(grid)
    axes = AXES[:dim]
    inverse_cells = {a: num(n / length) for a, n, length in zip(axes, grid, box, strict=True)}
    k = num(kernel.support)
    if dim == 1 and structure == "covariant":
        # one axis: H is a length
        rows, structure = rows.withColumn("h", F.sqrt("sxx")), "isotropic"
    if structure == "isotropic":
        if periodic:
            rows = rows.withColumn("h", F.least("h", F.lit(_support_limit(box, kernel.support))))
        reach = {a: f"{k} * h" for a in axes}
        offset = {a: f"c{j} * h" for j, a in enumerate(axes)}
        q = f"sqrt({' + '.join(f's.d{a} * s.d{a}' for a in axes)}) / h"
        flat = "false"
    else:
        limit = _support_limit(box, kernel.support) if periodic else None
        rows = with_eigensystem(rows, dim, limit)
        reach = {a: f"{k} * r{a}" for a in axes}
        offset = {a: "(" + total([f"v{a}{j} * l{j} * c{j}" for j in range(dim)]) + ")" for a in axes}
        form = total([("" if e[0] == e[1] else "2e0 * ") + f"g{e} * s.d{e[0]} * s.d{e[1]}" for e in entries(dim)])
        q = f"sqrt(greatest(0e0, {form}))"
        flat = f"least({', '.join(f'l{j}' for j in range(dim))}) <= 0e0"
    widths = [f"({reach[a]}) * {inverse_cells[a]}" for a in axes]
    rows = rows.withColumn("_eta", F.expr(f"2e0 * {widths[0] if dim == 1 else 'least(' + ', '.join(widths) + ')'}"))
    rows = rows.withColumn("_small", F.expr(f"_eta < {num(eta_crit)} OR {flat}"))
    keep = [*[f"i{a}" for a in axes], "share", *dict.fromkeys(fields)]
    small = _sampled(rows.filter("_small"), grid, box, kernel, periodic, eta_crit, offset).select(*keep)
    large = _integrated(rows.filter("NOT _small"), grid, box, kernel, periodic, rule, reach, q).select(*keep)
    return _sum_cells(small.unionByName(large), dim, fields, averaged)


def deposit_adaptive(
    particles: DataFrame,
    fields: list[str],
    averaged: list[bool],
    grid: tuple[int, ...],
    box: tuple[float, ...],
    kernel_name: str,
    structure: str,
    periodic: bool,
    integration_method: str = "midpoint",
    eta_crit: float = 4.0,
) -> DataFrame:
    """Each particle spread over its own kernel.

    ``particles`` has w, the coordinates, fields and ``h``, or for the covariant
    structure the entries of S (``sxx``, ...), or with ``projected`` a ready
    eigensystem (``l?``, ``v??``). The separable structure is exact. The others
    sample particles whose diameter is under ``eta_crit`` cells and integrate the
    rest by ``integration_method``, keeping each one's weight.
    """
    if structure not in STRUCTURES:
        raise ValueError(f"unknown structure {structure!r}: expected one of {', '.join(STRUCTURES)}")
    kernel = get_kernel(kernel_name, len(grid), structure)
    if structure == "separable":
        return _deposit_separable(particles, fields, averaged, grid, box, kernel, periodic)
    quadrature(integration_method, len(grid))
    return _deposit_radial(
        particles, fields, averaged, grid, box, kernel, periodic, structure, integration_method, eta_crit
    )


def densify(cells: DataFrame, grid: tuple[int, ...], fields: int) -> DataFrame:
    """All cells of the grid, those without particles holding 0."""
    from pointweave.sources.grids import create_grid

    axes = [f"i{a}" for a in AXES[: len(grid)]]
    every = create_grid(cells.sparkSession, grid, 1.0, len(grid)).select(*axes)
    out = every.join(cells, axes, "left")
    return out.fillna(0.0, subset=["w", *[f"f{k}" for k in range(fields)]])


