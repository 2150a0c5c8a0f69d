"""Every registered point-cloud query with its SQL.

Values are rounded to six decimals on both sides, because sums of doubles depend
on the order of rows; scales keep them near one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.cloud import ParticleFrame
from pointweave.functions.geometry import AXES, STENCILS
from pointweave.functions.kernels import (
    RADIAL,
    SEPARABLE,
    erf_precise,
    get_kernel,
    get_kernel_shapes_1d,
    separable_sigma,
    total_integral_separable,
    total_integral_spherical,
)
from pointweave.functions.tensors import eigenvalues_2d, entries, project_2d
from pointweave.functions.text import num
from pointweave.operators import knn as neighbours
from pointweave.plans import oracle
from pointweave.plans.clouds import cloud, cloud_sql
from pointweave.sources import grids

Query = Callable[[SparkSession, str], DataFrame]

#: Neighbours asked for, and cells per axis by dimension.
K = 16
CELLS = {1: [64], 2: [24, 16], 3: [8, 6, 10]}


def _rounded(df: DataFrame, keys: list[str], digits: int = 6, scale: float = 1.0) -> DataFrame:
    def plain(c: str):
        value = F.round(F.col(c) / scale if scale != 1.0 else F.col(c), digits)
        return F.when(value == 0, F.lit(0.0)).otherwise(value).alias(c)  # no negative zero

    return df.select(*keys, *[plain(c) for c in df.columns if c not in keys])


def _frame(spark, sf_dir, name: str, dim: int, box: float | None = 1.0) -> ParticleFrame:
    df = cloud(spark, sf_dir, name)
    if "id" not in df.columns:
        df = df.withColumn("id", F.lit(None).cast("long"))  # deposits need no identity
    return ParticleFrame.of(df.drop(*AXES[dim:]), AXES[:dim], weights="w", boxsize=box)


@lru_cache(maxsize=1)
def _entries() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}

    def add(name: str, query: Query, sql: str | None = None) -> None:
        out[name] = (query, sql)

    # -- fixed deposits --------------------------------------------------------
    for scheme in STENCILS:
        for dim in (1, 2, 3):
            for periodic in (True, False):

                def fixed(spark, sf_dir, scheme=scheme, dim=dim, periodic=periodic):
                    frame = _frame(spark, sf_dir, "L", dim, 1.0 if periodic else None)
                    extent = None if periodic else [(0.0, 1.0)] * dim
                    found = frame.deposit("tax", gridnums=CELLS[dim], kernel_name=scheme, extent=extent, return_weights=True)
                    return _rounded(found, [f"i{a}" for a in AXES[:dim]])

                add(
                    f"deposit_{scheme}_{dim}d_{'periodic' if periodic else 'open'}",
                    fixed,
                    oracle.fixed_deposit("L", dim, scheme, CELLS[dim], periodic, {"f0": "tax"}),
                )

    def mixed(spark, sf_dir):
        frame = _frame(spark, sf_dir, "L", 2)
        found = frame.deposit(["tax", "disc", "qty"], [True, False, True], CELLS[2], kernel_name="tsc", return_weights=True)
        return _rounded(found, ["ix", "iy"])

    three = {"f0": "tax", "f1": "disc", "f2": "qty"}
    add("deposit_averaged_mixed", mixed, oracle.fixed_deposit("L", 2, "tsc", CELLS[2], True, three, [True, False, True]))

    def multi(spark, sf_dir):
        frame = _frame(spark, sf_dir, "L", 3).add_fields("pair", ["tax", "disc"])
        found = frame.deposit(["pair", "qty"], [False, True], CELLS[3], kernel_name="cic", return_weights=True)
        return _rounded(found, ["ix", "iy", "iz"])

    add("deposit_multi_field", multi, oracle.fixed_deposit("L", 3, "cic", CELLS[3], True, three, [False, False, True]))

    def weights(spark, sf_dir):
        frame = _frame(spark, sf_dir, "L", 2)
        return _rounded(frame.deposit("weights", gridnums=16, kernel_name="pcs", return_weights=True), ["ix", "iy"])

    add("deposit_weights", weights, oracle.fixed_deposit("L", 2, "pcs", [16, 16], True, {"f0": "w"}))

    bounds = [(0.25, 0.75), (0.1, 0.6)]

    def extent(spark, sf_dir):
        frame = _frame(spark, sf_dir, "L", 2)
        found = frame.deposit("tax", gridnums=CELLS[2], kernel_name="cic", extent=bounds, return_weights=True)
        return _rounded(found, ["ix", "iy"])

    inside = "WHERE x BETWEEN 0.25e0 AND 0.75e0 AND y BETWEEN 0.1e0 AND 0.6e0"
    add(
        "deposit_extent",
        extent,
        oracle.fixed_deposit("L", 2, "cic", CELLS[2], False, {"f0": "tax"}, box=[0.5, 0.5], where=inside, shift=[0.25, 0.1]),
    )
    for label, plane in (("xy", [0, 1]), ("zy", [2, 1])):

        def flat(spark, sf_dir, plane=plane):
            frame = _frame(spark, sf_dir, "L", 3)
            found = frame.deposit("tax", gridnums=CELLS[2], kernel_name="cic", plane_projection=plane, return_weights=True)
            return _rounded(found, ["ix", "iy"])

        axes = tuple(AXES[p] for p in plane)
        add(f"deposit_plane_{label}", flat, oracle.fixed_deposit("L", 2, "cic", CELLS[2], True, {"f0": "tax"}, axes=axes))

    def dense(spark, sf_dir):
        frame = _frame(spark, sf_dir, "P", 2)
        found = frame.deposit("weights", gridnums=[40, 40], kernel_name="ngp", return_weights=True, dense=True)
        return _rounded(found, ["ix", "iy"])

    add(
        "deposit_dense",
        dense,
        "WITH g AS (" + oracle.fixed_deposit("P", 2, "ngp", [40, 40], True, {"f0": "w"}) + "), c AS (SELECT CAST(a AS INTEGER) AS ix, "
        "CAST(b AS INTEGER) AS iy FROM range(40) t(a), range(40) u(b)) SELECT ix, iy, coalesce(f0, 0e0) AS f0, "
        "coalesce(w, 0e0) AS w FROM c LEFT JOIN g USING (ix, iy)",
    )

    def clipped(spark, sf_dir):
        frame = _frame(spark, sf_dir, "V", 2, None)
        found = frame.deposit("s", gridnums=[12, 12], kernel_name="cic", extent=[(0.3, 0.7)] * 2, clip=True, return_weights=True)
        total = found.agg(F.sum("w").alias("w"), F.sum("f0").alias("f0"))
        return total.select(F.round("w", 6).alias("w"), F.round("f0", 6).alias("f0"))

    add(
        "deposit_cic_clip_total",
        clipped,
        f"SELECT round(sum(w), 6) AS w, round(sum(w * s), 6) AS f0 FROM ({cloud_sql('V')}) "
        "WHERE x BETWEEN 0.3e0 AND 0.7e0 AND y BETWEEN 0.3e0 AND 0.7e0",
    )

    # -- adaptive deposits -----------------------------------------------------
    def adaptive(kernel, structure, dim, grid, rule="midpoint", eta=4.0, plane=None):
        def run(spark, sf_dir):
            source = 3 if plane else dim
            smooth = "covariant" if structure == "covariant" else "isotropic"
            frame = _frame(spark, sf_dir, "V", source).compute_smoothing(num_neighbors=K, structure=smooth)
            found = frame.deposit(
                "s", gridnums=grid, adaptive=True, kernel_name=kernel, structure=structure, integration_method=rule,
                eta_crit=eta, plane_projection=plane, return_weights=True,
            )
            return _rounded(found, [f"i{a}" for a in AXES[:dim]])

        return run

    for kernel in SEPARABLE:
        for dim in (1, 2, 3):
            add(
                f"deposit_sep_{kernel}_{dim}d",
                adaptive(kernel, "separable", dim, CELLS[dim]),
                oracle.separable_deposit("V", dim, K, kernel, CELLS[dim]),
            )
    for kernel in RADIAL:
        add(
            f"deposit_iso_{kernel}_2d",
            adaptive(kernel, "isotropic", 2, [16, 16]),
            oracle.radial_deposit("V", 2, K, kernel, "isotropic", "midpoint", 4.0, [16, 16]),
        )
        add(
            f"deposit_iso_{kernel}_3d",
            adaptive(kernel, "isotropic", 3, [6, 6, 6]),
            oracle.radial_deposit("V", 3, K, kernel, "isotropic", "midpoint", 4.0, [6, 6, 6]),
        )
    for rule in ("midpoint", "trapezoidal", "simpson"):
        add(
            f"deposit_iso_{rule}",
            adaptive("cubic_spline", "isotropic", 2, [48, 48], rule, 1.0),
            oracle.radial_deposit("V", 2, K, "cubic_spline", "isotropic", rule, 1.0, [48, 48]),
        )
    for eta in (1, 4, 10):
        add(
            f"deposit_iso_eta_{eta}",
            adaptive("lucy", "isotropic", 2, [32, 32], "midpoint", float(eta)),
            oracle.radial_deposit("V", 2, K, "lucy", "isotropic", "midpoint", float(eta), [32, 32]),
        )
    add(
        "deposit_iso_1d",
        adaptive("wendland_c2", "isotropic", 1, [64]),
        oracle.radial_deposit("V", 1, K, "wendland_c2", "isotropic", "midpoint", 4.0, [64]),
    )
    add(
        "deposit_cov_2d",
        adaptive("cubic_spline", "covariant", 2, [64, 64], "midpoint", 0.0),
        oracle.radial_deposit("V", 2, K, "cubic_spline", "covariant", "midpoint", 0.0, [64, 64]),
    )
    for dim, grid, eta in ((2, [16, 16], 4.0), (3, [6, 6, 6], 2.0)):
        add(
            "deposit_cov_sampled_2d" if dim == 2 else "deposit_cov_3d",
            adaptive("cubic_spline", "covariant", dim, grid, "midpoint", eta),
            oracle.radial_deposit("V", dim, K, "cubic_spline", "covariant", "midpoint", eta, grid),
        )
    for structure, grid, eta, plane in (("covariant", [32, 32], 2.0, (0, 1)), ("isotropic", [16, 16], 4.0, (0, 2))):
        add(
            f"deposit_{structure[:3]}_plane",
            adaptive("cubic_spline", structure, 2, grid, "midpoint", eta, list(plane)),
            oracle.radial_deposit("V", 2, K, "cubic_spline", structure, "midpoint", eta, grid, plane),
        )
    for rule in ("trapezoidal", "simpson"):
        add(
            f"deposit_iso_{rule}_3d",
            adaptive("cubic_spline", "isotropic", 3, [12, 12, 12], rule, 1.0),
            oracle.radial_deposit("V", 3, K, "cubic_spline", "isotropic", rule, 1.0, [12, 12, 12]),
        )

    def given(structure, dim, grid, lengths):
        def run(spark, sf_dir):
            frame = _frame(spark, sf_dir, "V", dim)
            own = frame.df.select("id", F.expr(lengths).alias("hxx" if structure == "covariant" else "h"))
            kind = "smoothing_tensors" if structure == "covariant" else "smoothing_lengths"
            frame = frame.set_smoothing(structure, **{kind: own})
            found = frame.deposit(
                "s", gridnums=grid, adaptive=True, kernel_name="cubic_spline", structure=structure, return_weights=True
            )
            return _rounded(found, [f"i{a}" for a in AXES[:dim]])

        return run

    # lengths above half the box are cut to it; on one axis a tensor is a length
    for name, structure, dim, grid, lengths in (
        ("deposit_iso_clamped", "isotropic", 2, [16, 16], "0.4e0 + 0.3e0 * x"),
        ("deposit_cov_1d", "covariant", 1, [64], "0.01e0 + 0.1e0 * x"),
    ):
        add(
            name,
            given(structure, dim, grid, lengths),
            oracle.radial_deposit("V", dim, K, "cubic_spline", "isotropic", "midpoint", 4.0, grid, lengths=lengths),
        )

    part = [(0.3, 0.7), (0.35, 0.65)]

    def open_domain(structure):
        def run(spark, sf_dir):
            frame = _frame(spark, sf_dir, "V", 2, None).compute_smoothing(num_neighbors=K, structure=structure)
            found = frame.deposit(
                "s", gridnums=[24, 20], extent=part, adaptive=True, kernel_name="lucy", structure=structure, return_weights=True
            )
            return _rounded(found, ["ix", "iy"])

        return run

    for structure in ("isotropic", "covariant"):
        add(
            f"deposit_{structure[:3]}_open",
            open_domain(structure),
            oracle.radial_deposit("V", 2, K, "lucy", structure, "midpoint", 4.0, [24, 20], extent=part, periodic=False),
        )

    def single(spark, sf_dir):
        df = cloud(spark, sf_dir, "L").withColumn("id", F.lit(None).cast("long"))
        frame = ParticleFrame.of(df.drop("z"), ["x", "y"], weights="w", boxsize=1.0, precision="float32")
        return _rounded(frame.deposit("tax", gridnums=CELLS[2], kernel_name="cic", return_weights=True), ["ix", "iy"])

    add("deposit_cic_float32", single, oracle.fixed_deposit("L32", 2, "cic", CELLS[2], True, {"f0": "tax"}))

    # -- neighbours --------------------------------------------------------------
    def edges(name, dim, k, periodic, queries=None, cells=False):
        def run(spark, sf_dir):
            points = cloud(spark, sf_dir, name)
            asked = points.withColumnRenamed("id", "qid") if queries is None else queries(spark, sf_dir)
            found = neighbours.nearest(points, asked, k, dim, (1.0,) * dim if periodic else None, None, 0 if cells else None)
            return found.select("qid", "nid", "rank", F.round("dist", 6).alias("dist"))

        return run

    for dim in (1, 2, 3):
        add(f"knn_{dim}d", edges("V", dim, K, False), oracle.knn("V", dim, K, False))
        if dim > 1:
            add(f"knn_periodic_{dim}d", edges("V", dim, K, True), oracle.knn("V", dim, K, True))
    # joins of cells: more points than are broadcast, or none broadcast
    add("knn_orders_2d", edges("O", 2, 8, False), oracle.knn_of_many("O", 2, 8))
    add("knn_clustered_2d", edges("K", 2, 8, False), oracle.knn_of_many("K", 2, 8))
    for dim in (1, 2, 3):
        add(f"knn_cells_periodic_{dim}d", edges("V", dim, K, True, None, True), oracle.knn("V", dim, K, True))
    add("knn_cells_ties", edges("P", 2, 8, False, None, True), oracle.knn("P", 2, 8, False))
    add("knn_ties", edges("P", 2, 8, False), oracle.knn("P", 2, 8, False))

    def asked_grid(spark, sf_dir):
        return grids.create_grid_2d(spark, [12, 10], 1.0).select("qid", "x", "y")

    grid_sql = (
        "SELECT CAST(a * 10 + b AS BIGINT) AS qid, (a + 0.5e0) * " + num(1 / 12) + " AS x, (b + 0.5e0) * " + num(1 / 10)
        + " AS y FROM range(12) t(a), range(10) u(b)"
    )
    add("knn_query_points", edges("V", 2, K, True, asked_grid), oracle.knn("V", 2, K, True, grid_sql))

    # -- smoothing and density ---------------------------------------------------
    for dim in (1, 2, 3):

        def lengths(spark, sf_dir, dim=dim):
            frame = _frame(spark, sf_dir, "V", dim).compute_smoothing(num_neighbors=K, structure="isotropic")
            return _rounded(frame.lengths, ["id"])

        add(f"hsml_{dim}d", lengths, oracle.smoothing("V", dim, K, True, "isotropic"))
    for dim in (2, 3):

        def tensors(spark, sf_dir, dim=dim):
            frame = _frame(spark, sf_dir, "V", dim).compute_smoothing(num_neighbors=K, structure="covariant")
            cells = [F.round(f"s{e}", 8).alias(f"s{e}") for e in entries(dim)]
            if dim == 2:
                low, high = eigenvalues_2d()
                cells.append(F.expr(f"round(sqrt(greatest({low}, 0e0)), 6)").alias("l0"))
                cells.append(F.expr(f"round(sqrt({high}), 6)").alias("l1"))
            return frame.tensors.select("id", *cells)

        add(f"hmat_{dim}d", tensors, oracle.smoothing("V", dim, K, True, "covariant"))

        def system(spark, sf_dir, dim=dim):
            frame = _frame(spark, sf_dir, "V", dim).compute_smoothing(num_neighbors=K, structure="covariant")
            return _rounded(frame.smoothing_tensors(), ["id"])

        add(f"hmat_eigensystem_{dim}d", system, oracle.eigensystem("V", dim, K))

    def rho(kernel, structure, dim):
        def run(spark, sf_dir):
            frame = _frame(spark, sf_dir, "V", dim).compute_smoothing(num_neighbors=K, structure=structure)
            return _rounded(frame.compute_density(kernel, structure).density(structure), ["id"], scale=1000.0)

        return run

    for kernel in RADIAL:
        add(f"density_iso_{kernel}", rho(kernel, "isotropic", 2), oracle.density("V", 2, K, True, kernel, "isotropic"))
    add("density_iso_3d", rho("lucy", "isotropic", 3), oracle.density("V", 3, K, True, "lucy", "isotropic"))
    add("density_iso_1d", rho("lucy", "isotropic", 1), oracle.density("V", 1, K, True, "lucy", "isotropic"))
    for dim in (2, 3):
        add(
            f"density_cov_{dim}d",
            rho("wendland_c2", "covariant", dim),
            oracle.density("V", dim, K, True, "wendland_c2", "covariant"),
        )

    # -- interpolation -------------------------------------------------------------
    def interp(mode, structure, dim, fields, scale, queries=None, kernel="wendland_c2"):
        def run(spark, sf_dir):
            frame = _frame(spark, sf_dir, "V", dim)
            if fields != ["s"]:
                frame = frame.add_fields("v", [f"v{a}" for a in AXES[:dim]])
            frame = frame.compute_smoothing(num_neighbors=K, structure=structure).compute_density(kernel, structure)
            asked = queries(spark, sf_dir) if queries else None
            found = frame.interpolate(fields, asked, mode, structure)
            found = found.select(*[F.col(c).alias(_plain(c)) for c in found.columns])
            return _rounded(found, ["qid"], scale=scale)

        return run

    def _plain(column: str) -> str:
        # components of the vector field are called v_0, ...: name them as the table does
        for j, a in enumerate(AXES):
            if column == f"v_{j}" or column.startswith(f"v_{j}_"):
                return f"v{a}" + column[3:]
        return column

    for structure, short in (("isotropic", "iso"), ("covariant", "cov")):
        for dim in (2, 3):
            vector = [f"v{a}" for a in AXES[:dim]]
            for mode, fields, columns, scale in (
                ("field", ["s", "v"], [["s"], vector], 1.0),
                ("gradient", ["s"], [["s"]], 100.0),
                ("divergence", ["v"], [vector], 100.0),
                ("curl", ["v"], [vector], 100.0),
            ):
                add(
                    f"interp_{mode}_{short}_{dim}d",
                    interp(mode, structure, dim, fields, scale),
                    oracle.interpolate("V", dim, K, True, "wendland_c2", structure, mode, columns, scale),
                )
    add(
        "interp_query_grid",
        interp("field", "isotropic", 2, ["s"], 1.0, asked_grid),
        oracle.interpolate("V", 2, K, True, "wendland_c2", "isotropic", "field", [["s"]], 1.0, grid_sql),
    )
    add(
        "interp_1d",
        interp("gradient", "isotropic", 1, ["s"], 100.0, kernel="quintic_spline"),
        oracle.interpolate("V", 1, K, True, "quintic_spline", "isotropic", "gradient", [["s"]], 100.0),
    )

    # -- kernels and helpers -------------------------------------------------------
    for name, structure in [(k, "isotropic") for k in RADIAL] + [(k, "separable") for k in SEPARABLE]:

        def shape(spark, sf_dir, name=name, structure=structure):
            found = get_kernel_shapes_1d(spark, name, structure)
            return found.select("i", F.round("q", 6).alias("x"), F.round("value", 9).alias("value"))

        published = oracle.Published(name)
        add(
            f"kernel_shape_{name}" if structure == "isotropic" else f"kernel_shape_separable_{name}",
            shape,
            f"SELECT i, round(x, 6) AS x, round({num(published.sigma(1))} * ({published.value('abs(x)', 1)}), 9) AS value FROM "
            f"(SELECT CAST(i AS INTEGER) AS i, -({num(published.support)}) + CAST(i AS DOUBLE) * "
            f"{num(2.0 * published.support / 100)} AS x FROM range(100) t(i))",
        )
    def erf_values(spark, sf_dir):
        rows = spark.range(161).selectExpr("CAST(id AS INT) AS i", "(CAST(id AS DOUBLE) - 80e0) / 20e0 AS x")
        return _rounded(rows.select("i", F.expr(erf_precise("x")).alias("value")), ["i"], 9)

    steps = 2000  # of Simpson's rule between 0 and x
    add(
        "erf_precise",
        erf_values,
        f"SELECT CAST(i AS INTEGER) AS i, CASE WHEN i = 80 THEN 0e0 ELSE round(sum(c * exp(-((x * j / {steps}) ** 2))) * any_value(x) "
        f"/ {3 * steps} * 2 / sqrt(pi()), 9) END AS value FROM (SELECT i, (i - 80) / 20e0 AS x FROM range(161) t(i)), "
        f"(SELECT j, CASE WHEN j IN (0, {steps}) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END AS c FROM range({steps + 1}) u(j)) GROUP BY i",
    )
    for name in RADIAL:
        kernel = get_kernel(name)

        def integral(spark, sf_dir, name=name):
            rows = [(d, float(total_integral_spherical(name, d, 4.0))) for d in (1, 2, 3)]
            return _rounded(spark.createDataFrame(rows, "dim int, total double"), ["dim"])

        ends = ", ".join(
            f"({d}, {num(kernel.sigma(d))} * {f} * ({kernel.area(num(kernel.support), d)}))"
            for d, f in ((1, "2e0"), (2, "2e0 * pi()"), (3, "4e0 * pi()"))
        )
        add(
            f"kernel_integral_{name}",
            integral,
            f"SELECT CAST(d AS INTEGER) AS dim, round(t, 6) AS total FROM (VALUES {ends}) v(d, t)",
        )

    def separable(spark, sf_dir):
        rows = [(k, d, float(total_integral_separable(k, d))) for k in SEPARABLE for d in (1, 2, 3)]
        return _rounded(spark.createDataFrame(rows, "kernel string, dim int, total double"), ["kernel", "dim"])

    ends = ", ".join(
        f"('{k}', {d}, {num(separable_sigma(get_kernel(k), d))} * "
        + " * ".join([f"(2e0 * ({get_kernel(k).area(num(get_kernel(k).support), 1)}))"] * d)
        + ")"
        for k in SEPARABLE
        for d in (1, 2, 3)
    )
    add(
        "kernel_integral_separable",
        separable,
        f"SELECT k AS kernel, CAST(d AS INTEGER) AS dim, round(t, 6) AS total FROM (VALUES {ends}) v(k, d, t)",
    )
    counts = {1: [50], 2: [8, 5], 3: [4, 3, 5]}
    sides = {1: [2.0], 2: [2.0, 3.0], 3: [1.0, 2.0, 3.0]}
    for dim in (1, 2, 3):

        def grid(spark, sf_dir, dim=dim):
            found = grids.create_grid(spark, counts[dim], sides[dim], dim)
            return _rounded(found, ["qid", *[f"i{a}" for a in AXES[:dim]]])

        ids = "0"
        for n, a in zip(counts[dim], AXES, strict=False):
            ids = f"({ids}) * {n} + j{a}"
        add(
            f"grid_{dim}d",
            grid,
            f"SELECT CAST({ids} AS BIGINT) AS qid, "
            + ", ".join(f"CAST(j{a} AS INTEGER) AS i{a}" for a in AXES[:dim])
            + ", "
            + ", ".join(
                f"round((j{a} + 0.5e0) * {num(length / n)}, 6) AS {a}"
                for a, n, length in zip(AXES, counts[dim], sides[dim], strict=False)
            )
            + " FROM "
            + ", ".join(f"range({n}) t{a}(j{a})" for a, n in zip(AXES, counts[dim], strict=False)),
        )
    for edge in (True, False):

        def lines(spark, sf_dir, edge=edge):
            return _rounded(grids.grid_lines_frame(spark, (0.0, 2.0, -1.0, 1.0), 8, 5, edge), ["orientation", "line"])

        take = "" if edge else "WHERE i > 0 AND i < n"
        first = "0" if edge else "1"
        add(
            "grid_lines" if edge else "grid_lines_interior",
            lines,
            f"SELECT o AS orientation, CAST(i - {first} AS INTEGER) AS line, round(lo + 2e0 * i / n, 6) AS position FROM "
            f"(SELECT 'v' AS o, 8 AS n, 0e0 AS lo, unnest(range(0, 9)) AS i UNION ALL SELECT 'h', 5, -1e0, unnest(range(0, 6))) {take}",
        )

    def shifted(spark, sf_dir):
        found = grids.shift_coordinates(cloud(spark, sf_dir, "V").select("id", "x", "y", "z"), 3)
        return _rounded(found, ["id"])

    add(
        "shift_coordinates",
        shifted,
        f"SELECT id, round(x - (SELECT min(x) FROM p), 6) AS x, round(y - (SELECT min(y) FROM p), 6) AS y, "
        f"round(z - (SELECT min(z) FROM p), 6) AS z FROM p".replace("FROM p", f"FROM ({cloud_sql('V')})"),
    )

    def projected(spark, sf_dir):
        frame = _frame(spark, sf_dir, "V", 3).compute_smoothing(num_neighbors=K, structure="covariant")
        found = project_2d(frame.tensors, (0, 1)).select("id", "hxx", "hxy", "hyy", "l0", "l1")
        return _rounded(found, ["id"])

    add("project_2d", projected, oracle.projected("V", K, (0, 1)))

    def edited(spark, sf_dir):
        frame = _frame(spark, sf_dir, "V", 2).add_fields("twice", F.col("s") * 2).add_fields("pair", ["s", "w"])
        frame = frame.delete_fields(["twice", "absent"])
        return _rounded(frame.df.select("id", "pair_0", "pair_1", "w"), ["id"])

    add(
        "fields_edit",
        edited,
        f"SELECT id, round(s, 6) AS pair_0, round(w, 6) AS pair_1, round(w, 6) AS w FROM ({cloud_sql('V')})",
    )
    return out


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql is not None}
