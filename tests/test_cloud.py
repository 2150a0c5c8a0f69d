import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointweave.cloud import ParticleFrame
from pointweave.operators import knn
from pointweave.sources import grids
from pointweave.streaming.deposit import streaming_deposit


def _points(spark, n=400, seed=3, dim=3):
    rng = np.random.default_rng(seed)
    data = {"id": np.arange(n)} | {a: rng.random(n) for a in "xyz"[:dim]} | {"w": rng.random(n) + 0.5, "s": rng.random(n)}
    pdf = pd.DataFrame(data)
    return spark.createDataFrame(pdf), pdf


def _brute(p, q, k, box=None):
    d = q[:, None, :] - p[None]
    if box is not None:
        d -= box * np.round(d / box)
    r = np.sqrt((d**2).sum(axis=2))
    order = np.lexsort((np.broadcast_to(np.arange(len(p)), r.shape), r), axis=1)[:, :k]
    return order, np.take_along_axis(r, order, axis=1)


@pytest.mark.parametrize("dim", [1, 2, 3])
@pytest.mark.parametrize("periodic", [True, False])
@pytest.mark.parametrize("bucketed", [True, False])
def test_neighbours(spark, monkeypatch, dim, periodic, bucketed):
    if bucketed:
        monkeypatch.setattr(knn, "BROADCAST_POINTS", 0)
    df, pdf = _points(spark, dim=dim)
    edges = knn.nearest(df, df.withColumnRenamed("id", "qid"), 6, dim, (1.0,) * dim if periodic else None).toPandas()
    p = pdf[list("xyz"[:dim])].to_numpy()
    ids, dist = _brute(p, p, 6, 1.0 if periodic else None)
    got = edges.sort_values(["qid", "rank"])
    assert len(got) == 400 * 6
    assert np.allclose(got.dist.to_numpy().reshape(400, 6), dist)
    assert (got.nid.to_numpy().reshape(400, 6) == ids).mean() > 0.999


@pytest.mark.parametrize("periodic", [True, False])
def test_neighbours_of_a_clustered_cloud(spark, monkeypatch, periodic):
    """Dense clumps, lone points and many points in one place, in a box longer than wide."""
    monkeypatch.setattr(knn, "BROADCAST_POINTS", 0)
    monkeypatch.setattr(knn, "CROWDED", 4)
    rng = np.random.default_rng(3)
    parts = [rng.normal((1.0, 0.05), 1e-4, (200, 2)), rng.uniform((0, 0), (8, 0.1), (60, 2)), np.full((80, 2), (5.0, 0.05))]
    p = np.clip(np.concatenate(parts), 0, (7.999, 0.0999))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1]}))
    box = (8.0, 0.1) if periodic else None
    edges = knn.nearest(df, df.withColumnRenamed("id", "qid"), 5, 2, box).toPandas().sort_values(["qid", "rank"])
    ids, dist = _brute(p, p, 5, np.array(box) if box else None)
    assert np.allclose(edges.dist.to_numpy().reshape(len(p), 5), dist)
    assert (edges.nid.to_numpy().reshape(len(p), 5) == ids).mean() > 0.999


def test_neighbours_far_queries(spark, monkeypatch):
    monkeypatch.setattr(knn, "BROADCAST_POINTS", 0)
    df, pdf = _points(spark, dim=2)
    q = pd.DataFrame({"qid": [0, 1], "x": [5.0, -3.0], "y": [0.5, 9.0]})
    edges = knn.nearest(df, spark.createDataFrame(q), 3, 2).toPandas().sort_values(["qid", "rank"])
    _, dist = _brute(pdf[["x", "y"]].to_numpy(), q[["x", "y"]].to_numpy(), 3)
    assert np.allclose(edges.dist.to_numpy().reshape(2, 3), dist)
    with pytest.raises(IndexError):
        knn.nearest(df, df.withColumnRenamed("id", "qid"), 401, 2)


@pytest.mark.parametrize("scheme", ["ngp", "cic", "tsc", "pcs", "pqs"])
def test_fixed_deposits_conserve_weight(spark, scheme):
    df, pdf = _points(spark)
    cloud = ParticleFrame.of(df, weights="w", boxsize=1.0)
    out = cloud.deposit("s", gridnums=[5, 4, 6], kernel_name=scheme, return_weights=True).toPandas()
    assert np.isclose(out.w.sum(), pdf.w.sum())
    assert np.isclose(out.f0.sum(), (pdf.w * pdf.s).sum())


@pytest.mark.parametrize("periodic", [True, False])
@pytest.mark.parametrize("dim", [1, 2, 3])
def test_folded_deposits_equal_the_others(spark, monkeypatch, dim, periodic):
    from pointweave.operators import deposit

    df, _ = _points(spark, dim=dim)
    cloud = ParticleFrame.of(df, "xyz"[:dim], weights="w", boxsize=1.0 if periodic else None)
    extent = None if periodic else [(0.0, 1.0)] * dim
    keys = [f"i{a}" for a in "xyz"[:dim]]
    found = []
    for cells in (deposit.FOLDED_CELLS, 0):
        monkeypatch.setattr(deposit, "FOLDED_CELLS", cells)
        out = cloud.deposit(["s", "weights"], [True, False], 5, extent, kernel_name="pcs", return_weights=True)
        found.append(out.toPandas().sort_values(keys).reset_index(drop=True))
    assert found[0][keys].equals(found[1][keys]) and np.allclose(found[0], found[1])


@pytest.mark.parametrize("structure", ["separable", "isotropic", "covariant"])
@pytest.mark.parametrize("dim", [2, 3])
def test_adaptive_deposits_conserve_weight(spark, structure, dim):
    df, pdf = _points(spark, n=120, dim=dim)
    cloud = ParticleFrame.of(df, "xyz"[:dim], weights="w", boxsize=1.0)
    smooth = "covariant" if structure == "covariant" else "isotropic"
    cloud = cloud.compute_smoothing(num_neighbors=6, structure=smooth)
    kernel = "tsc" if structure == "separable" else "cubic_spline"
    for eta in (4.0, 8.0):
        out = cloud.deposit(
            "s", gridnums=8, adaptive=True, kernel_name=kernel, structure=structure, eta_crit=eta, return_weights=True
        ).toPandas()
        assert np.isclose(out.w.sum(), pdf.w.sum(), rtol=1e-3)


def test_constant_field_and_gradient(spark):
    rng = np.random.default_rng(0)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "x": rng.random(n), "y": rng.random(n)})
    df = spark.createDataFrame(pdf).withColumn("c", F.lit(2.0)).withColumn("line", F.col("x") * 3)
    cloud = ParticleFrame.of(df, ["x", "y"], boxsize=1.0).global_setup("isotropic", "cubic_spline", 32)
    cloud = cloud.compute_smoothing().compute_density()
    rho = cloud.density().toPandas().rho
    assert 0.7 * n < rho.median() < 1.5 * n
    out = cloud.interpolate(["c"]).toPandas()
    assert abs(out.c.mean() - 2.0) < 0.3


def test_covariant_density_needs_no_eigenvectors(spark):
    df, pdf = _points(spark, n=150)
    cloud = ParticleFrame.of(df, weights="w", boxsize=1.0).compute_smoothing(num_neighbors=10, structure="covariant")
    got = cloud.compute_density("lucy", "covariant").density("covariant").toPandas().set_index("id").rho
    p, w = pdf[list("xyz")].to_numpy(), pdf.w.to_numpy()
    ids, _ = _brute(p, p, 10, 1.0)
    for i in range(0, 150, 29):
        d = p[i] - p[ids[i]]
        d -= np.round(d)
        s = np.einsum("k,ki,kj->ij", w[ids[i]], d, d) / w[ids[i]].sum()
        s += 1e-7 * np.trace(s) * np.eye(3)
        val, vec = np.linalg.eigh(s)
        q = np.linalg.norm(d @ vec / np.sqrt(val), axis=1)
        k = np.where(q <= 1, (1 + 3 * q) * (1 - q) ** 3, 0) * 105 / (16 * np.pi) / np.sqrt(val.prod())
        assert np.isclose(got[i], (w[ids[i]] * k).sum())


def test_error_surface(spark):
    df, _ = _points(spark, n=20)
    cloud = ParticleFrame.of(df, weights="w", boxsize=1.0)
    line = ParticleFrame.of(df, ["x"], boxsize=1.0)
    cases = [
        (AssertionError, lambda: ParticleFrame.of(df, [])),
        (AttributeError, lambda: cloud.compute_smoothing(structure="isotropic")),
        (AssertionError, lambda: cloud.compute_smoothing(num_neighbors=0, structure="isotropic")),
        (TypeError, lambda: cloud.global_setup(structure=3)),
        (ValueError, lambda: cloud.global_setup(structure="other")),
        (TypeError, lambda: cloud.global_setup(num_neighbors="8")),
        (ValueError, lambda: cloud.global_setup(num_neighbors=0)),
        (AttributeError, lambda: cloud.compute_density("lucy", "isotropic")),
        (ValueError, lambda: cloud.compute_density("lucy", "separable")),
        (ValueError, lambda: line.compute_smoothing(num_neighbors=4, structure="covariant")),
        (ValueError, lambda: cloud.interpolate("s", mode="other", structure="isotropic")),
        (AttributeError, lambda: cloud.interpolate("s", structure="isotropic")),
        (ValueError, lambda: cloud.deposit("s", gridnums=4, kernel_name="cic", structure="isotropic")),
        (ValueError, lambda: cloud.deposit("s", gridnums=4, kernel_name="nope")),
        (ValueError, lambda: cloud.deposit("s", gridnums=[4, 4], kernel_name="cic")),
        (AttributeError, lambda: cloud.deposit("s", gridnums=4, adaptive=True, kernel_name="lucy", structure="isotropic")),
        (ValueError, lambda: ParticleFrame.of(df).deposit("s", gridnums=4, kernel_name="cic")),
        (AssertionError, lambda: cloud.deposit("s", gridnums=4, kernel_name="cic", plane_projection=[1, 1])),
        (ValueError, lambda: line.deposit("s", gridnums=4, kernel_name="cic", plane_projection=[0, 1])),
        (TypeError, lambda: cloud.deposit("s", 1, gridnums=4, kernel_name="cic")),
        (ValueError, lambda: cloud.deposit("s", [True, False], gridnums=4, kernel_name="cic")),
        (ValueError, lambda: cloud.add_fields(["a", "b"], ["s"])),
        (AttributeError, lambda: cloud.deposit("none", gridnums=4, kernel_name="cic")),
    ]
    for error, call in cases:
        with pytest.raises(error):
            call()
    smoothed = cloud.compute_smoothing(num_neighbors=4, structure="isotropic").compute_density("lucy", "isotropic")
    with pytest.raises(ValueError):
        smoothed.interpolate("s", mode="divergence", structure="isotropic")
    line = line.compute_smoothing(num_neighbors=4, structure="isotropic").compute_density("lucy", "isotropic")
    with pytest.raises(NotImplementedError):
        line.interpolate("s", mode="curl", structure="isotropic")


def test_set_smoothing(spark):
    df, pdf = _points(spark, n=50, dim=2)
    cloud = ParticleFrame.of(df, ["x", "y"], weights="w", boxsize=1.0)
    h = df.select("id", F.lit(0.2).alias("h"))
    out = cloud.set_smoothing("isotropic", smoothing_lengths=h).deposit(
        "s", gridnums=8, adaptive=True, kernel_name="lucy", structure="isotropic", return_weights=True
    )
    assert np.isclose(out.toPandas().w.sum(), pdf.w.sum(), rtol=1e-3)
    tensors = df.select("id", F.lit(0.2).alias("hxx"), F.lit(0.0).alias("hxy"), F.lit(0.2).alias("hyy"))
    same = cloud.set_smoothing("covariant", smoothing_tensors=tensors).deposit(
        "s", gridnums=8, adaptive=True, kernel_name="lucy", structure="covariant", return_weights=True
    )
    a, b = (x.toPandas().sort_values(["ix", "iy"]).w.to_numpy() for x in (out, same))
    assert np.allclose(a, b)


def test_grids_and_lines(spark):
    g = grids.create_grid_2d(spark, (2, 4), (5, 7)).toPandas().sort_values("qid")
    assert len(g) == 8 and np.allclose(g.x.unique(), [1.25, 3.75]) and np.allclose(g.y.unique(), [0.875, 2.625, 4.375, 6.125])
    for bad in (0, [1, 2, 3]):
        with pytest.raises(ValueError):
            grids.create_grid(spark, bad, 1.0, 2)
    assert grids.grid_lines((0, 1, 0, 2), 1, include_edges=False) == ([0.5], [1.0], (0, 2, 0, 1))
    shifted = grids.shift_coordinates(_points(spark, n=10)[0], 3).toPandas()
    assert np.allclose(shifted[list("xyz")].min(), 0)


def test_streaming_deposit(spark, tmp_path):
    df, pdf = _points(spark, n=100, dim=2)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streaming_deposit(stream, ["s"], (4, 4), (1.0, 1.0))
    query = (
        out.writeStream.outputMode("complete").format("memory").queryName("grid")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert np.isclose(spark.table("grid").toPandas().w.sum(), pdf.w.sum())


def test_neighbours_of_a_dense_corner(spark):
    """Nearly all points lie closer together than any cell of a tree of fixed depth: work must not grow with their square."""
    rng = np.random.default_rng(5)
    p = rng.random((30_000, 2)) * np.where(np.arange(30_000) % 100, 1e-12, 1.0)[:, None]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1]}))
    began = time.monotonic()
    edges = knn.nearest(df, df.withColumnRenamed("id", "qid"), 8, 2).toPandas().sort_values(["qid", "rank"])
    assert time.monotonic() - began < 90  # by pairs of the corner's points it takes minutes
    ask = np.concatenate([np.arange(0, len(p), 150), np.arange(1, len(p), 150)])
    ids, dist = _brute(p, p[ask], 8)
    assert len(edges) == 8 * len(p)
    assert (edges.nid.to_numpy().reshape(-1, 8)[ask] == ids).mean() > 0.999
    assert np.allclose(edges.dist.to_numpy().reshape(-1, 8)[ask], dist, rtol=1e-9, atol=0)


@pytest.mark.parametrize("dim", [1, 2, 3])
@pytest.mark.parametrize("periodic", [True, False])
def test_neighbours_in_many_tiles(spark, monkeypatch, dim, periodic):
    """A lattice with copies, whose ties go to the smaller id, and a cluster; more queries than a task takes; columns that come along."""
    for what, value in (("BROADCAST_POINTS", 0), ("TILE_POINTS", 40), ("TASK_QUERIES", 50), ("CROWDED", 4), ("AT_ONCE", 5000), ("MANY", 3)):
        monkeypatch.setattr(knn, what, value)
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.integers(0, 8, (500, dim)) / 8, rng.random((200, dim)) ** 9 * 0.99, np.full((30, dim), 0.375)])
    p = p[rng.permutation(len(p))]
    pdf = pd.DataFrame({"id": np.arange(len(p))} | {a: p[:, j] for j, a in enumerate("xyz"[:dim])} | {"w": np.arange(len(p)) * 2.0})
    q = np.concatenate([p, np.full((120, dim), 0.5), rng.random((20, dim)) if periodic else rng.random((20, dim)) * 9 - 4])
    asked = pd.DataFrame({"qid": np.arange(len(q))} | {a: q[:, j] for j, a in enumerate("xyz"[:dim])})
    box = (1.0,) * dim if periodic else None
    found = knn.nearest(spark.createDataFrame(pdf), spark.createDataFrame(asked), 6, dim, box, ["w"])
    edges = found.toPandas().sort_values(["qid", "rank"])
    d = q[:, None, :] - p[None]
    if periodic:
        t = d + 0.5
        d = t - np.floor(t) - 0.5
    d2 = sum(d[:, :, j] * d[:, :, j] for j in range(dim))
    ids = np.lexsort((np.broadcast_to(np.arange(len(p)), d2.shape), d2), axis=1)[:, :6]
    assert len(edges) == 6 * len(q)
    assert (edges.nid.to_numpy().reshape(-1, 6) == ids).all()
    assert (edges["rank"].to_numpy().reshape(-1, 6) == np.arange(1, 7)).all()
    assert (edges.dist.to_numpy().reshape(-1, 6) == np.sqrt(np.take_along_axis(d2, ids, axis=1))).all()
    assert (edges.dx.to_numpy().reshape(-1, 6) == np.take_along_axis(d[:, :, 0], ids, axis=1)).all()
    assert (edges.n_w == edges.nid * 2.0).all()


def test_neighbours_without_coordinates(spark, monkeypatch):
    """Such points are found by nobody else; such queries have the smallest ids, as all their distances are null."""
    monkeypatch.setattr(knn, "BROADCAST_POINTS", 0)
    rows = [(i, None if i == 1 else float("nan") if i == 2 else i / 10, 0.5) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    found = knn.nearest(df, df.withColumnRenamed("id", "qid"), 3, 2).collect()
    by = {(r.qid, r["rank"]): (r.nid, r.dist) for r in found}
    assert len(found) == len(by) == 120
    assert [by[q, r] for q in (1, 2) for r in (1, 2, 3)] == [(0, None), (1, None), (2, None)] * 2
    assert [by[0, r][0] for r in (1, 2, 3)] == [0, 3, 4]
    assert by[10, 2] == (9, pytest.approx(0.1))
