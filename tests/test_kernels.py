import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointweave.functions.geometry import STENCILS, quadrature, resolve_box, resolve_gridnums
from pointweave.functions.kernels import (
    RADIAL,
    SEPARABLE,
    get_kernel,
    total_integral_separable,
    total_integral_spherical,
)
from pointweave.functions.samples import sample_table


@pytest.mark.parametrize("name", list(RADIAL))
@pytest.mark.parametrize("dim", [1, 2, 3])
def test_antiderivative_follows_the_value(name, dim):
    kernel = RADIAL[name]
    at = np.linspace(0, kernel.support, 20001)
    values = np.array([kernel.value_at(q, dim) * q ** (dim - 1) for q in at])
    numeric = np.concatenate([[0], np.cumsum((values[1:] + values[:-1]) / 2 * np.diff(at))])
    own = np.array([kernel.area_at(q, dim) for q in at])
    assert np.abs(numeric - own).max() < 2e-4 * max(1.0, own.max())


@pytest.mark.parametrize("name", list(RADIAL))
@pytest.mark.parametrize("dim", [1, 2, 3])
@pytest.mark.parametrize("eta", [1.0, 4.0, 10.0])
def test_sample_masses_sum_to_one(name, dim, eta):
    assert abs(total_integral_spherical(name, dim, eta) - 1.0) < 1e-3


@pytest.mark.parametrize("name", SEPARABLE)
@pytest.mark.parametrize("dim", [1, 2, 3])
def test_separable_totals(name, dim):
    assert abs(total_integral_separable(name, dim) - 1.0) < 1e-3


#: Known normalisations: the exact ones of these kernels in 1, 2 and 3 dimensions.
SIGMAS = {
    "tophat": (1, 4 / math.pi, 6 / math.pi),
    "lucy": (5 / 4, 5 / math.pi, 105 / (16 * math.pi)),
    "cubic_spline": (4 / 3, 40 / (7 * math.pi), 8 / math.pi),
    "quintic_spline": (1 / 120, 7 / (478 * math.pi), 1 / (120 * math.pi)),
    "wendland_c2": (5 / 8, 7 / (4 * math.pi), 21 / (16 * math.pi)),
    "wendland_c4": (3 / 4, 9 / (4 * math.pi), 495 / (256 * math.pi)),
    "wendland_c6": (55 / 64, 39 / (14 * math.pi), 1365 / (512 * math.pi)),
}


@pytest.mark.parametrize("name", list(SIGMAS))
def test_normalisations(name):
    for dim in (1, 2, 3):
        assert math.isclose(RADIAL[name].sigma(dim), SIGMAS[name][dim - 1], rel_tol=1e-12)


def test_sample_table_sizes():
    sizes = [len(sample_table(get_kernel("lucy"), d, 4.0)) for d in (1, 2, 3)]
    assert sizes == [8, 65, 380]
    with pytest.raises(ValueError):
        sample_table(get_kernel("lucy"), 2, -1.0)


@pytest.mark.parametrize("rule", ["midpoint", "trapezoidal", "simpson"])
def test_quadrature_weights(rule):
    for dim in (1, 2, 3):
        assert math.isclose(sum(w for _, w in quadrature(rule, dim)), 1.0)
    with pytest.raises(ValueError):
        quadrature("other", 2)


@settings(max_examples=50, deadline=None)
@given(st.floats(0, 1))
def test_stencils_are_partitions_of_unity(d):
    for name, (_, weights) in STENCILS.items():
        at = d - 0.5 if name == "tsc" else d
        values = [eval(w.format(d="at"), {"at": at}) for w in weights.values()]
        assert abs(sum(values) - 1.0) < 1e-12
        assert min(values) > -1e-12


def test_errors():
    for bad in ((("nope",), ValueError), (("lucy", 4), ValueError), (("lucy", 2, "separable"), ValueError)):
        with pytest.raises(bad[1]):
            get_kernel(*bad[0])
    with pytest.raises(ValueError):
        resolve_gridnums([4, 4, 4], 2)
    with pytest.raises(AssertionError):
        resolve_box([1.0, 2.0], 3)
    assert resolve_box(2, 3) == (2.0, 2.0, 2.0)


def test_erf_precise(spark):
    from pointweave.functions.kernels import erf_precise

    xs = [-7.0, -6.0, -3.3, -0.5, -1e-9, 0.0, 1e-300, 0.1, 0.4999, 0.5, 1.7, 2.0, 4.6, 5.999, 6.0, 50.0]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)] + [(99, None)], "k int, x double")
    got = {r.k: r.v for r in df.selectExpr("k", erf_precise("x") + " AS v").collect()}
    assert got[99] is None and all(abs(got[k] - math.erf(x)) < 4e-16 for k, x in enumerate(xs))
