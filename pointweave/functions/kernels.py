"""Smoothing kernels as piecewise polynomials in q = r / h.

A kernel states its pieces; derivative, antiderivative and normalisation follow
from them by exact rational arithmetic, so no further formula is written down.
The Gaussian is the one exception. All functions give SQL text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

from pointweave.functions.text import num, polynomial

Poly = list[Fraction]


def _times(a: Poly, b: Poly) -> Poly:
    out = [Fraction(0)] * (len(a) + len(b) - 1)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] += x * y
    return out


def _plus(a: Poly, b: Poly) -> Poly:
    n = max(len(a), len(b))
    return [(a[i] if i < len(a) else Fraction(0)) + (b[i] if i < len(b) else Fraction(0)) for i in range(n)]


def _power(base: Poly, n: int) -> Poly:
    out: Poly = [Fraction(1)]
    for _ in range(n):
        out = _times(out, base)
    return out


def _slope(a: Poly) -> Poly:
    return [k * c for k, c in enumerate(a)][1:] or [Fraction(0)]


def _area(a: Poly) -> Poly:
    return [Fraction(0)] + [c / (k + 1) for k, c in enumerate(a)]


def _at(a: Poly, x: Fraction) -> Fraction:
    return sum((c * x**k for k, c in enumerate(a)), Fraction(0))


def _linear(constant, slope) -> Poly:
    return [Fraction(constant), Fraction(slope)]


def _shell_measure(dim: int) -> float:
    return {1: 2.0, 2: 2.0 * math.pi, 3: 4.0 * math.pi}[dim]


def check_dim(dim: int) -> None:
    if isinstance(dim, bool) or not isinstance(dim, int) or dim not in (1, 2, 3):
        raise ValueError(f"dim must be 1, 2 or 3, not {dim!r}")


class Kernel:
    """A radial kernel made of polynomial pieces.

    ``pieces(dim)`` lists (upper limit, coefficients), limits ascending. ``closed``
    says whether the kernel holds its value at the support itself.
    """

    def __init__(self, name: str, support: Fraction, pieces: Callable[[int], list[tuple[Fraction, Poly]]], closed: bool):
        self.name, self._support, self._pieces, self._closed = name, support, pieces, closed
        self.support = float(support)

    def sigma(self, dim: int) -> float:
        """The factor that makes the kernel's integral over the whole space one."""
        check_dim(dim)
        return 1.0 / (_shell_measure(dim) * float(self._areas(dim)[1]))

    def _case(self, q: str, rows: list[tuple[Fraction, Poly]]) -> str:
        parts = []
        for k, (upper, poly) in enumerate(rows):
            sign = "<=" if k < len(rows) - 1 or self._closed else "<"
            parts.append(f"WHEN {q} {sign} {num(upper)} THEN {polynomial(poly, q)}")
        return f"CASE {' '.join(parts)} ELSE 0e0 END"

    def value(self, q: str, dim: int) -> str:
        """K(q) for q >= 0."""
        check_dim(dim)
        return self._case(q, self._pieces(dim))

    def slope(self, q: str, dim: int) -> str:
        """dK/dq for q >= 0."""
        check_dim(dim)
        return self._case(q, [(u, _slope(p)) for u, p in self._pieces(dim)])

    def _areas(self, dim: int) -> tuple[list[tuple[Fraction, Poly]], Fraction]:
        """The continuous antiderivative of q**(dim - 1) K(q) that starts at 0, and its end value."""
        out, low, done = [], Fraction(0), Fraction(0)
        weight: Poly = [Fraction(0)] * (dim - 1) + [Fraction(1)]
        for upper, poly in self._pieces(dim):
            area = _area(_times(weight, poly))
            area[0] += done - _at(area, low)
            out.append((upper, area))
            done, low = _at(area, upper), upper
        return out, done

    def area(self, q: str, dim: int) -> str:
        """The integral of t**(dim - 1) K(t) from 0 to q, for q clamped to the support."""
        check_dim(dim)
        rows, end = self._areas(dim)
        parts = [f"WHEN {q} <= 0e0 THEN 0e0"]
        parts += [f"WHEN {q} <= {num(u)} THEN {polynomial(p, q)}" for u, p in rows]
        return f"CASE {' '.join(parts)} ELSE {num(end)} END"

    # the same on the driver, for tables and tests
    def value_at(self, q: float, dim: int) -> float:
        for k, (upper, poly) in enumerate(rows := self._pieces(dim)):
            inside = q <= upper if k < len(rows) - 1 or self._closed else q < upper
            if inside:
                return float(sum(float(c) * q**i for i, c in enumerate(poly)))
        return 0.0

    def area_at(self, q: float, dim: int) -> float:
        rows, end = self._areas(dim)
        if q <= 0:
            return 0.0
        for upper, poly in rows:
            if q <= upper:
                return float(sum(float(c) * q**i for i, c in enumerate(poly)))
        return float(end)


#: Coefficients of an error function approximation (7.1.26 of a
#: standard handbook of mathematical functions), for engines without ``erf``.
ERF_SCALE = 0.3275911
ERF_TERMS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: str) -> str:
    """The error function of a non-negative argument, to 1.5e-7."""
    t = f"(1e0 / (1e0 + {num(ERF_SCALE)} * {x}))"
    return f"(1e0 - {polynomial((0.0, *ERF_TERMS), t)} * exp(-({x} * {x})))"


#: Pieces of the precise error function: their width, their number, and the degree of each.
PIECE, PIECES, PIECE_DEGREE = 0.5, 12, 18


def _erf_piece(c: float) -> list[float]:
    """Taylor coefficients of erf at c. Those of exp(-x*x) obey (n + 1) g[n + 1] = -2 c g[n] - 2 g[n - 1]."""
    g = [math.exp(-c * c)]
    g.append(-2.0 * c * g[0])
    for n in range(1, PIECE_DEGREE):
        g.append(-2.0 * (c * g[n] + g[n - 1]) / (n + 1))
    return [math.erf(c), *(2.0 / math.sqrt(math.pi) * g[n] / (n + 1) for n in range(PIECE_DEGREE))]


def erf_precise(x: str) -> str:
    """The error function of any argument, to 1e-15."""
    size = f"abs({x})"
    rows = [f"WHEN {x} IS NULL THEN NULL", f"WHEN {size} >= {num(PIECE * PIECES)} THEN sign({x})"]
    for k in reversed(range(PIECES)):
        c = PIECE * (k + 0.5)
        rows.append(f"WHEN {size} >= {num(PIECE * k)} THEN sign({x}) * {polynomial(_erf_piece(c), f'({size} - {num(c)})')}")
    return f"CASE {' '.join(rows)} ELSE {x} END"


def erf_at(x: float) -> float:
    t = 1.0 / (1.0 + ERF_SCALE * x)
    return 1.0 - sum(c * t ** (k + 1) for k, c in enumerate(ERF_TERMS)) * math.exp(-x * x)


class Gaussian(Kernel):
    """exp(-q*q), cut at 3 without a new normalisation."""

    def __init__(self):
        super().__init__("gaussian", Fraction(3), lambda dim: [], False)

    def sigma(self, dim: int) -> float:
        check_dim(dim)
        return math.pi ** (-dim / 2)

    def value(self, q: str, dim: int) -> str:
        check_dim(dim)
        return f"CASE WHEN {q} < 3e0 THEN exp(-({q} * {q})) ELSE 0e0 END"

    def slope(self, q: str, dim: int) -> str:
        check_dim(dim)
        return f"CASE WHEN {q} < 3e0 THEN (-2e0) * {q} * exp(-({q} * {q})) ELSE 0e0 END"

    def area(self, q: str, dim: int) -> str:
        check_dim(dim)
        c = f"least(greatest({q}, 0e0), 3e0)"
        root = num(math.sqrt(math.pi))
        if dim == 2:
            return f"(0.5e0 * (1e0 - exp(-({c} * {c}))))"
        if dim == 1:
            return f"(0.5e0 * {root} * {erf(c)})"
        return f"(0.25e0 * {root} * {erf(c)} - 0.5e0 * {c} * exp(-({c} * {c})))"

    def value_at(self, q: float, dim: int) -> float:
        return math.exp(-q * q) if q < 3 else 0.0

    def area_at(self, q: float, dim: int) -> float:
        c = min(max(q, 0.0), 3.0)
        if dim == 2:
            return 0.5 * (1 - math.exp(-c * c))
        if dim == 1:
            return 0.5 * math.sqrt(math.pi) * erf_at(c)
        return 0.25 * math.sqrt(math.pi) * erf_at(c) - 0.5 * c * math.exp(-c * c)


def _quintic(dim: int) -> list[tuple[Fraction, Poly]]:
    three, two, one = (_power(_linear(c, -1), 5) for c in (3, 2, 1))
    middle = _plus(three, [-6 * c for c in two])
    return [(Fraction(1), _plus(middle, [15 * c for c in one])), (Fraction(2), middle), (Fraction(3), three)]


def _wendland(n_line: int, line: list, n_space: int, space: list) -> Callable[[int], list[tuple[Fraction, Poly]]]:
    def pieces(dim: int) -> list[tuple[Fraction, Poly]]:
        n, factor = (n_line, line) if dim == 1 else (n_space, space)
        return [(Fraction(2), _times(_power(_linear(1, Fraction(-1, 2)), n), [Fraction(c) for c in factor]))]

    return pieces


_HALF = Fraction(1, 2)
_TENT = Fraction(3, 2)

#: The radial kernels.
RADIAL: dict[str, Kernel] = {
    k.name: k
    for k in (
        Kernel("tophat", _HALF, lambda dim: [(_HALF, [Fraction(1)])], True),
        Kernel("tsc", _TENT, lambda dim: [(_TENT, _linear(1, -1 / _TENT))], False),
        Gaussian(),
        Kernel("lucy", Fraction(1), lambda dim: [(Fraction(1), _times(_linear(1, 3), _power(_linear(1, -1), 3)))], True),
        Kernel(
            "cubic_spline",
            Fraction(1),
            lambda dim: [
                (_HALF, [Fraction(1), Fraction(0), Fraction(-6), Fraction(6)]),
                (Fraction(1), [2 * c for c in _power(_linear(1, -1), 3)]),
            ],
            True,
        ),
        Kernel("quintic_spline", Fraction(3), _quintic, False),
        Kernel("wendland_c2", Fraction(2), _wendland(3, [1, "3/2"], 4, [1, 2]), False),
        Kernel("wendland_c4", Fraction(2), _wendland(5, [1, "5/2", 2], 6, [1, 3, "35/12"]), False),
        Kernel("wendland_c6", Fraction(2), _wendland(7, [1, "7/2", "19/4", "21/8"], 8, [1, 4, "25/4", 4]), False),
    )
}
#: Kernels that also exist as a product of one-dimensional ones.
SEPARABLE = ("tophat", "tsc", "gaussian")


def register_kernel(kernel: Kernel) -> None:
    """Add a radial kernel of one's own."""
    RADIAL[kernel.name] = kernel


def get_kernel(name: str, dim: int | None = None, structure: str = "isotropic") -> Kernel:
    """A kernel by name; unknown names and dimensions raise ValueError."""
    if dim is not None:
        check_dim(dim)
    known = SEPARABLE if structure == "separable" else tuple(RADIAL)
    if name not in known:
        raise ValueError(f"unknown kernel {name!r}: expected one of {', '.join(known)}")
    return RADIAL[name]


def separable_sigma(kernel: Kernel, dim: int) -> float:
    return kernel.sigma(1) ** dim


def shell_integral(kernel: Kernel, low: float, high: float, dim: int) -> float:
    """The integral of q**(dim - 1) K(q) between two radii."""
    return max(0.0, kernel.area_at(high, dim) - kernel.area_at(low, dim)) if high > low else 0.0


def axis_integral(kernel: Kernel, low: str, high: str) -> str:
    """The integral of the even 1-D kernel between two signed bounds, low <= high."""
    one = lambda x: f"(CASE WHEN {x} < 0e0 THEN -({kernel.area(f'(-({x}))', 1)}) ELSE {kernel.area(x, 1)} END)"
    return f"({one(high)} - {one(low)})"


def get_kernel_shapes_1d(spark, kernel_name: str, structure: str = "isotropic", samples: int = 100):
    """Rows (i, q, value) of the normalised 1-D kernel at ``samples`` even steps from -support on."""
    from pyspark.sql import functions as F

    kernel = get_kernel(kernel_name, 1, structure)
    step, low = num(2.0 * kernel.support / samples), num(-kernel.support)
    rows = spark.range(samples).selectExpr("CAST(id AS INT) AS i", f"{low} + CAST(id AS DOUBLE) * {step} AS q")
    rows = rows.withColumn("_q", F.abs("q"))
    return rows.select("i", "q", F.expr(f"{num(kernel.sigma(1))} * ({kernel.value('_q', 1)})").alias("value"))


def total_integral_separable(name: str, dim: int) -> float:
    kernel = get_kernel(name, dim, "separable")
    return separable_sigma(kernel, dim) * (2.0 * kernel.area_at(kernel.support, 1)) ** dim


def total_integral_spherical(name: str, dim: int, eta_crit: float) -> float:
    from pointweave.functions.samples import sample_table

    return float(sum(row[-1] for row in sample_table(get_kernel(name, dim), dim, eta_crit)))
