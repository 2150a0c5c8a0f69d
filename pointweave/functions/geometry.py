"""Boxes, cells, stencils and quadrature rules, as SQL text."""

from __future__ import annotations

from fractions import Fraction
from itertools import product
from math import comb

from pointweave.functions.text import num

AXES = ("x", "y", "z")


def resolve_box(boxsize, dim: int) -> tuple[float, ...] | None:
    """A scalar box holds for every axis; a sequence must have one length per axis."""
    if boxsize is None:
        return None
    if isinstance(boxsize, (int, float)):
        return (float(boxsize),) * dim
    out = tuple(float(b) for b in boxsize)
    out = out * dim if len(out) == 1 else out
    assert len(out) == dim, f"boxsize must have one value or {dim}, not {len(out)}"
    return out


def resolve_gridnums(gridnums, dim: int) -> tuple[int, ...]:
    out = (int(gridnums),) if isinstance(gridnums, (int, float)) else tuple(int(n) for n in gridnums)
    out = out * dim if len(out) == 1 else out
    if len(out) != dim:
        raise ValueError(f"gridnums has {len(out)} values; the deposit has {dim} axes")
    if any(n <= 0 for n in out):
        raise ValueError("gridnums must be positive")
    return out


def difference(a: str, b: str, length: float | None) -> str:
    """a - b, by the nearest image in a periodic box: in [-L/2, L/2)."""
    if length is None:
        return f"({a} - {b})"
    t = f"({a} - {b} + {num(length / 2)})"
    return f"({t} - {num(length)} * floor({t} / {num(length)}) - {num(length / 2)})"


def floor_int(x: str) -> str:
    return f"CAST(floor({x}) AS INT)"


def ceil_int(x: str) -> str:
    return f"CAST(ceil({x}) AS INT)"


def wrapped(i: str, n: int) -> str:
    """i modulo n, never negative."""
    return f"((({i}) % {n} + {n}) % {n})"


def _quintic_weight(offset: int) -> str:
    """The fifth-order spline at distance |offset - d| for d in [0, 1], as one polynomial by Horner's rule.

    The spline is the sum over j of (-1)^j C(6, j) (3 - j - x)^5 / 120, each term where it is
    positive. Offset o at d has the weight of offset 1 - o at 1 - d.
    """
    if offset < 1:
        return _quintic_weight(1 - offset).replace("{d}", "(1e0 - {d})")
    coefficients = [Fraction(0)] * 6
    for j in range(6):
        start = 3 - j - offset  # the term's base is start + d
        if start >= 0:
            for power in range(6):
                share = comb(5, power) * Fraction(start) ** (5 - power)
                coefficients[power] += (-1) ** j * comb(6, j) * share / 120
    text = num(float(coefficients[5]))
    for c in reversed(coefficients[:5]):
        text = f"({text} * {{d}}" + (f" + {num(float(c))})" if c else ")")
    return text


#: Per scheme: how the base cell is found from s = position in cells, and the
#: weight of each offset in d = s - 1/2 - base; {s} and {d} stand for the columns.
STENCILS: dict[str, tuple[str, dict[int, str]]] = {
    "ngp": ("floor({s})", {0: "1e0"}),
    "cic": ("floor({s} - 0.5e0)", {0: "(1e0 - {d})", 1: "{d}"}),
    "tsc": (
        "floor({s})",
        {
            -1: "(0.5e0 * (0.5e0 - {d}) * (0.5e0 - {d}))",
            0: "(0.75e0 - {d} * {d})",
            1: "(0.5e0 * (0.5e0 + {d}) * (0.5e0 + {d}))",
        },
    ),
    "pcs": (
        "floor({s} - 0.5e0)",
        {
            -1: "((1e0 - {d}) * (1e0 - {d}) * (1e0 - {d}) / 6e0)",
            0: "((4e0 - 6e0 * {d} * {d} + 3e0 * {d} * {d} * {d}) / 6e0)",
            1: "((1e0 + 3e0 * {d} + 3e0 * {d} * {d} - 3e0 * {d} * {d} * {d}) / 6e0)",
            2: "({d} * {d} * {d} / 6e0)",
        },
    ),
    "pqs": ("floor({s} - 0.5e0)", {k: _quintic_weight(k) for k in range(-2, 4)}),
}

_RULES_1D: dict[str, list[tuple[float, float]]] = {
    "midpoint": [(0.5, 1.0)],
    "trapezoidal": [(0.0, 0.5), (1.0, 0.5)],
    "simpson": [(0.0, 1 / 6), (0.5, 4 / 6), (1.0, 1 / 6)],
}


def quadrature(rule: str, dim: int) -> list[tuple[tuple[float, ...], float]]:
    """Points in a unit cell and their weights: products of the 1-D rule."""
    if rule not in _RULES_1D:
        raise ValueError(f"unknown integration method {rule!r}: expected one of {', '.join(_RULES_1D)}")
    out = []
    for points in product(_RULES_1D[rule], repeat=dim):
        weight = 1.0
        for _, w in points:
            weight *= w
        out.append((tuple(p for p, _ in points), weight))
    return out
