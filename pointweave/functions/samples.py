"""Sample tables: a kernel as a few weighted points, for particles smaller than a cell.

The support is cut into shells; the points of a shell share its mass. Spacing is
at most half a cell when the kernel's diameter is ``eta_crit`` cells, so the size
follows from ``eta_crit`` alone (65 rows in 2-D and 380 in 3-D at 4).
"""

from __future__ import annotations

import math

import numpy as np

from pointweave.functions.kernels import Kernel, _shell_measure, check_dim, shell_integral


def shell_count(eta_crit: float, nyquist: float = 2.0) -> int:
    return max(1, math.ceil(nyquist * eta_crit / 2.0))


def sphere_points(n: int) -> np.ndarray:
    """n unit vectors along a spiral with the golden angle, even in height."""
    k = np.arange(n)
    height = 1.0 - (2.0 * k + 1.0) / n
    angle = k * math.pi * (3.0 - math.sqrt(5.0))
    flat = np.sqrt(np.clip(1.0 - height**2, 0.0, None))
    return np.column_stack([flat * np.cos(angle), flat * np.sin(angle), height])


def _directions(dim: int, radius_cells: float, nyquist: float) -> np.ndarray:
    """Unit vectors for a shell whose outer radius is so many cells."""
    if dim == 1:
        return np.array([[1.0], [-1.0]])
    if dim == 2:
        n = max(1, math.ceil(2.0 * math.pi * radius_cells * nyquist))
        angle = (np.arange(n) + 0.5) * (2.0 * math.pi / n)
        return np.column_stack([np.cos(angle), np.sin(angle)])
    return sphere_points(max(1, math.ceil(4.0 * math.pi * radius_cells**2 * nyquist**2)))


def sample_table(kernel: Kernel, dim: int, eta_crit: float, nyquist: float = 2.0) -> list[tuple[float, ...]]:
    """(c0, ..., mass) rows: coordinates in units of h, masses that sum to the kernel's integral."""
    check_dim(dim)
    if eta_crit < 0:
        raise ValueError("eta_crit must not be negative")
    shells = shell_count(eta_crit, nyquist)
    step = kernel.support / shells
    rows = []
    for k in range(shells):
        mass = kernel.sigma(dim) * _shell_measure(dim) * shell_integral(kernel, k * step, (k + 1) * step, dim)
        points = _directions(dim, (eta_crit / 2.0) * (k + 1) / shells, nyquist) * ((k + 0.5) * step)
        rows += [(*map(float, p), mass / len(points)) for p in points]
    return [r for r in rows if r[-1] != 0.0]
