"""ParticleFrame: particles with their box, fields and smoothing, as an immutable plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.functions.geometry import AXES, resolve_box, resolve_gridnums
from pointweave.functions.tensors import determinant, entries, entry, project_2d, with_eigensystem
from pointweave.functions.text import num
from pointweave.operators import deposit as deposits
from pointweave.operators import knn, sph

_RESERVED = {"id", "x", "y", "z", "w", "h", "det"}
_STRUCTURES = ("isotropic", "covariant", "separable")


def _check_structure(structure) -> None:
    if not isinstance(structure, str):
        raise TypeError(f"structure must be a string, not {type(structure).__name__}")
    if structure not in _STRUCTURES:
        raise ValueError(f"unknown structure {structure!r}: expected one of {', '.join(_STRUCTURES)}")


@dataclass(frozen=True)
class ParticleFrame:
    """Particles (id, x[, y[, z]], w and fields) in an open or periodic box.

    Methods return a new frame or a result; nothing changes in place, so a
    density always belongs to the smoothing and neighbours it was made from.
    """

    df: DataFrame
    dim: int
    boxsize: tuple[float, ...] | None = None
    fields: dict[str, list[str]] = field(default_factory=dict)
    structure: str | None = None
    kernel_name: str | None = None
    num_neighbors: int | None = None
    edges: DataFrame | None = None
    lengths: DataFrame | None = None
    tensors: DataFrame | None = None
    densities: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def of(
        cls,
        df: DataFrame,
        positions: Sequence[str] = AXES,
        id_col: str = "id",
        weights: str | None = None,
        boxsize=None,
        precision: str = "double",
    ) -> ParticleFrame:
        """Take ``positions`` (one to three columns) of ``df``; weights default to one.

        A box makes every axis periodic. All other columns stay as scalar fields.
        ``precision="float32"`` rounds inputs to single precision first.
        """
        dim = len(positions)
        assert dim in (1, 2, 3), f"positions need one to three axes, not {dim}"
        kind = "float" if precision == "float32" else "double"
        cast = lambda c: c.cast(kind).cast("double")
        columns = [F.col(id_col).alias("id")]
        columns += [cast(F.col(p)).alias(a) for p, a in zip(positions, AXES, strict=False)]
        columns.append((cast(F.col(weights)) if weights else F.lit(1.0)).alias("w"))
        rest = [c for c in df.columns if c not in {id_col, weights, *positions} and c not in _RESERVED]
        out = df.select(*columns, *rest)
        return cls(out, dim, resolve_box(boxsize, dim), {"weights": ["w"]} | {c: [c] for c in rest})

    @property
    def periodic(self) -> bool:
        return self.boxsize is not None

    # -- fields ----------------------------------------------------------------

    def add_fields(self, names: str | list[str], values) -> ParticleFrame:
        """Attach a field: a column or its name, or a list of these as a vector field."""
        if isinstance(names, list) != (isinstance(values, list) and isinstance(names, list)):
            raise ValueError("names and values must both be lists or both be single")
        if isinstance(names, list):
            if len(names) != len(values):
                raise ValueError(f"{len(names)} names for {len(values)} values")
            out = self
            for n, v in zip(names, values, strict=True):
                out = out.add_fields(n, v)
            return out
        if names in _RESERVED:
            raise ValueError(f"{names!r} is a reserved name")
        parts = list(values) if isinstance(values, (list, tuple)) else [values]
        targets = [names] if len(parts) == 1 else [f"{names}_{k}" for k in range(len(parts))]
        columns = {t: (v if isinstance(v, Column) else F.col(v)).cast("double") for t, v in zip(targets, parts, strict=True)}
        return replace(self, df=self.df.withColumns(columns), fields=self.fields | {names: targets})

    def delete_fields(self, names: str | list[str]) -> ParticleFrame:
        """Drop fields; a name that isn't there is passed over."""
        names = [names] if isinstance(names, str) else list(names)
        gone = {c for n in names for c in self.fields.get(n, []) if n != "weights"}
        left = {n: c for n, c in self.fields.items() if n not in names or n == "weights"}
        held = {c for cs in left.values() for c in cs}
        return replace(self, df=self.df.drop(*(gone - held)), fields=left)

    def _components(self, fields) -> list[list[str]]:
        if isinstance(fields, str):
            fields = [fields]
        if not isinstance(fields, list):
            raise ValueError("fields must be a name or a list of names")
        missing = [f for f in fields if f not in self.fields]
        if missing:
            raise AttributeError(f"no field {missing[0]!r}")
        return [self.fields[f] for f in fields]

    # -- defaults --------------------------------------------------------------

    def global_setup(self, structure=None, kernel_name=None, num_neighbors=None) -> ParticleFrame:
        """Set defaults; those left out stay."""
        out = self
        if structure is not None:
            _check_structure(structure)
            out = replace(out, structure=structure)
        if kernel_name is not None:
            if not isinstance(kernel_name, str):
                raise TypeError("kernel_name must be a string")
            out = replace(out, kernel_name=kernel_name)
        if num_neighbors is not None:
            if isinstance(num_neighbors, bool) or not isinstance(num_neighbors, int):
                raise TypeError("num_neighbors must be an integer")
            if num_neighbors <= 0:
                raise ValueError("num_neighbors must be positive")
            out = replace(out, num_neighbors=num_neighbors)
        return out

    def _default(self, value, what: str):
        value = value if value is not None else getattr(self, what)
        if value is None:
            raise AttributeError(f"{what} is not set: pass it or call global_setup")
        return value

    # -- smoothing and density ---------------------------------------------------

    def _edges(self, queries: DataFrame | None, k: int) -> DataFrame:
        carry = [c for c in self.df.columns if c not in ("id", *AXES[: self.dim])]
        asked = self.df.withColumnRenamed("id", "qid") if queries is None else queries
        return knn.nearest(self.df, asked, k, self.dim, self.boxsize, carry)

    def compute_smoothing(self, query_positions: DataFrame | None = None, num_neighbors=None, structure=None) -> ParticleFrame:
        """Neighbours, then h or the tensor S = H H, at the particles or at query positions (qid, x, ...)."""
        k = self._default(num_neighbors, "num_neighbors")
        assert isinstance(k, int) and not isinstance(k, bool) and k > 0, f"num_neighbors must be positive, not {k!r}"
        if k == 1:
            raise ValueError("num_neighbors counts the particle itself, so it must be at least 2")
        structure = self._default(structure, "structure")
        _check_structure(structure)
        if structure == "covariant" and self.dim == 1:
            raise ValueError("covariant smoothing needs two or three dimensions")
        edges = self._edges(query_positions, k)
        out = replace(self, edges=edges if query_positions is None else None, num_neighbors=k, densities={})
        if structure == "covariant":
            return replace(out, tensors=sph.smoothing_tensor(edges, self.dim), lengths=None)
        return replace(out, lengths=sph.smoothing_length(edges), tensors=None)

    def set_smoothing(self, structure=None, smoothing_lengths: DataFrame | None = None, smoothing_tensors: DataFrame | None = None):
        """Supply (id, h), or (id, hxx, ...) as the entries of H."""
        out = self
        if smoothing_lengths is not None:
            assert structure in ("isotropic", "separable"), "smoothing_lengths go with structure='isotropic'"
            out = replace(out, lengths=smoothing_lengths.select("id", F.col("h").cast("double").alias("h")))
        if smoothing_tensors is not None:
            assert structure == "covariant", "smoothing_tensors go with structure='covariant'"
            axes = AXES[: self.dim]
            h = lambda a, b: f"h{min(a, b)}{max(a, b)}"
            cells = [
                F.expr(" + ".join(f"{h(e[0], c)} * {h(c, e[1])}" for c in axes)).alias(f"s{e}") for e in entries(self.dim)
            ]
            own = smoothing_tensors.select("id", *cells).withColumn("det", F.expr(determinant(self.dim)))
            out = replace(out, tensors=own)
        return out

    def _smoothing(self, structure: str) -> DataFrame:
        found = self.tensors if structure == "covariant" else self.lengths
        if found is None:
            raise AttributeError(f"no {structure} smoothing: call compute_smoothing first")
        return found

    def smoothing_tensors(self) -> DataFrame:
        """(id, h??, l?, v??): H itself, its eigenvalues ascending, and their unit vectors, v<axis><number>,
        whose largest component is positive."""
        own = with_eigensystem(self._smoothing("covariant"), self.dim)
        axes = AXES[: self.dim]
        columns = [f"h{e}" for e in entries(self.dim)] + [f"l{j}" for j in range(self.dim)]
        return own.select("id", *columns, *[f"v{a}{j}" for j in range(self.dim) for a in axes])

    def compute_density(self, kernel_name=None, structure=None) -> ParticleFrame:
        structure = self._default(structure, "structure")
        _check_structure(structure)
        if structure == "separable":
            raise ValueError("a density needs an isotropic or covariant structure")
        kernel_name = self._default(kernel_name, "kernel_name")
        smoothing = self._smoothing(structure)
        if self.edges is None:
            raise AttributeError("no neighbours: call compute_smoothing first")
        found = sph.density(self.edges, kernel_name, self.dim, structure, smoothing)
        return replace(self, densities=self.densities | {structure: found}, kernel_name=kernel_name)

    def density(self, structure=None) -> DataFrame:
        structure = self._default(structure, "structure")
        if structure not in self.densities:
            raise AttributeError(f"no {structure} density: call compute_density first")
        return self.densities[structure]

    # -- interpolation -----------------------------------------------------------

    def interpolate(self, fields, query_positions: DataFrame | None = None, mode="field", structure=None, kernel_name=None, num_neighbors=None) -> DataFrame:
        """Fields or their derivatives at the particles, or at query positions (qid, x, ...)."""
        structure = self._default(structure, "structure")
        if mode not in sph.MODES:
            raise ValueError(f"unknown mode {mode!r}: expected one of {', '.join(sph.MODES)}")
        if structure not in ("isotropic", "covariant"):
            raise ValueError("interpolation needs an isotropic or covariant structure")
        rho, smoothing = self.density(structure), self._smoothing(structure)
        components = self._components(fields)
        kernel_name = self._default(kernel_name, "kernel_name")
        k = self._default(num_neighbors, "num_neighbors")
        edges = self._edges(None, k) if self.edges is None else self.edges
        if query_positions is not None:
            edges = self._edges(query_positions, k)
        own = rho.join(smoothing, "id")
        own = own.select(F.col("id").alias("nid"), *[F.col(c).alias(f"n_{c}") for c in own.columns if c != "id"])
        # the stored weight of a neighbour is its own column already
        edges = edges.drop(*[c for c in own.columns if c != "nid"])
        return sph.interpolate(edges.join(own, "nid"), components, kernel_name, self.dim, mode, structure)

    # -- deposits ----------------------------------------------------------------

    def _averaged(self, averaged, components: list[list[str]]) -> list[bool]:
        size = sum(map(len, components))
        if isinstance(averaged, bool):
            return [averaged] * size
        if not isinstance(averaged, (list, tuple)):
            raise TypeError("averaged must be a bool or a sequence of bools")
        if len(averaged) == size:
            return list(averaged)
        if len(averaged) == len(components):
            return [flag for flag, c in zip(averaged, components, strict=True) for _ in c]
        raise ValueError(f"averaged has {len(averaged)} flags for {len(components)} fields of {size} components")

    def deposit(
        self,
        fields,
        averaged=False,
        gridnums=None,
        extent=None,
        adaptive=False,
        kernel_name=None,
        structure=None,
        plane_projection=None,
        integration_method="midpoint",
        eta_crit=4.0,
        return_weights=False,
        clip=False,
        dense=False,
    ) -> DataFrame:
        """Particles onto a grid: rows (ix[, iy[, iz]], f0, ..., and w if asked).

        ``extent`` (a (low, high) pair per axis) selects particles, both ends
        included, and makes an open domain; without it the box is the periodic
        domain. A plane projection keeps two of three axes, in its order.
        """
        kernel_name = self._default(kernel_name, "kernel_name")
        if not adaptive and structure is not None:
            raise ValueError("structure goes with adaptive=True only")
        structure = self._default(structure, "structure") if adaptive else None
        components = self._components(fields)
        flags = self._averaged(averaged, components)
        names = [c for cs in components for c in cs]
        if extent is None and self.boxsize is None:
            raise ValueError("an open cloud needs an extent")
        rows, axes = self.df, AXES[: self.dim]
        if extent is None:
            box, periodic = self.boxsize, True
        else:
            pairs = [tuple(map(float, p)) for p in extent]
            if len(pairs) != self.dim:
                raise ValueError("extent needs a (low, high) pair per axis")
            for a, (low, high) in zip(axes, pairs, strict=True):
                rows = rows.filter(F.col(a).between(low, high))
            box, periodic = tuple(high - low for low, high in pairs), False
        if plane_projection is not None:
            assert len(plane_projection) == 2 and len(set(plane_projection)) == 2, "a plane needs two different axes"
            assert all(0 <= p < 3 for p in plane_projection), f"plane axes must be 0, 1 or 2, not {plane_projection}"
            if self.dim != 3:
                raise ValueError("a plane projection needs three dimensions")
        if adaptive:
            _check_structure(structure)
            rows = rows.join(self._smoothing(structure), "id")
        if extent is not None:
            rows = rows.withColumns({a: F.expr(f"{a} - {num(low)}") for a, (low, _) in zip(axes, pairs, strict=True)})
        dim = self.dim
        if plane_projection is not None:
            dim = 2
            box = tuple(box[p] for p in plane_projection)
            if structure == "covariant":
                rows = project_2d(rows, tuple(plane_projection))
                square = {e: " + ".join(f"h{entry(e[0], c)} * h{entry(c, e[1])}" for c in "xy") for e in entries(2)}
                rows = rows.withColumns({f"s{e}": F.expr(t) for e, t in square.items()})
                rows = rows.select("id", *AXES, "w", *[c for c in dict.fromkeys(names) if c not in _RESERVED], *[f"s{e}" for e in entries(2)])
            first, second = (AXES[p] for p in plane_projection)
            rows = rows.withColumns({"x": F.col(first), "y": F.col(second)})
            if "z" not in names:
                rows = rows.drop("z")
        grid = resolve_gridnums(gridnums, dim)
        if adaptive:
            out = deposits.deposit_adaptive(
                rows, names, flags, grid, box, kernel_name, structure, periodic, integration_method, eta_crit
            )
        else:
            out = deposits.deposit_fixed(rows, names, flags, grid, box, kernel_name, periodic, clip)
        if dense:
            out = deposits.densify(out, grid, len(names))
        return out if return_weights else out.drop("w")
