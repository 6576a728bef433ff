"""Geometry of an image grid: dimensions and the affine map from voxels to world coordinates.

Voxels are counted from 1 and the first axis runs fastest. The coordinate functions take and return Columns, so
they stay inside generated code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def signif(x, digits: int):
    """``x`` rounded to significant digits."""
    x = np.asarray(x, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(x == 0, 1.0, 10.0 ** (digits - 1 - np.floor(np.log10(np.abs(x)))))
    return np.round(x * scale) / scale


@dataclass(frozen=True, eq=False)
class Space:
    """``dims`` may have time or feature axes after the three of space; the affine covers space only."""

    dims: tuple[int, ...]
    spacing: tuple[float, ...] = ()
    origin: tuple[float, ...] = ()
    trans: np.ndarray = field(default=None)

    def __post_init__(self):
        dims = tuple(int(d) for d in self.dims)
        if not dims or any(d < 1 for d in dims):
            raise ValueError(f"dimensions must be positive: {self.dims}")
        n = min(3, len(dims))
        if self.trans is None:
            spacing = tuple(self.spacing) or (1.0,) * n
            origin = tuple(self.origin) or (0.0,) * n
            if len(spacing) < n or any(s <= 0 for s in spacing[:n]):
                raise ValueError(f"spacing must be positive on {n} axes: {spacing}")
            trans = np.eye(n + 1)
            trans[:n, :n] = np.diag(spacing[:n])
            trans[:n, n] = origin[:n]
        else:
            trans = np.array(self.trans, float)
            if abs(np.linalg.det(trans)) < 1e-12:
                raise ValueError("the affine is singular")
            spacing = tuple(np.sqrt((trans[:n, :n] ** 2).sum(axis=0)))
            origin = tuple(trans[:n, n])
        for name, value in (
            ("dims", dims),
            ("trans", signif(trans, 7)),
            ("spacing", tuple(float(s) for s in signif(spacing[:n], 6))),
            ("origin", tuple(float(o) for o in signif(origin[:n], 6))),
        ):
            object.__setattr__(self, name, value)

    @property
    def inverse(self) -> np.ndarray:
        return signif(np.linalg.inv(self.trans), 7)

    @property
    def space_dims(self) -> tuple[int, ...]:
        return (*self.dims[:3], 1, 1)[:3]

    @property
    def n_vox(self) -> int:
        return math.prod(self.space_dims)

    def same_grid(self, other: Space) -> bool:
        return self.space_dims == other.space_dims and np.allclose(self.trans, other.trans, atol=1e-5)

    def require_same_grid(self, other: Space) -> None:
        if not self.same_grid(other):
            raise ValueError(f"images lie on different grids: {self.space_dims} and {other.space_dims}")

    def add_dim(self, n: int) -> Space:
        return Space((*self.dims, n), trans=self.trans)

    def drop_dim(self, axis: int = -1) -> Space:
        dims = list(self.dims)
        del dims[axis if axis < 0 else axis - 1]
        if len(dims) < 3:
            keep = [i for i in range(3) if i != (axis if axis >= 0 else 3) - 1][: len(dims)]
            trans = np.eye(len(dims) + 1)
            trans[: len(dims), : len(dims)] = self.trans[np.ix_(keep, keep)]
            trans[: len(dims), -1] = self.trans[keep, 3]
            return Space(tuple(dims), trans=trans)
        return Space(tuple(dims), trans=self.trans)

    def bounds(self) -> np.ndarray:
        """World coordinates of the first and the last voxel, a row per axis."""
        last = np.array([*(d - 1 for d in self.space_dims), 1.0])
        return np.stack([self.trans[:3, 3], (self.trans @ last)[:3]], axis=1)

    # columns

    def to_index(self, i: Column, j: Column, k: Column) -> Column:
        """Grid to linear index; values within 1e-4 of a whole number are taken for it, others cut off."""
        a, b, _ = self.space_dims

        def whole(x: Column) -> Column:
            x = x.cast("double")
            return F.when(F.abs(x - F.rint(x)) < 1e-4, F.rint(x)).otherwise(x).cast("long")

        return whole(i) + (whole(j) - 1) * a + (whole(k) - 1) * (a * b)

    def to_grid(self, vox: Column) -> tuple[Column, Column, Column]:
        a, b, _ = self.space_dims
        z = vox - 1
        return (
            (F.pmod(z, F.lit(a)) + 1).cast("int"),
            (F.pmod(F.floor(z / a), F.lit(b)) + 1).cast("int"),
            (F.floor(z / (a * b)) + 1).cast("int"),
        )

    def to_coord(self, i: Column, j: Column, k: Column) -> tuple[Column, ...]:
        g = (i - 1, j - 1, k - 1)
        return tuple(sum((F.lit(float(self.trans[r, c])) * g[c] for c in range(3)), F.lit(float(self.trans[r, 3]))) for r in range(3))

    def from_coord(self, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
        p, inv = (x, y, z), self.inverse
        return tuple(sum((F.lit(float(inv[r, c])) * p[c] for c in range(3)), F.lit(float(inv[r, 3]))) + 1 for r in range(3))

    def coord_to_index(self, x: Column, y: Column, z: Column) -> Column:
        """The nearest voxel, halves to even."""
        return self.to_index(*(F.rint(g) for g in self.from_coord(x, y, z)))

    def inside(self, i: Column, j: Column, k: Column) -> Column:
        a, b, c = self.space_dims
        return i.between(1, a) & j.between(1, b) & k.between(1, c)
