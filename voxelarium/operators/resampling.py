"""Images on other grids."""

from __future__ import annotations

import itertools
import warnings

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import affine as A
from ..image import Image
from ..space import Space


#: Grids that share less than this of the smaller one's extent are likely not meant for each other.
DISJOINT = 0.05


def overlap(a: Space, b: Space) -> float:
    """The share of the smaller grid's box of world coordinates, voxels' edges included, that the two boxes have in common."""

    def box(s: Space) -> np.ndarray:
        ends = np.array(list(itertools.product(*[(-0.5, d - 0.5) for d in s.space_dims])))
        corners = A.apply_affine(s.trans, ends)
        return np.stack([corners.min(axis=0), corners.max(axis=0)])

    p, q = box(a), box(b)
    common = np.prod(np.clip(np.minimum(p[1], q[1]) - np.maximum(p[0], q[0]), 0, None))
    return float(common / min(np.prod(p[1] - p[0]), np.prod(q[1] - q[0])))


def resample(image: Image, target: Space, method: str = "linear") -> Image:
    """Values at the voxels of another grid.

    ``nearest`` takes the closest voxel, ``linear`` weighs the 8 around the place, ``cubic`` the 64 of a Catmull-Rom
    spline. Voxels whose place lies outside the source are absent; taps outside count as 0. The target's voxels are
    joined with the source's on the tap's voxel, so the work is a join whatever the two affines.
    """
    source, spark = image.space, image.data.sparkSession
    if (share := overlap(source, target)) < DISJOINT:
        warnings.warn(f"the grids share {share:.0%} of the smaller one's extent", stacklevel=2)
    grid = spark.range(1, target.n_vox + 1).withColumnRenamed("id", "vox")
    place = to_grid_of(target, source, *target.to_grid(F.col("vox")))
    at = grid.select("vox", *[F.round(p, 9).alias(n) for p, n in zip(place, "xyz")])
    if method == "nearest":
        near = [F.rint(n).cast("long") for n in "xyz"]
        asked = at.where(source.inside(*near)).select("vox", source.to_index(*near).alias("tap"))
        found = asked.join(image.data.withColumnRenamed("vox", "tap"), "tap")
        return Image(Space((*target.space_dims, *image.space.dims[3:]), trans=target.trans), found.select(*image.keys, "value"), image.labels)
    inside = F.lit(True)
    for n, d in zip("xyz", source.space_dims):
        inside = inside & F.col(n).between(1, d)
    at = at.where(inside)
    if method == "linear":
        def weights(u):
            return {0: 1 - u, 1: u}
    else:
        def weights(u):
            return {
                -1: (-u + 2 * u * u - u * u * u) / 2,
                0: (2 - 5 * u * u + 3 * u * u * u) / 2,
                1: (u + 4 * u * u - 3 * u * u * u) / 2,
                2: (-u * u + u * u * u) / 2,
            }
    spread = at.withColumn("w", F.lit(1.0))
    for n, d in zip("xyz", source.space_dims):  # one axis after the other, so expressions stay small
        u = F.col(n) - F.floor(n)
        taps = F.array(*[F.struct((F.floor(n) + s).alias("at"), w.alias("w")) for s, w in weights(u).items()])
        kept = spread.withColumn("o", F.explode(taps)).where((F.col("o.w") != 0) & F.col("o.at").between(1, d))
        spread = kept.withColumns({n: F.col("o.at").cast("double"), "w": F.col("w") * F.col("o.w")}).drop("o")
    spot = [F.col(n) for n in "xyz"]
    asked = spread.select("vox", source.to_index(*spot).alias("tap"), "w")
    found = asked.join(image.data.withColumnRenamed("vox", "tap"), "tap")
    value = found.groupBy(*image.keys).agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    return Image(Space((*target.space_dims, *image.space.dims[3:]), trans=target.trans), value, image.labels)


def resample_labels(parcels, source: Space, target: Space):
    """Parcels ``(vox, cluster)`` on another grid; labels are never mixed."""
    image = Image(source, parcels.select("vox", F.col("cluster").alias("value")))
    return resample(image, target, "nearest").data.select("vox", F.col("value").alias("cluster"))


def reorient(image: Image, codes: tuple[str, str, str]) -> Image:
    """Axes permuted and turned so that they run towards ``codes``; values are moved, never interpolated."""
    space = image.space
    turn = A.orientation_transform(A.affine_to_orientation(space.trans), A.axcodes_to_orientation(codes))
    shape = space.space_dims
    new = [0, 0, 0]
    for old in range(3):
        new[int(turn[old, 0])] = shape[old]
    back = A.inverse_orientation_affine(turn, shape)
    target = Space((*new, *space.dims[3:]), trans=space.trans @ back)
    place = [None, None, None]
    for old, axis in enumerate("ijk"):
        place[int(turn[old, 0])] = F.col(axis) if turn[old, 1] > 0 else F.lit(shape[old] + 1) - F.col(axis)
    moved = image.gridded().select(target.to_index(*place).alias("vox"), *image.data.columns[1:])
    return image.with_data(moved, target)


def as_canonical(image: Image, codes: tuple[str, str, str] = ("R", "A", "S")) -> Image:
    """The image towards right, front and top; unchanged if it is already."""
    return image if A.affine_to_axcodes(image.space.trans) == tuple(codes) else reorient(image, codes)


def deoblique(image: Image, method: str = "linear") -> Image:
    """The image resampled along the world axes, at its finest spacing."""
    return resample(image, A.output_aligned_space(image.space), method)


def to_grid_of(source: Space, target: Space, i: Column, j: Column, k: Column) -> tuple[Column, Column, Column]:
    """Voxels of one grid as voxels (from 1, not rounded) of another, as Columns."""
    to, g = target.inverse @ source.trans, (i - 1, j - 1, k - 1)
    return tuple(sum((F.lit(float(to[r, c])) * g[c] for c in range(3)), F.lit(float(to[r, 3]))) + 1 for r in range(3))


def grid_to_grid(source: Space, target: Space, voxels: np.ndarray) -> np.ndarray:
    """Voxels of one grid as voxels (from 1, not rounded) of another."""
    return A.apply_affine(target.inverse @ source.trans, np.asarray(voxels, float) - 1) + 1
