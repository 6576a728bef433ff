"""Regions around voxels: a template of offsets joined with the mask."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..image import Image
from ..runtime import materialize, numbered
from ..space import Space
from .blocks import SIDE, Block, map_blocks


def sphere_offsets(spacing: tuple[float, ...], radius: float) -> list[tuple[int, int, int]]:
    """Offsets within the radius in world units, the first axis slowest; their number depends on the radius only."""
    if radius < min(spacing):
        raise ValueError(f"radius {radius} is smaller than a voxel of {spacing}")
    reach = [range(-math.floor(radius / s), math.floor(radius / s) + 1) for s in spacing]
    return [o for o in itertools.product(*reach) if math.sqrt(sum((x * s) ** 2 for x, s in zip(o, spacing))) <= radius]


def cube_offsets(surround: int, fixed: int | None = None) -> list[tuple[int, int, int]]:
    """Offsets of a box; ``fixed`` (1 to 3) names an axis that stays, which gives a square."""
    reach = [[0] if fixed == axis else range(-surround, surround + 1) for axis in (1, 2, 3)]
    return list(itertools.product(*reach))


def shifted(image: Image, offsets: list[tuple[int, int, int]], weights: list[float] | None = None) -> DataFrame:
    """Each row once for every offset that stays on the grid, with ``near``, the voxel there (and ``w``)."""
    space = image.space
    parts = [(*o, 1.0) for o in offsets] if weights is None else [(*o, w) for o, w in zip(offsets, weights)]
    taps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"), F.lit(float(w)).alias("w")) for x, y, z, w in parts])
    g = image.gridded().withColumn("o", F.explode(taps))
    i, j, k = (F.col(a) + F.col(f"o.{b}") for a, b in zip("ijk", "xyz"))
    a, b, _ = space.space_dims
    near = (i + (j - 1) * a + (k - 1) * (a * b)).cast("long")
    columns = [*image.data.columns, near.alias("near")]
    if weights is not None:
        columns.append(F.col("o.w").alias("w"))
    return g.where(space.inside(i, j, k)).select(*columns)


def searchlight(mask: Image, radius: float, members: Image | None = None) -> DataFrame:
    """``(center, vox)``: for every voxel of the mask those of ``members`` (the mask itself) within the radius."""
    of = members or mask
    near = shifted(mask.with_data(mask.data.select("vox")), sphere_offsets(mask.space.spacing, radius))
    asked = near.select(F.col("vox").alias("center"), F.col("near").alias("vox"))
    return asked.join(of.data.select("vox"), "vox", "left_semi").select("center", "vox")


def searchlight_reduce(image: Image, mask: Image, radius: float, aggregate) -> DataFrame:
    """``(vox, value)``: an aggregate of the image over every neighbourhood.

    Values are scattered to the centres that hold them, so partial aggregation runs before the shuffle.
    """
    near = shifted(image, sphere_offsets(image.space.spacing, radius))
    inside = near.join(mask.data.select("vox"), "vox", "left_semi")
    reached = inside.select(F.col("near").alias("vox"), "value").join(mask.data.select("vox"), "vox", "left_semi")
    return reached.groupBy("vox").agg(aggregate(F.col("value")).alias("value"))


def axis_runs(offsets: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """``(first, last, y, z)``: the offsets as runs along the first axis."""
    out: list[list[int]] = []
    for y, z, x in sorted((y, z, x) for x, y, z in offsets):
        if out and out[-1][2:] == [y, z] and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x, y, z])
    return [tuple(r) for r in out]


def searchlight_sums(image: Image, mask: Image, radius: float, side: int = SIDE) -> DataFrame:
    """``(vox, total, n)``: sum and number of the image's values in the mask within the radius of each voxel of the mask.

    A neighbourhood is cut into runs along the first axis, and a run's sum is the difference of two running sums
    within a cube of voxels, so its cost grows with the square of the radius. What is shuffled is a voxel and its copies
    in the rims of neighbouring cubes. Centers without any value around them are left out. Values that aren't finite
    count as in a plain sum.
    """
    offsets = sphere_offsets(image.space.spacing, radius)
    runs = axis_runs(offsets)
    rim = tuple(max(abs(o[n]) for o in offsets) for n in range(3))
    inside = mask.data.select("vox").distinct().join(image.data.select("vox", "value"), "vox", "left")
    has = F.col("value").isNotNull().cast("double")
    rows = Image(Space(mask.space.space_dims, trans=mask.space.trans), inside.select("vox", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"), has.alias("has")))

    def run(block: Block) -> dict[str, np.ndarray]:
        def total(array: np.ndarray) -> np.ndarray:
            sums = np.cumsum(np.concatenate([np.zeros((1, *array.shape[1:3])), array[..., 0]]), axis=0)
            out = np.zeros(tuple(n - 2 * r for n, r in zip(array.shape[:3], rim)))
            for first, last, y, z in runs:
                at = tuple(slice(r + o, n - r + o) for r, n, o in zip(rim[1:], array.shape[1:3], (y, z)))
                top, low = rim[0] + last + 1, rim[0] + first
                out += sums[(slice(top, top + out.shape[0]), *at)] - sums[(slice(low, low + out.shape[0]), *at)]
            return out

        finite = np.isfinite(block.values)
        sums = total(np.where(finite, block.values, 0.0))
        if not finite.all():
            with np.errstate(invalid="ignore"):
                for odd in (np.inf, -np.inf, np.nan):
                    which = np.isnan(block.values) if np.isnan(odd) else block.values == odd
                    sums = np.where(total(which.astype(float)) > 0, sums + odd, sums)
        return {"total": sums[..., None], "n": np.rint(total(block.extra["has"]))[..., None].astype(np.int64)}

    return map_blocks(rows, rim, run, "total double, n long", ("has",), side).where("n > 0")


def rois(space: Space, centers: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """``(roi, vox)`` of regions around grid points ``(roi, i, j, k)``, cut off at the bounds."""
    taps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("xyz", o)]) for o in offsets])
    g = centers.withColumn("o", F.explode(taps))
    i, j, k = (F.col(a) + F.col(f"o.{b}") for a, b in zip("ijk", "xyz"))
    return g.where(space.inside(i, j, k)).select("roi", space.to_index(i, j, k).alias("vox"))


def spherical_rois(image: Image, centers: DataFrame, radius: float, nonzero: bool = False) -> DataFrame:
    """``(roi, vox, value)`` within the radius of each center."""
    found = rois(image.space, centers, sphere_offsets(image.space.spacing, radius)).join(image.data, "vox")
    return (found.where("value <> 0") if nonzero else found).select("roi", "vox", "value")


def box_rois(image: Image, centers: DataFrame, surround: int, fixed: int | None = None, nonzero: bool = False) -> DataFrame:
    """``(roi, vox, value)`` of a cuboid, or of a square with one axis fixed, around each center."""
    found = rois(image.space, centers, cube_offsets(surround, fixed)).join(image.data, "vox")
    return (found.where("value <> 0") if nonzero else found).select("roi", "vox", "value")


def random_searchlight(mask: Image, radius: float, seed: int = 1) -> DataFrame:
    """``(center, vox)`` of a disjoint cover: centers in a random order each take what is left within the radius.

    A voxel whose place in the order is the first of all that are left around it is the next center there, so many
    centers come out in each round and the result is that of going through the order one by one.
    """
    offsets = sphere_offsets(mask.space.spacing, radius)
    left = materialize(mask.data.select("vox", F.struct(F.xxhash64(F.lit(seed), "vox").alias("h"), F.col("vox").alias("v")).alias("turn")), "left")
    out = None
    while left.take(1):
        near = shifted(mask.with_data(left), offsets)
        pairs = near.select(F.col("near").alias("vox"), F.col("turn").alias("other")).join(left, "vox")
        best = pairs.groupBy("vox").agg(F.min("other").alias("first"), F.first("turn").alias("turn"))
        centers = best.where(F.col("first") == F.col("turn")).select("vox", "turn")
        taken = shifted(mask.with_data(centers), offsets).join(left.select(F.col("vox").alias("near")), "near", "left_semi")
        owned = taken.groupBy(F.col("near").alias("vox")).agg(F.min("turn").alias("c")).select(F.col("c.v").alias("center"), "vox")
        owned = materialize(owned, "owned")
        out = owned if out is None else out.union(owned)
        left = materialize(left.join(owned.select("vox"), "vox", "left_anti"), "left")
    return out if out is not None else mask.data.select(F.col("vox").alias("center"), "vox")


def resampled_searchlight(mask: Image, radius: float, draws: int, seed: int = 1, shape=None) -> DataFrame:
    """``(draw, center, vox)``: centers drawn with replacement; ``shape(radius, spacing)`` gives other offsets than a sphere's."""
    offsets = (shape or (lambda r, s: sphere_offsets(s, r)))(radius, mask.space.spacing)
    n = mask.data.count()
    places = numbered(mask.data.select("vox"), "at", F.xxhash64(F.lit(seed), "vox"), F.col("vox"))
    drawn = mask.data.sparkSession.range(1, draws + 1).select(
        F.col("id").alias("draw"), (F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(max(1, n))) + 1).alias("at")
    )
    centers = drawn.join(places, "at").select("draw", "vox")
    near = shifted(mask.with_data(centers), offsets)
    found = near.select("draw", F.col("vox").alias("center"), F.col("near").alias("vox"))
    return found.join(mask.data.select("vox"), "vox", "left_semi").select("draw", "center", "vox")


def ellipsoid_shape(scales: tuple[float, float, float]):
    """A shape whose radius is scaled on each axis."""
    return lambda radius, spacing: [o for o in sphere_offsets(spacing, radius * max(scales)) if sum((x * s / (radius * c)) ** 2 for x, s, c in zip(o, spacing, scales)) <= 1]


def cube_shape(radius: float, spacing: tuple[float, ...]) -> list[tuple[int, int, int]]:
    """All offsets of the cube that holds the sphere."""
    reach = [range(-math.floor(radius / s), math.floor(radius / s) + 1) for s in spacing]
    return list(itertools.product(*reach))


def blobby_shape(drop: float = 0.3, edge: float = 0.7, seed: int = 1):
    """A sphere some of whose outer offsets, beyond ``edge`` of the radius, are dropped at random."""
    import random

    def shape(radius: float, spacing: tuple[float, ...]) -> list[tuple[int, int, int]]:
        rng = random.Random(seed)
        far = lambda o: math.sqrt(sum((x * s) ** 2 for x, s in zip(o, spacing))) > edge * radius
        return [o for o in sphere_offsets(spacing, radius) if not far(o) or rng.random() >= drop]

    return shape


def clustered_searchlight(mask: Image, parcels: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """``(center, vox)``: a neighbourhood for each parcel, or for each of ``k`` made by k-means."""
    from .aggregates import partition

    if parcels is None:
        if k is None:
            raise ValueError("give parcels or their number")
        parcels = partition(mask, k)
    return parcels.join(mask.data.select("vox"), "vox", "left_semi").select(F.col("cluster").alias("center"), "vox")
