"""Reductions over images, times, factors and parcels."""

from __future__ import annotations

import itertools
import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from ..image import Image
from ..space import Space

MEAN = F.avg


def summarize(image: Image) -> DataFrame:
    """One row: count, sum, smallest, largest, any and all, with absent voxels as 0."""
    total = image.space.n_vox * (int(image.space.dims[3]) if image.is_series else 1)
    there = F.count("*")
    lacks = there < total

    def with_zero(f, pick) -> Column:
        return F.when(lacks, pick(f("value"), F.lit(0))).otherwise(f("value"))

    return image.data.agg(
        there.alias("n_stored"),
        F.sum("value").alias("total"),
        with_zero(F.min, F.least).alias("smallest"),
        with_zero(F.max, F.greatest).alias("largest"),
        F.coalesce(F.max(F.col("value") != 0), F.lit(False)).alias("any_nonzero"),
        (~lacks & F.coalesce(F.min(F.col("value") != 0), F.lit(False))).alias("all_nonzero"),
    )


def describe(image: Image) -> DataFrame:
    """One row: extremes, mean, deviation, and counts of missing, zero and nonzero values."""
    v = F.col("value")
    return image.data.agg(
        F.min(v).alias("smallest"),
        F.max(v).alias("largest"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.sum(v.isNull().cast("long")).alias("n_missing"),
        F.sum((v == 0).cast("long")).alias("n_zero"),
        F.sum((v != 0).cast("long")).alias("n_nonzero"),
    )


def temporal_mean(image: Image) -> Image:
    """The mean over time of each voxel; a time without a row counts as 0 unless the voxel has no row at all."""
    n = F.lit(float(image.space.dims[3]))
    return Image(Space(image.space.space_dims, trans=image.space.trans), image.data.groupBy("vox").agg((F.sum("value") / n).alias("value")))


def split_reduce(image: Image, factor: DataFrame, aggregate=MEAN) -> DataFrame:
    """Reduces by a factor table: ``(t, level)`` gives ``(vox, level, value)``, ``(vox, level)`` gives ``(level, t, value)``."""
    by_time = "t" in factor.columns
    keys = ["vox", "level"] if by_time else ["level", "t"] if image.is_series else ["level"]
    return image.data.join(factor, "t" if by_time else "vox").groupBy(*keys).agg(aggregate("value").alias("value"))


def split_fill(image: Image, factor: DataFrame, aggregate=MEAN) -> Image:
    """As ``split_reduce`` over voxels, the result given back to each member."""
    keys = ["level", *(["t"] if image.is_series else [])]
    reduced = split_reduce(image, factor, aggregate)
    return image.with_data(image.data.drop("value").join(factor, "vox").join(reduced, keys).select(*image.keys, "value"))


def parcel_series(image: Image, parcels: DataFrame, aggregate=MEAN, weights: DataFrame | None = None) -> DataFrame:
    """``(cluster, t, value)`` from parcels ``(vox, cluster)``; with weights ``(vox, w)`` their weighted means.

    A voxel without a weight, or with one of null, counts as 0; a parcel whose weights sum to 0 has null values.
    """
    keys = ["cluster", *(["t"] if image.is_series else [])]
    rows = image.data.join(parcels, "vox")
    if weights is None:
        return rows.groupBy(*keys).agg(aggregate("value").alias("value"))
    total = F.sum("w")
    mean = F.when(total != 0, F.sum(F.col("w") * F.col("value")) / total)
    return rows.join(weights.select("vox", "w").where("w is not null"), "vox").groupBy(*keys).agg(mean.alias("value"))


def label_map(parcels: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """``(cluster, label)`` of the parcels; one without a name is called ``Clus_`` and its id."""
    ids = parcels.select("cluster").distinct()
    named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("cluster")] if names else F.lit(None).cast("string")
    return ids.select("cluster", F.coalesce(named, F.concat(F.lit("Clus_"), F.col("cluster").cast("string"))).alias("label"))


def parcels_named(parcels: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """The parcels with one of these labels; a name that no parcel has is an error."""
    found = labels.where(F.col("label").isin(names))
    if missing := set(names) - {r.label for r in found.select("label").distinct().collect()}:
        raise ValueError(f"no parcels are named {sorted(missing)}")
    return parcels.join(found.select("cluster"), "cluster", "left_semi").select("vox", "cluster")


def centroids(space: Space, parcels: DataFrame) -> DataFrame:
    """``(cluster, n, x, y, z)``: the mean world coordinates of each parcel."""
    i, j, k = space.to_grid(F.col("vox"))
    x, y, z = space.to_coord(i, j, k)
    placed = parcels.select("cluster", x.alias("x"), y.alias("y"), z.alias("z"))
    return placed.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"])


def medoids(space: Space, parcels: DataFrame, rounds: int = 20) -> DataFrame:
    """``(cluster, x, y, z)``: the geometric median of each parcel by Weiszfeld's steps.

    A step is a weighted mean per parcel, summed before the shuffle, so no parcel is held by one task.
    """
    i, j, k = space.to_grid(F.col("vox"))
    x, y, z = space.to_coord(i, j, k)
    points = runtime.materialize(parcels.select("cluster", x.alias("px"), y.alias("py"), z.alias("pz")), "points")
    centers = runtime.materialize(points.groupBy("cluster").agg(*[F.avg(f"p{c}").alias(c) for c in "xyz"]), "centers")
    for _ in range(rounds):
        far = F.sqrt(sum(((F.col(f"p{c}") - F.col(c)) ** 2 for c in "xyz"), F.lit(0.0)))
        pulled = points.join(centers, "cluster").withColumn("w", 1 / F.greatest(far, F.lit(1e-9)))
        step = pulled.groupBy("cluster").agg(*[(F.sum(F.col(f"p{c}") * F.col("w")) / F.sum("w")).alias(c) for c in "xyz"])
        centers = runtime.materialize(step, "centers")
    return centers


def sub_clusters(parcels: DataFrame, ids: list[int]) -> DataFrame:
    return parcels.where(F.col("cluster").isin(ids))


def num_clusters(parcels: DataFrame) -> DataFrame:
    return parcels.agg(F.countDistinct("cluster").alias("n_clusters"))


def target_dims(space: Space, spacing=None, factor=None, outdim=None) -> tuple[int, int, int]:
    """The dimensions that one of spacing, factor or outdim asks for, halves rounded to even, at least 1."""
    if sum(x is not None for x in (spacing, factor, outdim)) != 1:
        raise ValueError("give one of spacing, factor and outdim")
    if outdim is not None:
        return tuple(outdim)
    if factor is not None:
        factors = (factor,) * 3 if not hasattr(factor, "__len__") else factor
        return tuple(max(1, round(d * f)) for d, f in zip(space.space_dims, factors))
    return tuple(max(1, round(d * s / n)) for d, s, n in zip(space.space_dims, space.spacing, spacing))


def downsample(image: Image, spacing=None, factor=None, outdim=None) -> Image:
    """Box averages on a coarser grid, cells weighed by their overlap; missing and non-finite values are skipped.

    A voxel meets the few target cells it overlaps on each axis, so weights are summed before the shuffle.
    """
    new = target_dims(image.space, spacing, factor, outdim)
    old = image.space.space_dims
    rows = image.gridded()
    weight = F.lit(1.0)
    for axis, n_old, n_new in zip("ijk", old, new):
        ratio = n_old / n_new
        lo, hi = F.col(axis) - 1, F.col(axis)
        first = F.floor(lo / ratio)
        last = F.least(F.ceil(hi / ratio) - 1, F.lit(n_new - 1))
        rows = rows.withColumn(f"n{axis}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        begin, end = F.col(f"n{axis}") * ratio, (F.col(f"n{axis}") + 1) * ratio
        weight = weight * (F.least(end, hi.cast("double")) - F.greatest(begin, lo.cast("double")))
    v = F.col("value").cast("double")
    good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    scale = [o / n for o, n in zip(old, new)]
    trans = image.space.trans.copy()
    trans[:3, :3] = trans[:3, :3] * scale
    space = Space((*new, *image.space.dims[3:]), trans=trans)
    vox = space.to_index(F.col("ni") + 1, F.col("nj") + 1, F.col("nk") + 1)
    weighed = rows.where(good).select(vox.alias("vox"), *image.keys[1:], weight.alias("w"), v.alias("v")).where("w > 0")
    out = weighed.groupBy(*image.keys).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("value"))
    return Image(space, out, image.labels)


def downsample_sparse(image: Image, new_dims: tuple[int, int, int]) -> Image:
    """Plain means of the stored voxels in each bin of ``floor((c - 1) * new / old) + 1``."""
    old = image.space.space_dims
    trans = image.space.trans.copy()
    trans[:3, :3] = trans[:3, :3] * [o / n for o, n in zip(old, new_dims)]
    space = Space((*new_dims, *image.space.dims[3:]), trans=trans)
    bins = [F.floor((F.col(a) - 1) * n / o) + 1 for a, n, o in zip("ijk", new_dims, old)]
    binned = image.gridded().select(space.to_index(*bins).alias("vox"), *image.keys[1:], "value")
    return Image(space, binned.groupBy(*image.keys).agg(F.avg("value").alias("value")))


class Centers:
    """Centers of clusters and what is known of their distances; of the size of their number alone."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at = at
        #: How far each has moved, and how far any other one of them has at most.
        self.moved = np.zeros(len(at)) if before is None else np.sqrt(((at - before) ** 2).sum(axis=1))
        top = np.sort(self.moved)[::-1]
        first = int(self.moved.argmax())
        self.others = np.full(len(at), top[0])
        self.others[first] = top[1] if len(at) > 1 else 0.0
        # half the way to the next center: a point nearer than that has no nearer one
        self.half = np.full(len(at), np.inf)
        for s in range(0, len(at), 512):
            d = np.sqrt(((at[s : s + 512, None] - at[None]) ** 2).sum(axis=2))
            d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
            self.half[s : s + 512] = d.min(axis=1, initial=np.inf) / 2

    def squared(self, p: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Squared distances of points to some centers, summed in the order of the axes."""
        d = [p[:, None, n] - self.at[None, some, n] for n in range(3)]
        return (d[0] * d[0] + d[1] * d[1]) + d[2] * d[2]

    def search(self, p: np.ndarray, side: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest center of each point (of equals the first), its distance and that of the next one.

        Points are taken by cubes. A center that is nearest to any point of a cube is, seen from the cube's middle, no
        further than the nearest one and the cube's diagonal; the second one is no further than the second and the diagonal.
        """
        label, near, next_ = np.zeros(len(p), np.int64), np.zeros(len(p)), np.full(len(p), np.inf)
        cubes, of = np.unique(np.floor(p / side), axis=0, return_inverse=True)
        order = np.argsort(of.ravel(), kind="stable")
        ends = np.cumsum(np.bincount(of.ravel(), minlength=len(cubes)))
        reach = side * math.sqrt(3) * (1 + 1e-9)
        for c, (start, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            rows = order[start:end]
            middle = np.sqrt(self.squared((cubes[c] + 0.5)[None] * side, np.arange(len(self.at)))[0])
            bound = np.partition(middle, 1)[1] if len(middle) > 1 else middle[0]
            some = np.flatnonzero(middle <= bound + reach)
            d = self.squared(p[rows], some)
            best = d.argmin(axis=1)
            label[rows], near[rows] = some[best], np.sqrt(d[np.arange(len(rows)), best])
            if len(some) > 1:
                d[np.arange(len(rows)), best] = np.inf
                next_[rows] = np.sqrt(d.min(axis=1))
        return label, near, next_

    def assign(self, side: float):
        """Points ``(vox, x, y, z, cluster, upper, lower, skipped)`` with the clusters of these centers.

        ``upper`` is at least the distance of a point's center, ``lower`` at most that of any other. They follow the
        centers' moves, and a point whose upper bound stays under the lower one, or under half the way to the next center, keeps its
        cluster without a search.
        """

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                p = np.stack([np.asarray(b.column(n), float) for n in (1, 2, 3)], axis=1)
                label, upper, lower = (np.asarray(b.column(n)).copy() for n in (4, 5, 6))
                fresh = label < 0
                own = np.where(fresh, 0, label)
                upper, lower = upper + self.moved[own], lower - self.others[own]
                bound = np.maximum(lower, self.half[own]) * (1 - 1e-12)
                open_ = fresh | (upper >= bound)
                again = np.flatnonzero(open_ & ~fresh)
                d = p[again] - self.at[own[again]]
                upper[again] = np.sqrt((d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) + d[:, 2] * d[:, 2])
                open_[again] = upper[again] >= bound[again]
                rows = np.flatnonzero(open_)
                label[rows], upper[rows], lower[rows] = self.search(p[rows], side)
                columns = [b.column(0), *[pa.array(p[:, n]) for n in range(3)], pa.array(label), pa.array(upper), pa.array(lower), pa.array(~open_)]
                yield pa.RecordBatch.from_arrays(columns, ["vox", "x", "y", "z", "cluster", "upper", "lower", "skipped"])

        return run


_ASSIGNED = "vox long, x double, y double, z double, cluster long, upper double, lower double, skipped boolean"


def partition(mask: Image, k: int, rounds: int = 200, seed: int = 1, first: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """``(vox, cluster)``: k-means of the mask's world coordinates, from ``first`` centers or from ``k`` drawn voxels.

    Rounds go on until no center moves; a warning tells where ``rounds`` of them were not enough. To the driver come the k
    centers of a round. A round searches the cubes around a voxel only where the bounds of its distances leave its cluster open; it
    is written and the one before deleted.
    """
    spark = mask.data.sparkSession
    points = mask.with_coords().select("vox", "x", "y", "z").dropDuplicates(["vox"])
    path, points = runtime.write_table(points.withColumns({"cluster": F.lit(-1).cast("long"), "upper": F.lit(0.0), "lower": F.lit(0.0)}), "points")
    if first is None:
        first = [(r.x, r.y, r.z) for r in points.orderBy(F.xxhash64(F.lit(seed), "vox"), "vox").limit(k).collect()]
    if not first:
        return points.select("vox", F.col("cluster").cast("int").alias("cluster"))
    centers = Centers(np.array(first, float))
    extent = points.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
    # cubes of about the size of a cluster
    side = max((math.prod(max(extent[c] or 0.0, min(mask.space.spacing)) for c in "xyz") / len(first)) ** (1 / 3), min(mask.space.spacing)) if extent.n else 1.0
    for _ in range(rounds):
        new_path, points = runtime.write_table(points.select(*_names(_ASSIGNED)[:-1]).mapInArrow(centers.assign(side), _ASSIGNED), "points")
        runtime.delete_table(spark, path)
        path, at = new_path, centers.at.copy()
        for r in points.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in "xyz"]).collect():
            at[r.cluster] = (r.x, r.y, r.z)
        # sums in another order differ in their last digits
        if np.allclose(at, centers.at, rtol=1e-12, atol=1e-9):
            break
        centers = Centers(at, centers.at)
    else:
        warnings.warn(f"k-means: centers still move after {rounds} rounds", stacklevel=2)
        new_path, points = runtime.write_table(points.select(*_names(_ASSIGNED)[:-1]).mapInArrow(centers.assign(side), _ASSIGNED), "points")
        runtime.delete_table(spark, path)
    return points.select("vox", (F.col("cluster") + 1).cast("int").alias("cluster"))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def split_blocks(image: Image, blocks: DataFrame) -> DataFrame:
    """Rows with their ``block`` and the time counted anew in it, from ``(t, block)``."""
    again = F.dense_rank().over(Window.partitionBy("block").orderBy("t"))
    renumbered = blocks.withColumn("new_t", again.cast("int"))
    return image.data.join(renumbered, "t").select("block", "vox", F.col("new_t").alias("t"), "value")


def split_clusters(image: Image, parcels: DataFrame) -> DataFrame:
    """Rows with their cluster; ids of 0 or below are dropped."""
    return image.data.join(parcels.where("cluster > 0"), "vox").select("cluster", *image.keys, "value")


def _within(some: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """``(cluster, near, distance)`` of the points within ``reach`` of each of ``some``: a join of cubes of that side."""
    side = reach or 1.0
    cube = [F.floor(F.col(c) / side).alias(f"b{c}") for c in "xyz"]
    around = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("xyz", o)]) for o in itertools.product((-1, 0, 1), repeat=3)]))
    sent = some.select("cluster", *[F.col(c).alias(f"p{c}") for c in "xyz"], around.alias("o"))
    sent = sent.select("cluster", "px", "py", "pz", *[(F.floor(F.col(f"p{c}") / side) + F.col(f"o.{c}")).alias(f"b{c}") for c in "xyz"])
    far = F.sqrt(sum(((F.col(f"p{c}") - F.col(c)) ** 2 for c in "xyz"), F.lit(0.0)))
    found = sent.join(points.select(F.col("cluster").alias("near"), "x", "y", "z", *cube), ["bx", "by", "bz"])
    return found.select("cluster", "near", far.alias("distance")).where(F.col("distance") <= reach)


def cluster_neighbours(space: Space, parcels: DataFrame, k: int | None = 10, radius: float | None = None) -> DataFrame:
    """``(cluster, near, rank, distance)``: parcels by the distance of centroids, within a radius or the k nearest.

    Centroids meet through cubes of a reach. For the k nearest the reach is doubled, each time only for the parcels that
    have found fewer than k within it, until all have them or it spans the image.
    """
    points = runtime.materialize(centroids(space, parcels).select("cluster", "x", "y", "z"), "centroids")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("distance", "near"))
    if radius is not None:
        return _within(points, points, radius).withColumn("rank", rank)
    extent = points.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
    span = math.dist((0, 0, 0), (extent.x or 0, extent.y or 0, extent.z or 0)) * (1 + 1e-9) or 1.0
    reach, left, out = span * min(1.0, (k / max(extent.n, 1)) ** (1 / 3)), points, None
    while True:
        ranked = _within(left, points, reach).withColumn("rank", rank)
        ranked = ranked.withColumn("found", F.count("*").over(Window.partitionBy("cluster")))
        enough = F.lit(True) if reach >= span else F.col("found") >= k
        ready = runtime.materialize(ranked.where((F.col("rank") <= k) & enough).drop("found"), "near")
        out = ready if out is None else out.union(ready)
        if reach >= span:
            return out
        left = runtime.materialize(left.join(ready.select("cluster").distinct(), "cluster", "left_anti"), "left")
        if not left.take(1):
            return out
        reach = min(2 * reach, span)


def cluster_searchlight_series(image: Image, parcels: DataFrame, k: int | None = 10, radius: float | None = None) -> DataFrame:
    """``(cluster, near, rank, t, value)``: for each parcel the mean series of those near it, itself included."""
    means = parcel_series(image, parcels).withColumnRenamed("cluster", "near")
    return cluster_neighbours(image.space, parcels, k, radius).join(means, "near").select("cluster", "near", "rank", "t", "value")


#: Times of a tile.
TILE_TIMES = 512
_TYPES = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}


def matrix_tiles(image: Image, width: int = TILE_TIMES) -> DataFrame:
    """``(vox, tile, values)``: the series as rows of a matrix, cut into tiles of ``width`` times (from 0); absent values are 0.

    A tile's values are gathered with their places and put into one array in a pass, so the plan is the same for any
    number of times, and a row is never longer than a tile. Of values that repeat a time the greatest counts.
    """
    n, kind = int(image.space.dims[3]), image.data.schema["value"].dataType.simpleString()
    kind = kind if kind in _TYPES else "double"
    place = (F.col("t") - 1).cast("int")
    rows = image.data.where(F.col("t").between(1, n) & F.col("value").isNotNull())
    rows = rows.select("vox", F.floor(place / width).cast("int").alias("tile"), F.struct((place % width).alias("at"), F.col("value").cast(kind).alias("value")).alias("cell"))
    held = rows.groupBy("vox", "tile").agg(F.collect_list("cell").alias("cells"))

    def run(batches):
        for b in batches:
            cells = b.column(2)
            sizes = np.diff(np.asarray(cells.offsets)) if len(cells) else np.zeros(0, np.int64)
            flat = cells.flatten()
            at, values = np.asarray(flat.field("at")), np.asarray(flat.field("value"))
            row = np.repeat(np.arange(len(cells)), sizes)
            wide = np.minimum(width, n - np.asarray(b.column(1)).astype(np.int64) * width)
            start = np.cumsum(wide) - wide
            out = np.zeros(int(wide.sum()), _TYPES[kind])
            order = np.argsort(values, kind="stable")
            out[start[row[order]] + at[order]] = values[order]
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, wide.sum()).astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["vox", "tile", "values"])

    return held.mapInArrow(run, f"vox long, tile int, values array<{kind}>")


def to_matrix(image: Image, times: list[int] | None = None) -> DataFrame:
    """A row a voxel and a column ``t<n>`` a time, absent values 0; ``matrix_tiles`` has arrays instead of columns, for long series.

    Voxels without any value have no row.
    """
    n = int(image.space.dims[3])
    times = times or list(range(1, n + 1))
    first = Space((*image.space.space_dims, n), trans=image.space.trans)
    rows = matrix_tiles(image.with_data(image.data, first), n)
    return rows.select("vox", *[F.col("values")[t - 1].alias(f"t{t}") for t in times])


def matricized(image: Image) -> DataFrame:
    """``(col, vox)``: the columns of the matrix of times by voxels, the voxels that hold a value, numbered from 1 by their index."""
    return runtime.numbered(image.data.select("vox").distinct(), "col", "vox").select("col", "vox")


def matricized_access(image: Image, cells: DataFrame) -> DataFrame:
    """``(t, col, value)`` at the places ``(t, col)`` of that matrix, or, without ``t``, of whole columns; absent values are 0."""
    asked = cells.join(matricized(image), "col")
    if "t" not in cells.columns:
        asked = asked.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(int(image.space.dims[3])))))
    return asked.join(image.data.select("vox", "t", "value"), ["vox", "t"], "left").select("t", "col", F.coalesce("value", F.lit(0)).alias("value"))
