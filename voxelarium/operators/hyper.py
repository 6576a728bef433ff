"""Images of five dimensions (space, trials, features) in chunks.

A row of the table is a chunk: a cube of voxels by a span of trials by a span of features, with the least and the greatest
of each axis that it holds. A subset on any axis is a condition on these columns, which Parquet's statistics answer
for whole row groups, so few chunks are read; a chunk's values are one array, so a table of a billion values has some ten thousand rows.
Within a chunk absent values of its voxels are 0; a voxel without any value in a chunk takes no place in it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..space import Space

#: A chunk's side in voxels, and its trials and features.
SIDE, TRIALS, FEATURES = 16, 16, 16
_AXES = ("i", "j", "k", "trial", "feature")
_BOUNDS = [f"{axis}_{end}" for axis in _AXES for end in ("from", "to")]
_SCHEMA = "chunk long, " + ", ".join(f"{name} int" for name in _BOUNDS) + ", voxels array<long>, numbers array<double>"
CELLS = "feature int, trial int, vox long, value double"


@dataclass(frozen=True)
class HyperImage:
    """``space`` has five dimensions; ``data`` has a row a chunk. ``sizes`` are a chunk's extents on the axes i, j, k, trial, feature."""

    space: Space
    data: DataFrame
    sizes: tuple[int, ...] = (SIDE, SIDE, SIDE, TRIALS, FEATURES)

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple(-(-d // s) for d, s in zip(self.space.dims, self.sizes))

    def write(self, path: str) -> HyperImage:
        """The image on a table at ``path``, whose chunks lie in the order of the grid, in row groups of a few chunks."""
        ordered = self.data.repartitionByRange("chunk").sortWithinPartitions("chunk")
        ordered.write.option("parquet.block.size", 16 << 20).parquet(path)
        return replace(self, data=self.data.sparkSession.read.schema(_SCHEMA).parquet(path))


def from_cells(space: Space, cells: DataFrame, sizes: tuple[int, ...] = (SIDE, SIDE, SIDE, TRIALS, FEATURES)) -> HyperImage:
    """The image of rows ``(feature, trial, vox, value)``, counted from 1. Of rows that repeat a cell the greatest value counts."""
    if len(space.dims) != 5:
        raise ValueError(f"the space has {len(space.dims)} dimensions, not 5")
    dims = space.dims
    image = HyperImage(space, cells, sizes)
    counts = image.counts
    i, j, k = space.to_grid(F.col("vox"))
    chunk, stride = F.lit(0).cast("long"), 1
    for axis, size, count in zip((i, j, k, F.col("trial"), F.col("feature")), sizes, counts):
        chunk = chunk + F.floor((axis - 1) / size) * stride
        stride *= count
    inside = F.col("vox").between(1, space.n_vox) & F.col("trial").between(1, dims[3]) & F.col("feature").between(1, dims[4])
    rows = cells.where(inside & F.col("value").isNotNull()).select(chunk.alias("chunk"), F.col("feature").cast("int").alias("feature"), F.col("trial").cast("int").alias("trial"), F.col("vox").cast("long").alias("vox"), F.col("value").cast("double").alias("value"))

    def run(key, table):
        chunk = key[0].as_py()
        start = [int(c) * s + 1 for c, s in zip(np.unravel_index(chunk, counts, order="F"), sizes)]
        wide = [min(s, d - a + 1) for s, d, a in zip(sizes, dims, start)]
        vox, trial, feature, value = (table[name].to_numpy() for name in ("vox", "trial", "feature", "value"))
        order = np.argsort(value, kind="stable")
        voxels, at = np.unique(vox, return_inverse=True)
        numbers = np.zeros((wide[4], wide[3], len(voxels)))
        numbers[feature[order] - start[4], trial[order] - start[3], at[order]] = value[order]
        grid = [g + 1 for g in np.unravel_index(voxels - 1, dims[:3], order="F")]
        bounds = [int(f(g)) for g in grid for f in (np.min, np.max)] + [start[3], start[3] + wide[3] - 1, start[4], start[4] + wide[4] - 1]
        lists = [pa.array([voxels], pa.list_(pa.int64())), pa.array([numbers.ravel()], pa.list_(pa.float64()))]
        return pa.table([pa.array([chunk], pa.int64()), *[pa.array([b], pa.int32()) for b in bounds], *lists], names=["chunk", *_BOUNDS, "voxels", "numbers"])

    return replace(image, data=rows.groupBy("chunk").applyInArrow(run, _SCHEMA))


def read(spark: SparkSession, path: str, space: Space, sizes: tuple[int, ...] = (SIDE, SIDE, SIDE, TRIALS, FEATURES)) -> HyperImage:
    return HyperImage(space, spark.read.schema(_SCHEMA).parquet(path), sizes)


def _asked(wanted, dim: int) -> np.ndarray:
    """The places of an axis that are asked for: none given means all, a pair its span, a list itself."""
    if wanted is None:
        return np.arange(1, dim + 1)
    at = np.arange(wanted[0], wanted[1] + 1) if isinstance(wanted, tuple) else np.unique(np.asarray(wanted, np.int64))
    if len(at) and (at.min() < 1 or at.max() > dim):
        raise IndexError(f"places must lie in 1 to {dim}")
    return at


def _near(data: DataFrame, asked: list[np.ndarray]) -> DataFrame:
    """The chunks whose bounds meet what is asked for on every axis."""
    for axis, at in zip(_AXES, asked):
        low, high = (int(at.min()), int(at.max())) if len(at) else (1, 0)
        data = data.where((F.col(f"{axis}_from") <= high) & (F.col(f"{axis}_to") >= low))
    return data


def subset(image: HyperImage, i=None, j=None, k=None, trial=None, feature=None) -> DataFrame:
    """``(feature, trial, vox, value)`` of the cells asked for: a pair is a span, a list single places, on each axis.

    Voxels that hold no value are left out; ``dense`` has them.
    """
    dims = image.space.dims
    asked = [_asked(w, d) for w, d in zip((i, j, k, trial, feature), dims)]
    whole = [w is None for w in (i, j, k)]

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(n)[r] for n, name in enumerate(batch.schema.names)}
                t0, t1, f0, f1 = (row[name].as_py() for name in ("trial_from", "trial_to", "feature_from", "feature_to"))
                voxels = np.asarray(row["voxels"].values)
                numbers = np.asarray(row["numbers"].values).reshape(f1 - f0 + 1, t1 - t0 + 1, len(voxels))
                grid = np.unravel_index(voxels - 1, dims[:3], order="F")
                there = np.ones(len(voxels), bool)
                for g, at, every in zip(grid, asked, whole):
                    there &= every or np.isin(g + 1, at)
                trials, features = (at[(at >= a) & (at <= b)] for at, a, b in ((asked[3], t0, t1), (asked[4], f0, f1)))
                for f in features.tolist():  # a feature at a time
                    part = numbers[f - f0][np.ix_(trials - t0, there)]
                    n, m = part.shape
                    if n * m:
                        columns = [np.full(n * m, f, np.int32), np.repeat(trials, m).astype(np.int32), np.tile(voxels[there], n), part.ravel()]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["feature", "trial", "vox", "value"])

    return _near(image.data, asked).select(*_BOUNDS[6:], "voxels", "numbers").mapInArrow(run, CELLS)


def dense(image: HyperImage, **axes) -> DataFrame:
    """``(feature, trial, vox, value)`` of every cell of the grid, or of the axes given as for ``subset``, 0 where there is none.

    The cells are made chunk by chunk: every chunk of the grid that is asked for meets its row, if there is one.
    """
    dims, sizes, counts = image.space.dims, image.sizes, image.counts
    asked = [_asked(axes.get(name), d) for name, d in zip(_AXES, dims)]
    # along each axis the chunks that hold an asked place
    wanted = [np.unique((at - 1) // s).tolist() for at, s in zip(asked, sizes)]
    spark = image.data.sparkSession
    numbers, stride = spark.range(1).select(F.lit(0).cast("long").alias("chunk")), 1
    for at, count in zip(wanted, counts):
        each = F.explode(F.array(*[F.lit(c * stride).cast("long") for c in at]).cast("array<bigint>"))
        numbers = numbers.select("chunk", each.alias("c")).select((F.col("chunk") + F.col("c")).alias("chunk"))
        stride *= count
    chunks = math.prod(map(len, wanted))
    joined = numbers.repartition(max(1, min(chunks, 4096)), "chunk").join(_near(image.data, asked).select("chunk", "voxels", "numbers"), "chunk", "left")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                chunk, voxels, values = (batch.column(n)[r] for n in range(3))
                start = [int(c) * s + 1 for c, s in zip(np.unravel_index(chunk.as_py(), counts, order="F"), sizes)]
                spans = [at[(at >= a) & (at < a + s)] for at, a, s in zip(asked, start, sizes)]
                wide = [min(s, d - a + 1) for s, d, a in zip(sizes, dims, start)]
                grid = [g.ravel() for g in np.meshgrid(*spans[:3], indexing="ij")]
                vox = grid[0] + dims[0] * (grid[1] - 1 + dims[1] * (grid[2] - 1))
                full = np.zeros((wide[4], wide[3], len(vox)))
                if voxels.is_valid:
                    held = np.asarray(voxels.values)
                    at = np.searchsorted(held, vox)
                    found = (at < len(held)) & (held[np.minimum(at, len(held) - 1)] == vox)
                    full[:, :, found] = np.asarray(values.values).reshape(wide[4], wide[3], len(held))[:, :, at[found]]
                for f in spans[4].tolist():
                    part = full[f - start[4]][spans[3] - start[3]]
                    n, m = part.shape
                    columns = [np.full(n * m, f, np.int32), np.repeat(spans[3], m).astype(np.int32), np.tile(vox, n), part.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["feature", "trial", "vox", "value"])

    return joined.select("chunk", "voxels", "numbers").mapInArrow(run, CELLS)


def series(image: HyperImage, i: int, j: int, k: int) -> DataFrame:
    """``(feature, trial, value)`` at a voxel, a row for each, 0 outside the mask."""
    return dense(image, i=[i], j=[j], k=[k]).select("feature", "trial", "value")


def mask_of(image: HyperImage) -> DataFrame:
    """``(vox)``: the voxels that hold a value."""
    return image.data.select(F.explode("voxels").alias("vox")).distinct()
