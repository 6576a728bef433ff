"""Cubes of voxels with a rim, for operators that look at more of a neighbourhood than sums tell.

Each voxel goes to its own cube and to those whose rim it lies in, so what is shuffled grows with the cubes' surface and
not with the neighbourhood: at a side of 32 and a rim of 2 a voxel has 1.4 copies on average. A cube is one Arrow group of bounded
size, and its neighbourhoods are slices of one array.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..image import Image

#: Voxels of a cube's side, and times of a cube.
SIDE, TIMES = 32, 16


@dataclass(frozen=True)
class Layout:
    """The cubes of a grid: dimensions, sides and rims of the axes i, j, k and t."""

    dims: tuple[int, ...]
    sides: tuple[int, ...]
    rims: tuple[int, ...]

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple(-(-d // s) for d, s in zip(self.dims, self.sides))


@dataclass(frozen=True)
class Block:
    """A cube with its rim: values (0 where there is none), where there is one, the first place of the array in the grid, from 0, and further columns."""

    values: np.ndarray
    present: np.ndarray
    first: tuple[int, ...]
    layout: Layout
    extra: dict[str, np.ndarray]

    @property
    def own(self) -> tuple[slice, ...]:
        """The cube without its rim."""
        return tuple(slice(r, n - r) for r, n in zip(self.layout.rims, self.values.shape))

    def moved(self, array: np.ndarray, offset: tuple[int, ...]) -> np.ndarray:
        """What lies ``offset`` away from the places of the cube."""
        offset = (*offset, *[0] * (4 - len(offset)))
        return array[tuple(slice(r + o, n - r + o) for r, n, o in zip(self.layout.rims, self.values.shape, offset))]

    def clamped(self) -> np.ndarray:
        """The values, with places beyond the grid's bounds filled with those at the bounds."""
        at = [np.clip(np.arange(n), max(0, -f), max(0, d - f) - 1) for n, f, d in zip(self.values.shape, self.first, self.layout.dims)]
        return self.values[np.ix_(*at)]


def layout_of(image: Image, rim: tuple[int, ...], side: int = SIDE, times: int = TIMES) -> Layout:
    rim = (*rim, *[0] * (4 - len(rim)))
    n = int(image.space.dims[3]) if image.is_series else 1
    return Layout((*image.space.space_dims, n), (side, side, side, max(times, rim[3])), rim)


def haloed(image: Image, layout: Layout, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(block, vox[, t], value, *extra)``: each row once for every cube whose array holds it."""
    axes = [F.col("i"), F.col("j"), F.col("k"), F.col("t") if image.is_series else F.lit(1)]
    rows, block, stride = image.gridded(), F.lit(0).cast("long"), 1
    for n, (axis, side, rim, count) in enumerate(zip(axes, layout.sides, layout.rims, layout.counts)):
        if count > 1:
            low, high = F.floor((axis - 1 - rim) / side), F.floor((axis - 1 + rim) / side)
            cubes = F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(count - 1)))
            rows = rows.withColumn(f"__c{n}", F.explode(cubes))
            block = block + F.col(f"__c{n}") * stride
        stride *= count
    time = [F.col("t").cast("int").alias("t")] if image.is_series else []
    return rows.select(block.alias("block"), F.col("vox").cast("long").alias("vox"), *time, *[F.col(c).cast("double").alias(c) for c in ("value", *extra)])


def block_of(number: int, table: pa.Table, layout: Layout, series: bool, extra: tuple[str, ...] = ()) -> tuple[Block, np.ndarray, list[np.ndarray]]:
    """The block of a group of ``haloed``, its rows' voxels and their places in the block's arrays."""
    cube = np.unravel_index(number, layout.counts, order="F")
    first = tuple(int(c) * s - r for c, s, r in zip(cube, layout.sides, layout.rims))
    shape = tuple(min(s, d - int(c) * s) + 2 * r for c, s, d, r in zip(cube, layout.sides, layout.dims, layout.rims))
    vox = table["vox"].to_numpy()
    times = table["t"].to_numpy() - 1 if series else np.zeros(len(vox), np.int64)
    at = [a - f for a, f in zip((*np.unravel_index(vox - 1, layout.dims[:3], order="F"), times), first)]
    values, present = np.zeros(shape), np.zeros(shape, bool)
    values[tuple(at)], present[tuple(at)] = table["value"].to_numpy(), True
    others = {name: np.zeros(shape) for name in extra}
    for name, array in others.items():
        array[tuple(at)] = table[name].to_numpy()
    return Block(values, present, first, layout, others), vox, at


def map_blocks(image: Image, rim: tuple[int, ...], f: Callable[[Block], dict[str, np.ndarray]], columns: str = "value double", extra: tuple[str, ...] = (), side: int = SIDE, times: int = TIMES) -> DataFrame:
    """``(vox[, t], *columns)`` for the rows of an image, from what ``f`` gives for the places of each cube.

    ``rim`` has the reach on each axis. ``f`` is called for a cube with its rim and returns arrays of the cube's shape. ``extra`` names
    further columns of numbers, which the block holds beside the values.
    """
    layout, series = layout_of(image, rim, side, times), image.is_series
    names = [c.split()[0] for c in columns.split(",")]

    def run(key, table):
        block, vox, at = block_of(key[0].as_py(), table, layout, series, extra)
        shape = block.values.shape
        found = f(block)
        inside = np.all([(a >= r) & (a < n - r) for a, r, n in zip(at, layout.rims, shape)], axis=0)
        places = tuple(a[inside] - r for a, r in zip(at, layout.rims))
        out = {"vox": pa.array(vox[inside])}
        if series:
            out["t"] = pa.array(table["t"].to_numpy()[inside].astype(np.int32))
        return pa.table(out | {name: pa.array(found[name][places]) for name in names})

    schema = f"vox long, {'t int, ' if series else ''}{columns}"
    return haloed(image, layout, extra).groupBy("block").applyInArrow(run, schema)
