"""Arithmetic of images and lookups, as joins on the voxel."""

from __future__ import annotations

import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..image import Image

ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}


def arith(a: Image, op: str, b: Image | float, sparse: bool = False) -> Image:
    """Element-wise arithmetic.

    With a number, absent voxels take part as 0. Two images of a kind meet on the union of their voxels, absent ones
    as 0; ``sparse`` then drops results of 0. A volume meets every time of a series.
    """
    do = ARITHMETIC[op]
    if not isinstance(b, Image):
        return a.dense().map(lambda v: do(v, F.lit(b)))
    a.space.require_same_grid(b.space)
    other = b.data.withColumnRenamed("value", "other")
    zero = F.lit(0)
    if a.is_series != b.is_series:
        series, volume, turned = (a, b, False) if a.is_series else (b, a, True)
        joined = series.data.join(volume.data.withColumnRenamed("value", "other"), "vox", "left").withColumn("other", F.coalesce("other", zero))
        pair = (F.col("other"), F.col("value")) if turned else (F.col("value"), F.col("other"))
        return series.with_data(joined.withColumn("value", do(*pair)).drop("other"))
    joined = a.data.join(other, a.keys, "full")
    value = do(F.coalesce("value", zero), F.coalesce("other", zero))
    out = a.with_data(joined.select(*a.keys, value.alias("value")))
    return out.sparse() if sparse else out


def roi_arith(a: Image, op: str, b: Image) -> Image:
    """Arithmetic of two regions over the voxels that both have."""
    joined = a.data.join(b.data.withColumnRenamed("value", "other"), a.keys)
    return a.with_data(joined.select(*a.keys, ARITHMETIC[op](F.col("value"), F.col("other")).alias("value")))


def map_values(image: Image, lookup: DataFrame) -> Image:
    """Replaces values by a table ``(key, new)``; values without a key become 0. Keys must differ."""
    joined = image.data.join(lookup, F.col("value") == F.col("key"), "left")
    return image.with_data(joined.select(*image.keys, F.coalesce("new", F.lit(0)).alias("value")))


def series(image: Image, voxels: DataFrame, fill: int = 0) -> DataFrame:
    """``(pos, vox, t, value)`` for a table ``(pos, vox)``; repeats and order are kept, absent voxels give ``fill``."""
    asked = voxels.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(int(image.space.dims[3])))))
    # only the voxels asked for go on, below whatever makes the image's rows
    there = image.data.join(voxels.select("vox").distinct(), "vox", "left_semi")
    found = asked.join(there, ["vox", "t"], "left")
    return found.select("pos", "vox", "t", F.coalesce("value", F.lit(fill)).alias("value"))


def series_roi(image: Image, rois: DataFrame) -> DataFrame:
    """``(roi, vox, t, value)``: the series of the voxels of regions ``(roi, vox)``, absent values 0."""
    asked = rois.select("roi", "vox").distinct()
    times = asked.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(int(image.space.dims[3])))))
    # only voxels of a region go to the join of times
    there = image.data.join(asked.select("vox").distinct(), "vox", "left_semi")
    return times.join(there, ["vox", "t"], "left").select("roi", "vox", "t", F.coalesce("value", F.lit(0)).alias("value"))


def prune_coords(points: DataFrame, min_distance: float) -> DataFrame:
    """Points ``(id, x, y, z, value)`` without a larger value strictly nearer than the distance.

    Points meet in cubes of that edge and their neighbours, so the comparison is an equi-join.
    """
    if min_distance <= 0:
        return points
    cell = [F.floor(F.col(c) / min_distance).alias(f"c{c}") for c in "xyz"]
    near = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    own = points.select("id", "x", "y", "z", "value", *cell).withColumn("o", F.explode(near))
    own = own.select("id", "x", "y", "z", "value", *[(F.col(f"c{c}") + F.col(f"o.{c}")).alias(f"c{c}") for c in "xyz"])
    other = points.select(*[F.col(c).alias(f"{c}2") for c in "xyz"], F.col("value").alias("v2"), *cell)
    close = sum(((F.col(c) - F.col(f"{c}2")) ** 2 for c in "xyz"), F.lit(0.0)) < min_distance**2
    beaten = own.join(other, ["cx", "cy", "cz"]).where((F.col("v2") > F.col("value")) & close).select("id").distinct()
    return points.join(beaten, "id", "left_anti")
