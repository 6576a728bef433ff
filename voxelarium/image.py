"""An image is a geometry and a DataFrame of voxels.

A volume has a row ``(vox, value)`` for each voxel, a series of volumes a row ``(vox, t, value)``. A sparse image
simply lacks the rows of voxels that are 0; a mask has the rows of its voxels and no value. Every operator gives
a new image over a lazy plan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .space import Space


@dataclass(frozen=True)
class Image:
    space: Space
    data: DataFrame
    labels: tuple[str, ...] = ()

    @property
    def keys(self) -> list[str]:
        return ["vox", "t"] if self.is_series else ["vox"]

    @property
    def is_series(self) -> bool:
        return "t" in self.data.columns

    def with_data(self, data: DataFrame, space: Space | None = None) -> Image:
        return replace(self, data=data, space=space or self.space)

    def map(self, then) -> Image:
        """The image with ``then(value)`` as its values."""
        return self.with_data(self.data.withColumn("value", then(F.col("value"))))

    def gridded(self) -> DataFrame:
        """The rows with their ``i``, ``j`` and ``k``."""
        i, j, k = self.space.to_grid(F.col("vox"))
        return self.data.withColumns({"i": i, "j": j, "k": k})

    def with_coords(self) -> DataFrame:
        """The rows with grid and world coordinates."""
        x, y, z = self.space.to_coord(F.col("i"), F.col("j"), F.col("k"))
        return self.gridded().withColumns({"x": x, "y": y, "z": z})

    def dense(self, fill=0) -> Image:
        """All voxels (of all times), those without a row with ``fill``."""
        spark = self.data.sparkSession
        grid = spark.range(1, self.space.n_vox + 1).withColumnRenamed("id", "vox")
        if self.is_series:
            grid = grid.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(int(self.space.dims[3])))))
        full = grid.join(self.data, self.keys, "left").withColumn("value", F.coalesce("value", F.lit(fill)))
        return self.with_data(full.select(*self.keys, "value"))

    def sparse(self) -> Image:
        """Without the rows of value 0."""
        return self.with_data(self.data.where("value <> 0"))

    def mask(self, where: Column | None = None) -> Image:
        """The voxels for which ``where`` holds, or those above 0."""
        return self.with_data(self.data.where(F.col("value") > 0 if where is None else where).select("vox").distinct())

    def series_arrays(self) -> DataFrame:
        """``(vox, times, values)``, one row a voxel, in order of time."""
        rows = F.sort_array(F.collect_list(F.struct("t", "value")))
        return self.data.groupBy("vox").agg(rows.alias("r")).select("vox", F.col("r.t").alias("times"), F.col("r.value").alias("values"))

    def to_numpy(self) -> np.ndarray:
        """A local array, for small images and tests."""
        dims = self.space.space_dims if not self.is_series else (*self.space.space_dims, int(self.space.dims[3]))
        out = np.zeros(dims)
        pdf = self.data.toPandas()
        at = np.unravel_index(pdf["vox"].to_numpy(np.int64) - 1, dims[:3], order="F")
        if self.is_series:
            at = (*at, pdf["t"].to_numpy(np.int64) - 1)
        out[at] = pdf["value"].to_numpy(float)
        return out


def from_numpy(spark: SparkSession, array: np.ndarray, space: Space | None = None) -> Image:
    """An image of a small local array of 3 or 4 dimensions."""
    import pandas as pd

    array = np.asarray(array)
    n = int(np.prod(array.shape[:3]))
    pdf = pd.DataFrame({"vox": np.tile(np.arange(1, n + 1), array.shape[3] if array.ndim == 4 else 1)})
    if array.ndim == 4:
        pdf["t"] = np.repeat(np.arange(1, array.shape[3] + 1), n).astype("int32")
    pdf["value"] = array.reshape(-1, order="F").astype(float)
    return Image(space or Space(array.shape), spark.createDataFrame(pdf))
