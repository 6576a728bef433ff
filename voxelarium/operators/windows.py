"""Analytics along time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..image import Image


def scale_series(image: Image, center: bool = True, scale: bool = True) -> Image:
    """Centers each voxel's series and divides by its deviation (n - 1); a deviation of 0 divides by 1.

    Without centering the divisor is the root of the sum of squares over n - 1.
    """
    w = Window.partitionBy("vox")
    v = F.col("value").cast("double")
    mid = F.avg(v).over(w) if center else F.lit(0.0)
    sd = F.stddev_samp(v).over(w) if center else F.sqrt(F.sum(v * v).over(w) / (F.count("*").over(w) - 1))
    by = F.when(sd.isNull() | (sd == 0), 1.0).otherwise(sd) if scale else F.lit(1.0)
    return image.with_data(image.data.withColumn("value", (v - mid) / by))


def split_scale(image: Image, factor: DataFrame, center: bool = True, scale: bool = True) -> Image:
    """As ``scale_series`` within the levels of ``(t, level)``; a deviation of 0 gives NaN."""
    w = Window.partitionBy("vox", "level")
    v = F.col("value").cast("double")
    mid = F.avg(v).over(w) if center else F.lit(0.0)
    sd = F.stddev_samp(v).over(w)
    value = (v - mid) if not scale else F.when(sd == 0, F.lit(float("nan"))).otherwise((v - mid) / sd)
    return image.with_data(image.data.join(factor, "t").withColumn("value", value).select(*image.keys, "value"))


def differences(image: Image) -> DataFrame:
    """``(vox, t, d)``: the change from the voxel's row before."""
    before = F.lag("value").over(Window.partitionBy("vox").orderBy("t"))
    return image.data.withColumn("d", F.col("value") - before).where(F.col("d").isNotNull()).select("vox", "t", "d")


def dvars(image: Image) -> DataFrame:
    """``(t, dvars)``: the root mean square over voxels of the change from one volume to the next."""
    return differences(image).groupBy("t").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("dvars"))


def robust_z(frame: DataFrame, column: str) -> DataFrame:
    """``frame`` with ``z``, the distance from the median in units of 1.4826 times the median absolute deviation."""
    mid = frame.agg(F.median(column).alias("m"))
    off = frame.crossJoin(F.broadcast(mid)).withColumn("off", F.col(column) - F.col("m"))
    spread = off.agg(F.median(F.abs("off")).alias("mad"), F.stddev_samp("off").alias("sd"))
    scale = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return off.crossJoin(F.broadcast(spread)).withColumn("z", F.col("off") / scale).drop("m", "off", "mad", "sd")


def robust_weights(image: Image, method: str = "huber", c: float | None = None) -> DataFrame:
    """``(t, weight)`` by Huber's or Tukey's rule on the robust z of DVARS; the first volume gets 1."""
    z = F.abs("z")
    if method == "huber":
        weight = F.least(F.lit(1.0), (c or 1.345) / F.greatest(z, F.lit(1e-12)))
    else:
        u = z / (c or 4.685)
        weight = F.when(u < 1, (1 - u * u) ** 2).otherwise(0.0)
    weighed = robust_z(dvars(image), "dvars").select("t", weight.alias("weight"))
    times = image.data.select("t").distinct()
    return times.join(weighed, "t", "left").select("t", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def time_weights(
    frame: DataFrame, fd: str | None = None, dvars_col: str | None = None, spike: str | None = None, fd_thr: float = 0.5,
    dvars_z: float = 2.5, spike_z: float = 5.0, fd_soft: float = 0.1, dvars_soft: float = 0.25, combine: str = "min",
) -> DataFrame:
    """``frame`` with ``weight``: soft censoring of times by motion, DVARS and spikes, in 0 to 1."""

    def falling(x: Column, at: float, soft: float) -> Column:
        return 1 / (1 + F.exp((x - at) / soft))

    parts, out = [], frame
    if fd:
        parts.append(falling(F.col(fd), fd_thr, fd_soft))
    for name, at, soft in ((dvars_col, dvars_z, dvars_soft), (spike, spike_z, 0.5)):
        if name:
            out = robust_z(out, name).withColumnRenamed("z", f"z_{name}")
            z = F.col(f"z_{name}")
            parts.append(falling(z if name == dvars_col else F.abs(z), at, soft))
    if not parts:
        return out.withColumn("weight", F.lit(1.0))
    weight = parts[0]
    for p in parts[1:]:
        weight = F.least(weight, p) if combine == "min" else weight * p
    return out.withColumn("weight", F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))).select(*frame.columns, "weight")


def prepare_confounds(confounds: np.ndarray, run_lengths: list[int], weights: np.ndarray | None = None, intercept: bool = True, center: bool = True, scale: bool = False) -> list[np.ndarray]:
    """An orthonormal basis of the nuisance regressors of each run, rows weighted, dependent columns dropped; small (times x regressors), so local."""
    out, at = [], 0
    for n in run_lengths:
        x = np.array(confounds[at : at + n], float).reshape(n, -1)
        w = np.ones(n) if weights is None else np.asarray(weights[at : at + n], float)
        w = np.where(np.isfinite(w), np.maximum(w, 0.0), 0.0)
        at += n
        if center and x.shape[1]:
            x = x - x.mean(axis=0)
        if scale and x.shape[1]:
            sd = x.std(axis=0, ddof=1)
            x = x / np.where(sd > 0, sd, 1)
        if intercept:
            x = np.column_stack([np.ones(n), x])
        u, s, _ = np.linalg.svd(np.sqrt(w)[:, None] * x, full_matrices=False)
        out.append(u[:, s > 1e-10 * max(1.0, s.max(initial=0.0))])
    return out
