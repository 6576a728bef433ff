"""Correlation graphs between neighbouring voxels and smoothing along them."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..image import Image
from ..runtime import materialize
from .blocks import SIDE, block_of, haloed, layout_of
from .neighbourhoods import cube_offsets
from .windows import prepare_confounds, robust_weights


def correlations(image: Image, pairs: DataFrame) -> DataFrame:
    """``pairs (a, b, ...)`` with ``r`` and ``n``: Pearson's r over the times both voxels have, 0 below 3 of them."""
    x = image.data.select(F.col("vox").alias("a"), "t", F.col("value").cast("double").alias("x"))
    y = image.data.select(F.col("vox").alias("b"), "t", F.col("value").cast("double").alias("y"))
    joined = pairs.join(x, "a").join(y, ["b", "t"])
    n = F.count("*")
    cov = n * F.sum(F.col("x") * F.col("y")) - F.sum("x") * F.sum("y")
    den = F.sqrt((n * F.sum(F.col("x") ** 2) - F.sum("x") ** 2) * (n * F.sum(F.col("y") ** 2) - F.sum("y") ** 2))
    r = F.when((n < 3) | (den == 0), 0.0).otherwise(cov / den)
    return joined.groupBy(*pairs.columns).agg(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r)).alias("r"), n.alias("n"))


def affinity(r: Column, kind: str, parameter: float) -> Column:
    if kind == "power":
        return F.when(r > 0, F.pow(r, F.lit(float(parameter)))).otherwise(0.0)
    if kind == "exp":
        return F.exp(-((1 - r) ** 2) / (2 * parameter**2))
    return F.greatest(r - parameter, F.lit(0.0))


#: Numbers of a cube's array of series, and voxels of the side of a tile whose correlations are one product.
CUBE_VALUES, TILE = 1 << 22, 4


def neighbour_correlations(image: Image, window: int = 1, basis: np.ndarray | None = None, root_w: np.ndarray | None = None) -> DataFrame:
    """``(a, b, d2, r, n)`` of the voxels of a series at most ``window`` apart on each axis, both ways.

    Plain: Pearson's r over the ``n`` times that both have, 0 below 3 of them or without variance. With a ``basis`` (times x
    columns) and the roots of weights: absent values are 0, series are weighted and lose their projection on the basis. Values
    that aren't finite are absent.

    A cube of voxels with its rim is one array of series. Its tiles are multiplied with what surrounds them: one product where no
    time is missing; where some are, the products with the mask of times that give each pair its own sums.
    """
    times, spacing = int(image.space.dims[3]), image.space.spacing
    side = max(2, min(SIDE, int((CUBE_VALUES / max(1, times)) ** (1 / 3)) - 2 * window))
    layout = layout_of(image, (window,) * 3, side, times)
    rows = image.with_data(image.data.where(F.abs(F.col("value").cast("double")) < float("inf")))
    offsets = [o for o in cube_offsets(window) if any(o)]

    def pairs_of(shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in a tile, places in the tile with its rim, and numbers of offsets, of all pairs."""
        wide = tuple(n + 2 * window for n in shape)
        place = np.stack(np.unravel_index(np.arange(int(np.prod(shape))), shape), axis=1)
        near = place[:, None] + np.array(offsets)[None] + window
        b = np.ravel_multi_index(tuple(near.reshape(-1, 3).T), wide)
        return np.repeat(np.arange(len(place)), len(offsets)), b, np.tile(np.arange(len(offsets)), len(place))

    def products(x: np.ndarray, m: np.ndarray, near: np.ndarray, near_m: np.ndarray, a: np.ndarray, b: np.ndarray):
        if basis is not None:
            return (x @ near.T)[a, b], np.full(len(a), times)
        if m.all() and near_m.all():
            n, xy, sx, sy = float(times), (x @ near.T)[a, b], x.sum(axis=1)[a], near.sum(axis=1)[b]
            xx, yy = (x * x).sum(axis=1)[a], (near * near).sum(axis=1)[b]
        else:
            m, near_m = m.astype(float), near_m.astype(float)
            n, xy, sx, sy, xx, yy = ((p @ q.T)[a, b] for p, q in ((m, near_m), (x, near), (x, near_m), (m, near), (x * x, near_m), (m, near * near)))
        spread = (n * xx - sx * sx) * (n * yy - sy * sy)
        known = (np.asarray(n) >= 3) & (spread > 0)
        r = np.where(known, (n * xy - sx * sy) / np.sqrt(np.where(known, spread, 1.0)), 0.0)
        return r, np.broadcast_to(np.rint(n).astype(np.int64), r.shape)

    def run(key, table):
        block, _, _ = block_of(key[0].as_py(), table, layout, True)
        shape = block.values.shape[:3]
        x, m = block.values.reshape(-1, times), block.present.reshape(-1, times)
        there = m.any(axis=1)
        if basis is None:
            # whole numbers stay whole, so that a constant series keeps a variance of exactly 0
            x = np.where(m, x - np.rint(x.sum(axis=1) / np.maximum(1, m.sum(axis=1)))[:, None], 0.0)
        else:
            x = x * root_w
            loads = x @ basis
            rest = np.maximum(1e-12, (x * x).sum(axis=1) - (loads * loads).sum(axis=1))
            x = (x - loads @ basis.T) / np.sqrt(rest)[:, None]
        numbers = np.arange(int(np.prod(shape))).reshape(shape)
        inner, known, out = tuple(n - 2 * window for n in shape), {}, []
        for corner in itertools.product(*(range(0, n, TILE) for n in inner)):
            size = tuple(min(TILE, n - c) for n, c in zip(inner, corner))
            own = numbers[tuple(slice(window + c, window + c + s) for c, s in zip(corner, size))].ravel()
            if not there[own].any():
                continue
            near = numbers[tuple(slice(c, c + s + 2 * window) for c, s in zip(corner, size))].ravel()
            if size not in known:
                known[size] = pairs_of(size)
            a, b, o = known[size]
            both = there[own[a]] & there[near[b]]
            a, b, o = a[both], b[both], o[both]
            # places without a voxel would only make the rest look as if times were missing
            mine, theirs = np.unique(a), np.unique(b)
            r, n = products(x[own[mine]], m[own[mine]], x[near[theirs]], m[near[theirs]], np.searchsorted(mine, a), np.searchsorted(theirs, b))
            out.append((own[a], near[b], o, r, n))
        pa_, pb, o, r, n = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [()] * 5))
        met = n > 0

        def vox(place: np.ndarray) -> np.ndarray:
            i, j, k = (g + f for g, f in zip(np.unravel_index(place, shape), block.first))
            return (i + layout.dims[0] * (j + layout.dims[1] * k) + 1).astype(np.int64)

        d2 = np.array([sum((c * s) ** 2 for c, s in zip(offset, spacing)) for offset in offsets])
        columns = [vox(pa_[met]), vox(pb[met]), d2[o[met].astype(int)], np.clip(r[met].astype(float), -0.999999, 0.999999), n[met].astype(np.int64)]
        return pa.table([pa.array(c) for c in columns], names=["a", "b", "d2", "r", "n"])

    return haloed(rows, layout).groupBy("block").applyInArrow(run, "a long, b long, d2 double, r double, n long")


def _of_run(given, k: int, runs: int):
    """The entry of run ``k`` of a list with one for each run, or with one for all."""
    if given is None:
        return None
    if len(given) not in (1, runs):
        raise ValueError(f"{len(given)} entries for {runs} runs")
    return given[k if len(given) > 1 else 0]


def run_weights_of(image: Image, weights, robust: str, robust_c: float | None) -> np.ndarray | None:
    """A run's weight for each time: those given, cut to 0 to 1, times the robust ones; None where there are neither."""
    n = int(image.space.dims[3])
    if weights is not None:
        weights = np.asarray(weights, float)
        if len(weights) != n:
            raise ValueError(f"{len(weights)} weights for {n} times")
        weights = np.clip(np.where(np.isfinite(weights), weights, 0.0), 0.0, 1.0)
    if robust != "none":
        extra = np.ones(n)
        for r in robust_weights(image, robust, robust_c).collect():  # a row a time
            extra[r.t - 1] = r.weight
        weights = extra if weights is None else weights * extra
    return weights


def pooled_correlations(
    runs: list[Image], mask: Image | None = None, window: int = 1, run_weights: list[float] | None = None, time_weights: list | None = None,
    confounds: list | None = None, robust: str = "none", robust_c: float | None = None,
) -> DataFrame:
    """``(a, b, d2, z, w, n, of)``: each pair's sum of weighted Fisher's z, of weights and the number of runs, with ``of``, the map of
    a run's number (from 0) to its own ``(z, w)``. Each run's correlations are computed once."""
    first = runs[0]
    for run in runs:
        first.space.require_same_grid(run.space)
    voxels = (mask or first).data.select("vox").distinct()
    parts = None
    for k, run in enumerate(runs):
        given = _of_run(run_weights, k, len(runs))
        nuisance = _of_run(confounds, k, len(runs))
        weights = run_weights_of(run, _of_run(time_weights, k, len(runs)), robust, robust_c)
        inside = run.with_data(run.data.join(voxels, "vox", "left_semi"))
        if weights is not None or (nuisance is not None and np.asarray(nuisance).size):
            n = int(run.space.dims[3])
            weights = np.ones(n) if weights is None else weights
            [basis] = prepare_confounds(np.zeros((n, 0)) if nuisance is None else nuisance, [n], weights)
            found, weight = neighbour_correlations(inside, window, basis, np.sqrt(weights)), F.lit(max(1.0, n - 3.0))
        else:
            found = neighbour_correlations(inside, window)
            weight = F.greatest(F.lit(1.0), F.col("n") - 3.0)
        weight = weight if given is None else F.lit(float(given))
        part = found.select("a", "b", "d2", F.lit(k).alias("run"), (weight * F.atanh("r")).alias("z"), weight.alias("w"))
        parts = part if parts is None else parts.union(part)
    own = F.map_from_entries(F.collect_list(F.struct("run", F.struct("z", "w"))))  # an entry a run
    return parts.groupBy("a", "b", "d2").agg(F.sum("z").alias("z"), F.sum("w").alias("w"), F.count("*").alias("n"), own.alias("of"))


def _edges(pooled: DataFrame, voxels: DataFrame, leave_out: int | None, spatial_sigma: float, corr_map: str, corr_param: float, topk: int, add_self: bool) -> DataFrame:
    """The edges from pooled correlations, less those of a run."""
    z, w = F.col("z"), F.col("w")
    if leave_out is not None:
        own = F.col("of")[F.lit(leave_out)]
        pooled = pooled.where((F.col("n") > 1) | own.isNull())
        z, w = z - F.coalesce(own["z"], F.lit(0.0)), w - F.coalesce(own["w"], F.lit(0.0))
    r = F.tanh(z / w)
    weighed = pooled.select("a", "b", (affinity(r, corr_map, corr_param) * F.exp(-F.col("d2") / (2 * spatial_sigma**2))).alias("w")).where("w > 0")
    if topk > 0:
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))
        weighed = weighed.withColumn("rank", rank).where(F.col("rank") <= topk)
    best = weighed.select("a", "b", "w")
    if add_self:
        best = best.union(voxels.select("vox", "vox", F.lit(1e-12)))
    total = F.sum("w").over(Window.partitionBy("a"))
    return best.select(F.col("a").alias("vox"), F.col("b").alias("near"), (F.col("w") / total).alias("w"))


def correlation_graph(
    runs: list[Image], mask: Image | None = None, window: int = 1, spatial_sigma: float = 2.0, corr_map: str = "power", corr_param: float = 2.0,
    topk: int = 16, add_self: bool = True, run_weights: list[float] | None = None, time_weights: list | None = None, confounds: list | None = None,
    robust: str = "none", robust_c: float | None = None, leave_out: int | None = None,
) -> DataFrame:
    """``(vox, near, w)``: edges to the ``topk`` neighbours of the largest weight (0: to all), rows summing to 1.

    The runs' correlations are pooled as Fisher's z, each weighed by ``run_weights``, or by its length less 3, at least 1.
    ``time_weights`` (one per time and run, 0 to 1), ``confounds`` (times x columns per run) and ``robust`` weights from DVARS
    (``huber``, ``tukey``) make them partial correlations of weighted series, an intercept always taken out; their run weight then
    counts all times. ``leave_out`` names a run, from 0, whose own correlations take no part.
    """
    _check_graph(runs, robust, leave_out)
    pooled = pooled_correlations(runs, mask, window, run_weights, time_weights, confounds, robust, robust_c)
    voxels = (mask or runs[0]).data.select("vox").distinct()
    return _edges(pooled, voxels, leave_out, spatial_sigma, corr_map, corr_param, topk, add_self)


def leave_one_out_graphs(
    runs: list[Image], mask: Image | None = None, window: int = 1, spatial_sigma: float = 2.0, corr_map: str = "power", corr_param: float = 2.0,
    topk: int = 16, add_self: bool = True, robust: str = "none", **options,
) -> list[DataFrame]:
    """The graph of each run from all others; correlations are pooled once and a run's own are subtracted."""
    _check_graph(runs, robust, 0)
    pooled = materialize(pooled_correlations(runs, mask, window, robust=robust, **options), "pooled")
    voxels = materialize((mask or runs[0]).data.select("vox").distinct(), "voxels")
    return [_edges(pooled, voxels, k, spatial_sigma, corr_map, corr_param, topk, add_self) for k in range(len(runs))]


def _check_graph(runs: list[Image], robust: str, leave_out: int | None) -> None:
    if robust not in ("none", "huber", "tukey"):
        raise ValueError(f"robust is none, huber or tukey, not {robust}")
    if leave_out is not None and len(runs) < 2:
        raise ValueError("no run is left")


def graph_smooth(image: Image, graph: DataFrame, passes: int = 1, strength: float = 1.0) -> Image:
    """``(1 - strength) x + strength W x`` over the edges, at each time, ``passes`` times."""
    now = image.data
    for _ in range(passes):
        sent = graph.join(now.withColumnRenamed("vox", "near"), "near").withColumn("part", F.col("w") * F.col("value"))
        moved = sent.groupBy(*image.keys).agg(F.sum("part").alias("moved"))
        value = F.col("value") * (1 - strength) + F.coalesce("moved", F.lit(0.0)) * strength
        now = now.join(moved, image.keys, "left").select(*image.keys, value.alias("value"))
    return image.with_data(now)


def graph_filter(runs: list[Image], mask: Image | None = None, spatial_sigma: float = 2.0, window: int | None = None, passes: int = 1, strength: float = 1.0, leave_one_out: bool = False, **options) -> list[Image]:
    """Builds the graph and smooths each run along it; with ``leave_one_out`` a run's graph comes from the others."""
    window = window or max(1, math.ceil(2 * spatial_sigma / min(runs[0].space.spacing)))
    if not leave_one_out or len(runs) == 1:
        graph = correlation_graph(runs, mask, window, spatial_sigma, **options)
        return [graph_smooth(r, graph, passes, strength) for r in runs]
    every = leave_one_out_graphs(runs, mask, window, spatial_sigma, **options)
    return [graph_smooth(r, graph, passes, strength) for r, graph in zip(runs, every)]
