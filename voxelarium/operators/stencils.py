"""Filters over neighbourhoods.

A stencil is a scatter: each voxel sends its value, weighted, to the voxels that look at it, and sums come
together by voxel with partial aggregation before the shuffle. Gaussian and box kernels are separable, so three
passes along the axes replace one over the cube. Filters whose weights depend on both values (bilateral, non-local
means) take cubes of voxels with a rim instead, see ``blocks``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..image import Image
from ..runtime import materialize, quantiles
from .blocks import Block, map_blocks
from .neighbourhoods import cube_offsets, shifted


def _pass(frame: DataFrame, space, axis: int, taps: list[float], keys: list[str], columns: list[str]) -> DataFrame:
    """Sums of ``columns`` along one axis, weighted by taps that reach equally far both ways."""
    w = len(taps) // 2
    a, b, _ = space.space_dims
    stride, size = ((1, a), (a, b), (a * b, space.space_dims[2]))[axis]
    at = F.pmod(F.floor((F.col("vox") - 1) / stride), F.lit(size))
    tap = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(float(t)).alias("w")) for o, t in zip(range(-w, w + 1), taps)])
    sent = frame.withColumn("tap", F.explode(tap)).where((at + F.col("tap.o")).between(0, size - 1))
    moved = sent.select((F.col("vox") + F.col("tap.o") * stride).cast("long").alias("vox"), *keys[1:], *[(F.col(c) * F.col("tap.w")).alias(c) for c in columns])
    return moved.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def _separable(image: Image, taps: list[list[float]], columns: dict[str, Column]) -> DataFrame:
    frame = image.data.select(*image.keys, *[c.cast("double").alias(n) for n, c in columns.items()])
    for axis in range(3):
        frame = _pass(frame, image.space, axis, taps[axis], image.keys, list(columns))
    return frame


def _within(frame: DataFrame, image: Image, mask: Image | None) -> DataFrame:
    return frame.join((mask or image).data.select("vox").distinct(), "vox", "left_semi")


def gaussian_taps(spacing: float, sigma: float, width: int) -> list[float]:
    raw = [math.exp(-((o * spacing) ** 2) / (2 * sigma * sigma)) for o in range(-width, width + 1)]
    return [x / sum(raw) for x in raw]


def gaussian_blur(image: Image, mask: Image | None = None, sigma: float = 2.0, fwhm: float | None = None, window: int | None = None, normalize: bool = True, truncate: float = 4.0) -> Image:
    """Gaussian smoothing with sigma (or the width at half height) in world units.

    Normalised: the weighted mean of in-mask values, at in-mask voxels. Otherwise: the weighted sum with zeros outside.
    """
    if fwhm is not None:
        sigma = fwhm / (2 * math.sqrt(2 * math.log(2)))
    space = image.space
    width = window if window is not None else math.floor(truncate * sigma / min(space.spacing) + 0.5)
    width = max(0, min(width, max(space.space_dims)))
    taps = [gaussian_taps(s, sigma, width) for s in space.spacing]
    source = image if mask is None else image.with_data(_within(image.data, image, mask))
    if not normalize:
        source = image
    blurred = _separable(source, taps, {"v": F.col("value"), "m": F.lit(1.0)})
    value = F.col("v") / F.col("m") if normalize else F.col("v")
    return image.with_data(_within(blurred.select(*image.keys, value.alias("value")), image, mask))


def box_blur(image: Image, window: int = 1, mask: Image | None = None) -> Image:
    """The mean over a cube of ``2 * window + 1``; what lies outside counts as 0 and is counted."""
    side = 2 * window + 1
    summed = _separable(image, [[1.0] * side] * 3, {"v": F.col("value")})
    return image.with_data(_within(summed.select(*image.keys, (F.col("v") / side**3).alias("value")), image, mask))


def box_moments(image: Image, window: int) -> DataFrame:
    """``(vox, m, q)``: box means of the values and of their squares."""
    side = 2 * window + 1
    v = F.col("value").cast("double")
    summed = _separable(image, [[1.0] * side] * 3, {"m": v, "q": v * v})
    return summed.select(*image.keys, (F.col("m") / side**3).alias("m"), (F.col("q") / side**3).alias("q"))


def guided_filter(image: Image, radius: int = 4, epsilon: float = 0.49) -> Image:
    """The self-guided filter over the nonzero voxels: locally linear, keeps edges."""
    inside = image.with_data(image.data.where("value <> 0"))
    var = F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))
    a = var / (var + epsilon)
    coefficients = _within(box_moments(image, radius), inside, None).select("vox", a.alias("a"), (F.col("m") - a * F.col("m")).alias("b"))
    side = 2 * radius + 1
    frame = coefficients
    for axis in range(3):
        frame = _pass(frame, image.space, axis, [1.0] * side, ["vox"], ["a", "b"])
    joined = inside.data.join(frame, "vox")
    return image.with_data(joined.select("vox", ((F.col("a") * F.col("value") + F.col("b")) / side**3).alias("value")))


def bilateral_filter(image: Image, mask: Image | None = None, spatial_sigma: float = 2.0, intensity_sigma: float = 1.0, window: int = 1, range_scale: float | None = None) -> Image:
    """Edge-preserving smoothing by distance in space and in value, among in-mask neighbours.

    The range is scaled by the sample deviation over the mask, or by ``range_scale``.
    """
    inside = image if mask is None else image.with_data(_within(image.data, image, mask))
    if range_scale is None:
        range_scale = inside.data.agg(F.stddev_samp("value")).first()[0] or 0.0
    floor = max(2 * intensity_sigma**2 * range_scale**2, 1e-12)
    return image.with_data(map_blocks(inside, (window,) * 3, _bilateral(window, 0, image.space.spacing, spatial_sigma, 1.0, floor)))


def _bilateral(window: int, time_window: int, spacing: tuple[float, ...], spatial_sigma: float, temporal_sigma: float, floor: float):
    """The weighted mean of what is present around each place of a block."""

    def run(block: Block) -> dict[str, np.ndarray]:
        center = block.values[block.own]
        top, total = np.zeros_like(center), np.zeros_like(center)
        for x, y, z in cube_offsets(window):
            d2 = sum((o * s) ** 2 for o, s in zip((x, y, z), spacing))
            for dt in range(-time_window, time_window + 1):
                other = block.moved(block.values, (x, y, z, dt))
                near = math.exp(-d2 / (2 * spatial_sigma**2)) * math.exp(-(dt**2) / (2 * temporal_sigma**2))
                w = np.where(block.moved(block.present, (x, y, z, dt)), near * np.exp(-((other - center) ** 2) / floor), 0.0)
                top += w * other
                total += w
        with np.errstate(invalid="ignore"):
            return {"value": top / total}

    return run


def bilateral_filter_4d(image: Image, mask: Image | None = None, spatial_sigma: float = 2.0, intensity_sigma: float = 1.0, temporal_sigma: float = 1.0, spatial_window: int = 1, temporal_window: int = 1, temporal_spacing: float = 1.0) -> Image:
    """As ``bilateral_filter`` with taps in time too; the deviation is that of the population, outside voxels pass through."""
    inside = image if mask is None else image.with_data(_within(image.data, image, mask))
    sd = inside.data.agg(F.stddev_pop("value")).first()[0] or 0.0
    floor = max(2 * intensity_sigma**2 * sd**2, 1e-12)
    f = _bilateral(spatial_window, temporal_window, image.space.spacing, spatial_sigma, temporal_sigma / temporal_spacing, floor)
    out = map_blocks(inside, (spatial_window,) * 3 + (temporal_window,), f)
    if mask is None:
        return image.with_data(out)
    rest = image.data.join(mask.data.select("vox").distinct(), "vox", "left_anti").select("vox", "t", F.col("value").cast("double").alias("value"))
    return image.with_data(out.unionByName(rest))


def kernel_weights(dims: tuple[int, int, int], spacing: tuple[float, ...], density=None) -> tuple[list[tuple[int, int, int]], list[float]]:
    """Offsets and weights of a kernel of odd dimensions: a density of the distance, the normal one if none, summing to 1."""
    import itertools

    density = density or (lambda d: math.exp(-d * d / 2) / math.sqrt(2 * math.pi))
    offsets = list(itertools.product(*[range(-(d // 2), d // 2 + 1) for d in dims]))
    raw = [density(math.sqrt(sum((x * s) ** 2 for x, s in zip(o, spacing)))) for o in offsets]
    return offsets, [x / sum(raw) for x in raw]


def map_kernel(image: Image, offsets: list[tuple[int, int, int]], weights: list[float], mask: Image | None = None) -> Image:
    """The weighted sum around each voxel of the mask; taps outside are skipped and weights not renormalised.

    Without a mask voxels whose kernel would leave the grid are left out.
    """
    sent = shifted(image, [tuple(-x for x in o) for o in offsets], weights)
    summed = sent.groupBy(F.col("near").alias("vox")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    if mask is not None:
        return image.with_data(_within(summed, image, mask))
    reach = [max(abs(o[n]) for o in offsets) for n in range(3)]
    i, j, k = image.space.to_grid(F.col("vox"))
    inner = F.lit(True)
    for x, r, d in zip((i, j, k), reach, image.space.space_dims):
        inner = inner & x.between(1 + r, d - r)
    return image.with_data(summed.where(inner))


def embed_kernel(image: Image, offsets, weights, center: tuple[int, int, int]) -> Image:
    """A kernel set at a voxel, as a sparse volume."""
    rows = [(image.space.space_dims, o, w) for o, w in zip(offsets, weights)]
    spark, (a, b, c) = image.data.sparkSession, image.space.space_dims
    placed = [(tuple(x + y for x, y in zip(center, o)), w) for _, o, w in rows]
    inside = [(p[0] + (p[1] - 1) * a + (p[2] - 1) * a * b, float(w)) for p, w in placed if 1 <= p[0] <= a and 1 <= p[1] <= b and 1 <= p[2] <= c]
    return image.with_data(spark.createDataFrame(inside, "vox long, value double"))


def embed_kernels(centers: Image, offsets, weights) -> DataFrame:
    """``(center, vox, value)``: a kernel set at each voxel, cut off at the bounds of the grid."""
    placed = shifted(centers.with_data(centers.data.select("vox")), offsets, [float(w) for w in weights])
    return placed.select(F.col("vox").alias("center"), F.col("near").alias("vox"), F.col("w").alias("value"))


def despike(image: Image, mask: Image, k: float = 3.5, window: int = 1) -> Image:
    """Values further than k deviations (by the median) from their box mean become the median of good in-mask neighbours."""
    inside = image.with_data(_within(image.data, image, mask))
    off = inside.data.join(box_blur(image, window, mask).data.withColumnRenamed("value", "m"), "vox").withColumn("off", F.abs(F.col("value") - F.col("m")))
    off = materialize(off, "off")
    center = quantiles(off, F.col("value") - F.col("m"), [0.5])
    if center is None:
        return inside
    [mad] = quantiles(off, F.abs(F.col("value") - F.col("m") - F.lit(center[0])), [0.5])
    mad *= 1.4826
    if not mad:
        return inside
    flagged = off.withColumn("bad", F.col("off") > k * mad).select("vox", "value", "bad")
    good = inside.with_data(flagged.where("not bad").select("vox", "value"))
    bad = inside.with_data(flagged.where("bad").select("vox", "value"))
    offsets = [o for o in cube_offsets(window) if any(o)]
    sent = shifted(good, offsets).select(F.col("near").alias("vox"), F.col("value").alias("other"))
    fixed = sent.join(bad.data.select("vox"), "vox", "left_semi").groupBy("vox").agg(F.median("other").alias("new"))
    value = F.when(F.col("bad"), F.coalesce("new", "value")).otherwise(F.col("value"))
    return image.with_data(flagged.join(fixed, "vox", "left").select("vox", value.cast("double").alias("value")))


def enhance_stat_map(image: Image, mask: Image, method: str = "guided", radius: int = 2, gain: float = 1.0, spike_k: float | None = 3.5, epsilon: float = 0.49, spatial_sigma: float = 2.0, intensity_sigma: float = 1.0) -> Image:
    """Despikes, smooths, and sharpens where the local variance exceeds the noise."""
    clean = despike(image, mask, spike_k) if spike_k else image.with_data(_within(image.data, image, mask))
    rough = clean.data.join(box_blur(clean, 1, mask).data.withColumnRenamed("value", "m"), "vox").withColumn("r", F.col("value") - F.col("m"))
    rough = materialize(rough.select("r"), "rough")
    mid = quantiles(rough, F.col("r"), [0.5])
    mad = 1.4826 * quantiles(rough, F.abs(F.col("r") - mid[0]), [0.5])[0] if mid else None
    noise = mad or rough.agg(F.stddev_samp("r")).first()[0] or 1.0
    base = {
        "guided": lambda: guided_filter(clean, radius, epsilon),
        "bilateral": lambda: bilateral_filter(clean, mask, spatial_sigma, intensity_sigma, radius),
        "gaussian": lambda: gaussian_blur(clean, mask, spatial_sigma),
    }[method]()
    local = box_moments(base, radius).select("vox", F.greatest(F.col("q") - F.col("m") ** 2, F.lit(0.0)).alias("var"))
    wide = box_blur(base, 2 * radius, mask).data.withColumnRenamed("value", "wide")
    joined = base.data.join(local, "vox").join(wide, "vox")
    weight = F.col("var") / (F.col("var") + noise**2)
    return image.with_data(joined.select("vox", (F.col("value") + gain * weight * (F.col("value") - F.col("wide"))).alias("value")))


def patch_set(image: Image, dims: tuple[int, int, int], mask: Image | None = None) -> DataFrame:
    """``(center, pos, value)``: centered patches of odd dimensions, coordinates clamped to the bounds."""
    import itertools

    offsets = [tuple(reversed(o)) for o in itertools.product(*[range(-(d // 2), d // 2 + 1) for d in reversed(dims)])]
    taps = F.array(*[F.struct(F.lit(p).alias("pos"), *[F.lit(v).alias(n) for n, v in zip("xyz", o)]) for p, o in enumerate(offsets, 1)])
    centers = (mask or image).gridded().select(F.col("vox").alias("center"), "i", "j", "k").withColumn("o", F.explode(taps))
    at = [F.least(F.greatest(F.col(g) + F.col(f"o.{n}"), F.lit(1)), F.lit(d)) for g, n, d in zip("ijk", "xyz", image.space.space_dims)]
    asked = centers.select("center", F.col("o.pos").alias("pos"), image.space.to_index(*at).alias("vox"))
    return asked.join(image.data, "vox", "left").select("center", "pos", F.coalesce("value", F.lit(0)).alias("value"))


def laplace_enhance(image: Image, mask: Image, levels: int = 2, patch: int = 3, search: int = 2, h: float = 0.7, gains: tuple[float, ...] | None = None) -> Image:
    """Multi-level detail enhancement by non-local means.

    Voxels are linked to those in their search cube by the similarity of their patches, K = exp(-|P - Q|^2 / h^2). The
    level's weights are the powers K, K^2, K^4 and so on; smoothing with W = I + a (K - diag(row sums)), a one over the
    mean row sum of the voxels that have links. Details between levels pass a sigmoid and are added to the mapped base.

    A voxel of the mask without a row has no links. Patches and links stay within a cube and its rim, so only the cubes' copies are shuffled, and each level's mean is one number.
    """
    low, high = image.data.agg(F.min("value"), F.max("value")).first()
    span = float(high - low) if high is not None and high > low else 1.0
    low = float(low or 0.0)
    half = patch // 2
    marked = image.data.join(mask.data.select("vox").distinct().withColumn("m", F.lit(1.0)), "vox", "left")
    share = (F.col("value") - F.lit(low)) / F.lit(span)
    unit = image.with_data(marked.select("vox", share.alias("value"), F.coalesce("m", F.lit(0.0)).alias("m")))

    def run(block: Block) -> dict[str, np.ndarray]:
        around, values, linked = block.clamped(), block.values, block.extra["m"] > 0
        shape = tuple(n - 2 * half for n in around.shape[:3])
        taps = [tuple(slice(half + o, half + o + n) for o, n in zip(offset, shape)) for offset in cube_offsets(half)]
        patches = np.stack([around[(*t, 0)] for t in taps], axis=-1)
        cut = (*[slice(half, n - half) for n in around.shape[:3]], 0)
        values, linked = values[cut], linked[cut]
        own = tuple(slice(search, n - search) for n in shape)
        out = {name: np.zeros(values[own].shape) for name in ("links", *[f"{c}{n}" for n in range(levels) for c in ("d", "y")])}
        for offset in cube_offsets(search):
            if not any(offset):
                continue
            there = tuple(slice(search + o, n - search + o) for o, n in zip(offset, shape))
            k = np.exp(-((patches[own] - patches[there]) ** 2).sum(axis=-1) / h**2)
            k = np.where(linked[there] & linked[own] & (k > 1e-8), k, 0.0)
            out["links"] += k > 0
            for n in range(levels):
                power = k ** (2**n)
                out[f"d{n}"] += power
                out[f"y{n}"] += power * values[there]
        return {"unit": values[own][..., None], "m": linked[own][..., None].astype(float)} | {name: v[..., None] for name, v in out.items()}

    columns = ["unit", "m", "links", *[f"{c}{n}" for n in range(levels) for c in ("d", "y")]]
    found = map_blocks(unit, (search + half,) * 3, run, ", ".join(f"{c} double" for c in columns), ("m",))
    found = materialize(found.where("m > 0").drop("m"), "linked")
    means = found.where("links > 0").agg(*[F.avg(f"d{n}") for n in range(levels)]).first()
    gains = gains or tuple([1.0] * (levels + 1))
    smooth = [F.col("unit") + (F.col(f"y{n}") - F.col(f"d{n}") * F.col("unit")) / F.lit(means[n] or 1.0) for n in range(levels)]
    detail = F.lit(0.0)
    for level in range(1, levels):
        detail = detail + 2 / (1 + F.exp(-gains[level] * (smooth[level] - smooth[level - 1]))) - 1
    detail = detail + 2 / (1 + F.exp(-gains[levels] * (F.col("unit") - smooth[-1]))) - 1
    base = 1 / (1 + F.exp(-gains[0] * (smooth[0] - 0.5) * 4))
    return image.with_data(found.select("vox", (base + detail).alias("value")))
