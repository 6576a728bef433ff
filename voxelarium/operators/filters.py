"""Predicates and masks."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..image import Image
from ..runtime import materialize

COMPARISONS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


def compare(a: Image, op: str, b: Image | float) -> Image:
    """The mask of voxels for which the comparison holds; a voxel without a row is 0."""
    test = COMPARISONS[op]
    if isinstance(b, Image):
        a.space.require_same_grid(b.space)
        joined = a.data.join(b.data.withColumnRenamed("value", "other"), a.keys, "full")
        holds = test(F.coalesce("value", F.lit(0)), F.coalesce("other", F.lit(0)))
        return a.with_data(joined.where(holds).select(*a.keys))
    image = a.dense() if test(0, b) else a  # where 0 passes too, absent voxels do
    return image.with_data(image.data.where(test(F.col("value"), F.lit(b))).select(*image.keys))


def mask_and(a: Image, b: Image) -> Image:
    a.space.require_same_grid(b.space)
    return a.with_data(a.data.select("vox").join(b.data.select("vox"), "vox", "left_semi"))


def mask_or(a: Image, b: Image) -> Image:
    a.space.require_same_grid(b.space)
    return a.with_data(a.data.select("vox").union(b.data.select("vox")).distinct())


def mask_not(a: Image) -> Image:
    grid = a.data.sparkSession.range(1, a.space.n_vox + 1).withColumnRenamed("id", "vox")
    return a.with_data(grid.join(a.data.select("vox"), "vox", "left_anti"))


def apply_mask(image: Image, mask: Image, dense: bool = False) -> Image:
    """Voxels within the mask; with ``dense`` those outside stay, with value 0."""
    image.space.require_same_grid(mask.space)
    inside = mask.data.select("vox").distinct()
    if not dense:
        return image.with_data(image.data.join(inside, "vox", "left_semi"))
    marked = image.data.join(inside.withColumn("m", F.lit(True)), "vox", "left")
    zero = F.lit(0).cast(image.data.schema["value"].dataType)
    return image.with_data(marked.withColumn("value", F.when(F.col("m"), F.col("value")).otherwise(zero)).drop("m"))


def sub_box(image: Image, i: tuple[int, int], j: tuple[int, int], k: tuple[int, int]) -> Image:
    """Rows of a box given by its first and last voxel on each axis."""
    g = image.gridded()
    inside = F.col("i").between(*i) & F.col("j").between(*j) & F.col("k").between(*k)
    return image.with_data(g.where(inside).select(*image.data.columns))


def slice_of(image: Image, level: int, along: int = 3) -> "Image":
    """``(i, j, value)`` of one slice, the two other axes in order."""
    axes = [a for n, a in enumerate("ijk", 1) if n != along]
    at = "ijk"[along - 1]
    rows = image.gridded().where(F.col(at) == level)
    return rows.select(F.col(axes[0]).alias("i"), F.col(axes[1]).alias("j"), "value")


def linear_access(image: Image, where: Column) -> Image:
    return image.with_data(image.data.where(where))


def clip_histogram(image: Image, bins: int = 255):
    """Counts of the positive values by bin of the largest value's share; ``(bin, n)``."""
    positive = image.data.where("value > 0")
    top = positive.agg(F.max("value").alias("top"))
    share = F.least(F.floor(F.col("value") * bins / F.col("top")), F.lit(bins - 1)).cast("int")
    # one row, the largest value, meets every voxel
    return positive.crossJoin(F.broadcast(top)).groupBy(share.alias("bin")).agg(F.count("*").alias("n"))


def _threshold(counts, fraction: float) -> int:
    """The bin at which repeated halving of the median above it comes to rest."""
    import numpy as np

    n = len(counts) - 1
    bins = np.arange(n + 1)
    total = counts.sum()
    lowest = int(round(0.5 * float(np.sqrt((counts * bins.astype(float) ** 2).sum() / total))))
    down = np.cumsum(counts[lowest:n][::-1])
    enough = np.flatnonzero(down >= int(0.65 * total))
    cut = max(0, n - 2 - int(enough[0]) if len(enough) else lowest - 1)
    for _ in range(66):
        above = np.cumsum(counts[cut:n])
        half = int(above[-1]) // 2 if len(above) else 0
        steps = int(np.searchsorted(above, half)) + 1 if half else 0
        new = int(fraction * min(cut + steps, n))
        if new == cut:
            break
        cut = new
    return cut


def _clip_levels(rows, fraction: float, bins: int) -> dict[int, float]:
    """The threshold of each ``region`` of ``(region, value)``; 0 for one of 222 positive values or fewer.

    Only the histograms come to the driver, of at most 32768 bins a region.
    """
    import numpy as np

    good = rows.where((F.col("value") > 0) & ~F.isnan(F.col("value").cast("double")) & (F.col("value").cast("double") < float("inf")))
    whole = F.min(F.abs(F.col("value") - F.rint("value")) < 1e-8)
    tops = {r.region: r for r in good.groupBy("region").agg(F.max("value").alias("top"), whole.alias("whole"), F.count("*").alias("n")).collect()}
    out, sizes = {}, {}
    for region, r in tops.items():
        plain = r.whole and r.top <= 32767
        sizes[region] = (255 if r.top <= 255 else 32767, 1.0, 0.5) if plain else (bins, bins / float(r.top), 0.499)
    if not sizes:
        return {}
    scale = F.create_map(*[F.lit(x) for region, (_, f, _) in sizes.items() for x in (region, f)])
    shift = F.create_map(*[F.lit(x) for region, (_, _, f) in sizes.items() for x in (region, f)])
    at = F.floor(F.col("value") * scale[F.col("region")] + shift[F.col("region")]).cast("int")
    counts = {region: np.zeros(n + 1, np.int64) for region, (n, _, _) in sizes.items()}
    for r in good.groupBy("region", at.alias("bin")).agg(F.count("*").alias("n")).collect():
        if r.bin < len(counts[r.region]):
            counts[r.region][r.bin] = r.n
    for region, (_, f, _) in sizes.items():
        out[region] = _threshold(counts[region], fraction) / f if counts[region].sum() > 222 else 0.0
    return out


def clip_level(image: Image, fraction: float = 0.5, bins: int = 10000) -> float:
    """The threshold between background and object."""
    return _clip_levels(image.data.select(F.lit(0).alias("region"), "value"), fraction, bins).get(0, 0.0)


def gradual_clip(image: Image, fraction: float = 0.5) -> Column:
    """The threshold at each voxel, as a column over ``i``, ``j`` and ``k``.

    Eight overlapping parts around the center of mass have levels of their own, a third of the whole's at least, and
    a voxel's is blended from them along the three axes.
    """
    dims = image.space.space_dims
    g = image.gridded()
    w = F.when((F.col("value") > 0) & ~F.isnan(F.col("value").cast("double")), F.col("value")).otherwise(0)
    mass = g.agg(F.sum(w), *[F.sum(w * (F.col(a) - 1)) for a in "ijk"]).first()
    center = [round(m / mass[0]) if mass[0] else round((d - 1) / 2) for m, d in zip(mass[1:], dims)]
    center = [min(max(c, 0), d - 1) for c, d in zip(center, dims)]
    over = [max(1, round(0.01 * d)) for d in dims]
    parts = []
    for region in range(8):
        inside = F.lit(True)
        for n, (a, c, o) in enumerate(zip("ijk", center, over)):
            inside = inside & ((F.col(a) - 1 >= c - o) if region >> n & 1 else (F.col(a) - 1 <= c + o))
        parts.append(F.when(inside, F.lit(region)))
    held = g.select(F.explode(F.array(*parts)).alias("region"), "value").where(F.col("region").isNotNull())
    levels, least = _clip_levels(held, fraction, 10000), 0.333 * clip_level(image, fraction)
    total = F.lit(0.0)
    for region in range(8):
        weight = F.lit(1.0)
        for n, (a, c, d) in enumerate(zip("ijk", center, dims)):
            low, high = 0.5 * c, 0.5 * (c + d - 1)
            far = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(a) - 1 - low) / (high - low))) if high > low else F.lit(0.0)
            weight = weight * (far if region >> n & 1 else 1 - far)
        total = total + max(levels.get(region, 0.0), least) * weight
    return total


def neighbour_count_18(mask: Image):
    """``(vox, n)``: neighbours within the mask among the 18 that share a face or an edge; edges are clamped."""
    a, b, c = mask.space.space_dims
    offsets = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if 0 < abs(x) + abs(y) + abs(z) <= 2]
    g = mask.gridded().select("vox", "i", "j", "k")
    taps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x, y, z in offsets])
    asked = g.select("vox", F.explode(taps).alias("o"), "i", "j", "k")
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(1)), F.lit(top))
    at = mask.space.to_index(clamp(F.col("i") + F.col("o.x"), a), clamp(F.col("j") + F.col("o.y"), b), clamp(F.col("k") + F.col("o.z"), c))
    hits = asked.select("vox", at.alias("near")).join(mask.data.select(F.col("vox").alias("near")), "near", "left_semi")
    return mask.data.select("vox").join(hits.groupBy("vox").agg(F.count("*").alias("n")), "vox", "left").select("vox", F.coalesce("n", F.lit(0)).alias("n"))


def peel_restore(mask: Image, peels: int = 1, threshold: int = 17) -> Image:
    """Takes away layers of voxels with fewer neighbours than the threshold, then gives back those that still touch.

    The last layer taken comes back with one neighbour, earlier ones with two.
    """
    layers, now = [], mask.with_data(mask.data.select("vox"))
    for _ in range(peels):
        counted = materialize(neighbour_count_18(now), "peeled")
        layers.append(counted.where(F.col("n") < min(18, max(1, threshold))).select("vox"))
        now = mask.with_data(counted.where(F.col("n") >= min(18, max(1, threshold))).select("vox"))
    gone = None
    for n, layer in enumerate(reversed(layers)):
        gone = layer if gone is None else gone.union(layer)
        touched = _touching(mask.with_data(gone.join(now.data, "vox", "left_anti")), now, 1 if n == 0 else 2)
        now = mask.with_data(materialize(now.data.union(touched), "restored"))
    return now


def _touching(layer: Image, core: Image, least: int):
    """Voxels of ``layer`` with at least so many of their 18 neighbours in ``core``."""
    from .neighbourhoods import shifted

    offsets = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if 0 < abs(x) + abs(y) + abs(z) <= 2]
    near = shifted(layer, offsets).join(core.data.select(F.col("vox").alias("near")), "near", "left_semi")
    return near.groupBy("vox").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("vox")
