"""Connected components of a mask, and what is built on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..image import Image
from ..runtime import materialize, numbered
from .filters import apply_mask, clip_level, gradual_clip, mask_not, peel_restore
from .neighbourhoods import shifted

CONNECTIVITY = {"6-connect": 1, "18-connect": 2, "26-connect": 3}


def half_offsets(connect: str) -> list[tuple[int, int, int]]:
    """One of each pair of opposite offsets of a connectivity."""
    reach = CONNECTIVITY[connect]
    every = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    return [o for o in every if 0 < sum(map(abs, o)) <= reach and o > (0, 0, 0)]


def _close(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node of each part of a graph with edges ``(a, b)``.

    Each round takes the smallest label of the neighbours and then that label's own label, so chains shorten by more
    than half. A round is written to the shared folder; it ends when no label has changed.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(nodes.select("node", F.col("node").alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        lower = labels.join(seen.withColumnRenamed("a", "node"), "node", "left").select("node", "root", F.least("root", F.coalesce("other", "root")).alias("low"))
        # a root takes the smallest label that any of its members saw
        hooks = lower.groupBy("root").agg(F.min("low").alias("hook"))
        hooked = lower.join(hooks, "root").select("node", F.col("root").alias("old"), F.least("low", "hook").alias("root"))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = materialize(hooked.join(up, "root").select("node", "old", F.least("root", "above").alias("root")), "labels")
        labels = step.select("node", "root")
        if not step.where("root <> old").take(1):
            return labels


def _label_block(offsets, dims, block: int):
    """Labels the voxels of one block by the smallest voxel of their part within it; ``rim`` marks its outer voxels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vox = np.sort(pdf["vox"].to_numpy(np.int64))
        at = np.stack(np.unravel_index(vox - 1, dims, order="F"))
        low = at.min(axis=1) // block * block
        place = np.full((block + 1,) * 3, -1, np.int64)
        inner = at - low[:, None]
        place[tuple(inner)] = np.arange(len(vox))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for o in offsets:
            there = inner + np.array(o)[:, None]
            ok = ((there >= 0) & (there < block)).all(axis=0)
            hit = place[tuple(there[:, ok])]
            a.append(np.flatnonzero(ok)[hit >= 0])
            b.append(hit[hit >= 0])
        a, b = np.concatenate(a), np.concatenate(b)
        root = np.arange(len(vox))
        while True:
            low_of = np.minimum(root[a], root[b])
            new = root.copy()
            for end in (a, b):
                np.minimum.at(new, root[end], low_of)
            while not np.array_equal(jumped := new[new], new):
                new = jumped
            if np.array_equal(new, root):
                break
            root = new
        rim = ((inner == 0) | (inner == block - 1)).any(axis=0)
        return pd.DataFrame({"vox": vox, "root": vox[root], "rim": rim})

    return run


def label_components(mask: Image, connect: str = "26-connect", block: int = 64) -> DataFrame:
    """``(vox, root)``: the smallest voxel of each voxel's component.

    Blocks of ``block`` voxels a side are labelled by a task each. What meets across blocks is a graph of the parts'
    roots, far smaller than the image, which is closed in rounds; an image within one block needs none.
    """
    offsets, space = half_offsets(connect), mask.space
    i, j, k = space.to_grid(F.col("vox"))
    cell = [F.floor((x - 1) / block).alias(n) for x, n in zip((i, j, k), ("bi", "bj", "bk"))]
    voxels = mask.data.select("vox").distinct().select("vox", *cell)
    local = voxels.groupBy("bi", "bj", "bk").applyInPandas(_label_block(offsets, space.space_dims, block), "vox long, root long, rim boolean")
    local = materialize(local, "blocks")
    rim = local.where("rim").select("vox", "root")
    near = shifted(mask.with_data(rim), offsets).select(F.col("root").alias("a"), "near")
    edges = near.join(rim.select(F.col("vox").alias("near"), F.col("root").alias("b")), "near").where("a <> b").select("a", "b").distinct()
    if max(space.space_dims) <= block or not (edges := materialize(edges, "across")).take(1):
        return local.select("vox", "root")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    closed = _close(edges, nodes).withColumnRenamed("root", "final")
    joined = local.join(closed, local["root"] == closed["node"], "left")
    return joined.select("vox", F.coalesce("final", "root").alias("root"))


def connected_components(mask: Image, connect: str = "26-connect") -> DataFrame:
    """``(vox, component, size)``: components numbered by size, the largest first, ties by their smallest voxel."""
    labels = label_components(mask, connect)
    sizes = labels.groupBy("root").agg(F.count("*").alias("size"))
    ranked = numbered(sizes, "component", F.desc("size"), F.col("root"))
    return labels.join(ranked, "root").select("vox", F.col("component").cast("long").alias("component"), F.col("size").cast("long").alias("size"))


def component_table(image: Image, threshold: float, connect: str = "26-connect") -> DataFrame:
    """``(component, vox, n, area, value)`` of the parts above a threshold, each with its peak (ties to the smallest voxel)."""
    above = image.with_data(image.data.where(F.col("value") > threshold))
    found = connected_components(above, connect).join(above.data, "vox")
    peak = F.max_by(F.struct("vox", "value"), F.struct("value", -F.col("vox")))
    unit = math.prod(image.space.spacing)
    table = found.groupBy("component").agg(peak.alias("p"), F.count("*").alias("n"))
    return table.select("component", F.col("p.vox").alias("vox"), "n", (F.col("n") * unit).alias("area"), F.col("p.value").alias("value"))


def local_maxima(image: Image, connect: str = "26-connect") -> DataFrame:
    """``(vox, value)`` of voxels that no neighbour exceeds."""
    offsets = half_offsets(connect)
    both = offsets + [tuple(-x for x in o) for o in offsets]
    sent = shifted(image, both).select(F.col("near").alias("vox"), F.col("value").alias("other"))
    beaten = image.data.join(sent, "vox").where("other > value").select("vox").distinct()
    return image.data.join(beaten, "vox", "left_anti")


def largest_component(mask: Image, connect: str = "26-connect") -> Image:
    return mask.with_data(connected_components(mask, connect).where("component = 1").select("vox"))


def fill_holes(mask: Image) -> Image:
    """Adds the parts of the background (by faces) that touch no side of the grid."""
    labels = label_components(mask_not(mask), "6-connect")
    i, j, k = mask.space.to_grid(F.col("vox"))
    a, b, c = mask.space.space_dims
    side = i.isin(1, a) | j.isin(1, b) | k.isin(1, c)
    open_ = labels.where(side).select("root").distinct()
    holes = labels.join(open_, "root", "left_anti").select("vox")
    return mask.with_data(mask.data.select("vox").union(holes))


def automask(
    image: Image, fraction: float = 0.5, gradual: bool = True, representative: str = "mean_abs", peels: int = 1, peel_threshold: int = 17, connect: str = "26-connect"
) -> Image:
    """A mask of the object: clip a representative volume, keep the largest part, peel and restore, fill holes."""
    if image.is_series:
        pick = F.avg(F.abs("value")) if representative == "mean_abs" else F.median("value")
        volume = image.with_data(image.data.groupBy("vox").agg(pick.alias("value")))
    else:
        volume = image
    level = clip_level(volume, fraction)
    if level <= 0:
        return volume.with_data(volume.data.where(F.lit(False)).select("vox"))
    at = gradual_clip(volume, fraction) if gradual else F.lit(level)
    mask = volume.with_data(volume.gridded().where(F.col("value") >= at).select("vox"))
    mask = largest_component(mask, connect)
    if peels > 0:
        mask = largest_component(peel_restore(mask, peels, peel_threshold), connect)
    return largest_component(fill_holes(mask), connect)


def masked(image: Image, **options) -> Image:
    return apply_mask(image, automask(image, **options))
