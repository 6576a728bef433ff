"""Images put together and taken apart along time."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..image import Image
from ..space import Space


def _times(image: Image) -> int:
    return int(image.space.dims[3]) if image.is_series else 1


def concat(*images: Image) -> Image:
    """One series after the other; a volume is a series of one time."""
    first, at, parts, labels = images[0], 0, [], []
    for image in images:
        first.space.require_same_grid(image.space)
        data = image.data if image.is_series else image.data.withColumn("t", F.lit(1))
        parts.append(data.select("vox", (F.col("t") + at).cast("int").alias("t"), "value"))
        labels += list(image.labels) or [""] * _times(image)
        at += _times(image)
    space = Space((*first.space.space_dims, at), trans=first.space.trans)
    return Image(space, reduce(DataFrame.union, parts), tuple(labels) if any(labels) else ())


def sub_vector(image: Image, times: list[int]) -> Image:
    """The volumes asked for, in that order, repeats included; each is a time of its own."""
    if any(not 1 <= t <= _times(image) for t in times):
        raise IndexError(f"times must lie in 1 to {_times(image)}")
    picks = F.array(*[F.struct(F.lit(t).alias("old"), F.lit(n).alias("new")) for n, t in enumerate(times, 1)])
    wanted = F.filter(picks, lambda p: p["old"] == F.col("t"))
    data = image.data.where(F.col("t").isin(times)).withColumn("p", F.explode(wanted))
    space = Space((*image.space.space_dims, len(times)), trans=image.space.trans)
    labels = tuple(image.labels[t - 1] for t in times) if image.labels else ()
    return Image(space, data.select("vox", F.col("p.new").alias("t"), "value"), labels)


def volume_at(image: Image, time: int | str) -> Image:
    """One volume, by its time or its label."""
    if isinstance(time, str):
        found = [n for n, label in enumerate(image.labels, 1) if label == time]
        if len(found) != 1:
            raise KeyError(f"{len(found)} volumes are labelled {time!r}")
        time = found[0]
    data = image.data.where(F.col("t") == time).select("vox", "value")
    return replace(image, data=data, space=Space(image.space.space_dims, trans=image.space.trans), labels=())


def hyper(features: dict[str, Image]) -> DataFrame:
    """``(feature, vox, t, value)``: several series on one grid as one table."""
    parts = [image.data.select(F.lit(name).alias("feature"), "vox", "t", "value") for name, image in features.items()]
    return reduce(DataFrame.union, parts)
