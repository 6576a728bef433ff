"""What the queries share: their registry, the columns they return, and the mask they use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from ..image import Image
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query; ``sql`` may use the common table expressions of the derived images."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            recursive = " RECURSIVE" if body.startswith("RECURSIVE ") else ""
            body = body.removeprefix("RECURSIVE ")
            ORACLE[f.__name__] = f"WITH{recursive} {T.SQL}" + (f",\n{body[5:]}" if body.startswith("WITH ") else f"\n{body}")
        return f

    return add


def out(image: Image, digits: int | None = None) -> DataFrame:
    value = F.col("value") if digits is None else F.round("value", digits)
    return image.data.select(F.col("vox").cast("long").alias("vox"), *[F.col(k).cast("int").alias(k) for k in image.keys[1:]], value.alias("v"))


def mask_of(spark, sf_dir) -> Image:
    """The voxels of an upper part of the value range, so that a mask is neither empty nor full at any scale."""
    image = T.vol_qty(spark, sf_dir)
    image = image.with_data(runtime.materialize(image.data, "volume"))  # read for its mean, and for every use of the mask
    mean = image.data.agg(F.avg("value").alias("m"))
    return image.with_data(image.data.crossJoin(F.broadcast(mean)).where(F.col("value") > F.col("m") * 1.1).select("vox", "value"))


#: The mask as SQL.
MASK = "mask AS (SELECT * FROM vol_qty WHERE v > (SELECT AVG(v) * 1.1 FROM vol_qty))"
