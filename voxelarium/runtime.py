"""What iterative operators need from the cluster: the shared folder and tables written to it."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a new local one only where that is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """``materialize`` with the path, for who deletes it with ``delete_table``."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def delete_table(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def numbered(frame: DataFrame, name: str, *order) -> DataFrame:
    """``frame``, written, with the column ``name`` that counts its rows from 1 in the given order.

    Ranges are sorted apart, and a row's number is its place in its range after all the ranges before.
    """
    place = (F.monotonically_increasing_id() % (1 << 33)).alias("__at")
    dealt = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.select("*", F.spark_partition_id().alias("__part"), place), "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("__part").agg(F.count("*").alias("__rows"))  # a row a partition
    parts = parts.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    return dealt.join(parts, "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


#: Bins of a pass of ``quantiles``, and the values that are few enough to be sorted on the driver.
BINS, FEW = 4096, 1 << 14


def quantiles(frame: DataFrame, value: Column, shares: list[float], bins: int = BINS, few: int = FEW) -> list[float] | None:
    """The exact quantiles of a column, between two values in proportion; None for a table without values.

    Each pass counts the values by bin and goes on within the bin that holds the rank, so the driver gets ``bins`` counts a
    pass and at last ``few`` values, and no task gets them all. Nulls and NaN are left out; infinities count as the
    largest doubles. ``frame`` is read once a pass: write it before if it is costly.
    """
    largest = float(np.finfo(float).max)
    v = value.cast("double")
    rows = frame.where(v.isNotNull() & ~F.isnan(v)).select(F.greatest(F.lit(-largest), F.least(F.lit(largest), v)).alias("v"))
    n, bottom, top = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None

    def at(rank: int) -> float:
        low, high, count, before = bottom, top, n, 0
        while low < high:
            span = rows.where(F.col("v").between(low, high))
            if count <= few:
                return sorted(r.v for r in span.collect())[rank - before]
            # halves, so that the width of the widest range is a double too
            place = F.floor((F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * bins)
            found = span.groupBy(F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            for r in sorted(found.collect(), key=lambda r: r.bin):
                low, high, count = r.low, r.high, r.n
                if rank < before + count:
                    break
                before += count
        return low

    out = []
    for share in shares:
        place = share * (n - 1)
        first = at(math.floor(place))
        out.append(first if place == math.floor(place) else first + (at(math.ceil(place)) - first) * (place - math.floor(place)))
    return out
