"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, remove_path


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` of every node but the smallest of its component, with ``v`` that smallest node.

    ``edges`` has long columns ``u`` and ``v``, without nulls and loops. Each round is written to the
    shared folder, so a lost executor costs one round at most; rounds grow with the logarithm of the
    longest chain. A node with very many edges is met by pre-aggregated minima, which are written so that
    both sides of their join come from a shuffle of their own and Spark splits that node's edges.
    """
    spark = edges.sparkSession

    def write(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = new_path(spark, "components")
        df.write.parquet(path)
        out = spark.read.schema("u long, v long").parquet(path)
        state = out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return out, path, tuple(state)

    now, path, state = write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while state[0]:
        nxt, new, reached = write(_small_star(_large_star(now)))
        remove_path(spark, path)
        if reached == state:
            return nxt
        now, path, state = nxt, new, reached
    return now
