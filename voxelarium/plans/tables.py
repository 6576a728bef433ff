"""Images derived from the driver's tables, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..image import Image
from ..space import Space

QTY = Space((16, 16, 7), spacing=(1.0, 1.0, 1.0))
LI = Space((16, 16, 7, 7))
EV = Space((8, 19, 5, 31))
#: An oblique-free affine with turned axes, for coordinate queries.
WORLD = Space((16, 16, 7), trans=[[-2, 0, 0, 30], [0, 3, 0, -20], [0, 0, 2.5, -10], [0, 0, 0, 1]])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j, k = F.col("l_partkey") % 16 + 1, F.col("l_suppkey") % 16 + 1, F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select(QTY.to_index(i, j, k).alias("vox"), "l_quantity", "l_shipdate")


def vol_qty(spark: SparkSession, sf_dir: str, space: Space = QTY) -> Image:
    return Image(space, _cells(spark, sf_dir).groupBy("vox").agg(F.sum("l_quantity").cast("long").alias("value")))


def vol_cnt(spark: SparkSession, sf_dir: str) -> Image:
    return Image(QTY, _cells(spark, sf_dir).groupBy("vox").agg(F.count("*").alias("value")))


def vec_li(spark: SparkSession, sf_dir: str) -> Image:
    t = (F.year("l_shipdate") - 1994).cast("int")
    cells = _cells(spark, sf_dir).select("vox", t.alias("t"), "l_quantity").where(F.col("t").between(1, 7))
    return Image(LI, cells.groupBy("vox", "t").agg(F.sum("l_quantity").cast("long").alias("value")))


def vec_ev(spark: SparkSession, sf_dir: str) -> Image:
    kind = F.col("event_type")
    k = F.when(kind == "click", 1).when(kind == "error", 2).when(kind == "purchase", 3).when(kind == "signup", 4).otherwise(5)
    # ids beyond the grid's 152 columns are folded onto them, so every event counts at any scale
    cells = read(spark, sf_dir, "events").where(F.col("user_id").isNotNull()).select(
        EV.to_index(F.col("user_id") % 8 + 1, F.floor(F.col("user_id") / 8) % 19 + 1, k).alias("vox"),
        F.dayofmonth("ts").alias("t"),
        F.round(F.col("value") * 100).cast("long").alias("c"),
    )
    return Image(EV, cells.groupBy("vox", "t").agg(F.sum("c").alias("value")))


def parcels(image: Image) -> DataFrame:
    """``(vox, cluster)``: seven interleaved parcels of the voxels of an image."""
    return image.gridded().select("vox", ((F.col("i") + 2 * F.col("j") + 3 * F.col("k")) % 7 + 1).alias("cluster")).distinct()


def parcel_grid(spark: SparkSession, space: Space) -> DataFrame:
    """The same parcels over a whole grid, without reading the image."""
    i, j, k = space.to_grid(F.col("vox"))
    return spark.range(1, space.n_vox + 1).withColumnRenamed("id", "vox").withColumn("cluster", (i + 2 * j + 3 * k) % 7 + 1)


#: The same images as common table expressions.
SQL = """
cells AS (SELECT l_partkey % 16 + 1 AS i, l_suppkey % 16 + 1 AS j, l_linenumber AS k, l_quantity, year(l_shipdate) - 1994 AS t FROM lineitem),
vol_qty AS (SELECT i + (j - 1) * 16 + (k - 1) * 256 AS vox, i, j, k, CAST(SUM(l_quantity) AS BIGINT) AS v FROM cells GROUP BY i, j, k),
vol_cnt AS (SELECT i + (j - 1) * 16 + (k - 1) * 256 AS vox, i, j, k, COUNT(*) AS v FROM cells GROUP BY i, j, k),
vec_li AS (SELECT i + (j - 1) * 16 + (k - 1) * 256 AS vox, i, j, k, CAST(t AS INT) AS t, CAST(SUM(l_quantity) AS BIGINT) AS v FROM cells WHERE t BETWEEN 1 AND 7 GROUP BY i, j, k, t),
ev AS (SELECT user_id % 8 + 1 AS i, CAST(FLOOR(user_id / 8.0) AS BIGINT) % 19 + 1 AS j,
  CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS k,
  CAST(day(ts) AS INT) AS t, CAST(ROUND(value * 100) AS BIGINT) AS c FROM events WHERE user_id IS NOT NULL),
vec_ev AS (SELECT i + (j - 1) * 8 + (k - 1) * 152 AS vox, i, j, k, t, CAST(SUM(c) AS BIGINT) AS v FROM ev GROUP BY i, j, k, t),
parcel AS (SELECT vox, i, j, k, (i + 2 * j + 3 * k) % 7 + 1 AS cluster FROM vol_qty)
""".strip()
