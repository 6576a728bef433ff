"""Queries: name -> (spark, sf_dir) -> DataFrame, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import runtime
from ..functions import colours
from ..image import Image
from ..operators import aggregates, components, filters, graphs, hyper, joins, neighbourhoods, resampling, sets, stencils, windows
from ..sources import nifti
from ..space import Space
from . import files, geometry, masks  # noqa: F401 (their queries are registered)
from . import tables as T
from .registry import MASK, ORACLE, QUERIES, query  # noqa: F401
from .registry import mask_of as _mask
from .registry import out as _out

# construction and access


@query("SELECT vox, v FROM vol_qty")
def vol_construct(spark, sf_dir):
    return _out(T.vol_qty(spark, sf_dir))


@query("SELECT vox, t, v FROM vec_li")
def vec_construct(spark, sf_dir):
    return _out(T.vec_li(spark, sf_dir))


@query("SELECT vox, t, v FROM vec_ev")
def vec_events(spark, sf_dir):
    return _out(T.vec_ev(spark, sf_dir))


@query("SELECT vox, t, v FROM vec_li WHERE v >= 0 UNION ALL SELECT g.vox, g.t, 0 FROM (SELECT a.vox, b.t FROM (SELECT UNNEST(range(1, 1793)) AS vox) a CROSS JOIN (SELECT UNNEST(range(1, 8)) AS t) b) g LEFT JOIN vec_li USING (vox, t) WHERE vec_li.v IS NULL")
def vec_dense(spark, sf_dir):
    return _out(T.vec_li(spark, sf_dir).dense())


@query("SELECT i + (j - 1) * 16 + (k - 1) * 256 AS idx, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k FROM vol_qty")
def grid_to_index(spark, sf_dir):
    g = T.vol_qty(spark, sf_dir).gridded()
    return g.select(T.QTY.to_index(F.col("i"), F.col("j"), F.col("k")).alias("idx"), "i", "j", "k")


@query("SELECT vox, CAST((vox - 1) % 16 + 1 AS INT) AS i, CAST((vox - 1) // 16 % 16 + 1 AS INT) AS j, CAST((vox - 1) // 256 + 1 AS INT) AS k FROM vol_qty")
def index_to_grid(spark, sf_dir):
    return T.vol_qty(spark, sf_dir).gridded().select("vox", "i", "j", "k")


@query("SELECT vox, round(-2.0 * (i - 1) + 30, 6) AS x, round(3.0 * (j - 1) - 20, 6) AS y, round(2.5 * (k - 1) - 10, 6) AS z FROM vol_qty")
def grid_to_coord(spark, sf_dir):
    g = T.vol_qty(spark, sf_dir, T.WORLD).with_coords()
    return g.select("vox", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("SELECT vox, CAST(i AS DOUBLE) AS i, CAST(j AS DOUBLE) AS j, CAST(k AS DOUBLE) AS k FROM vol_qty")
def coord_to_grid(spark, sf_dir):
    g = T.vol_qty(spark, sf_dir, T.WORLD).with_coords()
    back = T.WORLD.from_coord(F.col("x"), F.col("y"), F.col("z"))
    return g.select("vox", *[F.round(c, 4).alias(n) for c, n in zip(back, "ijk")])


@query("SELECT vox, vox AS idx FROM vol_qty")
def coord_to_index(spark, sf_dir):
    g = T.vol_qty(spark, sf_dir, T.WORLD).with_coords()
    return g.select("vox", T.WORLD.coord_to_index(F.col("x") + 0.4, F.col("y") - 0.4, F.col("z") + 0.4).alias("idx"))


@query("SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, v FROM vol_qty WHERE k = 4")
def slice_k(spark, sf_dir):
    return filters.slice_of(T.vol_qty(spark, sf_dir), 4).withColumnRenamed("value", "v")


@query("SELECT CAST(j AS INT) AS i, CAST(k AS INT) AS j, v FROM vol_qty WHERE i = 3")
def slice_i(spark, sf_dir):
    return filters.slice_of(T.vol_qty(spark, sf_dir), 3, along=1).withColumnRenamed("value", "v")


@query("SELECT vox, v FROM vol_qty WHERE i BETWEEN 3 AND 8 AND j BETWEEN 2 AND 5 AND k BETWEEN 1 AND 4")
def subset_box(spark, sf_dir):
    return _out(filters.sub_box(T.vol_qty(spark, sf_dir), (3, 8), (2, 5), (1, 4)))


@query("SELECT vox, v FROM vol_qty WHERE vox BETWEEN 100 AND 400")
def linear_access(spark, sf_dir):
    return _out(filters.linear_access(T.vol_qty(spark, sf_dir), F.col("vox").between(100, 400)))


@query("SELECT vox, to_json(list(v ORDER BY t)) AS vs, CAST(count(*) AS BIGINT) AS n FROM vec_li GROUP BY vox")
def series_arrays(spark, sf_dir):
    rows = T.vec_li(spark, sf_dir).series_arrays()
    return rows.select("vox", F.to_json("values").alias("vs"), F.size("values").cast("long").alias("n"))


# predicates and masks


@query("SELECT vox FROM vol_qty WHERE v > 1000")
def mask_compare(spark, sf_dir):
    return filters.compare(T.vol_qty(spark, sf_dir), ">", 1000).data


@query("SELECT vox FROM vol_qty JOIN vol_cnt USING (vox) WHERE vol_qty.v > 25 * vol_cnt.v")
def mask_compare_images(spark, sf_dir):
    return filters.compare(T.vol_qty(spark, sf_dir), ">", T.vol_cnt(spark, sf_dir).map(lambda v: v * 25)).data


@query("WITH m AS (SELECT vox FROM vol_qty WHERE k <= 3), n AS (SELECT vox FROM vol_qty WHERE i > 5) SELECT vox FROM m WHERE vox IN (SELECT vox FROM n)")
def mask_logic_and(spark, sf_dir):
    q = T.vol_qty(spark, sf_dir)
    i, _, k = T.QTY.to_grid(F.col("vox"))
    return filters.mask_and(q.mask(k <= 3), q.mask(i > 5)).data


@query("SELECT vox FROM vol_qty WHERE k <= 3 OR i > 5")
def mask_logic_or(spark, sf_dir):
    q = T.vol_qty(spark, sf_dir)
    i, _, k = T.QTY.to_grid(F.col("vox"))
    return filters.mask_or(q.mask(k <= 3), q.mask(i > 5)).data


@query(f"WITH {MASK}, g AS (SELECT UNNEST(range(1, 1793)) AS vox) SELECT vox FROM g WHERE vox NOT IN (SELECT vox FROM mask)")
def mask_logic_not(spark, sf_dir):
    return filters.mask_not(_mask(spark, sf_dir)).data


@query(f"WITH {MASK} SELECT vox, t, v FROM vec_li WHERE vox IN (SELECT vox FROM mask)")
def apply_mask_sparse(spark, sf_dir):
    return _out(filters.apply_mask(T.vec_li(spark, sf_dir), _mask(spark, sf_dir)))


@query(f"WITH {MASK} SELECT vox, CASE WHEN vox IN (SELECT vox FROM mask) THEN v ELSE 0 END AS v FROM vol_cnt")
def apply_mask_dense(spark, sf_dir):
    return _out(filters.apply_mask(T.vol_cnt(spark, sf_dir), _mask(spark, sf_dir), dense=True))


@query("SELECT CAST(LEAST(FLOOR(v * 255.0 / (SELECT MAX(v) FROM vol_qty)), 254) AS INT) AS bin, COUNT(*) AS n FROM vol_qty WHERE v > 0 GROUP BY 1")
def clip_level_hist(spark, sf_dir):
    return filters.clip_histogram(T.vol_qty(spark, sf_dir), 255)


OFFSETS_18 = "o AS (SELECT a.x, b.x AS y, c.x AS z FROM (VALUES (-1), (0), (1)) a(x), (VALUES (-1), (0), (1)) b(x), (VALUES (-1), (0), (1)) c(x) WHERE abs(a.x) + abs(b.x) + abs(c.x) BETWEEN 1 AND 2)"


@query(f"""WITH {MASK}, {OFFSETS_18},
  p AS (SELECT m.vox, greatest(1, least(16, m.i + o.x)) AS i, greatest(1, least(16, m.j + o.y)) AS j, greatest(1, least(7, m.k + o.z)) AS k FROM mask m, o)
  SELECT m.vox, count(n.vox) AS n FROM mask m JOIN p ON p.vox = m.vox LEFT JOIN mask n ON n.i = p.i AND n.j = p.j AND n.k = p.k GROUP BY m.vox""")
def neighbor_count_18(spark, sf_dir):
    return filters.neighbour_count_18(_mask(spark, sf_dir))


# arithmetic and lookups


@query("SELECT vox, vol_qty.v - 2 * vol_cnt.v AS v FROM vol_qty JOIN vol_cnt USING (vox)")
def arith_vol_vol(spark, sf_dir):
    return _out(joins.arith(T.vol_qty(spark, sf_dir), "-", T.vol_cnt(spark, sf_dir).map(lambda v: v * 2)))


@query("SELECT g.vox, coalesce(v, 0) * 3 AS v FROM (SELECT UNNEST(range(1, 1793)) AS vox) g LEFT JOIN vol_qty USING (vox)")
def arith_vol_scalar(spark, sf_dir):
    return _out(joins.arith(T.vol_qty(spark, sf_dir), "*", 3))


@query("SELECT vec_li.vox, t, vec_li.v * vol_cnt.v AS v FROM vec_li JOIN vol_cnt USING (vox)")
def arith_vec_vol(spark, sf_dir):
    return _out(joins.arith(T.vec_li(spark, sf_dir), "*", T.vol_cnt(spark, sf_dir)))


@query("""WITH a AS (SELECT vox, v FROM vol_qty WHERE v % 3 = 0), b AS (SELECT vox, v FROM vol_cnt WHERE v % 2 = 0)
  SELECT vox, coalesce(a.v, 0) + coalesce(b.v, 0) AS v FROM a FULL JOIN b USING (vox) WHERE coalesce(a.v, 0) + coalesce(b.v, 0) <> 0""")
def arith_sparse_outer(spark, sf_dir):
    q, c = T.vol_qty(spark, sf_dir), T.vol_cnt(spark, sf_dir)
    a, b = q.with_data(q.data.where("value % 3 = 0")), c.with_data(c.data.where("value % 2 = 0"))
    return _out(joins.arith(a, "+", b, sparse=True))


@query("SELECT vox, a.v + b.v AS v FROM (SELECT * FROM vol_qty WHERE i < 9) a JOIN (SELECT * FROM vol_cnt WHERE i < 9) b USING (vox)")
def roi_arith(spark, sf_dir):
    q, c = T.vol_qty(spark, sf_dir), T.vol_cnt(spark, sf_dir)
    i = T.QTY.to_grid(F.col("vox"))[0]
    return _out(joins.roi_arith(q.with_data(q.data.where(i < 9)), "+", c.with_data(c.data.where(i < 9))))


@query("SELECT vox, CASE v % 5 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 3 THEN 40 ELSE 0 END AS v FROM vol_qty")
def map_values(spark, sf_dir):
    lookup = spark.createDataFrame([(0, 10), (1, 20), (3, 40)], "key long, new int")
    return _out(joins.map_values(T.vol_qty(spark, sf_dir).map(lambda v: v % 5), lookup))


ASKED = "asked AS (SELECT * FROM (VALUES (1, 5), (2, 700), (3, 5), (4, 1792)) x(pos, vox))"


@query(f"WITH {ASKED}, ts AS (SELECT CAST(UNNEST(range(1, 8)) AS INT) AS t) SELECT CAST(pos AS INT) AS pos, CAST(asked.vox AS BIGINT) AS vox, ts.t, coalesce(v, 0) AS v FROM asked CROSS JOIN ts LEFT JOIN vec_li ON vec_li.vox = asked.vox AND vec_li.t = ts.t")
def series_lookup(spark, sf_dir):
    asked = spark.createDataFrame([(1, 5), (2, 700), (3, 5), (4, 1792)], "pos int, vox long")
    return joins.series(T.vec_li(spark, sf_dir), asked).withColumnRenamed("value", "v")


@query("""WITH p AS (SELECT vox, i - 1 AS x, j - 1 AS y, k - 1 AS z, v FROM vol_qty)
  SELECT vox, v FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.v > p.v AND (q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2 < 9)""")
def prune_coords(spark, sf_dir):
    points = T.vol_qty(spark, sf_dir).with_coords().select(F.col("vox").alias("id"), "x", "y", "z", "value")
    return joins.prune_coords(points, 3.0).select(F.col("id").alias("vox"), F.col("value").alias("v"))


# reductions


@query("SELECT vox, round(SUM(v) / 7.0, 6) AS v FROM vec_li GROUP BY vox")
def temporal_mean(spark, sf_dir):
    return _out(aggregates.temporal_mean(T.vec_li(spark, sf_dir)), 6)


@query("SELECT MIN(v) AS smallest, MAX(v) AS largest, round(AVG(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, 0::BIGINT AS n_missing, CAST(SUM(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero, CAST(SUM(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_nonzero FROM vol_qty")
def summary_vol(spark, sf_dir):
    d = aggregates.describe(T.vol_qty(spark, sf_dir))
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


@query("SELECT t, CAST(SUM(v) AS BIGINT) AS total, MIN(v) AS smallest, MAX(v) AS largest FROM vec_li GROUP BY t")
def summary_vec(spark, sf_dir):
    return T.vec_li(spark, sf_dir).data.groupBy("t").agg(F.sum("value").alias("total"), F.min("value").alias("smallest"), F.max("value").alias("largest"))


@query("""SELECT count(*) AS n_stored, CAST(sum(v) AS BIGINT) AS total, CASE WHEN count(*) < 12544 THEN least(min(v), 0) ELSE min(v) END AS smallest,
  CASE WHEN count(*) < 12544 THEN greatest(max(v), 0) ELSE max(v) END AS largest, bool_or(v <> 0) AS any_nonzero, count(*) = 12544 AND bool_and(v <> 0) AS all_nonzero FROM vec_li""")
def global_summary(spark, sf_dir):
    return aggregates.summarize(T.vec_li(spark, sf_dir))


@query("SELECT vox, t % 2 AS level, round(AVG(v), 6) AS v FROM vec_li GROUP BY vox, t % 2")
def split_reduce_time(spark, sf_dir):
    factor = spark.range(1, 8).select(F.col("id").cast("int").alias("t"), (F.col("id") % 2).cast("int").alias("level"))
    return aggregates.split_reduce(T.vec_li(spark, sf_dir), factor).select("vox", "level", F.round("value", 6).alias("v"))


@query("SELECT CAST(cluster AS BIGINT) AS level, t, round(AVG(v), 6) AS v FROM vec_li JOIN parcel USING (vox) GROUP BY cluster, t")
def split_reduce_vox(spark, sf_dir):
    image = T.vec_li(spark, sf_dir)
    factor = T.parcel_grid(spark, image.space).select("vox", F.col("cluster").cast("long").alias("level"))
    return aggregates.split_reduce(image, factor).select("level", "t", F.round("value", 6).alias("v"))


@query("SELECT vox, CAST(SUM(v) OVER (PARTITION BY cluster) AS BIGINT) AS v FROM vol_qty JOIN parcel USING (vox)")
def split_fill(spark, sf_dir):
    image = T.vol_qty(spark, sf_dir)
    return _out(aggregates.split_fill(image, T.parcel_grid(spark, image.space).withColumnRenamed("cluster", "level"), F.sum))


@query("SELECT CAST(cluster AS INT) AS cluster, t, CAST(SUM(v) AS BIGINT) AS total, round(AVG(v), 6) AS mean FROM vec_li JOIN parcel USING (vox) GROUP BY cluster, t")
def parcel_series(spark, sf_dir):
    image = T.vec_li(spark, sf_dir)
    both = aggregates.parcel_series(image, T.parcel_grid(spark, image.space), lambda v: F.struct(F.sum(v).alias("total"), F.avg(v).alias("mean")))
    return both.select("cluster", "t", "value.total", F.round("value.mean", 6).alias("mean"))


@query("SELECT CAST(cluster AS INT) AS cluster, COUNT(*) AS n, round(AVG(i - 1), 6) AS x, round(AVG(j - 1), 6) AS y, round(AVG(k - 1), 6) AS z FROM parcel GROUP BY cluster")
def centroids(spark, sf_dir):
    c = aggregates.centroids(T.QTY, T.parcels(T.vol_qty(spark, sf_dir)))
    return c.select("cluster", "n", *[F.round(a, 6).alias(a) for a in "xyz"])


@query("SELECT vox, CAST(cluster AS INT) AS cluster FROM parcel WHERE cluster IN (2, 5)")
def sub_clusters(spark, sf_dir):
    return aggregates.sub_clusters(T.parcels(T.vol_qty(spark, sf_dir)), [2, 5])


@query("SELECT COUNT(DISTINCT cluster) AS n_clusters FROM parcel")
def num_clusters(spark, sf_dir):
    return aggregates.num_clusters(T.parcels(T.vol_qty(spark, sf_dir)))


@query("SELECT CAST(cluster AS INT) AS cluster, vox, t, v FROM vec_li JOIN parcel USING (vox)")
def split_clusters(spark, sf_dir):
    image = T.vec_li(spark, sf_dir)
    return aggregates.split_clusters(image, T.parcel_grid(spark, image.space)).withColumnRenamed("value", "v")


@query("""WITH n AS (SELECT UNNEST(range(0, 5)) AS c), m AS (SELECT UNNEST(range(0, 3)) AS c),
  w AS (SELECT vol_qty.vox, a.c AS ni, b.c AS nj, d.c AS nk, v,
    (least((a.c + 1) * 3.2, i) - greatest(a.c * 3.2, i - 1)) * (least((b.c + 1) * 3.2, j) - greatest(b.c * 3.2, j - 1)) * (least((d.c + 1) * 7 / 3.0, k) - greatest(d.c * 7 / 3.0, k - 1)) AS w
    FROM vol_qty, n a, n b, m d
    WHERE least((a.c + 1) * 3.2, i) > greatest(a.c * 3.2, i - 1) AND least((b.c + 1) * 3.2, j) > greatest(b.c * 3.2, j - 1) AND least((d.c + 1) * 7 / 3.0, k) > greatest(d.c * 7 / 3.0, k - 1))
  SELECT CAST(ni + 1 + nj * 5 + nk * 25 AS BIGINT) AS vox, round(SUM(w * v) / SUM(w) + 1e-7, 5) AS v FROM w GROUP BY ni, nj, nk""")
def downsample_box(spark, sf_dir):
    # means of whole numbers can end in an exact half, which the shift keeps off the edge of rounding
    return _out(aggregates.downsample(T.vol_qty(spark, sf_dir), outdim=(5, 5, 3)).map(lambda v: v + 1e-7), 5)


@query("SELECT CAST((i - 1) // 2 + 1 + ((j - 1) // 2) * 8 + ((k - 1) * 3 // 7) * 64 AS BIGINT) AS vox, t, round(AVG(v), 6) AS v FROM vec_li GROUP BY 1, 2")
def downsample_sparse(spark, sf_dir):
    return _out(aggregates.downsample_sparse(T.vec_li(spark, sf_dir), (8, 8, 3)), 6)


# analytics along time


@query("SELECT vox, t, round((v - AVG(v) OVER w) / CASE WHEN coalesce(stddev_samp(v) OVER w, 0) = 0 THEN 1 ELSE stddev_samp(v) OVER w END, 6) AS v FROM vec_ev WINDOW w AS (PARTITION BY vox)")
def scale_series(spark, sf_dir):
    return _out(windows.scale_series(T.vec_ev(spark, sf_dir)), 6)


@query("SELECT vox, t, round((v - AVG(v) OVER w) / stddev_samp(v) OVER w, 6) AS v FROM vec_ev WINDOW w AS (PARTITION BY vox, t % 3) QUALIFY stddev_samp(v) OVER w > 0")
def split_scale(spark, sf_dir):
    factor = spark.range(1, 32).select(F.col("id").cast("int").alias("t"), (F.col("id") % 3).alias("level"))
    scaled = windows.split_scale(T.vec_ev(spark, sf_dir), factor)
    return _out(scaled.with_data(scaled.data.where(F.col("value").isNotNull() & ~F.isnan("value"))), 6)


@query("WITH d AS (SELECT t, v - lag(v) OVER (PARTITION BY vox ORDER BY t) AS d FROM vec_ev) SELECT t, round(sqrt(avg(d * d)), 6) AS dvars FROM d WHERE d IS NOT NULL GROUP BY t")
def dvars_lag(spark, sf_dir):
    return windows.dvars(T.vec_ev(spark, sf_dir)).select("t", F.round("dvars", 6).alias("dvars"))


@query("""WITH d AS (SELECT t, v - lag(v) OVER (PARTITION BY vox ORDER BY t) AS d FROM vec_ev), e AS (SELECT t, sqrt(avg(d * d)) AS x FROM d WHERE d IS NOT NULL GROUP BY t),
  m AS (SELECT median(x) AS m FROM e), s AS (SELECT 1.4826 * median(abs(x - m)) AS mad FROM e, m)
  SELECT t, round(1 / (1 + exp(((x - m) / mad - 2.5) / 0.25)), 6) AS weight FROM e, m, s""")
def time_weights(spark, sf_dir):
    weighed = windows.time_weights(windows.dvars(T.vec_ev(spark, sf_dir)), dvars_col="dvars")
    return weighed.select("t", F.round("weight", 6).alias("weight"))


@query("""WITH d AS (SELECT t, v - lag(v) OVER (PARTITION BY vox ORDER BY t) AS d FROM vec_ev), e AS (SELECT t, sqrt(avg(d * d)) AS x FROM d WHERE d IS NOT NULL GROUP BY t),
  m AS (SELECT median(x) AS m FROM e), s AS (SELECT 1.4826 * median(abs(x - m)) AS mad FROM e, m), w AS (SELECT t, least(1.0, 1.345 / greatest(abs((x - m) / mad), 1e-12)) AS w FROM e, m, s)
  SELECT a.t, round(coalesce(w, 1.0), 6) AS weight FROM (SELECT DISTINCT t FROM vec_ev) a LEFT JOIN w USING (t)""")
def robust_weights(spark, sf_dir):
    return windows.robust_weights(T.vec_ev(spark, sf_dir)).select("t", F.round("weight", 6).alias("weight"))


@query("SELECT CAST(cluster AS INT) AS cluster, arg_max(vox, v * 10000 - vox) AS vox, max(v) AS v FROM vol_qty JOIN parcel USING (vox) GROUP BY cluster")
def argmax_per_cluster(spark, sf_dir):
    image = T.vol_qty(spark, sf_dir)
    joined = image.data.join(T.parcel_grid(spark, image.space), "vox")
    return joined.groupBy("cluster").agg(F.max_by("vox", F.struct("value", -F.col("vox"))).alias("vox"), F.max("value").alias("v"))


# neighbourhoods


NEAR = "a.i - b.i) ** 2 + (a.j - b.j) ** 2 + (a.k - b.k) ** 2"


@query(f"WITH {MASK} SELECT a.vox AS center, b.vox FROM mask a JOIN mask b ON ({NEAR} <= 4")
def searchlight_members(spark, sf_dir):
    return neighbourhoods.searchlight(_mask(spark, sf_dir), 2.0)


@query(f"WITH {MASK} SELECT a.vox, CAST(SUM(b.v) AS BIGINT) AS total, COUNT(*) AS n FROM mask a JOIN mask b ON ({NEAR} <= 4 GROUP BY a.vox")
def searchlight_sum(spark, sf_dir):
    mask = _mask(spark, sf_dir)
    return neighbourhoods.searchlight_sums(mask, mask, 2.0).select("vox", F.col("total").cast("long").alias("total"), "n")


@query(f"WITH {MASK} SELECT a.vox, round(AVG(b.v), 6) AS v FROM mask a JOIN mask b ON ({NEAR} <= 4 GROUP BY a.vox")
def searchlight_mean(spark, sf_dir):
    mask = _mask(spark, sf_dir)
    return neighbourhoods.searchlight_sums(mask, mask, 2.0).select("vox", F.round(F.col("total") / F.col("n"), 6).alias("v"))


@query(f"WITH {MASK} SELECT a.vox, MAX(b.v) AS v FROM mask a JOIN mask b ON ({NEAR} <= 4 GROUP BY a.vox")
def searchlight_max(spark, sf_dir):
    """Any other aggregate goes by the members."""
    mask = _mask(spark, sf_dir)
    return neighbourhoods.searchlight_reduce(mask, mask, 2.0, F.max).select("vox", F.col("value").alias("v"))



CENTERS = "c AS (SELECT * FROM (VALUES (1, 5, 5, 4), (2, 1, 1, 1), (3, 16, 8, 7)) x(roi, i, j, k))"


def _centers(spark):
    return spark.createDataFrame([(1, 5, 5, 4), (2, 1, 1, 1), (3, 16, 8, 7)], "roi int, i int, j int, k int")


@query(f"WITH {CENTERS} SELECT CAST(a.roi AS INT) AS roi, b.vox, b.v FROM c a JOIN vol_qty b ON ({NEAR} <= 9")
def spherical_roi(spark, sf_dir):
    return neighbourhoods.spherical_rois(T.vol_qty(spark, sf_dir), _centers(spark), 3.0).withColumnRenamed("value", "v")


@query(f"WITH {CENTERS} SELECT CAST(a.roi AS INT) AS roi, b.vox, b.v FROM c a JOIN vol_qty b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1")
def cuboid_roi(spark, sf_dir):
    return neighbourhoods.box_rois(T.vol_qty(spark, sf_dir), _centers(spark), 1).withColumnRenamed("value", "v")


@query(f"WITH {CENTERS} SELECT CAST(a.roi AS INT) AS roi, b.vox, b.v FROM c a JOIN vol_qty b ON abs(a.i - b.i) <= 2 AND abs(a.j - b.j) <= 2 AND a.k = b.k")
def square_roi(spark, sf_dir):
    return neighbourhoods.box_rois(T.vol_qty(spark, sf_dir), _centers(spark), 2, fixed=3).withColumnRenamed("value", "v")


@query("""WITH c AS (SELECT cluster, AVG(i) AS x, AVG(j) AS y, AVG(k) AS z FROM parcel GROUP BY cluster),
  d AS (SELECT a.cluster, b.cluster AS near, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS distance FROM c a, c b)
  SELECT CAST(cluster AS INT) AS cluster, CAST(near AS INT) AS near, round(distance, 6) AS distance FROM d WHERE distance <= 0.5""")
def cluster_knn(spark, sf_dir):
    found = aggregates.cluster_neighbours(T.QTY, T.parcels(T.vol_qty(spark, sf_dir)), radius=0.5)
    return found.select("cluster", "near", F.round("distance", 6).alias("distance"))


# stencils


@query("SELECT a.vox, round(SUM(b.v) / 27.0, 6) AS v FROM vol_qty a JOIN vol_qty b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY a.vox")
def box_blur(spark, sf_dir):
    return _out(stencils.box_blur(T.vol_qty(spark, sf_dir), 1), 6)


GAUSS = "WITH w AS (SELECT x, exp(-x * x / 2.0) / (SELECT SUM(exp(-y * y / 2.0)) FROM (SELECT UNNEST(range(-4, 5)) AS y) s) AS g FROM (SELECT UNNEST(range(-4, 5)) AS x) r)"
GAUSS_JOIN = "FROM vol_qty a JOIN vol_qty b ON abs(a.i - b.i) <= 4 AND abs(a.j - b.j) <= 4 AND abs(a.k - b.k) <= 4 JOIN w p ON p.x = b.i - a.i JOIN w q ON q.x = b.j - a.j JOIN w r ON r.x = b.k - a.k GROUP BY a.vox"


@query(f"{GAUSS} SELECT a.vox, round(SUM(p.g * q.g * r.g * b.v) / SUM(p.g * q.g * r.g), 5) AS v {GAUSS_JOIN}")
def gaussian_blur_norm(spark, sf_dir):
    return _out(stencils.gaussian_blur(T.vol_qty(spark, sf_dir), sigma=1.0), 5)


@query(f"{GAUSS} SELECT a.vox, round(SUM(p.g * q.g * r.g * b.v), 5) AS v {GAUSS_JOIN}")
def gaussian_blur_raw(spark, sf_dir):
    return _out(stencils.gaussian_blur(T.vol_qty(spark, sf_dir), sigma=1.0, normalize=False), 5)


@query("""WITH o AS (SELECT a.x, b.x AS y, c.x AS z, exp(-(a.x * a.x + b.x * b.x + c.x * c.x) / 2.0) AS g FROM (SELECT UNNEST(range(-1, 2)) AS x) a, (SELECT UNNEST(range(-1, 2)) AS x) b, (SELECT UNNEST(range(-1, 2)) AS x) c)
  SELECT a.vox, round(SUM(o.g * b.v) / (SELECT SUM(g) FROM o), 5) AS v FROM (SELECT x.i, y.j, z.k, x.i + (y.j - 1) * 16 + (z.k - 1) * 256 AS vox FROM (SELECT UNNEST(range(1, 17)) AS i) x, (SELECT UNNEST(range(1, 17)) AS j) y, (SELECT UNNEST(range(1, 8)) AS k) z) a, o, vol_qty b WHERE b.i = a.i + o.x AND b.j = a.j + o.y AND b.k = a.k + o.z
  AND a.i BETWEEN 2 AND 15 AND a.j BETWEEN 2 AND 15 AND a.k BETWEEN 2 AND 6 GROUP BY a.vox""")
def kernel_mapf(spark, sf_dir):
    offsets, weights = stencils.kernel_weights((3, 3, 3), (1.0, 1.0, 1.0))
    return _out(stencils.map_kernel(T.vol_qty(spark, sf_dir), offsets, weights), 5)


@query("""WITH m AS (SELECT a.vox, SUM(b.v) / 27.0 AS m, SUM(b.v * b.v) / 27.0 AS q FROM vol_qty a JOIN vol_qty b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY a.vox),
  s AS (SELECT vox, i, j, k, greatest(q - m * m, 0) / (greatest(q - m * m, 0) + 100.0) AS a, m FROM m JOIN vol_qty USING (vox)),
  c AS (SELECT vox, i, j, k, a, m - a * m AS b FROM s)
  SELECT x.vox, round(SUM(c.a) / 27.0 * x.v + SUM(c.b) / 27.0, 4) AS v FROM vol_qty x JOIN c ON abs(x.i - c.i) <= 1 AND abs(x.j - c.j) <= 1 AND abs(x.k - c.k) <= 1 GROUP BY x.vox, x.v""")
def guided_filter(spark, sf_dir):
    return _out(stencils.guided_filter(T.vol_qty(spark, sf_dir), 1, 100.0), 4)


@query("""WITH s AS (SELECT stddev_samp(v) AS sd FROM vol_qty),
  p AS (SELECT a.vox, b.v, exp(-((a.i - b.i) ** 2 + (a.j - b.j) ** 2 + (a.k - b.k) ** 2) / 8.0) * exp(-((a.v - b.v) ** 2) / (2 * sd * sd)) AS w
    FROM vol_qty a JOIN vol_qty b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1, s)
  SELECT vox, round(SUM(w * v) / SUM(w), 5) AS v FROM p GROUP BY vox""")
def bilateral(spark, sf_dir):
    return _out(stencils.bilateral_filter(T.vol_qty(spark, sf_dir), spatial_sigma=2.0, intensity_sigma=1.0, window=1), 5)


@query("""WITH s AS (SELECT stddev_pop(v) AS sd FROM vec_li),
  p AS (SELECT a.vox, a.t, b.v, exp(-((a.i - b.i) ** 2 + (a.j - b.j) ** 2 + (a.k - b.k) ** 2) / 8.0) * exp(-((a.t - b.t) ** 2) / 2.0) * exp(-((a.v - b.v) ** 2) / (2 * sd * sd)) AS w
    FROM vec_li a JOIN vec_li b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND abs(a.t - b.t) <= 1, s)
  SELECT vox, t, round(SUM(w * v) / SUM(w), 5) AS v FROM p GROUP BY vox, t""")
def bilateral_4d(spark, sf_dir):
    return _out(stencils.bilateral_filter_4d(T.vec_li(spark, sf_dir)), 5)


@query("""WITH o AS (SELECT UNNEST(range(-1, 2)) AS x), f AS (SELECT a.x, b.x AS y, c.x AS z, (a.x + 1) + 3 * (b.x + 1) + 9 * (c.x + 1) + 1 AS pos FROM o a, o b, o c)
  SELECT m.vox AS center, CAST(f.pos AS INT) AS pos, coalesce(b.v, 0) AS v FROM vol_qty m CROSS JOIN f
  LEFT JOIN vol_qty b ON b.i = greatest(1, least(16, m.i + f.x)) AND b.j = greatest(1, least(16, m.j + f.y)) AND b.k = greatest(1, least(7, m.k + f.z))""")
def patch_set(spark, sf_dir):
    q = T.vol_qty(spark, sf_dir)
    return stencils.patch_set(q, (3, 3, 3)).withColumnRenamed("value", "v")


_DESPIKED = """WITH box AS (SELECT a.vox, a.i, a.j, a.k, CAST(a.v AS DOUBLE) AS v, a.v - SUM(b.v) / 27.0::DOUBLE AS r FROM vol_qty a JOIN vol_qty b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY a.vox, a.i, a.j, a.k, a.v),
  mid AS (SELECT median(r) AS c FROM box), spread AS (SELECT 1.4826 * median(abs(r - c)) AS mad FROM box, mid), flagged AS (SELECT box.*, abs(r) > 3.5 * mad AS bad FROM box, spread),
  fixed AS (SELECT a.vox, median(b.v) AS new FROM flagged a JOIN flagged b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 WHERE a.bad AND NOT b.bad GROUP BY a.vox),
  clean AS (SELECT vox, i, j, k, CASE WHEN bad THEN coalesce(new, v) ELSE v END AS v FROM flagged LEFT JOIN fixed USING (vox))"""


@query(f"{_DESPIKED} SELECT vox, round(v, 6) AS v FROM clean")
def despike(spark, sf_dir):
    q = T.vol_qty(spark, sf_dir)
    return _out(stencils.despike(q, q), 6)


@query(f"""{_DESPIKED},
  rough AS (SELECT a.vox, a.v - SUM(b.v) / 27 AS r FROM clean a JOIN clean b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY a.vox, a.v),
  middle AS (SELECT median(r) AS c FROM rough), noise AS (SELECT 1.4826 * median(abs(r - c)) AS s FROM rough, middle),
  moments AS (SELECT a.vox, a.i, a.j, a.k, a.v, SUM(b.v) / 125 AS m, SUM(b.v * b.v) / 125 AS q FROM clean a JOIN clean b ON abs(a.i - b.i) <= 2 AND abs(a.j - b.j) <= 2 AND abs(a.k - b.k) <= 2 GROUP BY a.vox, a.i, a.j, a.k, a.v),
  lines AS (SELECT *, greatest(q - m * m, 0) / (greatest(q - m * m, 0) + 0.49) AS slope FROM moments),
  base AS (SELECT a.vox, a.i, a.j, a.k, (SUM(b.slope) * a.v + SUM(b.m - b.slope * b.m)) / 125 AS v FROM lines a JOIN lines b ON abs(a.i - b.i) <= 2 AND abs(a.j - b.j) <= 2 AND abs(a.k - b.k) <= 2 GROUP BY a.vox, a.i, a.j, a.k, a.v),
  inner_var AS (SELECT a.vox, greatest(SUM(b.v * b.v) / 125 - (SUM(b.v) / 125) ** 2, 0) AS var FROM base a JOIN base b ON abs(a.i - b.i) <= 2 AND abs(a.j - b.j) <= 2 AND abs(a.k - b.k) <= 2 GROUP BY a.vox),
  wide AS (SELECT a.vox, SUM(b.v) / 729 AS w FROM base a JOIN base b ON abs(a.i - b.i) <= 4 AND abs(a.j - b.j) <= 4 AND abs(a.k - b.k) <= 4 GROUP BY a.vox)
  SELECT base.vox, round(base.v + var / (var + s * s) * (base.v - w), 6) AS v FROM base JOIN inner_var USING (vox) JOIN wide USING (vox), noise""")
def enhance_stat_map(spark, sf_dir):
    q = T.vol_qty(spark, sf_dir)
    return _out(stencils.enhance_stat_map(q, q), 6)


@query("""WITH u AS (SELECT vox, i, j, k, (v - (SELECT min(v) FROM vol_qty)) / CAST((SELECT max(v) - min(v) FROM vol_qty) AS DOUBLE) AS s FROM vol_qty),
  o AS (SELECT UNNEST(range(-1, 2)) AS x), f AS (SELECT a.x, b.x AS y, c.x AS z, a.x + 3 * b.x + 9 * c.x AS pos FROM o a, o b, o c),
  p AS (SELECT m.vox, f.pos, coalesce(b.s, 0) AS s FROM u m CROSS JOIN f LEFT JOIN u b ON b.i = greatest(1, least(16, m.i + f.x)) AND b.j = greatest(1, least(16, m.j + f.y)) AND b.k = greatest(1, least(7, m.k + f.z))),
  pairs AS (SELECT a.vox AS a, b.vox AS b, b.s FROM u a JOIN u b ON abs(a.i - b.i) <= 2 AND abs(a.j - b.j) <= 2 AND abs(a.k - b.k) <= 2 AND a.vox <> b.vox),
  e AS (SELECT a, b, any_value(pairs.s) AS s, exp(-sum((x.s - y.s) ** 2) / 0.49) AS w FROM pairs JOIN p x ON x.vox = a JOIN p y ON y.vox = b AND y.pos = x.pos GROUP BY a, b),
  g AS (SELECT a, sum(w) AS d0, sum(w * s) AS y0, sum(w * w) AS d1, sum(w * w * s) AS y1 FROM e WHERE w > 1e-8 GROUP BY a),
  q AS (SELECT u.vox, u.s, u.s + (coalesce(y0, 0) - coalesce(d0, 0) * u.s) / (SELECT avg(d0) FROM g) AS s0, u.s + (coalesce(y1, 0) - coalesce(d1, 0) * u.s) / (SELECT avg(d1) FROM g) AS s1 FROM u LEFT JOIN g ON g.a = u.vox)
  SELECT vox, round(1 / (1 + exp(-4 * (s0 - 0.5))) + 2 / (1 + exp(s0 - s1)) - 1 + 2 / (1 + exp(s1 - s)) - 1, 6) AS v FROM q""")
def laplace_enhance(spark, sf_dir):
    q = T.vol_qty(spark, sf_dir)
    return _out(stencils.laplace_enhance(q, q), 6)


# components and extrema

_COMPONENTS = """RECURSIVE WITH {mask}, e AS (SELECT a.vox AS a, b.vox AS b FROM mask a JOIN mask b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) <= {n}),
  r(vox, root) AS (SELECT vox, vox FROM mask UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.vox WHERE r.root < e.b),
  l AS (SELECT vox, min(root) AS root FROM r GROUP BY vox), s AS (SELECT root, count(*) AS size FROM l GROUP BY root),
  c AS (SELECT root, size, row_number() OVER (ORDER BY size DESC, root) AS component FROM s)"""


def _components_sql(n: int) -> str:
    return _COMPONENTS.format(mask=MASK, n=n) + " SELECT vox, component, size FROM l JOIN c USING (root)"


@query(_components_sql(1))
def conn_comp_6(spark, sf_dir):
    return components.connected_components(_mask(spark, sf_dir), "6-connect")


@query(_components_sql(2))
def conn_comp_18(spark, sf_dir):
    return components.connected_components(_mask(spark, sf_dir), "18-connect")


@query(_components_sql(3))
def conn_comp_26(spark, sf_dir):
    return components.connected_components(_mask(spark, sf_dir), "26-connect")


@query(_COMPONENTS.format(mask=MASK, n=3) + " SELECT vox FROM l JOIN c USING (root) WHERE component = 1")
def largest_component(spark, sf_dir):
    return components.largest_component(_mask(spark, sf_dir)).data.select("vox")


@query(_COMPONENTS.format(mask=MASK, n=1) + """, t AS (SELECT component, vox, v, row_number() OVER (PARTITION BY component ORDER BY v DESC, vox) AS rn, count(*) OVER (PARTITION BY component) AS n FROM l JOIN c USING (root) JOIN vol_qty USING (vox))
  SELECT component, vox, n, CAST(n AS DOUBLE) AS area, v FROM t WHERE rn = 1""")
def conn_comp_table(spark, sf_dir):
    mask = _mask(spark, sf_dir)
    return components.component_table(mask, 0, "6-connect").withColumnRenamed("value", "v")


@query("SELECT a.vox, a.v FROM vol_qty a WHERE NOT EXISTS (SELECT 1 FROM vol_qty b WHERE abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND b.v > a.v)")
def local_maxima(spark, sf_dir):
    return components.local_maxima(T.vol_qty(spark, sf_dir)).select("vox", F.col("value").alias("v"))


@query(f"""RECURSIVE WITH {MASK}, g AS (SELECT * FROM (SELECT a.i, b.j, c.k, a.i + (b.j - 1) * 16 + (c.k - 1) * 256 AS vox FROM (SELECT UNNEST(range(1, 17)) AS i) a, (SELECT UNNEST(range(1, 17)) AS j) b, (SELECT UNNEST(range(1, 8)) AS k) c) x WHERE vox NOT IN (SELECT vox FROM mask)),
  o(vox) AS (SELECT vox FROM g WHERE i IN (1, 16) OR j IN (1, 16) OR k IN (1, 7) UNION SELECT b.vox FROM o JOIN g a ON a.vox = o.vox JOIN g b ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1)
  SELECT vox FROM mask UNION SELECT vox FROM g WHERE vox NOT IN (SELECT vox FROM o)""")
def fill_holes(spark, sf_dir):
    return components.fill_holes(_mask(spark, sf_dir)).data


# graphs


@query("""WITH p AS (SELECT a.vox AS a, b.vox AS b, count(*) AS n, sum(x.v * y.v) AS xy, sum(x.v) AS x, sum(y.v) AS y, sum(x.v * x.v) AS xx, sum(y.v * y.v) AS yy
    FROM (SELECT DISTINCT vox, i, j, k FROM vec_ev) a JOIN (SELECT DISTINCT vox, i, j, k FROM vec_ev) b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND a.vox <> b.vox
    JOIN vec_ev x ON x.vox = a.vox JOIN vec_ev y ON y.vox = b.vox AND y.t = x.t GROUP BY 1, 2)
  SELECT a, b, CAST(n AS BIGINT) AS n, round(CASE WHEN n < 3 OR (CAST(n AS DOUBLE) * xx - CAST(x AS DOUBLE) * x) * (CAST(n AS DOUBLE) * yy - CAST(y AS DOUBLE) * y) = 0 THEN 0 ELSE greatest(-0.999999, least(0.999999, (CAST(n AS DOUBLE) * xy - CAST(x AS DOUBLE) * y) / sqrt((CAST(n AS DOUBLE) * xx - CAST(x AS DOUBLE) * x) * (CAST(n AS DOUBLE) * yy - CAST(y AS DOUBLE) * y)))) END, 5) AS r FROM p""")
def corr_edges(spark, sf_dir):
    return graphs.neighbour_correlations(T.vec_ev(spark, sf_dir)).select("a", "b", "n", F.round("r", 5).alias("r"))


_GRAPH = """WITH c AS (SELECT DISTINCT vox, i, j, k FROM vec_ev),
  p AS (SELECT a.vox AS a, b.vox AS b, any_value((a.i - b.i) ** 2 + (a.j - b.j) ** 2 + (a.k - b.k) ** 2) AS d2, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x.v * y.v) AS DOUBLE) AS xy,
    CAST(sum(x.v) AS DOUBLE) AS x, CAST(sum(y.v) AS DOUBLE) AS y, CAST(sum(x.v * x.v) AS DOUBLE) AS xx, CAST(sum(y.v * y.v) AS DOUBLE) AS yy
    FROM c a JOIN c b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND a.vox <> b.vox
    JOIN vec_ev x ON x.vox = a.vox JOIN vec_ev y ON y.vox = b.vox AND y.t = x.t GROUP BY 1, 2),
  q AS (SELECT a, b, d2, least(0.999999, (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y))) AS r FROM p WHERE n >= 3 AND (n * xx - x * x) * (n * yy - y * y) > 0),
  f AS (SELECT a, b, r * r * exp(-d2 / 8.0) AS w FROM q WHERE r > 0),
  e AS (SELECT a, b, w FROM f QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) <= 4 UNION ALL SELECT vox, vox, 1e-12 FROM c),
  g AS (SELECT a AS vox, b AS near, w / sum(w) OVER (PARTITION BY a) AS w FROM e)"""


@query(f"{_GRAPH} SELECT vox, near, round(w, 6) AS w FROM g")
def corr_edges_topk(spark, sf_dir):
    graph = graphs.correlation_graph([T.vec_ev(spark, sf_dir)], topk=4)
    return graph.select("vox", "near", F.round("w", 6).alias("w"))


@query(f"{_GRAPH}, m AS (SELECT g.vox, y.t, sum(g.w * y.v) AS v FROM g JOIN vec_ev y ON y.vox = g.near GROUP BY 1, 2) SELECT x.vox, x.t, round(m.v, 5) AS v FROM vec_ev x JOIN m ON m.vox = x.vox AND m.t = x.t")
def graph_smooth(spark, sf_dir):
    image = T.vec_ev(spark, sf_dir)
    return _out(graphs.graph_smooth(image, graphs.correlation_graph([image], topk=4)), 5)


def _three_runs(spark, sf_dir):
    """The days 1 to 10, 11 to 20 and 21 to 31 as runs of their own."""
    image = T.vec_ev(spark, sf_dir)
    spans = [(1, 10), (11, 20), (21, 31)]
    cut = lambda a, b: image.data.where(F.col("t").between(a, b)).select("vox", (F.col("t") - (a - 1)).alias("t"), "value")
    return image, [image.with_data(cut(a, b), Space((*T.EV.space_dims, b - a + 1))) for a, b in spans]


_RUNS = """WITH c AS (SELECT DISTINCT vox, i, j, k FROM vec_ev), runs AS (SELECT vox, t, v, CASE WHEN t <= 10 THEN 0 WHEN t <= 20 THEN 1 ELSE 2 END AS run FROM vec_ev),
  p AS (SELECT x.run, a.vox AS a, b.vox AS b, any_value((a.i - b.i) ** 2 + (a.j - b.j) ** 2 + (a.k - b.k) ** 2) AS d2, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x.v * y.v) AS DOUBLE) AS xy,
    CAST(sum(x.v) AS DOUBLE) AS x, CAST(sum(y.v) AS DOUBLE) AS y, CAST(sum(x.v * x.v) AS DOUBLE) AS xx, CAST(sum(y.v * y.v) AS DOUBLE) AS yy
    FROM c a JOIN c b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND a.vox <> b.vox
    JOIN runs x ON x.vox = a.vox JOIN runs y ON y.vox = b.vox AND y.t = x.t GROUP BY 1, 2, 3),
  q AS (SELECT run, a, b, d2, greatest(1.0, n - 3) AS w, CASE WHEN n < 3 OR (n * xx - x * x) * (n * yy - y * y) = 0 THEN 0.0
    ELSE greatest(-0.999999, least(0.999999, (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)))) END AS r FROM p),
  o AS (SELECT out.k AS run, a, b, any_value(d2) AS d2, tanh(sum(w * atanh(r)) / sum(w)) AS r FROM q, (VALUES (0), (1), (2)) out(k) WHERE q.run <> out.k GROUP BY 1, 2, 3),
  e AS (SELECT run, a, b, r * r * exp(-d2 / 8.0) AS w FROM o WHERE r > 1e-9 UNION ALL SELECT out.k, vox, vox, 1e-12 FROM c, (VALUES (0), (1), (2)) out(k)),
  g AS (SELECT run, a AS vox, b AS near, w / sum(w) OVER (PARTITION BY run, a) AS w FROM e)"""


@query(f"{_RUNS} SELECT CAST(run AS INT) AS run, vox, near, round(w, 6) AS w FROM g WHERE w > 1e-6")
def graph_leave_one_out(spark, sf_dir):
    """Each run's graph from the two others."""
    image, runs = _three_runs(spark, sf_dir)
    every = graphs.leave_one_out_graphs(runs, image.mask(F.lit(True)), topk=0)
    out = reduce(DataFrame.union, [g.select(F.lit(k).alias("run"), "vox", "near", "w") for k, g in enumerate(every)])
    return out.where("w > 1e-6").select("run", "vox", "near", F.round("w", 6).alias("w"))


@query(f"""{_RUNS}, m AS (SELECT g.run, g.vox, y.t, sum(g.w * y.v) AS v FROM g JOIN runs y ON y.vox = g.near AND y.run = g.run GROUP BY 1, 2, 3)
  SELECT CAST(x.run AS INT) AS run, x.vox, CAST(x.t - 10 * x.run AS INT) AS t, round(m.v, 4) AS v FROM runs x JOIN m ON m.vox = x.vox AND m.t = x.t AND m.run = x.run""")
def graph_filter_runs(spark, sf_dir):
    """Three runs, each smoothed along the graph of the two others."""
    image, runs = _three_runs(spark, sf_dir)
    smoothed = graphs.graph_filter(runs, image.mask(F.lit(True)), window=1, leave_one_out=True, topk=0)
    return reduce(DataFrame.union, [_out(x, 4).select(F.lit(k).alias("run"), "vox", "t", "v") for k, x in enumerate(smoothed)])


# other grids


@query("SELECT vox, v FROM vol_qty WHERE FALSE UNION ALL SELECT CAST(a.i + (b.i - 1) * 8 + (c.i - 1) * 64 AS BIGINT), v FROM (SELECT UNNEST(range(1, 9)) AS i) a, (SELECT UNNEST(range(1, 9)) AS i) b, (SELECT UNNEST(range(1, 8)) AS i) c JOIN vol_qty ON vol_qty.k = c.i AND vol_qty.i = 2 * a.i - 1 AND vol_qty.j = 2 * b.i - 1")
def resample_nearest(spark, sf_dir):
    return _out(resampling.resample(T.vol_qty(spark, sf_dir), Space((8, 8, 7), spacing=(2.0, 2.0, 1.0)), "nearest"))


@query("""WITH g AS (SELECT a.i AS a, b.i AS b, c.i AS c, (a.i - 1) * 1.5 + 1 AS x, (b.i - 1) * 1.5 + 1 AS y, (c.i - 1) * 1.5 + 1 AS z FROM (SELECT UNNEST(range(1, 11)) AS i) a, (SELECT UNNEST(range(1, 11)) AS i) b, (SELECT UNNEST(range(1, 6)) AS i) c)
  SELECT CAST(g.a + (g.b - 1) * 10 + (g.c - 1) * 100 AS BIGINT) AS vox, round(SUM((1 - abs(x - i)) * (1 - abs(y - j)) * (1 - abs(z - k)) * v), 6) AS v
  FROM g JOIN vol_qty ON abs(x - i) < 1 AND abs(y - j) < 1 AND abs(z - k) < 1 WHERE x <= 16 AND y <= 16 AND z <= 7 GROUP BY g.a, g.b, g.c""")
def resample_linear(spark, sf_dir):
    return _out(resampling.resample(T.vol_qty(spark, sf_dir), Space((10, 10, 5), spacing=(1.5, 1.5, 1.5)), "linear"), 6)


@query("""WITH g AS (SELECT a.i AS a, b.i AS b, c.i AS c, (a.i - 1) * 1.5 + 1 AS x, (b.i - 1) * 1.5 + 1 AS y, (c.i - 1) * 1.5 + 1 AS z FROM (SELECT UNNEST(range(1, 11)) AS i) a, (SELECT UNNEST(range(1, 11)) AS i) b, (SELECT UNNEST(range(1, 6)) AS i) c),
  d AS (SELECT a, b, c, v, CAST(abs(x - i) AS DOUBLE) AS p, CAST(abs(y - j) AS DOUBLE) AS q, CAST(abs(z - k) AS DOUBLE) AS r FROM g JOIN vol_qty ON abs(x - i) < 2 AND abs(y - j) < 2 AND abs(z - k) < 2 WHERE x <= 16 AND y <= 16 AND z <= 7),
  w AS (SELECT a, b, c, v, CASE WHEN p < 1 THEN 1.5 * p ** 3 - 2.5 * p ** 2 + 1 ELSE -0.5 * p ** 3 + 2.5 * p ** 2 - 4 * p + 2 END AS p, CASE WHEN q < 1 THEN 1.5 * q ** 3 - 2.5 * q ** 2 + 1 ELSE -0.5 * q ** 3 + 2.5 * q ** 2 - 4 * q + 2 END AS q,
    CASE WHEN r < 1 THEN 1.5 * r ** 3 - 2.5 * r ** 2 + 1 ELSE -0.5 * r ** 3 + 2.5 * r ** 2 - 4 * r + 2 END AS r FROM d)
  SELECT CAST(a + (b - 1) * 10 + (c - 1) * 100 AS BIGINT) AS vox, round(SUM(p * q * r * v), 6) AS v FROM w WHERE p <> 0 AND q <> 0 AND r <> 0 GROUP BY a, b, c""")
def resample_cubic(spark, sf_dir):
    return _out(resampling.resample(T.vol_qty(spark, sf_dir), Space((10, 10, 5), spacing=(1.5, 1.5, 1.5)), "cubic"), 6)


@query("SELECT (17 - i) + (17 - j) * 0 + (j - 1) * 16 + (k - 1) * 256 AS vox, v FROM vol_qty")
def reorient_flip(spark, sf_dir):
    return _out(resampling.reorient(T.vol_qty(spark, sf_dir, T.WORLD), ("R", "A", "S")))


@query("SELECT k + (j - 1) * 7 + (17 - i - 1) * 112 AS vox, v FROM vol_qty")
def reorient_permute(spark, sf_dir):
    return _out(resampling.reorient(T.vol_qty(spark, sf_dir, T.WORLD), ("S", "A", "R")))


@query("SELECT (17 - i) + (j - 1) * 16 + (k - 1) * 256 AS vox, v FROM vol_qty")
def as_canonical(spark, sf_dir):
    return _out(resampling.as_canonical(T.vol_qty(spark, sf_dir, T.WORLD)))


# along time


@query("SELECT vox, t, v FROM vec_li UNION ALL SELECT vox, 8, v FROM vol_qty UNION ALL SELECT vox, t + 8, v FROM vec_li")
def concat_time(spark, sf_dir):
    li, q = T.vec_li(spark, sf_dir), T.vol_qty(spark, sf_dir)
    return _out(sets.concat(li, q, li))


@query("SELECT vox, CAST(p.new AS INT) AS t, v FROM vec_li JOIN (VALUES (5, 1), (2, 2), (5, 3)) p(old, new) ON vec_li.t = p.old")
def sub_vector(spark, sf_dir):
    return _out(sets.sub_vector(T.vec_li(spark, sf_dir), [5, 2, 5]))


@query("SELECT vox, v FROM vec_li WHERE t = 3")
def volume_at(spark, sf_dir):
    return _out(sets.volume_at(T.vec_li(spark, sf_dir), 3))


@query("SELECT CASE WHEN t <= 3 THEN 1 ELSE 2 END AS block, vox, CASE WHEN t <= 3 THEN t ELSE t - 3 END AS t, v FROM vec_li")
def split_blocks(spark, sf_dir):
    blocks = spark.range(1, 8).select(F.col("id").cast("int").alias("t"), F.when(F.col("id") <= 3, 1).otherwise(2).alias("block"))
    return aggregates.split_blocks(T.vec_li(spark, sf_dir), blocks).withColumnRenamed("value", "v")


@query("SELECT 'qty' AS feature, vox, t, v FROM vec_li UNION ALL SELECT 'twice', vox, t, 2 * v FROM vec_li")
def hyper_vec(spark, sf_dir):
    li = T.vec_li(spark, sf_dir)
    return sets.hyper({"qty": li, "twice": li.map(lambda v: v * 2)}).withColumnRenamed("value", "v")


def _hyper(spark, sf_dir) -> hyper.HyperImage:
    """Trials and two features of the line items, in small chunks on a table."""
    li = T.vec_li(spark, sf_dir)
    rows = sets.hyper({"1": li, "2": li.map(lambda v: v * 2)}).select(F.col("feature").cast("int").alias("feature"), F.col("t").alias("trial"), "vox", "value")
    image = hyper.from_cells(Space((*T.LI.dims, 2)), rows, (4, 4, 4, 3, 1))
    return image.write(f"{runtime.shared_dir(spark)}/hyper-{uuid.uuid4().hex}")


_CELLS = "five AS (SELECT 1 AS feature, t AS trial, vox, i, j, k, CAST(v AS DOUBLE) AS v FROM vec_li UNION ALL SELECT 2, t, vox, i, j, k, CAST(2 * v AS DOUBLE) FROM vec_li)"
_EVERY = "grid AS (SELECT f.n AS feature, t.n AS trial, x.n AS vox FROM (SELECT UNNEST(range(1, 3)) AS n) f, (SELECT UNNEST(range(1, 8)) AS n) t, (SELECT UNNEST(range(1, 1793)) AS n) x)"


@query(f"WITH {_CELLS} SELECT DISTINCT g.feature, CAST(g.trial AS INT) AS trial, g.vox, coalesce(b.v, 0) AS v FROM (SELECT p.vox, f.n AS feature, u.n AS trial FROM five p, (VALUES (2)) f(n), (VALUES (2), (5), (6)) u(n) WHERE p.i BETWEEN 3 AND 9 AND p.j IN (1, 8, 16) AND p.k <= 5 AND p.feature = 2 AND (p.trial - 1) // 3 = (u.n - 1) // 3) g LEFT JOIN five b ON b.feature = g.feature AND b.trial = g.trial AND b.vox = g.vox")
def hyper_subset(spark, sf_dir):
    """Cells of a five-dimensional image by conditions on every axis; a voxel that holds a value in a chunk has all of the chunk's trials."""
    cells = hyper.subset(_hyper(spark, sf_dir), i=(3, 9), j=[1, 8, 16], k=(1, 5), trial=[2, 5, 6], feature=[2])
    return cells.withColumnRenamed("value", "v")


@query(f"WITH {_CELLS}, {_EVERY} SELECT CAST(g.feature AS INT) AS feature, CAST(g.trial AS INT) AS trial, g.vox, coalesce(five.v, 0) AS v FROM grid g LEFT JOIN five ON five.feature = g.feature AND five.trial = g.trial AND five.vox = g.vox")
def hyper_dense(spark, sf_dir):
    return hyper.dense(_hyper(spark, sf_dir)).withColumnRenamed("value", "v")


@query(f"WITH {_CELLS}, {_EVERY} SELECT CAST(g.feature AS INT) AS feature, CAST(g.trial AS INT) AS trial, coalesce(five.v, 0) AS v FROM grid g LEFT JOIN five ON five.feature = g.feature AND five.trial = g.trial AND five.vox = g.vox WHERE g.vox = 2 + 4 * 16 + 2 * 256")
def hyper_series(spark, sf_dir):
    """Features and trials at the voxel (2, 5, 3)."""
    return hyper.series(_hyper(spark, sf_dir), 2, 5, 3).withColumnRenamed("value", "v")


@query("WITH u AS (SELECT vec_id, UNNEST(embedding) AS x, UNNEST(range(1, 65)) AS t FROM embeddings) SELECT vec_id + 1 AS vox, CAST(t AS INT) AS t, round((x::DOUBLE - avg(x::DOUBLE) OVER w) / stddev_samp(x::DOUBLE) OVER w, 5) AS v FROM u WINDOW w AS (PARTITION BY vec_id)")
def emb_scale(spark, sf_dir):
    e = T.read(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("vox"), F.posexplode("embedding").alias("t", "value"))
    image = Image(Space((1 << 20, 1, 1, 64)), e.select("vox", (F.col("t") + 1).alias("t"), F.col("value").cast("double").alias("value")))
    return _out(windows.scale_series(image), 5)


@query("""WITH u AS (SELECT vec_id, UNNEST(embedding)::DOUBLE AS x, UNNEST(range(1, 65)) AS t FROM embeddings)
  SELECT a.vec_id + 1 AS a, b.vec_id + 1 AS b, round(corr(a.x, b.x), 5) AS r FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 AND a.t = b.t GROUP BY 1, 2""")
def emb_corr(spark, sf_dir):
    e = T.read(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("vox"), F.posexplode("embedding").alias("t", "value"))
    image = Image(Space((1 << 20, 1, 1, 64)), e)
    pairs = image.data.select(F.col("vox").alias("a"), (F.col("vox") + 1).alias("b")).distinct()
    return graphs.correlations(image, pairs).select("a", "b", F.round("r", 5).alias("r"))


_BY_TIME = ", ".join(f"CAST(coalesce(MAX(CASE WHEN t = {t} THEN v END), 0) AS BIGINT) AS t{t}" for t in range(1, 8))


@query(f"SELECT vox, {_BY_TIME} FROM vec_li GROUP BY vox")
def to_matrix(spark, sf_dir):
    return aggregates.to_matrix(T.vec_li(spark, sf_dir))


@query("""WITH c AS (SELECT DISTINCT vox FROM vec_ev), g AS (SELECT vox, t.n AS t FROM c, (SELECT UNNEST(range(1, 32)) AS n) t), x AS (SELECT g.vox, g.t, coalesce(v, 0) AS v FROM g LEFT JOIN vec_ev e ON e.vox = g.vox AND e.t = g.t)
  SELECT vox, CAST((t - 1) // 10 AS INT) AS tile, string_agg(CAST(v AS VARCHAR), ',' ORDER BY t) AS v FROM x WHERE (vox, (t - 1) // 10) IN (SELECT (vox, (t - 1) // 10) FROM vec_ev) GROUP BY 1, 2""")
def matrix_tiles(spark, sf_dir):
    """Series in tiles of ten times."""
    rows = aggregates.matrix_tiles(T.vec_ev(spark, sf_dir), 10)
    return rows.select("vox", "tile", F.array_join(F.col("values").cast("array<string>"), ",").alias("v"))


@query("""WITH n AS (SELECT vox, row_number() OVER (ORDER BY vox) AS col FROM (SELECT DISTINCT vox FROM vec_ev) u), a AS (SELECT x AS col, 1 + x % 31 AS t FROM (SELECT UNNEST(range(1, 500)) AS x) r)
  SELECT CAST(a.t AS INT) AS t, a.col, coalesce(v, 0) AS v FROM a JOIN n USING (col) LEFT JOIN vec_ev e ON e.vox = n.vox AND e.t = a.t""")
def matricized_access(spark, sf_dir):
    """Single cells of the matrix of times by voxels."""
    cells = spark.range(1, 500).select((1 + F.col("id") % 31).cast("int").alias("t"), F.col("id").alias("col"))
    return aggregates.matricized_access(T.vec_ev(spark, sf_dir), cells).withColumnRenamed("value", "v")


@query("""WITH c AS (SELECT cluster, AVG(i) AS x, AVG(j) AS y, AVG(k) AS z FROM parcel GROUP BY cluster),
  n AS (SELECT a.cluster, b.cluster AS near FROM c a, c b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.05),
  m AS (SELECT cluster, t, AVG(v) AS m FROM vec_li JOIN parcel USING (vox) GROUP BY cluster, t)
  SELECT CAST(n.cluster AS INT) AS cluster, CAST(near AS INT) AS near, t, round(m, 6) AS v FROM n JOIN m ON m.cluster = n.near""")
def cluster_searchlight_series(spark, sf_dir):
    image = T.vec_li(spark, sf_dir)
    found = aggregates.cluster_searchlight_series(image, T.parcels(T.vol_qty(spark, sf_dir)), radius=0.05)
    return found.select("cluster", "near", "t", F.round("value", 6).alias("v"))


@query("WITH m AS (SELECT MIN(v) AS a, MAX(v) AS b FROM vol_qty) SELECT vox, CAST(greatest(1, least(16, FLOOR((v - a) / CAST(b - a AS DOUBLE) * 16) + 1)) AS INT) AS bin FROM vol_qty, m")
def colour_bins(spark, sf_dir):
    data = T.vol_qty(spark, sf_dir).data
    low, high = data.agg(F.min("value"), F.max("value")).first()
    return data.select("vox", colours.colour_bin(F.col("value"), low, high, 16).alias("bin"))


# by draw; rows only


@query("SELECT vox, CAST(v AS DOUBLE) AS v FROM vol_qty")
def nifti_round_trip(spark, sf_dir):
    """An image written to a file in the shared folder and read back, sparse as it was."""
    path = f"{runtime.shared_dir(spark)}/vol_qty-{uuid.uuid4().hex}.nii.gz"
    nifti.write_image(T.vol_qty(spark, sf_dir), path)
    return _out(nifti.read_image(spark, path).sparse())


@query(None)
def clustered_searchlight(spark, sf_dir):
    return neighbourhoods.clustered_searchlight(_mask(spark, sf_dir), k=6)


@query(None)
def blobby_searchlight(spark, sf_dir):
    return neighbourhoods.resampled_searchlight(_mask(spark, sf_dir), 2.0, draws=20, shape=neighbourhoods.blobby_shape())


@query(None)
def random_searchlight(spark, sf_dir):
    return neighbourhoods.random_searchlight(_mask(spark, sf_dir), 2.0)


@query(None)
def resampled_searchlight(spark, sf_dir):
    return neighbourhoods.resampled_searchlight(_mask(spark, sf_dir), 2.0, draws=50)


#: First centers of the k-means with SQL, in world coordinates, and the rounds that its SQL goes on for (it comes to rest before).
_FIRST = [(2.0, 2.0, 1.0), (12.0, 3.0, 1.0), (3.0, 12.0, 2.0), (13.0, 13.0, 1.0), (2.0, 3.0, 5.0), (12.0, 2.0, 5.0), (3.0, 13.0, 4.0), (8.0, 8.0, 3.0)]
_ROUNDS = 60


def _kmeans_sql() -> str:
    d = " + ".join(f"(p.{a} - c.{a}) * (p.{a} - c.{a})" for a in "xyz")
    parts = ["p AS MATERIALIZED (SELECT vox, CAST(i - 1 AS DOUBLE) AS x, CAST(j - 1 AS DOUBLE) AS y, CAST(k - 1 AS DOUBLE) AS z FROM mask)"]
    parts.append("c0(n, x, y, z) AS MATERIALIZED (VALUES " + ", ".join(f"({n}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for n, (x, y, z) in enumerate(_FIRST, 1)) + ")")
    for r in range(_ROUNDS):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vox, any_value(p.x) AS x, any_value(p.y) AS y, any_value(p.z) AS z, arg_min(c.n, {{'d': {d}, 'n': c.n}}) AS n FROM p, c{r} c GROUP BY vox)")
        mean = ", ".join(f"coalesce(avg(a.{a}), any_value(c.{a})) AS {a}" for a in "xyz")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.n, {mean} FROM c{r} c LEFT JOIN a{r} a ON a.n = c.n GROUP BY c.n)")
    return f"WITH {MASK}, {', '.join(parts)} SELECT vox, CAST(n AS INT) AS cluster FROM a{_ROUNDS - 1}"


@query(_kmeans_sql())
def partition_first(spark, sf_dir):
    """k-means from given first centers."""
    return aggregates.partition(_mask(spark, sf_dir), len(_FIRST), first=_FIRST)


@query(None)
def partition_kmeans(spark, sf_dir):
    return aggregates.partition(_mask(spark, sf_dir), 8)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of a masked series by parcel and time."""
    image = filters.apply_mask(T.vec_li(spark, sf_dir), _mask(spark, sf_dir))
    means = aggregates.parcel_series(image, T.parcel_grid(spark, image.space))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("t"))
    return means.select("cluster", "t", F.round("value", 6).alias("mean"), rank.alias("nth"))
