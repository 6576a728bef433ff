"""Queries on grids, affines, labels, colours, regions and weighted graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colours
from ..operators import aggregates, filters, graphs, joins, resampling
from ..space import Space
from . import tables as T
from .registry import MASK, mask_of, out, query


@query("SELECT vox, round(-2.0 * (i - 1) + 31, 6) AS x, round(3.0 * (j - 1) - 19, 6) AS y, round(2.5 * (k - 1) - 9, 6) AS z FROM vol_qty")
def grid_to_grid(spark, sf_dir):
    g = T.vol_qty(spark, sf_dir).gridded()
    place = resampling.to_grid_of(T.WORLD, T.QTY, F.col("i"), F.col("j"), F.col("k"))
    return g.select("vox", *[F.round(p, 6).alias(n) for p, n in zip(place, "xyz")])


@query("""WITH g AS (SELECT a.a, b.b, c.c FROM (SELECT UNNEST(range(0, 16)) AS a) a, (SELECT UNNEST(range(0, 24)) AS b) b, (SELECT UNNEST(range(0, 9)) AS c) c)
  SELECT CAST(a + 1 + b * 16 + c * 384 AS BIGINT) AS vox, v FROM g JOIN vol_qty ON i = 16 - a AND j = round(2 * b / 3.0) + 1 AND k = round(0.8 * c) + 1""")
def deoblique(spark, sf_dir):
    return out(resampling.deoblique(T.vol_qty(spark, sf_dir, T.WORLD), "nearest"))


@query("SELECT CAST(a.i + (b.i - 1) * 8 + (c.i - 1) * 64 AS BIGINT) AS vox, cluster FROM (SELECT UNNEST(range(1, 9)) AS i) a, (SELECT UNNEST(range(1, 9)) AS i) b, (SELECT UNNEST(range(1, 8)) AS i) c JOIN parcel ON parcel.k = c.i AND parcel.i = 2 * a.i - 1 AND parcel.j = 2 * b.i - 1")
def resample_labels(spark, sf_dir):
    parcels = T.parcels(T.vol_qty(spark, sf_dir))
    found = resampling.resample_labels(parcels, T.QTY, Space((8, 8, 7), spacing=(2.0, 2.0, 1.0)))
    return found.select("vox", F.col("cluster").cast("long").alias("cluster"))


@query("""WITH m AS (SELECT MIN(v) AS a, MAX(v) AS b FROM vol_qty)
  SELECT vox, CASE WHEN v = 0 OR (v > 0 AND v < 200) THEN '#00000000' ELSE CASE CAST(greatest(1, least(4, FLOOR((v - a) / CAST(b - a AS DOUBLE) * 4) + 1)) AS INT) WHEN 1 THEN '#000000' WHEN 2 THEN '#550000' WHEN 3 THEN '#aa0000' ELSE '#ff0000' END END AS colour FROM vol_qty, m""")
def map_to_colours(spark, sf_dir):
    data = T.vol_qty(spark, sf_dir).data
    low, high = data.agg(F.min("value"), F.max("value")).first()
    return data.select("vox", colours.map_to_colours(F.col("value"), ["#000000", "#550000", "#aa0000", "#ff0000"], low, high, (0, 200)).alias("colour"))


@query(f"""WITH {MASK}, o AS (SELECT UNNEST(range(-1, 2)) AS x), f AS (SELECT a.x, b.x AS y, c.x AS z FROM o a, o b, o c WHERE abs(a.x) + abs(b.x) + abs(c.x) IN (1, 2)),
  n AS (SELECT m.vox, count(b.vox) AS n FROM mask m CROSS JOIN f LEFT JOIN mask b ON b.i = greatest(1, least(16, m.i + f.x)) AND b.j = greatest(1, least(16, m.j + f.y)) AND b.k = greatest(1, least(7, m.k + f.z)) GROUP BY m.vox),
  core AS (SELECT mask.* FROM mask JOIN n USING (vox) WHERE n >= 6)
  SELECT vox FROM core UNION SELECT m.vox FROM mask m JOIN core c ON abs(m.i - c.i) <= 1 AND abs(m.j - c.j) <= 1 AND abs(m.k - c.k) <= 1 AND abs(m.i - c.i) + abs(m.j - c.j) + abs(m.k - c.k) IN (1, 2)""")
def peel_restore(spark, sf_dir):
    return filters.peel_restore(mask_of(spark, sf_dir), 1, 6).data.select("vox")


@query("""WITH r AS (SELECT a.cluster AS roi, a.vox FROM parcel a JOIN parcel b USING (vox) WHERE a.cluster <= 2)
  SELECT CAST(roi AS INT) AS roi, r.vox, CAST(g.t AS INT) AS t, coalesce(v, 0) AS v FROM r CROSS JOIN (SELECT UNNEST(range(1, 8)) AS t) g LEFT JOIN vec_li ON vec_li.vox = r.vox AND vec_li.t = g.t""")
def series_roi(spark, sf_dir):
    rois = T.parcels(T.vol_qty(spark, sf_dir)).where("cluster <= 2").select(F.col("cluster").cast("int").alias("roi"), "vox")
    return joins.series_roi(T.vec_li(spark, sf_dir), rois).withColumnRenamed("value", "v")


@query("SELECT CAST(p.cluster AS INT) AS cluster, l.t, round(SUM(c.v * l.v) / CAST(SUM(c.v) AS DOUBLE), 6) AS v FROM vec_li l JOIN parcel p ON p.vox = l.vox JOIN vol_cnt c ON c.vox = l.vox GROUP BY p.cluster, l.t")
def parcel_series_weighted(spark, sf_dir):
    """Voxels weighed by the number of their line items."""
    weights = T.vol_cnt(spark, sf_dir).data.withColumnRenamed("value", "w")
    found = aggregates.parcel_series(T.vec_li(spark, sf_dir), T.parcels(T.vol_qty(spark, sf_dir)), weights=weights)
    return found.select(F.col("cluster").cast("int").alias("cluster"), F.col("t").cast("int").alias("t"), F.round("value", 6).alias("v"))


@query("SELECT vox, CAST(cluster AS INT) AS cluster, CASE cluster WHEN 2 THEN 'front' ELSE 'Clus_' || CAST(cluster AS VARCHAR) END AS label FROM parcel WHERE cluster IN (2, 5)")
def parcels_by_name(spark, sf_dir):
    parcels = T.parcels(T.vol_qty(spark, sf_dir)).withColumn("cluster", F.col("cluster").cast("int"))
    labels = aggregates.label_map(parcels, {2: "front"})
    return aggregates.parcels_named(parcels, labels, ["front", "Clus_5"]).join(labels, "cluster").select("vox", "cluster", "label")


#: Weights of the days, falling through the month.
_DAYS = [1 - (t - 1) / 62 for t in range(1, 32)]


@query("""WITH c AS (SELECT DISTINCT vox, i, j, k FROM vec_ev), x AS (SELECT vox, t, CAST(v AS DOUBLE) AS v, 1 - (t - 1) / 62.0::DOUBLE AS w FROM vec_ev), sw AS (SELECT SUM(1 - (t - 1) / 62.0::DOUBLE) AS s FROM (SELECT UNNEST(range(1, 32)) AS t)),
  m AS (SELECT vox, SUM(w * v) AS m, SUM(w * v * v) AS q FROM x GROUP BY vox),
  p AS (SELECT a.vox AS a, b.vox AS b, (a.i - b.i) ** 2 + (a.j - b.j) ** 2 + (a.k - b.k) ** 2 AS d2 FROM c a JOIN c b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND a.vox <> b.vox),
  xy AS (SELECT p.a, p.b, SUM(y.w * y.v * z.v) AS xy FROM p JOIN x y ON y.vox = p.a JOIN x z ON z.vox = p.b AND z.t = y.t GROUP BY 1, 2),
  r AS (SELECT p.a, p.b, d2, (coalesce(xy, 0) - y.m * z.m / s) / sqrt((y.q - y.m * y.m / s) * (z.q - z.m * z.m / s)) AS r FROM p LEFT JOIN xy USING (a, b) JOIN m y ON y.vox = p.a JOIN m z ON z.vox = p.b, sw),
  e AS (SELECT a, b, r * r * exp(-d2 / 8.0) AS w FROM r WHERE r > 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) <= 4 UNION ALL SELECT vox, vox, 1e-12 FROM c)
  SELECT a AS vox, b AS near, round(w / SUM(w) OVER (PARTITION BY a), 6) AS w FROM e""")
def corr_graph_weighted(spark, sf_dir):
    """Correlations of series whose days weigh less and less."""
    graph = graphs.correlation_graph([T.vec_ev(spark, sf_dir)], topk=4, time_weights=[_DAYS])
    return graph.select("vox", "near", F.round("w", 6).alias("w"))
