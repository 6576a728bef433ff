"""Queries on thresholds, masks and drawn regions, with SQL that follows the same steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import affine
from ..operators import aggregates, components, filters, graphs, neighbourhoods, resampling, stencils, windows
from ..space import Space
from . import tables as T
from .registry import MASK, mask_of, out, query

#: Rounds of the halving of a threshold, in the operator and in SQL.
_HALVINGS = 66


def _levels_sql(name: str, rows: str, fraction: float = 0.5) -> str:
    """CTEs that end in ``name(region, level)``, the clip levels of the rows ``(region, v)`` of a CTE."""
    p = [f"{name}_good AS MATERIALIZED (SELECT region, CAST(v AS DOUBLE) AS v FROM {rows} WHERE v > 0)"]
    p.append(f"{name}_top AS (SELECT region, max(v) AS top, bool_and(abs(v - round_even(v, 0)) < 1e-8) AND max(v) <= 32767 AS plain FROM {name}_good GROUP BY region)")
    p.append(
        f"{name}_conf AS MATERIALIZED (SELECT region, CASE WHEN plain AND top <= 255 THEN 255 WHEN plain THEN 32767 ELSE 10000 END AS bins, CASE WHEN plain THEN 1.0::DOUBLE ELSE 10000 / top END AS f, CASE WHEN plain THEN 0.5::DOUBLE ELSE 0.499 END AS s FROM {name}_top)"
    )
    p.append(f"{name}_hist AS MATERIALIZED (SELECT * FROM (SELECT g.region, CAST(floor(v * f + s) AS BIGINT) AS b, any_value(bins) AS bins, count(*) AS n FROM {name}_good g JOIN {name}_conf c ON c.region = g.region GROUP BY 1, 2) x WHERE b <= bins)")
    p.append(f"{name}_sum AS MATERIALIZED (SELECT region, any_value(bins) AS bins, CAST(sum(n) AS BIGINT) AS total, CAST(round_even(0.5 * sqrt(sum(n * b * b) / sum(n)), 0) AS BIGINT) AS lowest FROM {name}_hist GROUP BY region)")
    p.append(f"{name}_down AS (SELECT region, b, sum(CASE WHEN b < bins THEN n ELSE 0 END) OVER (PARTITION BY region ORDER BY b DESC) AS d FROM {name}_hist)")
    p.append(
        f"{name}_0 AS MATERIALIZED (SELECT s.region, s.bins, s.total, coalesce(greatest(0, max(d.b) - 1), s.lowest - 1) AS cut FROM {name}_sum s LEFT JOIN {name}_down d ON d.region = s.region AND d.b >= s.lowest AND d.b < s.bins AND d.d >= floor(0.65 * s.total) GROUP BY s.region, s.bins, s.total, s.lowest)"
    )
    for k in range(_HALVINGS):
        above = f"(SELECT r.region, r.bins, r.total, r.cut, h.b, sum(coalesce(h.n, 0)) OVER (PARTITION BY r.region ORDER BY h.b) AS c, sum(coalesce(h.n, 0)) OVER (PARTITION BY r.region) // 2 AS half FROM {name}_{k} r LEFT JOIN {name}_hist h ON h.region = r.region AND h.b >= r.cut AND h.b < r.bins)"
        step = "coalesce(min(CASE WHEN half > 0 AND c >= half THEN b + 1 END), any_value(cut))"
        p.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT region, any_value(bins) AS bins, any_value(total) AS total, CAST(floor({fraction} * least({step}, any_value(bins))) AS BIGINT) AS cut FROM {above} x GROUP BY region)")
    p.append(f"{name} AS MATERIALIZED (SELECT r.region, CASE WHEN r.total > 222 THEN r.cut / c.f ELSE 0.0 END AS level FROM {name}_{_HALVINGS} r JOIN {name}_conf c ON c.region = r.region)")
    return ", ".join(p)


def _gradual_sql(name: str, rows: str, dims=(16, 16, 7)) -> str:
    """CTEs that end in ``name(vox, i, j, k, v, thr)`` with the threshold at each voxel of the rows ``(vox, i, j, k, v)``, and ``name_whole(level)``."""
    mass = ", ".join(f"CAST(greatest(0, least({d - 1}, round_even(sum(v * ({a} - 1)) / CAST(sum(v) AS DOUBLE), 0))) AS BIGINT) AS c{a}" for a, d in zip("ijk", dims))
    over = [max(1, round(0.01 * d)) for d in dims]
    inside = [" AND ".join(f"{a} - 1 >= c{a} - {o}" if region >> n & 1 else f"{a} - 1 <= c{a} + {o}" for n, (a, o) in enumerate(zip("ijk", over))) for region in range(8)]
    parts = " UNION ALL ".join(f"SELECT {region} AS region, v FROM {rows}, {name}_mid WHERE {test}" for region, test in enumerate(inside))
    far = [f"greatest(0.0, least(1.0, ({a} - 1 - 0.5 * c{a}) / (0.5 * (c{a} + {d - 1}) - 0.5 * c{a})))" for a, d in zip("ijk", dims)]
    weights = [" * ".join(f if region >> n & 1 else f"(1 - {f})" for n, f in enumerate(far)) for region in range(8)]
    total = " + ".join(f"greatest(coalesce((SELECT level FROM {name}_eight WHERE region = {region}), 0.0), 0.333 * (SELECT level FROM {name}_whole)) * {w}" for region, w in enumerate(weights))
    return (
        f"{name}_all AS (SELECT 0 AS region, v FROM {rows}), {_levels_sql(f'{name}_whole', f'{name}_all')}, {name}_mid AS MATERIALIZED (SELECT {mass} FROM {rows}), {name}_parts AS ({parts}), {_levels_sql(f'{name}_eight', f'{name}_parts')}, "
        f"{name} AS MATERIALIZED (SELECT vox, i, j, k, v, {total} AS thr FROM {rows}, {name}_mid)"
    )


@query(f"WITH a AS (SELECT 0 AS region, v FROM vol_qty), b AS (SELECT 1 AS region, sqrt(v) AS v FROM vol_qty), {_levels_sql('x', 'a')}, {_levels_sql('y', 'b')} SELECT 'whole' AS kind, round(level, 6) AS level FROM x UNION ALL SELECT 'parts', round(level, 6) FROM y")
def clip_level(spark, sf_dir):
    """The level of whole numbers and of values with parts."""
    q = T.vol_qty(spark, sf_dir)
    rows = [("whole", round(filters.clip_level(q), 6)), ("parts", round(filters.clip_level(q.map(F.sqrt)), 6))]
    return spark.createDataFrame(rows, "kind string, level double")


@query(f"WITH q AS (SELECT vox, i, j, k, v FROM vol_qty), {_gradual_sql('g', 'q')} SELECT vox, round(thr, 6) AS v FROM g")
def gradual_clip(spark, sf_dir):
    q = T.vol_qty(spark, sf_dir)
    return q.gridded().select("vox", F.round(filters.gradual_clip(q), 6).alias("v"))


_STEPS = {6: 1, 18: 2, 26: 3}


def _largest_sql(name: str, mask: str, connect: int = 26) -> str:
    """CTEs that end in ``name(vox, i, j, k)``, the largest part of a mask."""
    return (
        f"{name}_e AS MATERIALIZED (SELECT a.vox AS a, b.vox AS b FROM {mask} a JOIN {mask} b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) BETWEEN 1 AND {_STEPS[connect]}), "
        f"{name}_r(vox, root) AS (SELECT vox, vox FROM {mask} UNION SELECT e.b, r.root FROM {name}_r r JOIN {name}_e e ON e.a = r.vox WHERE r.root < e.b), "
        f"{name}_l AS MATERIALIZED (SELECT vox, min(root) AS root FROM {name}_r GROUP BY vox), {name}_s AS (SELECT root FROM {name}_l GROUP BY root ORDER BY count(*) DESC, root LIMIT 1), "
        f"{name} AS MATERIALIZED (SELECT m.* FROM {mask} m JOIN {name}_l l ON l.vox = m.vox JOIN {name}_s s ON s.root = l.root)"
    )


#: The steps of a mask of the rows ``(vox, i, j, k, v)`` of the CTE ``v``.
_AUTOMASK = f"""{_gradual_sql('g', 'v')},
  m0 AS MATERIALIZED (SELECT vox, i, j, k FROM g WHERE v >= thr AND (SELECT level FROM g_whole) > 0), {_largest_sql('m1', 'm0')},
  o AS (SELECT a.x, b.x AS y, c.x AS z FROM (VALUES (-1), (0), (1)) a(x), (VALUES (-1), (0), (1)) b(x), (VALUES (-1), (0), (1)) c(x) WHERE abs(a.x) + abs(b.x) + abs(c.x) BETWEEN 1 AND 2),
  near AS (SELECT m.vox, greatest(1, least(16, m.i + o.x)) + (greatest(1, least(16, m.j + o.y)) - 1) * 16 + (greatest(1, least(7, m.k + o.z)) - 1) * 256 AS n FROM m1 m, o),
  counted AS (SELECT near.vox, count(b.vox) AS n FROM near LEFT JOIN m1 b ON b.vox = near.n GROUP BY near.vox),
  core AS MATERIALIZED (SELECT m1.* FROM m1 JOIN counted USING (vox) WHERE n >= 17),
  back AS (SELECT DISTINCT m.* FROM m1 m JOIN core c ON abs(m.i - c.i) <= 1 AND abs(m.j - c.j) <= 1 AND abs(m.k - c.k) <= 1 AND abs(m.i - c.i) + abs(m.j - c.j) + abs(m.k - c.k) BETWEEN 1 AND 2),
  m2 AS MATERIALIZED (SELECT * FROM core UNION SELECT * FROM back), {_largest_sql('m3', 'm2')},
  rest AS MATERIALIZED (SELECT a.n + (b.n - 1) * 16 + (c.n - 1) * 256 AS vox, a.n AS i, b.n AS j, c.n AS k FROM (SELECT UNNEST(range(1, 17)) AS n) a, (SELECT UNNEST(range(1, 17)) AS n) b, (SELECT UNNEST(range(1, 8)) AS n) c
    WHERE NOT EXISTS (SELECT 1 FROM m3 WHERE m3.vox = a.n + (b.n - 1) * 16 + (c.n - 1) * 256)),
  open(vox, i, j, k) AS (SELECT vox, i, j, k FROM rest WHERE i IN (1, 16) OR j IN (1, 16) OR k IN (1, 7) UNION
    SELECT r.vox, r.i, r.j, r.k FROM open o JOIN rest r ON abs(r.i - o.i) + abs(r.j - o.j) + abs(r.k - o.k) = 1),
  m4 AS MATERIALIZED (SELECT * FROM m3 UNION SELECT * FROM rest WHERE vox NOT IN (SELECT vox FROM open)), {_largest_sql('m5', 'm4')}"""


_MEANS = "v AS (SELECT vox, any_value(i) AS i, any_value(j) AS j, any_value(k) AS k, avg(abs(CAST(v AS DOUBLE))) AS v FROM vec_li GROUP BY vox)"
_POWERS = "v AS (SELECT vox, i, j, k, CAST(v AS DOUBLE) * v * v * v AS v FROM vol_qty)"


@query(f"RECURSIVE WITH {_MEANS}, {_AUTOMASK} SELECT vox FROM m5")
def automask(spark, sf_dir):
    """Clip, largest part, peel and restore, largest part, fill, largest part."""
    return components.automask(T.vec_li(spark, sf_dir)).data.select("vox")


@query(f"RECURSIVE WITH {_POWERS}, {_AUTOMASK} SELECT vox FROM m5")
def automask_volume(spark, sf_dir):
    """A volume whose values lie further apart, so that voxels are clipped, peeled, given back and filled."""
    image = T.vol_qty(spark, sf_dir).map(lambda v: v.cast("double") * v * v * v)
    return components.automask(image).data.select("vox")


@query(f"RECURSIVE WITH {_MEANS}, {_AUTOMASK} SELECT a.vox, CAST(a.t AS INT) AS t, a.v FROM vec_li a JOIN m5 ON m5.vox = a.vox")
def automasked(spark, sf_dir):
    """The image within its own mask."""
    return out(components.masked(T.vec_li(spark, sf_dir)))


def _components_sql() -> str:
    return f"""RECURSIVE WITH {MASK}, e AS MATERIALIZED (SELECT a.vox AS a, b.vox AS b FROM mask a JOIN mask b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) BETWEEN 1 AND 2),
  r(vox, root) AS (SELECT vox, vox FROM mask UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.vox WHERE r.root < e.b) SELECT vox, min(root) AS root FROM r GROUP BY vox"""


@query(_components_sql())
def conn_comp_blocks(spark, sf_dir):
    """Parts that go over many blocks of four voxels a side."""
    return components.label_components(mask_of(spark, sf_dir), "18-connect", block=4)


@query("""WITH c AS (SELECT cluster, AVG(i) AS x, AVG(j) AS y, AVG(k) AS z FROM parcel GROUP BY cluster),
  d AS (SELECT a.cluster, b.cluster AS near, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance FROM c a, c b)
  SELECT CAST(cluster AS INT) AS cluster, CAST(near AS INT) AS near, CAST(rank AS INT) AS rank, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, near) AS rank FROM d) x WHERE rank <= 3""")
def cluster_nearest(spark, sf_dir):
    """Each parcel's three nearest, itself first."""
    found = aggregates.cluster_neighbours(T.QTY, T.parcels(T.vol_qty(spark, sf_dir)), k=3)
    return found.select(F.col("cluster").cast("int").alias("cluster"), F.col("near").cast("int").alias("near"), F.col("rank").cast("int").alias("rank"), F.round("distance", 6).alias("distance"))


def _medoids_sql(rounds: int) -> str:
    parts = ["p AS MATERIALIZED (SELECT cluster, i - 1.0::DOUBLE AS x, j - 1.0::DOUBLE AS y, k - 1.0::DOUBLE AS z FROM parcel)", "c0 AS MATERIALIZED (SELECT cluster, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY cluster)"]
    for k in range(rounds):
        far = " + ".join(f"(p.{a} - c.{a}) * (p.{a} - c.{a})" for a in "xyz")
        parts.append(f"w{k} AS (SELECT p.*, 1 / greatest(sqrt({far}), 1e-9) AS w FROM p JOIN c{k} c USING (cluster))")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT cluster, {', '.join(f'sum({a} * w) / sum(w) AS {a}' for a in 'xyz')} FROM w{k} GROUP BY cluster)")
    return f"WITH {', '.join(parts)} SELECT CAST(cluster AS INT) AS cluster, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM c{rounds}"


@query(_medoids_sql(20))
def medoids(spark, sf_dir):
    """The geometric median of each parcel."""
    found = aggregates.medoids(T.QTY, T.parcels(T.vol_qty(spark, sf_dir)))
    return found.select(F.col("cluster").cast("int").alias("cluster"), *[F.round(c, 5).alias(c) for c in "xyz"])


# graphs of series less confounds

_PAIRS = """c AS (SELECT DISTINCT vox, i, j, k FROM vec_ev), days AS (SELECT UNNEST(range(1, 32)) AS t),
  p AS (SELECT a.vox AS a, b.vox AS b, (a.i - b.i) ** 2 + (a.j - b.j) ** 2 + (a.k - b.k) ** 2 AS d2 FROM c a JOIN c b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND a.vox <> b.vox)"""
_EDGES = """e AS (SELECT a, b, r * r * exp(-d2 / 8.0) AS w FROM r WHERE r > 1e-6 UNION ALL SELECT vox, vox, 1e-12 FROM c)
  SELECT a AS vox, b AS near, round(w, 6) AS w FROM (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS w FROM e) x WHERE w > 1e-5"""


def _edges(graph):
    return graph.where("w > 1e-5").select("vox", "near", F.round("w", 6).alias("w"))


@query(f"""WITH {_PAIRS}, x AS (SELECT c.vox, t, coalesce(CAST(v AS DOUBLE), 0) AS v, CAST(t AS DOUBLE) - 16 AS d FROM c CROSS JOIN days LEFT JOIN vec_ev USING (vox, t)),
  s AS (SELECT vox, avg(v) AS m, sum(d * v) / sum(d * d) AS slope FROM x GROUP BY vox), y AS (SELECT vox, t, v - m - slope * d AS v FROM x JOIN s USING (vox)), n AS (SELECT vox, sum(v * v) AS q FROM y GROUP BY vox),
  r AS (SELECT p.a, p.b, any_value(d2) AS d2, greatest(-0.999999, least(0.999999, sum(u.v * w.v) / sqrt(any_value(un.q) * any_value(wn.q)))) AS r FROM p JOIN y u ON u.vox = p.a JOIN y w ON w.vox = p.b AND w.t = u.t JOIN n un ON un.vox = p.a JOIN n wn ON wn.vox = p.b GROUP BY 1, 2),
  {_EDGES}""")
def corr_graph_confounds(spark, sf_dir):
    """Correlations of series without their mean and trend."""
    graph = graphs.correlation_graph([T.vec_ev(spark, sf_dir)], topk=0, confounds=[[[t - 16.0] for t in range(1, 32)]])
    return _edges(graph)


@query(f"""WITH {_PAIRS}, dv AS (SELECT t, v - lag(v) OVER (PARTITION BY vox ORDER BY t) AS d FROM vec_ev), ee AS (SELECT t, sqrt(avg(d * d)) AS x FROM dv WHERE d IS NOT NULL GROUP BY t),
  mm AS (SELECT median(x) AS m FROM ee), ss AS (SELECT 1.4826 * median(abs(x - m)) AS mad FROM ee, mm), rw AS (SELECT t, CASE WHEN abs((x - m) / mad) < 4.685 THEN (1 - ((x - m) / mad / 4.685) * ((x - m) / mad / 4.685)) ** 2 ELSE 0.0 END AS w FROM ee, mm, ss),
  wt AS (SELECT t, coalesce(w, 1.0) AS w FROM days LEFT JOIN rw USING (t)), tw AS (SELECT sum(w) AS s FROM wt),
  x AS (SELECT vox, t, CAST(v AS DOUBLE) AS v, w FROM vec_ev JOIN wt USING (t)), m AS (SELECT vox, SUM(w * v) AS m, SUM(w * v * v) AS q FROM x GROUP BY vox),
  xy AS (SELECT p.a, p.b, SUM(y.w * y.v * z.v) AS xy FROM p JOIN x y ON y.vox = p.a JOIN x z ON z.vox = p.b AND z.t = y.t GROUP BY 1, 2),
  r AS (SELECT p.a, p.b, d2, greatest(-0.999999, least(0.999999, (coalesce(xy, 0) - y.m * z.m / s) / sqrt(greatest(1e-12, y.q - y.m * y.m / s) * greatest(1e-12, z.q - z.m * z.m / s)))) AS r FROM p LEFT JOIN xy USING (a, b) JOIN m y ON y.vox = p.a JOIN m z ON z.vox = p.b, tw),
  {_EDGES}""")
def corr_graph_robust(spark, sf_dir):
    """Tukey's weights from DVARS."""
    return _edges(graphs.correlation_graph([T.vec_ev(spark, sf_dir)], topk=0, robust="tukey"))


@query("""WITH days AS (SELECT UNNEST(range(1, 32)) AS t), d AS (SELECT t, CAST(coalesce(sum(v), 0) AS DOUBLE) AS x FROM days LEFT JOIN vec_ev USING (t) GROUP BY t), c AS (SELECT t, x - avg(x) OVER () AS x FROM d)
  SELECT CAST(a.t AS INT) AS t, CAST(b.t AS INT) AS other, round(1 / 31.0::DOUBLE + a.x * b.x / (SELECT sum(x * x) FROM c), 6) AS v FROM c a, c b""")
def confound_projection(spark, sf_dir):
    """What the basis of an image's global signal projects on, which no choice of basis changes."""
    total = T.vec_ev(spark, sf_dir).data.groupBy("t").agg(F.sum("value").alias("x"))
    signal = dict(total.collect())  # a row a time
    [q] = windows.prepare_confounds([[float(signal.get(t, 0))] for t in range(1, 32)], [31])
    days = total.select(F.explode(F.sequence(F.lit(1), F.lit(31))).alias("t")).distinct()
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in q @ q.T])
    return days.select("t", F.posexplode(rows[F.col("t") - 1]).alias("other", "v")).select("t", (F.col("other") + 1).alias("other"), F.round("v", 6).alias("v"))


# drawn regions: what holds for every draw

_REACH = 2.0


@query(f"WITH {MASK} SELECT vox, 1 AS centers, true AS reached FROM mask")
def random_cover(spark, sf_dir):
    """A random searchlight covers each voxel of the mask once, from a center within the radius."""
    mask = mask_of(spark, sf_dir)
    found = neighbourhoods.random_searchlight(mask, _REACH)
    place = mask.with_coords().select("vox", "x", "y", "z")
    far = F.sqrt(sum(((F.col(f"c{a}") - F.col(a)) ** 2 for a in "xyz"), F.lit(0.0)))
    joined = found.join(place, "vox").join(place.select(F.col("vox").alias("center"), *[F.col(a).alias(f"c{a}") for a in "xyz"]), "center")
    return joined.groupBy("vox").agg(F.count("*").cast("int").alias("centers"), F.min(far <= _REACH).alias("reached"))


@query("SELECT n AS draw, true AS in_mask, true AS whole FROM (SELECT UNNEST(range(1, 51)) AS n) x")
def resampled_regions(spark, sf_dir):
    """Each draw has a center of the mask and every voxel of the mask within its radius, and no other."""
    mask = mask_of(spark, sf_dir)
    drawn = neighbourhoods.resampled_searchlight(mask, _REACH, draws=50)
    every = neighbourhoods.searchlight(mask, _REACH)
    sizes = every.groupBy("center").agg(F.count("*").alias("size"))
    known = drawn.join(every.withColumn("known", F.lit(1)), ["center", "vox"], "left").join(sizes, "center", "left")
    return known.groupBy("draw").agg(F.max(F.col("size").isNotNull()).alias("in_mask"), ((F.sum("known") == F.max("size")) & (F.count("*") == F.max("size"))).alias("whole"))


@query("SELECT n AS draw, true AS within, true AS core FROM (SELECT UNNEST(range(1, 21)) AS n) x")
def blobby_regions(spark, sf_dir):
    """A blobby region lies within the sphere and has all of its inner part."""
    mask = mask_of(spark, sf_dir)
    drawn = neighbourhoods.resampled_searchlight(mask, _REACH, draws=20, shape=neighbourhoods.blobby_shape())
    inner = neighbourhoods.searchlight(mask, 0.7 * _REACH).groupBy("center").agg(F.count("*").alias("core"))
    every = neighbourhoods.searchlight(mask, _REACH).withColumn("known", F.lit(1))
    near = neighbourhoods.searchlight(mask, 0.7 * _REACH).withColumn("near", F.lit(1))
    found = drawn.join(every, ["center", "vox"], "left").join(near, ["center", "vox"], "left").join(inner, "center")
    return found.groupBy("draw").agg((F.count("known") == F.count("*")).alias("within"), (F.count("near") == F.max("core")).alias("core"))


@query(f"WITH {MASK} SELECT CAST(cluster AS INT) AS center, vox FROM parcel JOIN mask USING (vox)")
def clustered_regions(spark, sf_dir):
    """Neighbourhoods from given parcels."""
    found = neighbourhoods.clustered_searchlight(mask_of(spark, sf_dir), T.parcels(T.vol_qty(spark, sf_dir)))
    return found.select(F.col("center").cast("int").alias("center"), "vox")


# grids and kernels over the voxels of an image


@query("SELECT vox, CAST(-2 * (i - 1) + 30 AS DOUBLE) AS x, CAST(3 * (j - 1) - 20 AS DOUBLE) AS y, 2.5::DOUBLE * (k - 1) - 10 AS z, 'L A S' AS codes, '2.0 3.0 2.5' AS sizes, '0.0 0.0 0.0' AS obliquity, CAST(i - 1 AS DOUBLE) AS slice_x, 4.0::DOUBLE AS slice_z FROM vol_qty")
def affine_algebra(spark, sf_dir):
    """World coordinates of voxels by the affine that is rebuilt from its quaternion, and what the affine tells."""
    m = T.WORLD.trans
    quaternion, sign = affine.quaternion_of(m)
    rebuilt = Space(T.WORLD.dims, trans=affine.affine_of(quaternion, m[:3, 3], affine.voxel_sizes(m), sign))
    shown = lambda values: " ".join(str(abs(float(round(v, 6)))) for v in values)
    into = affine.slice_to_volume_affine(4, 2)
    g = T.vol_qty(spark, sf_dir, rebuilt).with_coords()
    at = [F.col("i") - 1, F.col("j") - 1, F.lit(1)]
    placed = [sum((F.lit(float(into[r, c])) * at[c] for c in range(3)), F.lit(0.0)) for r in (0, 2)]
    codes = F.lit(" ".join(affine.affine_to_axcodes(m)))
    return g.select("vox", *[F.round(c, 6).alias(c) for c in "xyz"], codes.alias("codes"), F.lit(shown(affine.voxel_sizes(m))).alias("sizes"), F.lit(shown(affine.obliquity(m))).alias("obliquity"), placed[0].alias("slice_x"), placed[1].alias("slice_z"))


@query("""WITH w AS (SELECT vox, i, j, k, -2.0::DOUBLE * (i - 1) + 30 AS x, 3.0::DOUBLE * (j - 1) - 20 AS y, 2.5::DOUBLE * (k - 1) - 10 AS z FROM vol_qty)
  SELECT vox, CAST(round_even(x / 2 + 1, 0) + (round_even((y + 20) / 2 + 1, 0) - 1) * 16 + (round_even((z + 10) / 2 + 1, 0) - 1) * 384 AS BIGINT) AS aligned, vox + 1792 * 4 AS fifth, x BETWEEN 0 AND 30 AND y BETWEEN -20 AND 25 AND z BETWEEN -10 AND 5 AS inside, 'R A S' AS flipped, 'S A R' AS permuted FROM w""")
def grid_facts(spark, sf_dir):
    """Of each voxel its place in the grid along the world axes and in an added dimension, whether the bounds hold it, and turned axes."""
    w, q = T.WORLD, T.vol_qty(spark, sf_dir, T.WORLD)
    aligned, more = affine.output_aligned_space(w), w.add_dim(5)
    codes = lambda image: F.lit(" ".join(affine.affine_to_axcodes(image.space.trans)))
    low, high = w.bounds().T.tolist()
    inside = F.lit(True)
    for c, a, b in zip("xyz", low, high):
        inside = inside & F.col(c).between(min(a, b), max(a, b))
    assert more.drop_dim().dims == w.dims
    return q.with_coords().select("vox", aligned.coord_to_index(F.col("x"), F.col("y"), F.col("z")).alias("aligned"), (F.col("vox") + w.n_vox * (more.dims[3] - 1)).alias("fifth"), inside.alias("inside"), codes(resampling.as_canonical(q)).alias("flipped"), codes(resampling.reorient(q, ("S", "A", "R"))).alias("permuted"))


@query(f"""WITH {MASK}, o AS (SELECT a.x, b.x AS y, c.x AS z FROM (VALUES (-1), (0), (1)) a(x), (VALUES (-1), (0), (1)) b(x), (VALUES (-1), (0), (1)) c(x))
  SELECT m.vox AS center, CAST(m.i + o.x + (m.j + o.y - 1) * 16 + (m.k + o.z - 1) * 256 AS BIGINT) AS vox, CAST(o.x + 10 * o.y + 100 * o.z AS DOUBLE) AS v FROM mask m, o
  WHERE m.i + o.x BETWEEN 1 AND 16 AND m.j + o.y BETWEEN 1 AND 16 AND m.k + o.z BETWEEN 1 AND 7""")
def embed_kernel(spark, sf_dir):
    """A kernel of 27 places set at each voxel of a mask."""
    offsets = neighbourhoods.cube_offsets(1)
    mask = mask_of(spark, sf_dir)
    return stencils.embed_kernels(mask, offsets, [a + 10 * b + 100 * c for a, b, c in offsets]).withColumnRenamed("value", "v")


@query("""WITH o AS (SELECT a.x, b.x AS y, c.x AS z FROM (SELECT UNNEST(range(-2, 3)) AS x) a, (SELECT UNNEST(range(-2, 3)) AS x) b, (SELECT UNNEST(range(-2, 3)) AS x) c WHERE a.x * a.x + b.x * b.x + c.x * c.x <= 4)
  SELECT vox, count(*) AS n FROM vol_qty, o WHERE i + x BETWEEN 1 AND 16 AND j + y BETWEEN 1 AND 16 AND k + z BETWEEN 1 AND 7 GROUP BY vox""")
def sphere_offsets(spark, sf_dir):
    """How many places of a sphere the grid has around each voxel."""
    image = T.vol_qty(spark, sf_dir)
    near = neighbourhoods.shifted(image, neighbourhoods.sphere_offsets(image.space.spacing, 2.0))
    return near.groupBy("vox").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT vox, CASE WHEN (i + j) % 2 = 0 THEN 'R' ELSE 'L' END || ' ' || CASE WHEN j % 2 = 0 THEN 'A' ELSE 'P' END || ' ' || CASE WHEN k % 2 = 0 THEN 'S' ELSE 'I' END AS codes FROM vol_qty)
  SELECT vox, codes, CAST(1 + CAST(codes LIKE '%L%' AS INT) * 4 + CAST(codes LIKE '%P%' AS INT) * 2 + CAST(codes LIKE '%I%' AS INT) AS INT) AS place FROM p""")
def anatomy_places(spark, sf_dir):
    """Orientations of the first order of axes, found in the catalogue of all."""
    ends = {c: n for n, c in enumerate(sorted((c for c in affine.anatomy_catalogue() if c[0] in "RL" and c[1] in "AP"), key=lambda c: (c[0] == "L", c[1] == "P", c[2] == "I")), 1)}
    g = T.vol_qty(spark, sf_dir).gridded()
    pick = lambda test, a, b: F.when(test, a).otherwise(b)
    codes = F.concat_ws(" ", pick((F.col("i") + F.col("j")) % 2 == 0, "R", "L"), pick(F.col("j") % 2 == 0, "A", "P"), pick(F.col("k") % 2 == 0, "S", "I"))
    known = F.create_map(*[x for c, n in ends.items() for x in (F.lit(" ".join(c)), F.lit(n))])
    return g.select("vox", codes.alias("codes"), known[codes].alias("place"))
