"""k-means of a mask's voxels against brute force from the same centers."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxelarium.image import from_numpy
from voxelarium.operators import aggregates
from voxelarium.space import Space


def test_partition_goes_on_until_no_center_moves(spark):
    mask = from_numpy(spark, np.ones((120, 3, 1))).mask()
    points = mask.with_coords().select("vox", "x", "y", "z").orderBy(F.xxhash64(F.lit(1), "vox")).collect()
    at = np.array([(p.x, p.y, p.z) for p in points])
    centers, rounds = at[:6].copy(), 0
    while True:
        near = ((at[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([at[near == c].mean(axis=0) for c in range(6)])
        rounds += 1
        if np.allclose(moved, centers, rtol=0, atol=1e-9):
            break
        centers = moved
    assert rounds > 11
    got = {r.vox: r.cluster for r in aggregates.partition(mask, 6).collect()}
    assert got == {p.vox: c + 1 for p, c in zip(points, near)}


def plain(points, centers, rounds=200):
    """Lloyd's rounds; of equal distances the first center's counts."""
    for _ in range(rounds):
        near = np.array([((p - centers) ** 2).sum(axis=1).argmin() for p in points])
        moved = np.array([points[near == c].mean(axis=0) if (near == c).any() else centers[c] for c in range(len(centers))])
        if np.allclose(moved, centers, rtol=1e-12, atol=1e-9):
            return near
        centers = moved
    raise AssertionError("no rest")


def test_two_thousand_centers(spark):
    """Against every distance, on a turned and stretched grid; half the voxels need no search at last."""
    rng = np.random.default_rng(4)
    space = Space((24, 20, 18), trans=[[2, 0, 0, -7], [0, 0, 3, 1], [0, -1, 0, 5], [0, 0, 0, 1]])
    mask = from_numpy(spark, (rng.random((24, 20, 18)) < 0.9).astype(float), space).mask()
    rows = mask.with_coords().select("vox", "x", "y", "z").toPandas()
    points = rows[["x", "y", "z"]].to_numpy()
    first = points[rng.choice(len(points), 2000, replace=False)] + rng.normal(0, 0.01, (2000, 3))
    got = {r.vox: r.cluster for r in aggregates.partition(mask, 2000, first=[tuple(c) for c in first]).collect()}
    want = plain(points, first)
    assert got == {v: c + 1 for v, c in zip(rows.vox, want)}


def test_bounds_hold_and_save_searches(spark):
    """In each round an upper bound is no less than a voxel's distance, a lower one no more than that of any other center."""
    rng = np.random.default_rng(5)
    points = rng.uniform(0, 30, (3000, 3))
    centers = aggregates.Centers(points[:40].copy())
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), *[pa.array(points[:, n]) for n in range(3)], pa.array(np.full(3000, -1)), pa.array(np.zeros(3000)), pa.array(np.zeros(3000))], list("vxyzcul"))
    shares = []
    for _ in range(25):
        [out] = list(centers.assign(8.0)([batch]))
        label, upper, lower, skipped = (np.asarray(out.column(n)) if n < 7 else out.column(7).to_numpy(zero_copy_only=False) for n in (4, 5, 6, 7))
        d = np.sqrt(((points[:, None] - centers.at) ** 2).sum(axis=2))
        assert np.array_equal(label, d.argmin(axis=1))
        own = d[np.arange(3000), label]
        d[np.arange(3000), label] = np.inf
        assert (upper >= own - 1e-9).all() and (lower <= d.min(axis=1) + 1e-9).all()
        shares.append(skipped.mean())
        at = np.array([points[label == c].mean(axis=0) for c in range(40)])
        centers, batch = aggregates.Centers(at, centers.at), out
    assert shares[0] == 0 and shares[-1] > 0.5


def test_few_voxels_and_equal_centers(spark):
    mask = from_numpy(spark, np.ones((2, 1, 1))).mask()
    assert sorted(r.cluster for r in aggregates.partition(mask, 5).collect()) == [1, 2]
    equal = {r.vox: r.cluster for r in aggregates.partition(mask, 2, first=[(0.0, 0.0, 0.0)] * 2).collect()}
    assert equal == dict(enumerate(plain(np.array([[0.0, 0, 0], [1, 0, 0]]), np.zeros((2, 3))) + 1, 1))
    assert aggregates.partition(mask.with_data(mask.data.where("false")), 3).collect() == []


def test_long_series_as_a_matrix(spark):
    """Two thousand times: the plan doesn't grow with them."""
    x = np.random.default_rng(6).integers(-50, 50, (3, 2, 2, 2000)).astype(float)
    x[1, 1, 1, :700] = 0
    image = from_numpy(spark, x).sparse()
    image = image.with_data(image.data.withColumn("value", F.col("value").cast("int")))
    tiles = aggregates.matrix_tiles(image, 600)
    assert dict(tiles.dtypes)["values"] == "array<int>" and len(tiles._jdf.queryExecution().optimizedPlan().toString()) < 6000
    flat = x.reshape(-1, 2000, order="F")
    rows = {(r.vox, r.tile): r["values"] for r in tiles.collect()}
    assert rows == {(v + 1, t): flat[v, 600 * t : 600 * t + 600].astype(int).tolist() for v in range(12) for t in range(4) if flat[v, 600 * t : 600 * t + 600].any()}
    wide = aggregates.to_matrix(image, [1, 1999, 2000]).collect()
    assert {(r.vox, r.t1, r.t1999, r.t2000) for r in wide} == {(v + 1, *flat[v, [0, 1998, 1999]].astype(int)) for v in range(12)}


def test_cells_of_the_matrix(spark):
    x = np.random.default_rng(7).normal(size=(3, 2, 2, 5))
    x[0, 0, 0] = x[2, 1, 0] = 0
    image = from_numpy(spark, x).sparse()
    voxels = [v for v in range(12) if x.reshape(-1, 5, order="F")[v].any()]
    flat = x.reshape(-1, 5, order="F")[voxels]
    cells = spark.createDataFrame([(1, 1), (5, 10), (3, 2)], "t int, col long")
    assert {(r.t, r.col, r.value) for r in aggregates.matricized_access(image, cells).collect()} == {(t, c, flat[c - 1, t - 1]) for t, c in ((1, 1), (5, 10), (3, 2))}
    whole = aggregates.matricized_access(image, cells.select("col").where("col = 2")).collect()
    assert [r.value for r in sorted(whole)] == flat[1].tolist()
