"""Parcels by their centers, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelarium import runtime
from voxelarium.operators import aggregates, components
from voxelarium.image import from_numpy
from voxelarium.space import Space

SPACE = Space((12, 10, 8), spacing=(2.0, 1.0, 1.5))


@pytest.fixture(scope="module")
def parcels(spark):
    rng = np.random.default_rng(5)
    label = rng.integers(1, 30, SPACE.n_vox)
    label[: SPACE.n_vox // 3] = 1  # one parcel of a third of the voxels
    return spark.createDataFrame([(int(v + 1), int(c)) for v, c in enumerate(label)], "vox long, cluster int")


def points_of(parcels):
    rows = parcels.collect()
    vox = np.array([r.vox for r in rows]) - 1
    at = np.stack(np.unravel_index(vox, SPACE.dims, order="F"), axis=1) * np.array(SPACE.spacing)
    return np.array([r.cluster for r in rows]), at


@pytest.mark.parametrize("k", [1, 4, 100])
def test_nearest_parcels(spark, parcels, k):
    label, at = points_of(parcels)
    centers = {c: at[label == c].mean(axis=0) for c in np.unique(label).tolist()}
    got = {}
    for r in aggregates.cluster_neighbours(SPACE, parcels, k).collect():
        got.setdefault(r.cluster, {})[r.rank] = (r.near, r.distance)
    assert set(got) == set(centers)
    for c, p in centers.items():
        want = sorted((np.linalg.norm(p - q), n) for n, q in centers.items())[:k]
        assert [got[c][n + 1][0] for n in range(len(want))] == [n for _, n in want]
        assert np.allclose([got[c][n + 1][1] for n in range(len(want))], [d for d, _ in want])


def test_parcels_within_a_radius(spark, parcels):
    label, at = points_of(parcels)
    centers = {c: at[label == c].mean(axis=0) for c in np.unique(label).tolist()}
    got = {(r.cluster, r.near) for r in aggregates.cluster_neighbours(SPACE, parcels, radius=1.5).collect()}
    assert got == {(a, b) for a, p in centers.items() for b, q in centers.items() if np.linalg.norm(p - q) <= 1.5}
    same = aggregates.cluster_neighbours(SPACE, parcels, radius=0).collect()
    assert {(r.cluster, r.near) for r in same} == {(c, c) for c in centers}
    none = parcels.where("vox < 0")
    assert aggregates.cluster_neighbours(SPACE, none, 3).count() == 0


def test_medoids(spark, parcels):
    label, at = points_of(parcels)
    for r in aggregates.medoids(SPACE, parcels, 5).collect():
        p = at[label == r.cluster]
        c = p.mean(axis=0)
        for _ in range(5):
            w = 1 / np.maximum(np.linalg.norm(p - c, axis=1), 1e-9)
            c = (p * w[:, None]).sum(axis=0) / w.sum()
        assert np.allclose([r.x, r.y, r.z], c)


def test_numbers_of_rows(spark):
    frame = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("g")).repartition(5)
    rows = runtime.numbered(frame, "n", F.desc("g"), F.col("id")).collect()
    want = sorted((-(x % 7), x) for x in range(1000))
    assert [r.id for r in sorted(rows, key=lambda r: r.n)] == [x for _, x in want]
    assert sorted(r.n for r in rows) == list(range(1, 1001))
    assert runtime.numbered(frame.where("id < 0"), "n", F.col("id")).count() == 0


def test_components_are_numbered_by_size(spark):
    x = np.zeros((30, 1, 1))
    x[[0, 2, 3, 5, 8, 9, 11, 12, 13]] = 1
    found = components.connected_components(from_numpy(spark, x).mask())
    got = {r.vox: (r.component, r.size) for r in found.collect()}
    assert got == {1: (4, 1), 3: (2, 2), 4: (2, 2), 6: (5, 1), 9: (3, 2), 10: (3, 2), 12: (1, 3), 13: (1, 3), 14: (1, 3)}


@pytest.mark.parametrize("bins,few", [(2, 0), (5, 3), (64, 10), (4096, 1 << 14)])
def test_quantiles(spark, bins, few):
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=501), rng.integers(0, 4, 400).astype(float), np.full(50, 2.5), np.array([1e308, -1e308, 3.0, 3.0, 1e-300])):
        frame = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
        got = runtime.quantiles(frame, F.col("v"), [0.0, 0.5, 0.98], bins, few)
        want = np.quantile(x / 4, [0.0, 0.5, 0.98]) * 4 if np.abs(x).max() < 1e300 else [-1e308, 3.0, None]
        assert all(w is None or np.isclose(g, w, rtol=1e-12) for g, w in zip(got, want))
    assert runtime.quantiles(frame.where("v is null"), F.col("v"), [0.5]) is None
