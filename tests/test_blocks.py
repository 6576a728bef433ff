"""Cubes with a rim against whole arrays."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelarium.image import Image, from_numpy
from voxelarium.operators import blocks, neighbourhoods, stencils
from voxelarium.space import Space


def cube(r):
    return list(itertools.product(range(-r, r + 1), repeat=3))


def at(x, p):
    return x[tuple(p)] if all(0 <= a < d for a, d in zip(p, x.shape)) else None


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    """Cubes of 4, so that every image has many."""
    real = blocks.layout_of
    monkeypatch.setattr(blocks, "layout_of", lambda image, rim, side=4, times=2: real(image, rim, 4, 2))


def test_copies_grow_with_the_surface(spark):
    image = from_numpy(spark, np.ones((64, 64, 32)))
    layout = blocks.Layout((64, 64, 32, 1), (32, 32, 32, 16), (2, 2, 2, 0))
    rows = blocks.haloed(image, layout)
    assert rows.count() == 68 * 68 * 32 < 1.5 * 64 * 64 * 32 and rows.select("block").distinct().count() == 4
    assert rows.distinct().count() == rows.count()


def test_a_rim_wider_than_a_cube(spark):
    image = from_numpy(spark, np.random.default_rng(0).normal(size=(9, 7, 5)))
    layout = blocks.Layout((9, 7, 5, 1), (4, 4, 4, 2), (6, 6, 6, 0))
    for r in blocks.haloed(image, layout).groupBy("block").agg(F.collect_set("vox").alias("v")).collect():
        first = [int(c) * 4 - 6 for c in np.unravel_index(r.block, layout.counts, order="F")]
        span = [range(max(0, f), min(d, f + 4 + 12)) for f, d in zip(first, (9, 7, 5))]
        assert set(r.v) == {i + 9 * (j + 7 * k) + 1 for i, j, k in itertools.product(*span)}


@pytest.mark.parametrize("window", [1, 2, 5])
def test_bilateral(spark, window):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(7, 6, 9))
    inside = rng.random(x.shape) < 0.7
    space = Space(x.shape, spacing=(1.0, 2.0, 1.5))
    mask = from_numpy(spark, inside.astype(float), space).mask()
    got = stencils.bilateral_filter(from_numpy(spark, x, space), mask, 2.0, 0.8, window)
    floor = 2 * 0.8**2 * x[inside].std(ddof=1) ** 2
    rows = {r.vox: r.value for r in got.data.collect()}
    assert len(rows) == inside.sum()
    for vox, value in rows.items():
        p = np.array(np.unravel_index(vox - 1, x.shape, order="F"))
        top = total = 0.0
        for o in cube(window):
            v = at(x, p + o)
            if v is not None and at(inside, p + o):
                w = np.exp(-sum((a * s) ** 2 for a, s in zip(o, space.spacing)) / 8) * np.exp(-((v - x[tuple(p)]) ** 2) / floor)
                top, total = top + w * v, total + w
        assert abs(value - top / total) < 1e-9


def test_bilateral_in_time(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 6, 3, 7))
    inside = rng.random(x.shape[:3]) < 0.8
    mask = from_numpy(spark, inside.astype(float)).mask()
    got = stencils.bilateral_filter_4d(from_numpy(spark, x), mask, temporal_sigma=1.5, temporal_window=2, temporal_spacing=0.5).to_numpy()
    floor = 2 * x[inside].std() ** 2
    for p in itertools.product(*map(range, x.shape)):
        if not inside[p[:3]]:
            assert got[p] == x[p]
            continue
        top = total = 0.0
        for o in cube(1):
            for dt in range(-2, 3):
                q = tuple(np.array(p) + (*o, dt))
                if at(x, q) is not None and inside[q[:3]]:
                    w = np.exp(-sum(a * a for a in o) / 8) * np.exp(-((dt * 0.5) ** 2) / (2 * 1.5**2)) * np.exp(-((x[q] - x[p]) ** 2) / floor)
                    top, total = top + w * x[q], total + w
        assert abs(got[p] - top / total) < 1e-9


@pytest.mark.parametrize("levels,search,patch", [(1, 1, 3), (2, 2, 3), (3, 1, 5)])
def test_laplace(spark, levels, search, patch):
    """The published steps on whole arrays: links by patches, Laplacian smoothing at each level, sigmoids of the details."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 5, 9))
    inside = rng.random(x.shape) < 0.8
    gains = tuple(1.0 + 0.5 * n for n in range(levels + 1))
    image = from_numpy(spark, x)
    got = stencils.laplace_enhance(image, from_numpy(spark, inside.astype(float)).mask(), levels, patch, search, 0.5, gains)
    unit = (x - x.min()) / (x.max() - x.min())
    half = patch // 2
    padded = np.pad(unit, half, mode="edge")
    voxels = [tuple(p) for p in np.argwhere(inside)]
    patches = {p: padded[tuple(slice(a, a + patch) for a in p)] for p in voxels}
    links = {p: {q: np.exp(-((patches[p] - patches[q]) ** 2).sum() / 0.25) for o in cube(search) if any(o) and at(inside, q := tuple(np.array(p) + o))} for p in voxels}
    links = {p: {q: w for q, w in near.items() if w > 1e-8} for p, near in links.items()}
    smooth = []
    for level in range(levels):
        d = {p: sum(w ** 2**level for w in near.values()) for p, near in links.items()}
        mean = np.mean([d[p] for p in voxels if links[p]])
        smooth.append({p: unit[p] + (sum(w ** 2**level * unit[q] for q, w in links[p].items()) - d[p] * unit[p]) / mean for p in voxels})
    rows = {r.vox: r.value for r in got.data.collect()}
    assert len(rows) == len(voxels)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for p in voxels:
        want = sigmoid(gains[0] * (smooth[0][p] - 0.5) * 4)
        for n in range(1, levels):
            want += 2 * sigmoid(gains[n] * (smooth[n][p] - smooth[n - 1][p])) - 1
        want += 2 * sigmoid(gains[levels] * (unit[p] - smooth[-1][p])) - 1
        assert abs(rows[int(np.ravel_multi_index(p, x.shape, order="F")) + 1] - want) < 1e-9


@pytest.mark.parametrize("radius,spacing", [(1.0, (1.0, 1.0, 1.0)), (3.2, (1.0, 1.5, 2.0)), (9.0, (2.0, 1.0, 3.0))])
def test_searchlight_sums(spark, radius, spacing):
    """Against the members' sums; values that aren't finite, mask voxels without a value, and centers without any."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(10, 9, 6))
    x[1, 1, 1], x[8, 2, 3], x[5, 5, 5], x[5, 6, 5] = np.nan, np.inf, np.inf, -np.inf
    space = Space(x.shape, spacing=spacing)
    inside = rng.random(x.shape) < 0.6
    mask = from_numpy(spark, inside.astype(float), space).mask()
    image = from_numpy(spark, x, space)
    image = Image(space, image.data.where("vox % 3 <> 0"))
    by_members = neighbourhoods.searchlight_reduce(image, mask, radius, lambda v: F.struct(F.sum(v).alias("total"), F.count(v).alias("n")))
    want = {r.vox: (r.value.total, r.value.n) for r in by_members.collect()}
    got = {r.vox: (r.total, r.n) for r in neighbourhoods.searchlight_sums(image, mask, radius).collect()}
    assert got.keys() == want.keys()
    assert all(got[v][1] == want[v][1] and np.isclose(got[v][0], want[v][0], equal_nan=True) for v in want)


def test_runs_of_a_sphere():
    for radius in (1.0, 2.0, 4.5):
        offsets = neighbourhoods.sphere_offsets((1.0, 1.0, 1.0), radius)
        runs = neighbourhoods.axis_runs(offsets)
        assert sorted((x, y, z) for a, b, y, z in runs for x in range(a, b + 1)) == sorted(offsets)
        assert len(runs) == len({o[1:] for o in offsets})
    assert neighbourhoods.axis_runs([(0, 0, 0), (2, 0, 0)]) == [(0, 0, 0, 0), (2, 2, 0, 0)]
