import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelarium.image import from_numpy
from voxelarium.operators import aggregates, components, filters, graphs, joins, neighbourhoods, resampling, sets, stencils, windows
from voxelarium.space import Space


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(0).normal(10, 3, (6, 5, 4))


def test_component_fixture(spark):
    """Three parts by faces of 1, 4 and 4 voxels."""
    x = np.zeros((5, 5, 5))
    x[0, 0, 0] = 1
    x[2:4, 2:4, 1] = 1
    x[4, 0:4, 4] = 1
    found = components.connected_components(from_numpy(spark, x).mask(), "6-connect")
    assert sorted(r.n for r in found.groupBy("component").agg(F.count("*").alias("n")).collect()) == [1, 4, 4]


@pytest.mark.parametrize("connect,block", [("6-connect", 64), ("18-connect", 3), ("26-connect", 2), ("6-connect", 2)])
def test_components_against_flood_fill(spark, connect, block):
    x = np.random.default_rng(3).random((7, 6, 5)) > 0.6
    reach = components.CONNECTIVITY[connect]
    offsets = [o for o in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= reach]
    label, todo = {}, [tuple(p) for p in np.argwhere(x)]
    for p in todo:
        if p in label:
            continue
        stack = [p]
        while stack:
            q = stack.pop()
            if q in label or not (all(0 <= a < d for a, d in zip(q, x.shape)) and x[q]):
                continue
            label[q] = p
            stack += [tuple(a + b for a, b in zip(q, o)) for o in offsets]
    rows = components.label_components(from_numpy(spark, x.astype(float)).mask(), connect, block).collect()
    got = {tuple(int(v) for v in np.unravel_index(r.vox - 1, x.shape, order="F")): r.root for r in rows}
    assert set(got) == set(label)
    pairs = {(label[p], got[p]) for p in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_fill_holes_and_largest(spark):
    x = np.ones((5, 5, 5))
    x[2, 2, 2] = 0
    x[0] = 0
    mask = from_numpy(spark, x).mask()
    assert components.fill_holes(mask).data.count() == mask.data.count() + 1
    assert components.fill_holes(mask.with_data(mask.data.where("vox < 0"))).data.count() == 0


def test_automask_finds_the_object(spark):
    x = np.random.default_rng(1).random((14, 14, 14))
    x[3:11, 3:11, 3:11] += 100
    vox = {r.vox for r in components.automask(from_numpy(spark, x)).data.collect()}
    core = {int(np.ravel_multi_index(p, x.shape, order="F")) + 1 for p in np.argwhere(x > 50)}
    assert len(vox & core) > 0.9 * len(core) and len(vox - core) < 0.1 * len(core)


def test_gaussian_against_dense_kernel(spark, cube):
    got = stencils.gaussian_blur(from_numpy(spark, cube), sigma=1.0, window=2).to_numpy()
    g = np.exp(-np.arange(-2, 3) ** 2 / 2)
    g /= g.sum()
    for p in np.ndindex(cube.shape):
        num = den = 0
        for o in itertools.product(range(-2, 3), repeat=3):
            q = tuple(a + b for a, b in zip(p, o))
            if all(0 <= a < d for a, d in zip(q, cube.shape)):
                w = g[o[0] + 2] * g[o[1] + 2] * g[o[2] + 2]
                num, den = num + w * cube[q], den + w
        assert abs(got[p] - num / den) < 1e-9


def test_despike_mends_one_voxel(spark):
    x = np.random.default_rng(2).normal(0, 1, (7, 7, 7))
    x[3, 3, 3] = 100
    image = from_numpy(spark, x)
    got = stencils.despike(image, image).to_numpy()
    assert abs(got[3, 3, 3]) < 5
    assert stencils.enhance_stat_map(image, image).data.count() == 343
    assert stencils.laplace_enhance(image, image, search=1).data.count() == 343


def test_cubic_and_linear_reproduce_a_ramp(spark):
    i, j, k = np.indices((6, 6, 6))
    ramp = from_numpy(spark, (i + 2 * j + 3 * k).astype(float))
    target = Space((4, 4, 4), spacing=(0.5, 0.5, 0.5), origin=(1.5, 1.5, 1.5))
    a, b, c = np.indices((4, 4, 4)) * 0.5 + 1.5
    for method in ("linear", "cubic"):
        assert np.allclose(resampling.resample(ramp, target, method).to_numpy(), a + 2 * b + 3 * c)


def test_reorient_and_back(spark, cube):
    space = Space(cube.shape, trans=[[-2, 0, 0, 1], [0, 3, 0, 2], [0, 0, 4, 3], [0, 0, 0, 1]])
    image = from_numpy(spark, cube, space)
    turned = resampling.reorient(image, ("S", "P", "R"))
    back = resampling.reorient(turned, ("L", "A", "S"))
    assert np.array_equal(back.to_numpy(), cube) and np.allclose(back.space.trans, space.trans)
    assert resampling.deoblique(image).space.spacing == (2.0, 2.0, 2.0)


def test_random_searchlight_is_a_disjoint_cover(spark):
    mask = from_numpy(spark, np.ones((6, 6, 6))).mask()
    rows = neighbourhoods.random_searchlight(mask, 2.0, seed=4).collect()
    assert sorted(r.vox for r in rows) == list(range(1, 217))
    # as going through the voxels in the same random order, one by one
    turn = {r.vox: (r.h, r.vox) for r in mask.data.select("vox", F.xxhash64(F.lit(4), "vox").alias("h")).collect()}
    left, want = set(turn), {}
    for v in sorted(turn, key=turn.get):
        if v in left:
            p = np.array(np.unravel_index(v - 1, (6, 6, 6), order="F"))
            took = {u for u in left if ((np.array(np.unravel_index(u - 1, (6, 6, 6), order="F")) - p) ** 2).sum() <= 4}
            want |= dict.fromkeys(took, v)
            left -= took
    assert {r.vox: r.center for r in rows} == want


def test_radius_below_a_voxel_is_an_error():
    with pytest.raises(ValueError):
        neighbourhoods.sphere_offsets((2.0, 2.0, 2.0), 1.0)


def test_partition_and_clusters(spark):
    mask = from_numpy(spark, np.ones((6, 6, 6))).mask()
    parts = aggregates.partition(mask, 4)
    assert parts.count() == 216 and 1 <= parts.select("cluster").distinct().count() <= 4
    assert aggregates.medoids(Space((6, 6, 6)), parts).count() == parts.select("cluster").distinct().count()


def test_split_scale_gives_nan_without_spread(spark):
    image = from_numpy(spark, np.ones((2, 2, 2, 4)))
    factor = spark.createDataFrame([(t, t % 2) for t in range(1, 5)], "t int, level int")
    assert all(np.isnan(r.value) for r in windows.split_scale(image, factor).data.collect())
    assert all(r.value == 0 for r in windows.scale_series(image).data.collect())


def test_confounds_are_orthonormal():
    x = np.random.default_rng(0).normal(size=(30, 3))
    for q in windows.prepare_confounds(np.column_stack([x, x[:, 0]]), [10, 20]):
        assert np.allclose(q.T @ q, np.eye(q.shape[1]), atol=1e-8) and q.shape[1] == 4


def test_graph_rows_sum_to_one(spark):
    image = from_numpy(spark, np.random.default_rng(5).normal(size=(3, 3, 3, 12)))
    graph = graphs.correlation_graph([image, image], topk=5)
    assert all(abs(r.w - 1) < 1e-9 for r in graph.groupBy("vox").agg(F.sum("w").alias("w")).collect())
    outs = graphs.graph_filter([image, image], window=1, spatial_sigma=1.0, topk=5, leave_one_out=True)
    assert len(outs) == 2 and outs[0].data.count() == 27 * 12


def test_joins_and_sets(spark, cube):
    a = from_numpy(spark, cube)
    assert np.allclose(joins.arith(a, "+", a).to_numpy(), 2 * cube)
    assert np.allclose(joins.arith(a, "/", 2.0).to_numpy(), cube / 2)
    with pytest.raises(ValueError):
        joins.arith(a, "+", from_numpy(spark, np.ones((2, 2, 2))))
    s = sets.concat(a, a, a)
    assert s.space.dims == (6, 5, 4, 3)
    with pytest.raises(IndexError):
        sets.sub_vector(s, [4])
    with pytest.raises(KeyError):
        sets.volume_at(s, "no such label")
    assert filters.compare(a, "<=", 0).data.count() == (cube <= 0).sum()
    assert filters.clip_level(from_numpy(spark, np.ones((3, 3, 3)))) == 0.0


def test_downsample_skips_missing(spark):
    x = np.ones((4, 4, 4))
    x[0, 0, 0] = np.nan
    got = aggregates.downsample(from_numpy(spark, x), factor=0.5)
    assert got.space.dims == (2, 2, 2) and np.allclose(got.to_numpy(), 1)
    with pytest.raises(ValueError):
        aggregates.target_dims(Space((4, 4, 4)), factor=0.5, outdim=(1, 1, 1))


def test_empty_images(spark):
    none = from_numpy(spark, np.ones((3, 3, 3)))
    none = none.with_data(none.data.where("vox < 0"))
    assert stencils.gaussian_blur(none).data.count() == 0
    assert components.connected_components(none.mask()).count() == 0
    assert neighbourhoods.random_searchlight(none.mask(), 1.0).count() == 0
    assert aggregates.summarize(none).first().largest == 0
