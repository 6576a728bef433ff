"""Correlations of neighbours by tiles of series, and graphs that leave a run out."""

import itertools

import numpy as np
import pytest

from voxelarium.image import from_numpy
from voxelarium.operators import blocks, graphs
from voxelarium.space import Space


def brute(x, there, window, spacing=(1.0, 1.0, 1.0)):
    out, dims = {}, x.shape[:3]
    for p in np.ndindex(dims):
        for o in itertools.product(range(-window, window + 1), repeat=3):
            q = tuple(a + b for a, b in zip(p, o))
            if not any(o) or any(a < 0 or a >= d for a, d in zip(q, dims)):
                continue
            both = there[p] & there[q]
            n = int(both.sum())
            if n:
                a, b = x[p][both], x[q][both]
                flat = n < 3 or a.std() == 0 or b.std() == 0
                r = 0.0 if flat else np.clip(np.corrcoef(a, b)[0, 1], -0.999999, 0.999999)
                number = lambda v: int(np.ravel_multi_index(v, dims, order="F")) + 1
                out[number(p), number(q)] = (sum((c * s) ** 2 for c, s in zip(o, spacing)), r, n)
    return out


@pytest.mark.parametrize("window,share", [(1, 1.0), (1, 0.6), (2, 0.3)])
def test_neighbour_correlations(spark, monkeypatch, window, share):
    """Over several cubes; with missing times, few common times, constant series and values far from zero."""
    monkeypatch.setattr(graphs, "CUBE_VALUES", 8 * (4 + 2 * window) ** 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(7, 5, 6, 8)) + 1000
    x[2, 2, 2], x[3, 2, 2, :] = 5.0, 1e6
    there = rng.random(x.shape) < share
    spacing = (1.0, 2.0, 1.5)
    image = from_numpy(spark, np.where(there, x, np.nan), Space(x.shape, spacing=spacing))
    got = {(r.a, r.b): (r.d2, r.r, r.n) for r in graphs.neighbour_correlations(image, window).collect()}
    want = brute(x, there, window, spacing)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][2] == want[k][2] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_no_join_on_time(spark):
    image = from_numpy(spark, np.random.default_rng(6).normal(size=(5, 4, 3, 9)))
    plan = graphs.correlation_graph([image])._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and not [line for line in plan.splitlines() if "Join" in line and "t#" in line]


def test_copies_of_series_grow_with_the_surface(spark):
    image = from_numpy(spark, np.ones((32, 32, 32, 2)))
    layout = blocks.layout_of(image, (1, 1, 1), 16, 2)
    assert blocks.haloed(image, layout).count() < 1.2 * 2 * 32**3


def test_leaving_out_is_subtraction(spark):
    """The same graphs as those of the other runs alone, and each run's correlations once in the plan."""
    rng = np.random.default_rng(7)
    runs = [from_numpy(spark, rng.normal(size=(4, 4, 3, n))) for n in (12, 9, 15)]
    for options in ({}, {"run_weights": [1, 2, 3]}, {"confounds": [rng.normal(size=(n, 1)) for n in (12, 9, 15)], "topk": 3}):
        every = graphs.leave_one_out_graphs(runs, **options)
        for k, graph in enumerate(every):
            others = [i for i in range(3) if i != k]
            alone = {name: [v[i] for i in others] if isinstance(v, list) else v for name, v in options.items()}
            want = {(r.vox, r.near): r.w for r in graphs.correlation_graph([runs[i] for i in others], **alone).collect()}
            got = {(r.vox, r.near): r.w for r in graph.collect()}
            assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in got)
    pooled = graphs.pooled_correlations(runs)._jdf.queryExecution().optimizedPlan().toString()
    assert pooled.count("FlatMapGroupsInArrow") == 3
    with pytest.raises(ValueError, match="no run"):
        graphs.leave_one_out_graphs(runs[:1])


def test_a_pair_of_the_left_out_run_alone_goes(spark):
    x = np.random.default_rng(8).normal(size=(3, 1, 1, 6))
    few = x.copy()
    few[2] = np.nan
    runs = [from_numpy(spark, x), from_numpy(spark, few)]
    first, second = graphs.leave_one_out_graphs(runs, topk=0, add_self=False, corr_map="exp")
    assert {(r.vox, r.near) for r in first.collect()} == {(1, 2), (2, 1)}
    assert {(r.vox, r.near) for r in second.collect()} == {(1, 2), (2, 1), (2, 3), (3, 2)}
