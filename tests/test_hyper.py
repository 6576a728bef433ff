"""Five dimensions in chunks against arrays."""

import itertools

import numpy as np
import pytest

from voxelarium.operators import hyper
from voxelarium.space import Space

DIMS = (7, 6, 5, 4, 3)
SIZES = (3, 4, 2, 3, 2)


@pytest.fixture(scope="module")
def image(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    x = rng.normal(size=DIMS)
    x[rng.random(DIMS[:3]) < 0.5] = 0
    rows = [(f + 1, t + 1, i + 7 * (j + 6 * k) + 1, float(x[i, j, k, t, f])) for i, j, k, t, f in np.argwhere(x != 0).tolist()]
    cells = spark.createDataFrame(rows, hyper.CELLS).repartition(5)
    made = hyper.from_cells(Space(DIMS), cells, SIZES)
    return x, made.write(str(tmp_path_factory.mktemp("hyper") / "chunks"))


def table(frame):
    return {(r.feature, r.trial, r.vox): r.value for r in frame.collect()}


def places(axes):
    return list(itertools.product(*[range(1, d + 1) if a is None else range(a[0], a[1] + 1) if isinstance(a, tuple) else sorted(set(a)) for a, d in zip(axes, DIMS)]))


@pytest.mark.parametrize("axes", [(None,) * 5, ((2, 5), [6, 1, 1], None, (2, 3), [3]), ([7], [1], [5], [4], [2]), ((3, 3), None, (1, 2), None, None), ([], None, None, None, None)])
def test_subsets_and_dense_cells(image, axes):
    x, made = image
    named = dict(zip(("i", "j", "k", "trial", "feature"), axes))
    want = {(f, t, i + 7 * (j - 1 + 6 * (k - 1))): float(x[i - 1, j - 1, k - 1, t - 1, f - 1]) for i, j, k, t, f in places(axes)}
    assert table(hyper.dense(made, **named)) == want
    got = table(hyper.subset(made, **named))
    assert all(want[c] == v for c, v in got.items()) and {c for c, v in want.items() if v} <= set(got)


def test_series_and_mask(image):
    x, made = image
    at = tuple(np.argwhere(x[..., 0, 0] != 0)[0])
    assert {(r.feature, r.trial): r.value for r in hyper.series(made, *(a + 1 for a in at)).collect()} == {(f + 1, t + 1): x[(*at, t, f)] for t in range(4) for f in range(3)}
    off = tuple(a + 1 for a in np.argwhere((x == 0).all(axis=(3, 4)))[0])
    assert {r.value for r in hyper.series(made, *off).collect()} == {0.0}
    assert {r.vox for r in hyper.mask_of(made).collect()} == {int(i + 7 * (j + 6 * k)) + 1 for i, j, k in np.argwhere((x != 0).any(axis=(3, 4)))}


def test_conditions_reach_the_chunks(spark, image):
    """The bounds of a chunk are what Parquet is asked for, and few chunks hold a small box."""
    _, made = image
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = hyper.subset(made, i=(1, 2), k=[5], feature=[3])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert "LessThanOrEqual(i_from,2)" in pushed and "GreaterThanOrEqual(k_to,5)" in pushed and "GreaterThanOrEqual(feature_to,3)" in pushed
    asked = [hyper._asked(w, d) for w, d in zip(((1, 2), None, [5], None, [3]), DIMS)]
    assert hyper._near(made.data, asked).count() <= 1 * 2 * 1 * 2 * 1 < made.data.count()


def test_bounds_and_repeats(spark):
    with pytest.raises(ValueError, match="not 5"):
        hyper.from_cells(Space((2, 2, 2)), spark.createDataFrame([], hyper.CELLS))
    rows = [(1, 1, 1, 2.0), (1, 1, 1, 5.0), (2, 1, 9, 1.0), (3, 1, 1, 1.0), (1, 9, 1, 1.0), (1, 1, 2, None)]
    made = hyper.from_cells(Space((2, 2, 2, 2, 2)), spark.createDataFrame(rows, hyper.CELLS))
    got = table(hyper.dense(made))
    assert len(got) == 32 and {c: v for c, v in got.items() if v} == {(1, 1, 1): 5.0}
    with pytest.raises(IndexError):
        hyper.subset(made, i=[3])
    empty = hyper.from_cells(Space((2, 2, 2, 1, 1)), spark.createDataFrame([], hyper.CELLS))
    assert set(table(hyper.dense(empty)).values()) == {0.0} and table(hyper.subset(empty)) == {}
