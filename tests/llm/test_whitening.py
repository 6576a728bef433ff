"""Whitening against numpy on the whole matrix."""

import numpy as np
import pytest

from voxelarium.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, n int, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 5, "c") for i, v in rows], SCHEMA)


def expected(vectors, k=4):
    """By vector: deviation and whitened values; and n, the shares and the spread of the eigenvalues."""
    x = np.array([[int(np.floor(256 * c)) for c in v] for v in vectors])
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    cov = (u - s / n).T @ (u - s / n) / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ axes / np.sqrt(e), e / np.trace(cov)


def check(rows, vectors, ids, k=4):
    n, deviation, w, share = expected(vectors, k)
    table = {}
    for r in rows:
        assert r.n == n and r.deviation == deviation[ids.index(r.vec_id)] and r.identity_error < 1e-9
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9
        table[r.vec_id, r.component] = r.whitened
    assert len(table) == len(rows) == k * len(ids)
    for c in range(1, k + 1):
        got = np.array([table[i, c] for i in ids])
        side = np.sign(got @ w[:, c - 1])
        assert np.allclose(got * side, w[:, c - 1], rtol=1e-8, atol=1e-8)


@pytest.mark.parametrize("tile,values", [(32, 1 << 20), (4, 64), (3, 7), (1, 10)])
def test_tiles(spark, tile, values):
    """Dimensions that the tiles don't divide, many row-blocks, and copies of one vector."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 10)) * np.arange(1, 11)[::-1] + rng.normal(size=10) * 50
    v[100:200] = v[0]
    ids = list(range(300))
    df = frame(spark, zip(ids, v.tolist())).repartition(5)
    check(whitening.whiten(df, whitening.fit(df, tile=tile, block_values=values)).collect(), v, ids)


def test_query(spark, sf_dir):
    pdf = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    v = np.array([np.array(x, float) for x in pdf.embedding])
    check(queries.op11_embedding_whitening(spark, sf_dir).collect(), v, pdf.vec_id.tolist())


def test_what_is_left_out(spark):
    """Nulls, non-finite entries, other lengths and empty vectors; a null id and a repeated row stay."""
    good = [(1, [1, 2]), (2, [3, -1]), (None, [0.5, 0.25]), (1, [1, 2])]
    bad = [(5, None), (6, []), (7, [1, None]), (8, [float("nan"), 1]), (9, [1, float("inf")]), (10, [float("-inf"), 0]), (11, [1, 2, 3])]
    df = frame(spark, good + bad)
    out = whitening.whiten(df, whitening.fit(df)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r.n for r in out} == {3} and max(r.identity_error for r in out) < 1e-9
    only_bad = frame(spark, bad[:6])
    assert whitening.whiten(only_bad, whitening.fit(only_bad)).collect() == []
    assert whitening.fit(df.where("false")) is None


def test_without_variance(spark):
    one = frame(spark, [(1, [1, 1, 1]), (2, [1, 1, 1])])
    out = whitening.whiten(one, whitening.fit(one)).collect()
    assert len(out) == 6 and all(r.whitened is None and r.identity_error is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in out)
    flat = frame(spark, [(i, [i, 0, 2 * i]) for i in range(9)])
    out = whitening.whiten(flat, whitening.fit(flat)).collect()
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in out)


def test_beyond_a_long(spark):
    """Entries so large that sums and squares leave a long."""
    big = frame(spark, [(1, [2.0**50, 0]), (2, [-(2.0**50), 1]), (3, [2.0**60, 2]), (4, [2.0**60, 5])])
    out = whitening.whiten(big, whitening.fit(big)).collect()
    assert len(out) == 8 and all(r.deviation is None for r in out)
    wide = frame(spark, [(1, [2.0**12, 0]), (2, [-(2.0**12), 1]), (3, [0, 2])])
    got = {r.vec_id: r.deviation for r in whitening.whiten(wide, whitening.fit(wide)).collect()}
    x = np.array([[2**20, 0], [-(2**20), 256], [0, 512]])
    assert got == dict(zip([1, 2, 3], ((3 * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist()))
