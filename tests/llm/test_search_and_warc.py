"""Nearest neighbours against brute force, archives against their rows."""

import base64
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelarium.llm import ann, warc


def brute(ids, vectors, query, k):
    score = vectors @ vectors[ids.index(query)]
    return [ids[i] for i in sorted((i for i in range(len(ids)) if ids[i] != query), key=lambda i: (-score[i], ids[i]))[:k]]


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 8))
    y = ann.rotate(x, ann.signs(1, 1, 8)[0])
    assert np.allclose(x @ x.T, y @ y.T) and np.allclose(ann.hadamard(ann.hadamard(x)), x)


@pytest.mark.parametrize("scale", [1.0, 5.0])
def test_recall_where_not_all_is_searched(spark, scale, monkeypatch):
    """Vectors of unequal length in loose groups; cells are cut small."""
    monkeypatch.setattr(ann, "CELL_VECTORS", 50)
    monkeypatch.setattr(ann, "CELL_QUERIES", 7)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 16)).repeat(50, axis=0) + 0.5 * rng.normal(size=(2000, 16))
    v *= scale * rng.uniform(0.5, 1.5, (2000, 1))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=10, probes=6, least=100).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and q not in set(g.vec_id)
        assert np.allclose(g.score, v[g.vec_id] @ v[q]) and (np.diff(g.score) <= 0).all()
        hit += len(set(g.vec_id) & set(brute(list(range(2000)), v, q, 10)))
    assert hit / 1000 >= 0.9


def test_recall_on_the_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pdf = df.toPandas()
    ids, v = pdf.vec_id.tolist(), np.array(pdf.embedding.tolist(), float)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    hits = [len(set(g.vec_id) & set(brute(ids, v, q, 20))) / 20 for q, g in got.groupby("query_id")]
    assert len(hits) == sum(i % 20 == 0 for i in ids) and np.mean(hits) >= 0.9


def test_recall_on_vectors_of_unequal_length(spark):
    """Plain normal vectors and, far below them, short ones; nothing but the operator's own parameters."""
    v = np.random.default_rng(8).normal(size=(8000, 64))
    v[6000:] *= 1e-3
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 160 == 0).toPandas()
    ids, hits = list(range(8000)), []
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert len(g) == 20 and np.allclose(g.score, v[g.vec_id] @ v[q])
        hits.append(len(set(g.vec_id) & set(brute(ids, v, q, 20))) / 20)
    assert len(hits) == 50 and np.mean(hits) >= 0.93


def test_keys_and_probes_agree():
    """Every bucket in the order of the summed coordinates; a vector is in the bucket that it probes first."""
    x = np.random.default_rng(3).normal(size=(20, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes, flips = [8, 8, 3], ann.signs(5, 3, 8)
    turned = [ann.rotate(x, f)[:, :n] for f, n in zip(flips, axes)]
    sides = [np.stack([t, -t], axis=2).reshape(20, -1) for t in turned]
    joint = (sides[0][:, :, None, None] + sides[1][:, None, :, None] + sides[2][:, None, None, :]).reshape(20, -1)
    for n in (1, 7, 40):
        got = np.take_along_axis(joint, ann.probes_of(x, flips, axes, n), axis=1)
        assert np.allclose(np.sort(got, axis=1), np.sort(joint, axis=1)[:, -n:])  # equal sums may stand for each other
    assert (ann.keys_of(x, flips, axes) == ann.probes_of(x, flips, axes, 1)[:, 0]).all()
    assert ann.axes_of(500, 128) == [31] and ann.axes_of(51_282, 128) == [128, 13] and len(ann.axes_of(10**9, 128)) == 4


def test_copies_lose_no_neighbour(spark):
    """A third of the rows is one vector, queries among them; every result equals brute force."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 4)).round(1)
    v[100:200] = v[100]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=7, probes=10_000).toPandas()
    assert got.groupby("query_id").size().tolist() == [7] * 15
    for q, g in got.groupby("query_id"):
        score = (v * v[q]).sum(axis=1)
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-score[i], i))[:7]
        assert g.sort_values("rank").vec_id.tolist() == want


def test_recall_beyond_every_threshold(spark):
    """Unit vectors without structure, more than a cell holds; a query meets a part of them."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(20_000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 200 == 0, k=10).toPandas()
    near = v[::200] @ v.T
    near[np.arange(100), np.arange(0, 20_000, 200)] = -np.inf
    want = np.argsort(-near, axis=1)[:, :10]
    hits = [len(set(g.vec_id) & set(want[q // 200].tolist())) for q, g in got.groupby("query_id")]
    assert sum(hits) / 1000 >= 0.9


def test_ties_and_hard_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in (0, 4, 2, 1, 3)] + [(5, [0.0, 1.0]), (6, [0.0, 0.0]), (7, None), (8, [float("nan"), 1.0]), (9, [None, 1.0]), (10, [float("inf"), 0.0]), (None, [1.0, 1.0]), (20, [1.0]), (4, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, t string")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2), (0, 3), (20, 0), (20, 1), (20, 2)]
    assert ann.nearest(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0


def test_archives(spark, tmp_path):
    rows = [(3, "http://a/ b\r\nX: y", "same é"), (1, None, "same é"), (2, "http://c", "other"), (4, "http://d", None), (5, "http://e", ""), (None, "http://f", "same é"), (2, "http://c", "other"), (6, "u", "long " * 50_000)]
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, path string, part string").repartition(3)
    archives = warc.deduplicated_archives(spark, df)
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows)
    for r in got:
        payloads = {(h or "").encode() for i, _, h in rows if i == r.page_id}
        payload = payloads.pop()
        assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "revisit", 1), (1, "response", None), (2, "response", None), (2, "revisit", 2), (3, "revisit", 1), (4, "response", None), (5, "revisit", 4), (6, "response", None)]
    assert {r.url for r in got if r.page_id == 1} == {"urn:page:1"} and {r.url for r in got if r.page_id == 3} == {"http://a/%20b%0D%0AX:%20y"}
    large = warc.read_archives(warc.deduplicated_archives(spark, df, min_payload=6)).collect()
    assert sum(r.record_type == "revisit" for r in large) == 2
    assert warc.read_archives(warc.deduplicated_archives(spark, df.where("page_id < 0"))).count() == 0


def test_revisits_have_headers_and_no_payload(spark):
    df = spark.createDataFrame([(1, "http://a", "p"), (2, "http://b", "p")], "page_id long, url string, html string").coalesce(1)
    paths = [r.path for r in warc.deduplicated_archives(spark, df).collect()]
    data = b"".join(gzip.decompress(warc.local_file(p)[0].open_input_file(warc.local_file(p)[1]).read()) for p in paths)
    assert data.count(b"WARC-Type: revisit") == 1 and b"WARC-Refers-To-Target-URI: http://a\r\n" in data and data.count(b"\r\n\r\np\r\n") == 1


def test_broken_records_are_errors():
    good = warc.record("response", 1, "u", warc.digest(b"p"), b"p", 1)
    assert warc.parse(good)[1] == b"p"
    for bad in (b"x" + good, good[:-1], good + b"x"):
        with pytest.raises(ValueError):
            warc.parse(bad)
