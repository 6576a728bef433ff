"""Graphs with weights and confounds, against numpy; reads of parts of a file; small operators."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelarium.image import from_numpy
from voxelarium.operators import aggregates, graphs, joins, resampling, windows
from voxelarium.sources import headers, nifti
from voxelarium.space import Space

DIMS = (4, 3, 2)


def runs_of(spark, lengths):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(*DIMS, sum(lengths))) + rng.normal(size=sum(lengths))
    parts = np.split(base, np.cumsum(lengths)[:-1], axis=3)
    return parts, [from_numpy(spark, x, Space(x.shape)) for x in parts]


def wanted(parts, weights, confounds, omega, left_out=None):
    """``{(vox, near): w}`` of all edges, by least squares on each pair's run."""
    vox = {p: int(np.ravel_multi_index(p, DIMS, order="F")) + 1 for p in np.ndindex(DIMS)}
    out = {}
    for p in vox:
        for o in itertools.product((-1, 0, 1), repeat=3):
            q = tuple(a + b for a, b in zip(p, o))
            if p == q or q not in vox:
                continue
            z = total = 0.0
            for k, x in enumerate(parts):
                if k == left_out:
                    continue
                sw = np.sqrt(weights[k])
                design = np.column_stack([np.ones(len(sw)), confounds[k]]) * sw[:, None]
                left = [y * sw - design @ np.linalg.lstsq(design, y * sw, rcond=None)[0] for y in (x[p], x[q])]
                r = np.clip(left[0] @ left[1] / np.sqrt((left[0] @ left[0]) * (left[1] @ left[1])), -0.999999, 0.999999)
                z, total = z + omega[k] * np.arctanh(r), total + omega[k]
            r = np.tanh(z / total)
            if r > 0:
                out[vox[p], vox[q]] = r**2 * np.exp(-sum(a * a for a in o) / 8)
    for v in vox.values():
        out[v, v] = 1e-12
    sums = {v: sum(w for (a, _), w in out.items() if a == v) for v in vox.values()}
    return {(a, b): w / sums[a] for (a, b), w in out.items()}


def check(graph, want):
    got = {(r.vox, r.near): r.w for r in graph.collect()}
    assert set(got) == set(want) and all(abs(got[e] - want[e]) < 1e-6 for e in got)


def test_weights_and_confounds(spark):
    parts, runs = runs_of(spark, [20, 25])
    rng = np.random.default_rng(9)
    weights = [rng.random(20), rng.random(25)]
    confounds = [np.column_stack([rng.normal(size=20), np.ones(20)]), rng.normal(size=(25, 2))]
    both = dict(topk=0, time_weights=weights, confounds=confounds)
    check(graphs.correlation_graph(runs, **both), wanted(parts, weights, confounds, [17, 22]))
    check(graphs.correlation_graph(runs, run_weights=[1, 3], **both), wanted(parts, weights, confounds, [1, 3]))
    check(graphs.correlation_graph(runs, leave_out=0, **both), wanted(parts, weights, confounds, [17, 22], 0))


@pytest.mark.parametrize("kind", ["huber", "tukey"])
def test_robust_weights(spark, kind):
    parts, runs = runs_of(spark, [22])
    parts[0][..., 9] += 30
    runs = [from_numpy(spark, parts[0], Space(parts[0].shape))]
    d = np.sqrt((np.diff(parts[0], axis=3) ** 2).mean(axis=(0, 1, 2)))
    z = np.abs(d - np.median(d)) / (1.4826 * np.median(np.abs(d - np.median(d))))
    w = np.minimum(1, 1.345 / np.maximum(z, 1e-12)) if kind == "huber" else np.where(z < 4.685, (1 - (z / 4.685) ** 2) ** 2, 0)
    check(graphs.correlation_graph(runs, topk=0, robust=kind), wanted(parts, [np.array([1, *w])], [np.zeros((22, 0))], [19]))


def test_plain_graph_is_the_one_without_confounds(spark):
    parts, runs = runs_of(spark, [15])
    ones = [np.ones(15)]
    check(graphs.correlation_graph(runs, topk=0), wanted(parts, ones, [np.zeros((15, 0))], [12]))
    check(graphs.correlation_graph(runs, topk=0, confounds=[np.zeros((15, 0))]), wanted(parts, ones, [np.zeros((15, 0))], [12]))
    with pytest.raises(ValueError):
        graphs.correlation_graph(runs, time_weights=[np.ones(3)])
    with pytest.raises(ValueError):
        graphs.correlation_graph(runs, robust="mean")
    smoothed = graphs.graph_filter(runs_of(spark, [12, 12])[1], leave_one_out=True)
    assert [s.data.count() for s in smoothed] == [24 * 12] * 2


def test_basis_drops_dependent_columns():
    x = np.random.default_rng(1).normal(size=(12, 2))
    [q] = windows.prepare_confounds(np.column_stack([np.ones(12), x, x[:, 0] + x[:, 1], x[:, 1]]), [12])
    assert q.shape == (12, 3) and np.allclose(q.T @ q, np.eye(3)) and np.allclose(q @ q.T @ x, x)


def test_only_what_is_asked_for_is_read(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(2).normal(size=(10, 10, 10, 20)).astype("f4")
    path = str(tmp_path / "r.nii")
    nifti.write_image(from_numpy(spark, x, Space(x.shape)), path)
    read, real = [], nifti.open_file

    class Counting:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *error):
            self.file.close()

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            read.append(n)
            return self.file.read(n)

    reader = nifti.NiftiReader([path], 8, [3, 17], (201, 400))
    parts = reader.partitions()
    header = nifti.read_header(path)
    monkeypatch.setattr(nifti, "open_file", lambda p: Counting(real(p)))
    monkeypatch.setattr(nifti, "read_header", lambda p: header)
    rows = [b for part in parts for b in reader.read(part)]
    assert sum(read) == 2 * 200 * 4 and sum(b.num_rows for b in rows) == 400
    flat = x.reshape(1000, 20, order="F")
    assert np.array_equal(np.asarray(rows[1].column(3)), flat[200:400, 16].astype(float))
    monkeypatch.undo()
    assert np.array_equal(nifti.read_volume(spark, path, 17).to_numpy(), x[..., 16].astype(float))
    with pytest.raises(ValueError):
        nifti.read_volume(spark, path, 21)
    mask = from_numpy(spark, x[..., 0], Space((10, 10, 10))).mask(F.col("vox").isin(5, 600))
    for name in (path, path + ".gz"):
        if name.endswith(".gz"):
            nifti.write_image(from_numpy(spark, x, Space(x.shape)), name)
        got = {(r.vox, r.t): r.value for r in nifti.read_image(spark, name, times=[9, 2], mask=mask).data.collect()}
        assert got == {(v, n): float(flat[v - 1, t - 1]) for v in (5, 600) for n, t in ((1, 9), (2, 2))}
    assert nifti.read_image(spark, path, mask=mask.with_data(mask.data.where("vox < 0"))).data.count() == 0
    uri = f"file://{tmp_path}/u.nii.gz"
    nifti.write_image(from_numpy(spark, x[..., 0]), uri)
    assert np.array_equal(nifti.read_image(spark, uri).to_numpy(), x[..., 0].astype(float))


def test_extensions_by_kind():
    h = headers.header_of(Space((2, 2, 2)), extensions=[headers.comment("one"), (4, b"afni"), headers.comment("two")])
    assert headers.extensions_of(h, "comment") == [b"one", b"two"] and headers.extensions_of(h, 4) == [b"afni"]
    assert len(headers.extensions_of(h)) == 3 and headers.has_extension(h, "AFNI") and not headers.has_extension(h, "DICOM")
    with pytest.raises(ValueError):
        headers.code_of("none such")


def test_parcel_weights_and_names(spark):
    x = np.arange(12, dtype=float).reshape(3, 2, 1, 2)
    image = from_numpy(spark, x, Space((3, 2, 1, 2)))
    parcels = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)], "vox long, cluster int")
    weights = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0), (4, None), (5, 2.0)], "vox long, w double")
    flat = x.reshape(6, 2, order="F")
    got = {(r.cluster, r.t): r.value for r in aggregates.parcel_series(image, parcels, weights=weights).collect()}
    assert got == {(1, t): (flat[0, t - 1] + 3 * flat[1, t - 1]) / 4 for t in (1, 2)} | {(2, t): None for t in (1, 2)} | {(3, t): flat[4, t - 1] for t in (1, 2)}
    labels = aggregates.label_map(parcels, {2: "left"})
    assert {r.cluster: r.label for r in labels.collect()} == {1: "Clus_1", 2: "left", 3: "Clus_3"}
    assert sorted(r.vox for r in aggregates.parcels_named(parcels, labels, ["left", "Clus_3"]).collect()) == [3, 4, 5]
    with pytest.raises(ValueError):
        aggregates.parcels_named(parcels, labels, ["right"])


def test_series_of_regions_and_grids(spark):
    x = np.arange(12, dtype=float).reshape(3, 2, 1, 2)
    image = from_numpy(spark, x, Space((3, 2, 1, 2))).sparse()
    rois = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 2)], "roi int, vox long")
    flat = x.reshape(6, 2, order="F")
    got = {(r.roi, r.vox, r.t): r.value for r in joins.series_roi(image, rois).collect()}
    assert got == {(a, v, t): flat[v - 1, t - 1] for a, v in ((1, 1), (1, 2), (2, 2)) for t in (1, 2)}
    a, b = Space((4, 4, 4), spacing=(2, 2, 2)), Space((8, 8, 8), origin=(1, 0, 0))
    cells = spark.range(1, 65).select(*[c.alias(n) for c, n in zip(a.to_grid(F.col("id")), "ijk")])
    for r in cells.select("i", "j", "k", *[c.alias(n) for c, n in zip(resampling.to_grid_of(a, b, *map(F.col, "ijk")), "xyz")]).collect():
        assert np.allclose([r.x, r.y, r.z], resampling.grid_to_grid(a, b, [[r.i, r.j, r.k]])[0])
    assert resampling.overlap(a, a) == 1 and resampling.overlap(a, Space((4, 4, 4), origin=(100, 0, 0))) == 0
    with pytest.warns(UserWarning, match="share"):
        resampling.resample(from_numpy(spark, np.ones((4, 4, 4)), a), Space((4, 4, 4), origin=(100, 0, 0)), "nearest")
