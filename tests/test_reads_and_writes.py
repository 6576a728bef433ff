"""What is read of a file, conditions on the frame, and files that many tasks write."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelarium.image import from_numpy
from voxelarium.sources import nifti
from voxelarium.space import Space


class Counting:
    """A file that adds up what is read of it."""

    total = 0

    def __init__(self, file):
        self.file = file

    def read(self, n=-1):
        out = self.file.read(n)
        Counting.total += len(out)
        return out

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def __getattr__(self, name):
        return getattr(self.file, name)


@pytest.fixture(scope="module")
def series(spark, tmp_path_factory):
    x = np.random.default_rng(0).integers(0, 30000, (40, 40, 30, 6)).astype(float)
    path = str(tmp_path_factory.mktemp("series") / "s.nii")
    nifti.write_image(from_numpy(spark, x, Space(x.shape)), path, dtype="i2")
    return path, x


def rows_of(batches):
    return [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]


def test_a_scattered_mask_reads_its_runs_only(series, monkeypatch):
    path, x = series
    flat = x.reshape(-1, 6, order="F")
    voxels = np.array([[1, 3], [5000, 5000], [5002, 5009], [30_000, 30_001], [48_000, 48_000]])
    real = nifti.open_file
    monkeypatch.setattr(nifti, "open_file", lambda p: Counting(real(p)))
    monkeypatch.setattr(nifti, "read_header", lambda p, h=nifti.read_header(path): h)
    for gap, bytes_a_volume in ((0, 15 * 2), (2, 16 * 2), (10**6, 48_000 * 2)):
        reader = nifti.NiftiReader([path], 4, times=[2, 5], runs=voxels, gap=gap)
        Counting.total, got = 0, []
        for part in reader.partitions():
            Counting.total = 0
            got += rows_of(reader.read(part))
            assert Counting.total == len(part.times) * bytes_a_volume
        want = [(t, v, flat[v - 1, t - 1]) for t in (2, 5) for a, b in voxels.tolist() for v in range(a, b + 1)]
        assert got == want


def test_mask_runs_and_their_packing(spark):
    rng = np.random.default_rng(1)
    for share in (0.0, 0.02, 0.5, 1.0):
        picked = np.flatnonzero(rng.random(5000) < share) + 1
        mask = from_numpy(spark, np.zeros((50, 10, 10))).mask(F.col("vox").isin(picked.tolist()))
        runs = nifti.mask_runs(mask.with_data(mask.data.repartition(3)))
        assert np.array_equal(np.concatenate([np.arange(a, b + 1) for a, b in runs] or [np.zeros(0)]), picked)
        assert len(runs) < 2 or (runs[1:, 0] > runs[:-1, 1] + 1).all()
        assert np.array_equal(nifti._unpack_runs(nifti._pack_runs(runs)), runs)
        fewer = nifti.merged(runs, 0, 7)
        assert len(fewer) <= 7 and (not len(runs) or (fewer[0, 0] == runs[0, 0] and fewer[-1, 1] == runs[-1, 1]))


def test_runs_in_common():
    rng = np.random.default_rng(2)

    def draw():
        at = np.flatnonzero(rng.random(60) < rng.choice([0.1, 0.5, 0.9]))
        return at, nifti.merged(np.stack([at, at], axis=1), 0)

    for _ in range(200):
        (a, runs), (b, others) = draw(), draw()
        both = nifti._within_runs(runs, others)
        got = np.concatenate([np.arange(s, e + 1) for s, e in both] or [np.zeros(0, int)])
        assert np.array_equal(got, np.intersect1d(a, b))


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_masked_image(spark, series, monkeypatch, most):
    """Also where the mask has more runs than a reader carries."""
    monkeypatch.setattr(nifti, "MOST_RUNS", most)
    path, x = series
    inside = np.zeros(x.shape[:3])
    inside[::7, ::5, ::3] = 1
    back = nifti.read_image(spark, path, times=[6, 1], mask=from_numpy(spark, inside).mask())
    assert back.data.count() == 2 * int(inside.sum())
    assert np.array_equal(back.to_numpy(), (x * inside[..., None])[..., [5, 0]])


def test_conditions_on_the_frame(spark, series):
    path, x = series
    flat = x.reshape(-1, 6, order="F")
    frame = nifti.scan(spark, [path], block=10_000)
    cases = [
        (F.col("t") == 3, lambda v, t: t == 3),
        ((F.col("t") >= 5) & (F.col("vox") < 40), lambda v, t: t >= 5 and v < 40),
        (F.col("vox").isin(7, 100, 47_999) & (F.col("t") != 2), lambda v, t: v in (7, 100, 47_999) and t != 2),
        ((F.col("t") == 1) & (F.col("value") > 29_900), lambda v, t: t == 1 and flat[v - 1, 0] > 29_900),
        ((F.col("t") == 1) & (F.col("t") == 2), lambda v, t: False),
        (F.col("vox") > 10**9, lambda v, t: False),
    ]
    for condition, holds in cases:
        got = sorted((r.vox, r.t, r.value) for r in frame.where(condition).collect())
        assert got == [(v, t, flat[v - 1, t - 1]) for v in range(1, 48_001) for t in range(1, 7) if holds(v, t)]
    both = frame.where("t = 3").union(frame.where("t = 5")).groupBy("t").count().collect()  # one frame, two conditions
    assert sorted(map(tuple, both)) == [(3, 48_000), (5, 48_000)] and frame.count() == 6 * 48_000


def test_what_a_condition_excludes_is_not_read(spark, series, tmp_path):
    """A file cut off after its third volume serves whoever asks for no more."""
    path, x = series
    cut = str(tmp_path / "cut.nii")
    with open(path, "rb") as a, open(cut, "wb") as b:
        b.write(a.read(352 + 3 * 48_000 * 2))
    image = nifti.read_image(spark, cut)
    assert image.data.where("t <= 3").count() == 3 * 48_000
    with pytest.raises(Exception, match="ends early"):
        image.data.where("t <= 4").count()
    plan = image.data.where("t = 2")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.rindex("Filter")


def test_gzip_by_its_bytes(spark, series, tmp_path):
    path, x = series
    packed = str(tmp_path / "packed.nii")
    with open(path, "rb") as a, gzip.open(packed, "wb") as b:
        b.write(a.read())
    assert np.array_equal(nifti.read_image(spark, packed, times=[4]).to_numpy()[..., 0], x[..., 3])


def test_many_files_are_one_scan(spark, tmp_path):
    xs = [np.random.default_rng(k).integers(0, 99, (3, 2, 2, 2)).astype(float) for k in range(3)]
    paths = [str(tmp_path / f"f,{k}.nii") for k in range(3)]
    for p, x in zip(paths, xs):
        nifti.write_image(from_numpy(spark, x), p)
    image = nifti.read_volumes(spark, paths)
    assert image.data._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert np.array_equal(image.to_numpy(), np.concatenate(xs, axis=3))
    assert sorted(r.t for r in image.data.where("t in (2, 5)").select("t").distinct().collect()) == [2, 5]


@pytest.mark.parametrize("name", ["w.nii", "w.nii.gz"])
@pytest.mark.parametrize("dtype", ["f4", "i2"])
def test_many_tasks_write_the_file_of_one(spark, tmp_path, name, dtype):
    """Also with parts that have no row, and integers whose 0 isn't 0 bytes."""
    x = np.random.default_rng(3).normal(3, 2, (20, 10, 5, 3))
    x[:, :, 1:3] = 0
    image = from_numpy(spark, x).sparse()
    image = image.with_data(image.data.repartition(7))
    one, many = str(tmp_path / f"one-{name}"), str(tmp_path / f"many-{name}")
    nifti.write_image(image, one, dtype=dtype)
    nifti.write_image(image, many, dtype=dtype, part_values=97)
    read = gzip.open if name.endswith(".gz") else open
    with read(one, "rb") as a, read(many, "rb") as b:
        assert a.read() == b.read()
    assert sorted(os.listdir(tmp_path)) == sorted([f"one-{name}", f"many-{name}"])
    step = 1e-6 if dtype == "f4" else (x.max() - x.min()) / 65535
    assert np.abs(nifti.read_image(spark, many).to_numpy() - x).max() <= step


@pytest.mark.parametrize("name", ["k.nii", "k.nii.gz"])
def test_a_failed_task_leaves_nothing(spark, tmp_path, name):
    image = from_numpy(spark, np.ones((10, 10, 10)))
    bad = image.map(lambda v: F.when(F.col("vox") == 777, F.raise_error(F.lit("lost")).cast("double")).otherwise(v))
    with pytest.raises(Exception, match="lost"):
        nifti.write_image(bad, str(tmp_path / name), part_values=100, dtype="f4")
    assert os.listdir(tmp_path) == []


def test_an_older_file_stays_until_the_new_one_is_whole(spark, tmp_path):
    path = str(tmp_path / "o.nii")
    nifti.write_image(from_numpy(spark, np.ones((4, 4, 4))), path)
    before = open(path, "rb").read()
    bad = from_numpy(spark, np.ones((4, 4, 4))).map(lambda v: F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        nifti.write_image(bad, path, dtype="f4")
    assert open(path, "rb").read() == before


def test_repeated_rows_and_rows_outside(spark, tmp_path):
    image = from_numpy(spark, np.zeros((2, 2, 2)))
    rows = spark.createDataFrame([(1, 5.0), (1, 7.0), (8, 1.0), (9, 3.0), (0, 3.0), (None, 4.0)], "vox long, value double")
    path = str(tmp_path / "r.nii")
    nifti.write_image(image.with_data(rows), path, dtype="f4")
    assert nifti.read_image(spark, path).to_numpy().reshape(-1, order="F").tolist() == [7, 0, 0, 0, 0, 0, 0, 1]
