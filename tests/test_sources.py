import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelarium.image import from_numpy
from voxelarium.sources import headers, nifti
from voxelarium.space import Space
from voxelarium.streaming import volumes

SPACE = Space((4, 3, 2), trans=[[-2, 0, 0, 10], [0, 3, 0, -5], [0, 0, 4, 1], [0, 0, 0, 1]])


@pytest.mark.parametrize("name", ["a.nii", "a.nii.gz"])
@pytest.mark.parametrize("version", [1, 2])
def test_volume_round_trip(spark, tmp_path, name, version):
    x = np.random.default_rng(0).normal(size=(4, 3, 2)).astype("f4")
    path = str(tmp_path / name)
    nifti.write_image(from_numpy(spark, x, SPACE), path, version=version)
    back = nifti.read_image(spark, path)
    assert np.array_equal(back.to_numpy(), x.astype(float)) and np.allclose(back.space.trans, SPACE.trans, atol=1e-5)


def test_series_with_labels_times_and_mask(spark, tmp_path):
    x = np.random.default_rng(1).integers(0, 1000, (4, 3, 2, 5)).astype(float)
    image = from_numpy(spark, x, Space((4, 3, 2, 5), trans=SPACE.trans))
    path = str(tmp_path / "s.nii")
    nifti.write_image(type(image)(image.space, image.data, ("a", "b c", "ü", "d", "e")), path, dtype="i2")
    back = nifti.read_image(spark, path, volumes=2)
    assert back.labels == ("a", "b c", "ü", "d", "e") and np.array_equal(back.to_numpy(), x)
    picked = nifti.read_image(spark, path, times=[3, 1], mask=from_numpy(spark, x[..., 0], SPACE).mask(F.col("vox") <= 6))
    assert picked.data.count() == 12
    every = nifti.read_images(spark, str(tmp_path)).where("t = 2").count()
    assert every == 24


def test_scaled_integers_and_sparse_rows(spark, tmp_path):
    x = np.zeros((4, 3, 2))
    x[1, 1, 1], x[3, 2, 0] = 0.5, -2.25
    path = str(tmp_path / "z.nii")
    nifti.write_image(from_numpy(spark, x).sparse(), path, dtype="i2")
    assert np.abs(nifti.read_image(spark, path).to_numpy() - x).max() < 1e-4


def test_cut_file_is_an_error(spark, tmp_path):
    path = tmp_path / "c.nii"
    nifti.write_image(from_numpy(spark, np.ones((4, 3, 2))), str(path))
    path.write_bytes(path.read_bytes()[:-4])
    with pytest.raises(Exception, match="ends early"):
        nifti.read_image(spark, str(path)).data.collect()


def test_headers():
    h = headers.header_of(SPACE, "i2", 2.0, 1.0, extensions=[headers.comment("hello")])
    back = headers.parse(headers.pack(h))
    assert back.dims == (4, 3, 2) and back.scale == (2.0, 1.0) and np.allclose(back.trans, SPACE.trans)
    assert back.extensions[0][1].rstrip(b"\0") == b"hello"
    h.endian = ">"
    assert headers.parse(headers.pack(h)).dims == (4, 3, 2)
    h.sform_code = 0
    assert np.allclose(headers.parse(headers.pack(h)).trans, SPACE.trans, atol=1e-5)
    assert headers.header_of(Space((40000, 1, 1))).version == 2
    with pytest.raises(ValueError):
        headers.parse(b"\0" * 400)
    assert headers.Header((1,), (1,), slope=0.0).scale == headers.Header((1,), (1,), slope=float("nan")).scale == (1.0, 0.0)


def test_afni_and_niml():
    head = "\n".join([
        "type  = integer-attribute", "name  = DATASET_DIMENSIONS", "count = 5", " 4 5 6 0 0", "",
        "type  = integer-attribute", "name  = DATASET_RANK", "count = 8", " 3 7 0 0 0 0 0 0", "",
        "type  = integer-attribute", "name  = ORIENT_SPECIFIC", "count = 3", " 0 3 4", "",
        "type  = float-attribute", "name  = ORIGIN", "count = 3", " -10 -20 -30", "",
        "type  = float-attribute", "name  = DELTA", "count = 3", " 2 2 2", "",
        "type  = string-attribute", "name  = TYPESTRING", "count = 6", "'3DIM_~",
    ])
    a = headers.parse_afni_head(head)
    assert a["TYPESTRING"]["content"] == "3DIM_" and headers.afni_space(a).dims == (4, 5, 6, 7)
    xml = b'<AFNI_attributes><AFNI_atr ni_type="float" ni_dimen="2" atr_name="DELTA"> 1.5 2 </AFNI_atr></AFNI_attributes>'
    assert headers.afni_attributes(xml) == {"DELTA": [1.5, 2.0]}
    binary = np.array([[1, 2], [3, 4]], "<f4").tobytes()
    data = b'<INDEX_LIST ni_type="int" ni_dimen="3">1 2 3</INDEX_LIST>\n<SPARSE_DATA ni_type="2*float" ni_dimen="2" ni_form="binary.lsbfirst">' + binary + b"</SPARSE_DATA>"
    first, second = headers.parse_niml(data)
    assert first["data"].ravel().tolist() == [1, 2, 3] and second["data"].tolist() == [[1, 2], [3, 4]]


def test_stream_of_volumes(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    days = volumes.volumes(stream, F.col("user_id") + 1, F.round(F.col("value") * 100).cast("long"))
    q = days.writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    want = events.groupBy(F.to_date("ts"), "user_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))
    got = spark.table("days")
    assert got.count() == want.count() and got.agg(F.sum("value")).first()[0] == want.agg(F.sum("v")).first()[0]
    rows = stream.select((F.col("user_id") + 1).alias("vox"), F.col("value").alias("value"))
    q = volumes.running_scores(rows).writeStream.outputMode("update").format("memory").queryName("scores").start()
    q.processAllAvailable()
    q.stop()
    last = {r.vox: r for r in spark.table("scores").collect()}
    means = {r.vox: r.m for r in events.groupBy((F.col("user_id") + 1).alias("vox")).agg(F.avg("value").alias("m")).collect()}
    assert all(abs(last[v].mean - m) < 1e-9 for v, m in means.items())


def test_afni_dataset(spark, tmp_path):
    from voxelarium.sources import afni

    x = np.random.default_rng(2).integers(-500, 500, (4, 5, 6, 2)).astype("<i2")
    attributes = [("integer", "DATASET_DIMENSIONS", [4, 5, 6]), ("integer", "DATASET_RANK", [3, 2]), ("integer", "ORIENT_SPECIFIC", [0, 3, 4]), ("float", "ORIGIN", [0, 0, 0]), ("float", "DELTA", [1, 1, 1]), ("integer", "BRICK_TYPES", [1, 1]), ("float", "BRICK_FLOAT_FACS", [0, 0.5])]
    (tmp_path / "d.HEAD").write_text("\n\n".join(f"type = {k}-attribute\nname = {n}\ncount = {len(v)}\n {' '.join(map(str, v))}" for k, n, v in attributes))
    (tmp_path / "d.BRIK").write_bytes(x.tobytes(order="F"))
    got = afni.read_afni(spark, str(tmp_path / "d.HEAD")).to_numpy()
    assert np.array_equal(got[..., 0], x[..., 0]) and np.array_equal(got[..., 1], x[..., 1] * 0.5)
    assert afni.format_of("a.nii.gz") == "NIFTI_GZ" and afni.format_of("a.BRIK") == "AFNI" and afni.stem_of("x/a.hdr") == "x/a"
    with pytest.raises(ValueError):
        afni.format_of("a.txt")


def test_five_dimensions(spark, tmp_path):
    x = np.arange(2 * 2 * 2 * 3 * 2, dtype=float).reshape(2, 2, 2, 3, 2)
    image = from_numpy(spark, x.reshape(2, 2, 2, 6, order="F"), Space((2, 2, 2, 3, 2)))
    path = str(tmp_path / "h.nii")
    nifti.write_image(image, path)
    for r in nifti.read_hyper(spark, path).collect():
        i, j, k = np.unravel_index(r.vox - 1, (2, 2, 2), order="F")
        assert r.value == x[i, j, k, r.trial - 1, r.feature - 1]
