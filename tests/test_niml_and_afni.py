"""Elements found by byte ranges, and bricks with types and factors of their own."""

import numpy as np
import pytest

from voxelarium.image import Image, from_numpy
from voxelarium.sources import afni, niml
from voxelarium.space import Space


def cells(spark, path, **options):
    return {(r.element, r.row, r.col): r.value for r in niml.read_tables(spark, path, **options).collect()}


def frame(spark, table):
    rows = [(r + 1, c + 1, float(v)) for r, row in enumerate(table) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "row long, col int, value double")


@pytest.mark.parametrize("range_bytes", [1, 7, 50, 1 << 20])
def test_elements_of_every_kind(spark, tmp_path, range_bytes):
    """Text and binary, both byte orders, mixed types, groups, strings, empty elements, and binary that looks like tags."""
    mixed = np.array([(1, 2.5, -3.25), (7, 0.5, 1e10)], [("a", "<i4"), ("b", "<f4"), ("c", "<f8")])
    tricky = np.frombuffer(b'</T><T ni_type="int" ni_dimen="3">', np.uint8)
    data = b"".join([
        b'<GROUP ni_form="ni_group">\n',
        b'<INDEX_LIST ni_type="int" ni_dimen="3">\n 10\n20  30 </INDEX_LIST>\n',
        b"<SPARSE_DATA ni_type='int,float,double' ni_dimen='2' ni_form='binary.lsbfirst'>", mixed.tobytes(), b"</SPARSE_DATA>",
        b'<T ni_type="byte" ni_dimen="%d" ni_form="binary.msbfirst">' % len(tricky), tricky.tobytes(), b"</T>",
        b'<NAMES ni_type="String" ni_dimen="1"> "a < b" </NAMES>', b'<EMPTY x="1"/>',
        b'<W ni_type="2*short" ni_dimen="2" ni_form="binary.msbfirst">', np.array([[1, -2], [300, 4]], ">i2").tobytes(), b"</W>",
        b'<LAST ni_type="2*float" ni_dimen="2">1.5 -2\n3e2 4.25\n</LAST>\n</GROUP>\n',
    ])
    path = tmp_path / "e.niml"
    path.write_bytes(data)
    found = niml.elements(spark, str(path), max(range_bytes, 20))
    assert [e.name for e in found] == ["GROUP", "INDEX_LIST", "SPARSE_DATA", "T", "NAMES", "EMPTY", "W", "LAST"]
    assert found[0].attributes == {"ni_form": "ni_group"} and found[5].attributes == {"x": "1"} and not found[4].kinds
    tables = {2: [[10], [20], [30]], 3: [[1, 2.5, -3.25], [7, 0.5, 1e10]], 4: tricky[:, None].tolist(), 7: [[1, -2], [300, 4]], 8: [[1.5, -2], [300, 4.25]]}
    want = {(e, r, c): float(v) for e, t in tables.items() for r, row in enumerate(t, 1) for c, v in enumerate(row, 1)}
    got = {(r.element, r.row, r.col): r.value for r in niml.read_tables(spark, str(path), found, range_bytes).collect()}
    assert got == want


@pytest.mark.parametrize("binary", [False, True])
def test_round_trip(spark, tmp_path, binary):
    rng = np.random.default_rng(0)
    nodes, values = rng.integers(0, 10**6, (500, 1)), rng.normal(size=(500, 3)).astype("f4").astype(float)
    path = str(tmp_path / "r.niml")
    niml.write_tables(path, [("INDEX_LIST", frame(spark, nodes), 500, "int", 1), ("SPARSE_DATA", frame(spark, values).where("value > -1"), 500, "float", 3)], binary, domain="x y")
    assert [p.name for p in tmp_path.iterdir()] == ["r.niml"]
    assert niml.elements(spark, path)[1].attributes["domain"] == "x y"
    want = {(1, r + 1, 1): float(v[0]) for r, v in enumerate(nodes)} | {(2, r + 1, c + 1): v if v > -1 else 0.0 for r, row in enumerate(values.tolist()) for c, v in enumerate(row)}
    assert cells(spark, path, range_bytes=777) == want


def test_wrong_lengths(spark, tmp_path):
    path = tmp_path / "w.niml"
    path.write_bytes(b'<A ni_type="int" ni_dimen="4">1 2 3</A>')
    with pytest.raises(ValueError, match="3 numbers"):
        niml.read_tables(spark, str(path))
    path.write_bytes(b'<A ni_type="int" ni_dimen="4" ni_form="binary.lsbfirst">123456')
    with pytest.raises(ValueError, match="ends early"):
        niml.read_tables(spark, str(path))
    path.write_bytes(b"")
    assert niml.read_tables(spark, str(path)).collect() == []


def test_bricks(spark, tmp_path):
    """Types and factors by volume, sparse rows, values cut to their range, and the grid."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 100, (4, 5, 3, 5))
    x[..., 2] *= 1000
    trans = [[-2, 0, 0, 30], [0, 3, 0, -20], [0, 0, 2.5, -10], [0, 0, 0, 1]]
    image = from_numpy(spark, np.where(np.abs(x) < 20, 0, x), Space(x.shape, trans=trans)).sparse()
    head = str(tmp_path / "b+orig.HEAD")
    afni.write_afni(image, head, ["f8", "i2", "i2", "u1", "f4"], [0, 0.5, 0, 2, 0])
    back = afni.read_afni(spark, head)
    y, got = np.where(np.abs(x) < 20, 0, x), back.to_numpy()
    assert np.allclose(back.space.trans, trans) and sorted(p.name for p in tmp_path.iterdir()) == ["b+orig.BRIK", "b+orig.HEAD"]
    assert np.array_equal(got[..., 0], y[..., 0]) and np.allclose(got[..., 4], y[..., 4].astype("f4"))
    assert np.array_equal(got[..., 1], np.rint(y[..., 1] / 0.5) * 0.5)
    assert np.array_equal(got[..., 2], np.clip(np.rint(y[..., 2]), -32768, 32767))
    assert np.array_equal(got[..., 3], np.clip(np.rint(y[..., 3] / 2), 0, 255) * 2)
    one = Image(Space((4, 5, 3)), image.data.where("t = 1").select("vox", "value"))
    afni.write_afni(one, head)
    assert np.allclose(afni.read_afni(spark, head).to_numpy(), y[..., 0].astype("f4"))
    with pytest.raises(ValueError, match="types"):
        afni.write_afni(image, head, ["f4"])
