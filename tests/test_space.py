import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelarium.functions import affine as A
from voxelarium.image import from_numpy
from voxelarium.space import Space, signif


def test_construction_and_coordinates(spark):
    s = Space((4, 4, 4), spacing=(2, 2, 2), origin=(-3, -3, -3))
    row = spark.createDataFrame([(1, 2, 3)], "i int, j int, k int").select(*s.to_coord(F.col("i"), F.col("j"), F.col("k"))).first()
    assert tuple(row) == (-3.0, -1.0, 1.0)
    row = spark.createDataFrame([(3.0, 5.0, 7.0)], "x double, y double, z double").select(*s.from_coord(F.col("x"), F.col("y"), F.col("z"))).first()
    assert tuple(row) == (4.0, 5.0, 6.0)
    assert s.bounds().tolist() == [[-3, 3]] * 3


def test_singular_affine_is_an_error():
    with pytest.raises(ValueError):
        Space((2, 2, 2), trans=np.zeros((4, 4)))


def test_significant_digits():
    assert signif(123456.789, 6) == 123457
    assert signif(0.0, 6) == 0


def test_index_and_grid_agree_with_numpy(spark):
    s = Space((3, 4, 5))
    rows = spark.range(1, 61).select("id", *[c.alias(n) for c, n in zip(s.to_grid(F.col("id")), "ijk")]).collect()
    for r in rows:
        i, j, k = np.unravel_index(r.id - 1, (3, 4, 5), order="F")
        assert (r.i, r.j, r.k) == (i + 1, j + 1, k + 1)


@pytest.mark.parametrize("codes", [c for c in A.anatomy_catalogue()][::5])
def test_orientations_round_trip(codes):
    turn = A.axcodes_to_orientation(codes)
    trans = np.zeros((4, 4))
    trans[3, 3] = 1
    for n, (world, d) in enumerate(turn):
        trans[int(world), n] = d * (n + 1)
    assert A.affine_to_axcodes(trans) == codes
    assert A.voxel_sizes(trans).tolist() == [1, 2, 3]


def test_catalogues_are_whole():
    assert len(set(A.anatomy_catalogue())) == 48
    assert len(set(A.plane_catalogue())) == 24


def test_quaternions_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(20):
        u, _, vt = np.linalg.svd(rng.normal(size=(3, 3)))
        m = A.from_matvec(u @ vt @ np.diag([1.0, 2, 3]), [4, 5, 6])
        q, sign = A.quaternion_of(m)
        assert np.allclose(A.affine_of(q, m[:3, 3], A.voxel_sizes(m), sign), m, atol=1e-6)


def test_rescaling_keeps_the_middle():
    a = A.from_matvec(np.diag([2.0, 2, 2]), [1, 2, 3])
    b = A.rescale_affine(a, (9, 9, 9), (1, 1, 1), (17, 17, 17))
    assert np.allclose(A.apply_affine(a, [4, 4, 4]), A.apply_affine(b, [8, 8, 8]))


def test_dense_and_numpy(spark):
    x = np.arange(24.0).reshape(2, 3, 4)
    image = from_numpy(spark, x)
    assert np.array_equal(image.to_numpy(), x)
    assert image.sparse().data.count() == 23
    assert image.sparse().dense().data.count() == 24
    assert np.array_equal(from_numpy(spark, np.stack([x, 2 * x], -1)).to_numpy()[..., 1], 2 * x)
