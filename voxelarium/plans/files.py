"""Queries that write images to the shared folder and read them, or parts of them, back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import runtime
from ..image import Image
from ..operators import sets
from ..sources import afni, headers, nifti, niml
from ..space import Space
from . import tables as T
from .registry import MASK, mask_of, out, query

#: All voxels of all times of the series of line items, as SQL.
_DENSE = "dense AS (SELECT a.vox, CAST(b.t AS INT) AS t, CAST(coalesce(v, 0) AS DOUBLE) AS v FROM (SELECT UNNEST(range(1, 1793)) AS vox) a CROSS JOIN (SELECT UNNEST(range(1, 8)) AS t) b LEFT JOIN vec_li ON vec_li.vox = a.vox AND vec_li.t = b.t)"


def _written(image: Image, suffix: str = ".nii", **options) -> str:
    path = f"{runtime.shared_dir(image.data.sparkSession)}/image-{uuid.uuid4().hex}{suffix}"
    nifti.write_image(image, path, **options)
    return path


@query(f"WITH {_DENSE} SELECT vox, t, v FROM dense")
def nifti_series(spark, sf_dir):
    return out(nifti.read_image(spark, _written(T.vec_li(spark, sf_dir)), volumes=2))


@query(f"WITH {_DENSE} SELECT vox, t, v FROM dense")
def nifti_integers(spark, sf_dir):
    """Written as 32-bit integers, in a version 2 file under gzip."""
    return out(nifti.read_image(spark, _written(T.vec_li(spark, sf_dir), ".nii.gz", dtype="i4", version=2)))


@query(f"WITH {_DENSE} SELECT vox, v FROM dense WHERE t = 3")
def nifti_volume(spark, sf_dir):
    return out(nifti.read_volume(spark, _written(T.vec_li(spark, sf_dir)), 3))


@query(f"WITH {_DENSE} SELECT vox, CAST(p.new AS INT) AS t, v FROM dense JOIN (VALUES (6, 1), (2, 2), (6, 3)) p(old, new) ON dense.t = p.old")
def nifti_times(spark, sf_dir):
    return out(nifti.read_image(spark, _written(T.vec_li(spark, sf_dir)), times=[6, 2, 6]))


@query(f"WITH {_DENSE}, {MASK} SELECT dense.vox, dense.t, dense.v FROM dense JOIN mask ON mask.vox = dense.vox")
def nifti_masked(spark, sf_dir):
    return out(nifti.read_image(spark, _written(T.vec_li(spark, sf_dir)), mask=mask_of(spark, sf_dir)))


@query(f"WITH {_DENSE} SELECT vox, t, v FROM dense WHERE vox % 5 = 2 OR vox BETWEEN 700 AND 719")
def nifti_scattered(spark, sf_dir):
    """Read by the runs of a scattered mask."""
    li = T.vec_li(spark, sf_dir)
    mask = Image(T.QTY, li.data.select("vox").union(spark.range(1, T.QTY.n_vox + 1)).distinct().where("vox % 5 = 2 OR vox BETWEEN 700 AND 719"))
    return out(nifti.read_image(spark, _written(li), mask=mask))


@query(f"WITH {_DENSE} SELECT vox, t, v FROM dense WHERE t = 3 AND vox > 500 UNION ALL SELECT vox, t, v FROM dense WHERE t IN (5, 6) AND v > 0")
def nifti_where(spark, sf_dir):
    """Conditions written on one frame pick what is read."""
    frame = nifti.read_image(spark, _written(T.vec_li(spark, sf_dir)))
    return out(frame.with_data(frame.data.where("t = 3 AND vox > 500").union(frame.data.where("t IN (5, 6) AND value > 0"))))


@query(f"WITH {_DENSE} SELECT 'plain' AS kind, vox, t, v FROM dense UNION ALL SELECT 'gzip', vox, t, v FROM dense")
def nifti_many_writers(spark, sf_dir):
    """Files that many tasks write, plain and of gzip members."""
    li = T.vec_li(spark, sf_dir)
    both = [out(nifti.read_image(spark, _written(li, suffix, part_values=500))).withColumn("kind", F.lit(kind)) for kind, suffix in (("plain", ".nii"), ("gzip", ".nii.gz"))]
    return both[0].union(both[1]).select("kind", "vox", "t", "v")


@query(f"WITH {_DENSE} SELECT vox, 1 AS t, v FROM dense WHERE t = 1 UNION ALL SELECT vox, t + 1, v FROM dense")
def nifti_many(spark, sf_dir):
    """Two files, one after the other in time."""
    li = T.vec_li(spark, sf_dir)
    return out(nifti.read_volumes(spark, [_written(sets.volume_at(li, 1)), _written(li)]))


@query(f"WITH {_DENSE} SELECT vox, t, v FROM dense")
def nifti_any_store(spark, sf_dir):
    """By Spark's own reader of files."""
    rows = nifti.read_images(spark, _written(T.vec_li(spark, sf_dir)))
    return rows.select("vox", "t", F.col("value").alias("v"))


@query(f"WITH {_DENSE} SELECT 1 AS feature, t AS trial, vox, v FROM dense UNION ALL SELECT 2, t, vox, 2 * v FROM dense")
def nifti_hyper(spark, sf_dir):
    """A file of five dimensions: trials and features."""
    li = T.vec_li(spark, sf_dir)
    both = sets.concat(li, li.map(lambda v: v * 2))
    path = _written(Image(Space((*T.LI.dims, 2)), both.data))
    return nifti.read_hyper(spark, path).select("feature", F.col("trial").cast("int").alias("trial"), "vox", F.col("value").alias("v"))


@query("""SELECT * FROM (VALUES ('dim1', '16'), ('dim2', '16'), ('dim3', '7'), ('dim4', '7'), ('dtype', 'i2'), ('slope', '1.0'), ('inter', '0.0'), ('spacing', '2.0 3.0 2.5'),
  ('origin', '30.0 -20.0 -10.0'), ('tr', '1.5'), ('version', '1'), ('comment', 'made of line items'), ('labels', 'a b c d e f g')) h(field, value)""")
def nifti_header(spark, sf_dir):
    """Fields, extensions and labels of a header that was written with an image."""
    image = Image(Space(T.LI.dims, trans=T.WORLD.trans), T.vec_li(spark, sf_dir).data, tuple("abcdefg"))
    h = nifti.read_header(_written(image, dtype="i2", tr=1.5, extensions=[headers.comment("made of line items")]))
    shown = lambda values: " ".join(str(float(v)) for v in values)
    fields = {f"dim{n}": str(d) for n, d in enumerate(h.dims, 1)} | {
        "dtype": h.dtype, "slope": str(h.scale[0]), "inter": str(h.scale[1]), "spacing": shown(h.space.spacing), "origin": shown(h.space.origin), "tr": str(h.pixdim[4]), "version": str(h.version),
        "comment": headers.extensions_of(h, "comment")[0].rstrip(b"\0").decode(), "labels": " ".join(headers.volume_labels(h, 7)),
    }
    return spark.createDataFrame(list(fields.items()), "field string, value string")


def _orders(spark, sf_dir):
    """``(row, col, value)``: the mask's voxels, and their quantity and half of it."""
    rows = runtime.numbered(mask_of(spark, sf_dir).data.select("vox", "value"), "row", "vox")
    rows = runtime.materialize(rows, "rows")
    pair = lambda col, value: rows.select("row", F.lit(col).alias("col"), value.cast("double").alias("value"))
    return pair(1, F.col("vox")), pair(1, F.col("value")).union(pair(2, F.col("value") / 2)), rows.count()


_NIML = f"""WITH {MASK}, r AS (SELECT row_number() OVER (ORDER BY vox) AS row, vox, v FROM mask),
  listed AS (SELECT 1 AS element, row, 1 AS col, CAST(vox AS DOUBLE) AS v FROM r UNION ALL SELECT 2, row, 1, CAST(v AS DOUBLE) FROM r UNION ALL SELECT 2, row, 2, v / 2.0::DOUBLE FROM r)"""


def _niml(spark, sf_dir, binary: bool):
    nodes, values, n = _orders(spark, sf_dir)
    path = f"{runtime.shared_dir(spark)}/table-{uuid.uuid4().hex}.niml.dset"
    niml.write_tables(path, [("INDEX_LIST", nodes, n, "int", 1), ("SPARSE_DATA", values, n, "float", 2)], binary)
    return niml.read_tables(spark, path, range_bytes=1500).withColumnRenamed("value", "v")


@query(f"{_NIML} SELECT CAST(element AS INT) AS element, row, CAST(col AS INT) AS col, v FROM listed")
def niml_table(spark, sf_dir):
    """Tables of a file of text elements, found and read by byte ranges."""
    return _niml(spark, sf_dir, False)


@query(f"{_NIML} SELECT CAST(element AS INT) AS element, row, CAST(col AS INT) AS col, v FROM listed")
def niml_binary(spark, sf_dir):
    return _niml(spark, sf_dir, True)


@query(f"WITH {_DENSE} SELECT vox, t, CASE WHEN t IN (2, 3) THEN round_even(v / 4, 0) * 4 ELSE v END AS v FROM dense")
def afni_bricks(spark, sf_dir):
    """Volumes of types and factors of their own: floats, shorts in steps of 4, and longer integers."""
    path = f"{runtime.shared_dir(spark)}/set-{uuid.uuid4().hex}+orig.HEAD"
    afni.write_afni(T.vec_li(spark, sf_dir), path, ["f4", "i2", "i2", "f8", "i4", "i4", "f4"], [0, 4, 4, 0, 0, 1, 0.5])
    return out(afni.read_afni(spark, path))
