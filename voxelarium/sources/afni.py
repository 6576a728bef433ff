"""AFNI datasets: a text ``.HEAD`` and a ``.BRIK`` of volumes, each with a type and a factor of its own."""

from __future__ import annotations

import gzip
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..image import Image
from . import headers
from .nifti import append_files, open_file, place_of, write_values

#: Data types by AFNI's code (fixed values).
BRICK_TYPES = {0: "u1", 1: "i2", 2: "i4", 3: "f4", 4: "f8"}

#: Endings of header and data files by format (fixed values).
FORMATS = {
    "NIFTI": (r"\.nii$", r"\.nii$"),
    "NIFTI_GZ": (r"\.nii\.gz$", r"\.nii\.gz$"),
    "NIFTI_PAIR": (r"\.hdr$", r"\.img$"),
    "NIFTI_PAIR_GZ": (r"\.hdr\.gz$", r"\.img\.gz$"),
    "AFNI": (r"\.HEAD$", r"\.BRIK$"),
    "AFNI_GZ": (r"\.HEAD$", r"\.BRIK\.gz$"),
}


def format_of(name: str) -> str:
    """The first format whose header or data ending the name has."""
    for kind, endings in FORMATS.items():
        if any(re.search(e, name) for e in endings):
            return kind
    raise ValueError(f"no image format has names like {name}")


def stem_of(name: str) -> str:
    kind = format_of(name)
    return next(re.sub(e, "", name) for e in FORMATS[kind] if re.search(e, name))


def read_afni(spark: SparkSession, head_path: str) -> Image:
    """The image of a dataset, named by its header; volumes are read by as many tasks."""
    with open_file(head_path) as file:
        attributes = headers.parse_afni_head(file.read().decode("latin-1"))
    space, stem = headers.afni_space(attributes), stem_of(head_path)
    times = attributes["DATASET_RANK"]["content"][1]
    kinds = [BRICK_TYPES[k] for k in attributes["BRICK_TYPES"]["content"][:times]]
    facs = [*attributes.get("BRICK_FLOAT_FACS", {"content": []})["content"], *[0.0] * times][:times]
    order = ">" if attributes.get("BYTEORDER_STRING", {"content": "LSB"})["content"].startswith("MSB") else "<"
    n = space.n_vox
    starts = np.concatenate([[0], np.cumsum([n * int(k[1:]) for k in kinds])]).tolist()

    def run(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                kind, fac = kinds[t - 1], facs[t - 1]
                try:
                    file = open_file(f"{stem}.BRIK")
                except FileNotFoundError:
                    file = gzip.GzipFile(fileobj=open_file(f"{stem}.BRIK.gz"))
                with file:
                    file.seek(starts[t - 1])
                    raw = file.read(n * int(kind[1:]))
                if len(raw) < n * int(kind[1:]):
                    raise ValueError(f"{stem}.BRIK ends early")
                values = np.frombuffer(raw, np.dtype(kind).newbyteorder(order)).astype(float) * (fac or 1.0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, n + 1)), pa.array(np.full(n, t, np.int32)), pa.array(values)], ["vox", "t", "value"])

    rows = spark.range(1, times + 1, 1, times).mapInArrow(run, "vox long, t int, value double")
    return Image(space, rows if times > 1 else rows.select("vox", "value"))


def write_afni(image: Image, head_path: str, kinds: list[str] | None = None, factors: list[float] | None = None) -> None:
    """Writes a dataset: ``.HEAD`` and ``.BRIK``. Each volume has a type (``f4`` if none) and a factor (0: none) of its own.

    Volumes of one type that follow each other are written together, by many tasks; integers are rounded and cut to their range.
    """
    times = int(image.space.dims[3]) if image.is_series else 1
    kinds, factors = kinds or ["f4"] * times, [float(f) for f in factors or [0.0] * times]
    if len(kinds) != times or len(factors) != times:
        raise ValueError(f"{len(kinds)} types and {len(factors)} factors for {times} volumes")
    codes = {name: code for code, name in BRICK_TYPES.items()}
    n, stem, trans = image.space.n_vox, stem_of(head_path), image.space.trans
    spans = [0, *[t for t in range(1, times) if kinds[t] != kinds[t - 1]], times]
    t = F.col("t").cast("int") if image.is_series else F.lit(1)
    scale = F.array(*[F.lit(f or 1.0) for f in factors])
    rows = image.data.select(t.alias("t"), "vox", (F.col("value").cast("double") / scale[t - 1]).alias("value"))
    parts = []
    for a, b in zip(spans, spans[1:]):
        some = rows.where(F.col("t").between(a + 1, b)).select(((F.col("t") - 1 - a).cast("long") * n + F.col("vox") - 1).alias("at"), "value")
        parts.append(f"{stem}.BRIK.{a}")
        write_values(some, (b - a) * n, parts[-1], dtype=kinds[a])
    append_files(parts, f"{stem}.BRIK")
    # the codes of the axes are even where they run against the world's, whose first two run to the left and the back
    axes = [int(np.abs(trans[:3, axis]).argmax()) for axis in range(3)]
    turned = [trans[w, 3] * (-1 if w < 2 else 1) for w in axes]
    steps = [trans[w, axis] * (-1 if w < 2 else 1) for axis, w in enumerate(axes)]
    orient = [2 * w + (0 if step > 0 else 1) for w, step in zip(axes, steps)]
    attributes = [
        ("string", "TYPESTRING", "3DIM_HEAD_ANAT"), ("string", "BYTEORDER_STRING", "LSB_FIRST"), ("integer", "DATASET_RANK", [3, times, 0, 0, 0, 0, 0, 0]), ("integer", "DATASET_DIMENSIONS", [*image.space.space_dims, 0, 0]),
        ("integer", "ORIENT_SPECIFIC", orient), ("float", "ORIGIN", turned), ("float", "DELTA", steps), ("integer", "BRICK_TYPES", [codes[k] for k in kinds]), ("float", "BRICK_FLOAT_FACS", factors),
    ]
    text = []
    for kind, name, content in attributes:
        body = f"'{content}~" if kind == "string" else " " + " ".join(map(repr, map(float if kind == "float" else int, content)))
        text.append(f"\ntype  = {kind}-attribute\nname  = {name}\ncount = {len(content) + (kind == 'string')}\n{body}\n")
    files, local = place_of(head_path)
    with files.open_output_stream(local, compression=None) as out:
        out.write("".join(text).encode())
