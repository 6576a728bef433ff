"""NIfTI files as tables, and tables as NIfTI files.

``spark.read.format("nifti")`` splits plain files by volumes, so a long series is read by many tasks; a gzip stream
can't be split and is one task. Of each volume it reads the runs of voxels that a mask or a condition leaves, a run (or several
that lie close) at a time. ``write_image`` writes a file by many tasks. ``read_images`` goes through Spark's own file reader instead and so reaches any
store that Spark does.
"""

from __future__ import annotations

import base64
import gzip
import json
import math
import os
import uuid
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..image import Image
from ..space import Space
from . import headers

SCHEMA = "path string, t int, vox long, value double"
#: Bytes of the beginning of a file that hold the header and its extensions.
_HEAD = 1 << 20


def place_of(path: str):
    """``(filesystem, path in it)`` of a path or URI, of any store that Arrow reaches."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def open_file(path: str):
    """A binary file by path or URI."""
    files, local = place_of(path)
    return files.open_input_file(local)


def read_header(path: str) -> headers.Header:
    with open_file(path) as file:
        data = file.read(2)
        file.seek(0)
        if data == b"\x1f\x8b":
            return headers.parse(gzip.GzipFile(fileobj=file).read(_HEAD))
        return headers.parse(file.read(_HEAD))


def decode(raw: bytes, h: headers.Header) -> np.ndarray:
    """Scaled values of a run of voxels."""
    slope, inter = h.scale
    values = np.frombuffer(raw, np.dtype(h.dtype).newbyteorder(h.endian)).astype(np.float64)
    return values if (slope, inter) == (1.0, 0.0) else values * slope + inter


def _batch(path: str, h: headers.Header, t: int, first: int, raw: bytes, n: int) -> pa.RecordBatch:
    """The rows of ``n`` voxels from ``first`` (from 0) of volume ``t`` (from 0)."""
    if len(raw) < n * h.item_size:
        raise ValueError(f"{path} ends early")
    vox = np.arange(first + 1, first + n + 1, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.array(np.full(n, t + 1, np.int32)), pa.array(vox), pa.array(decode(raw, h))], ["path", "t", "vox", "value"])


def is_gzip(path: str) -> bool:
    """By the first bytes of a file, whatever its name."""
    with open_file(path) as file:
        return file.read(2) == b"\x1f\x8b"


#: Voxels between two runs of a mask that are read rather than skipped, and runs that a reader carries at most.
GAP, MOST_RUNS = 1024, 1 << 16


def merged(runs: np.ndarray, gap: int, most: int | None = None) -> np.ndarray:
    """Rising runs ``(first, last)`` with those at most ``gap`` apart made one; beyond ``most`` the nearest are made one too."""
    if len(runs) < 2:
        return runs
    between = runs[1:, 0] - runs[:-1, 1] - 1
    apart = between > gap
    if most is not None and apart.sum() >= most:
        widest = np.argsort(-between, kind="stable")[: most - 1]
        apart &= np.isin(np.arange(len(between)), widest)
    return np.stack([runs[np.append(True, apart), 0], runs[np.append(apart, True), 1]], axis=1)


def mask_runs(mask: Image) -> np.ndarray:
    """The runs of consecutive voxels of a mask, rising; each range of voxels finds its own, and the driver joins their ends."""
    sorted_ = mask.data.select(F.col("vox").cast("long").alias("vox")).where("vox is not null").distinct().repartitionByRange("vox").sortWithinPartitions("vox")

    def run(batches):
        last = None  # the run that is still open
        for b in batches:
            v = np.asarray(b.column(0))
            if not len(v):
                continue
            cut = np.flatnonzero(np.diff(v) != 1)
            first, end = v[np.append(0, cut + 1)], v[np.append(cut, len(v) - 1)]
            if last is not None:
                if last[1] + 1 == first[0]:
                    first[0] = last[0]
                else:
                    first, end = np.append(last[0], first), np.append(last[1], end)
            last = first[-1], end[-1]
            if len(first) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(first[:-1]), pa.array(end[:-1])], ["first", "last"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(last[0])]), pa.array([int(last[1])])], ["first", "last"])

    found = sorted_.mapInArrow(run, "first long, last long").toPandas().to_numpy(np.int64).reshape(-1, 2)
    return merged(found[np.argsort(found[:, 0])], 0)


def _pack_runs(runs: np.ndarray) -> str:
    return base64.b64encode(zlib.compress(np.diff(runs.ravel(), prepend=0).astype("<i8").tobytes())).decode()


def _unpack_runs(packed: str) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(base64.b64decode(packed)), "<i8")).reshape(-1, 2)


class _Part(InputPartition):
    """Volumes of a file, from 0, and the number that the rows of the file's first volume get."""

    def __init__(self, path: str, times: list[int], base: int = 1, packed: bool = False):
        self.path, self.times, self.base, self.packed = path, times, base, packed


class NiftiReader(DataSourceReader):
    """``times`` (from 1), ``voxels`` (first and last, from 1) and ``runs`` (pairs of these, rising) say which bytes of a file are read at all.

    Runs at most ``gap`` voxels apart are read at once, and only the voxels of runs become rows. ``stacked`` counts the
    volumes of all files in one row of numbers.
    """

    def __init__(self, paths: list[str], volumes: int, times: list[int] | None = None, voxels: tuple[int, int] | None = None, runs: np.ndarray | None = None, gap: int = GAP, stacked: bool = False):
        self.paths, self.volumes, self.gap, self.stacked = paths, volumes, gap, stacked
        self.times = None if times is None else sorted(set(times))
        self.runs = runs if voxels is None else _within_runs(runs, np.array([voxels]))

    def partitions(self):
        with ThreadPoolExecutor(16) as pool:
            found = list(pool.map(lambda path: (math.prod(read_header(path).dims[3:]), is_gzip(path)), self.paths))
        out, base = [], 1
        for path, (there, packed) in zip(self.paths, found):
            asked = range(base, base + there) if self.times is None else [t for t in self.times if base <= t < base + there]
            asked = [t - base for t in asked]
            step = max(1, len(asked)) if packed else self.volumes
            out += [_Part(path, asked[k : k + step], base, packed) for k in range(0, len(asked), step)]
            base += there if self.stacked else 0
        return out or [_Part("", [])]

    def read(self, part):
        if not part.times:
            return
        with open_file(part.path) as file:
            h = read_header(part.path)
            stream = gzip.GzipFile(fileobj=file) if part.packed else file
            whole, item = math.prod(h.dims[:3]), h.item_size
            runs = np.array([[1, whole]]) if self.runs is None else np.clip(self.runs[(self.runs[:, 1] >= 1) & (self.runs[:, 0] <= whole)], 1, whole)
            for t in part.times:
                for first, last in merged(runs, self.gap).tolist():
                    start, n = first - 1, last - first + 1
                    stream.seek(int(h.vox_offset) + (t * whole + start) * item)
                    batch = _batch(part.path, h, t + part.base - 1, start, stream.read(n * item), n)
                    inside = voxels_of(_within_runs(runs, np.array([[first, last]])))
                    yield batch if len(inside) == n else batch.take(pa.array(inside - first))


def voxels_of(runs: np.ndarray) -> np.ndarray:
    sizes = runs[:, 1] - runs[:, 0] + 1
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(runs[:, 0], sizes)


def _within_runs(runs: np.ndarray | None, others: np.ndarray) -> np.ndarray:
    """What two rising lists of runs have in common."""
    if runs is None:
        return others
    if not len(runs) or not len(others):
        return np.zeros((0, 2), np.int64)
    low = np.searchsorted(others[:, 1], runs[:, 0], "left")
    many = np.maximum(0, np.searchsorted(others[:, 0], runs[:, 1], "right") - low)
    a = np.repeat(np.arange(len(runs)), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    return np.stack([np.maximum(runs[a, 0], others[b, 0]), np.minimum(runs[a, 1], others[b, 1])], axis=1)


class NiftiDataSource(DataSource):
    """``path``: one or more files, separated by commas, or ``paths`` as a JSON list. ``volumes``: volumes in a task. ``times``:
    volumes to read, separated by commas. ``voxels``: the first and the last voxel to read, with a comma between. ``runs``: packed runs
    of voxels. ``gap``: voxels that are read over. ``stacked``: volumes are numbered over all files.

    Conditions on the frame aren't pushed to this reader: a frame that two plans use gets one plan's conditions in the other
    (Spark 4.1.2 keeps what was pushed with the loaded frame). ``scan`` gives frames whose conditions prune.
    """

    @classmethod
    def name(cls):
        return "nifti"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        whole = lambda name: [int(x) for x in self.options[name].split(",")] if self.options.get(name) else None
        paths = json.loads(self.options["paths"]) if self.options.get("paths") else self.options["path"].split(",")
        runs = _unpack_runs(self.options["runs"]) if self.options.get("runs") else None
        stacked = self.options.get("stacked", "").lower() == "true"
        return NiftiReader(paths, int(self.options.get("volumes", "8")), whole("times"), whole("voxels"), runs, int(self.options.get("gap", GAP)), stacked)


#: Voxels of a row of ``scan``'s parts, and values that a task of it reads.
BLOCK, TASK_VALUES = 1 << 16, 1 << 21


def _blocks(runs: np.ndarray | None, whole: int, gap: int, block: int) -> np.ndarray:
    """What is read of a volume, in stretches of at most ``block`` voxels."""
    spans = merged(np.array([[1, whole]]) if runs is None else _within_runs(runs, np.array([[1, whole]])), gap)
    many = -(-(spans[:, 1] - spans[:, 0] + 1) // block)
    first = np.repeat(spans[:, 0], many) + block * voxels_of(np.stack([np.zeros_like(many), many - 1], axis=1))
    return np.stack([first, np.minimum(first + block - 1, np.repeat(spans[:, 1], many))], axis=1)


def scan(spark: SparkSession, paths: list[str], runs: np.ndarray | None = None, gap: int = GAP, block: int = BLOCK) -> DataFrame:
    """``(path, t, vox, value)`` of plain files, whose volumes are numbered over all files.

    A row of the parts is a stretch of voxels of a volume, and its bytes are read by an expression over it. So conditions
    on ``path`` and ``t``, wherever they stand in a plan, pick the parts before a byte of them is read, and of each volume
    only the ``runs`` are.
    """
    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(read_header, paths))
    files, base, total = [], 1, 0
    for path, h in zip(paths, found):
        times, blocks = math.prod(h.dims[3:]), len(_blocks(runs, math.prod(h.dims[:3]), gap, block))
        files.append((path, base, times, blocks))
        base, total = base + times, total + times * blocks
    spark_files = spark.createDataFrame(files, "path string, base int, times int, blocks int").where("blocks > 0")
    each = spark_files.select("path", "base", "blocks", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("at"))
    parts = each.select("path", (F.col("base") + F.col("at")).alias("t"), "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("nth"))
    parts = parts.repartition(max(1, min(total, -(-total * block // TASK_VALUES))))

    @F.arrow_udf("array<struct<vox:long,value:double>>")
    def voxels(path: pa.Array, at: pa.Array, nth: pa.Array) -> pa.Array:
        vox, values, sizes, last = [], [], [0], None
        for name, t, k in zip(path.to_pylist(), at.to_pylist(), nth.to_pylist()):
            if name != last:
                h, last = read_header(name), name
                whole = math.prod(h.dims[:3])
                blocks = _blocks(runs, whole, gap, block)
            first, end = blocks[k].tolist()
            with open_file(name) as file:
                file.seek(int(h.vox_offset) + (t * whole + first - 1) * h.item_size)
                raw = file.read((end - first + 1) * h.item_size)
            if len(raw) < (end - first + 1) * h.item_size:
                raise ValueError(f"{name} ends early")
            inside = np.arange(first, end + 1) if runs is None else voxels_of(_within_runs(runs, np.array([[first, end]])))
            vox.append(inside)
            values.append(decode(raw, h)[inside - first])
            sizes.append(len(inside))
        rows = pa.StructArray.from_arrays([pa.array(np.concatenate(vox) if vox else np.zeros(0, np.int64)), pa.array(np.concatenate(values) if vox else np.zeros(0))], ["vox", "value"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), rows)

    return parts.select("path", "t", F.inline(voxels("path", "at", "nth")))


def _rows(spark: SparkSession, paths: list[str], volumes: int, times=None, mask: Image | None = None) -> tuple[DataFrame, bool]:
    """``(path, t, vox, value)`` of files, and whether the rows are those of the mask alone.

    Only the volumes asked for and, in each, the runs of the mask are read.
    """
    runs, exact = None, True
    if mask is not None:
        runs = mask_runs(mask)
        exact = len(runs) <= MOST_RUNS
        runs = merged(runs, 0, MOST_RUNS)
    with ThreadPoolExecutor(16) as pool:
        packed = any(pool.map(is_gzip, paths))
    if not packed:
        rows = scan(spark, paths, runs)
        return (rows if times is None else rows.where(F.col("t").isin([int(t) for t in times]))), exact
    spark.dataSource.register(NiftiDataSource)
    reader = spark.read.format("nifti").option("volumes", volumes).option("paths", json.dumps(paths)).option("stacked", "true")
    if times is not None:
        reader = reader.option("times", ",".join(map(str, times)) or "0")
    if runs is not None:
        reader = reader.option("runs", _pack_runs(runs))
    return reader.load(), exact


def read_image(spark: SparkSession, path: str, times: list[int] | None = None, mask: Image | None = None, volumes: int = 8) -> Image:
    """The image in a file: a volume, or a series if it has times. ``times`` and ``mask`` select volumes and voxels, before they are read."""
    h = read_header(path)
    rows, exact = _rows(spark, [path], volumes, times, mask)
    rows = rows.select("vox", "t", "value")
    labels = headers.volume_labels(h, math.prod(h.dims[3:]))
    if len(h.shape) == 3:
        image = Image(h.space, rows.select("vox", "value"), labels)
    else:
        image = Image(Space((*h.dims[:3], math.prod(h.dims[3:])), trans=h.trans), rows, labels)
    if mask is not None:
        image.space.require_same_grid(mask.space)
        if not exact:
            from ..operators.filters import apply_mask

            image = apply_mask(image, mask)
    if times is not None:
        from ..operators.sets import sub_vector

        image = sub_vector(image, times)
    return image


def read_hyper(spark: SparkSession, path: str, mask: Image | None = None, volumes: int = 8) -> DataFrame:
    """``(feature, trial, vox, value)`` of a file of five dimensions, trials before features."""
    h = read_header(path)
    if len(h.dims) != 5:
        raise ValueError(f"{path} has {len(h.dims)} dimensions, not 5")
    rows, exact = _rows(spark, [path], volumes, mask=mask)
    if not exact:
        rows = rows.join(mask.data.select("vox").distinct(), "vox", "left_semi")
    at = F.col("t") - 1
    return rows.select((F.floor(at / h.dims[3]) + 1).cast("int").alias("feature"), (at % h.dims[3] + 1).alias("trial"), "vox", "value")


def read_volume(spark: SparkSession, path: str, index: int = 1) -> Image:
    """One volume of a file, the only one read."""
    h = read_header(path)
    if not 1 <= index <= math.prod(h.dims[3:]):
        raise ValueError(f"{path} has no volume {index}")
    return Image(Space(h.space.space_dims, trans=h.trans), _rows(spark, [path], 1, [index])[0].select("vox", "value"))


def read_volumes(spark: SparkSession, paths: list[str], volumes: int = 8) -> Image:
    """Files of one grid each, one after the other in time, in one scan."""
    if not paths:
        raise ValueError("no files")
    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(read_header, paths))
    for h in found[1:]:
        found[0].space.require_same_grid(h.space)
    labels = [name for h in found for name in (headers.volume_labels(h, math.prod(h.dims[3:])) or ("",) * math.prod(h.dims[3:]))]
    rows, _ = _rows(spark, paths, volumes)
    return Image(Space((*found[0].dims[:3], len(labels)), trans=found[0].trans), rows.select("vox", "t", "value"), tuple(labels) if any(labels) else ())


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``(path, t, vox, value)`` of all files under a path or pattern, by Spark's own reader; a file is a row there."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                raw = content.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                h = headers.parse(raw)
                n = math.prod(h.dims[:3])
                for t in range(math.prod(h.dims[3:])):
                    at = int(h.vox_offset) + t * n * h.item_size
                    yield _batch(name, h, t, 0, raw[at : at + n * h.item_size], n)

    return files.mapInArrow(run, SCHEMA)


def plan_type(image: Image, dtype: str | None) -> tuple[str, float, float]:
    """The type to write and its slope and intercept: an integer type gets the range of the finite values."""
    if dtype is None or dtype[0] == "f":
        return dtype or "f4", 1.0, 0.0
    low, high, whole = image.data.where(~F.isnan(F.col("value").cast("double"))).agg(F.min("value"), F.max("value"), F.min(F.col("value") == F.rint("value"))).first()
    info = np.iinfo(dtype)
    if low is None or (whole and info.min <= low and high <= info.max):
        return dtype, 1.0, 0.0
    slope = (high - low) / (float(info.max) - float(info.min)) or 1.0
    return dtype, float(slope), float(low - slope * info.min)


#: Values of a part that a task encodes at once.
PART_VALUES = 1 << 20


class NiftiSink(DataSource):
    """Takes rows ``(part, at, value)``, a row without ``at`` for each part at least, sorted by part, and writes one file.

    A part is a stretch of ``part_values`` values. Where the file is plain and local, each part is written at its place in
    a file of the final size, so attempts that run twice write the same bytes; the commit gives the file its name. Of gzip, and in
    other stores, each part is a file, whole gzip members where the image is compressed, and the commit appends them in order.
    An abort leaves nothing.
    """

    @classmethod
    def name(cls):
        return "nifti_sink"

    def writer(self, schema, overwrite):
        return _Writer(json.loads(self.options["plan"]))


@dataclass
class _Written(WriterCommitMessage):
    parts: dict[int, str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, plan: dict):
        self.plan = plan
        self.files, self.final = place_of(plan["path"])
        self.header, self.trailer = base64.b64decode(plan["header"]), base64.b64decode(plan["trailer"])
        self.own = f"{self.final}.{plan['run']}"

    @property
    def in_place(self) -> bool:
        from pyarrow import fs

        return isinstance(self.files, fs.LocalFileSystem) and not self.plan["gzip"] and not self.plan["columns"]

    def _encode(self, values: np.ndarray) -> bytes:
        if columns := self.plan["columns"]:
            rows = values.reshape(-1, columns).tolist()
            return "".join(" ".join(str(int(v)) if v.is_integer() else repr(v) for v in row) + "\n" for row in rows).encode()
        kind = np.dtype(self.plan["dtype"]).newbyteorder("<")
        if kind.kind == "f":
            return values.astype(kind).tobytes()
        info = np.iinfo(kind)
        x = np.where(np.isfinite(values), (values - self.plan["inter"]) / self.plan["slope"], 0.0)
        return np.clip(np.rint(x), info.min, info.max).astype(kind).tobytes()

    def write(self, iterator):
        done: dict[int, str] = {}
        size, total = self.plan["part_values"], self.plan["total"]
        part, values = None, None

        def finish():
            raw = self._encode(values)
            if self.in_place:
                with self._open_place() as file:
                    file.seek(len(self.header) + part * size * np.dtype(self.plan["dtype"]).itemsize)
                    file.write(raw)
                done[part] = ""
                return
            done[part] = f"{self.own}/part-{part}-{uuid.uuid4().hex}"
            self.files.create_dir(self.own)
            with self.files.open_output_stream(done[part], compression=None) as file:
                file.write(_member(raw) if self.plan["gzip"] else raw)

        for batch in iterator:
            parts = np.asarray(batch.column("part"))
            at, given = batch.column("at").to_numpy(zero_copy_only=False), batch.column("value").to_numpy(zero_copy_only=False)
            cut = np.append(np.flatnonzero(np.diff(parts)) + 1, len(parts))
            start = 0
            for end in cut.tolist():
                if end == start:
                    continue
                if part != int(parts[start]):
                    if part is not None:
                        finish()
                    part = int(parts[start])
                    values = np.zeros(min(size, total - part * size))
                there = ~np.isnan(at[start:end].astype(float))
                values[at[start:end][there].astype(np.int64) - part * size] = given[start:end][there].astype(float)
                start = end
        if part is not None:
            finish()
        return _Written(done)

    def _open_place(self):
        """The file that parts are written into; whoever comes first makes it."""
        os.makedirs(os.path.dirname(self.own) or ".", exist_ok=True)
        return os.fdopen(os.open(self.own, os.O_RDWR | os.O_CREAT, 0o644), "r+b")

    def commit(self, messages):
        parts = {k: path for m in messages if m is not None for k, path in m.parts.items()}
        expected = -(-self.plan["total"] // self.plan["part_values"])
        if sorted(parts) != list(range(expected)):
            self.abort(messages)
            raise ValueError(f"{expected - len(parts)} of {expected} parts of {self.plan['path']} are missing")
        if self.in_place:
            with self._open_place() as file:
                file.write(self.header)
                file.seek(0, os.SEEK_END)
                file.write(self.trailer)
            os.replace(self.own, self.final)
            return
        joined = f"{self.own}.joined"
        with self.files.open_output_stream(joined, compression=None) as out:
            out.write(_member(self.header) if self.plan["gzip"] else self.header)
            for k in range(expected):
                with self.files.open_input_file(parts[k]) as file:
                    while some := file.read(8 << 20):
                        out.write(some)
            if self.trailer:
                out.write(_member(self.trailer) if self.plan["gzip"] else self.trailer)
        self.files.move(joined, self.final)
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs

        for path in (self.own, f"{self.own}.joined"):
            kind = self.files.get_file_info(path).type
            if kind == fs.FileType.Directory:
                self.files.delete_dir(path)
            elif kind == fs.FileType.File:
                self.files.delete_file(path)


def _member(raw: bytes) -> bytes:
    """A gzip member, the same for the same bytes."""
    return gzip.compress(raw, 1, mtime=0)


def write_image(image: Image, path: str, dtype: str | None = None, tr: float = 1.0, version: int | None = None, extensions=(), part_values: int = PART_VALUES) -> None:
    """Writes one file, gzipped if its name ends in ``.gz``; voxels without a row are 0.

    As many tasks write as there are parts of ``part_values`` values, or shuffle partitions if these are fewer; the
    file appears whole, or not at all. Of rows that repeat a voxel the greatest value counts.
    """
    dtype, slope, inter = plan_type(image, dtype)
    extensions = [*extensions, *([headers.label_extension(list(image.labels))] if any(image.labels) else [])]
    h = headers.header_of(image.space, dtype, slope, inter, tr, extensions=extensions, version=version)
    n, total = image.space.n_vox, math.prod(image.space.dims)
    t = F.col("t").cast("long") - 1 if image.is_series else F.lit(0)
    rows = image.data.select((t * n + F.col("vox") - 1).cast("long").alias("at"), F.col("value").cast("double").alias("value"))
    write_values(rows, total, path, headers.pack(h), dtype=dtype, slope=slope, inter=inter, part_values=part_values, packed=path.endswith(".gz"))


def write_values(
    rows: DataFrame, total: int, path: str, header: bytes = b"", trailer: bytes = b"", dtype: str = "f4", slope: float = 1.0, inter: float = 0.0,
    part_values: int = PART_VALUES, packed: bool = False, columns: int = 0,
) -> None:
    """Writes ``(at, value)``, places from 0 to ``total`` less 1, between a header and a trailer, by many tasks; absent values are 0.

    With ``columns`` the values are text, a line for so many; ``part_values`` must then be a multiple of them.
    """
    spark = rows.sparkSession
    part_values = part_values // max(1, columns) * max(1, columns) or columns
    plan = {
        "path": path, "header": base64.b64encode(header).decode(), "trailer": base64.b64encode(trailer).decode(), "dtype": dtype, "slope": slope, "inter": inter, "total": total,
        "part_values": part_values, "gzip": packed, "columns": columns, "run": f"writing-{uuid.uuid4().hex}",
    }
    files, final = place_of(path)
    files.create_dir(final.rpartition("/")[0] or ".")
    spark.dataSource.register(NiftiSink)
    parts = -(-total // part_values)
    rows = rows.where(F.col("at").between(0, total - 1))
    rows = rows.select(F.floor(F.col("at") / part_values).alias("part"), "at", "value")
    every = spark.range(parts).select(F.col("id").alias("part"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("double").alias("value"))
    dealt = rows.unionByName(every).repartition(max(1, min(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))), "part")
    dealt.sortWithinPartitions("part", "at", "value").write.format("nifti_sink").option("plan", json.dumps(plan)).mode("append").save()


def append_files(parts: list[str], path: str) -> None:
    """Makes one file of several, in bounded memory; it appears whole, and its parts go."""
    files, final = place_of(path)
    own = f"{final}.{uuid.uuid4().hex}"
    with files.open_output_stream(own, compression=None) as out:
        for part in parts:
            with open_file(part) as file:
                while some := file.read(8 << 20):
                    out.write(some)
    files.move(own, final)
    for part in parts:
        some, local = place_of(part)
        some.delete_file(local)
