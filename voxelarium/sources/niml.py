"""NIML files: elements of a tag and a table, as text or binary, read by byte ranges.

Tasks look for tags in ranges of the file, and the driver, which gets the tags alone, follows them from the beginning: a binary
table is as long as its tag says, so what looks like a tag within it is passed over; one of text ends at the next tag.
Binary tables are then read by ranges of rows. Ranges of text are counted first, as the number of a row is that of all words before it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .nifti import append_files, open_file, place_of, write_values

#: Bytes of a range, and of the longest tag.
RANGE, LONGEST_TAG = 8 << 20, 1 << 16
#: Sizes of the format's types (fixed values).
TYPES = {"byte": "u1", "short": "i2", "int": "i4", "float": "f4", "double": "f8"}
_TAG = re.compile(rb"<(/?)([A-Za-z_]\w*)((?:\s+[\w.]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))*)\s*(/?)>", re.S)
_ATTRIBUTE = re.compile(rb"([\w.]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
CELLS = "element int, row long, col int, value double"


@dataclass(frozen=True)
class Element:
    """A tag: its name, attributes, and the bytes of its table (none for a group's tag)."""

    number: int
    name: str
    attributes: dict[str, str]
    start: int
    end: int

    @property
    def kinds(self) -> list[str]:
        """The types of the columns; none if the element has no table of numbers."""
        out = []
        for part in self.attributes.get("ni_type", "").split(","):
            times, _, kind = part.strip().rpartition("*")
            out += [kind] * (int(times) if times else 1)
        return out if out and all(k in TYPES for k in out) else []

    @property
    def rows(self) -> int:
        return int(np.prod([int(n) for n in self.attributes.get("ni_dimen", "1").split(",")]))

    @property
    def record(self) -> np.dtype | None:
        """A row of a binary table; None for text."""
        form = self.attributes.get("ni_form", "text")
        order = ">" if form.endswith("msbfirst") else "<"
        return np.dtype([(f"c{n}", order + TYPES[k]) for n, k in enumerate(self.kinds)]) if form.startswith("binary") else None


def size_of(path: str) -> int:
    files, local = place_of(path)
    return files.get_file_info(local).size


def elements(spark: SparkSession, path: str, range_bytes: int = RANGE) -> list[Element]:
    """The elements of a file, in order; a group's tag comes before what it holds."""
    size = size_of(path)

    def run(batches):
        for b in batches:
            for at in b.column(0).to_pylist():
                with open_file(path) as file:
                    file.seek(at * range_bytes)
                    data = file.read(range_bytes + LONGEST_TAG)
                found = [m for m in _TAG.finditer(data) if m.start() < range_bytes]
                places = [at * range_bytes + m.start() for m in found]
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([m[0] for m in found], pa.binary())], ["at", "tag"])

    ranges = -(-size // range_bytes)
    tags = sorted((r.at, bytes(r.tag)) for r in spark.range(0, ranges, 1, max(1, ranges)).mapInArrow(run, "at long, tag binary").collect())
    out, reached = [], 0
    for at, tag in tags:
        if at < reached:  # looks like a tag, but lies within a binary table
            continue
        m = _TAG.fullmatch(tag)
        if m[1]:
            if out and out[-1].end < 0:
                out[-1] = Element(out[-1].number, out[-1].name, out[-1].attributes, out[-1].start, at)
            continue
        attributes = {k.decode(): v.strip(b"\"'").decode() for k, v in _ATTRIBUTE.findall(m[3])}
        start = at + len(tag)
        element = Element(len(out) + 1, m[2].decode(), attributes, start, start)
        if not m[4] and element.kinds:
            element = Element(element.number, element.name, attributes, start, start + element.rows * element.record.itemsize if element.record else -1)
            reached = max(start, element.end)
        out.append(element)
    return [e if e.end >= 0 else Element(e.number, e.name, e.attributes, e.start, size) for e in out]


def read_tables(spark: SparkSession, path: str, found: list[Element] | None = None, range_bytes: int = RANGE) -> DataFrame:
    """``(element, row, col, value)`` of the elements with tables of numbers, all counted from 1."""
    found = elements(spark, path, range_bytes) if found is None else found
    tables = {e.number: e for e in found if e.kinds}
    for e in tables.values():
        if e.record and e.end > size_of(path):
            raise ValueError(f"{path} ends early")
    parts = []
    for e in tables.values():
        if e.record:
            step = max(1, range_bytes // e.record.itemsize)
            parts += [(e.number, r, min(r + step, e.rows), 0) for r in range(0, e.rows, step)]
    text = [(e.number, a, min(a + range_bytes, e.end), 0) for e in tables.values() if not e.record for a in range(e.start, e.end, range_bytes)]
    shape, spread = "number int, first long, last long, before long", lambda rows: spark.createDataFrame(rows, shape).repartition(len(rows))

    def words(file, e: Element, first: int, last: int) -> list[bytes]:
        """The words that begin in a range."""
        file.seek(max(e.start, first - 1))
        data = file.read(last - max(e.start, first - 1))
        if first > e.start:  # a word that runs into the range belongs to the one before
            data = data[1:] if data[:1].isspace() else (data.split(None, 1)[1] if len(data.split(None, 1)) > 1 and not data[:1].isspace() else b"")
        if data and not data[-1:].isspace():
            while last < e.end and (more := file.read(min(64, e.end - last))):
                cut = re.search(rb"\s", more)
                data, last = data + (more[: cut.start()] if cut else more), last + len(more)
                if cut:
                    break
        return data.split()

    def count(batches):
        for b in batches:
            rows = list(zip(*(b.column(n).to_pylist() for n in range(3))))
            with open_file(path) as file:
                sizes = [len(words(file, tables[e], first, last)) for e, first, last in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], ["number", "first", "n"])

    if text:
        sizes = {(r.number, r.first): r.n for r in spread(text).mapInArrow(count, "number int, first long, n long").collect()}
        before: dict[int, int] = {}
        for number, first, last, _ in text:
            parts.append((number, first, last, before.get(number, 0)))
            before[number] = before.get(number, 0) + sizes[number, first]
        for number, n in before.items():
            if n != tables[number].rows * len(tables[number].kinds):
                raise ValueError(f"element {number} of {path} has {n} numbers, not {tables[number].rows} rows of {len(tables[number].kinds)}")

    def read(batches):
        for b in batches:
            for number, first, last, before in zip(*(b.column(n).to_pylist() for n in range(4))):
                e = tables[number]
                columns = len(e.kinds)
                with open_file(path) as file:
                    if e.record:
                        file.seek(e.start + first * e.record.itemsize)
                        table = np.frombuffer(file.read((last - first) * e.record.itemsize), e.record)
                        values, at = np.stack([table[c].astype(float) for c in e.record.names], axis=1).ravel(), first * columns
                    else:
                        values, at = np.array(words(file, e, first, last), float), before
                place = np.arange(at, at + len(values))
                rows = [np.full(len(values), number, np.int32), place // columns + 1, (place % columns + 1).astype(np.int32), values]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["element", "row", "col", "value"])

    return spread(parts).mapInArrow(read, CELLS) if parts else spark.createDataFrame([], CELLS)


def write_tables(path: str, tables: list[tuple[str, DataFrame, int, str, int]], binary: bool = False, **attributes: str) -> None:
    """Writes elements ``(name, rows, number of rows, type, columns)``, their rows ``(row, col, value)`` counted from 1, by many tasks.

    Each element is written on its own and appended; ``attributes`` go to every tag.
    """
    parts = []
    for n, (name, rows, count, kind, columns) in enumerate(tables):
        form = ' ni_form="binary.lsbfirst"' if binary else ""
        more = "".join(f' {k}="{v}"' for k, v in attributes.items())
        tag = f'<{name} ni_type="{columns}*{kind}" ni_dimen="{count}"{form}{more}>'
        at = (F.col("row").cast("long") - 1) * columns + F.col("col") - 1
        parts.append(f"{path}.element-{n}")
        write_values(rows.select(at.alias("at"), F.col("value").cast("double").alias("value")), count * columns, parts[-1], tag.encode() + (b"" if binary else b"\n"), f"</{name}>\n".encode(), TYPES[kind], columns=0 if binary else columns)
    append_files(parts, path)
