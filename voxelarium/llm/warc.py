"""WARC archives with revisit resolution.

First every record is written with its payload, one archive per partition. Its header (page, digest, length and
place in the archive) goes on; only headers are shuffled, by payload digest. Of equal payloads of at least
``min_payload`` bytes the one of the smallest page id stays the response, and the headers of all others are
joined to it. Each archive is then copied: responses keep their payload, revisits become records without one,
all with fresh headers. Digests that very many pages share meet in a pre-aggregated minimum and a join that
Spark can split.

Archives are gzip members, one a record, led by a warcinfo record and written under a name of the task's own
attempt; the manifest that a stage leaves behind lists the files that count. All records carry the date that the
driver gave when the job was laid out, so a task that runs again writes the same bytes.

Defined results: a null html is an empty payload. Ids that are null come last, and equal ids are ordered by
archive and place, so exactly one of equal payloads is the response; ``refers_to`` has its id. A null url is
written as ``urn:page:<id>``; control characters of a url are written percent-encoded. An empty table gives an
empty table. Only id, url and html are read, so other columns may have any name. A very long payload is one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_file, materialize, new_path

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SOFTWARE = "voxelarium"
_INFO = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
_HEADERS = "part int, path string, offset long, length long, page_id long, payload_bytes long, payload_digest string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}/{kind}')}>"


def safe_url(url: str | None, page_id: int | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else f"urn:page:{page_id}"


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def info_record(name: str, date: str) -> bytes:
    """The warcinfo record that an archive begins with."""
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
        ("WARC-Date", date),
        ("WARC-Filename", name),
        ("Content-Type", "application/warc-fields"),
        ("Content-Length", str(len(_INFO))),
    ]
    return _assemble(fields, _INFO)


def _assemble(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return head + b"\r\n" + block + b"\r\n\r\n"


def record(
    kind: str, page_id: int | None, url: str, payload_digest: str, payload: bytes, size: int, refers_to: tuple | None = None, date: str = "1970-01-01T00:00:00Z"
) -> bytes:
    """A record in bytes. ``refers_to``: the id, url and date of the response that a revisit stands for."""
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, payload_digest, kind)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(size)),
    ]
    if kind == "revisit":
        to, to_url, to_date = refers_to
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(to, payload_digest, "response")),
            ("WARC-Refers-To-Target-URI", to_url),
            ("WARC-Refers-To-Date", to_date),
            ("X-Refers-To-Page-ID", "" if to is None else str(to)),
        ]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    return _assemble(fields, payload)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The fields and the payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.decode().split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record ends early or late")
    return fields, rest[:n]


def read_records(file):
    """Every record of an archive of gzip members, read piece by piece."""
    open_, held = zlib.decompressobj(31), []
    while data := file.read(1 << 18):
        while data:
            held.append(open_.decompress(data))
            data = b""
            if open_.eof:
                data = open_.unused_data
                yield parse(b"".join(held))
                open_, held = zlib.decompressobj(31), []
    if any(held):
        raise ValueError("an archive ends within a record")


class _Archive:
    """An archive that a task writes under a name of its own."""

    def __init__(self, folder: str, part: int, date: str):
        self.path, self.file, self.at, self.date = f"{folder}/pages-{part:06d}-{uuid.uuid4().hex}.warc.gz", None, 0, date

    def add(self, data: bytes) -> tuple[int, int]:
        if self.file is None:
            files, local = local_file(self.path)
            files.create_dir(local.rpartition("/")[0], recursive=True)
            self.file = files.open_output_stream(local, compression=None)
            self.add(info_record(self.path.rpartition("/")[2], self.date))
        packed = gzip.compress(data, compresslevel=1, mtime=0)
        self.file.write(packed)
        self.at += len(packed)
        return self.at - len(packed), len(packed)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def write_archives(
    pages: DataFrame, folder: str, date: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Writes a response record for every page, dated ``date`` or now; returns the header of each."""
    date = date or now()
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        archive = _Archive(folder, part, date)
        for b in batches:
            out: dict[str, list] = {f.split()[0]: [] for f in f"{_HEADERS}, url string".split(", ")}
            for page_id, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                payload = html.as_py() or b""
                key, url = digest(payload), safe_url(url, page_id)
                offset, length = archive.add(record("response", page_id, url, key, payload, len(payload), date=date))
                for column, value in zip(out.values(), (part, archive.path, offset, length, page_id, len(payload), key, url)):
                    column.append(value)
            out["part"] = pa.array(out["part"], pa.int32())
            yield pa.RecordBatch.from_pydict(out | {"page_id": pa.array(out["page_id"], pa.int64())})
        archive.close()

    return materialize(rows.mapInArrow(run, f"{_HEADERS}, url string"), "headers")


def resolve_revisits(headers: DataFrame, min_payload: int = 0) -> DataFrame:
    """``headers`` with ``record_type``, and for revisits ``to_id`` and ``to_url`` of their response."""
    place = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "part", "offset")
    large = headers.where(F.col("payload_bytes") >= min_payload)
    first = large.groupBy("payload_digest", "payload_bytes").agg(F.min(F.struct(place.alias("place"), "url")).alias("first"))
    # written, so that the join can split the headers of a very common payload
    first = materialize(first, "first-payloads")
    joined = headers.join(first, ["payload_digest", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & (place > F.col("first.place"))
    return joined.select(
        *headers.columns,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first.place.page_id")).alias("to_id"),
        F.when(again, F.col("first.url")).alias("to_url"),
    )


def rewrite_archives(resolved: DataFrame, folder: str, archives: int) -> DataFrame:
    """Copies each archive, with revisits instead of repeated payloads; returns the paths of the new archives.

    ``archives`` is their number. Twice as many tasks are asked for, as rows of plans are small and would else be put
    together in a few tasks, and as some tasks get more than one archive by their hash.
    """
    plans = resolved.select("path", "offset", "length", "record_type", "to_id", "to_url")
    # one task reads an archive once, in order of place; its plan has a row a record, and is streamed
    dealt = plans.repartition(max(1, 2 * archives), "path").sortWithinPartitions("path", "offset")

    def run(batches):
        from pyspark import TaskContext

        archive, path, file = None, None, None
        for b in batches:
            for at, offset, length, kind, to, to_url in zip(*[c.to_pylist() for c in b.columns]):
                if at != path:
                    if file is not None:
                        file.close()
                    files, local = local_file(at)
                    path, file = at, files.open_input_file(local)
                fields, payload = parse(gzip.decompress(file.read_at(length, offset)))
                archive = archive or _Archive(folder, TaskContext.get().partitionId(), fields["WARC-Date"])
                page_id = int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None
                key, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                again = kind == "revisit"
                date = fields["WARC-Date"]
                archive.add(record(kind, page_id, fields["WARC-Target-URI"], key, b"" if again else payload, size, (to, to_url, date), date))
        if archive is not None:
            file.close()
            archive.close()
            yield pa.RecordBatch.from_pydict({"path": [archive.path]})

    return materialize(dealt.mapInArrow(run, "path string"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, url)`` of every record.

    A response whose payload isn't that of its headers is an error.
    """

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                files, local = local_file(path)
                out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")}
                with files.open_input_stream(local, compression=None) as file:
                    for fields, payload in read_records(file):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        key, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                        kind, to = fields["WARC-Type"], fields.get("X-Refers-To-Page-ID")
                        if kind == "response" and (digest(payload) != key or len(payload) != size):
                            raise ValueError(f"{path}: a payload differs from its headers")
                        page = int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None
                        row = (page, size, key, kind, int(to) if to else None, fields["WARC-Target-URI"])
                        for column, value in zip(out.values(), row):
                            column.append(value)
                ids = {k: pa.array(out[k], pa.int64()) for k in ("page_id", "refers_to")}
                yield pa.RecordBatch.from_pydict(out | ids)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return archives.repartition(max(1, archives.count()), "path").mapInArrow(run, schema)


def deduplicated_archives(spark: SparkSession, pages: DataFrame, min_payload: int = 0, **columns) -> DataFrame:
    """Writes ``pages`` as archives, resolves revisits, writes the archives anew and returns the paths of those."""
    headers = write_archives(pages, new_path(spark, "warc-all"), **columns)
    archives = headers.select("path").distinct().count()
    return rewrite_archives(resolve_revisits(headers, min_payload), new_path(spark, "warc"), archives)
