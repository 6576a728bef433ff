"""Token ids as fixed-width bit-packed files.

Each id takes the fewest bits that hold the vocabulary, low bits first. A file is

    magic, u32 bits, u32 ids per block | blocks | u64 block offsets | i64 doc ids | u8 null flags | u64 doc starts | footer

with a footer of ``u64 tokens, docs, blocks, place of the offsets`` and the magic again. Blocks are padded to whole
bytes; their offsets let a reader take any range of ids without the rest, unpacked by numpy at once.

Documents are ordered by id (null first, as Spark sorts), then by the hash of the text, dealt by range, and each
task encodes and writes its range under a name of its own attempt. The manifest lists the files of the attempts
that counted, so a task that runs again, or twice, does no harm.

Defined results: null and empty texts are a lone end id. A text that holds the name of a special token gets that
token's id there, as the library gives it with ``add_special_tokens=False``. Very long texts are cut into pieces and
never held as one list of tokens' objects. Rows that repeat id and text get a row each. An empty
table gives an empty table. Only id and text are read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import local_file, materialize, new_path

MAGIC = b"VXTOKEN1"
BLOCK = 1 << 16
#: Pieces of text whose ids a worker remembers; the table is emptied when it is full.
CACHE = 1_000_000
#: Bytes of texts, and pieces of them, that are encoded at once.
TEXTS, AT_ONCE = 4 << 20, 500_000
#: Kinds of bytes: letter, digit, white space, apostrophe, other, and parts of characters beyond ASCII.
_LETTER, _DIGIT, _SPACE, _APOSTROPHE, _OTHER, _BEYOND = range(6)
_KIND = np.array(
    [
        _BEYOND if k > 127 else _LETTER if chr(k).isalpha() else _DIGIT if chr(k).isdigit() else _SPACE if k == 32 or 9 <= k <= 13 else _APOSTROPHE if k == 39 else _OTHER
        for k in range(256)
    ],
    np.uint8,
)
#: By the kinds of the bytes before and after a place, 1 if a match of the byte-level pattern always ends there, 2 if it does unless
#: the character before is white space, 3 if it does after a letter: letters, digits and other characters don't share a match,
#: but for a space before them and an apostrophe before letters, and no match goes on into white space.
_ENDS = np.zeros((6, 6), np.uint8)
_ENDS[_LETTER, [_DIGIT, _SPACE, _APOSTROPHE, _OTHER]] = 1
_ENDS[_DIGIT, [_LETTER, _SPACE, _APOSTROPHE, _OTHER]] = 1
_ENDS[_OTHER, [_LETTER, _DIGIT, _SPACE]] = 1
_ENDS[_APOSTROPHE, [_DIGIT, _SPACE]] = 1
_ENDS[_BEYOND, [_DIGIT, _APOSTROPHE, _OTHER]] = 3
_ENDS[_BEYOND, _SPACE] = 2
#: Pieces that are one match: Latin letters, of which U+00C0 to U+024F but two are all, after a space or not.
_WORD = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)\\Z")
#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others are numbered from 256.
_SELVES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STANDS = {k: 256 + n for n, k in enumerate(sorted(set(range(256)) - set(_SELVES)))}


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.asarray(ids, np.uint32)
    if bits in (8, 16, 32):  # packing is the plain little-endian layout then
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int, skip: int = 0) -> np.ndarray:
    """``count`` ids of a block, after the first ``skip``."""
    at = (np.arange(skip, skip + count, dtype=np.int64)) * bits
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    low, value = at >> 3, np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        value |= raw[low + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Writes one file, a document at a time, and holds one block and the document index in memory."""

    def __init__(self, file, bits: int, block: int = BLOCK):
        self.file, self.bits, self.block = file, bits, block
        self.offsets, self.docs, self.nulls, self.starts = [], [], [], [0]
        self.open, self.held, self.place = [], 0, 16
        file.write(MAGIC + struct.pack("<II", bits, block))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            whole = np.concatenate(self.open)
            full = len(whole) - len(whole) % self.block
            for k in range(0, full, self.block):
                self._put(whole[k : k + self.block])
            self.open, self.held = [whole[full:]], len(whole) - full

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.place)
        self.place += len(data)
        self.file.write(data)

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.open))
        self.file.write(np.array([*self.offsets, self.place], "<u8").tobytes())
        self.file.write(np.array(self.docs, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes() + np.array(self.starts, "<u8").tobytes())
        self.file.write(struct.pack("<QQQQ", self.starts[-1], len(self.docs), len(self.offsets), self.place) + MAGIC)
        self.file.close()


class Reader:
    """Random access to the ids of a file that pyarrow opened for input."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        if file.read_at(8, 0) != MAGIC or file.read_at(8, end - 8) != MAGIC:
            raise ValueError("not a token file, or cut short")
        self.bits, self.block = struct.unpack("<II", file.read_at(8, 8))
        self.n_tokens, n_docs, n_blocks, place = struct.unpack("<QQQQ", file.read_at(32, end - 40))
        index = file.read_at(end - 40 - place, place)
        self.offsets = np.frombuffer(index, "<u8", n_blocks + 1)
        at = 8 * (n_blocks + 1)
        self.doc_ids = np.frombuffer(index, "<i8", n_docs, at)
        self.nulls = np.frombuffer(index, np.uint8, n_docs, at + 8 * n_docs)
        self.starts = np.frombuffer(index, "<u8", n_docs + 1, at + 9 * n_docs).astype(np.int64)
        self._last = (-1, b"")

    def _data(self, block: int) -> bytes:
        if self._last[0] != block:
            a, b = int(self.offsets[block]), int(self.offsets[block + 1])
            self._last = (block, bytes(self.file.read_at(b - a, a)))
        return self._last[1]

    def tokens(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from place ``start``, reading the blocks that hold them only."""
        out = []
        while count > 0:
            skip = start % self.block
            here = min(count, self.block - skip)
            out.append(unpack(self._data(start // self.block), here, self.bits, skip))
            start, count = start + here, count - here
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece once while the worker remembers it."""

    def __init__(self, path: str, bound: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.bound, self.known = bound, {}
        names = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(n.encode()) for n in names)) if names else None
        before, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        #: Whether the library does nothing to a word but write its bytes as characters and merge them.
        self.plain = (
            isinstance(before, pre_tokenizers.ByteLevel)
            and before.use_regex
            and not before.add_prefix_space
            and self.tokenizer.normalizer is None
            and isinstance(self.model, models.BPE)
            and not self.model.dropout
        )

    def starts(self, data: np.ndarray) -> np.ndarray:
        """1 for each of the UTF-8 bytes before which a cut changes no match of the byte-level pattern, else 0."""
        kind = _KIND[data]
        ends = _ENDS.ravel()[kind[:-1] * np.uint8(6) + kind[1:]]
        doubtful = np.flatnonzero(ends == 2)
        # the last three bytes of the character before: U+0085, 00A0, 1680, 2000 to 200A, 2028, 2029, 202F, 205F and 3000
        c, d, e = (data[np.maximum(doubtful - k, 0)] for k in (2, 1, 0))
        space = (d == 0xC2) & ((e == 0x85) | (e == 0xA0)) | (c == 0xE1) & (d == 0x9A) & (e == 0x80) | (c == 0xE3) & (d == 0x80) & (e == 0x80)
        space |= (c == 0xE2) & ((d == 0x80) & ((e <= 0x8A) | np.isin(e, [0xA8, 0xA9, 0xAF])) | (d == 0x81) & (e == 0x9F))
        ends[doubtful[space]] = 0
        doubtful = np.flatnonzero(ends == 3)
        d, e = data[np.maximum(doubtful - 1, 0)], data[doubtful]
        ends[doubtful[~((d == 0xC3) & (e != 0x97) & (e != 0xB7) | (d >= 0xC4) & (d <= 0xC8) | (d == 0xC9) & (e <= 0x8F))]] = 0
        for m in self.special.finditer(memoryview(data)) if self.special else ():
            ends[m.start() : m.end() - 1] = 0
        return np.append(np.uint8(1), ends)

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        if bounds[-1] == bounds[0]:
            return [np.zeros(0, np.uint32)] * len(column)
        data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        starts = self.starts(data)
        starts[bounds[:-1][bounds[:-1] < len(data)]] = 1
        places = np.append(np.flatnonzero(starts), len(data))
        some = [self._encoded(data, places[at : at + AT_ONCE + 1]) for at in range(0, len(places) - 1, AT_ONCE)]
        ids, sizes = (np.concatenate(x) for x in zip(*some))
        of_text = np.append(0, np.cumsum(sizes))[np.searchsorted(places, bounds)]
        return [ids[a:b] for a, b in zip(of_text[:-1], of_text[1:])]

    def _encoded(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces between the places, and how many each has."""
        pieces = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
        words, of = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        if len(self.known) > self.bound:
            self.known.clear()
        found = list(map(self.known.get, words))
        fresh, others = [i for i, ids in enumerate(found) if ids is None], []
        for i in fresh:
            word = words[i]
            if self.plain and _WORD.match(word.decode()) and not (self.special and self.special.search(word)):
                # the library's model by itself takes half the time of its whole way to an encoding
                letters = word.decode().replace(" ", chr(_STANDS[32])) if word.isascii() else word.decode("latin-1").translate(_STANDS)
                ids = [t.id for t in self.model.tokenize(letters)]
                found[i] = self.known[word] = array("I", ids).tobytes()
            else:
                others.append(i)
        for at in range(0, len(others), 1000):
            some = others[at : at + 1000]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([words[i].decode() for i in some], add_special_tokens=False)):
                found[i] = self.known[words[i]] = array("I", e.ids).tobytes()
        # the ids of each piece lie at a place of those of all words
        ids = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(sizes) - sizes
        each = sizes[of]
        ends = np.cumsum(each)
        return ids[np.repeat(begins[of] - (ends - each), each) + np.arange(ends[-1])], each


def by_size(batch: pa.RecordBatch):
    """The batch of ids and texts in slices of some ``TEXTS`` bytes, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXTS, "right")))
        yield batch.slice(at, end - at)
        at = end


@lru_cache(maxsize=1)
def encoder_of(path: str) -> PieceEncoder:
    """The worker's encoder, which keeps what it knows from one task to the next."""
    return PieceEncoder(path)


def write_tokens(
    documents: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes the token files and returns their manifest ``(part, path, n_docs, n_tokens, base)``, parts in order.

    ``base`` is the number of ids in the parts before.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        encoder, part, writer = encoder_of(tokenizer_path), TaskContext.get().partitionId(), None
        path = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.vxt"
        for b in batches:
            for some in by_size(b):
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1))):
                    if writer is None:
                        files, local = local_file(path)
                        files.create_dir(local.rpartition("/")[0], recursive=True)
                        writer = Writer(files.open_output_stream(local, compression=None), width_of(encoder.vocabulary))
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [len(writer.docs)], "n_tokens": [writer.starts[-1]]}
            )

    manifest = materialize(ordered.mapInArrow(run, "part int, path string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files."""

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                files, local = local_file(path)
                with files.open_input_file(local) as file:
                    reader = Reader(file)
                    crc = [zlib.crc32(reader.document(k).astype("<u4").tobytes()) for k in range(len(reader.doc_ids))]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.doc_ids, pa.int64(), mask=reader.nulls.astype(bool)),
                            pa.array(reader.starts[:-1] + base),
                            pa.array(np.diff(reader.starts)),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    files = manifest.select("path", "base")
    return files.repartition(max(1, files.count()), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def pack_documents(spark: SparkSession, documents: DataFrame, tokenizer_path: str, end_id: int = 0, **columns) -> DataFrame:
    """Encodes, writes to a new folder of the shared one, and reads back."""
    return read_tokens(write_tokens(documents, tokenizer_path, new_path(spark, "tokens"), end_id, **columns))
