"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens are the matches of a pattern. Within one, the adjacent pair of the smallest merge rank is joined,
the leftmost of equals, until no pair has a rank. The queue has a bucket of linked-list positions for every
rank; two levels of bitmaps, of 256 bits a word, tell which buckets are filled, so the next rank is found by
two find-first-set steps whatever the length of the pre-token. Entries whose pair has changed since are skipped.

Texts are first cut where a run of white space begins, which never changes a match of the pattern, and pieces
met before are looked up. The table of pieces is emptied when it reaches a bound, so memory stays bounded.

Defined results: null and empty texts have no ids, and decode to nothing. Rows are encoded one by one. Only id and
text are read; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the tables of pieces and of pre-tokens in a worker.
CACHE = 1_000_000
#: A run of white space and what follows it. The pattern's white space has not the four separators that Python's has.
PIECES = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


#: Ranks to a word of the lower level; the upper level has a bit for each such word.
_WORD = 8
_BIT = [1 << i for i in range(1 << _WORD)]


class RankQueue:
    """Two levels of bitmaps over the merge ranks. It is empty between pre-tokens, so one serves them all."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> _WORD) + 1)


def merge(word: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """The ids of one pre-token.

    ``after`` and ``before`` link the positions at which tokens begin, ``pair`` has the rank of the pair that begins
    there or -1. A position popped from a bucket counts only if its pair still has the bucket's rank.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    after, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
    get, low, bit, top = ranks.get, queue.low, _BIT, 0
    buckets: dict[int, list[int]] = {}
    for i in range(n - 1):
        rank = get(word[i : i + 2])
        if rank is not None:
            pair[i] = rank
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
                at = rank >> _WORD
                low[at] |= bit[rank & 255]
                top |= 1 << at
    while top:
        at = (top & -top).bit_length() - 1
        filled = low[at]
        first = filled & -filled
        rank = (at << _WORD) + first.bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            low[at] = filled ^ first
            if filled == first:
                top ^= 1 << at
        if pair[i] != rank:
            continue
        j = after[i]
        k = after[i] = after[j]
        pair[j] = pair[i] = -1
        if k < n:
            before[k] = i
            changed = ((before[i], k), (i, after[k]))
        else:
            changed = ((before[i], k),)
        for start, end in changed:
            if start < 0:
                continue
            rank = get(word[start:end])
            if rank is None:
                pair[start] = -1
                continue
            pair[start] = rank
            if rank in buckets:
                heappush(buckets[rank], start)
            else:
                buckets[rank] = [start]
                at = rank >> _WORD
                low[at] |= bit[rank & 255]
                top |= 1 << at
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes and decodes texts by the ranks of a vocabulary file."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        import regex

        self.ranks = load_ranks(path)
        self.queue = RankQueue(max(self.ranks.values(), default=0) + 1)
        self.find = regex.compile(pattern).findall
        self.bound, self.words = cache, {}
        self.tokens = [b""] * (max(self.ranks.values(), default=0) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        encoder = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= encoder.bound:
                    self.clear()
                ids = encoder._encode_piece(piece)
                if len(piece) <= 64:
                    self[piece] = ids
                return ids

        self.pieces = Pieces()

    def _encode_piece(self, piece: str) -> bytes:
        if len(self.words) >= self.bound:
            self.words.clear()
        out = []
        for word in self.find(piece):
            ids = self.words.get(word)
            if ids is None:
                ids = np.array(merge(word.encode(), self.ranks, self.queue), np.uint32).tobytes()
                if len(word) <= 64:
                    self.words[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, PIECES.findall(text or ""))), np.uint32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=1)
def encoder_of(path: str, pattern: str) -> Encoder:
    """The worker's encoder, which keeps what it knows from one task to the next."""
    return Encoder(path, pattern)


def encode_documents(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every row, the ids as ``array<int>``."""

    def run(batches):
        encoder = encoder_of(path, pattern)
        for b in batches:
            rows = [encoder.encode(t.as_py()).astype(np.int32) for t in b.column(1)]
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
            values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def digests(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row, after encoding and decoding its text."""

    def run(batches):
        encoder = encoder_of(path, pattern)
        decimal = [str(i) for i in range(len(encoder.tokens))]
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for t in b.column(1):
                ids = encoder.encode(t.as_py()).tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
