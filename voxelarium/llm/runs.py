"""Periodic runs of words: stretches that repeat one block several times over, without a limit on the block's length.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are the same) that has at least
``max(MIN_LENGTH, EXPONENT * q)`` words and that no neighbouring word extends keeping the period.

Each text is worked on alone, and many texts stand in one array of numbers at a time, so the steps are numpy's:

1. A run holds each of its words ``EXPONENT`` times, so words that are rarer in a piece of a text cut it. What is left
   of most texts is nothing, and no run is lost.
2. The suffix array of the pieces by doubling: the ranks of all blocks of 1, 2, 4, ... words. The tables of ranks also
   give the longest common extension of two places, forwards and backwards, in one step a table.
3. The longest common prefixes of neighbours in the suffix array; from these and the nearest smaller places on either side
   the longest previous factor of each place, and with it the blocks of the Lempel-Ziv parse.
4. Main's extensions: a run that touches the start of a block is found from the matches around that start at a distance of
   its period, which is less than the two blocks around the start hold.
5. Runs strictly inside a block are copies of runs in the block's earlier occurrence, which are taken from buckets by start.

Defined results: a null or empty text has no runs. Rows are worked on one by one, so repeated rows get the same result, and
an empty table gives an empty table. Texts of any length are whole; a text is one task's, at some 250 bytes a word of its
pieces. Of runs of equal length the one that starts first is the longest, then the one of the smallest period. Only the
id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH, EXPONENT = 6, 4
#: Words of pieces that are worked on together; a longer text is worked on alone.
GROUP_WORDS = 1 << 17
#: Rounds in which pointers to smaller places jump together; what is still open then is finished one by one.
JUMPS = 64


class Ranks:
    """Ranks of all blocks of 1, 2, 4, ... numbers, up to blocks that are all different."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
        self.n, self.levels, step = n, [], 1
        while True:
            # one place more, which equals no other
            self.levels.append(np.append(rank, -1).astype(np.int32))
            if not n or rank.max() == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.append(True, key[order][1:] != key[order][:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            step *= 2
        self.suffixes = np.argsort(self.levels[-1][:-1], kind="stable")

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far what starts at ``i`` and at ``j`` is the same; the two differ."""
        i, j = i.copy(), j.copy()
        began = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            same = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i += same
            j += same
        return i - began

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far what ends at ``i`` and at ``j`` (inclusive) is the same; -1 is the place before the first."""
        i, j = i.copy(), j.copy()
        began = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << k) + 1, j - (1 << k) + 1
            fits = (a >= 0) & (b >= 0)
            same = (fits & (self.levels[k][np.where(fits, a, 0)] == self.levels[k][np.where(fits, b, 0)])).astype(np.int64) << k
            i -= same
            j -= same
        return began - i


def _nearest_smaller(values: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before it with a smaller value (-1: none) and the least gap on the way.

    ``gaps[r]`` is the gap between places ``r - 1`` and ``r``.
    """
    n = len(values)
    v = np.append(values, -1)  # the place -1
    at, least = np.arange(-1, n - 1), gaps.astype(np.int64)
    open_at = np.flatnonzero(v[at] > values)
    for _ in range(JUMPS):
        if not len(open_at):
            break
        through = at[open_at]
        least[open_at] = np.minimum(least[open_at], least[through])
        at[open_at] = at[through]
        open_at = open_at[v[at[open_at]] > values[open_at]]
    if len(open_at):
        # in rising order the pointers before a place are final, and each is passed once
        v, at, least = v.tolist(), at.tolist(), least.tolist()
        for r in open_at.tolist():
            while v[at[r]] > v[r]:
                least[r] = min(least[r], least[at[r]])
                at[r] = at[at[r]]
        at, least = np.array(at), np.array(least)
    return at, np.where(at < 0, 0, least)


def previous_factors(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous factor of each place and where it starts, from the suffix array and the common prefixes."""
    sa = ranks.suffixes
    n = len(sa)
    lcp = np.zeros(n + 1, np.int64)
    if n:
        lcp[1:n] = ranks.forward(sa[:-1], sa[1:])
    left, by_left = _nearest_smaller(sa, lcp[:n])
    right, by_right = _nearest_smaller(sa[::-1], lcp[1:][::-1])
    right, by_right = n - 1 - right[::-1], by_right[::-1]
    length, source = np.empty(n, np.int64), np.empty(n, np.int64)
    length[sa] = np.maximum(by_left, by_right)
    source[sa] = np.where(by_left >= by_right, sa[left], sa[np.minimum(right, n - 1)])
    return length, source


def parse(length: np.ndarray) -> np.ndarray:
    """Starts of the blocks of the Lempel-Ziv parse, and the end of the last one."""
    starts, at, lengths = [], 0, length.tolist()
    while at < len(lengths):
        starts.append(at)
        at += lengths[at] or 1
    return np.array([*starts, len(lengths)], np.int64)


def _touching(x: np.ndarray, ranks: Ranks, starts: np.ndarray, min_length: int, exponent: int) -> dict[tuple[int, int], int]:
    """Runs that touch a start of a block, as ``{(start, end): period}``.

    What follows the first period of a run has occurred before, so a block that starts there reaches the run's end. Of
    the starts within a run the first one after its first period, or else the last one, therefore has a block before or
    after it that holds all of the run but one period; so ``exponent - 1`` periods are less than the two blocks.
    """
    n, sizes = len(x), np.diff(starts, append=starts[-1])
    before = np.append(0, sizes[:-1])
    many = np.maximum(0, (before + sizes - 1) // (exponent - 1))
    b = np.repeat(starts, many)
    p = np.arange(len(b)) - np.repeat(np.cumsum(many) - many, many) + 1
    c, p = np.concatenate([b, b - p]), np.concatenate([p, p])
    y = np.append(x, -1)
    fits = (c >= 0) & (c + p <= n)
    c, p = c[fits], p[fits]
    hit = (y[c] == y[c + p]) | ((c > 0) & (y[c - 1] == y[c + p - 1]))
    c, p = c[hit], p[hit]
    start, end = c - ranks.backward(c - 1, c - 1 + p), c + ranks.forward(c, c + p) + p
    long_enough = end - start >= np.maximum(min_length, exponent * p)
    out: dict[tuple[int, int], int] = {}
    for s, e, q in zip(start[long_enough].tolist(), end[long_enough].tolist(), p[long_enough].tolist()):
        out[s, e] = min(q, out.get((s, e), q))
    return out


def maximal_runs(x: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of all runs in an array of numbers, by start, then end."""
    if len(x) < min_length:
        return []
    ranks = Ranks(x)
    length, source = previous_factors(ranks)
    starts = parse(length)
    found = _touching(x, ranks, starts, min_length, exponent)
    if not found:  # the first occurrence of a run touches a start
        return []
    buckets: dict[int, list[tuple[int, int]]] = {}
    for (s, e), q in found.items():
        buckets.setdefault(s, []).append((e, q))
    order = sorted(buckets)
    sizes = np.diff(starts)
    wide = np.flatnonzero(sizes > min_length + 1)
    for b, size, q in zip(starts[wide].tolist(), sizes[wide].tolist(), source[starts[wide]].tolist()):
        k = bisect_right(order, q)
        # copies are put in behind the bucket that they come from, so a block that overlaps its source copies them on
        while k < len(order) and order[k] < q + size - min_length:
            for e, period in buckets[order[k]]:
                s = order[k] + b - q
                if e < q + size and (s, e + b - q) not in found:
                    found[s, e + b - q] = period
                    if s not in buckets:
                        buckets[s] = []
                        insort(order, s)
                    buckets[s].append((e + b - q, period))
            k += 1
    return sorted((s, e, q) for (s, e), q in found.items())


def pieces_of(words: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's words that may lie in a run, and the numbers of their pieces.

    ``words`` are numbers from 0. A piece is a stretch of at least ``min_length`` words of which each stands in it ``exponent`` times.
    """
    counts = np.bincount(words)
    at = np.flatnonzero(counts[words] >= exponent)
    piece = np.zeros(0, np.int64)
    while len(at):
        first = np.append(True, (np.diff(at) > 1) | (np.diff(piece) != 0) if len(piece) else np.diff(at) > 1)
        piece = np.cumsum(first) - 1
        key = piece * (words.max() + 1) + words[at]
        _, same, n = np.unique(key, return_inverse=True, return_counts=True)
        stay = (n[same] >= exponent) & (np.bincount(piece)[piece] >= min_length)
        if stay.all():
            break
        at, piece = at[stay], piece[stay]
    return at, piece


def _runs_of_texts(texts: list[np.ndarray], min_length: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of several texts, given as numbers of their words, as ``(start, length, period)`` by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

    def work() -> None:
        if not held:
            return
        numbers, owner, place, shift = [], [], [], 0
        for k, words, at, piece in held:
            # numbers of their own for each piece, so that nothing extends over its ends
            same = np.unique(piece * (words.max() + 1) + words[at], return_inverse=True)[1]
            numbers.append(same + shift)
            owner.append(np.full(len(at), k))
            place.append(at)
            shift += int(same.max()) + 1
        owner, place = np.concatenate(owner), np.concatenate(place)
        for s, e, q in maximal_runs(np.concatenate(numbers), min_length, exponent):
            out[owner[s]].append((int(place[s]), e - s, q))
        held.clear()

    size = 0
    for k, words in enumerate(texts):
        if len(words) < min_length:
            continue
        at, piece = pieces_of(words, min_length, exponent)
        if not len(at):
            continue
        if size + len(at) > GROUP_WORDS:
            work()
            size = 0
        held.append((k, words, at, piece))
        size += len(at)
    work()
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def numbers_of(words: list[bytes]) -> np.ndarray:
    """The same number for the same word, from 0 on."""
    return pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that any run has after its first period."""
    if not runs:
        return words
    inside = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        inside[start + period] += 1
        inside[start + length] -= 1
    covered = np.cumsum(inside)
    return [w for w, c in zip(words, covered.tolist()) if not c]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT, collapse: bool = True) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed_sha256, collapsed)`` of every row.

    ``runs`` are structs ``(start, length, period)`` in words, by start and period. ``collapsed`` is the text with one
    space between words, each run cut to its first period; it is null where the text has no run to cut, and always with
    ``collapse=False``. Its SHA-256 is given for every row.
    """

    def run(batches):
        for batch in batches:
            rows, size, at = [], 0, 0
            texts = batch.column(1)
            for k in range(batch.num_rows):
                words = (texts[k].as_py() or "").encode().split()  # bytes split at these six characters only
                rows.append(words)
                size += len(words)
                if size >= 4 * GROUP_WORDS or k + 1 == batch.num_rows:
                    found = _runs_of_texts([numbers_of(w) for w in rows], min_length, exponent)
                    joined = [b" ".join(kept_words(w, r)) for w, r in zip(rows, found)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(at, len(rows)),
                            pa.array([len(w) for w in rows], pa.int64()),
                            pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], _SPAN),
                            pa.array([hashlib.sha256(j).hexdigest() for j in joined], pa.string()),
                            pa.array([j.decode() if r and collapse else None for j, r in zip(joined, found)], pa.string()),
                        ],
                        ["doc_id", "n_words", "runs", "collapsed_sha256", "collapsed"],
                    )
                    rows, size, at = [], 0, k + 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_sha256 string, collapsed string")
