"""SimHash near-duplicate detection with pigeonring filtering.

A fingerprint has 64 bits; two documents link when theirs differ in at most ``max_distance`` bits. The bits
are cut into ``max_distance + 1`` consecutive segments that form a ring. If two fingerprints link, some
segment starts a chain along the ring whose first l segments together differ in at most
``floor(l * max_distance / (max_distance + 1)) = l - 1`` bits, for every l. So the first segment of the chain
is equal and the second differs in one bit at most. That pair of segments is the key of the candidate
search. Each longer prefix of the chain drops the candidates over its budget before the next is counted, and the whole
ring is the full Hamming check.

Equal fingerprints are one node from the start, so copies are never expanded. A key that very many different
fingerprints share is refined by the third segment of the chain, within whose budget of two bits any two have a value
in common at one bit from each; so keys grow by a segment where the table has outgrown two. What is crowded even then
(a dense group of near copies) is cut into chunks, and each pair of chunks is a cell of its own. Within a cell only
the links of a spanning forest come out, never all pairs.

Defined results: null and empty texts have fingerprint 0 and link like any other. Repeated rows give a row
each. A null id stays null in its row and is never the smallest of a component that has an id. An empty table
gives an empty table. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import components

BITS = 64
#: Different fingerprints of one key that are compared in one task; keys with more are cut.
CHUNK = 4096
#: The place of a chain's start in a key, above the bits of any two segments.
_START = 56
#: Groups up to this size are compared by shifted arrays, larger ones by breadth-first search.
_SMALL = 12
#: Bytes of a text that are split into words at once, so that very long texts stay bounded.
_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _hashes(text: bytes | None, width: int):
    """Arrays of the hashes of all shingles; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    text = text or b""
    carried, at, some = [], 0, False
    while at < len(text):
        found = _SPACE.search(text, at + _PIECE)
        end = found.start() if found else len(text)
        words = carried + text[at:end].lower().split()
        at = end
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            last = len(words) - width + 1
            yield np.fromiter([digest(joined[s:e], 42) for s, e in zip(starts[:last].tolist(), ends[width - 1 :].tolist())], np.uint64, last)
            some = True
            carried = words[-(width - 1) :] if width > 1 else []
        else:
            carried = words
    if carried and not some:
        yield np.array([digest(b" ".join(carried), 42)], np.uint64)


def _lane(h: np.ndarray, n: int) -> np.ndarray:
    """The hashes of lane ``n``: those themselves, then mixtures of them that are as good as independent."""
    if n:
        h = h + np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def _majority(text: bytes | None, width: int, lanes: int) -> np.ndarray:
    """Lanes of 64 bits, each bit set if it is in over half of the shingles' hashes."""
    ones, total = np.zeros(BITS * lanes, np.int64), 0
    for hashes in _hashes(text, width):
        total += len(hashes)
        for k in range(0, len(hashes), 8192):
            some = np.stack([_lane(hashes[k : k + 8192], n) for n in range(lanes)], axis=1)
            ones += np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > total, bitorder="little")


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The signed 64-bit fingerprint of a text in UTF-8."""
    return int(_majority(text, width, 1).view(np.int64)[0])


def fingerprints(documents: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp)`` of every row; ``text_hash`` tells rows with the same id apart."""

    def run(batches):
        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            fps = pa.array([fingerprint(t, width) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps], ["doc_id", "text_hash", "fp"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def segments(max_distance: int) -> list[tuple[int, int]]:
    """``(offset, width)`` of the segments of the ring."""
    m = max(3, max_distance + 1)
    ends = [round(BITS * k / m) for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _bits(fp: Column, segment: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, segment[0]).bitwiseAND(F.lit((1 << segment[1]) - 1))


def chain_keys(fp: Column, max_distance: int) -> Column:
    """The search keys of a fingerprint: one or as many as a segment has bits, for each start of a chain.

    A key is the start, its segment, and a second segment of even parity. A second segment of odd parity
    is given by all its neighbours at one bit, so two that differ in one bit at most always share a key.
    """
    ring, arrays = segments(max_distance), []
    for i, first in enumerate(ring):
        second = ring[(i + 1) % len(ring)]
        follow = _bits(fp, second)
        key = F.shiftleft(_bits(fp, first), second[1]).bitwiseOR(follow).bitwiseOR(F.lit(i << _START).cast("long"))
        near = F.array(*[key.bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(second[1])])
        arrays.append(F.when(F.bit_count(follow) % 2 == 0, F.array(key)).otherwise(near))
    return F.flatten(F.array(*arrays))


def third_values(fp: Column, key: Column, max_distance: int) -> Column:
    """The values of the third segment of a key's chain that a fingerprint is met at: its own and all at one bit."""
    ring, out = segments(max_distance), None
    for i in range(len(ring)):
        third = ring[(i + 2) % len(ring)]
        own = _bits(fp, third)
        ball = F.array(own, *[own.bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(third[1])])
        here = F.shiftright(key, _START) == i
        out = F.when(here, ball) if out is None else out.when(here, ball)
    return out


def _chain_survivors(x: np.ndarray, start: np.ndarray, max_distance: int) -> np.ndarray:
    """Where the differing bits ``x`` keep every budget of the chain from segment ``start``; prefix by prefix, on what is left."""
    ring = segments(max_distance)
    offset, mask = np.array([o for o, _ in ring], np.uint64), np.array([(1 << w) - 1 for _, w in ring], np.uint64)
    left, total = np.arange(len(x)), np.zeros(len(x), np.uint8)
    for step in range(len(ring)):
        at = (start + step) % len(ring)
        total += np.bitwise_count((x >> offset[at]) & mask[at])
        holds = total <= min(step, max_distance)
        left, x, start, total = left[holds], x[holds], start[holds], total[holds]
        if not len(left):
            break
    return left


def _forest(fps: np.ndarray, start: int, max_distance: int) -> list[tuple[int, int]]:
    """Links that join all linked fingerprints of a cell, by breadth-first search over those not yet reached."""
    left, links = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = np.zeros(len(left), bool)
            near[_chain_survivors(left ^ u, np.full(len(left), start), max_distance)] = True
            if near.any():
                links += [(u, v) for v in left[near]]
                queue += list(left[near])
                left = left[~near]
    return links


def _links_in_cells(max_distance: int):
    def run(batches):
        carried = None
        for b in batches:
            cols = [np.asarray(b.column(k)) for k in range(5)]
            if carried is not None:
                cols = [np.concatenate(x) for x in zip(carried, cols)]
            key, fp = cols[0], cols[4]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            cut = new[-1] if len(new) else 0
            carried = [x[cut:] for x in cols]
            yield from emit(key[:cut], fp[:cut], new[:-1])
        if carried is not None:
            yield from emit(carried[0], carried[4], np.zeros(0, np.int64))

    def emit(key, fp, new):
        if not len(key):
            return
        u = fp.view(np.uint64)
        bounds = np.concatenate(([0], new, [len(key)]))
        sizes = np.diff(bounds)
        left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        small = np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
        run_of = np.repeat(np.arange(len(sizes)), sizes)
        start = key >> _START
        for d in range(1, _SMALL):
            at = np.flatnonzero(small[:-d] & (run_of[:-d] == run_of[d:])) if len(key) > d else np.zeros(0, np.int64)
            if not len(at):
                break
            at = at[_chain_survivors(u[at] ^ u[at + d], start[at], max_distance)]
            left.append(u[at])
            right.append(u[at + d])
        for r in np.flatnonzero(sizes > _SMALL):
            s = bounds[r]
            links = _forest(u[s : bounds[r + 1]], int(start[s]), max_distance)
            if links:
                x = np.array(links, np.uint64)
                left.append(x[:, 0])
                right.append(x[:, 1])
        x, y = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["u", "v"])

    return run


def links(distinct: DataFrame, max_distance: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Links ``(u, v)`` between different fingerprints ``fp`` that join the same components as all links do."""
    # a row has some thirty keys, so rows are dealt by number before; adaptive execution would put these small ones together
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = distinct.select("fp").repartition(tasks, F.xxhash64("fp")).select("fp", F.explode(chain_keys(F.col("fp"), max_distance)).alias("key"))
    crowded = keys.groupBy("key").count().where(F.col("count") > chunk).select("key")
    plain = keys.join(crowded, "key", "left_anti").select("key", F.lit(-1).cast("long").alias("third"), F.lit(0).alias("a"), F.lit(0).alias("b"), "fp")
    wide = keys.join(crowded, "key", "left_semi").select("key", F.explode(third_values(F.col("fp"), F.col("key"), max_distance)).alias("third"), "fp")
    dense = wide.groupBy("key", "third").count().where(F.col("count") > chunk)
    chunks = F.coalesce(F.ceil(F.col("count") / chunk), F.lit(1)).cast("int")
    cells = (
        wide.join(dense, ["key", "third"], "left")
        .select("key", "third", "fp", chunks.alias("chunks"))
        .select("key", "third", "fp", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("key", "third", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    )
    order = ["key", "third", "a", "b"]
    dealt = plain.union(cells).repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_links_in_cells(max_distance), "u long, v long").distinct()


def near_duplicates(
    documents: DataFrame, width: int = 4, max_distance: int = 4, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, text_hash, fp, component, component_id)`` of every row.

    ``component`` is the smallest fingerprint that links reach, ``component_id`` the smallest id among its rows.
    """
    rows = materialize(fingerprints(documents, width, id_col, text_col), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    roots = components(links(distinct, max_distance, chunk))
    placed = distinct.join(roots, distinct.fp == roots.u, "left").select("fp", "doc_id", F.coalesce("v", "fp").alias("component"))
    placed = materialize(placed, "placed")
    # written before it is joined, so that adaptive execution can split the rows of a large component
    named = materialize(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "named")
    return rows.join(placed.join(named, "component").select("fp", "component", "component_id"), "fp").select(
        "doc_id", "text_hash", "fp", "component", "component_id"
    )


def _keep(documents: DataFrame, stay: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``documents`` whose id and text hash are in ``stay``, repeated rows once."""
    own = {"__null": F.col(id_col).isNull(), "__id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__hash": F.xxhash64(text_col)}
    keys = list(own)
    at = stay.select(F.col("doc_id").isNull().alias("__null"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("text_hash").alias("__hash"))
    # one exchange serves the join and the removal of repeated rows
    return documents.withColumns(own).join(at, keys, "left_semi").dropDuplicates(keys).select(*documents.columns)


def keep_one_of_each(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` less all but one of each component: that of the smallest id.

    Ids that are null come last, ties go to the smaller hash of the text, and repeated rows stay once.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = near_duplicates(documents, **options)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("x"))
    return _keep(documents, materialize(first.select("x.doc_id", "x.text_hash"), "stay"), id_col, text_col)


# Similarity of shingle sets. A share of differing bits tells it, but within 64 bits a similarity of 0.8 is ten bits with a
# deviation of three, and ten bits in 64 leave no segment that is mostly equal. So the ring is made longer instead.

#: 64-bit lanes of a wide fingerprint, and the bits of a segment: 48 segments in all.
LANES, SEGMENT = 12, 16
#: Bits that a chain may be over its proportional budget, as chains start at segments that are equal and at no others.
SLACK = 4
#: How far below the similarity asked for an estimate still counts: somewhat less than its deviation of 0.03, so that most
#: pairs right at the bound are met.
MARGIN = 0.02


def distance_of(similarity: float, bits: int) -> int:
    """The bits in which two texts of this share of common shingles differ on average, if they are about as long."""
    return int(bits * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _chains_hold(a: np.ndarray, b: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Where the rings ``a`` and ``b`` keep every budget of the chain from segment ``start``; prefix by prefix, on what is left."""
    m = a.shape[1]
    left, total = np.arange(len(a)), np.zeros(len(a), np.int64)
    for step in range(m):
        at = (start[left] + step) % m
        total = total + np.bitwise_count(a[left, at] ^ b[left, at])
        holds = total <= min((step + 1) * distance / m + SLACK, distance)
        left, total = left[holds], total[holds]
        if not len(left):
            break
    return left


def _similar_in_cells(distance: int):
    """Links within runs of equal ``start`` and ``value``, ``a`` and ``b``: all of small runs, spanning forests of larger ones."""

    def linked(ring: np.ndarray, node: np.ndarray, start: int):
        left = np.arange(len(node))
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                u = queue.pop()
                holds = np.zeros(len(left), bool)
                holds[_chains_hold(np.broadcast_to(ring[u], (len(left), ring.shape[1])), ring[left], np.full(len(left), start), distance)] = True
                near = left[holds]
                yield np.full(len(near), node[u]), node[near]
                queue += near.tolist()
                left = left[~holds]

    def emit(cols, ring):
        place, node, start = cols[:4], cols[4], cols[0]
        new = np.flatnonzero(np.any(place[:, 1:] != place[:, :-1], axis=0)) + 1
        bounds = np.concatenate(([0], new, [len(node)]))
        sizes = np.diff(bounds)
        run_of, small = np.repeat(np.arange(len(sizes)), sizes), np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
        out = []
        for d in range(1, min(_SMALL, len(node))):
            at = np.flatnonzero(small[:-d] & (run_of[:-d] == run_of[d:]))
            for k in range(0, len(at), 1 << 16):
                some = at[k : k + (1 << 16)]
                some = some[_chains_hold(ring[some], ring[some + d], start[some], distance)]
                out.append((node[some], node[some + d]))
        for r in np.flatnonzero(sizes > _SMALL):
            here = slice(bounds[r], bounds[r + 1])
            out += linked(ring[here], node[here], int(start[bounds[r]]))
        x, y = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*out) if out else ((), ())))
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["u", "v"])

    def run(batches):
        held = None
        for batch in batches:
            cols = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(5)])
            ring = np.frombuffer(batch.column(5).cast(pa.binary(8 * LANES)).buffers()[1], np.uint16)[: batch.num_rows * 4 * LANES].reshape(batch.num_rows, -1)
            if held is not None:
                cols, ring = np.concatenate([held[0], cols], axis=1), np.concatenate([held[1], ring])
            new = np.flatnonzero(np.any(cols[:4, 1:] != cols[:4, :-1], axis=0)) + 1
            cut = new[-1] if len(new) else 0
            if cut:
                yield from emit(cols[:, :cut], ring[:cut])
            held = cols[:, cut:], ring[cut:]
        if held is not None and held[0].shape[1]:
            yield from emit(*held)

    return run


def similar_links(nodes: DataFrame, similarity: float = 0.8, chunk: int = CHUNK) -> DataFrame:
    """Links ``(u, v)`` between nodes ``(node, fp)`` whose wide fingerprints tell at least this similarity.

    Two such fingerprints nearly always have an equal segment, which is the key of the search; from there the chain of the
    next segments must keep its budgets, and the whole ring is the Hamming check.
    """
    distance = distance_of(similarity - MARGIN, BITS * LANES)

    def segments_of(batches):
        for b in batches:
            ring = np.frombuffer(b.column(1).cast(pa.binary(8 * LANES)).buffers()[1], np.uint16)[: b.num_rows * 4 * LANES]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ring) + 1, 4 * LANES, dtype=np.int32)), pa.array(ring.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["node", "fp", "ring"])

    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rings = materialize(nodes.select("node", "fp").repartition(tasks, F.xxhash64("node")).mapInArrow(segments_of, "node long, fp binary, ring array<int>"), "rings")
    keys = rings.select("node", "fp", F.posexplode("ring").alias("start", "value"))
    crowded = keys.groupBy("start", "value").count().where(F.col("count") > chunk)
    crowded = materialize(crowded.select("start", "value", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "crowded")
    chunks = F.coalesce("chunks", F.lit(1))
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    cells = (
        keys.join(crowded, ["start", "value"], "left")
        .select("start", "value", "node", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .select("start", "value", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "fp")
    )
    order = ["start", "value", "a", "b"]
    return cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(_similar_in_cells(distance), "u long, v long").distinct()


def keep_one_of_similar(documents: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` less all but one of each group of texts that links of this similarity of shingles join.

    The similarity is the one that wide fingerprints tell, with a deviation of some 0.03 and less ``MARGIN``. Which row stays, and what is
    defined for nulls, repeated rows and empty tables, is as in ``keep_one_of_each``; texts without words are one group.
    """

    def run(batches):
        for b in batches:
            fps = [_majority(t, width, LANES).tobytes() for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.binary())], ["doc_id", "text_hash", "fp"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, text_hash long, fp binary")
    place = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("x")
    nodes = materialize(rows.groupBy("fp").agg(place).select(F.monotonically_increasing_id().alias("node"), "fp", "x"), "nodes")
    roots = components(similar_links(nodes, similarity))
    placed = nodes.join(roots, nodes.node == roots.u, "left").select("x", F.coalesce("v", "node").alias("component"))
    first = placed.groupBy("component").agg(F.min("x").alias("x"))
    return _keep(documents, materialize(first.select("x.doc_id", "x.text_hash"), "stay"), id_col, text_col)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
