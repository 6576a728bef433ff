"""Nearest neighbours by inner product: cross-polytope hashing with multiprobe tables and exact reranking.

The largest inner product is the nearest angle once every vector is set on a sphere: x / M gets one more
coordinate, sqrt(1 - |x|^2 / M^2) with M the largest norm, and a query gets 0 there. That coordinate tells nothing of a
vector's direction, so vectors whose norms differ by more than ``RATIO`` lie in ranges of their own, each with its own M, its
own tables and its own number of buckets, and a query probes every range. A hash flips signs and applies
the fast Hadamard transform three times, a pseudo-rotation, and gives the signed axis nearest to the result. A table's
key is made of as many hashes as the table of vectors needs for buckets of about ``OCCUPANCY``; the last hash looks at
the first few axes only. So keys grow with the logarithm of the table. A query scores every key by the sum of its
hashes' coordinates and goes through the best of them: ``PROBE_RATE`` times the root of the number of buckets, at
least ``LEAST_PROBES``. The share of the table that a query is multiplied with falls with the root of its size.

Equal vectors are searched once. For any query no more than the ``k + 1`` smallest ids of them can be among the
nearest, so a class of equal vectors carries those only; queries that are equal share a search as well. Nothing is lost
by that, and copies can't crowd a bucket.

Buckets that follow each other are searched together as a cell of about ``CELL_VECTORS`` or ``CELL_BYTES``. A cell that holds more is cut
by a hash of the class, and its queries go to all parts. A task holds the vectors of one part and streams its queries
past them, ``CELL_QUERIES`` at a time; only vectors of buckets that a query probes are multiplied with it. Inner
products are exact, in double precision, and summed one way everywhere; the best of all cells are kept.

Work: of n vectors of equal norm a query is multiplied with some n^0.5, so all queries of a share of the table with n^1.5;
every further range of norms adds probes of its own.

To the driver come the dimension and, of each range (some 15,000 at most, as doubles go), its classes and largest norm.

Defined results: vectors that are null, zero or hold a null or non-finite component take no part, nor do rows with
a null id. Shorter vectors count as filled up with zeros. Rows that repeat an id and a vector are one. Ties go to the
smaller id. Without vectors or queries the result is empty. Only id and vector are read, so other columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TABLES = 16
#: Vectors to a bucket, which sets the number of hashes in a key.
OCCUPANCY = 8
#: The largest norm of a range over its smallest.
RATIO = 1.1
#: Buckets that a query probes in a table: at least so many, and this multiple of the root of their number.
LEAST_PROBES, PROBE_RATE = 8, 0.7
SEED = 7
#: A cell's vectors, in number and in bytes of double precision, and the queries that pass them at once.
CELL_VECTORS, CELL_BYTES, CELL_QUERIES = 65536, 32 << 20, 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    y = np.array(x.T, order="C")
    n, step = len(y), 1
    while step < n:
        pairs = y.reshape(-1, 2, step, y.shape[1])
        low, high = pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]
        pairs[:, 0], pairs[:, 1] = low, high
        step *= 2
    return y.T / np.sqrt(n)


def signs(seed: int, tables: int, width: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, 3, width))


def rotate(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    for s in flips:
        x = hadamard(x * s)
    return x


def on_sphere(x: np.ndarray, width: int, norm: float | None) -> np.ndarray:
    """Vectors scaled by the largest norm with the coordinate that makes them unit; queries (no norm) have 0 there."""
    out = np.zeros((len(x), width))
    if norm is None:
        out[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    else:
        out[:, : x.shape[1]] = x / norm
        out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (out * out).sum(axis=1)))
    return out


def axes_of(vectors: int, width: int, occupancy: int = OCCUPANCY) -> list[int]:
    """The number of axes that each hash of a key looks at."""
    buckets, out = max(2.0, vectors / occupancy), []
    while buckets > 2 * width:
        out.append(width)
        buckets /= 2 * width
    return [*out, max(1, round(buckets / 2))]


def keys_of(x: np.ndarray, flips: np.ndarray, axes: list[int]) -> np.ndarray:
    """The bucket of each row in one table: the signed axes of its hashes as the digits of a number."""
    out = np.zeros(len(x), np.int64)
    for f, n in zip(flips, axes):
        turned = rotate(x, f)[:, :n]
        axis = np.abs(turned).argmax(axis=1)
        out = out * (2 * n) + 2 * axis + (turned[np.arange(len(x)), axis] < 0)
    return out


def probes_of(x: np.ndarray, flips: np.ndarray, axes: list[int], probes: int) -> np.ndarray:
    """The best ``probes`` buckets of each row, by the sum of its coordinates on their axes.

    After each hash the best so far are kept. That loses none: of the buckets before a prefix in rank, each goes on
    to as many better ones.
    """
    score, key = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for f, n in zip(flips, axes):
        turned = rotate(x, f)[:, :n]
        own = np.stack([turned, -turned], axis=2).reshape(len(x), 1, -1)
        score = (score[:, :, None] + own).reshape(len(x), -1)
        key = (key[:, :, None] * (2 * n) + np.arange(2 * n)).reshape(len(x), -1)
        if score.shape[1] > probes:
            best = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
            score, key = np.take_along_axis(score, best, axis=1), np.take_along_axis(key, best, axis=1)
    return np.sort(key, axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


class _Cell:
    """The vectors of one part of a cell, in the order of their buckets."""

    def __init__(self, buckets: np.ndarray, classes: np.ndarray, firsts: np.ndarray, x: np.ndarray):
        order = np.argsort(buckets, kind="stable")
        self.buckets, self.classes, self.firsts, self.x = buckets[order], classes[order], firsts[order], x[order]

    def search(self, asked: np.ndarray, counts: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(row of q, class, its first id, score)`` of the best ``k`` of each query; ``asked`` has ``counts`` buckets for each."""
        low, high = np.searchsorted(self.buckets, asked, "left"), np.searchsorted(self.buckets, asked, "right")
        many = high - low
        rows = np.repeat(np.repeat(np.arange(len(q)), counts), many)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        score = np.empty(len(rows))
        for s in range(0, len(rows), 1 << 15):
            e = s + (1 << 15)
            score[s:e] = (self.x[at[s:e]] * q[rows[s:e]]).sum(axis=1)
        order = np.lexsort((self.firsts[at], -score, rows))
        rows, at, score = rows[order], at[order], score[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        best = nth < k
        return rows[best], self.classes[at[best]], self.firsts[at[best]], score[best]


def _search_cells(k: int, dim: int):
    """Rows come sorted by cell, the vectors of a cell before its queries."""

    def run(batches):
        here, held, cell = None, [], None
        for b in batches:
            place = np.stack([np.asarray(b.column(n)).astype(np.int64) for n in ("t", "g", "c")], axis=1)
            asks = np.asarray(b.column("asks"))
            new = np.flatnonzero(np.any(place[1:] != place[:-1], axis=1) | (asks[1:] != asks[:-1])) + 1
            for start, end in zip([0, *new], [*new, b.num_rows]):
                if here is None or (place[start] != here).any():
                    here, held, cell = place[start], [], None
                for at in range(start, end, CELL_QUERIES) if asks[start] else [start]:
                    some = b.slice(at, min(end, at + CELL_QUERIES) - at if asks[start] else end - start)
                    classes, x = np.asarray(some.column("class")), _matrix(some.column("v"), dim)
                    if not asks[start]:
                        held.append((np.asarray(some.column("b").flatten()), classes, np.asarray(some.column("first")), x))
                        continue
                    if held:
                        cell, held = _Cell(*[np.concatenate(c) for c in zip(*held)]), []
                    if cell is not None:
                        counts = np.asarray(some.column("b").value_lengths())
                        rows, found, first, score = cell.search(np.asarray(some.column("b").flatten()), counts, x, k)
                        if len(rows):
                            yield pa.RecordBatch.from_pydict({"query": classes[rows], "class": found, "first": first, "score": score})

    return run


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int = LEAST_PROBES, least: int = 0, seed: int = SEED,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each row for which ``is_query`` holds, the ``k`` nearest of all other rows.

    ``probes`` buckets of a table are probed at least, and as many as hold ``least`` vectors on average.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[vector_col]
    v = F.col(vector_col) if kind == "array<float>" else F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    valid = vectors.where(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
    plain = valid.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    dim, square = valid.agg(F.max(F.size(vector_col)), F.max(square)).first()
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    zero = F.lit(0.0).cast("float" if kind == "array<float>" else "double")
    # adding 0 makes -0 and 0 one
    filled = plain.withColumn("v", F.transform(F.concat("v", F.array_repeat(zero, F.lit(dim) - F.size("v"))), lambda x: x + zero))
    element = "float" if kind == "array<float>" else "double"
    width = 1 << dim.bit_length()  # a power of two with room for one more coordinate

    length2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    smallest = filled.select("vec_id", "v").distinct().withColumn("nth", place).where(F.col("nth") <= k + 1)
    classes = smallest.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = classes.select(F.monotonically_increasing_id().alias("class"), "v", "ids", F.greatest(length2, F.lit(5e-324)).alias("square"))
    span = F.floor((F.log(F.lit(max(square, 5e-324))) - F.log("square")) / (2 * math.log(RATIO)))
    classes = materialize(classes.withColumn("span", F.greatest(F.lit(0), span).cast("int")), "classes")
    ranges = sorted(classes.groupBy("span").agg(F.count("*").alias("n"), F.max("square").alias("square")).collect())
    places = {r.span: j for j, r in enumerate(ranges)}
    axes = [axes_of(r.n, width) for r in ranges]
    buckets = [int(np.prod([2 * n for n in a], dtype=object)) for a in axes]
    often = [min(m, max(probes, -(-least // OCCUPANCY), int(np.ceil(PROBE_RATE * np.sqrt(m))))) for m in buckets]
    deepest = max(map(len, axes))
    flips = signs(seed, tables * deepest, width).reshape(tables, deepest, 3, width)
    cell = max(1, min(CELL_VECTORS, CELL_BYTES // (8 * dim)))
    per_cell = max(1, cell // OCCUPANCY)

    asked = materialize(filled.where("asks").select("vec_id", "v").distinct().join(classes.select("class", "v"), "v").select("vec_id", "class"), "asked")

    def code(batches):
        for b in batches:
            every, span = _matrix(b.column("v"), dim), np.asarray(b.column("span"))
            codes = np.zeros((b.num_rows, tables), np.int64)
            for r in np.unique(span).tolist():
                rows, a = np.flatnonzero(span == r), axes[places[r]]
                for at in range(0, len(rows), 1024):
                    some = rows[at : at + 1024]
                    x = on_sphere(every[some], width, float(np.sqrt(ranges[places[r]].square)))
                    codes[some] = np.stack([keys_of(x, f[: len(a)], a) for f in flips], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("class"), b.column("first"), b.column("v"), b.column("span"), lists], ["class", "first", "v", "span", "codes"])

    coded = classes.select("class", F.col("ids")[0].alias("first"), "v", "span").mapInArrow(code, f"class long, first long, v array<{element}>, span int, codes array<long>")
    coded = materialize(coded, "coded")

    def ask(batches):
        for b in batches:
            for start in range(0, b.num_rows, 64):
                some = b.slice(start, 64)
                x = on_sphere(_matrix(some.column("v"), dim), width, None)
                for t in range(len(ranges) * tables):
                    a = axes[t // tables]
                    key = probes_of(x, flips[t % tables][: len(a)], a, often[t // tables])
                    row, flat = np.repeat(np.arange(len(x)), key.shape[1]), key.ravel()
                    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (flat[1:] // per_cell != flat[:-1] // per_cell)])
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(flat)].astype(np.int32)), pa.array(flat))
                    rows = pa.array(row[new])
                    yield pa.RecordBatch.from_pydict(
                        {"t": np.full(len(new), t, np.int32), "g": flat[new] // per_cell, "class": some.column("class").take(rows), "b": lists, "v": some.column("v").take(rows)}
                    )

    questions = coded.join(asked.select("class").distinct(), "class", "left_semi").select("class", "v")
    probing = questions.mapInArrow(ask, f"t int, g long, class long, b array<long>, v array<{element}>")

    # the tables of each range have numbers of their own
    base = F.create_map(*[F.lit(x) for r, j in places.items() for x in (r, j * tables)])[F.col("span")]
    coordinates = F.posexplode("codes").alias("nth", "key")
    placed = coded.select("class", "first", "v", "span", coordinates).withColumn("t", (base + F.col("nth")).cast("int")).select("t", F.floor(F.col("key") / per_cell).alias("g"), "class", "first", F.array("key").alias("b"), "v")
    crowded = placed.groupBy("t", "g").count().where(F.col("count") > 2 * cell)
    crowded = materialize(crowded.select("t", "g", F.ceil(F.col("count") / cell).cast("int").alias("cuts")), "crowded")
    cuts = F.coalesce("cuts", F.lit(1))
    columns = ["t", "g", "c", "asks", "class", "first", "b", "v"]
    own = F.pmod(F.xxhash64("class"), cuts).cast("int")
    offered = placed.join(crowded, ["t", "g"], "left").withColumns({"c": own, "asks": F.lit(False)}).select(*columns)
    every = F.explode(F.sequence(F.lit(0), cuts - 1))
    wanted = probing.join(crowded, ["t", "g"], "left").withColumns({"c": every, "asks": F.lit(True), "first": F.lit(0).cast("long")}).select(*columns)
    order = ["t", "g", "c", "asks"]
    dealt = offered.union(wanted).repartition("t", "g", "c").sortWithinPartitions(*order)
    found = dealt.mapInArrow(_search_cells(k + 1, dim), "query long, class long, first long, score double").distinct()
    # a class whose smallest id is not among the nearest has none among them
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first"))
    found = found.withColumn("nth", nth).where(F.col("nth") <= k + 1)

    named = found.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = named.distinct().withColumn("rank", rank).where(F.col("rank") <= k + 1)
    listed = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
    listed = materialize(listed.withColumnRenamed("query", "class"), "listed")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asked.withColumnRenamed("vec_id", "query_id").join(listed, "class").select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
