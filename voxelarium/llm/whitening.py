"""Whitening of embeddings by the eigenvectors of their covariance, which is summed in tiles of pairs of dimensions.

Entries are rounded down to multiples of ``1 / SCALE`` and held as integers ``x``. The statistics are those of the fit
list, each distinct vector once, so copies don't pull the axes to themselves. Its column blocks of ``TILE`` dimensions
are shuffled by row-block, the blocks of a row-block are centred and multiplied in pairs, the products are summed by tile,
first within a task and then over all, and the tiles make up the matrix that the driver decomposes.

A row-block holds ``BLOCK_VALUES`` numbers, a task one matrix of dimensions squared. To the driver come the sums by dimension
and the covariance; neither grows with the number of vectors.

Defined results: vectors that are null, empty or hold a null or non-finite entry are left out. The dimension is the most
frequent length (of ties the greatest), and vectors of other lengths are left out too. Entries beyond the range of a long
are its end. Every remaining row, a null id included, has its result; repeated rows have the same ones. A component
without variance (its eigenvalue is nothing but rounding) has null ``whitened``; where no component has any,
``identity_error`` is null. A ``deviation`` beyond a long is null. Without vectors the result is empty. Only id and vector are
read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE = 256
#: Dimensions of a column block, and numbers in a row-block.
TILE, BLOCK_VALUES = 32, 1 << 20
COMPONENTS = 4


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves; of the size of the dimensions alone. ``axes`` has a row a component."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """A row a vector; components without variance are NaN."""
        lively = self.values > np.finfo(float).eps * len(self.sums) * max(self.trace, 0.0)
        scale = np.where(lively, np.sqrt(np.where(lively, self.values, 1.0)), np.nan)
        return (x - self.mean) @ self.axes.T / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of ``(n * x - S) ** 2`` over the dimensions, exactly; None beyond a long."""
        bound = float(self.n) * np.abs(x).max(initial=0).astype(float) + max(map(abs, self.sums), default=0)
        if bound * bound * x.shape[1] < 2.0**62:
            z = self.n * x - np.array(self.sums, np.int64)
            return (z * z).sum(axis=1).tolist()
        exact = (sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist())
        return [v if v < 1 << 63 else None for v in exact]


def _integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _sums(batches):
    for b in batches:
        x = _matrix(b.column(0))
        if not len(x):
            continue
        safe = np.abs(x.astype(float)).sum(axis=0).max(initial=0) < 2.0**62
        sums = x.sum(axis=0).tolist() if safe else [sum(c) for c in x.T.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([sums], pa.list_(pa.decimal128(38, 0)))], ["n", "sums"])


def _blocks(tile: int, values: int):
    """Splits batches into row-blocks and those into column blocks, of the smallest integers that hold them."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for b in batches:
            x = _matrix(b.column(0))
            rows = max(1, values // max(1, x.shape[1]))
            for at in range(0, len(x), rows):
                some = x[at : at + rows]
                kind = next(k for k in ("i1", "i2", "i4", "i8") if np.iinfo(k).min <= some.min() and some.max() <= np.iinfo(k).max)
                parts = [some[:, c : c + tile].astype(kind).tobytes() for c in range(0, some.shape[1], tile)]
                m = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * m, pa.int64()), pa.array(range(m), pa.int32()), pa.array([len(some)] * m, pa.int32()), pa.array([kind] * m, pa.string()), pa.array(parts, pa.binary())],
                    ["row_block", "column_block", "rows", "kind", "numbers"],
                )
                block += 1

    return run


def _products(mean: np.ndarray, tile: int):
    """Sums the products of the column blocks of each row-block; they come sorted by row-block, then column block."""
    blocks = -(-len(mean) // tile)

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        held: list[np.ndarray] = []
        for batch in batches:
            for part, rows, kind, numbers in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                x = np.frombuffer(numbers, kind).reshape(rows, -1).astype(float)
                held.append(x - mean[part * tile : (part + 1) * tile])
                if part == blocks - 1:
                    for a in range(blocks):
                        for b in range(a, blocks):
                            product = held[a].T @ held[b]
                            sums[a, b] = sums[a, b] + product if (a, b) in sums else product
                    held = []
        for (a, b), s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([s.ravel()], pa.list_(pa.float64()))], ["a", "b", "sums"])

    return run


def _projected(model: Whitening):
    def run(batches):
        kind = pa.list_(pa.float64())
        for b in batches:
            x = _matrix(b.column(0))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(list(model.whitened(x)), kind)], ["w"])

    return run


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, tile: int = TILE, block_values: int = BLOCK_VALUES) -> Whitening | None:
    """The whitening of the distinct vectors; None without any."""
    vector = F.col(vector_col)
    found = vectors.where(_valid(vector)).groupBy(F.size(vector).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if found is None:
        return None
    distinct = vectors.where(_valid(vector) & (F.size(vector) == found.dims)).select(_integers(vector).alias("x")).distinct()
    listed = materialize(distinct, "fit-list")
    totals = materialize(listed.mapInArrow(_sums, "n long, sums array<decimal(38,0)>"), "sums")
    n = totals.agg(F.sum("n")).first()[0]
    each = totals.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"))
    sums = tuple(int(r.s) for r in sorted(each.collect()))
    model = Whitening(n, sums, np.zeros(0), np.zeros((0, len(sums))), 0.0)

    blocks = listed.mapInArrow(_blocks(tile, block_values), "row_block long, column_block int, rows int, kind string, numbers binary")
    dealt = blocks.repartition("row_block").sortWithinPartitions("row_block", "column_block")
    tiles = dealt.mapInArrow(_products(model.mean, tile), "a int, b int, sums array<double>")
    tiles = tiles.select("a", "b", F.posexplode("sums").alias("at", "s")).groupBy("a", "b", "at").agg(F.sum("s").alias("s"))
    cov = np.zeros((len(sums), len(sums)))
    for (a, b), g in tiles.toPandas().groupby(["a", "b"]):
        wide = min(tile, len(sums) - b * tile)
        i, j = a * tile + g["at"].to_numpy() // wide, b * tile + g["at"].to_numpy() % wide
        cov[i, j] = cov[j, i] = g["s"].to_numpy() / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    model = Whitening(n, sums, values[order], axes[:, order].T, float(np.trace(cov)))

    lively = np.flatnonzero(np.isfinite(model.whitened(np.zeros((1, len(sums))))[0])).tolist()
    if not lively:
        return model
    w = listed.mapInArrow(_projected(model), "w array<double>")
    pairs = [(i, j) for i in lively for j in lively if i <= j]
    found = w.agg(*(F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs)).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs))
    return Whitening(n, sums, model.values, model.axes, model.trace, float(error))


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row for each vector and component."""
    if model is None:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    dims, k = len(model.sums), len(model.values)
    explained = [v / model.trace if model.trace > 0 else None for v in model.values.tolist()]

    def run(batches):
        for b in batches:
            x, m = _matrix(b.column(1)), b.num_rows
            if not m:
                continue
            w = model.whitened(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(w, pa.float64(), mask=~np.isfinite(w)),
                    pa.array(explained * m, pa.float64()),
                    pa.array([model.identity_error] * (m * k), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    vector = F.col(vector_col)
    rows = vectors.where(_valid(vector) & (F.size(vector) == dims)).select(F.col(id_col).cast("long").alias("vec_id"), _integers(vector).alias("x"))
    return rows.mapInArrow(run, _RESULT)
