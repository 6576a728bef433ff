"""Mixing sources to target weights by subset-sum budget fitting.

Sources, ordered by code point with null last, weigh 1, 2, 3, repeating. They share the total size by weight;
no target exceeds ``max_repeat`` times its source's size, and what is cut off goes to the others by weight.
A source is taken whole as often as its target allows. For the rest of its budget the documents are counted by
exact size, and a bounded knapsack by dynamic programming says how many of each size to take once more: the best
sum there is. It decides the last ``KNAPSACK_WORDS`` words, or ``SPAN`` times the longest document that fits if that is
more, and what a budget has beyond them is taken in proportion from every size. Where that misses the budget (few sizes, most of them
taken), what is taken is exchanged for the best sum, which is never more than twice the longest document's number of
exchanges away (``exchange``). The
documents of each size are those of the smallest seeded hashes.

Only counts per (source, size) reach the planning step, one source to a task. Hot sizes are dealt into buckets by
their hash, about as many as the root of their number, so no task ranks more than that. Sources are numbered by
ranges, and the level of the targets is found by sums over all sources, so they may be many.

Defined results: null and empty texts have size 0 and are never taken. Rows that repeat id and text are documents
of their own here. A null source is a source. An empty table, or one of empty texts, gives targets of 0. Only id,
text and source are read; other columns may have any name. A very long document is taken where it still fits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, words_of

SEED = 20240601
MAX_REPEAT = 3
#: Words that the dynamic programme decides: so many, or so many times the longest document that fits.
KNAPSACK_WORDS, SPAN = 1 << 16, 16


def targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``(source, source_no, source_size, target)`` from ``(source, source_size)``, one row per source.

    With weights w and caps c, the targets are min(c, level * w) for the one level that spends the total. The level
    is shared anew among those below their caps until none is above; it only rises, so no cap is left again.
    """
    ranked = numbered(sizes.select("source", "source_size"), "source_no", F.col("source").isNull(), F.col("source"))
    w, cap = ((F.col("source_no") - 1) % 3 + 1).cast("double"), F.col("source_size") * float(max_repeat)
    weighed = ranked.select("source", F.col("source_no").cast("int").alias("source_no"), "source_size", w.alias("w"), cap.alias("cap"))

    def sums(level: float):
        capped = F.col("cap") < F.lit(level) * F.col("w")
        spent, shared = F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("w")))
        return weighed.agg(F.sum("source_size").alias("total"), spent.alias("spent"), shared.alias("w")).first()

    level = 0.0
    while (now := sums(level)).w and (level_now := (now.total - now.spent) / now.w) != level:
        level = level_now
    capped = F.col("cap") < F.lit(level) * F.col("w")
    return weighed.select(
        "source", "source_no", "source_size", F.when(capped, F.col("cap")).otherwise(F.lit(level) * F.col("w")).alias("target")
    )


#: Bits of the sums that exchanges may pass, 512 MB.
MOST_BITS = 1 << 32


def exchange(words: list[int], taken: list[int], left: list[int], missing: int) -> list[int]:
    """How many more (or fewer) documents of each size to take so that the sum grows by ``missing`` at most, as nearly as possible.

    The words have no common factor, and none of what is left fits into ``missing``. Of the ways to the best sum there is one of
    fewer than twice the longest document's exchanges: put in an order that keeps the sum within a document of the start, two
    equal sums in between would make what lies between them idle. So what is given back, in number as in words, is bounded by
    the square of the longest, whatever the budget; sums are bits of one number.
    """
    longest = max(words)
    most = 2 * longest
    down = min(sum(w * min(t, most) for w, t in zip(words, taken)), longest * longest)
    if down + missing >= MOST_BITS:  # documents of over 65,000 words without a common factor and of few sizes
        return [0] * len(words)
    width = (1 << (down + missing + 1)) - 1
    reach, steps = 1 << down, []

    def passed(way: int, i: int, many: int) -> None:
        nonlocal reach
        steps.append((way, i, many, reach))
        part = 1
        while many > 0 and not reach >> (down + missing):
            part = min(part, many)
            reach |= (reach >> part * words[i]) if way < 0 else (reach << part * words[i]) & width
            many -= part
            part *= 2

    for i, t in enumerate(taken):
        passed(-1, i, min(t, most))
    for i, n in enumerate(left):
        passed(1, i, min(n, most))
    out, at = [0] * len(words), reach.bit_length() - 1
    for way, i, many, before in reversed(steps):
        bits = before.to_bytes(-(-before.bit_length() // 8), "little")
        for k in range(many + 1):
            place = at - way * k * words[i]
            if 0 <= place < 8 * len(bits) and bits[place >> 3] >> (place & 7) & 1:
                out[i] += way * k
                at = place
                break
    return out


def fit_budget(size: np.ndarray, n: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their words meet ``budget`` as nearly as possible from below."""
    take, budget = np.zeros_like(n), int(budget)
    some = np.flatnonzero((n > 0) & (size > 0) & (size <= budget))
    some = some[np.argsort(size[some], kind="stable")]
    words = [int(size[i]) for i in some]
    total = sum(w * int(n[i]) for w, i in zip(words, some))
    if total <= budget:
        take[some] = n[some]
        return take
    span = max(KNAPSACK_WORDS, SPAN * words[-1])
    rest = budget
    if budget > span:
        take[some] = np.floor(n[some] * ((budget - span) / total)).astype(np.int64)
        rest -= sum(w * int(take[i]) for w, i in zip(words, some))
        for w, i in zip(reversed(words), reversed(some)):
            more = min(int(n[i] - take[i]), max(0, rest - span) // w)
            take[i] += more
            rest -= more * w
    rest -= budget % math.gcd(*words)  # no sum meets what their common factor leaves over
    # by[x]: the item that first reached x words, -1 where none has
    by = np.full(rest + 1, -1, np.int32)
    by[0] = 0
    items: list[tuple[int, int, int]] = [(0, 0, 0)]
    for w, i in zip(words, some):
        many, part = min(int(n[i] - take[i]), rest // w), 1
        while many > 0 and by[rest] < 0:
            part = min(part, many)
            fresh = np.flatnonzero((by[: -part * w] >= 0) & (by[part * w :] < 0)) + part * w
            by[fresh] = len(items)
            items.append((i, part, part * w))
            many -= part
            part *= 2
    at = int(np.flatnonzero(by >= 0)[-1])
    missing = rest - at
    while at:
        i, part, cost = items[by[at]]
        take[i] += part
        at -= cost
    if missing and budget > span:
        factor = math.gcd(*words)
        for w, i in zip(reversed(words), reversed(some)):
            more = min(int(n[i] - take[i]), missing // w)
            take[i] += more
            missing -= more * w
        taken = [int(take[i]) for i in some]
        change = exchange([w // factor for w in words], taken, [int(n[i]) - t for i, t in zip(some, taken)], missing // factor)
        take[some] += np.array(change, np.int64)
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    target, whole = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
    pdf = pdf.sort_values("size")
    size, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    copies = min(MAX_REPEAT, int(target // whole)) if whole else 0
    budget = round(target - copies * whole) if copies < MAX_REPEAT else 0
    take = fit_budget(size, n, min(budget, whole))
    return pd.DataFrame({"source_no": pdf["source_no"], "size": size, "n": n, "copies": copies, "once_more": take})


def mix(documents: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, text_hash, source, size, source_size, target, copies, taken)`` of every row."""
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text_col).alias("text_hash"),
        F.col(source_col).cast("string").alias("source"),
        F.size(words_of(F.col(text_col))).cast("long").alias("size"),
    )
    rows = materialize(rows, "sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = materialize(sources, "targets")
    counts = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    of_source = counts.source.eqNullSafe(sources.source)
    plan = counts.join(sources, of_source).select("source_no", "source_size", "target", "size", "n")
    plan = plan.groupBy("source_no").applyInPandas(_plan, "source_no int, size long, n long, copies int, once_more long")

    placed_rows = rows.join(sources, rows.source.eqNullSafe(sources.source)).select(rows["*"], "source_no", "source_size", "target")
    buckets = F.ceil(F.sqrt("n"))
    drawn = placed_rows.join(plan, ["source_no", "size"]).select(
        "*", F.xxhash64(F.lit(seed), "doc_id", "text_hash").alias("draw")
    ).withColumn("bucket", F.pmod(F.col("draw"), buckets))
    drawn = materialize(drawn, "drawn")
    key = ["source_no", "size", "bucket"]
    below = Window.partitionBy("source_no", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = drawn.groupBy(*key).agg(F.count("*").alias("here"))
    filled = filled.select(*key, F.coalesce(F.sum("here").over(below), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("draw", "doc_id", "text_hash"))
    placed = drawn.withColumn("rank", rank).join(filled, key)
    copies = F.when(F.col("size") == 0, 0).otherwise(
        F.col("copies") + F.when(F.col("before") + F.col("rank") <= F.col("once_more"), 1).otherwise(0)
    )
    return placed.select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def repeat_documents(documents: DataFrame, **options) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, with the columns it had."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    source_col = options.get("source_col", "source")
    taken = mix(documents, **options).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("source").alias("__source")).agg(
        F.sum("copies").cast("int").alias("__copies"), F.count("*").cast("int").alias("__rows")
    )
    keyed = documents.withColumns({"__own_id": F.col(id_col).cast("long"), "__own_hash": F.xxhash64(text_col), "__own_source": F.col(source_col).cast("string")})
    same = keyed["__own_id"].eqNullSafe(taken["__id"]) & (keyed["__own_hash"] == taken["__hash"]) & keyed["__own_source"].eqNullSafe(taken["__source"])
    joined = keyed.join(taken.where("__copies > 0"), same)
    # rows that repeat a document of a source share its copies, in an order of what else they hold
    rest = F.xxhash64(*[F.col(c) for c, kind in documents.dtypes if "map<" not in kind and "variant" not in kind])
    nth = F.row_number().over(Window.partitionBy("__own_id", "__own_hash", "__own_source").orderBy(rest))
    share = F.floor(F.col("__copies") / F.col("__rows")) + F.when(nth <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
    return joined.withColumn("__share", share.cast("int")).where("__share > 0").select(
        *[F.col(c) for c in documents.columns], F.explode(F.sequence(F.lit(1), "__share")).alias("__copy")
    ).drop("__copy")
