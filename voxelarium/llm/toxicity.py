"""Toxic spans and scores by a linear-chain conditional random field.

Labels stand for whole documents, so tokens are labelled first: over the labelled rows the words that mark toxic
documents are counted, and such a word within a toxic document is a toxic token. Near copies would make their rare
words look like marks; of the documents that share a label and a smallest shingle hash one is counted.

The field has the tags clean and toxic, one weight for each hashed feature of a token (the word, its first and
its last letters, the words before and after it) and weights for the first tag and the transitions. Words are counted
over all labelled rows, and the field is fitted to ``SAMPLE`` of them of up to ``SAMPLE_WORDS`` words; these bounds are
parameters, and scoring has none. Forward-backward gives each token the marginal probability of the toxic tag. The
document's evidence is the chance that any token is toxic; a logistic curve, fitted to the sample's labels, makes it
the score.

To count words, ids meet texts by a broadcast of the ids where there are at most ``BROADCAST_IDS`` of them, and by a
shuffle of the texts beyond; the result is the same.

With two tags the forward and backward messages are single ratios, so all documents of a batch move along
together, one position a step.

Defined results: null and empty texts have no evidence and get the lowest score. Labels that are null, and rows with
a null id, teach nothing; conflicting labels of an id both count. Without labels of both kinds all scores are the
share of toxic labels, or 0. Rows are scored one by one. An empty table gives an empty table. Only id and text are
read from documents, and neither id nor any label is part of a score.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words_of

#: Labelled rows that the field is fitted to, by the hash of their id, if their texts have no more than so many words.
SAMPLE, SAMPLE_WORDS = 4000, 1500
#: Labelled ids that are broadcast to the texts; with more of them the texts are shuffled instead.
BROADCAST_IDS = 1_000_000
#: What the weights of a token's neighbours count against its own: they tell less, and few texts teach each of them.
CONTEXT = 0.25
#: Hashed features.
FEATURES = 1 << 18
ROUNDS, RATE, SHRINK = 40, 0.5, 1e-4
#: A word marks toxic documents if its log odds are this many deviations above zero and most of its documents are toxic.
MARK_DEVIATIONS, MARK_SHARE = 3.0, 0.5
#: Words that a worker remembers the weight of.
CACHE = 1_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def bare(word: str) -> str:
    """A word in lower case without the marks around it."""
    return _EDGE.sub("", word.lower())


def features(word: str) -> list[int]:
    """The hashed features of a word: its own three, and those it lends to the token after it and to the one before it."""
    w = bare(word)
    kinds = (("w", w), ("p", w[:4]), ("s", w[-4:]), ("before", w), ("after", w))
    return [zlib.crc32(f"{kind}:{part}".encode()) % FEATURES for kind, part in kinds]


#: How the five features count.
_SHARE = np.array([1.0, 1.0, 1.0, CONTEXT, CONTEXT])
#: What the first token has before it and the last one after it.
_EDGES = tuple(zlib.crc32(f"{kind}:\n".encode()) % FEATURES for kind in ("before", "after"))


def in_context(own: np.ndarray, first, last) -> np.ndarray:
    """Rows of ``features`` in the order of a text, each with the lent values of its neighbours in place of its own."""
    out = own.copy()
    if len(own):
        out[1:, 3], out[0, 3] = own[:-1, 3], first
        out[:-1, 4], out[-1, 4] = own[1:, 4], last
    return out


@dataclass
class Field:
    """Weights of the field and of the curve from evidence to score; picklable, of a fixed size."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = -4.0
    start: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float] = (0.0, 0.0)

    def emissions(self, own: np.ndarray) -> np.ndarray:
        """The emissions of a text from the weights of the features of its words, a row a word."""
        return self.bias + in_context(own, *self.weights[list(_EDGES)]) @ _SHARE


def messages(s: np.ndarray, lengths: np.ndarray, model: Field) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios, toxic over clean, at the places of a matrix of emissions (documents x positions).

    ``lengths`` must not increase, so the documents that are still open stand first.
    """
    (oo, ot), (to, tt) = np.exp(model.moves)
    e = np.exp(np.clip(s, -30, 30))
    fwd, back = np.zeros_like(s), np.ones_like(s)
    open_at = np.searchsorted(-lengths, -np.arange(1, s.shape[1] + 1), side="right")
    if not s.shape[1]:
        return fwd, back
    r = e[:, 0] * np.exp(model.start)
    fwd[:, 0] = r
    for t in range(1, s.shape[1]):
        m = open_at[t]
        r = np.clip(e[:m, t] * (ot + r[:m] * tt) / (oo + r[:m] * to), 1e-30, 1e30)
        fwd[:m, t] = r
    for t in range(s.shape[1] - 2, -1, -1):
        m = open_at[t + 1]
        x = e[:m, t + 1] * back[:m, t + 1]
        back[:m, t] = np.clip((to + tt * x) / (oo + ot * x), 1e-30, 1e30)
    return fwd, back


def marginals(rows: list[np.ndarray], model: Field, cells: int = 2_000_000) -> list[np.ndarray]:
    """The toxic tag's probability for every token; ``rows`` has the emissions of each document."""
    out: list[np.ndarray] = [np.zeros(0)] * len(rows)
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    at = 0
    while at < len(order):
        longest = max(1, len(rows[order[at]]))
        some = order[at : at + max(1, cells // longest)]
        at += len(some)
        lengths = np.array([len(rows[i]) for i in some])
        s = np.zeros((len(some), longest))
        for k, i in enumerate(some):
            s[k, : lengths[k]] = rows[i]
        fwd, back = messages(s, lengths, model)
        odds = np.clip(fwd * back, 1e-30, 1e30)
        p = odds / (1 + odds)
        for k, i in enumerate(some):
            out[i] = p[k, : lengths[k]].copy()
    return out


def evidence(p: np.ndarray) -> float:
    """Log odds of any token being toxic."""
    total = -np.log1p(-np.minimum(p, 1 - 1e-12)).sum() if len(p) else 0.0
    return float(np.clip(np.log(np.expm1(total)) if 1e-12 < total < 30 else (30 if total >= 30 else -30), -14, 14))


@dataclass
class _Part:
    """Documents of the sample of like length, the longest first, as matrices of positions."""

    lengths: np.ndarray
    label: np.ndarray
    real: np.ndarray
    feats: np.ndarray
    y: np.ndarray

    @property
    def pair(self) -> np.ndarray:
        return self.real[:, 1:]

    def emissions(self, model: Field) -> np.ndarray:
        s = np.zeros(self.real.shape)
        s[self.real] = model.bias + model.weights[self.feats] @ _SHARE
        return s


def _training_parts(texts: list[str], toxic: np.ndarray, marks: set[str], cells: int = 150_000) -> list[_Part]:
    known: dict[str, tuple[int, ...]] = {}
    rows = []
    for text, label in zip(texts, toxic):
        words = _WORD.findall(text)
        for w in set(words).difference(known):
            known[w] = (*features(w), bare(w) in marks)
        own = np.array([known[w] for w in words], np.int32).reshape(-1, 6)
        rows.append((in_context(own, *_EDGES), float(label)))
    rows.sort(key=lambda r: -len(r[0]))
    parts, at = [], 0
    while at < len(rows):
        longest = max(1, len(rows[at][0]))
        some = rows[at : at + max(1, cells // longest)]
        at += len(some)
        lengths, label = np.array([len(r) for r, _ in some]), np.array([x for _, x in some])
        real = np.arange(longest) < lengths[:, None]
        table = np.concatenate([r for r, _ in some])
        y = np.zeros(real.shape)
        y[real] = table[:, 5]
        parts.append(_Part(lengths, label, real, table[:, :5].copy(), y * label[:, None]))
    return parts


def _moves(a: np.ndarray, b: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """How often each tag follows each."""
    first, second = a[:, :-1], b[:, 1:]
    return np.array([[(u * v * pair).sum() for v in (1 - second, second)] for u in (1 - first, first)])


def fit(texts: list[str], toxic: np.ndarray, marks: set[str]) -> Field:
    """The field for labelled documents; a token is toxic where a mark stands in a toxic document."""
    model = Field()
    rate = float(toxic.mean()) if len(toxic) else 0.0
    if not len(toxic) or rate in (0.0, 1.0):
        model.curve = (float(np.log((rate + 1e-6) / (1 - rate + 1e-6))), 0.0)
        return model
    parts = _training_parts(texts, toxic, marks)
    seen = sum(_moves(part.y, part.y, part.pair) for part in parts)
    tokens = sum(len(part.feats) for part in parts)
    sums = {"w": np.full(FEATURES, 1e-8), "b": 1e-8, "s": 1e-8, "m": np.full((2, 2), 1e-8)}
    for _ in range(ROUNDS):
        grad, at_bias, at_start, expected = -SHRINK * 0.01 * tokens * model.weights, 0.0, 0.0, np.zeros((2, 2))
        for part in parts:
            s = part.emissions(model)
            fwd, back = messages(s, part.lengths, model)
            odds = np.clip(fwd * back, 1e-30, 1e30)
            off = np.where(part.real, part.y - odds / (1 + odds), 0.0)
            grad += np.bincount(part.feats.ravel(), np.outer(off[part.real], _SHARE).ravel(), FEATURES)
            at_bias += off.sum()
            at_start += off[part.lengths > 0, 0].sum()
            x, move = np.exp(np.clip(s[:, 1:], -30, 30)) * back[:, 1:], np.exp(model.moves)
            four = np.stack([np.full_like(x, move[0, 0]), move[0, 1] * x, fwd[:, :-1] * move[1, 0], fwd[:, :-1] * move[1, 1] * x])
            expected += np.where(part.pair, four / four.sum(axis=0), 0.0).sum(axis=(1, 2)).reshape(2, 2)
        steps = {}
        for name, g in (("w", grad), ("b", at_bias), ("s", at_start), ("m", seen - expected - 0.1 * model.moves)):
            sums[name] = sums[name] + np.square(g)
            steps[name] = RATE * g / np.sqrt(sums[name])
        model.weights = model.weights + steps["w"]
        model.moves = model.moves + steps["m"]
        model.bias += float(steps["b"])
        model.start += float(steps["s"])
    x, label = [], []
    for part in parts:
        s = part.emissions(model)
        rows = [s[k, :n] for k, n in enumerate(part.lengths)]
        x += [evidence(p) for p in marginals(rows, model)]
        label += part.label.tolist()
    x, label = np.array(x), np.array(label)
    a, b = np.log(rate / (1 - rate)), 0.5
    for _ in range(50):  # Newton steps of a logistic regression with a little shrinkage
        p = 1 / (1 + np.exp(-(a + b * x)))
        w = p * (1 - p)
        g = np.array([(label - p).sum() - 1e-3 * a, ((label - p) * x).sum() - 1e-3 * b])
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        da, db = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + da, b + db
    model.curve = (float(a), float(max(b, 0.0)))
    return model


def _join_ids(texts: DataFrame, ids: DataFrame, keys: list[str], reduce) -> DataFrame:
    """``reduce(texts)`` joined with ``ids`` by ``keys``; only what ``reduce`` leaves is shuffled where ids are many.

    ``ids`` is a written table, so its count costs no more than its footers.
    """
    if ids.count() <= BROADCAST_IDS:
        return reduce(texts.join(F.broadcast(ids), keys), [c for c in ids.columns if c not in keys])
    return reduce(texts, []).join(ids, keys)


def toxic_marks(texts: DataFrame, told: DataFrame) -> list[str]:
    """Words that mark toxic documents, from texts ``(__id, text)`` and a written table ``(__id, toxic)``.

    The list is short: it holds words that stand mostly in toxic documents, significantly often.
    """
    words = words_of(F.lower(F.col("text")))

    def shingled(rows: DataFrame, more: list[str]) -> DataFrame:
        split = rows.select("__id", *more, F.xxhash64("text").alias("__text"), words.alias("words")).where(F.size("words") > 0)
        shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0))), lambda i: F.xxhash64(F.slice("words", i + 1, 3)))
        return split.select("__id", *more, "__text", F.array_min(shingles).alias("least"))

    def told_words(rows: DataFrame, more: list[str]) -> DataFrame:
        bare_words = F.transform(F.array_distinct(words), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
        return rows.select("__id", "__text", *more, F.array_distinct(bare_words).alias("words"))

    least = _join_ids(texts, told, ["__id"], shingled)
    once = least.groupBy("toxic", "least").agg(F.min(F.struct("__text", "__id")).alias("x"))
    once = materialize(once.select("x.__id", "x.__text", "toxic").distinct(), "once")
    each = _join_ids(texts.withColumn("__text", F.xxhash64("text")), once, ["__id", "__text"], told_words)
    # the empty word counts the documents
    word = F.explode(F.array_union(F.filter("words", lambda w: w != ""), F.array(F.lit(""))))
    found = each.select("toxic", word.alias("word")).groupBy("word").agg(F.sum("toxic").alias("d1"), F.sum(1 - F.col("toxic")).alias("d0"))
    found = materialize(found, "words")
    every = found.where("word = ''").first()
    if every is None or not every.d1 or not every.d0:
        return []
    odds = F.log((F.col("d1") + 0.5) / F.lit(every.d1 + 1.0)) - F.log((F.col("d0") + 0.5) / F.lit(every.d0 + 1.0))
    spread = F.sqrt(1 / (F.col("d1") + 0.5) + 1 / (F.col("d0") + 0.5))
    marks = found.where((F.col("word") != "") & (odds / spread >= MARK_DEVIATIONS) & (F.col("d1") >= MARK_SHARE * (F.col("d1") + F.col("d0"))))
    return [r.word for r in marks.select("word").collect()]


def held_out(id_column: Column) -> Column:
    """Rows that teach nothing."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """The field for the labelled rows that aren't held out.

    Words are counted over all of them; the sample that the field is fitted to is drawn from the labels alone and has
    a fixed bound.
    """
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    told = materialize(told.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("toxic")), "told")
    texts = documents.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = set(toxic_marks(texts, told))
    picked = materialize(told.orderBy(F.xxhash64("__id"), "__id", "toxic").limit(SAMPLE), "picked")
    sample = texts.join(F.broadcast(picked), "__id")
    rows = sample.where(F.size(words_of(F.col("text"))) <= SAMPLE_WORDS).select("text", "toxic").collect()
    rows.sort()
    return fit([r.text for r in rows], np.array([float(r.toxic) for r in rows]), marks)


def score(documents: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", span_from: float = 0.5) -> DataFrame:
    """``(doc_id, score, spans)`` of every row; spans are ``(start, end, p)`` in code points of tokens at ``span_from`` or above."""

    def run(batches):
        known: dict[str, int] = {}
        weights = np.zeros((1 << 12, 5))
        a, b = model.curve
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                texts = [t or "" for t in some.column(1).to_pylist()]
                rows = []
                for text in texts:
                    words = _WORD.findall(text)
                    if len(known) > CACHE:
                        known.clear()
                    for w in set(words).difference(known):
                        at_word = known[w] = len(known)
                        if at_word == len(weights):
                            weights = np.concatenate([weights, np.zeros_like(weights)])
                        weights[at_word] = model.weights[features(w)]
                    rows.append(model.emissions(weights[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]))
                scores, spans = [], []
                for text, p in zip(texts, marginals(rows, model)):
                    scores.append(float(1 / (1 + np.exp(-(a + b * evidence(p))))))
                    hits = set(np.flatnonzero(p >= span_from).tolist())
                    spans.append([{"start": m.start(), "end": m.end(), "p": float(p[k])} for k, m in enumerate(_WORD.finditer(text)) if k in hits] if hits else [])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")
