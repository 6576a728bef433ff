"""Secrets in texts: what fixed rules find, and what a convolutional network over characters finds besides.

Rules give the base findings: assignments to a name such as ``token``, access keys, and long lower-case hexadecimal
numbers. Candidates are all runs of ``MIN_RUN`` or more characters of secrets that hold a digit, base findings or not. The network
reads each candidate whole with ``LEFT`` characters before and ``RIGHT`` after it: filters of ``WIDTH`` characters, over the
characters, their classes and whether they are in the candidate, are pooled (the greatest and the mean inside, the greatest
around it), so its length is free, and a candidate of a million characters takes no more memory than a piece of it.

It is trained on labelled findings: base findings are secrets, other candidates aren't. Each secret is learned a second time
with the surroundings of one that isn't, so that a secret without a telling name is found too. Every different window of the
table teaches, whatever its length, and every one calibrates: the windows lie in ``FOLDS`` folds by the hash of the value, and
for each fold a network is trained on the others beside the one that is trained on all. Its outputs for the fold that it never
saw give the logistic curve that makes an output a probability, and the threshold of each shape (hexadecimal or mixed), the
highest at which ``RECALL`` of its secrets are found.

Windows are dealt by their hash to shards of some ``SHARD``. In a round each shard goes on from the same weights, minibatch by
minibatch, and the shards' weights are averaged, in whole numbers, so that no order of summing shows. The driver gets the averages,
whose number is fixed; windows and outputs stay in tables.

Defined results: a null or empty text has no findings. Rows are scanned one by one, so repeated rows have the same findings, and
an empty table gives an empty table. Base findings stay whatever the network says. Without findings of both labels there is no
network, base findings have a null score and none are added. A candidate that a base finding overlaps is not added
again. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import quantiles
from .common import materialize, numbered

#: The rules and the least length of what counts (fixed values of the contract): of the second group, of the match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
#: What every assignment has in lower case.
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "net")

MIN_RUN = 12
_RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_RUN},}}")
_DIGIT = re.compile("[0-9]")
_HEX_SHAPE = re.compile(r"[0-9A-Fa-f]+\Z")

LEFT, RIGHT, WIDTH, FILTERS = 16, 8, 5, 16
ROUNDS, BATCH, RATE, SHRINK = 12, 64, 0.01, 1e-4
FOLDS = 4
#: Windows and characters of a shard, on average.
SHARD, SHARD_CHARS = 2048, 1 << 22
#: What a one of a weight counts as, where weights are summed.
_ONE = float(1 << 36)
RECALL = 0.98
#: Secrets of a shape that a threshold of its own needs.
LEAST_OF_SHAPE = 20
#: Positions that are convolved at once.
PIECE = 1 << 14

#: Characters: 0 is none, then ASCII, 128 is any other. Classes: none, digit, lower, upper, mark of a secret, quote, space, other.
_CODES, _CLASSES = 129, 8


def _class_of(code: int) -> int:
    c = chr(code)
    if code == 0:
        return 0
    if code < 128 and c.isalnum():
        return 1 if c.isdigit() else 2 if c.islower() else 3
    return 4 if c in "+/_.=-" else 5 if c in "\"'`" else 6 if c in " \t\n\r" else 7


_CLASS = np.array([_class_of(k) for k in range(_CODES)])


def base_findings(text: str) -> list[tuple[str, int, int, int, int]]:
    """``(kind, start, end, start of the value, its end)``, by start, then kind."""
    out = []
    low = text.encode("utf-8", "replace").lower()
    if any(name in low for name in _NAMES):
        out += [("assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0])))


def other_candidates(text: str, base: list[tuple]) -> list[tuple[int, int]]:
    """Runs that no base finding overlaps."""
    out, k = [], 0
    spans = sorted((f[1], f[2]) for f in base)
    for m in _RUN.finditer(text):
        if not _DIGIT.search(text, m.start(), m.end()):
            continue
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if not any(s < m.end() and m.start() < e for s, e in spans[k : k + 4]):
            out.append(m.span())
    return out


@dataclass
class Network:
    """Filters by character, by class and by place, the weights of what is pooled, the curve and the thresholds."""

    chars: np.ndarray
    classes: np.ndarray
    places: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float = 0.0
    curve: tuple[float, float] = (0.0, 1.0)
    thresholds: tuple[float, float] = (0.5, 0.5)

    def tables(self) -> np.ndarray:
        """The filters by offset, place and character."""
        return self.chars[:, None] + self.classes[:, _CLASS][:, None] + self.places[:, :, None]

    def rectified(self, tables: np.ndarray, codes: np.ndarray, place: np.ndarray, at: int, end: int) -> np.ndarray:
        """The filters' outputs from position ``at`` to ``end``."""
        half = WIDTH // 2
        a = self.shift + sum(tables[o, place[at + o - half : end + o - half], codes[at + o - half : end + o - half]] for o in range(WIDTH))
        return np.maximum(a, 0) * (place[at:end] > 0)[:, None]

    def outputs(self, windows: list[tuple[str, str, str]]) -> np.ndarray:
        """The output for each ``(left, value, right)``."""
        return self.pooled(*flat(windows), np.array([max(1, len(v)) for _, v, _ in windows])) @ self.out + self.bias

    def pooled(self, codes: np.ndarray, place: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What the filters give for each window; all stand in one array, which is convolved a piece at a time."""
        tables, half, n = self.tables(), WIDTH // 2, len(sizes)
        top = np.zeros((2 * n, FILTERS))  # rectified outputs are not negative
        total = np.zeros((2 * n, FILTERS))
        for at in range(half, len(codes) - half, PIECE):
            end = min(at + PIECE, len(codes) - half)
            a = self.rectified(tables, codes, place, at, end)
            part = 2 * owner[at:end] + (place[at:end] != 2)
            first = np.flatnonzero(np.append(True, np.diff(part) != 0))
            np.maximum.at(top, part[first], np.maximum.reduceat(a, first))
            np.add.at(total, part[first], np.add.reduceat(a, first))
        return np.concatenate([top[0::2], top[1::2], total[0::2] / sizes[:, None]], axis=1)

    def probabilities(self, windows: list[tuple[str, str, str]]) -> np.ndarray:
        return self.probability(self.outputs(windows)) if windows else np.zeros(0)

    def probability(self, outputs: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * outputs, -50, 50)))


def shape_of(value: str) -> int:
    return 0 if _HEX_SHAPE.match(value) else 1


def flat(windows: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all characters, their places (0 none, 1 before, 2 inside, 3 after) and windows, with gaps between windows."""
    gap = "\0" * (WIDTH // 2)
    text = "".join(f"{gap}{left}{value}{right}{gap}" for left, value, right in windows)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([[len(gap), len(left), len(value), len(right), len(gap)] for left, value, right in windows], np.int64).reshape(-1, 5)
    place = np.repeat(np.tile([0, 1, 2, 3, 0], len(windows)), sizes.ravel())
    owner = np.repeat(np.arange(len(windows)), sizes.sum(axis=1))
    return np.where(codes < 128, codes, 128).astype(np.int64), place, owner


#: The network's weights in one array. A state of learning has them, the means of their gradients and of the squares (as
#: roots), and the number of steps.
_SHAPES = [(WIDTH, _CODES, FILTERS), (WIDTH, _CLASSES, FILTERS), (WIDTH, 4, FILTERS), (FILTERS,), (3 * FILTERS,), (1,)]
_ENDS = np.cumsum([math.prod(shape) for shape in _SHAPES])
_SIZE = int(_ENDS[-1])


def network_of(weights: np.ndarray) -> Network:
    parts = [part.reshape(shape) for part, shape in zip(np.split(weights, _ENDS[:-1]), _SHAPES)]
    return Network(*parts[:5], float(parts[5][0]))


def first_state(seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    scales = [0.3 / np.sqrt(WIDTH)] * 3 + [0, 0.3, 0]
    weights = [rng.normal(0, scale, math.prod(shape)) if scale else np.zeros(math.prod(shape)) for scale, shape in zip(scales, _SHAPES)]
    return np.concatenate([*weights, np.zeros(2 * _SIZE + 1)])


def gradient(net: Network, windows: list[tuple[str, str, str]], labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The gradient of the weighted mean of the logistic losses, a piece of the characters at a time."""
    codes, place, owner = flat(windows)
    tables, half, n = net.tables(), WIDTH // 2, len(windows)
    sizes = np.array([max(1, len(v)) for _, v, _ in windows])
    pooled = net.pooled(codes, place, owner, sizes)
    y = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.bias, -30, 30)))
    dy = (y - labels) * weight / n
    dp = dy[:, None] * net.out
    top, dtop = pooled[:, : 2 * FILTERS].reshape(2 * n, FILTERS), dp[:, : 2 * FILTERS].reshape(2 * n, FILTERS)
    mean = dp[:, 2 * FILTERS :] / sizes[:, None]
    by, shift = np.zeros((WIDTH, 4 * _CODES * FILTERS)), np.zeros(FILTERS)
    open_ = np.ones((2 * n, FILTERS), bool)  # whose greatest wasn't met yet
    for at in range(half, len(codes) - half, PIECE):
        end = min(at + PIECE, len(codes) - half)
        a = net.rectified(tables, codes, place, at, end)
        part = 2 * owner[at:end] + (place[at:end] != 2)
        da = mean[owner[at:end]] * ((place[at:end] == 2)[:, None] & (a > 0))
        rows, cols = np.nonzero((a > 0) & (a == top[part]))
        _, once = np.unique(part[rows] * FILTERS + cols, return_index=True)  # the first of equals
        rows, cols = rows[once], cols[once]
        new = open_[part[rows], cols]
        rows, cols = rows[new], cols[new]
        open_[part[rows], cols] = False
        da[rows, cols] += dtop[part[rows], cols]
        near = slice(at - half, end + half)
        key = (place[near] * _CODES + codes[near])[:, None] * FILTERS + np.arange(FILTERS)
        for o in range(WIDTH):
            by[o] += np.bincount(key[o : o + end - at].ravel(), da.ravel(), by.shape[1])
        shift += da.sum(axis=0)
    by = by.reshape(WIDTH, 4, _CODES, FILTERS)
    chars, classes = by.sum(axis=1), np.zeros((WIDTH, _CLASSES, FILTERS))
    np.add.at(classes, (slice(None), _CLASS), chars)
    return np.concatenate([chars.ravel(), classes.ravel(), by.sum(axis=2).ravel(), shift, pooled.T @ dy, [dy.sum()]])


def one_pass(state: np.ndarray, windows: list[tuple[str, str, str]], labels: np.ndarray, weight: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """The state after a pass over the windows by Adam, in minibatches in a random order."""
    (p, m, root), step = state[:-1].reshape(3, _SIZE), state[-1]
    v = root**2
    order = np.random.default_rng(seed).permutation(len(labels))
    for some in np.array_split(order, -(-len(order) // BATCH)):
        g = gradient(network_of(p), [windows[i] for i in some], labels[some], weight[some]) + SHRINK * p
        step += 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        p = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return np.concatenate([p, m, np.sqrt(v), [step]])


def label_weights(no: int, yes: int) -> tuple[float, float]:
    """The weights of windows that aren't secrets and of those that are: both labels count alike."""
    return 0.5 * (no + yes) / max(1, no), 0.5 * (no + yes) / max(1, yes)


def train(windows: list[tuple[str, str, str]], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 1) -> Network:
    """A network fitted to windows at hand, which are one shard."""
    weight = np.where(labels > 0, *label_weights((labels <= 0).sum(), (labels > 0).sum())[::-1])
    state = first_state(seed)
    for k in range(rounds):
        state = one_pass(state, windows, labels, weight, (seed, k))
    return network_of(state[:_SIZE])


def fitted_curve(sums, no: int, yes: int) -> tuple[float, float]:
    """The logistic curve by Newton's steps; ``sums(a, b, low, high)`` gives the sums of ``e``, ``e z``, ``w``, ``w z``, ``w z z``.

    ``e`` is what a target is above its probability, ``w`` its variance. Targets lie a little inside of 0 and 1, which keeps the curve finite.
    """
    a, b = 0.0, 1.0
    for _ in range(50):
        e, ez, w, wz, wzz = sums(a, b, 1 / (no + 2), (yes + 1) / (yes + 2))
        move = np.clip(np.linalg.solve(np.array([[w, wz], [wz, wzz]]) + 1e-6 * np.eye(2), np.array([e, ez])), -1, 1)
        a, b = a + float(move[0]), b + float(move[1])
        if np.abs(move).max() < 1e-9:
            break
    return a, max(b, 1e-3)


def calibrate(net: Network, windows: list[tuple[str, str, str]], labels: np.ndarray, recall: float = RECALL) -> Network:
    """Sets the curve and the thresholds by windows at hand that the network wasn't fitted to."""
    z = net.outputs(windows)

    def sums(a: float, b: float, low: float, high: float) -> list[float]:
        q = 1 / (1 + np.exp(-np.clip(a + b * z, -50, 50)))
        e, w = np.where(labels > 0, high, low) - q, np.maximum(q * (1 - q), 1e-9)
        return [x.sum() for x in (e, e * z, w, w * z, w * z * z)]

    net.curve = fitted_curve(sums, (labels <= 0).sum(), (labels > 0).sum())
    q = net.probabilities(windows)
    shapes = np.array([shape_of(value) for _, value, _ in windows])
    thresholds = []
    for shape in (0, 1):
        found = np.sort(q[(labels > 0) & (shapes == shape)])
        if len(found) < LEAST_OF_SHAPE:
            found = np.sort(q[labels > 0])
        thresholds.append(float(found[rank_of(len(found), recall)]))
    net.thresholds = tuple(thresholds)
    return net


def rank_of(n: int, recall: float) -> int:
    """Which of ``n`` rising values, from 0, is the threshold."""
    return math.floor((1 - recall) * n)


def _scan(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("left", pa.string()), ("value", pa.string()), ("right", pa.string())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some, found = batch.slice(at, 512), []
            for value in some.column(1):
                text = value.as_py() or ""
                base = base_findings(text)
                spans = base + [("net", s, e, s, e) for s, e in other_candidates(text, base)]
                found.append([{"kind": k, "start": s, "end": e, "left": text[max(0, a - LEFT) : a], "value": text[a:z], "right": text[z : z + RIGHT]} for k, s, e, a, z in spans])
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, kind)], ["doc_id", "candidates"])


_CANDIDATES = "doc_id long, candidates array<struct<kind:string,start:int,end:int,left:string,value:string,right:string>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, candidates)`` of every row, written: base findings and, as kind ``net``, the other candidates, with their windows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(_scan, _CANDIDATES), "candidates")


def labelled(found: DataFrame) -> DataFrame:
    """``(secret, left, value, right)``: every different window of ``candidates``, and each secret in the surroundings of one that isn't."""
    each = found.select(F.explode("candidates").alias("c"))
    windows = materialize(each.select((F.col("c.kind") != "net").alias("secret"), "c.left", "c.value", "c.right").distinct(), "windows")
    order = [F.xxhash64("left", "value", "right"), "left", "value", "right"]
    secrets, others = (numbered(windows.where(F.col("secret") == secret), "at", *order) for secret in (True, False))
    yes, no = secrets.count(), others.count()
    if not yes or not no:
        return windows
    # the k-th secret takes the surroundings of the k-th other, of which there are as many copies as that needs
    copies = others.select("left", "right", F.explode(F.sequence(F.col("at"), F.greatest("at", F.lit(yes)), F.lit(no))).alias("at"))
    bare = secrets.select("secret", "value", "at").join(copies, "at")
    return windows.unionByName(bare.select("secret", "left", "value", "right"))


def _averages(windows: DataFrame, states: list[np.ndarray], weights: list[tuple[float, float]], k: int) -> list[np.ndarray]:
    """The states after round ``k``: each shard goes on from the same ones, then they are averaged."""
    width = len(states[0]) + 1  # the last is the number of shards

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("left", "value", "right", "secret", "fold"))))
        place, value = [], []
        for f, state in enumerate(states):
            own = [r for r in rows if r[4] != f]
            if own:
                labels = np.array([float(r[3]) for r in own])
                after = one_pass(state, [r[:3] for r in own], labels, np.where(labels > 0, *weights[f][::-1]), (k, key[0].as_py(), f))
                place.append(np.arange(f * width, (f + 1) * width))
                value.append(np.append(np.rint(after * _ONE), 1))
        return pa.table({"place": pa.array(np.concatenate(place), pa.int32()), "value": pa.array(np.concatenate(value).astype(np.int64))})

    summed = windows.groupBy("shard").applyInArrow(run, "place int, value long").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    whole = np.zeros((len(states), width))
    whole.ravel()[summed.column("place").to_numpy()] = summed.column("value").to_numpy()
    return [row[:-1] / _ONE / row[-1] for row in whole]


def learn(found: DataFrame, rounds: int = ROUNDS, shard: int = SHARD) -> Network | None:
    """The network for the candidates of a table; None without secrets and others to learn and to calibrate from."""
    windows = labelled(found).withColumn("fold", (F.crc32(F.col("value").cast("binary")) % FOLDS).cast("int"))
    windows = materialize(windows, "labelled")
    counts = {(r.fold, r.secret): (r.n, r.chars) for r in windows.groupBy("fold", "secret").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars")).collect()}
    # the last network is taught by all folds
    sizes = [[sum(n for (fold, secret), (n, _) in counts.items() if fold != f and secret == label) for label in (False, True)] for f in range(FOLDS + 1)]
    if not all(min(size) for size in sizes):
        return None
    shards = math.ceil(max(sum(sizes[-1]) / shard, sum(chars for _, chars in counts.values()) / SHARD_CHARS))
    # so many partitions that small shards aren't gathered in one task, which their size alone would allow
    windows = windows.withColumn("shard", F.pmod(F.xxhash64("left", "value", "right"), F.lit(shards))).repartition(shards, "shard")
    states, weights = [first_state()] * (FOLDS + 1), [label_weights(*size) for size in sizes]
    for k in range(rounds):
        states = _averages(windows, states, weights, k)
    nets = [network_of(state[:_SIZE]) for state in states]

    def score(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512).to_pydict()
                rows = list(zip(some["left"], some["value"], some["right"]))
                fold, z = np.array(some["fold"]), np.zeros(len(rows))
                for f in np.unique(fold):
                    z[fold == f] = nets[f].outputs([rows[i] for i in np.flatnonzero(fold == f)])
                yield pa.RecordBatch.from_pydict({"secret": some["secret"], "shape": pa.array([shape_of(v) for _, v, _ in rows], pa.int32()), "z": z})

    net = nets[-1]
    unseen = materialize(windows.drop("shard").mapInArrow(score, "secret boolean, shape int, z double"), "unseen")

    def sums(a: float, b: float, low: float, high: float) -> list[float]:
        z, q = F.col("z"), F.col("q")
        rows = unseen.withColumn("q", 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.lit(a) + F.lit(b) * z)))))
        e, w = F.when(F.col("secret"), high).otherwise(low) - q, F.greatest(q * (1 - q), F.lit(1e-9))
        # decimal sums are the same in any order
        return [float(x) for x in rows.agg(*(F.sum(x.cast("decimal(28,12)")) for x in (e, e * z, w, w * z, w * z * z))).first()]

    net.curve = fitted_curve(sums, *sizes[-1])
    secret, thresholds = unseen.where("secret"), []
    of_shape = {r.shape: r["count"] for r in secret.groupBy("shape").count().collect()}
    for shape in (0, 1):
        few = of_shape.get(shape, 0) < LEAST_OF_SHAPE
        n = sizes[-1][1] if few else of_shape[shape]
        [z] = quantiles(secret if few else secret.where(F.col("shape") == shape), F.col("z"), [rank_of(n, RECALL) / max(1, n - 1)])
        thresholds.append(net.probability(np.array([z]))[0].item())
    net.thresholds = tuple(thresholds)
    return net


def findings(found: DataFrame, net: Network | None) -> DataFrame:
    """``(doc_id, findings)`` of every row of ``candidates``: structs ``(kind, start, end, score)`` by start, then kind.

    ``start`` and ``end`` count code points. The network's own have the kind ``net``.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                rows = some.column(1).to_pylist()
                scores = iter(net.probabilities([(c["left"], c["value"], c["right"]) for row in rows for c in row]).tolist() if net else [])
                out = []
                for row in rows:
                    spans = []
                    for c in row:
                        score = next(scores, None)
                        if c["kind"] != "net" or (score is not None and score >= net.thresholds[shape_of(c["value"])]):
                            spans.append({"kind": c["kind"], "start": c["start"], "end": c["end"], "score": score})
                    out.append(sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, kind)], ["doc_id", "findings"])

    return found.mapInArrow(run, "doc_id long, findings array<struct<kind:string,start:int,end:int,score:double>>")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``findings`` of every row by the network that the rows themselves teach."""
    found = candidates(docs, id_col, text_col)
    return findings(found, learn(found))
