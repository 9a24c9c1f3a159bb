"""Operator 8: quality classifier, a naive Bayes support vector machine.

Features are indicators of n-grams: of words, in runs of one and two, and of the words' shapes (which kinds of
characters a word has, and whether it repeats the word before) in runs of one, two and three. A shape n-gram has
one indicator for each share of the text that it reaches. Words and shapes are hashed whole, all indicators to
BITS bits. Each indicator is scaled by its
log-count ratio between the classes; a linear model with hinge loss is fitted on these by dual
coordinate descent; a sigmoid fitted on margins of held-back folds turns margins into probabilities.

The classifier is fitted on a bounded sample of labelled rows: of each class the PER_CLASS rows of smallest
hash of doc_id, never rows of the held-out fifth, and of these, in that order, as many as have SAMPLE indicators
together. Every text is scored whole.

Defined results: null and empty texts have the score of no features; a null doc_id is not held out;
repeated rows are scored alike; with no labels, or one class only, every score is that class's rate (1 where
there is no label); doc_ids labelled twice count with their mean, rounded; further columns are kept out of the features.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hashes, mix, ready, words

BITS, PER_CLASS, FOLDS, EPOCHS, COST, THRESHOLD = 20, 3000, 3, 12, 1.0, 0.3
#: Indicators of all rows that are fitted on, at most (four bytes each on the driver).
SAMPLE = 16_000_000
#: Rows of the sample that an indicator needs to have a weight.
LEAST = 2
SHARES = 2.0 ** -np.arange(1, 8)
_KINDS = [(re.compile(p), r) for p, r in ((rb"[0-9]+", b"9"), (rb"[A-Z]{2,}", b"AA"), (rb"[a-z\x80-\xff]+", b"a"), (rb"([^0-9A-Za-z\x80-\xff])\1+", rb"\1\1"))]


class Shapes(dict):
    """Hashes of words' shapes; those of short words are remembered up to a bound."""

    def __init__(self, bound: int = 150_000, longest: int = 64):
        super().__init__()
        self.bound, self.longest = bound, longest

    def __missing__(self, word: bytes) -> int:
        import xxhash

        shape = word
        for pattern, to in _KINDS:
            shape = pattern.sub(to, shape)
        if len(self) >= self.bound:
            self.clear()
        h = xxhash.xxh3_64_intdigest(shape)
        if len(word) <= self.longest:
            self[word] = h
        return h


_SHAPES = Shapes()


def features(text: str | None) -> np.ndarray:
    """Indices of the indicators of a text, each once."""
    w = words(text)
    if not w:
        return np.empty(0, np.int64)
    ids, shapes = hashes(w), np.fromiter(map(_SHAPES.__getitem__, w), np.uint64, len(w))
    same = np.zeros(len(w), np.uint64)
    same[1:] = ids[1:] == ids[:-1]
    one = mix(shapes + same)
    found = [mix(ids), mix(ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:])]
    run = one
    for n in (1, 2, 3):
        if len(w) < n:
            break
        if n > 1:
            run = mix(run[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[n - 1 :])
        grams, counts = np.unique(run, return_counts=True)
        reached = counts[:, None] >= SHARES[None, :] * len(run)
        found.append(mix(grams))
        g, s = np.nonzero(reached)
        found.append(mix(grams[g] + (s.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)))
    return np.unique(np.concatenate(found) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def log_ratios(rows: list[np.ndarray], y: np.ndarray, size: int = 1 << BITS) -> np.ndarray:
    """Log-count ratio of each indicator between the classes."""
    count = lambda c: 1.0 + np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(y == c)]), minlength=size)
    p, q = count(1), count(-1)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def scaled(rows: list[np.ndarray]) -> np.ndarray:
    return 1.0 / np.sqrt(np.maximum(1, np.fromiter(map(len, rows), np.int64, len(rows))))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, norm: np.ndarray | None = None, seed: int = 1, epochs: int | None = None) -> np.ndarray:
    """Weights (with the bias last) of the hinge-loss model, by coordinate descent in the dual."""
    w, alpha = np.zeros(len(ratio) + 1), np.zeros(len(rows))
    norm = scaled(rows) if norm is None else norm
    x = [ratio[r] * n for r, n in zip(rows, norm, strict=True)]
    dot = lambda a, b: np.einsum("i,i->", a, b)  # noqa: E731 -- no threads for so little
    square = np.array([float(dot(v, v)) + 1.0 for v in x])
    cost = costs(y)
    rng = np.random.default_rng(seed)
    for _ in range(epochs or EPOCHS):
        for i in rng.permutation(len(rows)):
            slope = y[i] * (dot(w[rows[i]], x[i]) + w[-1]) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * x[i]
                w[-1] += step
                alpha[i] = new
    return w


def costs(y: np.ndarray) -> np.ndarray:
    """Cost of each row: both classes weigh the same."""
    return np.where(y > 0, COST * len(y) / (2 * max(1, (y > 0).sum())), COST * len(y) / (2 * max(1, (y < 0).sum())))


def margins(rows: list[np.ndarray], weights: np.ndarray, bias: float, norm: np.ndarray | None = None) -> np.ndarray:
    norm = scaled(rows) if norm is None else norm
    return np.array([weights[r].sum() * n for r, n in zip(rows, norm, strict=True)]) + bias


def sigmoid_fit(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))), by Newton's method with smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, h = weight * (p - t), weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ m, g.sum()])
        hess = np.array([[h @ (m * m), h @ m], [h @ m, h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    def score(self, text: str | None) -> float:
        r = features(text)
        m = float(self.weights[r].sum(dtype=np.float64)) / np.sqrt(max(1, len(r))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.a * m + self.b, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, rate: float) -> Model:
    """rate: share of class 1 among all labelled rows; the sample has both classes in other shares."""
    y = np.where(labels > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        p = min(max(rate, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))
    norm = scaled(rows)
    # indicators of one row alone tell nothing about others; those that are left are numbered by how common they are
    count = np.bincount(np.concatenate(rows), minlength=1 << BITS)
    used = np.argsort(-count, kind="stable")[: int((count >= LEAST).sum())]
    place = np.full(1 << BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    rows = [np.sort(p[p >= 0]) for p in (place[r] for r in rows)]
    held = np.zeros(len(y))
    fold = np.arange(len(y)) % FOLDS
    for k in range(FOLDS):
        a, b = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(b) and len(set(y[a].tolist())) == 2:
            some = [rows[i] for i in a]
            ratio = log_ratios(some, y[a], len(used))
            w = dual_descent(some, y[a], ratio, norm[a])
            held[b] = margins([rows[i] for i in b], w[:-1] * ratio, w[-1], norm[b])
    share = (y > 0).mean()
    slope, shift = sigmoid_fit(held, y, np.where(y > 0, rate / share, (1 - rate) / (1 - share)))
    ratio = log_ratios(rows, y, len(used))
    w = dual_descent(rows, y, ratio, norm)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w[:-1] * ratio
    return Model(weights, float(w[-1]), slope, shift)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample; its features are computed where the texts are."""
    spark = docs.sparkSession
    ready(spark)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    pick = lambda c: known.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS)
    sample = pick(1).unionByName(pick(0)).select(F.col("doc_id").alias("id"), "quality")

    def run(batches):
        for b in batches:
            found = [features(t).astype(np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "quality", "x"])

    # at most 2 * PER_CLASS ids are broadcast
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("doc_id", "quality", "text").mapInArrow(run, "doc_id bigint, quality int, x binary").dropDuplicates(["doc_id", "x"]))
    order = lambda r: (r.doc_id * 0x9E3779B97F4A7C15 % 2**64, r.doc_id, r.h)
    taken, room = [], SAMPLE
    for r in sorted(rows.select("doc_id", F.xxhash64("x").alias("h"), (F.length("x") / 4).cast("bigint").alias("n")).collect(), key=order):
        if r.n <= room:
            taken.append((r.doc_id, r.h))
            room -= r.n
    some = spark.createDataFrame(taken, "doc_id bigint, h bigint")
    rows = sorted(rows.withColumn("h", F.xxhash64("x")).join(F.broadcast(some), ["doc_id", "h"]).collect(), key=order)
    total = sum(counts.values())
    rate = counts.get(1, 0) / total if total else 1.0
    return fit([np.frombuffer(r.x, np.int32).astype(np.int64) for r in rows], np.array([r.quality for r in rows]), rate)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, with score and predicted."""
    ready(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*kept)
    share = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.a, model.b))

    def run(batches):
        m = Model(*share.value)
        for b in batches:
            s = np.array([m.score(t) for t in b.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, score double, predicted int")
