import random

import numpy as np

from seqloom.llm import quality


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdehinorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for d in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 200))]
        good = d % 4 != 0
        if not good:
            kind = d // 4 % 3
            w = [x for x in w[:20] for _ in range(6)] if kind == 0 else [x + "***" for x in w] if kind == 1 else [x.upper() + "!!" for x in w]
        rows.append((d, " ".join(w), "x", "y"))
        labels.append((d, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus(300)
    odd = [(1000, None, "x", "y"), (1001, "", "x", "y"), (None, "plain words here", "x", "y"), (7, rows[7][1], "x", "y"), (1002, "word " * 30_000, "x", "y")]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, score string, lang string")
    table = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, table)
    got = quality.scored(docs, model).withColumn("held", quality.held_out()).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {d: q for d, q, _ in labels}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held and r.doc_id in truth]
    assert len(held) > 30 and np.mean([p == t for p, t in held]) >= 0.95
    assert len({round(r.score, 12) for r in got if not r.text}) == 1 and len({r.score for r in got if r.doc_id == 7}) == 1
    assert quality.scored(docs.limit(0), model).collect() == []


def test_held_out_labels_are_never_learnt(spark):
    rows, labels = corpus(120)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    a = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    from pyspark.sql import functions as F

    b = a.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    x, y = quality.train(docs, a), quality.train(docs, b)
    assert np.array_equal(x.weights, y.weights) and (x.bias, x.a, x.b) == (y.bias, y.a, y.b)


def test_without_labels_or_with_one_class(spark):
    rows, labels = corpus(20)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    for some, p in ((table.limit(0), 1), (table.where("quality = 0"), 0)):
        assert {r.predicted for r in quality.scored(docs, quality.train(docs, some)).collect()} == {p}


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate([rng.integers(0, 500, 20), [600 + (i % 2)]])) for i in range(200)]
    y = np.where(np.arange(200) % 2, 1, -1)
    ratio = quality.log_ratios(rows, y)
    w = quality.dual_descent(rows, y, ratio)
    assert (np.sign(quality.margins(rows, w[:-1] * ratio, w[-1])) == y).mean() > 0.98


def test_descent_reaches_the_optimum():
    """The dual objective, against projected gradient ascent over the whole kernel matrix."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 60, 15)) for _ in range(80)]
    y = np.where(np.arange(80) % 3 > 0, 1, -1)
    ratio = quality.log_ratios(rows, y)
    w = quality.dual_descent(rows, y, ratio, epochs=400)
    x = np.zeros((80, 61))
    for i, (r, n) in enumerate(zip(rows, quality.scaled(rows), strict=True)):
        x[i, r], x[i, 60] = ratio[r] * n, 1
    loss = lambda v: v @ v / 2 + (quality.costs(y) * np.maximum(0, 1 - y * (x @ v))).sum()
    kernel, alpha = (x @ x.T) * np.outer(y, y), np.zeros(80)
    for _ in range(100_000):
        alpha = np.clip(alpha + (1 - kernel @ alpha) / np.linalg.norm(kernel, 2), 0, quality.costs(y))
    best = loss(x.T @ (alpha * y))
    assert loss(np.append(w[:60], w[-1])) <= best * 1.001 + 1e-6


def test_words_and_shapes_count_whole():
    a, b = "x" * 250 + "1" * 3 + "!" * 3 + "y.Z.", "x" * 250 + "1" * 3 + "?" * 3 + "z,Q,"
    assert quality._SHAPES[a.encode()] != quality._SHAPES[b.encode()]
    assert len(np.setdiff1d(quality.features("one two three"), quality.features("three one two"))) >= 1  # runs of two words


def test_whole_query_as_by_brute_force(spark):
    """Sample, fit and scores of every row, from plain lists."""
    import zlib

    rows, labels = corpus(90, seed=8)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, predicted string, lang string").repartition(3)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: (r.score, r.predicted) for r in quality.scored(docs, quality.train(docs, table)).collect()}
    known = {d: q for d, q, _ in labels if zlib.crc32(str(d).encode()) % 5}
    order = sorted(known, key=lambda d: d * 0x9E3779B97F4A7C15 % 2**64)
    text = {r[0]: r[1] for r in rows}
    model = quality.fit([quality.features(text[d]) for d in order], np.array([known[d] for d in order]), sum(known.values()) / len(known))
    for d, t in text.items():
        f = quality.features(t)
        p = 1 / (1 + np.exp(-(model.a * (sum(float(model.weights[i]) for i in f) / len(f) ** 0.5 + model.bias) + model.b)))
        assert abs(got[d][0] - p) < 1e-6 and got[d][1] == int(got[d][0] >= 0.3)


def test_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 6000)
    rows, labels = corpus(120)
    docs = spark.createDataFrame([*rows, (1, "other text", "x", "y")], "doc_id bigint, text string, source string, lang string")
    got = quality.scored(docs, quality.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))).collect()
    assert len(got) == 121 and all(0 <= r.score <= 1 for r in got)
