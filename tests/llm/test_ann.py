import math
import random

import numpy as np

from seqloom.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int, score int"


def exact(rows, top=10):
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    size = max({len(v) for _, v in good}, key=lambda n: sum(len(v) == n for _, v in good)) if good else 0
    good = [(i, v) for i, v in good if len(v) == size]
    out = {}
    for i, v in good:
        if i % 100 == 0:
            out[i] = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in good if j != i)[:top]
    return out


def found(spark, rows):
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA)
    out = {}
    for r in sorted(ann.search(df, "vec_id % 100 = 0").collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)]
    want, got = exact(rows), found(spark, rows)
    hit = sum(len({j for _, j in want[q]} & {j for _, j in got[q]}) for q in want)
    assert hit >= 0.95 * sum(map(len, want.values()))
    vectors = dict(rows)
    for q, near in got.items():
        assert near == sorted(near)
        for s, j in near:
            assert s == np.sqrt(((np.float64(vectors[q]) - np.float64(vectors[j])) ** 2).sum()) or abs(s - np.sqrt(((np.float64(vectors[q]) - np.float64(vectors[j])) ** 2).sum())) < 1e-12


def test_copies_and_ties(spark):
    rng = random.Random(2)
    copy = [1.0, 2.0, 3.0, 0.5]
    rows = [(i, copy if i % 3 else [rng.random() for _ in range(4)]) for i in range(400)]
    want, got = exact(rows), found(spark, rows)
    assert {q: [j for _, j in v] for q, v in got.items() if q % 3} == {q: [j for _, j in v] for q, v in want.items() if q % 3}
    assert sum(len({j for _, j in want[q]} & {j for _, j in got[q]}) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, None]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (7, [2.0, 0.0]), (8, []), (100, [0.0, 5.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0])]
    got = found(spark, rows)
    assert [j for _, j in got[0]] == [9, 9, 7, 100] and [j for _, j in got[100]] == [0, 9, 9, 7]
    assert found(spark, []) == {} and found(spark, [(0, [1.0])]) == {}


def test_bigger_batches_than_a_group(spark, monkeypatch):
    monkeypatch.setattr(ann, "GROUP", 3)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(500)]
    want, got = exact(rows), found(spark, rows)
    assert sum(len({j for _, j in want[q]} & {j for _, j in got[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_fewer_vectors_than_shuffle_partitions(spark):
    rng = random.Random(4)
    rows = [(10 * i, [rng.random() for _ in range(4)]) for i in range(24)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "25")
    try:
        got = found(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {q: [j for _, j in v] for q, v in got.items()} == {q: [j for _, j in v] for q, v in exact(rows).items()}


def test_doubles_and_one_id_with_two_vectors(spark):
    rng = random.Random(9)
    rows = [(i, [rng.random() for _ in range(5)]) for i in range(150)] + [(100, [0.0, 0.1, 0.2, 0.3, 0.4]), (3, [0.5] * 5)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id % 100 = 0").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    for q in (0, 100):
        own = min(v for i, v in rows if i == q)
        want = sorted((math.dist(own, v), i) for i, v in rows if i != q)[:10]
        assert [j for _, j in sorted(got[q])] == [j for _, j in want] and np.allclose([s for s, _ in sorted(got[q])], [s for s, _ in want], rtol=1e-14, atol=0)


def test_a_walk_ends_when_nothing_is_left(spark, monkeypatch):
    """A chain: from its one end to the other takes as many hops as there are nodes."""
    monkeypatch.setattr(ann, "ENTRIES", 2)
    n = 40
    nodes = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)], "node bigint, v array<float>")
    graph = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n - 1)], "node bigint, nbr bigint, d double")
    queries = spark.createDataFrame([(1, [float(n), 1.0], 0)], "query bigint, q array<float>, own bigint")
    assert sorted(r.node for r in ann.walk(nodes, graph, queries, 2).collect()) == list(range(n))


def test_neighbours_that_have_met_do_not_meet_again(spark):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(60, 5)).astype(np.float32)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "node bigint, v array<float>")
    star = [(0, i) for i in range(1, 60)]
    d = lambda a, b: float(((vectors[a] - vectors[b]) ** 2).sum())

    def pairs(fresh):
        graph = spark.createDataFrame([(a, b, d(a, b), b in fresh) for a, b in star], "node bigint, nbr bigint, d double, fresh boolean")
        return {(r.node, r.nbr) for r in ann.improved(graph, nodes, 5).collect()}

    assert pairs(set()) == set()
    some = pairs({7})
    assert some and all(7 in p for p in some)
    near = pairs(set(range(1, 60)))
    for a in range(1, 60):  # of all that meet at the star's centre, the K nearest
        want = sorted((b for b in range(1, 60) if b != a), key=lambda b: d(a, b))[: ann.K]
        assert {b for x, b in near if x == a} - {0} == set(want)
