import random

from seqloom.llm import components, minhash


def brute(rows):
    """component of each doc_id by all pairs."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault(d, []).append(s)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(100 * len(x & y) >= 75 * len(x | y) > 0 for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: root(d) for d in ids}, sets


def corpus(seed, families=6, size=9):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ß"]
    rows, d = [], 0
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 160))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((d, rng.choice([" ", "\n", "\t"]).join(w)))
            d += 1
    rng.shuffle(rows)
    return rows


def test_same_components_as_all_pairs(spark):
    rows = corpus(1) + [(1000, ""), (1001, "one two"), (1002, "ONE Two"), (1003, None), (1004, "one two three"), (1005, "x " * 20_000)]
    want, sets = brute(rows)
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id bigint, text string, kept int")
    got = {r.doc_id: r for r in minhash.components(df).collect()}
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.n_shingles == len(sets[d][0]) and r.kept == (want[d] == d) for d, r in got.items())


def test_a_large_family_with_few_links_is_joined_exactly(spark, monkeypatch):
    monkeypatch.setattr(minhash, "ROUNDS", 1)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for d in range(70):
        w = list(base)
        for i in rng.sample(range(90), rng.randint(1, 5)):
            w[i] = f"n{rng.randrange(10_000)}"
        rows.append((d, " ".join(w)))
    want, _ = brute(rows)
    got = minhash.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "alone here"), (2, "a b c d e f"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.components(df).collect()), key=str)
    assert got == sorted([(3, 2, False), (3, 2, False), (None, 2, False), (None, None, False), (2, 2, True), (9, 9, True)], key=str)
    assert minhash.components(df.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (501, 502), (502, 500)], "a bigint, b bigint")
    got = {r.node: r.label for r in components.connected(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 500: 500, 501: 500, 502: 500}


def test_components_by_one_task_and_by_joins(spark, monkeypatch):
    """Few links need one task: no round of joins, whose plans fill the driver's memory."""
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(400), rng.randrange(400)) for _ in range(260)}) + [(-7, 3), (9, 9), (2**62, 5), (700, 701)]
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    want = {d: d for p in pairs if p[0] != p[1] for d in p}
    for _ in want:
        for a, b in pairs:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    by_joins = []
    flat = components._flat
    monkeypatch.setattr(components, "_flat", lambda parent: by_joins.append(1) or flat(parent))
    for most in (1 << 20, 40, 0):
        monkeypatch.setattr(components, "ONE_TASK", most)
        by_joins.clear()
        assert {r.node: r.label for r in components.connected(links).collect()} == want
        assert bool(by_joins) == (most < 1 << 20)


def test_min_and_max_estimate_the_resemblance():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = x[:350], x[50:]
    (la, ha), (lb, hb) = minhash.signature(a), minhash.signature(b)
    same = ((la == lb).mean() + (ha == hb).mean()) / 2
    assert abs(same - 300 / 400) < 0.12
