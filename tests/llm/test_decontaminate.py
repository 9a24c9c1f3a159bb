import random

import numpy as np

from seqloom.llm import decontaminate


def setting(seed=1):
    rng = random.Random(seed)
    common = ["the", "of", "and", "in", "to"]
    vocab = ["".join(rng.choice("abcdefghinorstu") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    words = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(rng.randint(15, 60)))) for i in range(25)]
    docs, leaks = [], set()
    for d in range(150):
        w = words(rng.randint(30, 600))
        if d % 5 == 0:
            i = rng.randrange(25)
            t = items[i][1].split()
            if d % 10 == 0:  # a paraphrase: a fifth of the words other, but for the answer
                for k in range(0, len(t) - 5, 5):
                    t[k] = rng.choice(vocab)
            at = rng.randrange(len(w))
            w = w[:at] + [x.capitalize() + "," if rng.random() < 0.2 else x for x in t] + w[at:]
            leaks.add((d, i))
        docs.append((d, " ".join(w), 1))
    return docs, items, leaks


def test_finds_copies_and_paraphrases_and_nothing_else(spark):
    docs, items, leaks = setting()
    long = (1000, " ".join(["filler"] * 20_000) + " " + items[3][1] + " " + " ".join(["filler"] * 20_000), 1)
    d = spark.createDataFrame([*docs, long, docs[5], (1001, None, 1), (1002, "", 1)], "doc_id bigint, text string, item_id int")
    b = spark.createDataFrame([*items, (900, None), (901, "")], "item_id bigint, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()]
    assert len(got) == len(set(got)) and set(got) == leaks | {(1000, 3)}
    assert decontaminate.leaks(d.limit(0), b).collect() == [] and decontaminate.leaks(d, b.limit(0)).collect() == []


def test_subsequence_as_by_the_table():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 70))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.subsequence(a, b) == t[-1, -1]


def test_the_sketch_is_that_of_the_whole_matrix(spark):
    docs, items, _ = setting(4)
    bench = decontaminate.Benchmark(items)
    x = np.random.default_rng(1).standard_normal((len(bench.columns), 8)).astype(np.float32)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, k int").repartition(5)
    n, seen, y = decontaminate.gathered(df, bench, x)
    rows = []
    for _, t, _ in docs:
        w = decontaminate.terms_of(t)
        for i in range(max(1, -(-len(w) // bench.stride) - 1)):
            row = np.zeros(len(bench.columns))
            for x_ in w[i * bench.stride : (i + 2) * bench.stride]:
                if x_ in bench.columns:
                    row[bench.columns[x_]] += 1
            rows.append(row)
    m = np.array(rows)
    assert n == len(m) and (seen == (m > 0).sum(0)).all() and np.allclose(y, m.T @ (m @ x), rtol=1e-3, atol=1e-2)


def test_items_next_to_repeated_words(spark):
    docs, items, leaks = setting(6)
    other = max(items[7][1].split(), key=len)
    more = [(1000 + i, " ".join([other] * 120 + t.split() + [other] * 120), 1) for i, t in items[:3]]
    got = decontaminate.leaks(spark.createDataFrame([*docs, *more], "doc_id bigint, text string, k int"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(1000 + i, i) for i in range(3)} <= {(r.doc_id, r.item_id) for r in got}


def test_an_item_does_not_depend_on_longer_ones(spark):
    docs, items, leaks = setting(8)
    long = " ".join(w for _, t, _ in docs[1:5] for w in t.split())
    d = spark.createDataFrame([*docs, (2000, "before " * 50 + long + " after" * 50, 1)], "doc_id bigint, text string, k int")
    found = lambda b: {(r.doc_id, r.item_id): r.start for r in decontaminate.leaks(d, spark.createDataFrame(b, "item_id bigint, text string")).collect()}
    alone, beside = found(items), found([*items, (900, long)])
    assert set(alone) == leaks and (2000, 900) in beside
    assert {k: v for k, v in beside.items() if k[1] != 900} == alone


def test_the_rank_cut_drops_no_item(spark, monkeypatch):
    docs, items, leaks = setting(9)
    monkeypatch.setattr(decontaminate, "RANK", 3)
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string, k int"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks and all(0 < r.cosine <= 1.001 for r in got)


def test_items_of_one_word_and_of_common_words(spark):
    docs = [(1, "the answer is xylophone today", 1), (2, "nothing here", 1), (None, "Xylophone!", 1), (3, "to be or not to be that is the question here", 1)]
    items = [(1, "xylophone"), (None, "to be or not to be"), *[(10 + i, f"to be or not word{i}") for i in range(30)]]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string, k int"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert {(1, 1), (None, 1), (3, None)} <= found and all(r.lcs >= 0.7 for r in got)


def brute(docs, items):
    """Every stretch of every document against every item, on its words alone."""
    bench, out = decontaminate.Benchmark(items), set()
    for d, t, *_ in docs:
        w = decontaminate.terms_of(t)
        for (i, x), answer in zip(bench.items, bench.answers, strict=True):
            most = int(decontaminate.STRETCH * len(x)) + 1
            for a in range(0, max(1, len(w) - most + 1)):
                share = decontaminate.subsequence(x, w[a : a + most]) / len(x)
                if share >= decontaminate.DIRECT or (share >= decontaminate.LOOSE and decontaminate.subsequence(answer, w[a : a + most]) >= decontaminate.ANSWERED * len(answer)):
                    out.add((d, i))
                    break
    return out


def test_whole_query_as_by_brute_force(spark):
    docs, items, leaks = setting(12)
    docs = docs[:60]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string, k int"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = brute(docs, items)
    # by the cosine's door come paraphrases that are further off; stretches are tried at steps of an eighth of the item
    assert want == {x for x in leaks if x[0] < 60} and want <= got and len(got - want) <= 1


def test_paraphrases_are_found_through_the_latent_space(spark, monkeypatch):
    """Half of the words exchanged, the rest in order: too few for the words' own doors."""
    docs, items, leaks = setting(13)
    rng = random.Random(3)
    more = []
    for i, t in items:
        w, c = t.split(), decontaminate.Benchmark(items).columns
        keep = set(rng.sample(range(len(w)), int(0.36 * len(w)))) | set([k for k, x in enumerate(w) if x.encode() in c][-4:])
        more.append((3000 + i, " ".join(["before"] * 30 + [x if k in keep else f"other{k}" for k, x in enumerate(w)] + ["after"] * 30), 1))
    d, b = spark.createDataFrame([*docs, *more], "doc_id bigint, text string, k int"), spark.createDataFrame(items, "item_id bigint, text string")
    found = lambda: {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()}
    got = found()
    wanted = {(3000 + i, i) for i, _ in items}
    assert len(got & wanted) >= 0.7 * len(wanted) and got - wanted == leaks
    monkeypatch.setattr(decontaminate, "NEAR", 2.0)
    assert len(found() & wanted) < len(got & wanted)


def test_a_large_benchmark_in_slices_and_a_sketch_of_its_rows(spark, monkeypatch):
    docs, items, leaks = setting(14)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string, k int"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "SLICE", 2500)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()} == leaks
    monkeypatch.setattr(decontaminate, "SLICE", 10**7)
    monkeypatch.setattr(decontaminate, "TABLE", 8000)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()} == leaks
