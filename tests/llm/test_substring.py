import hashlib
import random

from seqloom.llm import substring


def brute(rows, window=50):
    seen = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if d is not None:
                seen[g] = min(seen.get(g, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if d is not None and seen[tuple(w[k : k + window])] < d:
                gone[k : k + window] = [True] * window
        left = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, kept int")
    return sorted((tuple(r)[:4] for r in substring.deduplicated(df).collect()), key=str)


def test_as_brute_force_on_passages_copies_and_periods(spark):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(60)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [words(n) for n in (49, 50, 51, 64, 120)]
    rows = []
    for d in range(60):
        w = words(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            cutoff = rng.randint(0, 12)
            w += s[cutoff:] if rng.random() < 0.4 else s
            w += words(rng.randint(0, 40))
        rows.append((d * 3 % 61, " ".join(w) + rng.choice(["", "\n", " \t "])))
    rows += [(100, "the " * 300), (101, "the " * 180 + "end"), (102, "a b " * 90), (103, "b a " * 90), (104, rows[5][1]), (105, rows[5][1])]
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long + " more"), (None, long), (5, "é " * 60), (6, "é " * 60)]
    assert result(spark, rows) == brute(rows)
    assert substring.deduplicated(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_every_shared_window_has_one_anchor():
    import numpy as np

    rng = np.random.default_rng(1)
    core = rng.integers(0, 2**63, 50, dtype=np.uint64)
    for _ in range(50):
        a = np.concatenate([rng.integers(0, 2**63, 20, dtype=np.uint64), core, rng.integers(0, 2**63, 9, dtype=np.uint64)])
        b = np.concatenate([rng.integers(0, 2**63, 3, dtype=np.uint64), core])
        own = lambda h, at: next(x for x, s, n in zip(*substring.segments(h)) if s <= at < s + n)
        assert own(a, 20) == own(b, 3)


class Captured:
    """Stands for a DataFrame: any step gives it again, mapInArrow the function that it is given."""

    def __getattr__(self, name):
        return (lambda f, schema: f) if name == "mapInArrow" else (lambda *a: self)


def test_memory_follows_from_a_text_not_from_a_batch_of_long_ones(spark):
    import tracemalloc

    import pyarrow as pa

    n, length = 400, 3000
    texts = [" ".join(f"w{(i * 7919 + d * 104729) % 99991:05}" for i in range(length)) for d in range(n)]
    at = [[{"start": 0, "count": length - 49}]] * n
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "version": pa.array([0] * n, pa.int32()), "text": texts, "at": at})
    for run, least in ((substring.seeds(Captured()), n * length // 50), (substring.windows(Captured(), Captured()), n * (length - 49))):
        list(run([batch.slice(0, 1)]))
        tracemalloc.start()
        rows = [b.num_rows for b in run([batch])]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(rows) >= least
        assert max(rows) <= 1 << 16
        assert peak < 60e6


def test_slices_hold_every_row_once():
    import pyarrow as pa

    texts = ["x" * n for n in (0, 1 << 22, 5, 1 << 20, 1 << 20, 1, 1 << 21)] + [None, "y"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    got = [b.column("text").to_pylist() for b in substring.light([batch, batch.slice(2, 3), batch.slice(0, 0)])]
    assert [x for b in got for x in b] == texts + texts[2:5]
    assert all(len(b) == 1 or sum(len(x or "") for x in b) <= substring.BYTES for b in got)
