"""What a step holds or moves does not grow with its input."""

import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.operators import mask, packed, reference, search
from seqloom.plans import prepared

ODD = [("", 1), ("A", 2), ("ACGTNACGTACGTT", 3), ("GATTACA" * 50, 4), ("ACGT\nACGTAC", 5), ("CCÄGTACGTACG", 6)]


class Task:
    """Stands for a table; what would run in a task runs here."""

    sparkSession = None  # noqa: N815 -- as of a DataFrame

    def __init__(self, rows, size=10_000):
        self.batches = [pa.RecordBatch.from_arrays([pa.array([x[1] for x in rows[i : i + size]], pa.int64()), pa.array([x[0] for x in rows[i : i + size]])], names=["seq_id", "seq"]) for i in range(0, len(rows), size)]

    def __getattr__(self, name):
        return lambda *a, **b: self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.out = lambda: [r for b in run(iter(self.batches)) for r in b.to_pylist()]
        return self


@pytest.fixture
def here(spark, monkeypatch):
    monkeypatch.setattr(reference, "is_prepared", lambda ref: False)
    monkeypatch.setattr(reference, "dealt", lambda df: df)
    monkeypatch.setattr(reference, "ship", lambda spark: None)


def code(kmer):
    return sum("ACGT".index(c) << 2 * i for i, c in enumerate(reversed(kmer)))


def brute(rows, q):
    return [(q, code(s[i : i + q]), n, i) for s, n in rows for i in range(len(s) - q + 1) if set(s[i : i + q]) <= set("ACGT")]


@pytest.mark.parametrize("segment", [1 << 20, 7, 40])
def test_kmers_by_pieces(here, monkeypatch, segment):
    monkeypatch.setattr(reference, "SEGMENT", segment)
    for sizes in ([1], [5], [3, 4, 11], [16], [15, 20]):
        task = Task(ODD, 2)
        reference.kmers(task, *sizes)
        got = [(r["q"], r["code"], r["seq_id"], r["pos"]) for r in task.out()]
        assert sorted(got) == sorted(x for q in sizes for x in brute(ODD, q))
    task = Task(ODD, 2)
    reference.kmers(task, 0)
    assert sorted((r["code"], r["seq_id"], r["pos"]) for r in task.out()) == sorted((0, n, i) for s, n in ODD for i in range(len(s)))


@pytest.mark.parametrize("held", [1 << 20, 5])
def test_frequencies_by_pieces(here, monkeypatch, held):
    monkeypatch.setattr(reference, "SEGMENT", 40)
    monkeypatch.setattr(reference, "MOST_HELD", held, raising=False)
    task = Task(ODD, 2)
    reference.kmer_frequencies(task, 6)
    got = Counter()
    for r in task.out():
        got[r["code"]] += r["n"]
    assert got == Counter(x[1] for x in brute(ODD, 6))


@pytest.mark.parametrize("k", [5, 8])
def test_counting_holds_a_piece_not_a_batch(here, k):
    rng = random.Random(1)
    task = Task([("".join(rng.choices("ACGT", k=2000)), i) for i in range(8000)])
    reference.kmer_frequencies(task, k)
    tracemalloc.start()
    n = sum(r["n"] for r in task.out())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 8000 * (2001 - k) and peak < 100e6


def test_mask(spark):
    import pickle

    import numpy as np

    keys = [-(2**62), -1, 0, 1, 32_768, 16_777_212, 16_777_213, 2**62, 12_345_678_901]
    m = pickle.loads(pickle.dumps(mask.mask(spark.createDataFrame([(x,) for x in keys], "k bigint"), F.col("k"))))
    assert m.has(np.array(keys)).all() and m.has(np.array([0, 1, 32_768], np.uint32)).all()
    assert not m.has(np.array([2, 3, -2, 32_767, 32_769, 16_777_211, 2**62 + 5])).any()
    assert mask.mask(spark.range(9_000_000), F.col("id")) is None
    assert not mask.mask(spark.range(0), F.col("id")).has(np.arange(9)).any()


def test_a_search_moves_candidates_not_the_reference(spark):
    rng = random.Random(3)
    ref = [(i, i % 2, f"s{i}", "".join(rng.choices("ACGT", k=3000))) for i in range(-300, 300)]
    reads = [(7, ref[40][3][2500:2700]), (8, ref[41][3][1000:1100])]
    rf = spark.createDataFrame(ref, "seq_id bigint, file_id int, seq_name string, seq string").repartition(4).localCheckpoint()
    rd = spark.createDataFrame(reads, "read_id bigint, seq string")

    for find in (search.exact, lambda q, r: search.hamming(q, r, 2), lambda q, r: search.edit(q, r, 1)):
        before = shuffled(spark)
        got = {(r.read_id, r.strand, r.seq_id, r.begin, r.end) for r in find(search.both_strands(rd), rf).collect() if r.distance == 0}
        assert got == {(7, "+", -260, 2500, 2700), (8, "+", -259, 1000, 1100)}
        assert shuffled(spark) - before < 200_000  # of 1,800,000 letters


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    x = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(x.apply(i).totalShuffleWrite() for i in range(x.size()))


@pytest.mark.parametrize("n", [1, 7, 600])
def test_buckets_are_sparks(spark, n):
    import numpy as np

    rows = spark.range(0, 4**15, 9_999_991).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("b")).collect()
    assert packed.bucket(np.array([r.id for r in rows]), n).tolist() == [r.b for r in rows]
    assert packed.bucket(packed.first_of_buckets(n), n).tolist() == list(range(n))


@pytest.mark.parametrize("k,wide", [(4, False), (12, False), (15, True)])
def test_order_of_packed_kmers(k, wide):
    import numpy as np

    rng = np.random.default_rng(5)
    code, place = rng.integers(0, 4**k, 3000).astype(np.uint32), rng.permutation(1 << 14)[:3000].astype(np.uint32) << (17 if wide else 0)
    buckets = 40_000 if wide else 7
    where = packed.bucket(code, buckets).astype(np.uint32)
    got = [(n, c, p) for n, cs, ps in packed.in_order(where, code, place, buckets, k) for c, p in zip(cs.tolist(), ps.tolist())]
    assert got == sorted(zip(where.tolist(), code.tolist(), place.tolist()))
    columns = [np.array(x) for x in ([0, 5, 2**40, -3], [], [1, 255, 256, 2**31], [0, 0])]
    assert [x.tolist() for x in packed.unpack(packed.pack(*columns))] == [x.tolist() for x in columns]


@pytest.mark.parametrize("letters", [250_000, 5_000])
def test_a_reference_is_prepared_from_packed_kmers(spark, tmp_path, monkeypatch, letters):
    rng = random.Random(4)
    monkeypatch.setattr(prepared, "BUCKET", letters)
    ref = [(7 * i - 900, i % 2, f"s{i}", "".join(rng.choices("ACGTN" if i == 3 else "ACGT", k=rng.choice([0, 5, 900, 9000])))) for i in range(300)]
    rf = spark.createDataFrame(ref, "seq_id bigint, file_id int, seq_name string, seq string").repartition(4).localCheckpoint()
    before = shuffled(spark)
    p = prepared.build(rf, f"file://{tmp_path}/ref", k=11)
    letters = sum(len(x[3]) for x in ref)
    assert shuffled(spark) - before < 6 * letters  # 10.8 a letter when each was a row
    want = sorted((code_, n, i) for _, code_, n, i in brute([(x[3], x[0]) for x in ref], 11))
    assert sorted(map(tuple, p.kmers.select("code", "seq_id", "pos").collect())) == want
    # each bucket holds its own codes, so that Spark's bucketed reads find all
    assert len(want) == p.kmers.groupBy("code").count().agg(F.sum("count")).first()[0]
    assert p.kmers.join(p.kmers.select("code").distinct().hint("merge"), "code").count() == len(want)
