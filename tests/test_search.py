import random

import numpy as np

from seqloom.operators import dedupe, kernels, search
from seqloom.plans.aligner import Options, hits, single_end

REF, READ = "seq_id bigint, file_id int, seq_name string, seq string", "read_id bigint, seq string"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def data(seed, n_ref=8, n_reads=25, indels=False):
    rng = random.Random(seed)
    ref = [(i, i % 2, f"s{i}", "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 5, 60, 400, 1500])))) for i in range(n_ref)]
    ref.append((n_ref, 0, "rep", "ACGTACGT" * 60 + "A" * 120))
    reads = []
    for r in range(n_reads):
        s = rng.choice([x for x in ref if len(x[3]) >= 60])[3]
        m = rng.randint(18, 50)
        at = rng.randint(0, len(s) - m)
        w = list(s[at : at + m])
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            kind = rng.choice("sid") if indels else "s"
            if kind == "s":
                w[i] = rng.choice("ACGTN")
            elif kind == "i":
                w.insert(i, rng.choice("ACGT"))
            else:
                del w[i]
        w = "".join(w)
        reads.append((r, rc(w) if rng.random() < 0.5 else w))
    reads += [(500, "ACGTAC"), (501, "A"), (502, "N" * 20), (503, "ACGT" * 200)]
    return ref, reads


def brute_hamming(ref, reads, k):
    out = set()
    for r, s in reads:
        for strand, q in (("+", s), ("-", rc(s))):
            for i, _, _, t in ref:
                for b in range(len(t) - len(q) + 1):
                    d = sum(x != y or x == "N" for x, y in zip(q, t[b : b + len(q)]))
                    if q and d <= k:
                        out.add((r, strand, i, b, b + len(q), d))
    return out


def test_hamming_as_brute_force(spark):
    ref, reads = data(1)
    rf, rd = spark.createDataFrame(ref, REF), spark.createDataFrame(reads, READ)
    for k in (0, 1, 3):
        got = [tuple(x)[:6] for x in search.hamming(search.both_strands(rd), rf, k).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_hamming(ref, reads, k)
    exact = {tuple(x)[:6] for x in search.exact(search.both_strands(rd), rf).collect()}
    assert exact == brute_hamming(ref, reads, 0)


def semi_global(q, t):
    """Best distance of q ending at each position of t."""
    row = list(range(len(q) + 1))
    out = [row[-1]]
    for c in t:
        new = [0]
        for j, x in enumerate(q):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != c or x == "N")))
        row = new
        out.append(row[-1])
    return out


def test_edit_finds_every_centre(spark):
    ref, reads = data(2, indels=True)
    rf, rd = spark.createDataFrame(ref, REF), spark.createDataFrame(reads, READ)
    k = 2
    got = {}
    for x in search.edit(search.both_strands(rd), rf, k).collect():
        got.setdefault((x.read_id, x.strand, x.seq_id), {})[x.end] = x
    # a read of at most k letters matches at every place, if need be without one of its letters
    assert {x.seq_id for (r, _, _), f in got.items() if r == 501 for x in f.values()} == {r[0] for r in ref if r[3]}
    for r, s in reads:
        if len(s) <= k:
            continue
        for strand, q in (("+", s), ("-", rc(s))):
            for i, _, _, t in ref:
                last = semi_global(q, t)
                ends = {e: d for e, d in enumerate(last) if d <= k and t and d <= last[max(e - 1, 0)] and d <= last[min(e + 1, len(t))]}
                found = got.get((r, strand, i), {})
                assert {e: h.distance for e, h in found.items()} == ends, (r, strand, i)


def cost(q, t, cigar):
    import re

    i = j = d = 0
    for n, op in re.findall(r"(\d+)([MID])", cigar):
        n = int(n)
        if op == "M":
            d += sum(x != y or x == "N" for x, y in zip(q[j : j + n], t[i : i + n]))
            i, j = i + n, j + n
        else:
            d += n
            i, j = (i, j + n) if op == "I" else (i + n, j)
    return d, i, j


def test_cigars_and_best_hits(spark):
    ref, reads = data(3, indels=True)
    rf, rd = spark.createDataFrame(ref, REF), spark.createDataFrame(reads, READ)
    text, seq = {r[0]: r[3] for r in ref}, dict(reads)
    every = hits(rd, rf, Options(mode="all", max_distance=2)).collect()
    assert every
    for h in every:
        q = seq[h.read_id] if h.strand == "+" else rc(seq[h.read_id])
        assert cost(q, text[h.seq_id][h.begin : h.end], h.cigar) == (h.distance, h.end - h.begin, len(q))
    best = single_end(rd, rf, Options(mode="best", min_identity=90)).collect()
    for h in best:
        q = seq[h.read_id]
        limit = min(13, len(q) * 10 // 100)
        least = min(min(semi_global(x, t)) for x in (q, rc(q)) for t in text.values() if t)
        assert h.distance == least == h.best <= limit
    assert sum(h.is_primary for h in best) == len({h.read_id for h in best})


def test_tandem_repeats_keep_all_their_best_hits(spark):
    rf = spark.createDataFrame([(0, 0, "s", "ACGT" * 30)], REF)
    rd = spark.createDataFrame([(1, "ACGT" * 10), (2, "ACGT" * 5 + "TACGTACGTACGTACGTACGT")], READ)
    best = [h for h in single_end(rd, rf, Options(mode="best", min_identity=95)).collect() if h.read_id == 1]
    assert len(best) == 42 and {h.distance for h in best} == {0} and {h.n_best for h in best} == {42}
    # a stratum more: the radius is that of the last one reported
    more = [h for h in single_end(rd, rf, Options(mode="best", min_identity=95, strata_after_best=1)).collect() if h.read_id == 1]
    assert {h.distance for h in more} == {0} and 0 < len(more) <= 42
    two = [h for h in single_end(rd, rf, Options(mode="best", min_identity=95)).collect() if h.read_id == 2]
    assert {h.distance for h in two} == {1} and len(two) > 2


def test_time_of_tiles_is_that_of_the_letters(spark):
    import time

    from seqloom.functions import dna
    from seqloom.operators import reference
    from pyspark.sql import functions as F

    def took(n):
        seq = F.concat(F.repeat(F.lit("ACGTTGCA"), n // 16), F.repeat(F.lit("N"), n // 4), F.repeat(F.lit("CCGTTGAA"), n // 32))
        df = spark.range(1).select(F.lit(0).cast("bigint").alias("seq_id"), dna.without_odd_letters(seq, "GATT").alias("seq"))
        began = time.time()
        rows = reference.tiles(df, 1024, 100, 100).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("m")).first()
        assert rows.n == -(-n // 1024)
        return time.time() - began

    took(100_000)
    assert took(16_000_000) < 16 * max(took(2_000_000), 0.5)


def test_metamorphic_scheme_and_strand(spark):
    ref, reads = data(4)
    rf = spark.createDataFrame(ref, REF)
    a = {tuple(x)[:6] for x in search.hamming(search.both_strands(spark.createDataFrame(reads, READ)), rf, 2).collect()}
    b = {tuple(x)[:6] for x in search.hamming(search.both_strands(spark.createDataFrame([(r, rc(s)) for r, s in reads], READ)), rf, 2).collect()}
    flip = {"+": "-", "-": "+"}
    assert {(r, flip[s], *rest) for r, s, *rest in a} == b
    c = {tuple(x)[:6] for x in search.hamming(search.both_strands(spark.createDataFrame(reads, READ)), rf, 3).collect()}
    assert a <= c


def test_redundancy_fold_compares_with_the_last_survivor(spark):
    rows = [(1, "+", 0, b, b + 20, d, f"{b}M") for b, d in ((0, 3), (6, 2), (12, 1), (40, 1), (41, 1), (50, 0))]
    df = spark.createDataFrame(rows, "read_id bigint, strand string, seq_id bigint, begin int, end int, distance int, cigar string")
    got = sorted(r.begin for r in dedupe.non_redundant(df, 3, False).collect())
    assert got == [12, 40, 50]
    assert dedupe.non_redundant(df.limit(0), 3, False).collect() == []


def test_kernel_prefers_insertions_then_the_diagonal():
    d = kernels.matrices(kernels.codes("AACC")[None], kernels.codes("AAC")[None])[0]
    assert kernels.trace(d, kernels.codes("AACC"), kernels.codes("AAC"), 3) == (0, "3M1I")
    assert kernels.ends(np.array([4, 3, 2, 2, 3]), 2).tolist() == [2, 3]
