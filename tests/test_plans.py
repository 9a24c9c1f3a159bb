import pytest
from pyspark.sql import functions as F

from seqloom.operators import insert_size, pairing, ranking, reference
from seqloom.plans import schemes
from seqloom.plans.aligner import Options, paired_end

HIT = "pair_id bigint, mate int, strand string, seq_id bigint, begin int, end int, distance int, cigar string"


@pytest.mark.parametrize("name", ["naive", "pigeon", "suffix_filter", "01*0"])
@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_generated_schemes_are_valid_and_lossless(name, k):
    scheme = schemes.GENERATORS[name](k)
    assert not any(s.problems() for s in scheme) and schemes.is_lossless(scheme, k)
    assert schemes.is_lossless(schemes.mirrored(scheme), k) and not any(s.problems() for s in schemes.mirrored(scheme))


def test_coverage_counts(spark):
    from math import comb

    for p, k in ((3, 2), (4, 3), (5, 4)):
        assert schemes.distributions(spark, p, k).count() == comb(p + k, k)
    gaps = schemes.coverage(spark, schemes.pigeonhole(2)[:2], 2).where("searches = 0").collect()
    assert gaps and all(r.errors[0] and r.errors[1] for r in gaps)


def test_scheme_text():
    s = schemes.parse("{0,1,2} {0,0,0} {0,2,2}\n{2,1,0}, {0,0,1}, {0,1,2}\n\n")
    assert s[1] == schemes.Search((2, 1, 0), (0, 0, 1), (0, 1, 2)) and schemes.critical_part(s) == 0
    assert schemes.Search((0, 2, 1), (0, 0, 0), (0, 1, 2)).problems() == ["parts are not connected"]
    assert schemes.Search((0, 1), (0, 0), (1, 0)).problems() == ["bounds fall"]
    with pytest.raises(ValueError):
        schemes.parse("{0} {0}")


def test_options_are_checked():
    for bad in ({"mode": "some"}, {"metric": "x"}, {"max_distance": 14}, {"min_identity": 49}, {"kmer_size": 16}, {"min_insert": 9, "max_insert": 8}, {"trim": (5, 5)}, {"xa": True, "cigar": False}):
        with pytest.raises(ValueError):
            Options(**bad)


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, HIT)


def test_orientations(spark):
    one = (1, 1, "+", 0, 100, 150, 1, "50M"), (1, 2, "-", 0, 300, 350, 0, "50M")
    h = pairs_of(spark, [*one, (1, 2, "-", 1, 300, 350, 0, "50M"), (2, 1, "-", 0, 10, 60, 0, "50M"), (2, 2, "+", 0, 200, 250, 0, "50M"), (3, 1, "+", 0, 10, 60, 0, "50M"), (3, 2, "+", 0, 90, 140, 0, "50M")])
    for o, want in (("FR", (1, 250)), ("RF", (2, 240)), ("FF", (3, 130))):
        got = [(r.pair_id, r.frag_size) for r in pairing.concordant(h, o, 0, 500).collect()]
        assert got == [want]
    assert pairing.concordant(h, "FR", 251, 500).collect() == []


def test_discordant_and_status(spark):
    h = pairs_of(spark, [(1, 1, "+", 0, 100, 150, 1, "50M"), (1, 2, "+", 3, 40, 90, 0, "50M"), (2, 1, "+", 0, 5, 55, 0, "50M"), (4, 1, "+", 0, 0, 9, 0, "9M"), (4, 2, "-", 0, 20, 29, 0, "9M")])
    good = pairing.concordant(h, "FR", 0, 100)
    bad = pairing.discordant(h, good)
    r = bad.first()
    assert bad.count() == 1 and (r.up_mate, r.down_mate, r.frag_size, r.distance, r.discordant) == (2, 1, 0, 1, True)
    assert pairing.discordant(h, good, most=0).collect() == []
    every = spark.createDataFrame([(i,) for i in range(1, 5)], "pair_id bigint")
    got = {x.pair_id: x.status for x in pairing.status(good.unionByName(bad), h, every).collect()}
    assert got == {1: "discordant", 2: "mate1", 3: "unmapped", 4: "concordant"}


def test_mapping_quality(spark):
    rows = [(n, "+", i, 10 * i, 10 * i + 5, 1, "5M") for n in (1, 2, 3, 4, 9, 10) for i in range(n)] + [(1, "-", 0, 3, 8, 2, "5M")]
    df = spark.createDataFrame(rows, "read_id bigint, strand string, seq_id bigint, begin int, end int, distance int, cigar string")
    got = ranking.ranked(ranking.strata(df, 1)).collect()
    assert {r.read_id: r.mapq for r in got if r.distance == 1} == {1: 60, 2: 3, 3: 2, 4: 1, 9: 1, 10: 0}
    second = next(r for r in got if r.distance == 2)
    assert second.mapq == 0 and second.flag == 272 and not second.is_primary


def test_insert_size(spark):
    def of(sizes):
        return insert_size.inferred(spark.createDataFrame([(i, o, s) for i, (o, s) in enumerate(sizes)], "pair_id bigint, orientation string, frag_size int")).first()

    r = of([("FR", s) for s in (300, 310, 290, 305, 295, 9000)])
    assert (r.median, r.mad, r.orientation) == (302, 7, "FR") and abs(r["mean"] - 300) < 1e-6 and r.max_insert == 347 and r.min_insert == 253
    same = of([("RF", 200)] * 5)
    assert (same["mean"], same.stddev, same.min_insert, same.max_insert, same.orientation) == (200, 0, 200, 200, "RF")
    for few in ([], [("FF", 70)]):
        r = of(few)
        assert (r.min_insert, r.max_insert, r.orientation) == (0, 500, "FR")


def test_paired_end_infers_and_finds(spark):
    import random

    rng = random.Random(6)
    ref = [(0, 0, "a", "".join(rng.choice("ACGT") for _ in range(4000)))]
    comp = str.maketrans("ACGT", "TGCA")
    rows = []
    for p in range(12):
        at, size = 100 + 250 * p, 200 + p % 3
        s = ref[0][3]
        rows += [(p, 1, s[at : at + 40]), (p, 2, s[at + size - 40 : at + size][::-1].translate(comp))]
    rows += [(12, 1, ref[0][3][:40]), (12, 2, "N" * 40)]
    pairs, found, library = paired_end(spark.createDataFrame(rows, "pair_id bigint, mate int, seq string"), spark.createDataFrame(ref, "seq_id bigint, file_id int, seq_name string, seq string"), Options(mode="best", min_identity=95))
    p = library.first()
    assert p.orientation == "FR" and p.median == 201 and {r.pair_id for r in pairs.collect()} == set(range(12))
    assert all(r.mapq == 60 and r.rank == 1 and 200 <= r.frag_size <= 202 for r in pairs.collect())


def test_location_in_the_concatenation(spark):
    ref = spark.createDataFrame([(0, "a", "A" * 100), (1, "e", ""), (2, "b", "C" * 70_000), (3, "c", "G" * 10)], "seq_id bigint, seq_name string, seq string")
    c = reference.catalogue(ref)
    at = spark.createDataFrame([(0, 5), (98, 5), (100, 5), (70_099, 1), (70_100, 10), (70_105, 10)], "pos bigint, width int")
    got = {r.pos: (r.seq_id, r.begin, r.found) for r in reference.located(at, c).collect()}
    assert got == {0: (0, 0, "found"), 98: (0, 98, "clipped"), 100: (2, 0, "found"), 70_099: (2, 69_999, "found"), 70_100: (3, 0, "found"), 70_105: (3, 5, "clipped")}
    with pytest.raises(ValueError):
        reference.checked_names(ref.unionByName(ref.withColumn("seq_id", F.col("seq_id") + 10)))
