import random

import pytest

from seqloom.operators import search
from seqloom.plans import prepared
from seqloom.plans.aligner import Options, hits, single_end
from seqloom.plans.run import run
from tests.test_search import READ, REF, data, rc


@pytest.fixture(scope="module")
def opened(spark, tmp_path_factory):
    ref, reads = data(11, indels=True)
    path = f"file://{tmp_path_factory.mktemp('ref')}/r"
    prepared.build(spark.createDataFrame(ref, REF), path, k=6, pad=200)
    return ref, reads, prepared.open_(spark, path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_prepared_reference_gives_the_same_hits(spark, opened):
    ref, reads, p = opened
    rf, rd = spark.createDataFrame(ref, REF), spark.createDataFrame(reads, READ)
    assert p.k == 6 and rows(p.sequences.select("seq_id", "seq")) == sorted(((r[0], r[3]) for r in ref), key=repr)
    q = search.both_strands(rd)
    assert rows(search.exact(q, p)) == rows(search.exact(q, rf))
    assert rows(search.hamming(q, p, 2)) == rows(search.hamming(q, rf, 2))
    o = Options(mode="all", max_distance=2)
    assert rows(hits(rd, p, o)) == rows(hits(rd, rf, o))


def test_schemes_and_partitions_change_no_answer(spark, opened, tmp_path):
    ref, reads, p = opened
    rd = spark.createDataFrame(reads, READ)
    (tmp_path / "own" / "1").mkdir(parents=True)
    (tmp_path / "own" / "2").mkdir()
    (tmp_path / "own" / "name.txt").write_text("own\n")
    (tmp_path / "own" / "2" / "searches.txt").write_text("{0,1,2} {0,0,0} {0,2,2}\n{2,1,0} {0,0,0} {0,1,2}\n{1,0,2} {0,0,1} {0,1,2}\n")
    (tmp_path / "own" / "2" / "static_partitioning.txt").write_text("0.3 0.7\n")
    want = rows(hits(rd, p, Options(mode="all", metric="hamming", max_distance=2, partitioning="uniform")))
    for scheme, partitioning in (("pigeon", "dynamic"), ("01*0", "uniform"), ("suffix_filter", "dynamic"), ("naive", "uniform"), (f"file://{tmp_path}/own", "static")):
        assert rows(hits(rd, p, Options(mode="all", metric="hamming", max_distance=2, scheme=scheme, partitioning=partitioning))) == want, scheme
    (tmp_path / "own" / "2" / "searches.txt").write_text("{0,1,2} {0,0,0} {0,2,2}\n")
    with pytest.raises(ValueError, match="misses"):
        hits(rd, p, Options(mode="all", max_distance=2, scheme=f"file://{tmp_path}/own"))
    with pytest.raises(ValueError, match="neither"):
        hits(rd, p, Options(mode="all", max_distance=2, scheme="none such"))


def lines(path, folder="*"):
    return [x for f in sorted(path.glob(f"{folder}/part-*")) for x in f.read_text().splitlines()]


def test_from_files_to_sam(spark, tmp_path):
    rng = random.Random(3)
    ref = ["".join(rng.choice("ACGT") for _ in range(1500)) for _ in range(3)]
    (tmp_path / "a.fa").write_text("".join(f">s{i} x\n{s[:700]}\n{s[700:]}\n" for i, s in enumerate(ref[:2])))
    (tmp_path / "b.fa").write_text(f">s2\n{ref[2]}\n")
    (tmp_path / "refs.txt").write_text(f"file://{tmp_path}/a.fa\nfile://{tmp_path}/b.fa\n")
    reads, mates = [], []
    for i in range(30):
        s, at = ref[i % 3], rng.randint(0, 1100)
        reads.append(s[at : at + 60])
        mates.append(rc(s[at + 200 : at + 260]))
    reads[4] = "ACGT" * 15
    for name, some in (("r", reads), ("m", [*mates, "ACGT"])):
        (tmp_path / f"{name}.fq").write_text("".join(f"@same\n{s}\n+\n{'I' * len(s)}\n" for s in some))
    f = f"file://{tmp_path}"
    got = run(spark, f"{f}/refs.txt", f"{f}/r.fq", f"{f}/out.sam", Options(reorder=True, kmer_size=8)).first()
    sam = lines(tmp_path, "out.sam")
    assert sam[0].startswith("@HD") and sum(x.startswith("@SQ") for x in sam) == 3 and got.reads == 30 and got.mapped_reads == 29
    body = [x.split("\t") for x in sam if not x.startswith("@")]
    assert len(body) == 30 and all(x[0] == "same" for x in body) and [x[9] for x in body] == reads and body[4][1] == "4"
    first = run(spark, f"{f}/refs.txt", f"{f}/r.fq", f"{f}/few.sam.gz", Options(report_unmapped=False)).first()
    import gzip

    zipped = [x for z in sorted(tmp_path.glob("few.sam.gz/part-*")) for x in gzip.open(z, "rt").read().splitlines()]
    assert first.mapped_reads == 29 and len([x for x in zipped if x[0] != "@"]) == 29 and zipped[0].startswith("@HD")
    run(spark, [f"{f}/a.fa", f"{f}/b.fa"], f"{f}/r.fq", f"{f}/out.rhs", Options(reorder=True))
    rhs = lines(tmp_path, "out.rhs")
    assert rhs[0] == "ReadID\tHits" and rhs[1] == "same\t(0,0)" and rhs[5] == "same\t*" and len(rhs) == 31
    status = {r.status: r.pairs for r in run(spark, f"{f}/refs.txt", f"{f}/r.fq", f"{f}/pairs.sam", Options(reorder=True), mates=f"{f}/m.fq").collect()}
    assert status == {"concordant": 29, "mate2": 1}
    body = [x.split("\t") for x in lines(tmp_path, "pairs.sam") if not x.startswith("@")]
    assert len(body) == 60 and {x[8].lstrip("-") for x in body if x[6] != "*"} == {"260"} and sum(int(x[1]) & 4 > 0 for x in body) == 1
    with pytest.raises(ValueError, match="single"):
        run(spark, f"{f}/refs.txt", f"{f}/r.fq", f"{f}/p.rhs", mates=f"{f}/m.fq")
    best = single_end(spark.createDataFrame([(i, s) for i, s in enumerate(reads)], READ), spark.createDataFrame([(i, 0, f"s{i}", s) for i, s in enumerate(ref)], REF), Options())
    assert {(r.read_id, r.begin) for r in best.collect()} == {(i, int(x[3]) - 1) for i, x in enumerate([x.split("\t") for x in sam if x[0] != "@"]) if x[1] != "4"}
