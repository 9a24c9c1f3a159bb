import gzip

import pytest

from seqloom.functions import dna
from seqloom.plans.aligner import Options, single_end
from seqloom.sources import fastx, sinks
from seqloom.streaming.reads import align_stream


def put(path, text):
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(text)
    return str(path)


def test_fasta_and_fastq(spark, tmp_path):
    a = put(tmp_path / "a.fa", ">one first\nacgt\nNNAC\n>two\nGGGG\n\n")
    b = put(tmp_path / "b.fasta.gz", ">three x\r\nTTTT\r\nAA\r\n")
    ref = fastx.reference(spark, a, str(tmp_path / "b"), seed="GT")
    assert [tuple(r) for r in ref.orderBy("seq_id").collect()] == [(0, 0, "one", "ACGTGTAC"), (1, 0, "two", "GGGG"), (2, 1, "three", "TTTTAA")]
    bare = put(tmp_path / "bare.fna", "ACGT\nAC\n")
    assert fastx.fasta(spark, bare).first().seq == "ACGTAC" and fastx.fasta(spark, bare).first().name == bare
    with pytest.raises(ValueError):
        fastx.reference(spark, a, put(tmp_path / "c.fa", ">two\nA\n"))
    q = put(tmp_path / "r.fq", "@r1 x\nACGTx\n+\nIIII#\n\n@r2\nGG\n+r2\n@@\n")
    got = [tuple(r) for r in fastx.reads(spark, q).orderBy("read_ord").collect()]
    assert got == [("r1", 0, "ACGTN", "IIII#"), ("r2", 1, "GG", "@@")]
    m = put(tmp_path / "m.fastq", "@m1\nAA\n+\nII\n")
    assert sorted((r.pair_id, r.mate, r.seq) for r in fastx.pairs(spark, q, m).collect()) == [(0, 1, "ACGTN"), (0, 2, "AA")]
    assert fastx.reads(spark, a).where("read_id = 'one'").first().qual == "*"
    with pytest.raises(ValueError):
        fastx.file_type("x.txt")


def test_scheme_folder(spark, tmp_path):
    (tmp_path / "2").mkdir()
    put(tmp_path / "name.txt", "mine\n")
    put(tmp_path / "2" / "searches.txt", "{0,1,2} {0,0,0} {0,2,2}\n{1,2,0} {0,0,0} {0,2,2}\n{2,1,0} {0,0,0} {0,2,2}\n")
    put(tmp_path / "2" / "static_partitioning.txt", "0.4 0.7\n")
    s = fastx.scheme_folder(spark, str(tmp_path), 2)
    assert s["name"] == "mine" and len(s["schemes"][0]) == 3 and s["static"] == [[0.4, 0.7]] and s["dynamic"] is None
    with pytest.raises(FileNotFoundError):
        fastx.scheme_folder(spark, str(tmp_path), 3)


def test_scalars(spark):
    df = spark.createDataFrame([("ACGTN",)], "s string")
    s = df["s"]
    r = df.select(dna.reverse_complement(s).alias("rc"), dna.complement(s).alias("c"), dna.is_acgt(s).alias("a"), dna.contains_n(s).alias("n"), dna.unpacked(dna.packed(dna.complement(dna.trimmed(s, 0, 4))), 4).alias("u"), dna.trimmed(s, 1, 9).alias("t"), dna.trimmed_quality(s, s, 1, 3).alias("q"), dna.max_errors(dna.F.length(s) * 30, 95).alias("e")).first()
    assert tuple(r) == ("NACGT", "TGCAN", False, True, "TGCA", "ACGTN", "CG", 7)
    h = spark.createDataFrame([("ACGN", "ACTN")], "a string, b string")
    assert h.select(dna.hamming(h.a, h.b)).first()[0] == 2


def test_sam_and_summary(spark, tmp_path):
    ref = spark.createDataFrame([(0, 0, "a", "ACGTTGCATTGACCAGTA"), (1, 0, "b", "GGGGACGTTGCATTCCCC")], "seq_id bigint, file_id int, seq_name string, seq string")
    reads = spark.createDataFrame([(1, "ACGTTGCATT", "IIIIIIIIIJ"), (2, "AATGCAACGT", "ABCDEFGHIJ"), (3, "CCCCCCCCCC", "")], "read_id bigint, seq string, qual string")
    hits = single_end(reads.select("read_id", "seq"), ref, Options(mode="all"))
    lines = {(r.read_id, r["rank"]): r.line.split("\t") for r in sinks.sam_single(hits, reads, ref).collect()}
    assert lines[1, 1] == ["1", "0", "a", "1", "3", "10M", "*", "0", "0", "ACGTTGCATT", "IIIIIIIIIJ", "AS:i:0", "NM:i:0", "PG:Z:seqloom"]
    assert lines[1, 2][1] == "256" and lines[1, 2][9:11] == ["*", "*"]
    assert lines[2, 1][1] == "16" and lines[2, 1][9:11] == ["ACGTTGCATT", "JIHGFEDCBA"]
    assert lines[3, 1] == ["3", "4", "*", "0", "0", "*", "*", "0", "0", "CCCCCCCCCC", "*", "PG:Z:seqloom"]
    xa = {r.read_id: r.line for r in sinks.sam_single(hits, reads, ref, unmapped=False, xa=True).collect()}
    assert xa[1].endswith("X0:i:1\tX1:i:0\tXA:Z:b,+5,10M,0;") and 3 not in xa
    assert {r.read_id: r.hits for r in sinks.summary(hits, reads).collect()} == {1: "(0,0);(1,0)", 2: "(0,0);(1,0)", 3: "*"}
    out = sinks.sam_header(ref).unionByName(sinks.sam_single(hits, reads, ref).selectExpr("read_id read_ord", "bigint(rank) rank", "line"))
    sinks.write(out, f"{tmp_path}/x", zipped=True, order=["read_ord", "rank"])
    text = [r.value for r in spark.read.text(f"{tmp_path}/x").collect()]
    assert len(text) == 9 and any(t.startswith("@SQ\tSN:b\tLN:18") for t in text)
    assert sinks.output_type("a/B.SAM.gz") == ("sam", True)
    with pytest.raises(ValueError):
        sinks.output_type("x.bam")


def test_stream(spark, tmp_path):
    ref = spark.createDataFrame([(0, 0, "a", "ACGTTGCATTGACCAGTA" * 3)], "seq_id bigint, file_id int, seq_name string, seq string")
    reads = spark.createDataFrame([(i, "ACGTTGCATTGACCAGTA"[i : i + 10]) for i in range(8)], "read_id bigint, seq string")
    reads.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    align_stream(stream, ref, Options(mode="all"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(r.read_id, r.begin, r.mapq) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(r.read_id, r.begin, r.mapq) for r in single_end(reads, ref, Options(mode="all")).collect()}
