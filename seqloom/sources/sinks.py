"""SAM, read-hit summaries, FASTA and FASTQ as tables of lines, and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna

PROGRAM = "seqloom"


def output_type(path: str) -> tuple[str, bool]:
    """"sam" or "rhs", and whether the file is gzipped."""
    low = path.lower()
    zipped = low.endswith(".gz")
    kind = low.removesuffix(".gz").rpartition(".")[2]
    if kind not in ("sam", "rhs"):
        raise ValueError(f"{path}: the extension is .sam or .rhs, with .gz or without")
    return kind, zipped


def sam_header(ref: DataFrame, command: str = "") -> DataFrame:
    """read_ord (before all reads), rank, line."""
    spark = ref.sparkSession
    top = spark.createDataFrame([(-2, 0, "@HD\tVN:1.6\tSO:queryname"), (-2, 1, f"@PG\tID:{PROGRAM}\tPN:{PROGRAM}\tCL:{command}")], "read_ord bigint, rank bigint, line string")
    names = ref.select(F.lit(-1).cast("bigint").alias("read_ord"), F.col("seq_id").alias("rank"), F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), F.col("seq_name")), F.concat(F.lit("LN:"), F.col("length") if "length" in ref.columns else F.length("seq"))).alias("line"))
    return top.unionByName(names)


def _oriented(reads: DataFrame) -> DataFrame:
    out = reads if "qual" in reads.columns else reads.withColumn("qual", F.lit("*"))
    return out.withColumn("qual", F.when(F.coalesce("qual", F.lit("")) == "", "*").otherwise(F.col("qual")))


def sam_single(hits: DataFrame, reads: DataFrame, ref: DataFrame, unmapped: bool = True, xa: bool = False) -> DataFrame:
    """read_id, rank, line. hits: ranked; only the primary record carries the read."""
    reads = _oriented(reads if "name" in reads.columns else reads.withColumn("name", F.col("read_id").cast("string"))).select("read_id", "name", "seq", "qual")
    full = hits.join(ref.select("seq_id", "seq_name"), "seq_id").join(reads, "read_id")
    back = F.col("strand") == "-"
    seq = F.when(back, dna.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    qual = F.when(back, F.reverse("qual")).otherwise(F.col("qual"))
    star = lambda c: F.when(F.col("is_primary"), c).otherwise(F.lit("*"))
    d = F.col("distance").cast("string")
    line = F.concat_ws("\t", "name", F.col("flag").cast("string"), "seq_name", (F.col("begin") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*\t0\t0"), star(seq), star(qual), F.concat(F.lit("AS:i:"), d), F.concat(F.lit("NM:i:"), d), F.lit(f"PG:Z:{PROGRAM}"))
    rows = full.select("read_id", "rank", line.alias("line"), F.concat("seq_name", F.lit(","), F.when(back, "-").otherwise("+"), (F.col("begin") + 1).cast("string"), F.lit(","), "cigar", F.lit(","), d, F.lit(";")).alias("alt"), "n_best")
    if xa:
        others = F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "alt"))))
        by = rows.groupBy("read_id").agg(F.min_by("line", "rank").alias("line"), F.first("n_best").alias("n_best"), others.alias("o"))
        x0 = F.col("n_best") - 1
        tags = F.concat(F.lit("\tX0:i:"), x0.cast("string"), F.lit("\tX1:i:"), (F.size("o") - x0).cast("string"), F.lit("\tXA:Z:"), F.array_join(F.transform("o", lambda s: s["alt"]), ""))
        rows = by.select("read_id", F.lit(1).alias("rank"), F.concat("line", tags).alias("line"))
    else:
        rows = rows.select("read_id", "rank", "line")
    if unmapped:
        none = reads.join(hits.select("read_id").distinct(), "read_id", "left_anti")
        rows = rows.unionByName(none.select("read_id", F.lit(1).alias("rank"), F.concat_ws("\t", "name", F.lit("4\t*\t0\t0\t*\t*\t0\t0"), "seq", "qual", F.lit(f"PG:Z:{PROGRAM}")).alias("line")))
    return rows


def sam_pairs(pairs: DataFrame, reads: DataFrame, ref: DataFrame) -> DataFrame:
    """pair_id, rank, mate, line: two lines for each ranked pair. reads: pair_id, mate, seq, qual."""
    reads = _oriented(reads if "name" in reads.columns else reads.withColumn("name", F.col("pair_id").cast("string"))).select("pair_id", "mate", "name", "seq", "qual")
    sides = []
    for own, other in (("up", "down"), ("down", "up")):
        sides.append(pairs.select("pair_id", "rank", "mapq", "frag_size", "discordant", *[F.col(f"{own}_{c}").alias(c) for c in ("mate", "strand", "seq_id", "begin", "distance", "cigar")], *[F.col(f"{other}_{c}").alias(f"o_{c}") for c in ("strand", "seq_id", "begin")]))
    rows = sides[0].unionByName(sides[1]).join(reads, ["pair_id", "mate"])
    rows = rows.join(ref.select("seq_id", "seq_name"), "seq_id").join(ref.select(F.col("seq_id").alias("o_seq_id"), F.col("seq_name").alias("o_name")), "o_seq_id")
    yes = F.lit(True)
    flag = dna.flags_pair(yes, yes, F.col("strand"), F.col("o_strand"), F.col("mate") == 1, F.col("discordant"), F.col("rank") == 1)
    back, d = F.col("strand") == "-", F.col("distance").cast("string")
    size = F.concat(F.when(F.col("begin") > F.col("o_begin"), "-").otherwise(""), F.col("frag_size").cast("string"))
    line = F.concat_ws("\t", "name", flag.cast("string"), "seq_name", (F.col("begin") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", "o_name", (F.col("o_begin") + 1).cast("string"), size, F.when(back, dna.reverse_complement(F.col("seq"))).otherwise(F.col("seq")), F.when(back, F.reverse("qual")).otherwise(F.col("qual")), F.concat(F.lit("AS:i:"), d), F.concat(F.lit("NM:i:"), d), F.lit(f"PG:Z:{PROGRAM}"))
    return rows.select("pair_id", "rank", "mate", line.alias("line"))


def sam_without_pair(hits: DataFrame, pairs: DataFrame, reads: DataFrame, ref: DataFrame, unmapped: bool = True) -> DataFrame:
    """pair_id, rank, mate, line of pairs without a pair: best hits of mapped mates, a record for each unmapped mate.

    The reverse strand flag is set on mapped mates that need it.
    """
    from ..operators.pairing import unpaired
    from pyspark.sql import Window as W

    reads = _oriented(reads if "name" in reads.columns else reads.withColumn("name", F.col("pair_id").cast("string"))).select("pair_id", "mate", "name", "seq", "qual").join(pairs.select("pair_id").distinct(), "pair_id", "left_anti")
    own = unpaired(hits, pairs)
    order = W.partitionBy("pair_id", "mate").orderBy("seq_id", "begin", "strand", "end")
    own = own.withColumn("rank", F.row_number().over(order)).join(reads, ["pair_id", "mate"]).join(ref.select("seq_id", "seq_name"), "seq_id")
    back, first, d = F.col("strand") == "-", F.col("rank") == 1, F.col("distance").cast("string")
    flag = F.lit(1) + F.when(F.col("mate") == 1, 64).otherwise(128) + F.when(back, 16).otherwise(0) + F.when(first, 0).otherwise(256)
    star = lambda c: F.when(first, c).otherwise(F.lit("*"))
    line = F.concat_ws("\t", "name", flag.cast("string"), "seq_name", (F.col("begin") + 1).cast("string"), dna.mapq(F.lit(True), F.col("n_best")).cast("string"), "cigar", F.lit("*\t0\t0"), star(F.when(back, dna.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))), star(F.when(back, F.reverse("qual")).otherwise(F.col("qual"))), F.concat(F.lit("AS:i:"), d), F.concat(F.lit("NM:i:"), d), F.lit(f"PG:Z:{PROGRAM}"))
    mapped = own.select("pair_id", "rank", "mate", line.alias("line"))
    if not unmapped:
        return mapped
    other = own.where("rank = 1").select("pair_id", (3 - F.col("mate")).alias("mate"), F.col("strand").alias("o_strand"))
    none = reads.join(own.select("pair_id", "mate").distinct(), ["pair_id", "mate"], "left_anti").join(other, ["pair_id", "mate"], "left")
    flag = F.lit(5) + F.when(F.col("o_strand").isNull(), 8).otherwise(0) + F.when(F.col("o_strand") == "-", 32).otherwise(0) + F.when(F.col("mate") == 1, 64).otherwise(128)
    line = F.concat_ws("\t", "name", flag.cast("string"), F.lit("*\t0\t0\t*\t*\t0\t0"), "seq", "qual", F.lit(f"PG:Z:{PROGRAM}"))
    return mapped.unionByName(none.select("pair_id", F.lit(1).alias("rank"), "mate", line.alias("line")))


def summary(hits: DataFrame, reads: DataFrame, unmapped: bool = True) -> DataFrame:
    """read_id, hits: "(sequence,distance)" of each read, once each, by distance and sequence; "*" without hits."""
    once = hits.select("read_id", "distance", "seq_id").distinct()
    by = once.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("distance", "seq_id"))).alias("h"))
    text = F.array_join(F.transform("h", lambda s: F.concat(F.lit("("), s["seq_id"].cast("string"), F.lit(","), s["distance"].cast("string"), F.lit(")"))), ";")
    rows = reads.select("read_id").join(by, "read_id", "left" if unmapped else "inner")
    return rows.select("read_id", F.coalesce(text, F.lit("*")).alias("hits"))


def summary_header(spark: SparkSession) -> DataFrame:
    """read_ord (before all reads), rank, line."""
    return spark.createDataFrame([(-1, 0, "ReadID\tHits")], "read_ord bigint, rank bigint, line string")


def fasta_lines(rows: DataFrame, name: str = "seq_name") -> DataFrame:
    return rows.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), "seq").alias("line"))


def fastq_lines(rows: DataFrame, name: str = "read_id") -> DataFrame:
    return rows.select(F.concat(F.lit("@"), F.col(name).cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("line"))


def write(lines: DataFrame, path: str, zipped: bool = False, order: list[str] | None = None, first=None) -> None:
    """Lines as text files in a folder; in order, if asked, across the files by name; those that are first (a condition) stand in the first file in any case."""
    if order:
        out = lines.orderBy(*order)
    elif first is not None:
        out = lines.where(first).coalesce(1).sortWithinPartitions("read_ord", "rank").union(lines.where(~first))
    else:
        out = lines
    out.select("line").write.option("compression", "gzip" if zipped else "none").text(path)
