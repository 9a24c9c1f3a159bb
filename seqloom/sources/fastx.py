"""FASTA and FASTQ files, plain or gzipped, as tables; Spark reads and decompresses them."""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna

FASTA, FASTQ = (".fa", ".fna", ".fasta"), (".fq", ".fastq", ".fnq")


def file_type(path: str) -> str:
    """"fasta" or "fastq" by the extension, with or without .gz."""
    base = re.sub(r"\.gz$", "", path.lower())
    for kind, ends in (("fasta", FASTA), ("fastq", FASTQ)):
        if base.endswith(ends):
            return kind
    raise ValueError(f"{path}: not a known kind of sequence file")


def probed(spark: SparkSession, path: str) -> str:
    """path, or the first of its usual extensions that exists where it has none."""
    try:
        file_type(path)
        return path
    except ValueError:
        pass
    for end in (e + z for e in (".fasta", ".fa", ".fna", ".FASTA", ".FA", ".FNA") for z in ("", ".gz")):
        if exists(spark, path + end):
            return path + end
    raise FileNotFoundError(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Paths in a file of paths, one a line."""
    return [r.value.strip() for r in spark.read.text(path).where("trim(value) <> ''").collect()]


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows numbered from 0 in the order of the files: partition sizes are counted, no row moves."""
    df = df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r["_p"]: r["n"] for r in df.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    at, starts = 0, []
    for p in sorted(sizes):
        starts += [F.lit(p), F.lit(at).cast("bigint")]
        at += sizes[p]
    start = F.get(F.array(*starts[1::2]), F.array_position(F.array(*starts[::2]), F.col("_p")).cast("int") - 1) if starts else F.lit(0)
    return df.withColumn(name, (start + F.col("_i")).cast("bigint")).drop("_p", "_i")


def fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """file_id, name (up to the first space), seq (as written, lines joined), path: a row for each record.

    A file without any header is one record named by its path.
    """
    out = None
    for i, path in enumerate(paths):
        raw = spark.read.option("lineSep", ">").text(path).select(F.regexp_replace("value", "\r", "").alias("value"))
        raw = raw.where("trim(value) <> ''").select("value", F.lit(path).alias("path"))
        headed = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
        name = F.substring_index(F.substring_index("value", "\n", 1), " ", 1)
        seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*(\n|$)", ""), r"\s", "")
        if headed and not headed[0].value.startswith(">"):
            name, seq = F.col("path"), F.regexp_replace("value", r"\s", "")
        rows = raw.select(F.lit(i).alias("file_id"), name.alias("name"), seq.alias("seq"), "path")
        out = rows if out is None else out.unionByName(rows)
    return out


def reference(spark: SparkSession, *paths: str, seed: str = "ACGT") -> DataFrame:
    """ref_seq of FASTA files: seq_id, file_id, seq_name, seq in bases only; two sequences of one name are an error."""
    from ..operators.reference import checked_names

    rows = fasta(spark, *[probed(spark, p) for p in paths])
    named = numbered(rows, "seq_id")
    return checked_names(named.select("seq_id", "file_id", F.col("name").alias("seq_name"), dna.without_odd_letters(F.col("seq"), seed).alias("seq")))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """read_ord, name, seq, qual of four-line records; blank lines are skipped."""
    lines = numbered(spark.read.text(path).where("trim(value) <> ''"), "n")
    at = lambda k: F.max(F.when(F.col("n") % 4 == k, F.regexp_replace("value", "\r$", "")))
    rows = lines.groupBy(F.floor(F.col("n") / 4).alias("read_ord")).agg(at(0).alias("head"), at(1).alias("seq"), at(2).alias("plus"), at(3).alias("qual"))
    good = F.col("head").startswith("@")
    head = F.when(good, F.col("head")).otherwise(F.raise_error(F.lit("a FASTQ record starts with @")))
    return rows.select("read_ord", dna.clean_name(head).alias("name"), "seq", "qual")


def reads(spark: SparkSession, path: str) -> DataFrame:
    """read_id, read_ord, seq (cleaned), qual ("*" for FASTA) of a file of either kind."""
    if file_type(path) == "fastq":
        rows = fastq(spark, path)
    else:
        rows = numbered(fasta(spark, path), "read_ord").withColumn("qual", F.lit("*"))
    return rows.select(F.col("name").alias("read_id"), "read_ord", dna.cleaned(F.col("seq")).alias("seq"), "qual")


def pairs(spark: SparkSession, first: str, second: str, strict: bool = False) -> DataFrame:
    """pair_id, mate, name, seq, qual of two files in lock-step, as far as the shorter one goes: with a warning, or an error if strict."""
    a, b = reads(spark, first), reads(spark, second)
    n, m = a.count(), b.count()
    if n != m:
        if strict:
            raise ValueError(f"{first} has {n} reads, {second} has {m}")
        logging.getLogger("seqloom").warning("%s has %d reads, %s has %d: the rest of the longer one is left out", first, n, second, m)
    both = a.select("read_ord", F.struct(F.lit(1).alias("mate"), F.col("read_id").alias("name"), "seq", "qual").alias("x")).join(b.select("read_ord", F.struct(F.lit(2).alias("mate"), F.col("read_id").alias("name"), "seq", "qual").alias("y")), "read_ord")
    return both.select(F.col("read_ord").alias("pair_id"), F.explode(F.array("x", "y")).alias("m")).select("pair_id", "m.*")


def scheme_folder(spark: SparkSession, folder: str, k: int) -> dict:
    """name, searches and (where given) static and dynamic partitioning of a folder's scheme for k errors."""
    from ..plans.schemes import parse

    def text(name: str) -> str | None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return spark.read.text(f"{folder}/{name}", wholetext=True).first()[0] if fs.exists(p) else None

    numbers = lambda s: [[float(x) for x in line.split()] for line in s.strip().splitlines()] if s else None
    several, i = [], 1
    while (t := text(f"{k}/scheme{i}.txt")) is not None:
        several.append(parse(t))
        i += 1
    one = text(f"{k}/searches.txt")
    if one is None and not several:
        raise FileNotFoundError(f"{folder}/{k}/searches.txt")
    schemes = ([parse(one)] if one else []) + several
    for s in schemes:
        for x in s:
            if x.problems():
                raise ValueError(f"{x}: {', '.join(x.problems())}")
    return {"name": (text("name.txt") or folder).strip(), "schemes": schemes, "static": numbers(text(f"{k}/static_partitioning.txt")), "dynamic": numbers(text(f"{k}/dynamic_partitioning.txt"))}
