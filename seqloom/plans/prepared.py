"""A prepared reference: sequences, window tiles, k-mers and their frequencies, written once and opened by path.

The k-mer table is bucketed by k-mer (two bits a base), so that joins with many reads shuffle the reads alone; joins with few reads
broadcast them. Tables are Parquet below one path; a table of one row holds what a reader must know.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import packed, reference

VERSION = 1
#: Letters a bucket of the k-mer table holds, about.
BUCKET = 8_000_000


@dataclass(frozen=True)
class Prepared:
    """An opened reference; it stands wherever a table of sequences is asked for."""

    sequences: DataFrame  # seq_id, file_id, seq_name, seq
    names: DataFrame  # seq_id, file_id, seq_name, len
    windows: DataFrame  # seq_id, tile, begin, text
    kmers: DataFrame  # code, seq_id, pos
    frequencies: DataFrame  # kmer, n
    k: int
    pad: int

    @property
    def sparkSession(self) -> SparkSession:  # noqa: N802 -- as of a DataFrame
        return self.sequences.sparkSession

    @property
    def columns(self) -> list[str]:
        return self.sequences.columns

    def select(self, *cols) -> DataFrame:
        return self.sequences.select(*cols)


def build(ref: DataFrame, path: str, k: int = 10, pad: int = 512) -> Prepared:
    """Write the tables of a reference (seq_id, file_id, seq_name, seq) and open them. pad: letters around window tiles."""
    spark, path = ref.sparkSession, path.rstrip("/")
    if not 1 <= k <= 15:
        raise ValueError("k-mers have 1 to 15 letters")
    if "file_id" not in ref.columns:
        ref = ref.withColumn("file_id", F.lit(0))
    ref.select(F.col("seq_id").cast("bigint").alias("seq_id"), "file_id", "seq_name", "seq").write.option("compression", "zstd").parquet(f"{path}/sequences")
    ref = spark.read.parquet(f"{path}/sequences")
    ref.select("seq_id", "file_id", "seq_name", F.length("seq").cast("bigint").alias("len")).write.parquet(f"{path}/names")
    letters = spark.read.parquet(f"{path}/names").agg(F.sum("len").alias("n")).first().n or 0
    reference.tiles(reference.dealt(ref), reference.WINDOW_TILE, pad, pad).write.option("compression", "zstd").parquet(f"{path}/windows")
    buckets = max(1, -(-letters // BUCKET))
    name = f"seqloom_{uuid.uuid4().hex}"
    # ordered numbers: differences, packed (Parquet's second version), take half the room
    small = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#seq_id": "false", "path": f"{path}/kmers"}
    packed.by_bucket(ref, k, buckets).write.bucketBy(buckets, "code").sortBy("code").options(**small).saveAsTable(name)
    counts = spark.table(name).groupBy("code").agg(F.count("*").alias("n"))
    counts.select(dna.unpacked(F.col("code"), k).alias("kmer"), "n").write.parquet(f"{path}/frequencies")
    spark.sql(f"DROP TABLE {name}")  # of the catalogue only: the files are at a path of their own
    spark.createDataFrame([(VERSION, k, pad, buckets)], "version int, k int, pad int, buckets int").coalesce(1).write.parquet(f"{path}/about")
    return open_(spark, path)


def open_(spark: SparkSession, path: str) -> Prepared:
    """The reference that build() wrote at path."""
    path = path.rstrip("/")
    about = spark.read.parquet(f"{path}/about").first()
    if about.version != VERSION:
        raise ValueError(f"{path} was written by another version ({about.version}; this is {VERSION})")
    name = f"seqloom_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (code BIGINT, seq_id BIGINT, pos INT) USING parquet CLUSTERED BY (code) SORTED BY (code) INTO {about.buckets} BUCKETS LOCATION '{path}/kmers'")
    table = lambda part: spark.read.parquet(f"{path}/{part}")
    return Prepared(table("sequences"), table("names"), table("windows"), spark.table(name), table("frequencies"), about.k, about.pad)
