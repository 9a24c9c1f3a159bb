"""Library parameters inferred from unambiguous pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Deviations that count as usual.
DEVIATIONS = 6
#: Unambiguous pairs that the inference takes, of so many first reads.
PAIRS, READS = 750, 10_000
DEFAULT = {"mean": 0.0, "stddev": 0.0, "min_insert": 0, "max_insert": 500, "orientation": "FR"}


def unambiguous(hits: DataFrame) -> DataFrame:
    """pair_id, orientation, frag_size of pairs whose mates have one hit each, in the first file and on one sequence."""
    if "file_id" in hits.columns:
        hits = hits.where("file_id = 0")
    one = hits.groupBy("pair_id", "mate").agg(F.count("*").alias("n"), F.first(F.struct("strand", "seq_id", "begin", "end")).alias("h")).where("n = 1")
    a, b = (one.where(f"mate = {m}").select("pair_id", F.col("h").alias(n)) for m, n in ((1, "a"), (2, "b")))
    both = a.join(b, "pair_id").where("a.seq_id = b.seq_id")
    same = F.col("a.strand") == F.col("b.strand")
    forward_first = F.when(F.col("a.strand") == "+", F.col("a.begin") <= F.col("b.begin")).otherwise(F.col("b.begin") <= F.col("a.begin"))
    kind = F.when(same, "FF").when(forward_first, "FR").otherwise("RF")
    size = F.greatest("a.end", "b.end") - F.least("a.begin", "b.begin")
    return both.select("pair_id", kind.alias("orientation"), size.alias("frag_size"))


def first_pairs(pairs: DataFrame, most: int = PAIRS, reads: int = READS) -> DataFrame:
    """Those of the first reads (by pair_id) and, of them, the first pairs: enough to tell the library."""
    return pairs.where(F.col("pair_id") < reads).orderBy("pair_id").limit(most) if dict(pairs.dtypes)["pair_id"] in ("bigint", "int") else pairs


def inferred(pairs: DataFrame) -> DataFrame:
    """One row: n, median, mad, mean, stddev, min_insert, max_insert, orientation.

    Sizes beyond DEVIATIONS median absolute deviations don't count; if that leaves no mean or no spread, all do.
    """
    size = F.col("frag_size")
    middle = pairs.agg(F.floor(F.median(size)).cast("int").alias("median"))
    spread = pairs.crossJoin(F.broadcast(middle)).withColumn("off", F.abs(size - F.col("median")))  # one row
    mad = spread.agg(F.floor(F.median("off")).cast("int").alias("mad"))
    near = spread.crossJoin(F.broadcast(mad)).withColumn("usual", F.col("off") < DEVIATIONS * F.col("mad"))
    count = lambda o: F.count_if(F.col("orientation") == o)
    usual = F.when(F.col("usual"), size)
    s = near.agg(F.count("*").alias("n"), F.first("median").alias("median"), F.first("mad").alias("mad"), F.avg(usual).alias("m1"), F.stddev_samp(usual).alias("s1"), F.avg(size).alias("m2"), F.stddev_samp(size).alias("s2"), count("FR").alias("fr"), count("RF").alias("rf"), count("FF").alias("ff"))
    odd = F.coalesce(F.col("m1"), F.lit(0)) * F.coalesce(F.col("s1"), F.lit(0)) == 0
    mean, sd = F.when(odd, F.col("m2")).otherwise(F.col("m1")), F.coalesce(F.when(odd, F.col("s2")).otherwise(F.col("s1")), F.lit(0.0))
    dev = F.floor(DEVIATIONS * F.col("stddev"))
    few = F.col("n") < 2
    s = s.withColumn("mean", mean).withColumn("stddev", sd)
    kind = F.when((F.col("fr") >= F.col("rf")) & (F.col("fr") >= F.col("ff")), "FR").when(F.col("rf") >= F.col("ff"), "RF").otherwise("FF")
    pick = lambda c, name: F.when(few, F.lit(DEFAULT[name])).otherwise(c).alias(name)
    return s.select(
        "n",
        "median",
        "mad",
        pick(F.round("mean", 6), "mean"),
        pick(F.round("stddev", 6), "stddev"),
        pick(F.greatest(F.floor(F.col("mean") - dev), F.lit(0)).cast("int"), "min_insert"),
        pick(F.floor(F.col("mean") + dev).cast("int"), "max_insert"),
        pick(kind, "orientation"),
    )
