"""Statistics of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def single_end(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: reads, mapped_reads, mapped_pct, hits, unique_best, avg_hits, avg_distance."""
    hits = hits.select("read_id", "distance")
    per = hits.groupBy("read_id").agg(F.count("*").alias("h"), F.sum("distance").alias("d"), F.min("distance").alias("best"))
    best = hits.join(per.select("read_id", "best"), "read_id").where("distance = best").groupBy("read_id").agg(F.count("*").alias("b"))
    all_ = reads.select("read_id").join(per, "read_id", "left").join(best, "read_id", "left")
    n = F.count("*")
    mapped = F.count_if(F.col("h") > 0)
    return all_.agg(
        n.alias("reads"),
        mapped.alias("mapped_reads"),
        F.round(100.0 * mapped / n, 6).alias("mapped_pct"),
        F.coalesce(F.sum("h"), F.lit(0)).alias("hits"),
        F.count_if(F.col("b") == 1).alias("unique_best"),
        F.round(F.coalesce(F.sum("h"), F.lit(0)) / n, 6).alias("avg_hits"),
        F.round(F.sum("d") / F.sum("h"), 6).alias("avg_distance"),
    )


def paired_end(status: DataFrame) -> DataFrame:
    """status, pairs, pct of all pairs."""
    by = status.groupBy("status").agg(F.count("*").alias("pairs"))
    total = status.agg(F.count("*").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("status", "pairs", F.round(100.0 * F.col("pairs") / F.col("total"), 6).alias("pct"))  # one row
