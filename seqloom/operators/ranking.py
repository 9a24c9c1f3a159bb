"""Best strata, mapping quality and primary hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dna


def strata(hits: DataFrame, x: int) -> DataFrame:
    """Hits at most x worse than the best of their read, with best and n_best (hits as good as the best).

    hits may carry max_distance; n_best counts hits before equal places are made one.
    """
    by = W.partitionBy("read_id")
    out = hits.withColumn("best", F.min("distance").over(by))
    out = out.withColumn("n_best", F.sum(F.when(F.col("distance") == F.col("best"), 1).otherwise(0)).over(by).cast("int"))
    limit = F.least(F.col("best") + x, F.col("max_distance")) if "max_distance" in hits.columns else F.col("best") + x
    out = out.where(F.col("distance") <= limit)
    return out.dropDuplicates(["read_id", "strand", "distance", "seq_id", "begin"])


def ranked(hits: DataFrame) -> DataFrame:
    """rank (1 is the primary hit), is_primary, mapq and flag of hits with best and n_best."""
    if "best" not in hits.columns:
        hits = counted(hits)
    order = W.partitionBy("read_id").orderBy("distance", "strand", "seq_id", "begin", "end")
    out = hits.withColumn("rank", F.row_number().over(order)).withColumn("is_primary", F.col("rank") == 1)
    out = out.withColumn("mapq", dna.mapq(F.col("distance") == F.col("best"), F.col("n_best")))
    return out.withColumn("flag", dna.flags_single(F.col("strand"), F.col("is_primary")))


def counted(hits: DataFrame) -> DataFrame:
    """best and n_best of each read, kept with all its hits."""
    by = W.partitionBy("read_id")
    out = hits.withColumn("best", F.min("distance").over(by))
    return out.withColumn("n_best", F.sum(F.when(F.col("distance") == F.col("best"), 1).otherwise(0)).over(by).cast("int"))
