"""Removal of redundant hits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..ship import ship


def unique(hits: DataFrame, by_strand: bool) -> DataFrame:
    """One hit for each place and distance; where strands share a bag, the forward one."""
    keys = ["read_id", "seq_id", "begin", "end", "distance", *(["strand"] if by_strand else [])]
    order = W.partitionBy(*keys).orderBy("strand", "cigar")
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def non_redundant(hits: DataFrame, k: int | None, by_strand: bool) -> DataFrame:
    """Of overlapping edit-distance hits (begins at most 2k apart) the best survives.

    A fold over the hits of a sequence in the order of begin, distance, width: a hit near the last survivor
    replaces it if it is strictly better in distance, or in width at equal distance, and goes otherwise; only the
    last survivor counts. hits may have a column k of their own; with k = None the larger distance of the two hits
    is the radius, so that exact hits never fold one another. The fold streams through sorted partitions: a batch
    is decided on its numbers alone, and only survivors are carried on.
    """
    ship(hits.sparkSession)
    group = ["read_id", "seq_id", *(["strand"] if by_strand else [])]
    names = hits.columns
    if "k" not in names:
        hits = hits.withColumn("k", F.lit(-1 if k is None else k))
    full = hits.repartition(*group).sortWithinPartitions(*group, "begin", "distance", F.col("end") - F.col("begin"), "strand", "cigar")

    def run(batches):
        last = None
        for b in batches:
            if last is not None:
                b = pa.concat_batches([last, b])
            begin, end, distance, radius = (b.column(c).to_pylist() for c in ("begin", "end", "distance", "k"))
            keys, out, kept = list(zip(*(b.column(g).to_pylist() for g in group), strict=True)), [], 0
            for i in range(1, b.num_rows):
                if keys[i] == keys[kept]:
                    gap, most = begin[i] - begin[kept], radius[i] if radius[i] >= 0 else max(distance[i], distance[kept])
                    if gap == 0:
                        continue
                    if gap <= 2 * most:
                        if (distance[i], end[i] - begin[i]) < (distance[kept], end[kept] - begin[kept]):
                            kept = i
                        continue
                out.append(kept)
                kept = i
            last = b.slice(kept, 1) if b.num_rows else last
            if out:
                yield b.take(pa.array(out))
        if last is not None:
            yield last

    return full.mapInArrow(run, full.schema).select(*names)
