"""Alignment of a stream of reads against a fixed reference, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.aligner import Options, single_end


def align_stream(reads: DataFrame, ref: DataFrame, options: Options, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Hits of each batch, appended to out as Parquet. A read's hits depend on it alone, so no state is kept.

    Batches are written to folders of their own number: one that is run again overwrites its own.
    """

    def batch(rows: DataFrame, number: int) -> None:
        single_end(rows, ref, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
