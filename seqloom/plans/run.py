"""One call from files and options to the files of a run."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counters, pairing
from ..shared import written
from ..sources import fastx, sinks
from . import prepared
from .aligner import Options, paired_end, single_end

log = logging.getLogger("seqloom")


def reference_of(spark: SparkSession, ref, o: Options):
    """A prepared reference: opened from its path, or prepared in the shared folder from FASTA files (a path, several, or a list file ending in .txt)."""
    from ..shared import folder

    if isinstance(ref, prepared.Prepared):
        return ref
    paths = [ref] if isinstance(ref, str) else list(ref)
    if len(paths) == 1 and paths[0].endswith(".txt"):
        paths = fastx.listed(spark, paths[0])
    if len(paths) == 1 and fastx.exists(spark, f"{paths[0].rstrip('/')}/about"):
        return prepared.open_(spark, paths[0])
    return prepared.build(fastx.reference(spark, *paths), folder(spark), max(1, o.kmer_size))


def run(spark: SparkSession, ref, reads: str, out: str, options: Options | None = None, mates: str | None = None) -> DataFrame:
    """Align the reads of a file (and its mates) and write out: SAM or a read-hit summary, by its extension. Returns the counters.

    ref: a prepared reference, its path, or FASTA files. The lines are files in the folder out, in the order of the
    reads if options say so (reorder).
    """
    o, began = options or Options(), time.time()
    kind, zipped = sinks.output_type(out)
    if kind == "rhs" and mates:
        raise ValueError("a read-hit summary is of single reads")
    opened = reference_of(spark, ref, o)
    names = opened.names.withColumnRenamed("len", "length")
    log.info("reference of %d-mers opened after %.1f s", opened.k, time.time() - began)
    if mates:
        rows = fastx.pairs(spark, reads, mates, strict=False)
        pairs, found, library = paired_end(rows.select("pair_id", "mate", "seq"), opened, o)
        pairs = written(pairs)
        named = rows.select("pair_id", "mate", "name", "seq", "qual")
        lines = sinks.sam_pairs(pairs, named, names).unionByName(sinks.sam_without_pair(found, pairs, named, names, o.report_unmapped))
        lines = lines.select(F.col("pair_id").alias("read_ord"), (F.col("rank") * 4 + F.col("mate")).cast("bigint").alias("rank"), "line")
        status = written(pairing.status(pairs, found, rows.select("pair_id").distinct()))
        counted = counters.paired_end(status)
        log.info("library: %s", library.first())
    else:
        rows = written(fastx.reads(spark, reads))
        # reads may share a name: they are told apart by their place in the file
        hits = written(single_end(rows.select(F.col("read_ord").alias("read_id"), "seq"), opened, o))
        own = rows.select(F.col("read_ord").alias("read_id"), F.col("read_id").alias("name"), "seq", "qual")
        if kind == "rhs":
            lines = sinks.summary(hits, own, o.report_unmapped).join(own.select("read_id", "name"), "read_id")
            lines = lines.select(F.col("read_id").alias("read_ord"), F.lit(1).cast("bigint").alias("rank"), F.concat_ws("\t", "name", "hits").alias("line"))
        else:
            lines = sinks.sam_single(hits, own, names, o.report_unmapped, o.xa)
            lines = lines.select(F.col("read_id").alias("read_ord"), F.col("rank").cast("bigint").alias("rank"), "line")
        counted = counters.single_end(own, hits)
    head = sinks.sam_header(names, f"{out} {o}") if kind == "sam" else sinks.summary_header(spark)
    lines = head.select("read_ord", F.col("rank").cast("bigint").alias("rank"), "line").unionByName(lines.select(F.col("read_ord").cast("bigint").alias("read_ord"), "rank", "line"))
    sinks.write(lines, out, zipped, ["read_ord", "rank"] if o.reorder else None, first=F.col("read_ord") < 0)
    log.info("%s written after %.1f s", out, time.time() - began)
    return counted
