"""Similarity joins of reads with the reference: an equi-join on seeds, then verification of the candidates.

The reference's k-mers stream through the join; the reads' seeds are the small side, and Spark broadcasts them
only if their size allows. Windows are verified against tiles of the reference, so that no row ever holds
more of a sequence than a tile and its neighbourhood. k-mers and tiles that no read asks for mostly end in the task
that makes them: masks of a fixed size tell them. Where reads ask for nearly all, there is none and all go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..shared import written
from ..ship import ship
from . import kernels
from .mask import mask
from .partition import LONGEST, seeds
from .reference import WINDOW_TILE, is_prepared, kmers, windows

#: Candidates of one read whose begins lie in one block are verified together.
BLOCK = 64


def both_strands(reads: DataFrame) -> DataFrame:
    """read_id, strand, seq (and k, if there): the read and its reverse complement."""
    rest = [c for c in reads.columns if c not in ("strand", "seq")]
    of = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("seq")), F.struct(F.lit("-").alias("strand"), dna.reverse_complement(F.col("seq")).alias("seq"))))
    return reads.select(*rest, of.alias("s")).select(*rest, "s.*")


class Seeding:
    """How reads are cut into seeds: a scheme (its searches for each k), where parts begin, and whether the rarest letters of a part are taken, which needs the frequencies of a prepared reference."""

    def __init__(self, schemes: dict[int, list] | None = None, fractions: dict[int, list[float]] | None = None, rarest: bool = False):
        self.schemes, self.fractions, self.rarest = schemes, fractions, rarest

    def seeds(self, queries: DataFrame, ref) -> DataFrame:
        known = is_prepared(ref)
        frequencies = ref.frequencies if known and self.rarest else None
        return seeds(queries, F.col("k"), ref.k if known else LONGEST, self.schemes, self.fractions, frequencies, ref.k if known else 0)


def _extent(queries: DataFrame, found: DataFrame) -> tuple[list[int], int, int]:
    """Seed lengths in use (few), length of the longest read, most errors; one job each for reads and seeds."""
    r = queries.agg(F.max(F.length("seq")).alias("m"), F.max("k").alias("k")).first()
    return sorted(x.q for x in found.select("q").distinct().collect()) or [1], r.m or 0, r.k or 0


def _seeds(queries: DataFrame, ref, how: Seeding) -> tuple[DataFrame, DataFrame]:
    """Queries and their seeds (read_id, strand, q, code, offset), from tables of their own: Spark knows their sizes."""
    queries = written(queries)
    found = how.seeds(queries, ref)
    return queries, written(found.withColumn("code", F.when(F.col("q") > 0, dna.packed(F.col("kmer"))).otherwise(0)).drop("kmer"))


def candidates(found: DataFrame, ref, sizes: list[int]) -> DataFrame:
    """read_id, strand, seq_id, diag: where a read may begin (0-based), from each of its seeds."""
    if is_prepared(ref) and sizes == [ref.k]:  # by the k-mer alone: the buckets of a prepared reference are made by it
        met = kmers(ref, *sizes).drop("q").join(found.drop("q"), "code")
    else:
        met = kmers(ref, *sizes, among=mask(found, F.col("code"))).join(found, ["q", "code"])
    return met.select("read_id", "strand", "seq_id", (F.col("pos") - F.col("offset")).alias("diag")).distinct()


def _windows(found: DataFrame, queries: DataFrame, ref, margin: int, longest: int) -> DataFrame:
    """found (read_id, strand, seq_id, low, high: first and last begin) with the read, its k and the text around (and where that begins).

    Candidates are written first: only tiles that some of them lies in are cut. A begin lies before its seed, so
    it never lies beyond its sequence.
    """
    at = written(found.withColumn("tile", F.floor(F.greatest("low", F.lit(0)) / WINDOW_TILE).cast("int")))
    pieces = windows(ref, margin + longest + BLOCK, at).withColumnRenamed("begin", "text_begin")
    # no more of the text goes on than the longest read needs
    begin = F.greatest(F.col("low") - margin, F.lit(0), F.col("text_begin"))
    text = F.substr("text", F.col("begin") - F.col("text_begin") + 1, F.greatest(F.col("high") + (longest + margin) - F.col("begin"), F.lit(0)))
    near = at.join(pieces, ["seq_id", "tile"]).withColumn("begin", begin).withColumn("text", text)
    return near.drop("text_begin", "tile").withColumnRenamed("begin", "text_begin").join(queries, ["read_id", "strand"])


def hamming(queries: DataFrame, ref, k, how: Seeding = Seeding()) -> DataFrame:  # noqa: B008 -- never changed
    """All hits within k mismatches: read_id, strand, seq_id, begin, end, distance, cigar. queries: read_id, strand, seq."""
    ship(queries.sparkSession)
    queries = queries.withColumn("k", F.lit(k) if isinstance(k, int) else k)
    queries, some = _seeds(queries, ref, how)
    sizes, longest, _ = _extent(queries, some)
    found = candidates(some, ref, sizes).select("read_id", "strand", "seq_id", F.col("diag").alias("low"), F.col("diag").alias("high")).where("low >= 0")
    full = _windows(found, queries, ref, 1, longest).select("read_id", "strand", "seq_id", "low", "k", "seq", F.substr("text", F.col("low") - F.col("text_begin") + 1, F.length("seq")).alias("text"))
    full = full.where("length(text) = length(seq)")

    def run(batches):
        for b in batches:
            reads, texts = b.column("seq").to_pylist(), b.column("text").to_pylist()
            by: dict[int, list[int]] = {}
            for i, r in enumerate(reads):
                by.setdefault(len(r), []).append(i)
            d = np.zeros(len(reads), np.int32)
            for rows in by.values():
                d[rows] = kernels.mismatches(np.stack([kernels.codes(reads[i]) for i in rows]), np.stack([kernels.codes(texts[i]) for i in rows]))
            ok = pa.array(d <= b.column("k").to_numpy())
            n = pa.array([len(r) for r in reads], pa.int32())
            out = pa.RecordBatch.from_arrays([b.column("read_id"), b.column("strand"), b.column("seq_id"), b.column("low"), n, pa.array(d)], names=["read_id", "strand", "seq_id", "begin", "n", "distance"])
            yield out.filter(ok)

    kind = dict(queries.dtypes)["read_id"]
    hits = full.mapInArrow(run, f"read_id {kind}, strand string, seq_id bigint, begin int, n int, distance int")
    return hits.select("read_id", "strand", "seq_id", "begin", (F.col("begin") + F.col("n")).alias("end"), "distance", F.concat(F.col("n").cast("string"), F.lit("M")).alias("cigar"))


def edit(queries: DataFrame, ref, k, how: Seeding = Seeding()) -> DataFrame:  # noqa: B008
    """All cluster centres within k edits: read_id, strand, seq_id, begin, end, distance, cigar; not yet without redundancy."""
    ship(queries.sparkSession)
    queries = queries.withColumn("k", F.lit(k) if isinstance(k, int) else k)
    queries, some = _seeds(queries, ref, how)
    sizes, longest, most = _extent(queries, some)
    margin = 3 * most + 2
    by = candidates(some, ref, sizes).withColumn("block", F.floor(F.col("diag") / BLOCK)).groupBy("read_id", "strand", "seq_id", "block")
    found = by.agg(F.min("diag").alias("low"), F.max("diag").alias("high")).drop("block")
    full = _windows(found, queries, ref, margin, longest)
    start = F.greatest(F.col("low") - 3 * F.col("k") - 2, F.lit(0), F.col("text_begin"))
    stop = F.col("high") + F.length("seq") + 3 * F.col("k") + 2
    full = full.select("read_id", "strand", "seq_id", "low", "high", "k", "seq", start.alias("start"), F.substr("text", start - F.col("text_begin") + 1, F.greatest(stop - start, F.lit(0))).alias("text"))

    def run(batches):
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in b.schema.names}
            rows = []
            for i, found in enumerate(kernels.align(c["seq"], c["text"], c["k"])):
                s, k = c["start"][i], c["k"][i]
                for begin, end, d, cigar in found:
                    if end > begin and c["low"][i] - k <= s + begin <= c["high"][i] + k:
                        rows.append((c["read_id"][i], c["strand"][i], c["seq_id"][i], s + begin, s + end, d, cigar))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (b.schema.field("read_id").type, pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["read_id", "strand", "seq_id", "begin", "end", "distance", "cigar"])

    kind = dict(queries.dtypes)["read_id"]
    return full.mapInArrow(run, f"read_id {kind}, strand string, seq_id bigint, begin int, end int, distance int, cigar string").distinct()


def exact(queries: DataFrame, ref, how: Seeding = Seeding()) -> DataFrame:  # noqa: B008
    """All occurrences: an equi-join on the first letters and a comparison, without Python."""
    queries = queries.withColumn("k", F.lit(0))
    queries, some = _seeds(queries, ref, how)
    sizes, longest, _ = _extent(queries, some)
    found = candidates(some, ref, sizes).select("read_id", "strand", "seq_id", F.col("diag").alias("low"), F.col("diag").alias("high"))
    full = _windows(found, queries, ref, 1, longest)
    n = F.length("seq")
    same = full.where((F.substr("text", F.col("low") - F.col("text_begin") + 1, n) == F.col("seq")) & ~F.col("seq").contains("N"))
    return same.select("read_id", "strand", "seq_id", F.col("low").alias("begin"), (F.col("low") + n).alias("end"), F.lit(0).alias("distance"), F.concat(n.cast("string"), F.lit("M")).alias("cigar"))
