"""The options of an alignment run and the plan that they stand for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dna
from ..operators import dedupe, insert_size, pairing, ranking, search
from ..shared import written
from ..sources import fastx
from . import schemes


@dataclass(frozen=True)
class Options:
    """mode: all hits within max_distance, or the best ones (and x strata more) above min_identity per cent."""

    mode: str = "best"
    metric: str = "edit"
    max_distance: int = 0
    min_identity: int = 95
    strata_after_best: int = 0
    orientation: str = "FR"
    min_insert: int = 0
    max_insert: int = 500
    infer: bool = True
    discordant: bool = False
    max_discordant: int = 10_000
    report_unmapped: bool = True
    xa: bool = False
    cigar: bool = True
    #: where parts are cut; dynamic takes a part's rarest letters where a prepared reference tells them, else its first
    partitioning: str = "dynamic"
    #: a scheme of plans.schemes, or a folder of scheme files; it decides which parts are seeds
    scheme: str = "pigeon"
    #: of a reference that is prepared for this run
    kmer_size: int = 10
    trim: tuple[int, int] | None = None
    reorder: bool = False

    def __post_init__(self) -> None:
        for name, allowed in (("mode", ("all", "best")), ("metric", ("edit", "hamming")), ("orientation", tuple(pairing.ORIENTATIONS)), ("partitioning", ("uniform", "static", "dynamic"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")
        for name, low, high in (("max_distance", 0, dna.MAX_ERRORS), ("min_identity", 50, 100), ("kmer_size", 0, 15)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} lies between {low} and {high}")
        if self.strata_after_best < 0:
            raise ValueError("strata_after_best is not negative")
        if self.min_insert > self.max_insert:
            raise ValueError("min_insert exceeds max_insert")
        if self.trim and not 0 <= self.trim[0] < self.trim[1]:
            raise ValueError("trim is a range start < end")
        if self.xa and not self.cigar:
            raise ValueError("the XA tag needs the CIGAR strings")


def seeding(spark: SparkSession, o: Options) -> search.Seeding:
    """What scheme and partitioning ask for. A folder's schemes are checked; k that a scheme doesn't have is cut by the pigeonhole."""
    chosen, fractions = {}, {}
    for k in range(1, dna.MAX_ERRORS + 1):
        if o.scheme in schemes.GENERATORS:
            chosen[k] = schemes.GENERATORS[o.scheme](k)
            continue
        try:
            found = fastx.scheme_folder(spark, o.scheme, k)
        except FileNotFoundError:
            continue
        chosen[k] = found["schemes"][0]
        if not schemes.is_lossless(chosen[k], k):
            raise ValueError(f"{o.scheme}: the scheme for {k} errors misses some of their distributions")
        if o.partitioning == "static" and found["static"]:
            fractions[k] = found["static"][0]
    if not chosen:
        raise ValueError(f"{o.scheme} is neither a known scheme nor a folder of scheme files")
    return search.Seeding(chosen, fractions, o.partitioning == "dynamic")


def _prepared(reads: DataFrame, o: Options) -> DataFrame:
    seq = dna.cleaned(F.col("seq"))
    return reads.withColumn("seq", dna.trimmed(seq, *o.trim) if o.trim else seq)


def hits(reads: DataFrame, ref, o: Options, per_strand: bool | None = None) -> DataFrame:
    """ref: a table of sequences or a prepared reference. All hits of reads (read_id, seq) within their limit of errors, both strands, without redundant ones."""
    reads = _prepared(reads, o).select("read_id", "seq")
    limit = F.lit(o.max_distance) if o.mode == "all" else dna.max_errors(F.length("seq"), o.min_identity)
    queries = search.both_strands(reads.withColumn("k", limit))
    how = seeding(reads.sparkSession, o)
    if o.mode == "all" and o.max_distance == 0:
        found = search.exact(queries.drop("k"), ref, how).withColumn("max_distance", F.lit(0))
        return found if o.cigar else found.withColumn("cigar", F.lit("*"))
    k = F.col("k")
    if o.metric == "hamming":
        found = search.hamming(queries, ref, k, how)
    else:
        found = search.edit(queries, ref, k, how)
    found = found.join(reads.select("read_id", limit.alias("max_distance")), "read_id")
    by_strand = o.mode == "best" if per_strand is None else per_strand
    found = dedupe.unique(found, by_strand)
    if o.metric == "edit" and o.mode == "all":
        found = dedupe.non_redundant(found.withColumn("k", F.col("max_distance")), o.max_distance, by_strand).drop("k")
    elif o.metric == "edit" and per_strand is None:
        # strata first: hits beyond them fold nothing, and exact hits are all reported
        last = F.least(F.min("distance").over(W.partitionBy("read_id")) + o.strata_after_best, F.col("max_distance"))
        found = found.withColumn("k", last).where(F.col("distance") <= F.col("k"))
        found = dedupe.non_redundant(found, None, by_strand).drop("k")
    elif o.metric == "edit":  # mates: which stratum counts is known only of pairs
        found = dedupe.non_redundant(found, None, by_strand)
    if not o.cigar:
        found = found.withColumn("cigar", F.lit("*"))
    return found


def single_end(reads: DataFrame, ref, o: Options) -> DataFrame:
    """Reported hits with best, n_best, rank, is_primary, mapq and flag."""
    found = hits(reads, ref, o)
    found = ranking.strata(found, o.strata_after_best) if o.mode == "best" else found
    return ranking.ranked(found).drop("max_distance")


def paired_end(pairs: DataFrame, ref, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs found, all hits of the mates, and the library's parameters. pairs: pair_id, mate, seq."""
    reads = pairs.withColumn("read_id", F.concat_ws("/", F.col("pair_id").cast("string"), F.col("mate").cast("string")))
    found = hits(reads, ref, o, per_strand=True)
    # alignments are read by the inference and by each kind of pair: they are made once
    found = written(found.join(reads.select("read_id", "pair_id", "mate"), "read_id").drop("read_id", "max_distance"))
    if o.infer:
        with_file = found.join(ref.select("seq_id", "file_id"), "seq_id") if "file_id" in ref.columns else found
        library = insert_size.inferred(insert_size.first_pairs(insert_size.unambiguous(with_file)))
        p = library.first()
        orientation, least, most = p.orientation, p.min_insert, p.max_insert
    else:
        spark = pairs.sparkSession
        library = spark.createDataFrame([(o.orientation, o.min_insert, o.max_insert)], "orientation string, min_insert int, max_insert int")
        orientation, least, most = o.orientation, o.min_insert, o.max_insert
    out = pairing.concordant(found, orientation, least, most)
    if o.discordant:
        out = out.unionByName(pairing.discordant(found, out, o.max_discordant))
    if o.mode == "best":
        out = pairing.best_pairs(out, o.strata_after_best).drop("best")
    return pairing.ranked_pairs(out), found, library
