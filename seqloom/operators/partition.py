"""How a read is cut into parts, and the seeds that a lossless search needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No seed is longer; no read has more errors.
LONGEST, MOST_ERRORS = 16, 13


def uniform(length: Column, parts: int) -> Column:
    """array<struct<part, begin, end>> of parts of equal length; a read no longer than the number of parts stays whole."""
    cut = lambda i: F.floor(i * length / F.lit(parts)).cast("int")
    even = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(i.alias("part"), cut(i).alias("begin"), cut(i + 1).alias("end")))
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("begin"), length.cast("int").alias("end")))
    return F.when(length > parts, even).otherwise(whole) if parts > 1 else whole


def static(length: Column, fractions: list[float]) -> Column:
    """Parts that begin at the given fractions of the read (the first begins at 0)."""
    edges = [F.lit(0), *[F.floor(length * f).cast("int") for f in fractions], length.cast("int")]
    return F.array(*[F.struct(F.lit(i).alias("part"), edges[i].alias("begin"), edges[i + 1].alias("end")) for i in range(len(edges) - 1)])


def rarest(reads: DataFrame, frequencies: DataFrame, parts: int, k: int) -> DataFrame:
    """read_id, part, begin, end, offset, kmer, n: the rarest k-mer of each part of a read, the first among equals.

    It is the part's seed: of all places in a part that is free of errors any may be looked up, and the rarest gives
    the fewest candidates. Part borders stay even, so nothing is looked up letter by letter.
    """
    even = reads.select("read_id", "seq", F.inline(uniform(F.length("seq"), parts)))
    at = even.select("read_id", "part", "begin", "end", "seq", F.explode(F.sequence("begin", F.greatest(F.col("end") - k, F.col("begin")))).alias("offset"))
    at = at.select("read_id", "part", "begin", "end", "offset", F.substr("seq", F.col("offset") + 1, F.lit(k)).alias("kmer"))
    seen = at.join(frequencies, "kmer", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = F.min_by(F.struct("offset", "kmer", "n"), F.struct("n", "offset"))
    return seen.groupBy("read_id", "part", "begin", "end").agg(best.alias("b")).select("read_id", "part", "begin", "end", "b.*")


def starts(scheme: list | None, k: int) -> tuple[int, list[int]]:
    """Parts, and those with which the searches of a scheme begin, if none of them may have an error there; else (and without a scheme) those of the pigeonhole."""
    if scheme and all(s.u[0] == 0 for s in scheme):
        return len(scheme[0].pi), sorted({s.pi[0] for s in scheme})
    return k + 1, list(range(k + 1))


def seeds(queries: DataFrame, k: Column | int, longest: int = LONGEST, schemes: dict[int, list] | None = None, fractions: dict[int, list[float]] | None = None, frequencies: DataFrame | None = None, width: int = 0) -> DataFrame:
    """read_id, strand, q, kmer, offset: letters of a read of which some must match exactly within k errors.

    Each error distribution leaves some search of the scheme (by default: of the pigeonhole, k + 1 parts) a first
    part without errors, so q letters of each such part are enough. They are the first ones of the part, or, with
    frequencies of k-mers of the given width, the rarest of the part's. fractions: where parts begin, for each k;
    else they are equal. A read of at most k letters may match without a single letter in common: its one seed is
    empty and meets every position.
    """
    k = F.lit(k) if isinstance(k, int) else k
    rows = queries.where(F.length("seq") > 0).select("read_id", "strand", "seq", k.alias("k"))
    # of each k: how many parts, which of them are seeds, and where they begin
    parts, firsts = zip(*(starts((schemes or {}).get(e), e) for e in range(MOST_ERRORS + 1)), strict=True)
    of_k = lambda xs: F.get(F.array(*xs), F.col("k"))
    rows = rows.withColumn("p", of_k([F.lit(p) for p in parts])).withColumn("m", F.length("seq"))
    rows = rows.withColumn("whole", F.col("m") < F.col("p"))
    rows = rows.withColumn("i", F.explode(F.when(F.col("whole"), F.array(F.lit(0))).otherwise(of_k([F.array(*map(F.lit, x)) for x in firsts]))))
    edge = lambda i: F.floor(i * F.col("m") / F.col("p")).cast("int")
    if fractions:
        even = lambda p: [j / p for j in range(1, p)]
        inner = [fractions[e] if e in fractions and len(fractions[e]) == p - 1 else even(p) for e, p in enumerate(parts)]
        given = of_k([F.array(*[F.lit(float(x)) for x in (0, *x, 1)]) for x in inner])
        edge = lambda i: F.floor(F.get(given, i) * F.col("m")).cast("int")
    rows = rows.withColumn("begin", F.when(F.col("whole"), 0).otherwise(edge(F.col("i")))).withColumn("end", F.when(F.col("whole"), 0).otherwise(edge(F.col("i") + 1)))
    rows = rows.withColumn("q", F.least(F.lit(longest), F.col("end") - F.col("begin")))
    out = rows.select("read_id", "strand", "i", "q", "seq", F.col("begin").alias("offset"), "end")
    if frequencies is not None:
        # of all places in the part the one whose letters are rarest
        most = F.when(F.col("q") == width, F.col("end") - width).otherwise(F.col("offset"))
        every = out.select("read_id", "strand", "i", "q", "seq", F.explode(F.sequence("offset", most)).alias("offset"))
        every = every.select("read_id", "strand", "i", "q", "offset", F.substr("seq", F.col("offset") + 1, F.col("q")).alias("kmer"))
        seen = every.join(frequencies.select("kmer", "n"), "kmer", "left")
        rare = F.min_by(F.struct("kmer", "offset"), F.struct(F.coalesce("n", F.lit(0)), "offset"))
        out = seen.where(~F.col("kmer").contains("N")).groupBy("read_id", "strand", "i", "q").agg(rare.alias("s")).select("read_id", "strand", "q", "s.kmer", "s.offset")
        return out
    out = out.select("read_id", "strand", "q", F.substr("seq", F.col("offset") + 1, F.col("q")).alias("kmer"), "offset")
    return out.where(~F.col("kmer").contains("N"))
