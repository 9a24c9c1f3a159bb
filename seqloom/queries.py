"""Queries over the driver's tables, with the same queries in SQL.

The tables hold no DNA, so it is derived: letters A-Z of a text, the i-th of the alphabet as the (i mod 4)-th
base. References are the whole texts of all documents, reads the whole texts of all benchmark items: as they
are, with planted substitutions, with planted gaps, or cut into two mates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dna
from .operators import counters, dedupe, insert_size, pairing, partition, ranking, reference, search
from .plans import prepared, schemes
from .plans.aligner import Options, hits, single_end
from .shared import folder, written
from .sources import sinks

# --- derived tables


def ref_seq(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.where("doc_id is not null").select(F.col("doc_id").alias("seq_id"), (F.col("doc_id") % 2).cast("int").alias("file_id"), F.concat(F.lit("doc_"), F.col("doc_id")).alias("seq_name"), dna.from_text(F.coalesce("text", F.lit(""))).alias("seq"))


def reads(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    return items.select(F.col("item_id").alias("read_id"), dna.from_text(F.coalesce("text", F.lit(""))).alias("seq"))


def substituted(seq: str, pos: str) -> str:
    """SQL: seq with another base at pos."""
    return f"concat(substr({seq}, 1, {pos} - 1), translate(substr({seq}, {pos}, 1), 'ACGT', 'CGTA'), substr({seq}, {pos} + 1))"


def planted(seq: str, m: str, n: int) -> str:
    for t in range(1, n + 1):
        seq = substituted(seq, f"cast(floor({t} * {m} / {n + 1}.0) as int)")
    return seq


#: Of each read: itself and with one, two and three substitutions, evenly spread.
VARIANTS = " UNION ALL ".join(f"SELECT read_id * 4 + {n} AS read_id, {planted('seq', 'length(seq)', n)} AS seq FROM reads" for n in range(4))
#: Of each read: a base less (even ids) or more (odd ids) in the middle.
GAPPED = "SELECT read_id, CASE WHEN read_id % 2 = 0 THEN concat(substr(seq, 1, cast(floor(length(seq) / 2.0) as int)), substr(seq, cast(floor(length(seq) / 2.0) as int) + 2)) ELSE concat(substr(seq, 1, cast(floor(length(seq) / 2.0) as int)), 'A', substr(seq, cast(floor(length(seq) / 2.0) as int) + 1)) END AS seq FROM reads"


def mates(kind: str = "FR") -> str:
    """SQL: the two halves of each read, turned as the library says; every seventh second mate is its neighbour's, every eleventh unknown."""
    turned = lambda x, back: f"reverse(translate({x}, 'ACGT', 'TGCA'))" if back else x
    one = turned("substr(a.seq, 1, cast(floor(length(a.seq) / 2.0) as int))", kind[0] == "R")
    two = turned("substr(b.seq, cast(floor(length(b.seq) / 2.0) as int) + 1)", kind == "FR")
    return f"""
SELECT a.read_id AS pair_id, 1 AS mate, {one} AS seq FROM reads a
UNION ALL
SELECT a.read_id, 2, CASE WHEN a.read_id % 11 = 0 THEN 'NNNNNNNNNNNNNNNNNNNN' ELSE {two} END
FROM reads a JOIN reads b ON b.read_id = CASE WHEN a.read_id % 7 = 0 THEN a.read_id + 1 ELSE a.read_id END"""


MATES = mates()
#: Hits made of a read's first 60 letters, crowded enough for the fold: one for every letter but the last two.
CROWDED = """
SELECT read_id, '+' AS strand, CAST(read_id % 3 AS BIGINT) AS seq_id, CAST(2 * i + strpos('ACGT', substr(seq, i + 1, 1)) AS INT) AS "begin",
  CAST(2 * i + 40 + strpos('ACGT', substr(seq, i + 3, 1)) AS INT) AS "end", CAST(strpos('ACGT', substr(seq, i + 2, 1)) - 1 AS INT) AS distance, '*' AS cigar
FROM (SELECT read_id, seq, i FROM reads, (SELECT unnest(range(58)) AS i) WHERE length(seq) >= 60)"""


def derived(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM reads", "FROM {reads}").replace("JOIN reads", "JOIN {reads}"), reads=reads(spark, d))


def variants(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, VARIANTS)


# --- queries


def q_dna_functions(spark, d):
    s = F.col("seq")
    return reads(spark, d).select("read_id", F.length(s).alias("len"), dna.complement(s).alias("complement"), dna.reverse_complement(s).alias("rc"), F.reverse(s).alias("reversed"), dna.is_acgt(s).alias("is_acgt"), dna.canonical(s).alias("canonical"), dna.max_errors(F.length(s), 95).alias("max_errors"), dna.cleaned(F.concat(F.lower(s), F.lit("x"))).alias("cleaned"))


def q_letter_counts(spark, d):
    return reference.letter_counts(ref_seq(spark, d))


def q_kmer_frequencies(spark, d):
    return reference.kmer_frequencies(ref_seq(spark, d), 6)


def q_canonical_kmers(spark, d):
    return reference.kmer_frequencies(ref_seq(spark, d), 6).groupBy(dna.canonical(F.col("kmer")).alias("kmer")).agg(F.sum("n").alias("n"))


def q_packed_kmers(spark, d):
    by = reference.kmer_frequencies(ref_seq(spark, d), 5)
    return by.select("kmer", dna.packed(F.col("kmer")).alias("code"), dna.unpacked(dna.packed(F.col("kmer")), 5).alias("unpacked"), "n")


def q_catalogue(spark, d):
    return reference.catalogue(ref_seq(spark, d))


def q_locate(spark, d):
    """Where a stretch of 50 letters around each border of the concatenation lies."""
    c = reference.catalogue(ref_seq(spark, d))
    at = c.where("len > 0").select(F.greatest(F.col("start") + F.col("len") - 30 - F.col("seq_id") % 40, F.lit(0)).alias("pos"), F.lit(50).alias("width"))
    return reference.located(at, c)


def q_exact(spark, d):
    return search.exact(search.both_strands(reads(spark, d)), ref_seq(spark, d))


def q_prepared(spark, d):
    """Exact hits by way of a prepared reference: built, opened by its path, searched."""
    path = folder(spark)
    prepared.build(ref_seq(spark, d), path, k=12)
    return search.exact(search.both_strands(reads(spark, d)), prepared.open_(spark, path), search.Seeding(rarest=True))


def q_hamming(spark, d):
    return search.hamming(search.both_strands(variants(spark, d)), ref_seq(spark, d), 3)


def q_hamming_best(spark, d):
    h = search.hamming(search.both_strands(variants(spark, d)), ref_seq(spark, d), 3)
    return ranking.ranked(ranking.strata(h, 1))


def q_sam(spark, d):
    return sinks.sam_single(written(q_hamming_best(spark, d)), variants(spark, d), ref_seq(spark, d))


def q_sam_xa(spark, d):
    return sinks.sam_single(written(q_hamming_best(spark, d)), variants(spark, d), ref_seq(spark, d), xa=True)


def q_sam_header(spark, d):
    return sinks.sam_header(ref_seq(spark, d), "queries")


def q_rhs(spark, d):
    return sinks.summary(q_hamming(spark, d), variants(spark, d))


def q_counters(spark, d):
    return counters.single_end(variants(spark, d), written(q_hamming(spark, d)))


def q_edit_all(spark, d):
    return hits(derived(spark, d, GAPPED), ref_seq(spark, d), Options(mode="all", metric="edit", max_distance=2)).drop("max_distance")


def q_edit_best(spark, d):
    return single_end(derived(spark, d, GAPPED), ref_seq(spark, d), Options(mode="best", metric="edit", min_identity=98))


def q_edit_distance(spark, d):
    """The best distance of each gapped read: what does not depend on how redundant hits are folded."""
    return search.edit(search.both_strands(derived(spark, d, GAPPED)), ref_seq(spark, d), 1).groupBy("read_id").agg(F.min("distance").alias("best"))


def _mates(spark, d, kind="FR"):
    m = derived(spark, d, mates(kind))
    q = search.both_strands(m.withColumn("read_id", F.col("pair_id") * 2 + F.col("mate")).select("read_id", "seq"))
    h = search.exact(q, ref_seq(spark, d)).withColumn("mate", F.when(F.col("read_id") % 2 == 1, 1).otherwise(2))
    # alignments are made once, and read by both sides of a pair and by each kind of pair
    return m, written(h.withColumn("pair_id", ((F.col("read_id") - F.col("mate")) / 2).cast("bigint")).drop("read_id"))


def _pairs(spark, d):
    m, h = _mates(spark, d)
    good = pairing.concordant(h, "FR", 0, 500)
    return m, h, written(good.unionByName(pairing.discordant(h, good)))


def q_pairs_fr(spark, d):
    return pairing.concordant(_mates(spark, d)[1], "FR", 0, 500)


def q_pairs_rf(spark, d):
    return pairing.concordant(_mates(spark, d, "RF")[1], "RF", 0, 100_000)


def q_pairs_ff(spark, d):
    return pairing.concordant(_mates(spark, d, "FF")[1], "FF", 0, 100_000)


def q_pairs_discordant(spark, d):
    return _pairs(spark, d)[2].where("discordant")


def q_pairs_best(spark, d):
    return pairing.ranked_pairs(pairing.best_pairs(_pairs(spark, d)[2]).drop("best"))


def q_pair_status(spark, d):
    m, h, p = _pairs(spark, d)
    return pairing.status(p, h, m.select("pair_id").distinct())


def q_pair_counters(spark, d):
    return counters.paired_end(q_pair_status(spark, d))


def q_sam_pairs(spark, d):
    m, h, p = _pairs(spark, d)
    ref = ref_seq(spark, d)
    ranked = pairing.ranked_pairs(pairing.best_pairs(p).drop("best"))
    return sinks.sam_pairs(ranked, m, ref).unionByName(sinks.sam_without_pair(h, p, m, ref))


def q_insert_size(spark, d):
    """Of pairs whose mates have one hit each in the first file."""
    files = ref_seq(spark, d).select("seq_id", "file_id")
    return insert_size.inferred(insert_size.unambiguous(_mates(spark, d)[1].join(files, "seq_id")))


def q_partition_uniform(spark, d):
    return reads(spark, d).select("read_id", F.inline(partition.uniform(F.length("seq"), 4)))


def q_partition_static(spark, d):
    return reads(spark, d).select("read_id", F.inline(partition.static(F.length("seq"), [0.25, 0.625])))


def q_partition_dynamic(spark, d):
    return partition.rarest(reads(spark, d), reference.kmer_frequencies(ref_seq(spark, d), 8), 4, 8)


def q_scheme_selection(spark, d):
    options = {"pigeon": schemes.pigeonhole(2), "pigeon_mirrored": schemes.mirrored(schemes.pigeonhole(2))}
    return schemes.select(reads(spark, d), reference.kmer_frequencies(ref_seq(spark, d), 8), options, 8)


def _coverage(name: str, k: int):
    return lambda spark, d: schemes.coverage(spark, schemes.GENERATORS[name](k), k).select(F.array_join(F.transform("errors", lambda x: x.cast("string")), "").alias("errors"), F.col("searches").cast("int").alias("searches"))


def q_cleaned_reads(spark, d):
    """Benchmark texts taken as records: name, trimmed and cleaned sequence."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").where("text is not null")
    seq = F.regexp_replace("text", "[^A-Za-z]", "")
    return items.select("item_id", dna.clean_name(F.concat(F.lit("@"), "text")).alias("name"), dna.cleaned(dna.trimmed(seq, 5, 90)).alias("seq"))


def q_odd_letters(spark, d):
    """Benchmark letters taken as a reference: what is no base is replaced by a seed."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").where("text is not null")
    return items.select("item_id", dna.without_odd_letters(F.regexp_replace("text", "[^A-Za-z]", ""), "GATT").alias("seq"))


def q_fold(spark, d):
    """The redundancy fold over crowded hits, taken as hits within two errors."""
    made = CROWDED.replace("(SELECT unnest(range(58)) AS i)", "(SELECT explode(sequence(0, 57)) AS i)").replace("strpos('ACGT', ", "instr('ACGT', ").replace('"', "`")
    return dedupe.non_redundant(derived(spark, d, made), 2, False)


def q_streaming(spark, d):
    """Reads as a stream, aligned batch by batch; the hits that it wrote."""
    from .streaming.reads import align_stream

    at = folder(spark)
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    stream = spark.readStream.schema(items.schema).parquet(f"{d}/benchmark.parquet*")
    rows = stream.select(F.col("item_id").alias("read_id"), dna.from_text(F.coalesce("text", F.lit(""))).alias("seq"))
    align_stream(rows, ref_seq(spark, d), Options(mode="all", metric="hamming", max_distance=0, cigar=False), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k[2:]: f for k, f in globals().items() if k.startswith("q_")}
    return found | {f"coverage_{LABELS.get(n, n)}_{k}": _coverage(n, k) for n, k in COVERAGES}


LABELS = {"01*0": "zero_ones_zero"}
COVERAGES = [("pigeon", 2), ("pigeon", 3), ("suffix_filter", 3), ("01*0", 2)]

# --- the same in SQL

_DNA = f"translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{dna.LETTERS}', '{dna.BASES_OF_LETTERS}')"
_RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"
_BASE = f"""
ref AS (SELECT doc_id AS seq_id, 'doc_' || doc_id AS seq_name, {_DNA} AS seq FROM documents WHERE doc_id IS NOT NULL),
reads AS (SELECT item_id AS read_id, {_DNA} AS seq FROM benchmark)"""


def _kmers(k: int) -> str:
    return f"km AS (SELECT substr(seq, i, {k}) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - {k - 2})) AS i FROM ref WHERE length(seq) >= {k}))"


def _stranded(table: str) -> str:
    return f"strands AS (SELECT read_id, '+' AS strand, seq FROM {table} UNION ALL SELECT read_id, '-', {_RC} FROM {table})"


_EXACT = """
found AS (SELECT s.read_id, s.strand, r.seq_id, s.seq, r.seq AS text FROM strands s JOIN ref r ON contains(r.seq, s.seq) WHERE s.seq <> ''),
hits AS (SELECT * FROM (SELECT read_id, strand, seq_id, seq, text, unnest(range(0, length(text) - length(seq) + 1)) AS "begin" FROM found)
  WHERE substr(text, "begin" + 1, length(seq)) = seq),
exact AS (SELECT read_id, strand, seq_id, CAST("begin" AS INT) AS "begin", CAST("begin" + length(seq) AS INT) AS "end", 0 AS distance, length(seq) || 'M' AS cigar FROM hits)"""
_HAMMING = f"""
v AS ({VARIANTS}), {_stranded("v")},
parts AS (SELECT read_id, strand, seq, CAST(floor(i * length(seq) / 4.0) AS INT) AS o, substr(seq, CAST(floor(i * length(seq) / 4.0) AS INT) + 1,
    CAST(floor((i + 1) * length(seq) / 4.0) AS INT) - CAST(floor(i * length(seq) / 4.0) AS INT)) AS p FROM strands, (SELECT unnest(range(4)) AS i)),
met AS (SELECT p.*, r.seq_id, r.seq AS text FROM parts p JOIN ref r ON contains(r.seq, p.p)),
loc AS (SELECT * FROM (SELECT *, unnest(range(0, length(text) - length(p) + 1)) AS b FROM met) WHERE substr(text, b + 1, length(p)) = p),
spots AS (SELECT DISTINCT read_id, strand, seq_id, seq, text, b - o AS "begin" FROM loc WHERE b - o >= 0 AND b - o + length(seq) <= length(text)),
ham AS (SELECT read_id, strand, seq_id, CAST("begin" AS INT) AS "begin", CAST("begin" + length(seq) AS INT) AS "end",
    CAST(hamming(seq, substr(text, "begin" + 1, length(seq))) AS INT) AS distance, length(seq) || 'M' AS cigar FROM spots),
h AS (SELECT * FROM ham WHERE distance <= 3)"""
_BEST = """
b0 AS (SELECT *, min(distance) OVER (PARTITION BY read_id) AS best FROM h),
b1 AS (SELECT *, CAST(sum(CASE WHEN distance = best THEN 1 ELSE 0 END) OVER (PARTITION BY read_id) AS INT) AS n_best FROM b0),
b2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY read_id ORDER BY distance, strand, seq_id, "begin", "end") AS INT) AS rank FROM b1 WHERE distance <= best + 1),
ranked AS (SELECT *, rank = 1 AS is_primary,
  CAST(CASE WHEN distance <> best THEN 0 WHEN n_best = 1 THEN 60 ELSE round(-10 * log10(1 - 1.0 / n_best)) END AS INT) AS mapq,
  CAST(CASE WHEN strand = '-' THEN 16 ELSE 0 END + CASE WHEN rank = 1 THEN 0 ELSE 256 END AS INT) AS flag FROM b2)"""
_LINE = """
full_ AS (SELECT k.*, r.seq_name, CASE WHEN k.strand = '-' THEN reverse(translate(v.seq, 'ACGT', 'TGCA')) ELSE v.seq END AS printed FROM ranked k JOIN ref r USING (seq_id) JOIN v USING (read_id)),
lines AS (SELECT read_id, rank, n_best, concat_ws(chr(9), read_id, flag, seq_name, "begin" + 1, mapq, cigar, '*', '0', '0',
    CASE WHEN is_primary THEN printed ELSE '*' END, '*', 'AS:i:' || distance, 'NM:i:' || distance, 'PG:Z:seqloom') AS line,
    seq_name || ',' || CASE WHEN strand = '-' THEN '-' ELSE '+' END || ("begin" + 1) || ',' || cigar || ',' || distance || ';' AS alt FROM full_),
nothing AS (SELECT read_id, 1 AS rank, concat_ws(chr(9), read_id, '4', '*', '0', '0', '*', '*', '0', '0', seq, '*', 'PG:Z:seqloom') AS line FROM v WHERE read_id NOT IN (SELECT read_id FROM ranked))"""
def _hits_of_mates(kind: str) -> str:
    return f"""
m AS ({mates(kind)}), mr AS (SELECT pair_id * 2 + mate AS read_id, seq FROM m), {_stranded("mr")}, {_EXACT},
h AS (SELECT CASE WHEN read_id % 2 = 1 THEN 1 ELSE 2 END AS mate, (read_id - CASE WHEN read_id % 2 = 1 THEN 1 ELSE 2 END) // 2 AS pair_id, strand, seq_id, "begin", "end", distance, cigar FROM exact)"""


_MATES = _hits_of_mates("FR")
_FIELDS = ["mate", "strand", "seq_id", "begin", "end", "distance", "cigar"]


def _oriented_pairs(orientation: str, least: int, most: int) -> str:
    cols = ", ".join([f'{s}."{c}" AS {n}_{c}' for s, n in (("u", "up"), ("w", "down")) for c in _FIELDS])
    where = " OR ".join(f"(u.mate = {a} AND u.strand = '{x}' AND w.mate = {b} AND w.strand = '{y}')" for (a, x), (b, y) in pairing.ORIENTATIONS[orientation])
    return f"""SELECT u.pair_id, {cols}, w."end" - u."begin" AS frag_size, u.distance + w.distance AS distance, false AS discordant
FROM h u JOIN h w ON u.pair_id = w.pair_id AND u.seq_id = w.seq_id WHERE ({where}) AND w."begin" >= u."begin" AND w."end" - u."begin" BETWEEN {least} AND {most}"""


_UP = ", ".join([f'CASE WHEN a."begin" <= b."begin" THEN a."{c}" ELSE b."{c}" END AS up_{c}' for c in _FIELDS] + [f'CASE WHEN a."begin" <= b."begin" THEN b."{c}" ELSE a."{c}" END AS down_{c}' for c in _FIELDS])
_DISCORDANT = f"""
good AS ({_oriented_pairs("FR", 0, 500)}),
few AS (SELECT pair_id FROM h WHERE pair_id NOT IN (SELECT pair_id FROM good) GROUP BY pair_id
  HAVING sum(CASE WHEN mate = 1 THEN 1 ELSE 0 END) * sum(CASE WHEN mate = 2 THEN 1 ELSE 0 END) BETWEEN 1 AND 10000),
disc AS (SELECT a.pair_id, {_UP}, CASE WHEN a.seq_id = b.seq_id THEN greatest(a."end", b."end") - least(a."begin", b."begin") ELSE 0 END AS frag_size,
  a.distance + b.distance AS distance, true AS discordant FROM h a JOIN h b ON a.pair_id = b.pair_id AND a.mate = 1 AND b.mate = 2 WHERE a.pair_id IN (SELECT pair_id FROM few))"""
_STATUS = """
mapped AS (SELECT pair_id, max(CASE WHEN mate = 1 THEN 1 ELSE 0 END) AS one, max(CASE WHEN mate = 2 THEN 1 ELSE 0 END) AS two FROM h GROUP BY pair_id),
st AS (SELECT pair_id, CASE WHEN pair_id IN (SELECT pair_id FROM good) THEN 'concordant' WHEN pair_id IN (SELECT pair_id FROM disc) THEN 'discordant'
  WHEN one = 1 AND two = 1 THEN 'unpaired' WHEN one = 1 THEN 'mate1' WHEN two = 1 THEN 'mate2' ELSE 'unmapped' END AS status
  FROM (SELECT DISTINCT pair_id FROM m) LEFT JOIN mapped USING (pair_id))"""
_SAM_PAIRS = """every AS (SELECT * FROM good UNION ALL SELECT * FROM disc),
x AS (SELECT *, min(distance) OVER (PARTITION BY pair_id) AS best FROM every),
y AS (SELECT *, count(*) OVER (PARTITION BY pair_id) AS n_best,
  CAST(row_number() OVER (PARTITION BY pair_id ORDER BY distance, up_seq_id, up_begin, down_begin, up_strand, up_mate, up_end, down_end, down_seq_id) AS INT) AS rank FROM x WHERE distance = best),
sides AS (
  SELECT pair_id, rank, n_best, frag_size, discordant, up_mate AS mate, up_strand AS strand, up_seq_id AS seq_id, up_begin AS b, up_distance AS d, up_cigar AS cigar, down_strand AS o_strand, down_seq_id AS o_seq, down_begin AS o_b FROM y
  UNION ALL SELECT pair_id, rank, n_best, frag_size, discordant, down_mate, down_strand, down_seq_id, down_begin, down_distance, down_cigar, up_strand, up_seq_id, up_begin FROM y),
paired AS (SELECT s.pair_id, s.rank, s.mate, concat_ws(chr(9), s.pair_id, 1 + CASE WHEN discordant THEN 0 ELSE 2 END + CASE WHEN strand = '-' THEN 16 ELSE 0 END + CASE WHEN o_strand = '-' THEN 32 ELSE 0 END
    + CASE WHEN s.mate = 1 THEN 64 ELSE 128 END + CASE WHEN rank = 1 THEN 0 ELSE 256 END, 'doc_' || seq_id, b + 1, CAST(CASE WHEN n_best = 1 THEN 60 ELSE round(-10 * log10(1 - 1.0 / n_best)) END AS INT), cigar, 'doc_' || o_seq, o_b + 1,
    CASE WHEN b > o_b THEN '-' ELSE '' END || frag_size, CASE WHEN strand = '-' THEN reverse(translate(m.seq, 'ACGT', 'TGCA')) ELSE m.seq END, '*', 'AS:i:' || d, 'NM:i:' || d, 'PG:Z:seqloom') AS line
  FROM sides s JOIN m ON m.pair_id = s.pair_id AND m.mate = s.mate),
alone AS (SELECT *, count(*) OVER (PARTITION BY pair_id, mate) AS n_best, CAST(row_number() OVER (PARTITION BY pair_id, mate ORDER BY seq_id, "begin", strand, "end") AS INT) AS rank
  FROM (SELECT *, min(distance) OVER (PARTITION BY pair_id, mate) AS best FROM h WHERE pair_id NOT IN (SELECT pair_id FROM every)) WHERE distance = best),
mapped_ AS (SELECT a.pair_id, a.rank, a.mate, concat_ws(chr(9), a.pair_id, 1 + CASE WHEN a.mate = 1 THEN 64 ELSE 128 END + CASE WHEN strand = '-' THEN 16 ELSE 0 END + CASE WHEN rank = 1 THEN 0 ELSE 256 END, 'doc_' || seq_id, "begin" + 1,
    CAST(CASE WHEN n_best = 1 THEN 60 ELSE round(-10 * log10(1 - 1.0 / n_best)) END AS INT), cigar, '*', '0', '0',
    CASE WHEN rank > 1 THEN '*' WHEN strand = '-' THEN reverse(translate(m.seq, 'ACGT', 'TGCA')) ELSE m.seq END, '*', 'AS:i:' || distance, 'NM:i:' || distance, 'PG:Z:seqloom') AS line
  FROM alone a JOIN m ON m.pair_id = a.pair_id AND m.mate = a.mate),
none AS (SELECT m.pair_id, 1 AS rank, m.mate, concat_ws(chr(9), m.pair_id, 5 + CASE WHEN o.strand IS NULL THEN 8 ELSE 0 END + CASE WHEN o.strand = '-' THEN 32 ELSE 0 END + CASE WHEN m.mate = 1 THEN 64 ELSE 128 END, '*', '0', '0', '*', '*', '0', '0', m.seq, '*', 'PG:Z:seqloom') AS line
  FROM m LEFT JOIN (SELECT * FROM alone WHERE rank = 1) o ON o.pair_id = m.pair_id AND o.mate = 3 - m.mate
  WHERE m.pair_id NOT IN (SELECT pair_id FROM every) AND NOT EXISTS (SELECT 1 FROM alone a WHERE a.pair_id = m.pair_id AND a.mate = m.mate))
SELECT pair_id, rank, mate, line FROM paired UNION ALL SELECT pair_id, rank, mate, line FROM mapped_ UNION ALL SELECT pair_id, rank, mate, line FROM none"""
_CATALOGUE = "cat AS (SELECT seq_id, seq_name, CAST(length(seq) AS BIGINT) AS len, CAST(sum(length(seq)) OVER (ORDER BY seq_id) - length(seq) AS BIGINT) AS start FROM ref)"


def _covered(name: str, k: int) -> str:
    scheme = schemes.GENERATORS[name](k)
    p = len(scheme[0].pi)
    digits = [f"(id // {(k + 1) ** i}) % {k + 1}" for i in range(p)]
    fits = []
    for s in scheme:
        steps = [f"({' + '.join(f'e{x}' for x in s.pi[: i + 1])}) BETWEEN {s.l[i]} AND {s.u[i]}" for i in range(p)]
        fits.append(f"CASE WHEN {' AND '.join(steps)} THEN 1 ELSE 0 END")
    cols = ", ".join(f"{x} AS e{i}" for i, x in enumerate(digits))
    return f"""SELECT {" || ".join(f"e{i}" for i in range(p))} AS errors, CAST({" + ".join(fits)} AS INT) AS searches
FROM (SELECT {cols} FROM (SELECT unnest(range({(k + 1) ** p})) AS id)) WHERE {" + ".join(f"e{i}" for i in range(p))} <= {k}"""


def _part(name: str, edges: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT read_id, {i} AS part, CAST({edges[i]} AS INT) AS \"begin\", CAST({edges[i + 1]} AS INT) AS \"end\" FROM reads" for i in range(len(edges) - 1))
    return f"WITH {_BASE} {rows}"


def oracle_sql() -> dict[str, str]:
    ham, best, pair = f"WITH {_BASE}, {_HAMMING}", f"WITH {_BASE}, {_HAMMING}, {_BEST}", f"WITH {_BASE}, {_MATES}"
    pairs = f"{pair}, {_DISCORDANT}"
    every = "every AS (SELECT * FROM good UNION ALL SELECT * FROM disc)"
    return {
        "dna_functions": f"""WITH {_BASE} SELECT read_id, CAST(length(seq) AS INT) AS len, translate(seq, 'ACGT', 'TGCA') AS complement, {_RC} AS rc, reverse(seq) AS reversed,
  regexp_full_match(seq, '[ACGT]*') AS is_acgt, least(seq, {_RC}) AS canonical, CAST(least(13, floor(length(seq) * 5 / 100.0)) AS INT) AS max_errors, seq || 'N' AS cleaned FROM reads""",
        "letter_counts": f"WITH {_BASE} SELECT letter, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS letter FROM ref) WHERE letter <> '' GROUP BY letter",
        "kmer_frequencies": f"WITH {_BASE}, {_kmers(6)} SELECT kmer, count(*) AS n FROM km GROUP BY kmer",
        "canonical_kmers": f"WITH {_BASE}, {_kmers(6)} SELECT least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM km GROUP BY 1",
        "packed_kmers": f"""WITH {_BASE}, {_kmers(5)}, c AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer)
SELECT kmer, CAST({" + ".join(f"{4 ** (4 - i)} * (strpos('ACGT', substr(kmer, {i + 1}, 1)) - 1)" for i in range(5))} AS BIGINT) AS code, kmer AS unpacked, n FROM c""",
        "catalogue": f"WITH {_BASE}, {_CATALOGUE} SELECT * FROM cat",
        "locate": f"""WITH {_BASE}, {_CATALOGUE}, loc AS (SELECT greatest(start + len - 30 - seq_id % 40, 0) AS pos, 50 AS width FROM cat WHERE len > 0)
SELECT pos, width, seq_id, pos - start AS "begin", CASE WHEN pos + width <= start + len THEN 'found' ELSE 'clipped' END AS found FROM loc JOIN cat ON pos >= start AND pos < start + len""",
        "exact": f"WITH {_BASE}, {_stranded('reads')}, {_EXACT} SELECT * FROM exact",
        "prepared": f"WITH {_BASE}, {_stranded('reads')}, {_EXACT} SELECT * FROM exact",
        "hamming": f"{ham} SELECT * FROM h",
        "hamming_best": f"{best} SELECT * FROM ranked",
        "sam": f"{best}, {_LINE} SELECT read_id, rank, line FROM lines UNION ALL SELECT * FROM nothing",
        "sam_xa": f"""{best}, {_LINE}, o AS (SELECT read_id, max(n_best) AS nb, count(*) - 1 AS others, coalesce(string_agg(CASE WHEN rank > 1 THEN alt END, '' ORDER BY rank), '') AS alts FROM lines GROUP BY read_id)
SELECT read_id, 1 AS rank, line || chr(9) || 'X0:i:' || (nb - 1) || chr(9) || 'X1:i:' || (others - (nb - 1)) || chr(9) || 'XA:Z:' || alts AS line FROM lines JOIN o USING (read_id) WHERE rank = 1 UNION ALL SELECT * FROM nothing""",
        "sam_header": f"""WITH {_BASE} SELECT -2 AS read_ord, 0 AS rank, '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:queryname' AS line
UNION ALL SELECT -2, 1, '@PG' || chr(9) || 'ID:seqloom' || chr(9) || 'PN:seqloom' || chr(9) || 'CL:queries'
UNION ALL SELECT -1, seq_id, '@SQ' || chr(9) || 'SN:' || seq_name || chr(9) || 'LN:' || length(seq) FROM ref""",
        "rhs": f"""{ham}, once AS (SELECT DISTINCT read_id, distance, seq_id FROM h),
by_ AS (SELECT read_id, string_agg('(' || seq_id || ',' || distance || ')', ';' ORDER BY distance, seq_id) AS hits FROM once GROUP BY read_id)
SELECT v.read_id, coalesce(hits, '*') AS hits FROM v LEFT JOIN by_ USING (read_id)""",
        "counters": f"""{ham}, per AS (SELECT read_id, count(*) AS h, sum(distance) AS d, min(distance) AS best FROM h GROUP BY read_id),
top AS (SELECT h.read_id, count(*) AS b FROM h JOIN per USING (read_id) WHERE distance = best GROUP BY h.read_id)
SELECT count(*) AS reads, count(*) FILTER (h > 0) AS mapped_reads, round(100.0 * count(*) FILTER (h > 0) / count(*), 6) AS mapped_pct, CAST(coalesce(sum(h), 0) AS BIGINT) AS hits,
  count(*) FILTER (b = 1) AS unique_best, round(coalesce(sum(h), 0) / count(*), 6) AS avg_hits, round(sum(d) / sum(h), 6) AS avg_distance
FROM v LEFT JOIN per USING (read_id) LEFT JOIN top USING (read_id)""",
        "pairs_fr": f"{pair} {_oriented_pairs('FR', 0, 500)}",
        "pairs_rf": f"WITH {_BASE}, {_hits_of_mates('RF')} {_oriented_pairs('RF', 0, 100_000)}",
        "pairs_ff": f"WITH {_BASE}, {_hits_of_mates('FF')} {_oriented_pairs('FF', 0, 100_000)}",
        "pairs_discordant": f"{pairs} SELECT * FROM disc",
        "pairs_best": f"""{pairs}, {every}, x AS (SELECT *, min(distance) OVER (PARTITION BY pair_id) AS best FROM every),
y AS (SELECT *, CAST(count(*) OVER (PARTITION BY pair_id) AS INT) AS n_best,
  CAST(row_number() OVER (PARTITION BY pair_id ORDER BY distance, up_seq_id, up_begin, down_begin, up_strand, up_mate, up_end, down_end, down_seq_id) AS INT) AS rank FROM x WHERE distance = best)
SELECT *, CAST(CASE WHEN n_best = 1 THEN 60 ELSE round(-10 * log10(1 - 1.0 / n_best)) END AS INT) AS mapq FROM y""",
        "pair_status": f"{pairs}, {_STATUS} SELECT * FROM st",
        "pair_counters": f"{pairs}, {_STATUS} SELECT status, count(*) AS pairs, round(100.0 * count(*) / (SELECT count(*) FROM st), 6) AS pct FROM st GROUP BY status",
        "insert_size": f"""{pair}, one AS (SELECT pair_id, mate, min(strand) AS strand, min(seq_id) AS seq_id, min("begin") AS b, min("end") AS e FROM h WHERE seq_id % 2 = 0 GROUP BY pair_id, mate HAVING count(*) = 1),
p AS (SELECT a.pair_id, CASE WHEN a.strand = b.strand THEN 'FF' WHEN (CASE WHEN a.strand = '+' THEN a.b <= b.b ELSE b.b <= a.b END) THEN 'FR' ELSE 'RF' END AS o,
  greatest(a.e, b.e) - least(a.b, b.b) AS s FROM one a JOIN one b ON a.pair_id = b.pair_id AND a.seq_id = b.seq_id AND a.mate = 1 AND b.mate = 2),
md AS (SELECT CAST(floor(median(s)) AS INT) AS md FROM p), ad AS (SELECT CAST(floor(median(abs(s - md))) AS INT) AS mad FROM p, md),
u AS (SELECT count(*) AS n, max(md) AS md, max(mad) AS mad, avg(s) FILTER (abs(s - md) < 6 * mad) AS m1, stddev_samp(s) FILTER (abs(s - md) < 6 * mad) AS s1, avg(s) AS m2, stddev_samp(s) AS s2,
  count(*) FILTER (o = 'FR') AS fr, count(*) FILTER (o = 'RF') AS rf, count(*) FILTER (o = 'FF') AS ff FROM p, md, ad),
w AS (SELECT *, CASE WHEN coalesce(m1, 0) * coalesce(s1, 0) = 0 THEN m2 ELSE m1 END AS mean, coalesce(CASE WHEN coalesce(m1, 0) * coalesce(s1, 0) = 0 THEN s2 ELSE s1 END, 0) AS sd FROM u)
SELECT n, md AS median, mad, CASE WHEN n < 2 THEN 0.0 ELSE round(mean, 6) END AS mean, CASE WHEN n < 2 THEN 0.0 ELSE round(sd, 6) END AS stddev,
  CASE WHEN n < 2 THEN 0 ELSE CAST(greatest(floor(mean - floor(6 * sd)), 0) AS INT) END AS min_insert, CASE WHEN n < 2 THEN 500 ELSE CAST(floor(mean + floor(6 * sd)) AS INT) END AS max_insert,
  CASE WHEN n < 2 OR (fr >= rf AND fr >= ff) THEN 'FR' WHEN rf >= ff THEN 'RF' ELSE 'FF' END AS orientation FROM w""",
        "partition_uniform": _part("u", [f"floor({i} * length(seq) / 4.0)" for i in range(5)]),
        "partition_static": _part("s", ["0", "floor(length(seq) * 0.25)", "floor(length(seq) * 0.625)", "length(seq)"]),
        "scheme_selection": f"""WITH {_BASE}, {_kmers(8)}, c AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer),
o AS (SELECT read_id, 'pigeon' AS scheme, substr(seq, CAST(floor({schemes.critical_part(schemes.pigeonhole(2))} * length(seq) / 3.0) AS INT) + 1, 8) AS kmer FROM reads
  UNION ALL SELECT read_id, 'pigeon_mirrored', substr(seq, CAST(floor({schemes.critical_part(schemes.mirrored(schemes.pigeonhole(2)))} * length(seq) / 3.0) AS INT) + 1, 8) FROM reads)
SELECT read_id, scheme FROM (SELECT read_id, scheme, row_number() OVER (PARTITION BY read_id ORDER BY coalesce(n, 0), scheme) AS r FROM o LEFT JOIN c USING (kmer)) WHERE r = 1""",
        "cleaned_reads": """WITH t AS (SELECT item_id, text, regexp_replace(text, '[^A-Za-z]', '', 'g') AS s FROM benchmark WHERE text IS NOT NULL)
SELECT item_id, split_part(text, ' ', 1) AS name, regexp_replace(upper(CASE WHEN length(s) >= 90 THEN substr(s, 6, 85) ELSE s END), '[^ACGT]', 'N', 'g') AS seq FROM t""",
        "partition_dynamic": f"""WITH {_BASE}, {_kmers(8)}, c AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer),
p AS (SELECT read_id, seq, i AS part, CAST(floor(i * length(seq) / 4.0) AS INT) AS "begin", CAST(floor((i + 1) * length(seq) / 4.0) AS INT) AS "end" FROM reads, (SELECT unnest(range(4)) AS i)),
o AS (SELECT *, substr(seq, "offset" + 1, 8) AS kmer FROM (SELECT *, CAST(unnest(range("begin", greatest("end" - 7, "begin" + 1))) AS INT) AS "offset" FROM p))
SELECT read_id, CAST(part AS INT) AS part, "begin", "end", "offset", kmer, n FROM (SELECT o.*, coalesce(c.n, 0) AS n, row_number() OVER (PARTITION BY read_id, part ORDER BY coalesce(c.n, 0), "offset") AS r FROM o LEFT JOIN c USING (kmer)) WHERE r = 1""",
        "odd_letters": """WITH t AS (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM benchmark WHERE text IS NOT NULL),
l AS (SELECT item_id, i, substr(s, i, 1) AS c FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM t)),
b AS (SELECT *, coalesce(max(CASE WHEN c IN ('A', 'C', 'G', 'T') THEN i END) OVER (PARTITION BY item_id ORDER BY i), 0) AS last_ FROM l),
f AS (SELECT item_id, string_agg(CASE WHEN last_ = i THEN c ELSE substr('GATT', CAST((i - last_ - 1) % 4 + 1 AS INT), 1) END, '' ORDER BY i) AS seq FROM b GROUP BY item_id)
SELECT item_id, coalesce(seq, '') AS seq FROM t LEFT JOIN f USING (item_id)""",
        # with one error at most a half is free of errors; what it leaves is compared with the text beside it
        "edit_distance": f"""WITH {_BASE}, g AS ({GAPPED}), {_stranded("g")},
halves AS (SELECT *, i, CASE WHEN i = 0 THEN substr(seq, 1, CAST(floor(length(seq) / 2.0) AS INT)) ELSE substr(seq, CAST(floor(length(seq) / 2.0) AS INT) + 1) END AS p FROM strands, (SELECT unnest(range(2)) AS i)),
met AS (SELECT h.*, r.seq AS text FROM halves h JOIN ref r ON contains(r.seq, h.p) WHERE h.p <> ''),
loc AS (SELECT * FROM (SELECT *, unnest(range(0, length(text) - length(p) + 1)) AS b FROM met) WHERE substr(text, b + 1, length(p)) = p),
win AS (SELECT read_id, seq, CASE WHEN i = 0 THEN substr(text, b + 1, length(seq) + e) ELSE substr(text, greatest(b + length(p) - length(seq) - e, 0) + 1, least(length(seq) + e, b + length(p))) END AS w FROM loc, (SELECT unnest(range(-1, 2)) AS e))
SELECT read_id, CAST(min(levenshtein(seq, w)) AS INT) AS best FROM win GROUP BY read_id HAVING min(levenshtein(seq, w)) <= 1""",
        # the fold, hit by hit: a state for each of the sorted hits, the survivor of a cluster is what its last state keeps
        "fold": f"""WITH RECURSIVE {_BASE}, h AS ({CROWDED}),
o AS (SELECT *, row_number() OVER (PARTITION BY read_id, seq_id ORDER BY "begin", distance, "end" - "begin", strand, cigar) AS n FROM h),
st AS (SELECT read_id, seq_id, n, 1 AS c, "begin" AS b, "end" AS e, distance AS x FROM o WHERE n = 1
  UNION ALL SELECT s.read_id, s.seq_id, o.n, CASE WHEN o."begin" - s.b > 4 THEN c + 1 ELSE c END,
    CASE WHEN o."begin" - s.b > 4 OR (o."begin" > s.b AND (o.distance, o."end" - o."begin") < (s.x, s.e - s.b)) THEN o."begin" ELSE s.b END,
    CASE WHEN o."begin" - s.b > 4 OR (o."begin" > s.b AND (o.distance, o."end" - o."begin") < (s.x, s.e - s.b)) THEN o."end" ELSE s.e END,
    CASE WHEN o."begin" - s.b > 4 OR (o."begin" > s.b AND (o.distance, o."end" - o."begin") < (s.x, s.e - s.b)) THEN o.distance ELSE s.x END
  FROM st s JOIN o ON o.read_id = s.read_id AND o.seq_id = s.seq_id AND o.n = s.n + 1)
SELECT read_id, '+' AS strand, seq_id, b AS "begin", e AS "end", x AS distance, '*' AS cigar FROM (SELECT *, row_number() OVER (PARTITION BY read_id, seq_id, c ORDER BY n DESC) AS r FROM st) WHERE r = 1""",
        "sam_pairs": f"""{pairs}, {_SAM_PAIRS}""",
        "streaming": f"""WITH {_BASE}, {_stranded("reads")}, {_EXACT}, x AS (SELECT read_id, strand, seq_id, "begin", "end", distance, '*' AS cigar,
  0 AS best, CAST(count(*) OVER (PARTITION BY read_id) AS INT) AS n_best, CAST(row_number() OVER (PARTITION BY read_id ORDER BY strand, seq_id, "begin") AS INT) AS rank FROM exact)
SELECT *, rank = 1 AS is_primary, CAST(CASE WHEN n_best = 1 THEN 60 ELSE round(-10 * log10(1 - 1.0 / n_best)) END AS INT) AS mapq,
  CAST(CASE WHEN strand = '-' THEN 16 ELSE 0 END + CASE WHEN rank = 1 THEN 0 ELSE 256 END AS INT) AS flag FROM x""",
    } | {f"coverage_{LABELS.get(n, n)}_{k}": _covered(n, k) for n, k in COVERAGES}
