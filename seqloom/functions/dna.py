"""Column functions over DNA strings; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The i-th letter of the alphabet becomes the (i mod 4)-th base.
BASES_OF_LETTERS = "".join("ACGT"[i % 4] for i in range(26))
#: No read has more errors than this; the best mapping quality.
MAX_ERRORS, MAX_MAPQ = 13, 60


def from_text(text: Column) -> Column:
    """DNA of a text: its letters A-Z as bases, all else dropped."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, BASES_OF_LETTERS)


def complement(seq: Column) -> Column:
    """Base pairs exchanged; other letters stay."""
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def is_acgt(seq: Column) -> Column:
    return seq.rlike("^[ACGT]*$")


def contains_n(seq: Column) -> Column:
    return seq.contains("N")


def cleaned(seq: Column) -> Column:
    """Upper case, with N for everything that is no base."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def clean_name(name: Column) -> Column:
    """A record's name: up to the first space, without its marker."""
    return F.substring_index(F.regexp_replace(name, "^[>@]", ""), " ", 1)


def trimmed(seq: Column, start: int, end: int) -> Column:
    """Characters start .. end - 1 (0-based) of a record that is long enough; others stay whole."""
    return F.when(F.length(seq) >= end, F.substring(seq, start + 1, end - start)).otherwise(seq)


def trimmed_quality(qual: Column, seq: Column, start: int, end: int) -> Column:
    """The qualities of a trimmed record; "*" stays."""
    return F.when(qual == "*", qual).when(F.length(seq) >= end, F.substring(qual, start + 1, end - start)).otherwise(qual)


def packed(kmer: Column) -> Column:
    """Two bits a base, at most 31 bases."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


def unpacked(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def kmers(seq: Column, k: int) -> Column:
    """array of the k-mers of a short sequence, in order."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substr(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def without_odd_letters(seq: Column, seed: str = "ACGT") -> Column:
    """Letters that are no bases replaced by the seed, cyclically and anew after each real base: run by run."""
    runs = F.regexp_extract_all(F.upper(seq), F.lit("[ACGT]+|[^ACGT]+"), F.lit(0))
    filled = F.transform(runs, lambda r: F.when(r.rlike("^[ACGT]"), r).otherwise(F.rpad(F.lit(""), F.length(r), F.lit(seed))))
    return F.when(is_acgt(F.upper(seq)), F.upper(seq)).otherwise(F.array_join(filled, ""))


def max_errors(length: Column, identity: int, limit: int = MAX_ERRORS) -> Column:
    """Most errors that leave the given identity (per cent)."""
    return F.least(F.lit(limit), F.floor(length * (100 - identity) / 100)).cast("int")


def mapq(is_best: Column, n_best: Column) -> Column:
    """Mapping quality of one of n best hits; 0 for others."""
    return F.when(~is_best, F.lit(0)).when(n_best == 1, F.lit(MAX_MAPQ)).otherwise(F.round(-10 * F.log10(1 - 1 / n_best))).cast("int")


def flags_single(strand: Column, primary: Column) -> Column:
    return F.when(strand == "-", 16).otherwise(0) + F.when(primary, 0).otherwise(256)


def flags_pair(mapped: Column, mate_mapped: Column, strand: Column, mate_strand: Column, first: Column, discordant: Column, primary: Column) -> Column:
    bit = lambda c, v: F.when(c, v).otherwise(0)
    return F.lit(1) + bit(~discordant & mapped & mate_mapped, 2) + bit(~mapped, 4) + bit(~mate_mapped, 8) + bit(strand == "-", 16) + bit(mate_strand == "-", 32) + bit(first, 64) + bit(~first, 128) + bit(~primary, 256)


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two strings of one length differ; N differs from everything."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when((x != y) | (x == "N"), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
