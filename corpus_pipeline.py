"""The corpus pipeline: rejects poor documents, keeps one of each near-duplicate group, drops those that hold
benchmark items, replaces personal data, and encodes what is left.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; the result is written
as Parquet and read again as the next stage's docs. All but the last return the columns of documents; n_chars
follows the text. A stage begins by deleting the temporary tables of the one before, whose result is written by then.

Defined results: a row with a null doc_id is a document of its own; rows that share a doc_id are one document,
judged by all its texts, and of them the second stage keeps the one that comes first in the order of text and all
other columns; null and empty texts are scored, never near-duplicates, and pass; an empty table gives no rows. Columns
of documents that are named as a stage's own are kept as they are, but in the last one (see there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm import bpe, decontaminate, minhash, pii, quality
from seqloom.llm.common import cut, delete, shared_dir, sweep, table

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None

OWN = "own_"


def _hidden(docs: DataFrame, *names: str) -> DataFrame:
    """docs with columns of these names put aside."""
    return docs.withColumnsRenamed({c: OWN + c for c in docs.columns if c.lower() in names})


def _shown(rows: DataFrame, docs: DataFrame, *names: str) -> DataFrame:
    """rows with the columns of docs under their names."""
    return rows.select(*[F.col(OWN + c).alias(c) if c.lower() in names else F.col(c) for c in docs.columns])


def _identified(docs: DataFrame) -> DataFrame:
    """docs with a doc_id for rows that have none, greater than all others; written down where there are such rows, as ids must not change."""
    if not docs.where("doc_id is null").limit(1).count():
        return docs
    own = F.lit(1 << 62) + F.monotonically_increasing_id()
    return cut(docs.withColumn("doc_id", F.coalesce("doc_id", own)))


def _restored(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.when(F.col("doc_id") < 1 << 62, F.col("doc_id")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Each row is judged by its own text; without labels all stay."""
    sweep(spark)
    own = ("score", "predicted")
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _shown(quality.scored(_hidden(docs, *own), model).where("predicted = 1"), docs, *own)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group; one row of each doc_id, and of rows without one those whose text no other row repeats."""
    sweep(spark)
    rows = _identified(docs)
    kept = minhash.components(rows.select("doc_id", "text")).where("kept").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*[c for c in docs.columns if c != "text"]))
    place = "_place_in_its_document"
    one = rows.join(kept, "doc_id", "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return _restored(one).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and empty texts hold none."""
    sweep(spark)
    rows = _identified(docs)
    found = decontaminate.leaks(rows, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return _restored(rows.join(found, "doc_id", "left_anti")).select(*docs.columns)


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with pseudonyms for personal data; n_chars is counted anew where a text has changed."""
    sweep(spark)
    own = ("kinds", "n_replaced")
    new = pii.pseudonymised(_hidden(docs, *own))
    new = new.withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("bigint"))
    return _shown(new, docs, *own)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, with ids, n_tokens, and as text that decoded from the ids (null: empty); columns of documents named ids, n_tokens or decoded are called own_<name>."""
    import public_tokenizers as p

    sweep(spark)
    docs = _hidden(docs, "ids", "n_tokens", "decoded")
    keep = tuple(c for c in docs.columns if c != "text")
    return bpe.encode(docs, p.path("byte_bpe_50k.tiktoken"), p.PATTERN, keep=keep, with_text=True).withColumnRenamed("decoded", "text")


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("personal data", hide_persons),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is deleted once the next one's is written; the last one's input stays for who reads the result."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
