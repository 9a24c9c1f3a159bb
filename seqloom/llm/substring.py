"""Operator 3: duplicate passages by seed and extend.

The anchor of a window of WINDOW words is the smallest hash among its runs of ANCHOR words; as it depends on
the window's words alone, equal windows have equal anchors wherever they stand (winnowing). Consecutive
windows with the same anchor make a segment, the seed together with its extension both ways as far as the
anchor reaches. Segments whose anchor stands in one document only are dropped by the first join. Of equal
segments the smallest document keeps its own and the others lose theirs whole. Where the segments of an
anchor differ, the match is extended from the anchor word by word: each window of one segment of each
content is compared with the windows of the others, by two 64-bit polynomial hashes (of the words' 64-bit hashes)
that Spark groups, so that the cost is linear in the text however many documents share a passage: the windows of
one anchor that agree are the extension, as far as it goes to either side. Adjacent matches merge into maximal repeats.

Defined results: null and empty texts have no words; documents shorter than WINDOW lose nothing; a null
doc_id is not smaller than any, nor is any smaller than it; rows that share a doc_id don't take words from
each other; an empty table gives no rows; further columns are ignored. Texts are worked on a few at a time, by their
bytes, and go back to Spark in small batches, so that memory follows from the longest text, not from many long ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, as_long, cut, drop, hashes, mix, ready, rolling, tidy, words

WINDOW, ANCHOR = 50, 10
#: Bytes of text that are worked on at once, and rows that go back to Spark at once.
BYTES, ROWS = 1 << 21, 1 << 16
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the runs of words from start to end, of any lengths."""
    up, down = _powers(base, len(h) + 1)
    s = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * down[: len(h)], out=s[1:])
    return mix((s[end] - s[start]) * up[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def smallest(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def segments(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's word hashes: anchor, first window and number of windows of each segment."""
    if len(h) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    m = smallest(rolling(h, ANCHOR), WINDOW - ANCHOR + 1)
    start = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
    return m[start], start, np.diff(np.append(start, len(m)))


def runs(start: list[int], count: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Words covered by runs of windows, as disjoint ranges (from, to): the maximal repeats."""
    order = np.argsort(np.array(start, np.int64), kind="stable")
    a = np.array(start, np.int64)[order]
    b = np.maximum.accumulate(a + np.array(count, np.int64)[order] + WINDOW - 1)
    new = np.concatenate([[True], a[1:] > b[:-1]])
    at = np.flatnonzero(new)
    return a[at], b[np.append(at[1:] - 1, len(a) - 1)]


def light(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most BYTES of text, a row at least: what is made of a text is many times its size."""
    for b in batches:
        end = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = end[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(end, before + BYTES, "right")))
            yield b.slice(at, to - at)
            at = to


def thin(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ROWS."""
    for at in range(0, b.num_rows, ROWS):
        yield b.slice(at, ROWS)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, version (of rows that share a doc_id), text."""
    return docs.select("doc_id", F.hash("text").alias("version"), "text")


def seeds(docs: DataFrame) -> DataFrame:
    """doc_id, version, anchor, hashes s1 and s2, start and count of each segment."""

    def run(batches):
        for b in light(batches):
            ids, versions, cols = b.column("doc_id").to_pylist(), b.column("version").to_pylist(), [[] for _ in range(7)]
            for d, v, t in zip(ids, versions, b.column("text").to_pylist(), strict=True):
                w = words(t)
                if len(w) < WINDOW:
                    continue
                h = hashes(w)
                anchor, start, count = segments(h)
                end = start + count + WINDOW - 1
                n = len(start)
                for c, x in zip(cols, (np.full(n, d), np.full(n, v, np.int32), as_long(anchor), *(as_long(spans(h, start, end, base)) for base in BASES), start.astype(np.int32), count.astype(np.int32)), strict=True):
                    c.append(x)
            if cols[0]:
                yield from thin(pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["doc_id", "version", "anchor", "s1", "s2", "start", "count"]))

    return docs.where("doc_id is not null and text is not null").mapInArrow(run, "doc_id bigint, version int, anchor bigint, s1 bigint, s2 bigint, start int, count int")


def windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """w1, w2, doc_id, version, start, count: windows of the wanted segments; equal neighbours are one row."""

    def run(batches):
        for b in light(batches):
            cols = [[] for _ in range(6)]
            for d, v, t, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "version", "text", "at")), strict=True):
                h = hashes(words(t))
                first, second = (rolling(h, WINDOW, base) for base in BASES)
                start = np.unique(np.concatenate([np.arange(x["start"], x["start"] + x["count"]) for x in at]))
                one, two = first[start], second[start]
                cutoff = np.concatenate([[True], (np.diff(start) != 1) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
                i = np.flatnonzero(cutoff)
                n = len(i)
                for c, x in zip(cols, (as_long(one[i]), as_long(two[i]), np.full(n, d), np.full(n, v, np.int32), start[i].astype(np.int32), np.diff(np.append(i, len(start))).astype(np.int32)), strict=True):
                    c.append(x)
            if cols[0]:
                yield from thin(pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["w1", "w2", "doc_id", "version", "start", "count"]))

    by = wanted.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "count")).alias("at"))
    both = docs.join(by, ["doc_id", "version"]).select("doc_id", "version", "text", "at")
    return both.mapInArrow(run, "w1 bigint, w2 bigint, doc_id bigint, version int, start int, count int")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, version, start, count: runs of windows that also start in a document with a smaller doc_id. docs: keyed."""
    spark = docs.sparkSession
    every = cut(seeds(docs))
    shared = cut(every.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"))
    tidy(spark)
    some = cut(every.join(shared, "anchor"))
    drop(spark, every, shared)
    tidy(spark)
    same = ["anchor", "s1", "s2"]
    first = cut(some.groupBy(*same).agg(F.min("doc_id").alias("low")))
    differ = cut(first.groupBy("anchor").agg(F.count("*").alias("n"), F.min("low").alias("a"), F.max("low").alias("b")).where("n > 1 and a < b").select("anchor"))
    named = some.join(first, same)
    whole = named.where("doc_id > low").select("doc_id", "version", "start", "count")
    own = named.where("doc_id = low").select("anchor", "doc_id", "version", "start", "count").join(differ, "anchor").select("doc_id", "version", "start", "count")
    whole, own = cut(whole), cut(own)
    drop(spark, some, first, differ)
    tidy(spark)
    part = cut(windows(docs, own))
    tidy(spark)
    least = cut(part.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("w1", "w2", "low"))
    extended = cut(part.join(least, ["w1", "w2"]).where("doc_id > low").select("doc_id", "version", "start", "count"))
    drop(spark, own, part, least)
    tidy(spark)
    return whole.unionByName(extended)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space)."""
    spark = docs.sparkSession
    ready(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
    docs = _keyed(docs)
    found = repeats(docs)
    by = found.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "count")).alias("at"))

    def run(batches):
        for b in light(batches):
            n, removed, texts = [], [], []
            for t, at in zip(b.column("text").to_pylist(), b.column("at").to_pylist(), strict=True):
                w = words(t)
                n.append(len(w))
                if at:
                    a, e = runs([x["start"] for x in at], [x["count"] for x in at])
                    left, last = [], 0
                    for i, j in zip(a.tolist(), e.tolist(), strict=True):
                        left += w[last:i]
                        last = j
                    w = left + w[last:]
                removed.append(n[-1] - len(w))
                texts.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), pa.array([x.decode("utf-8", "surrogatepass") for x in texts], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    both = docs.join(by, ["doc_id", "version"], "left").select("doc_id", "text", "at")
    return both.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
