"""Operator 1: near-duplicates by min-max hashing.

Under each of PERMUTATIONS permutations of the 64-bit shingle hashes both the smallest and the largest value
are kept: two signature values for one evaluation. Bands take two permutations, so four values; a pair at the
threshold misses all BANDS bands with a probability of about (1 - 0.75 ** 4) ** BANDS, 1e-8, if the sets are large
(smallest and largest value are then nearly independent), and of 1e-6 for the smallest sets that can be linked
without being equal (three of four shingles: both agree with 1/2, a band with 1/4). Documents with the same shingle set form a class first, and only classes are compared. In each bucket the members are compared
with one centre, on full sets; verified links join components; then other centres are taken in buckets whose
members are still in several components, and what then
is left in buckets of several components goes through an exact join on prefixes of the sets, rarest shingles first. So
no link between texts that share a bucket is lost, and no bucket is expanded into all its pairs: the last join meets
only pairs that share one of the rarest quarter of their shingles and whose sizes and places still allow a link.

Defined results: a null or empty text, or one without words, has an empty set, is linked with nothing and is
kept; a text of fewer than WIDTH words is one shingle; repeated rows have the same component and are both
returned; rows that share a doc_id are one document; a null doc_id has a null component unless its class has
ids, and is never kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, cut, drop, hashes, mix, ready, rolling, tidy
from .components import connected

WIDTH, PERMUTATIONS, BANDS = 5, 96, 48
#: A link: 100 * intersection >= SHARE * union.
SHARE = 75
#: Star rounds end when two in a row find no link, or after so many.
ROUNDS = 6
#: Size of the table by which shingles are ordered.
SLOTS = 1 << 18

_rng = np.random.default_rng(20_000_003)
_FACTORS = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and the six white spaces
    if not w:
        return np.empty(0, np.uint64)
    h = hashes(w)
    return np.unique(rolling(h, min(WIDTH, len(h))))


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of a set under each permutation."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(found), 1024):
        v = found[None, i : i + 1024] * _FACTORS[:, None] + _SHIFTS[:, None]
        np.minimum(low, v.min(1), out=low)
        np.maximum(high, v.max(1), out=high)
    return low, high


def bands(found: np.ndarray) -> np.ndarray:
    """One key for each band, the band's number included."""
    low, high = signature(found)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for v in (low[::2], high[::2], low[1::2], high[1::2]):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + v)
    return key


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (hashes of the set), bands."""

    def run(batches):
        import xxhash

        for b in batches:
            n, first, second, keys = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                first.append(int.from_bytes(d[:8], "little", signed=True))
                second.append(int.from_bytes(d[8:], "little", signed=True))
                keys.append(as_long(bands(s)) if len(s) else np.empty(0, np.int64))
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], names=["doc_id", "n_shingles", "h1", "h2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>")


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets are linked: exact, on all their shingles."""
    if 100 * min(len(x), len(y)) < SHARE * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= SHARE * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are linked. texts: node, text."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")

    def run(batches):
        seen: OrderedDict[str, np.ndarray] = OrderedDict()

        def of(text: str) -> np.ndarray:
            s = seen.get(text)
            if s is None:
                s = seen[text] = shingles(text)
                if len(seen) > 64:
                    seen.popitem(last=False)
            return s

        for b in batches:
            ok = [alike(of(x), shingles(y)) for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def near(pairs: DataFrame) -> DataFrame:
    """Pairs whose sizes allow a link."""
    return pairs.where(f"100 * least(na, nb) >= {SHARE} * greatest(na, nb) and a <> b")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    ready(spark)
    rows = cut(sketches(docs))
    full = rows.where("n_shingles > 0")
    classes = cut(full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")).where("node is not null"))
    labels = linked(docs, classes)
    named = classes.select("h1", "h2", "n_shingles", "node").join(labels, "node", "left").select("h1", "h2", "n_shingles", F.coalesce("label", "node").alias("component_id"))
    named = cut(named)
    drop(spark, classes, labels)
    some = full.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2", "n_shingles"], "left")
    none = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    out = some.select("doc_id", "n_shingles", "component_id").unionByName(none.select("doc_id", "n_shingles", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def linked(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node, label of all nodes (smallest doc_ids of classes) that have links."""
    spark = docs.sparkSession
    exploded = classes.select(F.explode("bands").alias("key"), "node", F.col("n_shingles").alias("n"))
    shared = cut(exploded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key"))
    buckets = cut(exploded.join(shared, "key"))
    drop(spark, shared)
    wanted = buckets.select(F.col("node").alias("doc_id")).distinct()
    texts = cut(docs.where("doc_id is not null").select("doc_id", "text").join(wanted, "doc_id").select(F.col("doc_id").alias("node"), "text").where("text is not null"))
    links, labels, idle = None, None, 0
    for k in range(ROUNDS):
        members = cut(_mixed(buckets, labels))
        pairs = _to_centres(members, k)
        new = cut(confirmed(pairs, texts))
        drop(spark, members)
        found = new.limit(1).count()
        idle = 0 if found else idle + 1
        if found or links is None:
            links = new if links is None else cut(links.unionByName(new))
            drop(spark, *([labels] if labels is not None else []))
            labels = connected(links)
        tidy(spark)
        if idle == 2:
            break
    # what buckets hold of different components: an exact join of all of it
    members = cut(_mixed(buckets, labels))
    drop(spark, buckets)
    left = cut(texts.join(members.select("node", "label").distinct(), "node"))
    drop(spark, members)
    new = cut(confirmed(prefix_pairs(left), texts))
    if new.limit(1).count():
        old, labels = labels, connected(links.unionByName(new))
        drop(spark, old)
    drop(spark, left, texts)
    return labels


def rarity(texts: DataFrame) -> np.ndarray:
    """How often shingles of each slot occur: a table of fixed size, only used to order shingles."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                np.add.at(total, (shingles(t) & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    rows = texts.select("text").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(SLOTS, np.int64)
    for r in rows:
        found[r.slot] = r.n
    return found


def prefix_pairs(texts: DataFrame) -> DataFrame:
    """a, b: all pairs of different labels that may be linked. texts: node, text, label.

    Two linked sets share at least need(n, m) = SHARE / (100 + SHARE) * (n + m) shingles, so in any common
    order of shingles they share one among the first n - need(n, smallest partner) + 1 of each; and at the
    first that they share, enough must be left on both sides. Rare shingles come first, so that the members
    of a family of near copies meet only if their own edits leave room for a link.
    """
    spark = texts.sparkSession
    order = spark.sparkContext.broadcast(rarity(texts))

    def run(batches):
        count = order.value
        for b in batches:
            cols = [[] for _ in range(5)]
            for node, label, t in zip(b.column("node").to_pylist(), b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = shingles(t)
                n = len(s)
                s = s[np.lexsort((s, count[(s & np.uint64(SLOTS - 1)).astype(np.int64)]))]
                k = n - -(-SHARE * n // 100) + 1  # the smallest partner has SHARE percent of n, all of it shared
                for c, x in zip(cols, (as_long(s[:k]), np.full(k, node), np.full(k, label), np.full(k, n, np.int64), np.arange(k, dtype=np.int32)), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["key", "node", "label", "n", "at"])

    rows = cut(texts.select("node", "label", "text").mapInArrow(run, "key bigint, node bigint, label bigint, n bigint, at int"))
    keys = cut(rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"))
    some = cut(rows.join(keys, "key"))
    drop(spark, rows, keys)
    x, y = (some.select("key", *[F.col(c).alias(f"{c}_{p}") for c in ("node", "label", "n", "at")]) for p in "ab")
    enough = f"{100 + SHARE} * least(n_a - at_a, n_b - at_b) >= {SHARE} * (n_a + n_b)"
    return x.join(y, "key").where(f"node_a < node_b and label_a <> label_b and {enough}").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _mixed(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of the buckets that still hold several components, with their labels."""
    if labels is None:
        return buckets.withColumn("label", F.col("node"))
    named = cut(buckets.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label")))
    keys = cut(named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"))
    return named.join(keys, "key")


def _to_centres(members: DataFrame, k: int) -> DataFrame:
    """a, b: each member with the centre that it shares most buckets with, if sizes allow a link.

    Each bucket has one centre, by another order in each round; so a round has at most a pair for each member.
    """
    order = F.col("node") if k == 0 else F.xxhash64("node", F.lit(k))
    centre = cut(members.groupBy("key").agg(F.min_by(F.struct("node", "n", "label"), order).alias("c")).select("key", F.col("c.node").alias("a"), F.col("c.n").alias("na"), F.col("c.label").alias("la")))
    met = members.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb")).join(centre, "key").where("la <> lb")
    shared = near(met).groupBy("a", "b").agg(F.count("*").alias("c"))
    return shared.groupBy("b").agg(F.max_by("a", F.struct(F.col("c"), -F.col("a"))).alias("a")).select("a", "b")
