"""Operator 9: approximate nearest neighbours by NN-descent.

Every row is indexed. Equal vectors are one node, so that any number of copies stays one place in the graph
and its members come back when results are written (the smallest ids of a node are enough: more than TOP + 1
never fit into a result). The first graph joins neighbours in blocks along an order of the vectors by their
nearest pivots; then each iteration joins, at every node, its neighbours with one another (the neighbours of
neighbours) and keeps each node's K nearest, until an iteration changes less than DONE of all links. Two neighbours
that both were there an iteration before have met by then, and don't meet again. Nodes with many
incoming links are dealt into groups by a salt: every link takes part, and neighbours of such a node meet within
their group (those of different groups only by way of other nodes). A query walks the graph greedily: it starts at
its own node and at the entry points nearest to it, expands the nodes of its beam that are not expanded, and ends
when none is left, however many hops that takes. Distances that are returned are computed on the original vectors
in double precision; those that only build the graph are in single precision.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those of another
length than the most frequent one, take no part; rows with a null vec_id take no part; repeated ids are rows
of their own, but never candidates of the query with their id; a repeated id with several vectors is one query, by
the smallest of them; where there are no more vectors than entry points, a query meets all of them; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, drop, ready, tidy

TOP, K, BEAM = 10, 32, 160
#: NN-descent ends when an iteration changes less than this share of all links.
DONE = 0.002
#: Rows of a block of the first graph; pivots and entry points (bounded samples); members of a local join.
BLOCK, PIVOTS, ENTRIES, GROUP, STARTS = 160, 256, 512, 160, 4


def matrix(column: pa.Array, dim: int, kind: type = np.float32) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dim)


def kind_of(rows: DataFrame, column: str) -> str:
    """SQL type of vectors in a column."""
    return dict(rows.dtypes)[column]


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.maximum(d, 0)


def valid(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and v (floats as they are, other numbers as doubles) of the rows that take part, and their length."""
    v = F.col("embedding")
    kind = "float" if kind_of(vectors, "embedding") == "array<float>" else "double"
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    rows = rows.where(F.exists(v, lambda x: x != 0)).select("vec_id", F.transform(v, lambda x: x.cast(kind) + F.lit(0.0).cast(kind)).alias("v"))
    best = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    dim = best.n if best else 1
    return rows.where(F.size("v") == dim), dim


def nearest_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest neighbours of each node, each once; fresh, if all rows of a pair are."""
    once = pairs.groupBy("node", "nbr").agg(F.min("d").alias("d"), F.bool_and("fresh").alias("fresh"))
    order = W.partitionBy("node").orderBy("d", "nbr")
    return once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def first_graph(nodes: DataFrame, dim: int, seed: int) -> DataFrame:
    """node, nbr, d: neighbours within blocks of an order by nearest pivot and distance to it."""
    sample = nodes.orderBy(F.xxhash64("node", F.lit(seed))).limit(PIVOTS).select("v").collect()
    pivots = np.array([r.v for r in sample], np.float32).reshape(-1, dim)

    def place(batches):
        for b in batches:
            d = squares(matrix(b.column("v"), dim), pivots)
            best = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32)), pa.array(d[np.arange(len(best)), best].astype(np.float64))], names=["node", "v", "pivot", "near"])

    def block(ids, x):
        d = squares(x, x)
        np.fill_diagonal(d, np.inf)
        k = min(K, len(ids) - 1)
        if k < 1:
            return None
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(ids[near].ravel()), pa.array(np.take_along_axis(d, near, 1).ravel().astype(np.float64))], names=["node", "nbr", "d"])

    def join(batches):
        ids, x = np.empty(0, np.int64), np.empty((0, dim), np.float32)
        for b in batches:
            ids = np.concatenate([ids, b.column("node").to_numpy()])
            x = np.concatenate([x, matrix(b.column("v"), dim)])
            while len(ids) >= 2 * BLOCK:
                yield block(ids[:BLOCK], x[:BLOCK])
                ids, x = ids[BLOCK:], x[BLOCK:]
        out = block(ids, x) if len(ids) else None
        if out is not None:
            yield out

    spark = nodes.sparkSession
    placed = cut(nodes.select("node", "v").mapInArrow(place, f"node bigint, v {kind_of(nodes, 'v')}, pivot int, near double"))
    # a partition holds blocks, whatever the number of shuffle partitions
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), placed.count() // (4 * BLOCK)))
    return placed.repartitionByRange(parts, "pivot", "near").sortWithinPartitions("pivot", "near").select("node", "v").mapInArrow(join, "node bigint, nbr bigint, d double")


def improved(graph: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """node, nbr, d: pairs of neighbours of a common node that are nearer than the farthest the node has, each once.

    Pairs of links that aren't fresh have met before, but in nodes of several groups, as those may be dealt anew.
    Of one group a node gets its K nearest: no others can be among the K that it keeps.
    """
    links = graph.select(F.col("node").alias("at"), F.col("nbr").alias("u"), "fresh").unionByName(graph.select(F.col("nbr").alias("at"), F.col("node").alias("u"), "fresh"))
    links = cut(links.groupBy("at", "u").agg(F.bool_and("fresh").alias("fresh")))
    degree = cut(links.groupBy("at").agg(F.ceil(F.count("*") / GROUP).alias("groups"), F.bool_or("fresh").alias("any")).where("any or groups > 1").drop("any"))
    worst = graph.groupBy("node").agg(F.max("d").alias("worst"), F.count("*").alias("have"))
    known = cut(nodes.join(worst, "node", "left").select(F.col("node").alias("u"), "v", F.when(F.col("have") >= K, F.col("worst")).otherwise(F.lit(float("inf"))).alias("worst")))
    dealt = links.join(degree, "at").select("at", F.pmod(F.xxhash64("u"), F.col("groups")).alias("salt"), "u", (F.col("fresh") | (F.col("groups") > 1)).alias("fresh"))
    full = dealt.join(known, "u").select("at", "salt", "u", "v", "worst", "fresh")

    def local(batches):
        keep = None
        for b in batches:
            at, salt = b.column("at").to_numpy(), b.column("salt").to_numpy()
            u, w, x, new = b.column("u").to_numpy(), b.column("worst").to_numpy(), matrix(b.column("v"), dim), b.column("fresh").to_numpy(zero_copy_only=False)
            if keep is not None:
                at, salt, u, w, x, new = (np.concatenate([p, q]) for p, q in zip(keep, (at, salt, u, w, x, new), strict=True))
            edges = np.flatnonzero((at[1:] != at[:-1]) | (salt[1:] != salt[:-1])) + 1
            last = int(edges[-1]) if len(edges) else 0
            yield from joined(np.concatenate([[0], edges]) if last else np.zeros(1, int), u, w, x, new)
            keep = tuple(a[last:] for a in (at, salt, u, w, x, new))
        if keep is not None and len(keep[0]):
            yield from joined(np.array([0, len(keep[0])]), *keep[2:])

    def joined(edges, u, w, x, new):
        one, two, dist = [], [], []
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            d = squares(x[i:j], x[i:j])
            np.fill_diagonal(d, np.inf)
            old = np.flatnonzero(~new[i:j])
            d[np.ix_(old, old)] = np.inf
            near = d < w[i:j, None]
            if j - i > K:
                near &= d <= np.partition(d, K - 1, axis=1)[:, K - 1 : K]
            p, q = np.nonzero(near)
            one.append(u[i:j][p])
            two.append(u[i:j][q])
            dist.append(d[p, q])
        if one:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(two)), pa.array(np.concatenate(dist).astype(np.float64))], names=["node", "nbr", "d"])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = full.repartition(parts, "at", "salt").sortWithinPartitions("at", "salt").mapInArrow(local, "node bigint, nbr bigint, d double")
    out = cut(out.groupBy("node", "nbr").agg(F.min("d").alias("d")))
    drop(nodes.sparkSession, links, degree, known)
    return out


def graph_of(nodes: DataFrame, dim: int) -> DataFrame:
    """node, nbr, d (squared), fresh: the K nearest of each node that NN-descent finds."""
    spark = nodes.sparkSession
    graph = cut(nearest_k(first_graph(nodes, dim, 1).unionByName(first_graph(nodes, dim, 2)).withColumn("fresh", F.lit(True)), K))
    size = nodes.count()
    while True:
        new = improved(graph, nodes, dim)
        better = new.join(graph.select("node", "nbr"), ["node", "nbr"], "left_anti")
        changes = better.count()
        merged = cut(nearest_k(graph.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True))), K))
        drop(spark, graph, new)
        tidy(spark)
        graph = merged
        if changes <= DONE * K * size:
            return graph


def distances(pairs: DataFrame, nodes: DataFrame, queries: DataFrame, dim: int) -> DataFrame:
    """query, node, d (squared, double) of pairs (query, node). queries: query, q."""

    def run(batches):
        for b in batches:
            d = matrix(b.column("q"), dim, np.float64) - matrix(b.column("v"), dim, np.float64)
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("node"), pa.array((d * d).sum(1))], names=["query", "node", "d"])

    return pairs.join(nodes, "node").join(queries, "query").select("query", "node", "q", "v").mapInArrow(run, "query bigint, node bigint, d double")


def best(rows: DataFrame, n: int) -> DataFrame:
    order = W.partitionBy("query").orderBy("d", "node")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def walk(nodes: DataFrame, graph: DataFrame, queries: DataFrame, dim: int) -> DataFrame:
    """query, node, d (squared): the beam of each query when nothing in it is left to expand. queries: query, q, own."""
    spark = nodes.sparkSession
    sample = nodes.orderBy(F.xxhash64("node", F.lit(9))).limit(ENTRIES).collect()
    at, ids = np.array([r.v for r in sample], np.float32).reshape(-1, dim), np.array([r.node for r in sample], np.int64)

    def enter(batches):
        k = min(STARTS, len(ids)) if len(ids) == ENTRIES else len(ids)  # fewer: the sample is all there is
        for b in batches:
            d = squares(matrix(b.column("q"), dim), at)
            near = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(d), 0), int)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("query").to_numpy(), k)), pa.array(ids[near].ravel())], names=["query", "node"])

    starts = queries.select("query", "q").mapInArrow(enter, "query bigint, node bigint").unionByName(queries.select("query", F.col("own").alias("node"))).distinct()
    q = queries.select("query", "q")
    links = cut(graph.select("node", "nbr").unionByName(graph.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))).distinct())
    beam = cut(distances(starts, nodes, q, dim).withColumn("done", F.lit(False)))
    while True:
        open_ = beam.where("not done")
        if not open_.limit(1).count():
            break
        seen = beam.select("query", "node")
        # nodes that fell out of the beam may be met again; they fall out again
        new = open_.join(links, "node").select("query", F.col("nbr").alias("node")).distinct().join(seen, ["query", "node"], "left_anti")
        found = distances(new, nodes, q, dim).withColumn("done", F.lit(False))
        after = cut(best(beam.withColumn("done", F.lit(True)).unionByName(found), BEAM))
        drop(spark, beam)
        beam = after
    drop(spark, links)
    return beam.drop("done")


def search(vectors: DataFrame, is_query, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the top nearest of each query found, by distance, then vec_id."""
    spark = vectors.sparkSession
    ready(spark, 4000)
    rows, dim = valid(vectors)
    rows = cut(rows)
    classes = cut(rows.groupBy("v").agg(F.min("vec_id").alias("node")))
    # two vectors of one id: nodes are told apart by the vector
    ids = cut(classes.select("v", F.row_number().over(W.partitionBy("node").orderBy(F.hash("v"), "v")).alias("k"), "node").where("k = 1").select("node", "v"))
    extra = classes.join(ids.select("v"), "v", "left_anti")
    if extra.limit(1).count():
        ids = cut(ids.unionByName(extra.select((-F.abs(F.xxhash64("v"))).alias("node"), "v")))
    graph = graph_of(ids, dim)
    named = rows.join(ids, "v").select("vec_id", "node", "v")
    order = W.partitionBy("node").orderBy("vec_id")
    members = cut(named.select("node", "vec_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1).drop("r"))
    queries = cut(named.where(is_query).select(F.col("vec_id").alias("query"), F.col("node").alias("own"), F.col("v").alias("q")).groupBy("query").agg(F.min(F.struct("q", "own")).alias("s")).select("query", "s.own", "s.q"))
    beam = walk(ids, graph, queries, dim)
    drop(spark, graph)
    near = beam.join(members, "node").where("vec_id <> query")
    order = W.partitionBy("query").orderBy("d", "vec_id")
    out = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("d").alias("score"))
