"""Connected components of a table of links: by joins, until the links that are left fit into one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: So many links are joined by one task, whose memory they bound; more are first contracted by joins.
ONE_TASK = 1 << 20


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b), ascending, and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        # roots hook to the smallest root next to them; as that is smaller, no cycles arise
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _in_one_task(links: DataFrame) -> DataFrame:
    """node, label of links (a, b), read by a single task."""

    def run(batches):
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for x in batches:
            a.append(x.column("a").to_numpy())
            b.append(x.column("b").to_numpy())
        node, label = smallest_reachable(np.concatenate(a), np.concatenate(b))
        for i in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + (1 << 16)]), pa.array(label[i : i + (1 << 16)])], names=["node", "label"])

    return links.coalesce(1).mapInArrow(run, "node bigint, label bigint")


def _flat(parent: DataFrame) -> DataFrame:
    """Follow parents to their roots; each pass halves the way. parent: node, label (label <= node, roots included)."""
    while True:
        up = parent.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = cut(parent.join(up, "label").select("node", F.col("root").alias("label"), (F.col("root") != F.col("label")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        drop(parent.sparkSession, parent)
        parent = new.select("node", "label")
        parent.folder = new.folder
        if not moved:
            return parent


def _renamed(labels: DataFrame, hooks: DataFrame) -> DataFrame:
    """node, label, with labels that hooks (node, label) has replaced."""
    up = hooks.select(F.col("node").alias("label"), F.col("label").alias("root"))
    return labels.join(up, "label", "left").select("node", F.coalesce("root", "label").alias("label"))


def connected(links: DataFrame) -> DataFrame:
    """node, label for every node of links (a, b): label is the smallest node that can be reached.

    Each round, every label hooks to the smallest label next to it, the forest is flattened, and links
    inside one label go; at least half of the labels that still have links vanish in a round. The last ONE_TASK
    links need no rounds of joins.
    """
    spark = links.sparkSession
    rest = cut(links.select("a", "b").where("a <> b").distinct())
    labels = None
    while n := rest.count():
        if n <= ONE_TASK:
            hooks = cut(_in_one_task(rest))
            drop(spark, rest)
            if labels is None:
                return hooks
            new = cut(_renamed(labels, hooks))
            drop(spark, labels, hooks)
            return new
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = _flat(cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))))
        if labels is None:
            new = hooks
        else:
            new = cut(_renamed(labels, hooks))
            drop(spark, labels)
        name = lambda c: hooks.select(F.col("node").alias(c), F.col("label").alias(f"{c}{c}"))
        left = cut(rest.join(name("a"), "a").join(name("b"), "b").select(F.col("aa").alias("a"), F.col("bb").alias("b")).where("a <> b").distinct())
        drop(spark, rest)
        if labels is not None:
            drop(spark, hooks)
        labels, rest = new, left
    drop(spark, rest)
    return labels if labels is not None else rest.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
