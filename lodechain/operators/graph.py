"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodechain.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(k, root): the smallest node that each node of ``edges`` (a, b) reaches; minimum labels with pointer jumping,
    every round written to the shared folder."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("a"), F.min("b")).alias("root"))
    while True:
        labels = cut(labels)
        near = both.join(labels.select(F.col("k").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("k")).agg(F.min("r").alias("r"))
        lower = labels.join(near, "k").select("k", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        up = labels.select(F.col("k").alias("root"), F.col("root").alias("above"))
        new = cut(lower.join(up, "root", "left").select("k", "old", F.least("root", F.coalesce("above", "root")).alias("root")))
        labels = new.select("k", "root")
        if not new.where("root <> old").limit(1).count():
            return labels


def bounded_walk(edges: DataFrame, starts: DataFrame, up: int = 2, down: int = 3) -> DataFrame:
    """(start, node) reachable by at most ``up`` steps from child to parent or ``down`` steps from parent to child, the
    start included. Nodes met upwards are not expanded downwards. ``edges``: (parent, child); ``starts``: (start)."""
    seen = level = starts.select("start", F.col("start").alias("node"))
    for here, there, hops in (("child", "parent", up), ("parent", "child", down)):
        level = starts.select("start", F.col("start").alias("node"))
        for _ in range(hops):
            step = level.join(edges, F.col("node") == F.col(here)).select("start", F.col(there).alias("node")).distinct()
            level = step.join(seen, ["start", "node"], "left_anti")
            seen = seen.union(level)
    return seen


def one_hop(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """Marked nodes, their parents and their children, each once."""
    m = marked.select(F.col("node"))
    parents = edges.join(m, F.col("child") == F.col("node"), "left_semi").select(F.col("parent").alias("node"))
    children = edges.join(m, F.col("parent") == F.col("node"), "left_semi").select(F.col("child").alias("node"))
    return m.union(parents).union(children).distinct()


def tagged_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes of every weakly connected component that holds a seed (edges: a, b; seeds: node)."""
    labels = components(edges)
    roots = labels.join(seeds, F.col("k") == F.col("node"), "left_semi").select("root").distinct()
    return labels.join(roots, "root", "left_semi").select(F.col("k").alias("node"))


def label_communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(k, root): communities by synchronous label propagation; the most frequent neighbouring label wins, ties to the
    smallest. Stands in for modularity clustering, which needs a global sequential order."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b"))
    labels = both.select(F.col("a").alias("k")).distinct().withColumn("root", F.col("k"))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("k").alias("b"), "root"), "b").groupBy(F.col("a").alias("k"), "root").count()
        labels = cut(votes.groupBy("k").agg(F.min(F.struct(-F.col("count"), "root")).alias("v")).select("k", F.col("v.root").alias("root")))
    return labels
