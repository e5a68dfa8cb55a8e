"""Connected components of a graph held in DataFrames, and forests within one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintable.session import durable

#: Edges up to which a graph is one task's work: its rounds would cost more in shuffles than they spread.
SMALL_GRAPH = 10_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node of its component: one less than nodes for each.

    Tasks that see parts of one large component mostly agree on its smallest node, so their edges are the same ones.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    return np.array(nodes, np.int64), np.array([root(x) for x in nodes], np.int64)


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    whole = pd.concat(list(batches))
    node, root = stars(whole["a"].to_numpy(), whole["b"].to_numpy())
    yield pd.DataFrame({"a": node, "b": root})


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of an edge with the smallest node of its component.

    ``edges`` has two long columns a, b. Rounds of large-star and small-star: each links nodes to the
    smallest neighbour by partial minima and a join, so a node with very many edges is no group in one
    task. Each round is checkpointed; the number of rounds grows with the logarithm of the nodes. A graph
    of up to ``SMALL_GRAPH`` edges takes no rounds.
    """
    a, b = F.col("a"), F.col("b")
    links = durable(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                    .filter("a <> b").distinct())
    before = None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        if state["n"] <= SMALL_GRAPH:
            links = links.coalesce(1).mapInPandas(_forest, "a long, b long")
            break
        before = state
        both = links.union(links.select(b, a))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (both.filter("b > a").join(least, F.col("a") == F.col("u"))
                 .select(b.alias("a"), F.col("m").alias("b")).union(
                     least.filter("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = (large.join(low, F.col("a") == F.col("u")).filter("b <> m")
                 .select(b.alias("a"), F.col("m").alias("b"))
                 .union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        links = durable(small)
    roots = links.select(b.alias("node"), b.alias("root")).distinct()
    return links.select(a.alias("node"), b.alias("root")).union(roots)
