"""Connected components of an edge table, by alternating star operations until a task can end them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import staged, unstaged

#: Edges that one task holds at most: about 100 MB with its work.
LOCAL = 500_000


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges, and the smallest node that each one reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    parent = np.arange(len(nodes))
    while len(a):
        x, y = parent[a], parent[b]
        on = x != y
        a, b, x, y = a[on], b[on], x[on], y[on]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return nodes, nodes[parent]


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, v): each node but the smallest of its component, and that smallest one."""
    parts = [b for b in batches if len(b)]
    if parts:
        node, low = smallest_reachable(*(np.concatenate([p[c].to_numpy(np.int64) for p in parts]) for c in "uv"))
        yield pd.DataFrame({"u": node, "v": low})[node != low]


def _min_neighbour(e: DataFrame) -> DataFrame:
    """(u, m): the smallest of a node and its neighbours (map-side combined)."""
    return e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, max_rounds: int = 60, local: int = LOCAL) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its
    smallest node.

    Large-star joins a node's larger neighbours to its smallest one, small-star
    its smaller neighbours; both keep the components and shrink the graph to
    stars in O(log n) rounds.  Every round is a join and two aggregations over at
    most the edges there are, and is written to the shared folder.  Once no more than
    ``local`` edges are left, one task makes the stars and no round follows.  Self-loops,
    repeated and null edges are allowed; nodes only in self-loops keep themselves.
    """
    e = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).dropna()
    own = e.filter("u = v").select(F.col("u").alias("node"))
    e = staged(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
               "edges")

    def mark(x):
        r = x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    before = mark(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        if before[0] <= local:
            old, e = e, staged(e.coalesce(1).mapInPandas(_stars, "u long, v long"), "edges")
            unstaged(old)
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_min_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = _min_neighbour(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(
            low.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, staged(small, "edges")
        unstaged(old)
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return found.unionByName(roots).unionByName(own.select("node", F.col("node").alias("component"))) \
        .groupBy("node").agg(F.min("component").alias("component"))
