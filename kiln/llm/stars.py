"""Linked classes from shared keys, without forming the pairs of a group.

Documents that link share a key.  First every member of a key's group is compared
with the group's smallest member (its hub) only, one row a comparison; what links there falls
into components, and most groups are done.  The other members of all groups of one hub
are a pool; where they hold several components they are dealt by set size into blocks of
bounded size; in a task that holds one block, the members outside a pool's largest
component are compared with all members of the block, and only links leave it.
Each pair that shares a key is thus either compared or known to be in one component.
Pools are not joined further by the members they have in common: those would chain
most groups of a large table to one, whose blocks grow with its square.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import staged, unstaged
from kiln.llm.components import components

#: Set elements of the members, and of the compared ones, that one block holds.
BLOCK = 1_000_000


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _mixed(grouped: DataFrame, found: DataFrame) -> DataFrame:
    """Members (pool, node, n, c, outside) of the pools that hold several components, a
    pool named by its hub, which is none of them: the member's component, and whether it
    is not the pool's largest."""
    member = grouped.filter("node <> hub").select(F.col("hub").alias("pool"), "node", "n").distinct().join(
        found.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select(
        "pool", "node", "n", F.coalesce("component", "node").alias("c"))
    parts = member.groupBy("pool", "c").agg(F.count("*").alias("k"))
    top = parts.groupBy("pool").agg(F.max_by("c", F.struct("k", "c")).alias("top"), F.count("*").alias("parts")).filter(
        "parts > 1").drop("parts")
    return member.join(top, "pool").withColumn("outside", F.col("c") != F.col("top")).drop("top")


def _cells(mixed: DataFrame, percent: int, block: int) -> DataFrame:
    """(pool, band, x, y, node, c, probe): the members of pools by band of set sizes, and
    those to be compared in their own band and the two beside it, as linked sets are
    never further apart; members in blocks x, compared ones in blocks y, every one
    with every other of the same pool and band.  Bands of one component are left out."""
    width = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    rows = mixed.withColumn("band", F.floor(F.log("n") / width))
    near = F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)
    sent = rows.filter("outside").withColumn("band", F.explode(near))
    role = lambda df, probe: df.select("pool", "band", "n", "c", F.lit(probe).alias("probe"))
    blocks = lambda of, name: F.ceil(F.sum(F.when(of, F.col("n"))) / block).cast("int").alias(name)
    size = role(rows, False).unionByName(role(sent, True)).groupBy("pool", "band").agg(
        blocks(~F.col("probe"), "xs"), blocks(F.col("probe"), "ys"), F.min("c").alias("low"), F.max("c").alias("high")).filter(
        "xs > 0 and ys > 0 and low < high").drop("low", "high")
    number = F.xxhash64("node")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.join(size, ["pool", "band"]).select(
        "pool", "band", F.pmod(number, F.col("xs")).cast("int").alias("x"), every("ys").alias("y"), "node", "c",
        F.lit(False).alias("probe"))
    probes = sent.join(size, ["pool", "band"]).select(
        "pool", "band", every("xs").alias("x"), F.pmod(number, F.col("ys")).cast("int").alias("y"), "node", "c",
        F.lit(True).alias("probe"))
    return members.unionByName(probes)


CELL = ["pool", "band", "x", "y"]


def in_cells(rows: DataFrame, compare: Callable[[list, list], list[tuple[int, int]]]) -> DataFrame:
    """Links (a, b) that ``compare(members, probes)`` finds in each cell of ``rows`` (pool, band,
    x, y, node, c, probe, s): both are lists of (node, component, set bytes)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, members, probes = None, [], []

        def links():
            return pd.DataFrame(compare(members, probes), columns=["a", "b"])

        for b in batches:
            for *cell, node, c, probe, s in zip(*(b[k] for k in (*CELL, "node", "c", "probe", "s"))):
                if cell != key:
                    if members and probes:
                        yield links()
                    key, members, probes = cell, [], []
                (probes if probe else members).append((node, c, s))
        if members and probes:
            yield links()
    return rows.repartition(*CELL).sortWithinPartitions(*CELL).mapInPandas(run, "a long, b long")


def linked_components(keys: DataFrame, percent: int, links: Callable[[DataFrame, list[DataFrame]], DataFrame],
                      cell_links: Callable[[DataFrame, list[DataFrame]], DataFrame], block: int = BLOCK) -> DataFrame:
    """(node, component) of the linked nodes, written.

    ``keys`` is a written table (key, node, n) with the set size of each node.
    ``links(pairs, made)`` keeps of pairs (a, b) those that link, ``cell_links(cells,
    made)`` gives the links of cells (pool, band, x, y, node, c, probe); both list the tables
    that they wrote in ``made``.
    """
    def written(step, rows):
        made = []
        out = staged(step(rows, made), "links")
        for t in made:
            unstaged(t)
        return out

    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("k")).filter("k > 1").drop("k")
    grouped = staged(keys.join(hubs, "key"), "grouped")
    sizes = grouped.filter("node = hub").select("key", F.col("n").alias("hub_n")).distinct()
    pairs = staged(grouped.filter("node <> hub").join(sizes, "key").filter(
        sizes_fit(F.col("n"), F.col("hub_n"), percent)).select(F.col("node").alias("a"), F.col("hub").alias("b"))
        .distinct(), "pairs")
    first = written(links, pairs)
    found = staged(components(first), "components")
    mixed = staged(_mixed(grouped, found), "mixed")
    unstaged(grouped)
    cells = staged(_cells(mixed, percent, block), "cells")
    second = written(cell_links, cells)
    out = staged(components(first.unionByName(second)), "components")
    for t in (pairs, first, found, mixed, cells, second):
        unstaged(t)
    return out
