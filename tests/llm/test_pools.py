"""What shares keys is compared once, in blocks that follow the rows; shuffle files go with the query that made them."""

import random
import time
from itertools import combinations

import pytest

from kiln.llm.common import staged, unstaged
from kiln.llm.stars import linked_components


def compared(spark, groups, linked=(), percent=90, block=1000, size=lambda node: 100):
    """The cell rows of the groups (lists of nodes) and the pairs that meet, with the links ``linked`` of the first step."""
    keys = spark.createDataFrame([(k, x, size(x)) for k, g in enumerate(groups) for x in g], "key long, node long, n long")
    seen = []

    def links(pairs, made):
        return spark.createDataFrame(list(linked), "a long, b long")

    def cell_links(cells, made):
        seen.extend(cells.collect())
        return spark.createDataFrame([], "a long, b long")

    unstaged(linked_components(staged(keys, "keys"), percent, links, cell_links, block))
    members, met = {}, {frozenset((x, min(g))) for g in groups for x in g}
    for r in seen:
        if not r["probe"]:
            members.setdefault((r["pool"], r["band"], r["x"], r["y"]), []).append(r["node"])
    for r in seen:
        if r["probe"]:
            met |= {frozenset((r["node"], m)) for m in members.get((r["pool"], r["band"], r["x"], r["y"]), [])}
    return seen, met


def test_groups_in_a_chain_are_no_pool(spark):
    groups = [list(range(k, k + 4)) for k in range(300)]
    cells, met = compared(spark, groups)
    assert len(cells) <= 6 * len(groups)  # one pool of all would have 300 / 10 blocks for each member
    assert {frozenset(p) for g in groups for p in combinations(g, 2)} <= met


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_pair_of_a_group_is_compared_or_in_one_component(spark, seed):
    rng = random.Random(seed)
    groups = [rng.sample(range(80), rng.randint(2, 12)) for _ in range(40)]
    sizes = [rng.randint(60, 100) for _ in range(80)]
    linked = [(max(p), min(p)) for p in (rng.sample(g, 2) for g in groups[:20])]
    component = {}
    for a, b in linked:
        x, y = component.get(a, a), component.get(b, b)
        component |= {k: min(x, y) for k in [a, b, *(k for k, c in component.items() if c in (x, y))]}
    _, met = compared(spark, groups, linked, block=300, size=sizes.__getitem__)
    for g in groups:
        for a, b in combinations(g, 2):
            fit = 100 * min(sizes[a], sizes[b]) >= 90 * max(sizes[a], sizes[b])
            assert not fit or component.get(a, a) == component.get(b, b) or frozenset((a, b)) in met


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        out = set()
        while found.hasNext():
            out.add(found.next().getName())
        return {f for f in out if f.startswith("shuffle_")}

    before = files()
    out = staged(spark.range(20_000).withColumnRenamed("id", "x").repartition(5, "x").groupBy("x").count(), "counts")
    until = time.time() + 5
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and out.count() == 20_000
    unstaged(out)
