"""Connected components: the rounds, and the task that ends them, against a plain search."""

import random

import numpy as np

from kiln.llm import components as C


def plain(edges):
    beside = {}
    for a, b in edges:
        if a is not None and b is not None:
            beside.setdefault(a, set()).add(b)
            beside.setdefault(b, set()).add(a)
    found = {}
    for start in sorted(beside):
        stack = [start]
        while stack:
            x = stack.pop()
            if found.setdefault(x, start) == start:
                stack += [y for y in beside[x] if y not in found]
    return found


def graph(seed):
    rng = random.Random(seed)
    path = list(range(100, 140))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(900, k) for k in range(500, 530)] + [(-(1 << 62) - 5, 7), (7, 8), (8, 7), (8, 7)]
    edges += [(rng.randrange(2000, 2060), rng.randrange(2000, 2060)) for _ in range(40)]
    return edges + [(9, 9), (None, 1), (2, None), (None, None), (1 << 61, (1 << 61) + 1)]


def test_smallest_reachable_equals_a_plain_search():
    for seed in range(30):
        edges = [e for e in graph(seed) if None not in e]
        node, low = C.smallest_reachable(*(np.array(c, np.int64) for c in zip(*edges)))
        assert dict(zip(node.tolist(), low.tolist())) == plain(edges)


def test_rounds_and_the_last_task_agree(spark):
    for seed, local in ((1, C.LOCAL), (2, 0), (3, 100)):  # one task, rounds only, rounds and then a task
        edges = graph(seed)
        rows = C.components(spark.createDataFrame(edges, "a long, b long"), local=local).collect()
        assert {r["node"]: r["component"] for r in rows} == plain(edges) and len(rows) == len(plain(edges))
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_graph_that_fits_a_task_needs_no_rounds(spark, monkeypatch):
    written, staged = [], C.staged
    monkeypatch.setattr(C, "staged", lambda df, name: written.append(name) or staged(df, name))
    path = [(k, k + 1) for k in range(300)]
    assert {r["component"] for r in C.components(spark.createDataFrame(path, "a long, b long")).collect()} == {0}
    assert len(written) == 2  # the edges and their stars
