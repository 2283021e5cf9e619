"""A prefix tree of sorted sets, held in arrays by layer, that many sets traverse at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Most elements of one edge: the bounds are looked at after so many.
STRIDE = 32
#: Most element look-ups of one step over a layer, and numbers of the membership table.
LOOKUPS, TABLE = 8_000_000, 32_000_000


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    m = min(len(a), len(b))
    differ = a[:m] != b[:m]
    at = int(differ.argmax()) if m else 0
    return at if m and differ[at] else m


class Layer:
    """Nodes of one layer.  ``run``: begin and end of the node's elements in ``elements``;
    ``depth``: length of the path to its end; ``low``, ``high``: smallest and largest
    set below; ``one``: the component of all sets below, or ``mixed`` of them;
    ``ends``: the set that ends here or -1; ``kids``: begin and end in the next layer."""

    def __init__(self, nodes: list[tuple]):
        run0, run1, depth, low, high, one, mixed, ends, kid0, kid1 = (np.array(c) for c in zip(*nodes))
        self.run0, self.run1, self.depth, self.low, self.high = run0, run1, depth, low, high
        self.one, self.mixed, self.ends, self.kid0, self.kid1 = one, mixed, ends, kid0, kid1


class PrefixTree:
    """Sets (sorted arrays of 64-bit numbers, none empty, one global order: the order of
    the numbers) with a component each."""

    def __init__(self, sets: list[np.ndarray], components: list[int]):
        key = [(s.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=key.__getitem__)
        sets = [sets[k] for k in self.order]
        self.component = np.array([components[k] for k in self.order], np.int64)
        sizes = np.array([len(s) for s in sets])
        begin = np.append(0, np.cumsum(sizes))
        self.values, self.elements = np.unique(np.concatenate(sets), return_inverse=True)
        common = np.array([_common(a, b) for a, b in zip(sets, sets[1:])], np.int64)
        self.layers: list[Layer] = []
        items = list(self._parts(0, len(sets), 0, common))
        while items:
            nodes, below = [], []
            for lo, hi, depth in items:
                shared = int(sizes[lo]) if hi - lo == 1 else int(common[lo:hi - 1].min())
                end, done = min(shared, depth + STRIDE), -1
                kid0 = len(below)
                if end < shared:
                    below.append((lo, hi, end))
                else:
                    at = lo
                    if sizes[lo] == shared:  # the shortest set of a path comes first
                        done, at = lo, lo + 1
                    if at < hi:
                        below.extend(self._parts(at, hi, shared, common))
                own = self.component[lo:hi]
                nodes.append((begin[lo] + depth, begin[lo] + end, end, sizes[lo:hi].min(), sizes[lo:hi].max(), own[0],
                              bool((own != own[0]).any()), done, kid0, len(below)))
            self.layers.append(Layer(nodes))
            items = below

    @staticmethod
    def _parts(lo: int, hi: int, depth: int, common: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The sets lo to hi, equal up to ``depth``, by their next element."""
        cuts = (np.flatnonzero(common[lo:hi - 1] <= depth) + lo + 1).tolist()
        for a, b in zip([lo, *cuts], [*cuts, hi]):
            yield a, b, depth

    def links(self, sets: list[np.ndarray], components: list[int], percent: int) -> Iterator[tuple[int, int]]:
        """(traversing set, stored set) pairs with 100 * intersection >= percent * union and
        different components, as places in the lists given."""
        width = max(1, len(self.layers[0].depth)) * STRIDE
        step = max(1, min(64, TABLE // len(self.values), LOOKUPS // width))
        for lo in range(0, len(sets), step):
            yield from self._traverse(lo, sets[lo:lo + step], np.array(components[lo:lo + step], np.int64), percent)

    def _traverse(self, first: int, sets, component, percent):
        size, n = np.array([len(s) for s in sets]), len(self.values)
        place = [np.searchsorted(self.values, s) for s in sets]
        mine = np.zeros((len(sets), n), bool)
        for k, (s, at) in enumerate(zip(sets, place)):
            at = at[self.values[np.minimum(at, n - 1)] == s]
            mine[k, at] = True
        mine = mine.ravel()
        passed_at = np.concatenate([k * (n + 1) + at for k, at in enumerate(place)])
        begin = np.append(0, np.cumsum(size))
        who = np.repeat(np.arange(len(sets)), len(self.layers[0].depth))
        node = np.tile(np.arange(len(self.layers[0].depth)), len(sets))
        both = np.zeros(len(who), np.int64)
        for layer in self.layers:
            if not len(who):
                return
            on = layer.mixed[node] | (layer.one[node] != component[who])
            who, node, both = who[on], node[on], both[on]
            if not len(who):
                return
            run0, run1 = layer.run0[node], layer.run1[node]
            cut = np.append(0, np.cumsum(run1 - run0))
            at = np.arange(cut[-1]) + np.repeat(run0 - cut[:-1], run1 - run0)
            hit = mine[np.repeat(who * n, run1 - run0) + self.elements[at]]
            both = both + np.add.reduceat(hit, cut[:-1], dtype=np.int64)
            depth, low, high, own = layer.depth[node], layer.low[node], layer.high[node], size[who]
            passed = np.searchsorted(passed_at, who * (n + 1) + self.elements[run1 - 1], "right") - begin[who]
            # what the set has passed without meeting it, and what the path has beside it, never comes back
            most = both + np.minimum(own - passed, high - depth)
            other = np.maximum(depth - both + most, low)
            on = 100 * most >= percent * (own + other - most)
            who, node, both, depth, own = who[on], node[on], both[on], depth[on], own[on]
            ends = layer.ends[node]
            hit = (ends >= 0) & (100 * both >= percent * (own + depth - both)) & (self.component[ends] != component[who])
            for x, y in zip(who[hit].tolist(), ends[hit].tolist()):
                yield first + x, self.order[y]
            kids = layer.kid1[node] - layer.kid0[node]
            cut = np.append(0, np.cumsum(kids))
            node = np.arange(cut[-1]) + np.repeat(layer.kid0[node] - cut[:-1], kids)
            who, both = np.repeat(who, kids), np.repeat(both, kids)
