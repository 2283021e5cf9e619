"""MinHash near-dedup with SetSketch registers.

Every element of a set sends exponentially distributed values to m registers; a
register keeps the minimum x as floor(1 - log_b x), truncated to 16 bits.  Sketches
of unions are the maxima of registers, and equal registers are as likely as the
sets are similar.  Groups of registers (bands) are the keys by which documents
meet; of a pair that meets, the numbers of larger, smaller and equal registers give
the likelihood of every similarity, and pairs that cannot well be over the threshold
go.  What is left is verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import staged, unstaged
from kiln.llm.shingles import classes, described, named_components, nodes, set_rows
from kiln.llm.stars import in_cells, linked_components

#: Registers and their bands: at a similarity of 0.8 a pair shares no band in about 1 of 8 million cases.
REGISTERS, BAND = 200, 5
#: Base of the registers' logarithm, rate of the values and largest register, for 16 bits.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: A pair goes if its registers are this much (in log-likelihood) likelier under the
#: threshold than over it: about six standard deviations.
SLACK = 18.0
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """Registers (sets x m, 16 bits) of sets of 64-bit hashes; of an empty set, zeros.

    The values of an element come in rising order: the points of a Poisson process
    of rate m * RATE, each to a random register, so that a register's first point is
    exponential with RATE.  An element is done once its next point lies beyond the
    largest register of its set, which leaves a few points per element.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    state = np.concatenate(sets).view(np.uint64) if len(owner) else np.zeros(0, np.uint64)
    value, least = np.zeros(len(owner)), np.full(n * m, np.inf)
    while len(owner):
        state = state + GOLDEN
        r = _mixed(state)
        value = value - np.log(((r >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0 ** -32) / (m * RATE)
        register = ((r & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
        np.minimum.at(least, owner * m + register.astype(np.int64), value)
        on = value < least.reshape(n, m).max(axis=1)[owner]
        owner, state, value = owner[on], state[on], value[on]
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(least) / np.log(BASE))
    return np.clip(k, 0, TOP).astype(np.uint16).reshape(n, m)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray, band: int = BAND) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    n, m = registers.shape
    bands = m // band
    parts = registers[:, :bands * band].reshape(n, bands, band).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)) * GOLDEN
    for k in range(band):
        h = _mixed(h ^ (parts[:, :, k] + np.uint64(1)) * GOLDEN)
    return h.view(np.int64)


def _first_larger(x):
    """Probability that one set's register is the larger, for x its share of the elements beyond the other."""
    return -np.log1p(-np.clip(x, 1e-9, 1.0) * (BASE - 1) / BASE) / np.log(BASE)


def likelihoods(larger, smaller, equal, na, nb, steps: int = 64):
    """(J, log-likelihood) of ``steps`` + 1 similarities from 0 to the largest that the
    set sizes allow, for each pair (rows)."""
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.minimum(na / nb, nb / na)[:, None] * np.linspace(0, 1, steps + 1)
    up, down = _first_larger(u - v * j), _first_larger(v - u * j)
    same = np.maximum(1 - up - down, 1e-9)
    return j, larger[:, None] * np.log(up) + smaller[:, None] * np.log(down) + equal[:, None] * np.log(same)


def possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches (rows of a and b) may come from sets over the threshold."""
    j, fit = likelihoods((a > b).sum(axis=1), (a < b).sum(axis=1), (a == b).sum(axis=1),
                         na.astype(np.float64), nb.astype(np.float64))
    over = np.where(100 * j >= percent - 1e-9, fit, -np.inf)
    # between two steps of the grid the likelihood at the threshold itself is close to the next step's
    return (100 * j[:, -1] >= percent - 1e-9) & (over.max(axis=1) >= fit.max(axis=1) - SLACK)


def _describe(sets: list[np.ndarray]):
    return [[r.tobytes() for r in sketches(sets)]]


def _band_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for lo in range(0, len(b), 2000):
            p = b.iloc[lo:lo + 2000]
            keys = band_keys(_registers(p["registers"]))
            each = keys.shape[1]
            yield pd.DataFrame({"key": keys.ravel(), "node": np.repeat(p["node"].to_numpy(), each),
                                "n": np.repeat(p["n"].to_numpy(), each)})


def _registers(column) -> np.ndarray:
    return np.stack([np.frombuffer(r, np.uint16) for r in column])


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Words are runs without white space, A-Z lower-cased; a set is the distinct n-word
    shingles, the whole sequence if there are fewer words.  Two documents link when
    100 * intersection >= percent * union, confirmed on the full sets; a component is
    named by its smallest id, and the document of that id is kept.  Null, empty or
    blank text: no shingles, linked with nothing, kept.  Rows that share an id are one
    document (see ``shingles.classes``).  A row without id gives a row, links by its
    set, and is kept only if its component has no id at all.  No rows: no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = staged(described(base, n, "registers binary", _describe), "sketches")
    members = staged(classes(rows), "classes")
    repeats = rows.count() > members.count()
    known = staged(nodes(members).join(rows.select("sig", "registers").dropDuplicates(["sig"]), "sig"), "nodes")
    unstaged(rows)
    keys = staged(known.select("node", "n", "registers").mapInPandas(_band_rows, "key long, node long, n long"), "keys")

    def sets_of(wanted: DataFrame, made: list[DataFrame]) -> DataFrame:
        sets = set_rows(base, wanted.distinct().join(known.select("node", "sig"), "node"), n, repeats)
        made.append(sets)
        return sets

    def links(pairs: DataFrame, made: list[DataFrame]) -> DataFrame:
        close = staged(_possible(pairs, known, percent), "close")
        made.append(close)
        return _over(close, sets_of(close.select(F.explode(F.array("a", "b")).alias("node")), made), percent)

    def cell_links(cells: DataFrame, made: list[DataFrame]) -> DataFrame:
        return in_cells(cells.join(sets_of(cells.select("node"), made), "node"),
                        lambda members, probes: linked_by_postings(members, probes, percent))

    found = linked_components(keys, percent, links, cell_links)
    out = staged(named_components(members, found), "named")
    for t in (members, known, keys, found):
        unstaged(t)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _ends(pairs: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the columns of both nodes, as a_... and b_..."""
    out = pairs
    for side in "ab":
        out = out.join(known.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return out


def _possible(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 1000):
                p = b.iloc[lo:lo + 1000]
                x, y = _registers(p["a_registers"]), _registers(p["b_registers"])
                yield p[possible(x, y, p["a_n"].to_numpy(), p["b_n"].to_numpy(), percent)][["a", "b"]]
    return _ends(pairs, known, ["n", "registers"]).mapInPandas(run, "a long, b long")


def _over(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are over the threshold."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["a_s"], b["b_s"]):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b[keep][["a", "b"]]
    return _ends(pairs, sets, ["s"]).mapInPandas(run, "a long, b long")


def linked_by_postings(members, probes, percent: int) -> list[tuple[int, int]]:
    """Links of each probe to the members (node, component, set bytes) over the threshold,
    one a component other than its own: full intersections from posting lists."""
    sets = [np.frombuffer(s, np.int64) for _, _, s in members]
    sizes = np.array([len(s) for s in sets])
    node, component = (np.array([m[k] for m in members], np.int64) for k in (0, 1))
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), sizes)[np.argsort(code, kind="stable")]
    begin = np.append(0, np.cumsum(np.bincount(code, minlength=len(values))))
    out = []
    for x, c, s in probes:
        s = np.frombuffer(s, np.int64)
        at = np.searchsorted(values, s)
        at = at[values[np.minimum(at, len(values) - 1)] == s]
        lists = [holder[i:j] for i, j in zip(begin[at].tolist(), begin[at + 1].tolist())]
        both = np.bincount(np.concatenate(lists), minlength=len(sets)) if lists else np.zeros(len(sets), np.int64)
        hit = np.flatnonzero((100 * both >= percent * (len(s) + sizes - both)) & (component != c))
        if len(hit):
            out += [(x, y) for y in node[hit[np.unique(component[hit], return_index=True)[1]]].tolist()]
    return out


def op13_minhash_near_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, n=2, percent=80)
