"""N-gram Jaccard join: documents linked by near-equal word n-gram sets.

1. Equal sets form one class; only the class representative goes on.
2. Candidates: a pair over the threshold shares one of the first elements of its
   sets in any global order.  The order puts the shingles whose hash falls in a
   fixed residue class first, rare ones before frequent ones; a shingle that only
   one representative holds joins nothing, so a document with enough of them is
   done.  The shared first shingles are the keys by which documents meet.
3. What meets is compared in prefix trees (``stars`` says what with what): the sets,
   all sorted by the same global order of the hashes, are stored in a tree; a set is
   traversed against it, sharing partial overlaps along common paths and leaving a
   subtree as soon as the remaining lengths cannot reach the threshold.  Subtrees
   already in the set's own component are skipped, and of a set's links one for each
   other component leaves the tree, never all pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import staged, unstaged
from kiln.llm.prefix_tree import PrefixTree
from kiln.llm.shingles import classes, described, named_components, nodes, prefix_length, set_rows
from kiln.llm.stars import BLOCK, in_cells, linked_components

#: Members of one tree that meet the same smallest member.
STAR = 500


# -- step 2: keys -----------------------------------------------------------------------------

def first_shingles(percent: int):
    """For ``described``: ``early``, the shingles of a set of the first class of the global
    order (a residue class of the hash, about 1.7 times what a prefix needs), and
    ``late``, the following ones that a set with too few of them needs."""
    residue = max(1, 60 // max(1, 100 - percent))

    def describe(sets: list[np.ndarray]):
        early, late = [], []
        for s in sets:
            first = s % residue == 0
            early.append(s[first])
            missing = prefix_length(len(s), percent) - len(early[-1]) if len(s) else 0
            late.append(s[~first][:max(0, missing)])
        return [early, late]
    return describe


def prefix_keys(known: DataFrame, percent: int) -> DataFrame:
    """(key, node, n): the shared shingles in the prefix of each node, from (node, n,
    early, late)."""
    def marked(column, late):
        return F.transform(column, lambda t: F.struct(t.alias("key"), F.lit(late).alias("late")))

    rows = known.select("node", F.explode(F.concat(marked("early", False), marked("late", True))).alias("x")).select(
        "x.key", "node", "x.late")
    df = rows.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    by_node = rows.join(df, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(
        F.col("late"), F.when(F.col("late"), F.lit(0)).otherwise(F.col("df")).alias("df"), F.col("key")))).alias("ts"))
    # the shingles that nobody shares are the rarest: they come first and use up the prefix
    alone = F.col("front") - F.size(F.filter("ts", lambda x: ~x["late"]))
    left = (F.expr(f"n - (n * {percent} + 99) div 100 + 1") - alone).cast("int")
    return by_node.join(known.select("node", "n", F.size("early").alias("front")), "node").select(
        "node", "n", F.explode(F.slice("ts", F.lit(1), F.greatest(left, F.lit(0)))).alias("x")).select("x.key", "node", "n")


# -- step 3: the prefix tree ------------------------------------------------------------------

def tree_links(members, probes, percent: int) -> list[tuple[int, int]]:
    """Links of each probe to the members (node, component, set bytes) over the threshold,
    one a component other than its own."""
    sets = lambda rows: [np.frombuffer(s, np.int64) for _, _, s in rows]
    tree = PrefixTree(sets(members), [c for _, c, _ in members])
    out = {}
    for x, y in tree.links(sets(probes), [c for _, c, _ in probes], percent):
        out[probes[x][0], members[y][1]] = members[y][0]
    return [(node, other) for (node, _), other in out.items()]


# -- the operator -----------------------------------------------------------------------------

def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id",
                       text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Words are runs without white space, A-Z lower-cased; a set is the distinct
    n-word shingles, the whole sequence if there are fewer words.  Two documents
    link when 100 * intersection >= percent * union; a component is named by its
    smallest id.  Null, empty or blank text: no shingles, linked with nothing.
    Rows that share an id are one document (of different texts the one with the
    most shingles, ties by digest) and give one row.  A row without id gives a row
    and links by its set; its component is named by the smallest id in it, or null
    if none has an id.  No rows: no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = staged(described(base, n, "early array<long>, late array<long>", first_shingles(percent), 1000), "firsts")
    members = staged(classes(rows), "classes")
    repeats = rows.count() > members.count()
    first = rows.select("sig", "early", "late")
    known = staged(nodes(members).join(first.dropDuplicates(["sig"]), "sig"), "nodes")
    unstaged(rows)
    keys = staged(prefix_keys(known, percent), "keys")

    def compared(cells: DataFrame, made: list[DataFrame]) -> DataFrame:
        wanted = cells.select("node").distinct().join(known.select("node", "sig"), "node")
        sets = set_rows(base, wanted, n, repeats)
        made.append(sets)
        return in_cells(cells.join(sets, "node"), lambda m, p: tree_links(m, p, percent))

    def links(pairs: DataFrame, made: list[DataFrame]) -> DataFrame:
        # pairs of one smallest member b meet in trees of about STAR sets
        many = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("int").alias("trees"))
        tree = F.pmod(F.xxhash64("a"), F.col("trees")).cast("int")
        placed = pairs.join(many, "b").select(F.col("b").alias("pool"), F.lit(0).alias("band"), tree.alias("x"), F.lit(0).alias("y"),
                                              F.col("a").alias("node"), F.col("a").alias("c"), F.lit(False).alias("probe"))
        probes = many.select(F.col("b").alias("pool"), F.lit(0).alias("band"), F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("x"),
                             F.lit(0).alias("y"), F.col("b").alias("node"), F.col("b").alias("c"), F.lit(True).alias("probe"))
        cells = staged(placed.unionByName(probes), "stars")
        made.append(cells)
        return compared(cells, made)

    found = linked_components(keys, percent, links, compared, block)
    out = staged(named_components(members, found), "named")
    for t in (members, known, keys, found):
        unstaged(t)
    return out


def op4_ngram_jaccard_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, n=3, percent=90)
