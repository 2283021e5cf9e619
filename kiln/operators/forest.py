"""Fitted forests as a table of nodes (J9, J12, J20): prediction by joins, level by
level, and impurity importance worked out again from the nodes' own statistics.

The node table is read back from the saved model, so it never passes through the
driver; it has one row a node.  All features are numeric (``x <= threshold`` goes left).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from uuid import uuid4

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.core import ensure_checkpoint_dir

VARIANCE, GINI = "variance", "gini"
#: Trees of together at most this many nodes (about 50 bytes each) are broadcast at once.
BROADCAST_NODES = 1_000_000


def node_table(model: PipelineModel) -> DataFrame:
    """``tree, node, feature, threshold, left, right, stats, gain`` of a fitted forest; leaves have
    NULL children.  ``stats``: rows, sum and sum of squares of the label, or rows a class.
    The forest is saved in the session's checkpoint folder and scanned."""
    forest = model.stages[-1]
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kiln-forest-{uuid4().hex}"
    forest.save(path)
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), F.when(inner, n["split"]["featureIndex"]).alias("feature"),
        F.when(inner, F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner, n["leftChild"]).alias("left"), F.when(inner, n["rightChild"]).alias("right"),
        n["impurityStats"].alias("stats"), F.when(inner, n["gain"]).alias("gain"))


def depth(model: PipelineModel) -> int:
    """Levels of the deepest tree (one number a tree on the driver)."""
    return max((t.depth for t in model.stages[-1].trees), default=0)


def leaves(df: DataFrame, nodes: DataFrame, features: Sequence[str], levels: int, row: str) -> DataFrame:
    """``row``, ``tree``, ``stats`` of the leaf that every row reaches in every tree.

    A row meets its trees' roots and goes down one level a join.  The trees are taken in
    groups whose nodes are few enough to broadcast (counted first, one number a tree), so
    nothing is shuffled; only trees too large by themselves are joined by shuffle.  A NULL
    feature goes right, as a NaN does.
    """
    sizes = nodes.groupBy("tree").count().orderBy("tree").collect()         # one row a tree
    large = [tree for tree, count in sizes if count > BROADCAST_NODES]
    groups, held = [], 0
    for tree, count in sizes:
        if count > BROADCAST_NODES:
            continue
        if not groups or held + count > BROADCAST_NODES:
            groups.append([])
            held = 0
        groups[-1].append(tree)
        held += count
    parts = [_group_leaves(df, nodes.filter(F.col("tree").isin(g)), features, levels, row, F.broadcast) for g in groups]
    if large or not parts:
        parts.append(_group_leaves(df, nodes.filter(F.col("tree").isin(large)), features, levels, row, lambda d: d))
    return reduce(DataFrame.unionByName, parts)


def _group_leaves(df: DataFrame, nodes: DataFrame, features: Sequence[str], levels: int, row: str, hint) -> DataFrame:
    inner = nodes.filter("left is not null").select(
        F.col("tree").alias("__t"), F.col("node").alias("__n"), "feature", "threshold", "left", "right")
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    at = df.select(F.col(f"`{row}`").alias(row), x.alias("__x")).crossJoin(
        F.broadcast(nodes.select("tree").distinct())).withColumn("node", F.lit(0))      # one row a tree
    for _ in range(levels):
        left = F.get("__x", F.col("feature")) <= F.col("threshold")
        at = at.join(hint(inner), (F.col("tree") == F.col("__t")) & (F.col("node") == F.col("__n")), "left").select(
            row, "__x", "tree", F.when(F.col("__n").isNull(), F.col("node")).when(left, F.col("left"))
            .otherwise(F.col("right")).alias("node"))
    ends = nodes.filter("left is null").select(F.col("tree").alias("__t"), F.col("node").alias("__n"), "stats")
    return at.join(hint(ends), (F.col("tree") == F.col("__t")) & (F.col("node") == F.col("__n"))).select(
        row, "tree", "stats")


def predict_regression(df: DataFrame, nodes: DataFrame, features: Sequence[str], levels: int, row: str) -> DataFrame:
    """``row, prediction``: the mean over the trees of the leaf's mean label."""
    return leaves(df, nodes, features, levels, row).groupBy(row).agg(
        F.avg(F.col("stats")[1] / F.col("stats")[0]).alias("prediction"))


def votes(df: DataFrame, nodes: DataFrame, features: Sequence[str], levels: int, row: str) -> DataFrame:
    """``row, class, share``: the mean over the trees of the class's share in the leaf (classes
    with a share only); a forest predicts the class of the largest share."""
    trees = nodes.agg(F.count_distinct("tree").alias("__trees"))
    total = F.aggregate("stats", F.lit(0.0), lambda a, v: a + v)
    shares = leaves(df, nodes, features, levels, row).select(
        row, F.posexplode(F.transform("stats", lambda v: v / total)).alias("class", "share")).filter("share > 0")
    return shares.groupBy(row, "class").agg(F.sum("share").alias("share")).crossJoin(F.broadcast(trees)).select(
        row, "class", (F.col("share") / F.col("__trees")).alias("share"))


def _rows(stats: Column, kind: str) -> Column:
    return stats[0] if kind == VARIANCE else F.aggregate(stats, F.lit(0.0), lambda a, v: a + v)


def _impurity(stats: Column, kind: str) -> Column:
    if kind == VARIANCE:
        return stats[2] / stats[0] - (stats[1] / stats[0]) * (stats[1] / stats[0])
    n = _rows(stats, kind)
    return 1 - F.aggregate(stats, F.lit(0.0), lambda a, v: a + (v / n) * (v / n))


def split_gains(nodes: DataFrame, kind: str) -> DataFrame:
    """``tree, node, feature, rows, gain, model_gain``: every split's fall in impurity, from the
    statistics of the node and of its two children."""
    child = nodes.select(F.col("tree").alias("__t"), F.col("node").alias("__n"), F.col("stats").alias("__s"))
    one = nodes.filter("left is not null")
    for side in ("left", "right"):
        one = one.join(child, (F.col("tree") == F.col("__t")) & (F.col(side) == F.col("__n"))).withColumn(
            f"__{side}", F.col("__s")).drop("__t", "__n", "__s")
    s, lo, hi = F.col("stats"), F.col("__left"), F.col("__right")
    n = _rows(s, kind)
    gain = _impurity(s, kind) - _rows(lo, kind) / n * _impurity(lo, kind) - _rows(hi, kind) / n * _impurity(hi, kind)
    return one.select("tree", "node", "feature", n.alias("rows"), gain.alias("gain"), F.col("gain").alias("model_gain"))


def impurity_importance(nodes: DataFrame, features: Sequence[str], kind: str) -> DataFrame:
    """``feature, importance``: each tree's gains weighted by rows, scaled to 1 a tree, averaged
    over the trees and scaled to 1.  Features without a split have 0; without any split all have."""
    spark = nodes.sparkSession
    gains = split_gains(nodes, kind).groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("g"))
    trees = gains.groupBy("tree").agg(F.sum("g").alias("all")).filter("all > 0")     # one row a tree
    total = gains.join(trees, "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("all")).alias("w"))
    whole = total.agg(F.sum("w").alias("whole"))
    names = spark.createDataFrame(list(enumerate(features)), "feature int, name string")
    return names.join(total, "feature", "left").crossJoin(F.broadcast(whole)).select(
        F.col("name").alias("feature"), F.coalesce(F.col("w") / F.col("whole"), F.lit(0.0)).alias("importance"))
