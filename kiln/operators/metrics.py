"""Model evaluation tables (J14-J19, J23-J25) as DataFrame aggregations.

All metrics are computed over a (label, prediction[, score]) frame with plain
aggregations; ranks and cumulative counts use the distributed P4 helpers, so
nothing is collected and no single task sees all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.core import join_small, materialize
from kiln.plans.ordering import prefix_sum, prefix_sums


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Long ``metric, value``: RMSE, MAE, R2 (1 - SS_res / SS_tot)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    a = df.agg(F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"),
               F.sum((y - p) * (y - p)).alias("ssr"), F.var_pop(y).alias("vy"), F.count(F.lit(1)).alias("n"))
    r2 = 1 - F.try_divide(F.col("ssr"), F.col("vy") * F.col("n"))
    return a.select(F.inline(F.array(
        F.struct(F.lit("RMSE").alias("metric"), F.sqrt("mse").alias("value")),
        F.struct(F.lit("MAE").alias("metric"), F.col("mae").alias("value")),
        F.struct(F.lit("R2").alias("metric"), r2.alias("value")))))


def _labels(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return (df.select(F.col(label).alias("v")).union(df.select(F.col(prediction).alias("v")))
            .filter(F.col("v").isNotNull()).distinct())


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Dense ``actual, predicted, count`` over the sorted union of labels."""
    counts = df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))
    labs = _labels(df, label, prediction)
    grid = labs.select(F.col("v").alias("actual")).crossJoin(labs.select(F.col("v").alias("predicted")))
    return join_small(grid, counts, ["actual", "predicted"], how="left").select(
        "actual", "predicted", F.coalesce("count", F.lit(0)).alias("count"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per class precision/recall/F1/support plus accuracy, macro avg and weighted
    avg rows (zero division -> 0): ``class, precision, recall, f1, support``.

    Each (label, prediction) count is a row of the label's class and one of the
    prediction's: a class is one aggregation, without a class x class grid.  The
    table of one row per class is written once and read by every branch."""
    y, p = F.col("y"), F.col("p")
    counts = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("k"))
    both = counts.withColumn("seen", (y.isNotNull() & p.isNotNull()).cast("int"))
    sides = both.select(F.explode(F.array(
        F.struct(y.alias("class"), F.when(y == p, F.col("k")).otherwise(F.lit(0)).alias("tp"),
                 (F.col("k") * F.col("seen")).alias("support"), F.lit(0).cast("long").alias("pred")),
        F.struct(p.alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"),
                 (F.col("k") * F.col("seen")).alias("pred")))).alias("x")).select("x.*").filter("class is not null")
    per = materialize(sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "pred")]))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pred").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    per = per.withColumn("precision", prec).withColumn("recall", rec)
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                       F.col("precision") + F.col("recall")), F.lit(0.0)))
    rows = per.select(F.col("class").cast("string").alias("class"), "precision", "recall", "f1",
                      F.col("support").cast("double").alias("support"))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"), F.avg("precision").alias("mp"),
                  F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    n = F.col("n").cast("double")
    acc = F.try_divide(F.col("tp").cast("double"), n)
    summary = tot.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"),
                 acc.alias("f1"), n.alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.try_divide(F.col("wp"), n).alias("precision"),
                 F.try_divide(F.col("wr"), n).alias("recall"), F.try_divide(F.col("wf"), n).alias("f1"),
                 n.alias("support")))))
    return rows.unionByName(summary)


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Long ``metric, value``: Accuracy and support-weighted F1."""
    rep = classification_report(df, label, prediction)
    return rep.filter(F.col("class").isin("accuracy", "weighted avg")).select(
        F.when(F.col("class") == "accuracy", F.lit("Accuracy")).otherwise(F.lit("F1 (weighted)")).alias("metric"),
        F.when(F.col("class") == "accuracy", F.col("precision")).otherwise(F.col("f1")).alias("value"))


def _auc_by(d: DataFrame, by: str) -> DataFrame:
    """(by, auc, np): exact Mann-Whitney AUC of (by, s, pos); ties count 1/2.

    Rows are counted per score first (map-side combined), so equal scores are one
    row; each takes the negatives below it from a prefix sum."""
    g = d.groupBy(by, "s").agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("q"))
    g = prefix_sum(g, ["s"], "q", "upto", by=[by])
    wins = F.col("p").cast("double") * (F.col("upto") - F.col("q") / 2)
    a = g.groupBy(by).agg(F.sum(wins).alias("wins"), F.sum("p").alias("np"), F.sum("q").alias("nn"))
    return a.select(by, F.try_divide(F.col("wins"), F.col("np").cast("double") * F.col("nn")).alias("auc"), "np")


def roc_auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Exact binary ROC-AUC (Mann-Whitney; ties count 1/2): one row ``auc``."""
    d = df.select((F.col(label) == F.lit(positive)).alias("pos"), F.col(score).cast("double").alias("s")) \
        .filter(F.col("s").isNotNull() & F.col("pos").isNotNull()).withColumn("k", F.lit(0))
    return _auc_by(d, "k").agg(F.max("auc").alias("auc"))


def roc_auc_ovr(df: DataFrame, label: str, score_cols: dict) -> DataFrame:
    """Support-weighted one-vs-rest AUC; ``score_cols`` maps class -> score column."""
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("cls"), F.col(c).cast("double").alias("s")) for k, c in score_cols.items()
    ])).alias("__c")).select("y", "__c.cls", "__c.s").filter(F.col("s").isNotNull() & F.col("y").isNotNull())
    per = _auc_by(long.withColumn("pos", F.col("y") == F.col("cls")), "cls")
    return per.agg(F.try_divide(F.sum(F.col("auc") * F.col("np")), F.sum("np").cast("double")).alias("auc"))


def roc_curve(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """``threshold, fpr, tpr`` at every distinct score (descending), plus the
    starting point (threshold +inf, 0, 0).  Cumulative counts by P4 prefix sums."""
    d = df.select((F.col(label) == F.lit(positive)).cast("int").alias("pos"),
                  F.col(score).cast("double").alias("s")).filter(F.col("s").isNotNull())
    g = d.groupBy("s").agg(F.sum("pos").alias("tp"), F.sum(1 - F.col("pos")).alias("fp"))
    g = prefix_sums(g.withColumn("neg_s", -F.col("s")), ["neg_s"], {"ctp": "tp", "cfp": "fp"})
    tot = d.agg(F.sum("pos").alias("P"), F.sum(1 - F.col("pos")).alias("N"))
    j = g.crossJoin(F.broadcast(tot))
    pts = j.select(F.col("s").alias("threshold"),
                   F.try_divide(F.col("cfp").cast("double"), F.col("N").cast("double")).alias("fpr"),
                   F.try_divide(F.col("ctp").cast("double"), F.col("P").cast("double")).alias("tpr"))
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(pts)


def residuals(df: DataFrame, label: str, prediction: str, bins: int = 30) -> tuple[DataFrame, DataFrame]:
    """(points ``fitted, residual``, histogram of residuals ``bin, lower, upper, count``)."""
    pts = df.select(F.col(prediction).cast("double").alias("fitted"),
                    (F.col(label).cast("double") - F.col(prediction).cast("double")).alias("residual"))
    from kiln.operators.dist import histogram
    h = histogram(pts.select("residual"), ["residual"], bins=bins).drop("column")
    return pts, h


def actual_vs_predicted(df: DataFrame, label: str, prediction: str) -> tuple[DataFrame, DataFrame]:
    """(points ``actual, predicted``, one row ``lo, hi, r2`` for the diagonal)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    pts = df.select(y.alias("actual"), p.alias("predicted"))
    a = df.agg(F.least(F.min(y), F.min(p)).alias("lo"), F.greatest(F.max(y), F.max(p)).alias("hi"),
               F.sum((y - p) * (y - p)).alias("ssr"), (F.var_pop(y) * F.count(F.lit(1))).alias("sst"))
    return pts, a.select("lo", "hi", (1 - F.try_divide(F.col("ssr"), F.col("sst"))).alias("r2"))


def top_importance(importance: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most important features (a top-k report)."""
    return importance.orderBy(F.col("importance").desc(), F.col("feature")).limit(n)


__all__: Sequence[str] = ["regression_metrics", "confusion_matrix", "classification_report",
                          "classification_metrics", "roc_auc", "roc_auc_ovr", "roc_curve", "residuals",
                          "actual_vs_predicted", "top_importance"]
