"""Summary statistics (H1-H5) and missing-value tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from kiln.core import datetime_columns, epoch_micros, join_small, numeric_columns, string_columns
from kiln.functions.moments import adjusted_kurtosis, adjusted_skewness
from kiln.plans.quantiles import exact_quantiles
from kiln.plans.stats import positions, to_long

SUMMARY_PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
PROB_NAMES = ["p1", "p5", "p25", "p50", "p75", "p95", "p99"]


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Per numeric column: count, mean, std (n-1), min, p1..p99, max, skewness,
    kurtosis (bias adjusted, as pandas) and cv = std/mean*100 (mean 0 -> NULL).
    ``approx=True``: one-pass sketch percentiles instead of exact ones."""
    cols = numeric_columns(df, columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string")
    long = to_long(df, cols, keep_nulls=False)
    m = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.skewness("value").alias("__g1"),
        F.kurtosis("value").alias("__g2"))
    m = (m.withColumn("skewness", adjusted_skewness(F.col("__g1"), F.col("count")))
         .withColumn("kurtosis", adjusted_kurtosis(F.col("__g2"), F.col("count")))
         .withColumn("cv", F.try_divide(F.col("std"), F.nullif(F.col("mean"), F.lit(0.0))) * 100)
         .drop("__g1", "__g2"))
    q = exact_quantiles(long, ["column"], "value", SUMMARY_PROBS, broadcast_state=True, approx=approx)
    qw = q.groupBy("column").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
        for p, n in zip(SUMMARY_PROBS, PROB_NAMES)])
    pos = positions(df.sparkSession, cols)
    out = join_small(pos, m, ["column"], how="left")
    out = join_small(out, qw, ["column"], how="left")
    return out.select("position", "column", F.coalesce("count", F.lit(0)).alias("count"), "mean",
                      "std", "min", *PROB_NAMES, "max", "skewness", "kurtosis", "cv")


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per string/boolean column: n_unique, top_value (most frequent; ties -> the
    smallest value), top_freq and missing."""
    cols = [c for c in string_columns(df) if not columns or c in columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string")
    long = to_long(df, cols, value_type="string")
    freq = long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))
    best = freq.groupBy("column").agg(F.max("n").alias("top_freq"),
                                      F.count(F.lit(1)).alias("n_unique"))
    top = (join_small(freq, best, ["column"]).filter(F.col("n") == F.col("top_freq"))
           .groupBy("column").agg(F.min("value").alias("top_value")))
    miss = long.groupBy("column").agg(F.count_if(F.col("value").isNull()).alias("missing"))
    pos = positions(df.sparkSession, cols)
    out = join_small(pos, miss, ["column"], how="left")
    out = join_small(out, best, ["column"], how="left")
    out = join_small(out, top, ["column"], how="left")
    return out.select("position", "column", F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
                      "top_value", F.coalesce("top_freq", F.lit(0)).alias("top_freq"), "missing")


def datetime_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per datetime column: min, max, range_days (whole days, floor) and missing."""
    cols = [c for c in datetime_columns(df) if not columns or c in columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string")
    long = to_long(df, cols, value_type="timestamp_ntz")
    agg = long.groupBy("column").agg(F.min("value").alias("min"), F.max("value").alias("max"),
                                     F.count_if(F.col("value").isNull()).alias("missing"))
    ntz = T.TimestampNTZType()
    micros = epoch_micros(F.col("max"), ntz) - epoch_micros(F.col("min"), ntz)
    agg = agg.withColumn("range_days", F.floor(micros / F.lit(86400 * 1_000_000)).cast("long"))
    pos = positions(df.sparkSession, cols)
    return join_small(pos, agg, ["column"], how="left").select(
        "position", "column", "min", "max", "range_days", "missing")


def summary_statistics(df: DataFrame) -> dict:
    """The three summaries of the reference's summary tab, as DataFrames."""
    return {"numeric": numeric_summary(df), "categorical": categorical_summary(df),
            "datetime": datetime_summary(df)}


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with missing values: n_missing, pct_missing, severity; descending."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    recs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                     F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(cols)]
    long = wide.select("__rows", F.inline(F.array(*recs)))
    pct = F.try_divide(F.col("n_missing") * 100.0, F.col("__rows").cast("double"))
    return (long.withColumn("pct_missing", pct).filter(F.col("n_missing") > 0)
            .withColumn("severity", F.when(F.col("pct_missing") > 50, "high")
                        .when(F.col("pct_missing") > 20, "medium").otherwise("low"))
            .drop("__rows").orderBy(F.col("pct_missing").desc(), F.col("position")))


def missing_matrix(df: DataFrame, order_by, max_rows: int = 300) -> DataFrame:
    """0/1 missing indicator for the first ``max_rows`` rows (a top-k preview)."""
    cols = df.columns
    order = [F.col(c) if isinstance(c, str) else c for c in ([order_by] if isinstance(order_by, str) else order_by)]
    head = df.orderBy(*order).limit(max_rows)
    from kiln.plans.ordering import ordered_index
    head = ordered_index(head, order_by, idx_col="row_index", num_buckets=1)
    return head.select("row_index", F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 F.col(f"`{c}`").isNull().cast("int").alias("is_missing"))
        for i, c in enumerate(cols)])))
