"""Categorical encoding (E1-E3) and numeric scaling.

The distinct categories of a one-hot column are bounded (at most
``max_cardinality`` values), so they are the only thing collected to the
driver, to name the output columns.  Label codes for high-cardinality columns
stay distributed: distinct values are numbered with the P3 ordered index and
joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.core import join_small
from kiln.plans.ordering import ordered_index
from kiln.plans.quantiles import column_quantiles


def _as_text(df: DataFrame, c: str):
    """pandas ``astype(str)`` spelling: booleans True/False, NULL -> 'nan'."""
    dt = df.schema[c].dataType
    x = F.col(f"`{c}`")
    if isinstance(dt, T.BooleanType):
        s = F.when(x, F.lit("True")).when(~x, F.lit("False"))
    else:
        s = x.cast("string")
    return s


def encode_categoricals(df: DataFrame, columns: Sequence[str], method: str = "onehot",
                        max_cardinality: int = 20) -> tuple[DataFrame, DataFrame]:
    """One-hot (drop first, sorted categories, ``<col>_<value>`` int columns appended,
    source dropped, NULL -> all zeros) for columns with at most ``max_cardinality``
    distinct values when ``method == 'onehot'``; otherwise label codes (index in
    the sorted distinct strings, NULL spelled 'nan').

    Returns (encoded df, encoder map ``column, method, category, code, output_column``).
    """
    spark = df.sparkSession
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df, spark.createDataFrame([], "column string, method string, category string, code long, "
                                             "output_column string")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _as_text(df, c).alias("value")) for c in columns])).alias("__c")
    ).select("__c.column", "__c.value")
    distinct = long.filter(F.col("value").isNotNull()).distinct()
    n_unique = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    card = {r["column"]: r["n_unique"] for r in n_unique.collect()}   # one row per column
    onehot = [c for c in columns if method == "onehot" and card.get(c, 0) <= max_cardinality]
    label = [c for c in columns if c not in onehot]
    maps = []
    out = df
    if onehot:
        small = (join_small(distinct, n_unique.filter(F.col("n_unique") <= max_cardinality), ["column"])
                 .filter(F.col("column").isin(onehot)).select("column", "value"))
        cats: dict[str, list[str]] = {c: [] for c in onehot}
        for r in small.collect():          # at most max_cardinality values per column
            cats[r["column"]].append(r["value"])
        new_cols = []
        rows = []
        for c in onehot:
            values = sorted(cats[c])
            text = _as_text(df, c)
            for i, v in enumerate(values):
                name = f"{c}_{v}"
                if i == 0:
                    rows.append((c, "onehot", v, i, None))
                    continue
                rows.append((c, "onehot", v, i, name))
                new_cols.append(F.coalesce((text == F.lit(v)).cast("int"), F.lit(0)).alias(name))
        keep = [F.col(f"`{x}`") for x in df.columns if x not in onehot]
        out = out.select(*keep, *new_cols)
        maps.append(spark.createDataFrame(rows, "column string, method string, category string, code long, "
                                                "output_column string"))
    for c in label:
        vals = long.filter(F.col("column") == c).select(F.coalesce("value", F.lit("nan")).alias("category")).distinct()
        codes = ordered_index(vals, ["category"], idx_col="code")
        tmp = out.withColumn("__txt", F.coalesce(_as_text(out, c), F.lit("nan")))
        joined = tmp.join(codes.withColumnRenamed("category", "__txt"), "__txt", "left")
        out = joined.select(*[F.col("code").alias(c) if x == c else F.col(f"`{x}`") for x in out.columns])
        maps.append(codes.select(F.lit(c).alias("column"), F.lit("label").alias("method"), "category",
                                 "code", F.lit(c).alias("output_column")))
    enc_map = maps[0]
    for m in maps[1:]:
        enc_map = enc_map.unionByName(m)
    return out, enc_map


def scale_params(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """One row of fitted parameters: ``<c>__center`` and ``<c>__scale``.

    standard: mean, population std (0 -> 1); minmax: min, max-min (0 -> 1);
    robust: median, Q3-Q1 (0 -> 1).  NULLs are ignored in the fit.
    """
    columns = list(columns)
    if method == "standard":
        aggs = []
        for c in columns:
            x = F.col(f"`{c}`").cast("double")
            aggs += [F.avg(x).alias(f"{c}__center"), F.stddev_pop(x).alias(f"{c}__raw")]
        p = df.agg(*aggs)
    elif method == "minmax":
        aggs = []
        for c in columns:
            x = F.col(f"`{c}`").cast("double")
            aggs += [F.min(x).alias(f"{c}__center"), (F.max(x) - F.min(x)).alias(f"{c}__raw")]
        p = df.agg(*aggs)
    elif method == "robust":
        q = column_quantiles(df, columns, [0.25, 0.5, 0.75])
        aggs = []
        for c in columns:
            def at(pr):
                return F.max(F.when((F.col("column") == c) & (F.col("prob") == pr), F.col("quantile")))
            aggs += [at(0.5).alias(f"{c}__center"), (at(0.75) - at(0.25)).alias(f"{c}__raw")]
        p = q.agg(*aggs)
    else:
        raise ValueError(f"unknown scaling method {method!r}")
    sel = []
    for c in columns:
        raw = F.col(f"{c}__raw")
        sel += [F.col(f"{c}__center"),
                F.when(raw.isNull() | (raw == 0), F.lit(1.0)).otherwise(raw).alias(f"{c}__scale")]
    return p.select(*sel)


def scale_features(df: DataFrame, columns: Sequence[str], method: str = "standard",
                   exclude: Sequence[str] = ()) -> tuple[DataFrame, DataFrame | None]:
    """(x - center) / scale for the given numeric columns; returns (df, params)."""
    cols = [c for c in columns if c in df.columns and c not in set(exclude)]
    if not cols or method == "none":
        return df, None
    params = scale_params(df, cols, method)
    joined = df.crossJoin(F.broadcast(params))
    out = [((F.col(f"`{c}`").cast("double") - F.col(f"{c}__center")) / F.col(f"{c}__scale")).alias(c)
           if c in cols else F.col(f"`{c}`") for c in df.columns]
    return joined.select(*out), params
