"""Outlier detection (D1, D2, D4) and treatment.

Statistics for all columns come from one pass (P1/P2) and are applied through
a one-row broadcast cross join, so detection and treatment are single
projections over the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.plans.quantiles import column_quantiles, order_statistics
from kiln.plans.stats import to_long

FLAG = "__outlier"
WINSOR_LIMIT = 0.05
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def flag_name(c: str) -> str:
    return f"{c}{FLAG}"


def iqr_fences(df: DataFrame, columns: Sequence[str], k: float) -> DataFrame:
    """One row: ``<c>__lo`` / ``<c>__hi`` = Q1 - k*IQR / Q3 + k*IQR (exact quartiles)."""
    q = column_quantiles(df, columns, [0.25, 0.75])
    aggs = []
    for c in columns:
        q1 = F.max(F.when((F.col("column") == c) & (F.col("prob") == 0.25), F.col("quantile")))
        q3 = F.max(F.when((F.col("column") == c) & (F.col("prob") == 0.75), F.col("quantile")))
        aggs += [(q1 - k * (q3 - q1)).alias(f"{c}__lo"), (q3 + k * (q3 - q1)).alias(f"{c}__hi")]
    return q.agg(*aggs)


def detect_outliers(df: DataFrame, columns: Sequence[str], method: str = "iqr",
                    threshold: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Returns (df with boolean ``<c>__outlier`` columns, report).

    iqr: x < Q1 - t*IQR or x > Q3 + t*IQR.  zscore: |x - mean| / std_pop > t
    (zero std never flags).  NULL is never an outlier.  The report has
    ``column, n_outliers, pct`` (pct of all rows, half-even 2 decimals).
    """
    columns = list(columns)
    if method == "iqr":
        lim = iqr_fences(df, columns, threshold)
        flags = {c: (F.col(f"`{c}`") < F.col(f"{c}__lo")) | (F.col(f"`{c}`") > F.col(f"{c}__hi"))
                 for c in columns}
        drop = [f"{c}__lo" for c in columns] + [f"{c}__hi" for c in columns]
    elif method == "zscore":
        lim = df.agg(*[x for c in columns for x in (
            F.avg(F.col(f"`{c}`")).alias(f"{c}__mu"), F.stddev_pop(F.col(f"`{c}`")).alias(f"{c}__sd"))])
        flags = {c: F.abs(F.try_divide(F.col(f"`{c}`") - F.col(f"{c}__mu"), F.nullif(F.col(f"{c}__sd"), F.lit(0.0))))
                 > threshold for c in columns}
        drop = [f"{c}__mu" for c in columns] + [f"{c}__sd" for c in columns]
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    flagged = df.crossJoin(F.broadcast(lim)) if columns else df
    for c in columns:
        flagged = flagged.withColumn(flag_name(c), F.coalesce(flags[c], F.lit(False)))
    flagged = flagged.drop(*drop)
    return flagged, outlier_report(flagged, columns)


def outlier_report(flagged: DataFrame, columns: Sequence[str]) -> DataFrame:
    cols = list(columns)
    if not cols:
        return flagged.sparkSession.createDataFrame([], "column string, n_outliers long, pct double")
    wide = flagged.agg(F.count(F.lit(1)).alias("__rows"),
                       *[F.count_if(F.col(flag_name(c))).alias(f"n{i}") for i, c in enumerate(cols)])
    recs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"n{i}").alias("n_outliers"))
            for i, c in enumerate(cols)]
    return wide.select("__rows", F.inline(F.array(*recs))).select(
        "position", "column", "n_outliers",
        F.bround(F.try_divide(F.col("n_outliers") * 100.0, F.col("__rows").cast("double")), 2).alias("pct"))


def treat_outliers(flagged: DataFrame, columns: Sequence[str], method: str = "clip",
                   clip_k: float = 1.5) -> DataFrame:
    """Treat only columns with at least one flag; drops the flag columns.

    clip: clip to the k*IQR fences (k = 1.5 whatever the detection method); whole-number
    columns become double, as fences may be fractions;
    remove: drop rows flagged in any column; winsorize: values below the
    k-th order statistic (k = int(0.05 n), non-null values) are raised to it and
    values above the (n-1-k)-th are lowered to it.
    """
    columns = list(columns)
    flag_cols = [flag_name(c) for c in columns]
    if not columns:
        return flagged
    counts = flagged.agg(*[F.count_if(F.col(flag_name(c))).alias(f"{c}__nf") for c in columns])
    if method == "remove":
        any_flag = F.lit(False)
        for f in flag_cols:
            any_flag = any_flag | F.col(f)
        return flagged.filter(~any_flag).drop(*flag_cols)
    base = flagged.drop(*flag_cols)
    if method == "clip":
        lim = iqr_fences(base, columns, clip_k)
    elif method == "winsorize":
        long = to_long(base, columns, keep_nulls=False)
        stats = order_statistics(
            long, ["column"], "value",
            {"lo": lambda n: F.floor(n * WINSOR_LIMIT),
             "hi": lambda n: n - 1 - F.floor(n * WINSOR_LIMIT)},
            broadcast_state=True)
        aggs = []
        for c in columns:
            aggs.append(F.max(F.when((F.col("column") == c) & (F.col("stat") == "lo"), F.col("value"))).alias(f"{c}__lo"))
            aggs.append(F.max(F.when((F.col("column") == c) & (F.col("stat") == "hi"), F.col("value"))).alias(f"{c}__hi"))
        lim = stats.agg(*aggs)
    else:
        raise ValueError(f"unknown treatment {method!r}")
    lo = {c: F.col(f"{c}__lo") for c in columns}
    hi = {c: F.col(f"{c}__hi") for c in columns}
    # one row of fences and flag counts: broadcast with a fixed size
    joined = base.crossJoin(F.broadcast(lim.crossJoin(counts)))
    out = []
    for f in base.schema.fields:
        c = f.name
        if c in columns:
            x = F.col(f"`{c}`")
            clipped = F.when(x.isNull(), x).otherwise(F.greatest(F.least(x, hi[c]), lo[c]))
            # fences of whole numbers may be fractions: clipped whole-number columns are double
            kind = "double" if isinstance(f.dataType, WHOLE) and method == "clip" else f.dataType
            out.append(F.when(F.col(f"{c}__nf") > 0, clipped.cast(kind)).otherwise(x.cast(kind)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return joined.select(*out)
