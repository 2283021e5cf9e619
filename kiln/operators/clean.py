"""Duplicate removal (C1) and missing-value handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from kiln.core import join_small
from kiln.plans.ordering import fill_backward, fill_forward
from kiln.plans.quantiles import column_quantiles
from kiln.plans.stats import to_long

NUMERIC_STRATEGIES = ("mean", "median", "mode", "forward_fill", "ffill", "backward_fill", "bfill", "drop")


def remove_duplicates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Full-row dedup (NULLs equal).  Returns (deduped, one-row ``n_removed``).

    ``dropDuplicates`` is a hash aggregation on all columns: duplicates collapse
    map-side before the shuffle, so a hot duplicated row costs one record per task.
    """
    deduped = df.dropDuplicates()
    n = df.agg(F.count(F.lit(1)).alias("a")).crossJoin(
        deduped.agg(F.count(F.lit(1)).alias("b"))).select((F.col("a") - F.col("b")).alias("n_removed"))
    return deduped, n


def column_modes(df: DataFrame, columns: Sequence[str], value_type: str) -> DataFrame:
    """Most frequent non-null value per column (ties -> the smallest): ``column, mode``.

    A distributed ``groupBy(column, value)`` count, then two small aggregations;
    no per-column value map is built in one task.
    """
    long = to_long(df, columns, value_type=value_type, keep_nulls=False)
    freq = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = freq.groupBy("column").agg(F.max("n").alias("top"))
    return (join_small(freq, best, ["column"]).filter(F.col("n") == F.col("top"))
            .groupBy("column").agg(F.min("value").alias("mode")))


def _one_row(values: DataFrame, columns: Sequence[str], value_col: str, suffix: str) -> DataFrame:
    """Pivot a ``column, value`` frame (one row per column) into one row."""
    return values.agg(*[F.max(F.when(F.col("column") == c, F.col(value_col))).alias(f"{c}{suffix}")
                        for c in columns])


def handle_missing_values(df: DataFrame, schema: dict, strategy: str = "mean",
                          custom_fill: dict | None = None, order_by=None) -> tuple[DataFrame, DataFrame]:
    """Fill or drop NULLs per column type; columns without NULLs are untouched.

    numeric: mean | median | mode (smallest tie) | forward_fill (then backward
    for leading NULLs) | backward_fill | drop; categorical/text/boolean: mode,
    'Unknown' when all NULL; datetime: forward then backward fill.  ``drop``
    removes rows with a NULL in any column.  ``custom_fill`` {col: value} wins.
    Fill order needs ``order_by`` (a total order), as the data has no row order.
    Returns (df, report ``position, column, n_missing, method``).
    """
    if strategy not in NUMERIC_STRATEGIES:
        raise ValueError(f"unknown missing-value strategy {strategy!r}")
    custom_fill = custom_fill or {}
    cols = df.columns
    null_counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols]).first()
    with_nulls = [c for c in cols if null_counts[c] > 0]       # one number per column
    kind = {c: schema.get(c, {}).get("inferred_type", "text") for c in cols}
    custom = [c for c in with_nulls if c in custom_fill]
    spark = df.sparkSession
    report_rows = []
    out = df.fillna({c: custom_fill[c] for c in custom}) if custom else df
    for c in custom:
        report_rows.append((cols.index(c), c, int(null_counts[c]), f"custom ({custom_fill[c]})"))
    rest = [c for c in with_nulls if c not in custom]

    if strategy == "drop":
        if rest:
            # report for column j: NULL in j and non-NULL in every earlier processed column
            aggs, seen = [], F.lit(True)
            for c in rest:
                aggs.append(F.count_if(seen & F.col(f"`{c}`").isNull()).alias(c))
                seen = seen & F.col(f"`{c}`").isNotNull()
            seq = out.agg(*aggs).first()
            for c in rest:
                if seq[c] > 0:
                    report_rows.append((cols.index(c), c, int(seq[c]), "drop_rows"))
            out = out.dropna(how="any", subset=rest)
        return out, _report(spark, report_rows)

    num = [c for c in rest if kind[c] == "numeric"]
    cat = [c for c in rest if kind[c] in ("categorical", "text", "boolean")]
    dtm = [c for c in rest if kind[c] == "datetime"]
    const_cols: dict[str, str] = {}
    stats_frames = []
    if num and strategy == "mean":
        stats_frames.append(out.agg(*[F.avg(F.col(f"`{c}`")).alias(f"{c}__fill") for c in num]))
        const_cols.update({c: "mean" for c in num})
    elif num and strategy == "median":
        q = column_quantiles(out, num, [0.5])
        stats_frames.append(_one_row(q, num, "quantile", "__fill"))
        const_cols.update({c: "median" for c in num})
    elif num and strategy == "mode":
        stats_frames.append(_one_row(column_modes(out, num, "double"), num, "mode", "__fill"))
        const_cols.update({c: "mode" for c in num})
    if cat:
        m = column_modes(out, cat, "string")
        stats_frames.append(_one_row(m, cat, "mode", "__fill"))
        const_cols.update({c: "mode" for c in cat})
    if stats_frames:
        st = stats_frames[0]
        for s in stats_frames[1:]:
            st = st.crossJoin(s)
        joined = out.crossJoin(F.broadcast(st))
        sel = []
        for f in out.schema.fields:
            c = f.name
            if c in const_cols:
                fill = F.col(f"{c}__fill")
                if c in cat:
                    fill = F.coalesce(fill, F.lit("Unknown"))
                    if f.dataType.simpleString() == "boolean":
                        fill = fill.cast("boolean")
                if c in num and strategy in ("mean", "median") and is_integral(f.dataType):
                    # an integer column with NULLs is float in pandas: keep the fraction
                    sel.append(F.coalesce(F.col(f"`{c}`").cast("double"), fill.cast("double")).alias(c))
                else:
                    sel.append(F.coalesce(F.col(f"`{c}`"), fill.cast(f.dataType)).alias(c))
            else:
                sel.append(F.col(f"`{c}`"))
        out = joined.select(*sel)
    forward = dtm + (num if strategy in ("forward_fill", "ffill") else [])
    backward = num if strategy in ("backward_fill", "bfill") else []
    if (forward or backward) and order_by is None:
        raise ValueError("forward/backward fill needs order_by")
    if forward:
        out = fill_forward(out, forward, order_by, then_backward=True)
    if backward:
        out = fill_backward(out, backward, order_by)
    for c in rest:
        if c in const_cols:
            method = const_cols[c]
        elif c in dtm:
            method = "forward_fill (datetime)"
        elif c in forward:
            method = "forward_fill"
        else:
            method = "backward_fill"
        report_rows.append((cols.index(c), c, int(null_counts[c]), method))
    return out, _report(spark, report_rows)


def is_integral(dt) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _report(spark, rows):
    return spark.createDataFrame(sorted(rows), "position int, column string, n_missing long, method string")
