"""Time resampling (F1-F5): bin labels, aggregation by name, empty-bin densification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.core import join_small, numeric_columns
from kiln.plans.quantiles import exact_quantiles

FREQS = ("H", "D", "W", "M")
# aggregations that are 0 (not NULL) on an empty bin
ZERO_ON_EMPTY = ("sum", "count", "nunique", "size")


def bin_label(ts: Column, freq: str) -> Column:
    """H/D: left edge; W: the Sunday ending the Monday-Sunday week; M: month end."""
    freq = freq.upper()
    if freq == "H":
        out = F.date_trunc("hour", ts)
    elif freq == "D":
        out = F.date_trunc("day", ts)
    elif freq == "W":
        out = F.date_trunc("week", ts) + F.expr("INTERVAL 6 DAYS")
    elif freq == "M":
        out = F.last_day(ts).cast("timestamp")
    else:
        raise ValueError(f"freq must be one of {FREQS}")
    return out.cast("timestamp_ntz")


def _agg(name: str, c: str, ts: str, order_by: Sequence[str] = ()) -> Column:
    x = F.col(f"`{c}`")
    # of tied timestamps order_by decides, and of ties there the value itself
    at = F.struct(F.col(f"`{ts}`"), *[F.col(f"`{o}`") for o in order_by], x)
    if name == "mean":
        return F.avg(x)
    if name == "sum":
        return F.sum(x)
    if name == "min":
        return F.min(x)
    if name == "max":
        return F.max(x)
    if name == "count":
        return F.count(x)
    if name == "std":
        return F.stddev_samp(x)
    if name == "nunique":
        return F.count_distinct(x)
    if name == "first":
        return F.min_by(x, F.when(x.isNotNull(), at))
    if name == "last":
        return F.max_by(x, F.when(x.isNotNull(), at))
    raise ValueError(f"unknown aggregation {name!r}")


def group_by_time(df: DataFrame, datetime_col: str, freq: str = "D",
                  agg_funcs: dict | None = None, densify: bool = True,
                  order_by: Sequence[str] = ()) -> DataFrame:
    """Resample to H/D/W/M bins and aggregate (default: mean of every numeric column).

    ``agg_funcs`` maps column -> mean/sum/min/max/count/std/median/first/last/nunique.
    With ``densify`` every bin between the first and the last exists; sum, count
    and nunique are 0 on an empty bin, the others NULL (as pandas resample).
    ``first`` and ``last`` go by (``datetime_col``, ``order_by``, the value).
    """
    if datetime_col not in df.columns:
        raise ValueError(f"Column '{datetime_col}' not found.")
    if agg_funcs is None:
        agg_funcs = {c: "mean" for c in numeric_columns(df) if c != datetime_col}
    label = "__bin"
    d = df.withColumn(label, bin_label(F.col(f"`{datetime_col}`").cast("timestamp_ntz"), freq)) \
        .filter(F.col(label).isNotNull())
    plain = {c: f for c, f in agg_funcs.items() if f != "median"}
    medians = [c for c, f in agg_funcs.items() if f == "median"]
    g = d.groupBy(label).agg(*[_agg(f, c, datetime_col, order_by).alias(c) for c, f in plain.items()]) if plain \
        else d.select(label).distinct()
    for c in medians:
        q = exact_quantiles(d.select(label, c), [label], c, [0.5]).select(label, F.col("quantile").alias(c))
        g = join_small(g, q, [label])
    if densify:
        bounds = d.agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
        f = freq.upper()
        if f == "M":
            first_of = F.trunc(F.col("lo"), "month"), F.trunc(F.col("hi"), "month")
            seq = F.sequence(first_of[0], first_of[1], F.expr("INTERVAL 1 MONTH"))
            bins = bounds.select(F.explode(seq).alias("m")).select(
                F.last_day("m").cast("timestamp").cast("timestamp_ntz").alias(label))
        else:
            step = {"H": "INTERVAL 1 HOUR", "D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAYS"}[f]
            bins = bounds.select(F.explode(F.sequence("lo", "hi", F.expr(step))).alias(label))
        g = join_small(bins, g, [label], how="left")
        g = g.select(label, *[F.coalesce(F.col(c), F.lit(0)).alias(c) if agg_funcs[c] in ZERO_ON_EMPTY
                              else F.col(c) for c in agg_funcs])
    return g.select(F.col(label).alias(datetime_col), *[F.col(c) for c in agg_funcs])
