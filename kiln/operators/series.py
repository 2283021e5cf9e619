"""Time-series tables (H14, H15) and trend decomposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.core import col_list
from kiln.plans.ordering import frame_sums, ordered_index


def time_series(df: DataFrame, datetime_col: str, value_cols: Sequence[str],
                group_by: str | None = None) -> DataFrame:
    """Long series ``[group,] <datetime_col>, column, value`` sorted by column and time."""
    keep = [group_by] if group_by else []
    long = df.select(*keep, F.col(f"`{datetime_col}`").cast("timestamp_ntz").alias(datetime_col),
                     F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                  F.col(f"`{c}`").cast("double").alias("value"))
                                         for c in value_cols])).alias("__c"))
    long = long.select(*keep, datetime_col, "__c.column", "__c.value")
    return long.orderBy("column", *keep, datetime_col)


def trend_decomposition(df: DataFrame, datetime_col: str, value_col: str, order_by=None,
                        window: int | None = None) -> DataFrame:
    """Centered rolling-mean trend and residual over the time-ordered non-null rows.

    window w = max(7, n // 20); the frame is (w-1) - (w-1)//2 rows before and
    (w-1)//2 after (for even w one more before); trend is NULL unless the frame
    is full; residual = value - trend.  ``order_by`` breaks ties in time.
    """
    order = col_list(order_by) or [datetime_col]
    data = df.select(*{datetime_col, *[c for c in order if isinstance(c, str)], value_col}) \
        .filter(F.col(f"`{datetime_col}`").isNotNull() & F.col(f"`{value_col}`").isNotNull())
    if window is None:
        window = max(7, data.count() // 20)   # one number: sizes the frame
    after = (window - 1) // 2
    before = window - 1 - after
    idx = ordered_index(data, order, idx_col="point_index").select(
        "point_index", F.col(f"`{datetime_col}`").alias("__t"), F.col(f"`{value_col}`").cast("double").alias("__v"))
    out = frame_sums(idx, "point_index", "__v", before, after, carry=["__t"])
    trend = F.col("__sum") / F.lit(float(window))
    return out.select("point_index", F.col("__t").alias(datetime_col), F.col("__v").alias("value"),
                      trend.alias("trend"), (F.col("__v") - trend).alias("residual"))
