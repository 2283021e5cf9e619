"""P1 — one pass per stage: wide tables become long (column, value) frames.

Per-column statistics of a stage are computed by one aggregation over a long
projection (``explode`` of an array of structs: a single Expand-like pass), so
that ``groupBy(column)`` does the work with map-side partial aggregation
instead of one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, columns: Sequence[str], value_type: str = "double",
            keep: Sequence[str] = (), keep_nulls: bool = True) -> DataFrame:
    """``keep..., column, value`` with one row per (row, column)."""
    long = df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(value_type).alias("value"))
        for c in columns])).alias("__c")).select(*keep, "__c.column", "__c.value")
    return long if keep_nulls else long.filter(F.col("value").isNotNull())


def positions(spark, columns: Sequence[str]) -> DataFrame:
    """Tiny frame (column, position) preserving the table's column order."""
    return spark.createDataFrame([(c, i) for i, c in enumerate(columns)], "column string, position int")
