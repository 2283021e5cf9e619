"""Registered queries over the driver tables: a Spark side and an SQL twin.

Each area module exposes ``QUERIES`` (name -> fn(spark, sf_dir) -> DataFrame)
and ``SQL`` (name -> DuckDB SQL over the same tables).  Result columns carry the
same names on both sides; doubles are rounded to a fixed number of decimals on
both sides so that summation order does not change the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS, per_column: dict | None = None) -> DataFrame:
    """Round every double column (the SQL twin rounds the same columns).

    ``per_column`` overrides the digits of single columns (e.g. a mean of
    2-decimal values sits exactly on a 6-digit rounding boundary).
    """
    per_column = per_column or {}
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), per_column.get(f.name, digits)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def r(expr: str, digits: int = DIGITS) -> str:
    return f"round({expr}, {digits})"
