"""CSV scan and sinks (A1-A3), preview (A4), table profile (A5), column selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.core import col_list, datetime_columns, nan_to_null, numeric_columns, string_columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             infer_schema: bool = True, **options) -> DataFrame:
    """Header row, inferred (or given) types; float NaN normalised to NULL.

    Give ``schema`` for large inputs: inference costs one extra pass over the files.
    """
    r = spark.read.option("header", True).options(**options)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", infer_schema)
    return nan_to_null(r.csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """Header, no index.  ``single_file`` only for small outputs (one task writes)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(path)


def predictions_frame(predictions: DataFrame, feature_cols: Sequence[str], label_col: str = "label",
                      prediction_col: str = "prediction") -> DataFrame:
    """Test features + ``y_actual`` + ``y_predicted`` (what the predictions sink writes)."""
    return predictions.select(*[F.col(f"`{c}`") for c in feature_cols],
                              F.col(label_col).alias("y_actual"),
                              F.col(prediction_col).alias("y_predicted"))


def write_predictions(predictions: DataFrame, feature_cols: Sequence[str], path: str,
                      label_col: str = "label", prediction_col: str = "prediction",
                      mode: str = "overwrite") -> None:
    write_csv(predictions_frame(predictions, feature_cols, label_col, prediction_col), path, mode)


def preview(df: DataFrame, order_by, n: int = 20) -> DataFrame:
    """First ``n`` rows in ``order_by`` order (TakeOrdered: top-k per partition)."""
    if n < 1:
        raise ValueError("n must be positive")
    return df.orderBy(*col_list(order_by)).limit(n)


def table_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing_cells, missing_pct (mean of per-column
    missing shares, in %), duplicate_rows (rows beyond the first of each group of
    identical rows; NULLs equal)."""
    cols = df.columns
    stats = df.agg(F.count(F.lit(1)).alias("rows"),
                   *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    distinct_rows = df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.lit(1).alias("_")) \
        .agg(F.count(F.lit(1)).alias("distinct_rows"))
    miss = sum((F.col(f"m{i}") for i in range(len(cols))), F.lit(0))
    return stats.crossJoin(distinct_rows).select(
        F.col("rows"), F.lit(len(cols)).cast("long").alias("columns"),
        miss.cast("long").alias("missing_cells"),
        (F.try_divide(miss.cast("double"), F.col("rows") * F.lit(len(cols))) * 100).alias("missing_pct"),
        (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"))


def select_columns(df: DataFrame, kind: str = "numeric", columns: Sequence[str] | None = None,
                   max_columns: int | None = None) -> DataFrame:
    """Columns by kind ('numeric', 'categorical' = string/bool, 'datetime'),
    optionally intersected with ``columns`` (their order), capped at ``max_columns``."""
    if kind == "numeric":
        pool = numeric_columns(df)
    elif kind == "categorical":
        pool = string_columns(df)
    elif kind == "datetime":
        pool = datetime_columns(df)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    chosen = [c for c in columns if c in pool] if columns else pool
    if max_columns:
        chosen = chosen[:max_columns]
    return df.select(*[F.col(f"`{c}`") for c in chosen])
