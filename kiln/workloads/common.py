"""Deterministic perturbations of the driver tables, written in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.workloads import table


def events_dirty(spark, sf):
    """events + NULLs, date strings, a constant and a boolean column."""
    e = table(spark, sf, "events")
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value", "props",
        F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value")).alias("value_n"),
        F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type_n"),
        F.date_format("ts", "dd/MM/yyyy").alias("ts_dmy"),
        F.date_format("ts", "yyyy-MM-dd").alias("ts_iso"),
        F.when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.col("ts")).alias("ts_n"),
        F.lit(1.0).alias("const"),
        (F.col("value") > 50).alias("flag"))


EVENTS_DIRTY_SQL = """ev as (
  select event_id, ts, user_id, event_type, value, props,
         case when event_id % 7 = 0 then null else value end as value_n,
         case when event_id % 11 = 0 then null else event_type end as event_type_n,
         strftime(ts, '%d/%m/%Y') as ts_dmy,
         strftime(ts, '%Y-%m-%d') as ts_iso,
         case when event_id % 13 = 0 then null else ts end as ts_n,
         1.0::double as const,
         value > 50 as flag
  from events)"""

EVENTS_DIRTY_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props", "value_n",
                     "event_type_n", "ts_dmy", "ts_iso", "ts_n", "const", "flag"]
EVENTS_DIRTY_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint",
                      "event_type": "string", "value": "double", "props": "string",
                      "value_n": "double", "event_type_n": "string", "ts_dmy": "string",
                      "ts_iso": "string", "ts_n": "timestamp_ntz", "const": "double",
                      "flag": "boolean"}


def with_duplicates(df):
    return df.unionByName(df.filter(F.col("event_id") % 50 == 0))


DUPS_SQL = "evd as (select * from ev union all select * from ev where event_id % 50 = 0)"
