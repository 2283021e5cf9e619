"""Profile, schema and summary queries."""

from __future__ import annotations

from kiln.operators import schema as sch
from kiln.operators import summary as sm
from kiln.sources import io
from kiln.workloads import r, rounded, table
from kiln.workloads.common import (DUPS_SQL, EVENTS_DIRTY_COLS, EVENTS_DIRTY_SQL, EVENTS_DIRTY_TYPES,
                                   events_dirty, with_duplicates)
from kiln.operators.schema import DATETIME_FORMATS


def profile_events(spark, sf):
    return rounded(io.table_profile(with_duplicates(events_dirty(spark, sf))))


def preview_orders(spark, sf):
    return rounded(io.preview(table(spark, sf, "orders"), ["o_orderkey"], 20))


def select_numeric_lineitem(spark, sf):
    return rounded(io.select_columns(table(spark, sf, "lineitem"), "numeric", max_columns=5))


def schema_events(spark, sf):
    return sch.detect_schema(events_dirty(spark, sf))


def parse_dates_events(spark, sf):
    df = events_dirty(spark, sf)
    info = sch.schema_dict(sch.detect_schema(df))
    return sch.parse_datetime_columns(df, info).select("event_id", "ts_dmy", "ts_iso")


def numeric_summary_lineitem(spark, sf):
    return rounded(sm.numeric_summary(table(spark, sf, "lineitem")))


def numeric_summary_events(spark, sf):
    return rounded(sm.numeric_summary(events_dirty(spark, sf)))


def categorical_summary_events(spark, sf):
    return sm.categorical_summary(events_dirty(spark, sf))


def datetime_summary_events(spark, sf):
    return sm.datetime_summary(events_dirty(spark, sf))


def missing_by_column_events(spark, sf):
    return rounded(sm.missing_by_column(events_dirty(spark, sf)))


def csv_round_trip(spark, sf):
    """A2 then A1: write orders as CSV under the session's checkpoint folder (the
    shared folder on a cluster) and scan it back with type inference."""
    from uuid import uuid4

    from pyspark.sql import functions as F

    from kiln.core import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kiln-csv-{uuid4().hex}"
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
    io.write_csv(o, path)
    return rounded(io.read_csv(spark, path))


def missing_matrix_events(spark, sf):
    return sm.missing_matrix(events_dirty(spark, sf), ["ts", "event_id"], 300)


QUERIES = {
    "profile_table": profile_events,
    "preview_head": preview_orders,
    "select_numeric_capped": select_numeric_lineitem,
    "schema_detect": schema_events,
    "schema_parse_datetimes": parse_dates_events,
    "summary_numeric": numeric_summary_lineitem,
    "summary_numeric_nulls": numeric_summary_events,
    "summary_categorical": categorical_summary_events,
    "summary_datetime": datetime_summary_events,
    "missing_by_column": missing_by_column_events,
    "missing_matrix": missing_matrix_events,
    "io_csv_round_trip": csv_round_trip,
}

# ---------------------------------------------------------------- SQL twins
_nulls = " + ".join(f"count_if({c} is null)" for c in EVENTS_DIRTY_COLS)
_cols = ", ".join(EVENTS_DIRTY_COLS)

SQL = {
    "profile_table": f"""with {EVENTS_DIRTY_SQL}, {DUPS_SQL}
select count(*) as rows, {len(EVENTS_DIRTY_COLS)}::bigint as columns, ({_nulls})::bigint as missing_cells,
       {r(f"({_nulls})::double / (count(*) * {len(EVENTS_DIRTY_COLS)}) * 100")} as missing_pct,
       count(*) - (select count(*) from (select distinct {_cols} from evd)) as duplicate_rows
from evd""",
    "preview_head": f"""select o_orderkey, o_custkey, o_orderstatus, {r("o_totalprice")} as o_totalprice,
       o_orderdate, o_orderpriority from orders order by o_orderkey limit 20""",
    "io_csv_round_trip": f"""select o_orderkey::integer as o_orderkey, o_custkey::integer as o_custkey,
       o_orderstatus, {r("o_totalprice")} as o_totalprice, o_orderdate::date as o_orderdate, o_orderpriority
from orders""",
    "select_numeric_capped": f"""select l_orderkey, l_partkey, l_suppkey, l_linenumber,
       {r("l_quantity")} as l_quantity from lineitem""",
}


def _schema_sql():
    parts = []
    for i, c in enumerate(EVENTS_DIRTY_COLS):
        dt = EVENTS_DIRTY_TYPES[c]
        nn = f"count({c})"
        nu = f"count(distinct {c})"
        fmt = "null::varchar"
        if dt == "string":
            fmts = [(f"count(try_strptime({c}, '{p}'))", j) for p, j in DATETIME_FORMATS]
            free = (f"count(coalesce(try_cast({c} as timestamp), "
                    + ", ".join(f"try_strptime({c}, '{p}')" for p, _ in DATETIME_FORMATS) + "))")
            case = " ".join(f"when {e} = {nn} then '{j}'" for e, j in fmts)
            fmt = (f"coalesce(case {case} end, case when {free}::double / greatest({nn}, 1) > 0.8 "
                   f"then 'auto' end)")
            kind = (f"case when {fmt} is not null then 'datetime' when {nu}::double / greatest({nn}, 1) < 0.05 "
                    f"or {nu} <= 20 then 'categorical' else 'text' end")
        elif dt == "boolean":
            kind = "'boolean'"
        elif dt.startswith("timestamp"):
            kind = "'datetime'"
        else:
            kind = "'numeric'"
        parts.append(f"""select {i} as position, '{c}' as column, '{dt}' as dtype, {kind} as inferred_type,
       {nu} as n_unique, count(*) - {nn} as n_missing,
       round_even((count(*) - {nn}) * 100.0 / count(*), 2)::double as pct_missing, {fmt} as datetime_format
from ev""")
    return f"with {EVENTS_DIRTY_SQL}\n" + "\nunion all\n".join(parts)


SQL["schema_detect"] = _schema_sql()
SQL["schema_parse_datetimes"] = f"""with {EVENTS_DIRTY_SQL}
select event_id, try_strptime(ts_dmy, '%d/%m/%Y') as ts_dmy, try_strptime(ts_iso, '%Y-%m-%d') as ts_iso from ev"""

_PROBS = [(0.01, "p1"), (0.05, "p5"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"),
          (0.99, "p99")]


def _numeric_summary_sql(src: str, cols: list[str], cte: str = "") -> str:
    parts = []
    for i, c in enumerate(cols):
        qs = ", ".join(f"{r(f'quantile_cont({c}, {p})')} as {n}" for p, n in _PROBS)
        parts.append(f"""select {i} as position, '{c}' as column, count({c}) as count, {r(f"avg({c})")} as mean,
       {r(f"stddev_samp({c})")} as std, {r(f"min({c})::double")} as min, {qs}, {r(f"max({c})::double")} as max,
       {r(f"skewness({c})")} as skewness, {r(f"kurtosis({c})")} as kurtosis,
       {r(f"stddev_samp({c}) / nullif(avg({c}), 0) * 100")} as cv from {src}""")
    return (f"with {cte}\n" if cte else "") + "\nunion all\n".join(parts)


SQL["summary_numeric"] = _numeric_summary_sql(
    "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax"])
SQL["summary_numeric_nulls"] = _numeric_summary_sql(
    "ev", ["event_id", "user_id", "value", "value_n", "const"], EVENTS_DIRTY_SQL)


def _categorical_sql():
    cols = [c for c in EVENTS_DIRTY_COLS if EVENTS_DIRTY_TYPES[c] in ("string", "boolean")]
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"""select {i} as position, '{c}' as column,
       (select count(distinct {c}) from ev) as n_unique,
       (select v from (select {c}::varchar as v, count(*) as n from ev where {c} is not null group by 1)
          order by n desc, v limit 1) as top_value,
       coalesce((select max(n) from (select count(*) as n from ev where {c} is not null group by {c})), 0) as top_freq,
       (select count_if({c} is null)::bigint from ev) as missing""")
    return f"with {EVENTS_DIRTY_SQL}\n" + "\nunion all\n".join(parts)


SQL["summary_categorical"] = _categorical_sql()
SQL["summary_datetime"] = f"""with {EVENTS_DIRTY_SQL}
select 0 as position, 'ts' as column, min(ts) as min, max(ts) as max,
       floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)::bigint as range_days,
       count_if(ts is null)::bigint as missing from ev
union all
select 1, 'ts_n', min(ts_n), max(ts_n), floor((epoch_us(max(ts_n)) - epoch_us(min(ts_n))) / 86400000000)::bigint,
       count_if(ts_n is null)::bigint from ev"""
SQL["missing_by_column"] = f"""with {EVENTS_DIRTY_SQL},
m as (""" + "\nunion all\n".join(
    f"select {i} as position, '{c}' as column, count_if({c} is null)::bigint as n_missing, count(*) as n from ev"
    for i, c in enumerate(EVENTS_DIRTY_COLS)) + f""")
select position, "column", n_missing, {r("n_missing * 100.0 / n")}::double as pct_missing,
       case when n_missing * 100.0 / n > 50 then 'high' when n_missing * 100.0 / n > 20 then 'medium'
            else 'low' end as severity
from m where n_missing > 0"""
SQL["missing_matrix"] = f"""with {EVENTS_DIRTY_SQL},
h as (select *, row_number() over (order by ts, event_id) - 1 as row_index from ev
      order by ts, event_id limit 300)
""" + "\nunion all\n".join(
    f"select row_index, {i} as position, '{c}' as column, ({c} is null)::integer as is_missing from h"
    for i, c in enumerate(EVENTS_DIRTY_COLS))
