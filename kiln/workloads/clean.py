"""Dedup and missing-value queries (C1-C11) on events with injected NULLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import clean
from kiln.operators.schema import detect_schema, schema_dict
from kiln.workloads import r, rounded, table
from kiln.workloads.common import DUPS_SQL, EVENTS_DIRTY_SQL, events_dirty, with_duplicates

ORDER = ["ts", "event_id"]
OUT = ["event_id", "ts", "value_n", "event_type_n", "ts_n", "user_id"]


def _dirty(spark, sf):
    d = events_dirty(spark, sf).select("event_id", "ts", "user_id", "value_n", "event_type_n", "ts_n")
    # leading/trailing NULLs: first and last 10 rows by time
    e = table(spark, sf, "events")
    lo = e.orderBy("ts", "event_id").limit(10).select("event_id")
    hi = e.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(10).select("event_id")
    edge = lo.unionByName(hi).withColumn("__edge", F.lit(True))
    d = d.join(F.broadcast(edge), "event_id", "left")   # 20 rows: fixed size
    return d.withColumn("value_n", F.when(F.col("__edge"), F.lit(None)).otherwise(F.col("value_n"))).drop("__edge")


DIRTY_SQL = f"""{EVENTS_DIRTY_SQL},
edge as (select event_id from (select event_id from events order by ts, event_id limit 10)
         union all select event_id from (select event_id from events order by ts desc, event_id desc limit 10)),
d as (select event_id, ts, user_id,
             case when event_id in (select event_id from edge) then null else value_n end as value_n,
             event_type_n, ts_n from ev)"""


def _handled(spark, sf, strategy, custom=None):
    df = _dirty(spark, sf)
    info = schema_dict(detect_schema(df))
    return clean.handle_missing_values(df, info, strategy, custom_fill=custom, order_by=ORDER)


def _filled(spark, sf, strategy):
    return rounded(_handled(spark, sf, strategy)[0].select(*OUT))


def dedup_rows(spark, sf):
    return rounded(clean.remove_duplicates(with_duplicates(events_dirty(spark, sf)))[0])


def dedup_count(spark, sf):
    return clean.remove_duplicates(with_duplicates(events_dirty(spark, sf)))[1]


QUERIES = {
    "dedup_rows": dedup_rows,
    "dedup_count": dedup_count,
    "missing_mean": lambda s, d: _filled(s, d, "mean"),
    "missing_median": lambda s, d: _filled(s, d, "median"),
    "missing_mode": lambda s, d: _filled(s, d, "mode"),
    "missing_ffill": lambda s, d: _filled(s, d, "forward_fill"),
    "missing_bfill": lambda s, d: _filled(s, d, "backward_fill"),
    "missing_drop": lambda s, d: _filled(s, d, "drop"),
    "missing_custom": lambda s, d: rounded(_handled(s, d, "median", {"value_n": -1.0})[0].select(*OUT)),
    "missing_report_drop": lambda s, d: _handled(s, d, "drop")[1],
    "missing_report_mean": lambda s, d: _handled(s, d, "mean")[1],
}

_EV_COLS = ("event_id, ts, user_id, event_type, value, props, value_n, event_type_n, ts_dmy, ts_iso, ts_n, "
            "const, flag")
_DT = ("coalesce(last_value(ts_n ignore nulls) over (order by ts, event_id rows between unbounded preceding "
       "and current row), first_value(ts_n ignore nulls) over (order by ts, event_id rows between current row "
       "and unbounded following)) as ts_n")
_CAT = ("coalesce(event_type_n, (select v from (select event_type_n as v, count(*) as n from d "
        "where event_type_n is not null group by 1) order by n desc, v limit 1), 'Unknown') as event_type_n")


def _fill_sql(value_expr):
    return f"""with {DIRTY_SQL}
select event_id, ts, {r(value_expr)} as value_n, {_CAT}, {_DT}, user_id from d"""


SQL = {
    "dedup_rows": f"""with {EVENTS_DIRTY_SQL}, {DUPS_SQL}
select distinct event_id, ts, user_id, event_type, {r("value")} as value, props, {r("value_n")} as value_n,
       event_type_n, ts_dmy, ts_iso, ts_n, {r("const")} as const, flag from evd""",
    "dedup_count": f"""with {EVENTS_DIRTY_SQL}, {DUPS_SQL}
select count(*) - (select count(*) from (select distinct {_EV_COLS} from evd)) as n_removed from evd""",
    "missing_mean": _fill_sql("coalesce(value_n, (select avg(value_n) from d))"),
    "missing_median": _fill_sql("coalesce(value_n, (select quantile_cont(value_n, 0.5) from d))"),
    "missing_mode": _fill_sql("coalesce(value_n, (select v from (select value_n as v, count(*) as n from d "
                              "where value_n is not null group by 1) order by n desc, v limit 1))"),
    "missing_ffill": _fill_sql(
        "coalesce(last_value(value_n ignore nulls) over (order by ts, event_id rows between unbounded "
        "preceding and current row), first_value(value_n ignore nulls) over (order by ts, event_id rows "
        "between current row and unbounded following))"),
    "missing_bfill": _fill_sql(
        "first_value(value_n ignore nulls) over (order by ts, event_id rows between current row and "
        "unbounded following)"),
    "missing_drop": f"""with {DIRTY_SQL}
select event_id, ts, {r("value_n")} as value_n, event_type_n, ts_n, user_id from d
where value_n is not null and event_type_n is not null and ts_n is not null""",
    "missing_custom": _fill_sql("coalesce(value_n, -1.0)"),
    "missing_report_drop": f"""with {DIRTY_SQL}
select * from (
select 3 as position, 'value_n' as column, count_if(value_n is null)::bigint as n_missing, 'drop_rows' as method from d
union all
select 4, 'event_type_n', count_if(value_n is not null and event_type_n is null)::bigint, 'drop_rows' from d
union all
select 5, 'ts_n', count_if(value_n is not null and event_type_n is not null and ts_n is null)::bigint, 'drop_rows' from d)
where n_missing > 0""",
    "missing_report_mean": f"""with {DIRTY_SQL}
select 3 as position, 'value_n' as column, count_if(value_n is null)::bigint as n_missing, 'mean' as method from d
union all select 4, 'event_type_n', count_if(event_type_n is null)::bigint, 'mode' from d
union all select 5, 'ts_n', count_if(ts_n is null)::bigint, 'forward_fill (datetime)' from d""",
}
