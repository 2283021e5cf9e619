"""Resampling, time-series and trend queries."""

from __future__ import annotations

from kiln.operators import resample as rs
from kiln.operators import series as ser
from kiln.workloads import r, rounded, table
from kiln.workloads.common import EVENTS_DIRTY_SQL, events_dirty


def events_timed(spark, sf):
    return events_dirty(spark, sf).select("event_id", "ts", "user_id", "value", "value_n")


TIMED_SQL = f"""{EVENTS_DIRTY_SQL},
eg as (select event_id, ts, user_id, value, value_n from ev)"""

DAILY_AGGS = {"value": "sum", "user_id": "nunique", "event_id": "count", "value_n": "median"}
WEEKLY_AGGS = {"value": "max", "value_n": "first", "user_id": "last", "event_id": "std"}


QUERIES = {
    "resample_hourly_mean": lambda s, d: rounded(rs.group_by_time(events_timed(s, d), "ts", "H")),
    "resample_daily_aggs": lambda s, d: rounded(rs.group_by_time(events_timed(s, d), "ts", "D", DAILY_AGGS)),
    "resample_weekly_aggs": lambda s, d: rounded(rs.group_by_time(events_timed(s, d), "ts", "W", WEEKLY_AGGS)),
    "resample_monthly_orders": lambda s, d: rounded(rs.group_by_time(
        table(s, d, "orders").select("o_orderdate", "o_totalprice", "o_orderkey"), "o_orderdate", "M",
        {"o_totalprice": "sum", "o_orderkey": "count"}), 2),
    "timeseries_long": lambda s, d: rounded(ser.time_series(events_dirty(s, d), "ts", ["value", "value_n"])),
    "timeseries_by_group": lambda s, d: rounded(ser.time_series(events_dirty(s, d), "ts", ["value"],
                                                                 group_by="event_type")),
    "trend_decomposition": lambda s, d: rounded(ser.trend_decomposition(
        table(s, d, "events"), "ts", "value", order_by=["ts", "event_id"])),
}


def _dense(step, label_expr, aggs_sql, out_sql, src="eg"):
    return f"""with {TIMED_SQL},
b as (select {label_expr} as bin, * from {src}),
g as (select bin, {aggs_sql} from b group by bin),
bins as (select unnest(generate_series(min(bin), max(bin), {step})) as bin from b)
select bins.bin as ts, {out_sql} from bins left join g using (bin)"""


SQL = {
    "resample_hourly_mean": _dense(
        "interval 1 hour", "date_trunc('hour', ts)",
        "avg(event_id) as event_id, avg(user_id) as user_id, avg(value) as value, avg(value_n) as value_n",
        f"{r('event_id')} as event_id, {r('user_id')} as user_id, {r('value')} as value, "
        f"{r('value_n')} as value_n"),
    "resample_daily_aggs": _dense(
        "interval 1 day", "date_trunc('day', ts)",
        "sum(value) as value, count(distinct user_id) as user_id, count(event_id) as event_id, "
        "quantile_cont(value_n, 0.5) as value_n",
        f"{r('coalesce(value, 0)')} as value, coalesce(user_id, 0) as user_id, "
        f"coalesce(event_id, 0) as event_id, {r('value_n')} as value_n"),
    "resample_weekly_aggs": _dense(
        "interval 7 day", "date_trunc('week', ts) + interval 6 day",
        "max(value) as value, arg_min(value_n, ts) filter (where value_n is not null) as value_n, "
        "arg_max(user_id, ts) filter (where user_id is not null) as user_id, stddev_samp(event_id) as event_id",
        f"{r('value')} as value, {r('value_n')} as value_n, user_id, {r('event_id')} as event_id"),
    "resample_monthly_orders": """with b as (select last_day(o_orderdate)::timestamp as bin, * from orders),
g as (select bin, sum(o_totalprice) as o_totalprice, count(o_orderkey) as o_orderkey from b group by bin),
bins as (select last_day(unnest(generate_series(date_trunc('month', min(bin)), date_trunc('month', max(bin)),
                 interval 1 month)))::timestamp as bin from b)
select bins.bin as o_orderdate, round(coalesce(o_totalprice, 0), 2) as o_totalprice,
       coalesce(o_orderkey, 0) as o_orderkey from bins left join g using (bin)""",
    "timeseries_long": f"""with {EVENTS_DIRTY_SQL}
select ts, 'value' as column, {r('value')} as value from ev
union all select ts, 'value_n', {r('value_n')} from ev""",
    "timeseries_by_group": f"""select event_type, ts, 'value' as column, {r('value')} as value from events""",
    "trend_decomposition": f"""with d as (
  select ts, value, row_number() over (order by ts, event_id) - 1 as point_index
  from events where ts is not null and value is not null),
p as (select greatest(7, count(*) // 20) as w from d),
b as (select w, w - 1 - (w - 1) // 2 as bef, (w - 1) // 2 as aft from p),
t as (select d.point_index, any_value(d.ts) as ts, any_value(d.value) as value,
             case when count(*) = any_value(b.w) then avg(e.value) end as trend
      from d cross join b join d e on e.point_index between d.point_index - b.bef and d.point_index + b.aft
      group by d.point_index)
select point_index, ts, {r('value')} as value, {r('trend')} as trend, {r('value - trend')} as residual from t""",
}
