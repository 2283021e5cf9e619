"""The full preprocessing pipeline (G1) on events with injected defects."""

from __future__ import annotations

from kiln.operators.pipeline import run_preprocessing_pipeline
from kiln.workloads import r, rounded
from kiln.workloads.common import DUPS_SQL, EVENTS_DIRTY_SQL, events_dirty, with_duplicates

COLS = ["event_id", "ts", "user_id", "event_type_n", "value_n", "ts_dmy"]


def _run(spark, sf):
    df = with_duplicates(events_dirty(spark, sf)).select(*COLS)
    return run_preprocessing_pipeline(df, order_by=["ts", "event_id"])


QUERIES = {
    "pipeline_output": lambda s, d: rounded(_run(s, d)[0]),
    "pipeline_outlier_report": lambda s, d: _run(s, d)[1]["outliers"],
}

_NUM = ["event_id", "user_id", "value_n"]
_fence = ", ".join(
    f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as {c}__lo, "
    f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as {c}__hi"
    for c in _NUM)
_STAGES = f"""with {EVENTS_DIRTY_SQL}, {DUPS_SQL},
raw as (select {", ".join(COLS)} from evd),
dd as (select distinct event_id, ts, user_id, event_type_n, value_n,
              try_strptime(ts_dmy, '%d/%m/%Y') as ts_dmy from raw),
mv as (select event_id, ts, user_id,
              coalesce(event_type_n, (select v from (select event_type_n as v, count(*) as n from dd
                  where event_type_n is not null group by 1) order by n desc, v limit 1), 'Unknown') as event_type_n,
              coalesce(value_n, (select avg(value_n) from dd)) as value_n, ts_dmy from dd),
lim as (select {_fence} from mv),
fl as (select mv.*, {", ".join(f"coalesce({c} < {c}__lo or {c} > {c}__hi, false) as {c}__outlier" for c in _NUM)}
       from mv cross join lim),
nf as (select {", ".join(f"count_if({c}__outlier) as {c}__nf" for c in _NUM)} from fl),
tr as (select event_id, ts, {", ".join(
    f"case when {c}__nf > 0 and {c} is not null then greatest(least({c}, {c}__hi), {c}__lo) else {c} end as {c}"
    for c in ["user_id", "value_n"])}, event_type_n, ts_dmy,
    case when event_id__nf > 0 then greatest(least(event_id, event_id__hi), event_id__lo) else event_id end as event_id2
    from mv cross join lim cross join nf),
sc as (select {", ".join(f"avg({c}) as {c}__m, stddev_pop({c}) as {c}__s" for c in ["event_id2", "user_id", "value_n"])}
       from tr)"""


def _z(c, src=None):
    src = src or c
    return (f"{r(f'({src} - {c}__m) / (case when {c}__s is null or {c}__s = 0 then 1.0 else {c}__s end)')}")


SQL = {
    "pipeline_output": _STAGES + f"""
select {_z('event_id2')} as event_id, ts, {_z('user_id')} as user_id, {_z('value_n')} as value_n, ts_dmy,
       coalesce((event_type_n = 'error')::integer, 0) as event_type_n_error,
       coalesce((event_type_n = 'purchase')::integer, 0) as event_type_n_purchase,
       coalesce((event_type_n = 'signup')::integer, 0) as event_type_n_signup,
       coalesce((event_type_n = 'view')::integer, 0) as event_type_n_view
from tr cross join sc""",
    "pipeline_outlier_report": _STAGES + "\n" + "\nunion all\n".join(
        f"select {i} as position, '{c}' as column, count_if({c}__outlier)::bigint as n_outliers, "
        f"round_even(count_if({c}__outlier) * 100.0 / count(*), 2)::double as pct from fl"
        for i, c in enumerate(_NUM)),
}
