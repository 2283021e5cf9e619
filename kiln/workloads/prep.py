"""Outlier, encoding and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import encode as enc
from kiln.operators import outliers as out
from kiln.workloads import r, rounded, table

OUT_COLS = ["value_o", "value_n", "user_id"]


def events_outliers(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        F.when(F.col("event_id") % 500 == 0, F.col("value") * 100).otherwise(F.col("value")).alias("value_o"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value")).alias("value_n"),
        "user_id")


EV_OUT_SQL = """ev as (select event_id,
  case when event_id % 500 = 0 then value * 100 else value end as value_o,
  case when event_id % 7 = 0 then null else value end as value_n, user_id from events)"""


def _detect(spark, sf, method, t):
    return out.detect_outliers(events_outliers(spark, sf), OUT_COLS, method, t)


def _treated(spark, sf, how):
    flagged, _ = _detect(spark, sf, "iqr", 1.5)
    return rounded(out.treat_outliers(flagged, OUT_COLS, how))


def _clipped_whole(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.floor(F.col("value") * 4).cast("long").alias("quarters"))
    flagged, _ = out.detect_outliers(e, ["quarters"], "iqr", 1.5)
    return rounded(out.treat_outliers(flagged, ["quarters"], "clip"))


LI_SCALE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scaled(spark, sf, method):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LI_SCALE)
    return rounded(enc.scale_features(li, LI_SCALE, method)[0])


def _onehot_lineitem(spark, sf, method="onehot"):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
                                             "l_quantity")
    return enc.encode_categoricals(li, ["l_returnflag", "l_linestatus"], method)


def _part_encoded(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return enc.encode_categoricals(p, ["p_brand", "p_type"], "onehot")


QUERIES = {
    "outliers_iqr_report": lambda s, d: _detect(s, d, "iqr", 1.5)[1],
    "outliers_zscore_report": lambda s, d: _detect(s, d, "zscore", 2.0)[1],
    "outliers_iqr_flags": lambda s, d: _detect(s, d, "iqr", 1.5)[0].select(
        "event_id", *[f"{c}__outlier" for c in OUT_COLS]),
    "outliers_zscore_flags": lambda s, d: _detect(s, d, "zscore", 2.0)[0].select(
        "event_id", *[f"{c}__outlier" for c in OUT_COLS]),
    "outliers_clip": lambda s, d: _treated(s, d, "clip"),
    "outliers_clip_whole": _clipped_whole,
    "outliers_remove": lambda s, d: _treated(s, d, "remove"),
    "outliers_winsorize": lambda s, d: _treated(s, d, "winsorize"),
    "encode_onehot": lambda s, d: rounded(_onehot_lineitem(s, d)[0]),
    "encode_label": lambda s, d: rounded(_onehot_lineitem(s, d, "label")[0]),
    "encode_mixed": lambda s, d: _part_encoded(s, d)[0],
    "encode_map": lambda s, d: _part_encoded(s, d)[1],
    "scale_standard": lambda s, d: _scaled(s, d, "standard"),
    "scale_minmax": lambda s, d: _scaled(s, d, "minmax"),
    "scale_robust": lambda s, d: _scaled(s, d, "robust"),
}


def _fences_sql(k=1.5):
    return ", ".join(
        f"quantile_cont({c}, 0.25) - {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as {c}__lo, "
        f"quantile_cont({c}, 0.75) + {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as {c}__hi"
        for c in OUT_COLS)


_IQR_FLAGS = f"""with {EV_OUT_SQL}, lim as (select {_fences_sql()} from ev),
fl as (select ev.*, {", ".join(f"coalesce({c} < {c}__lo or {c} > {c}__hi, false) as {c}__outlier" for c in OUT_COLS)}
       from ev cross join lim)"""
_Z_FLAGS = f"""with {EV_OUT_SQL}, lim as (select {", ".join(f"avg({c}) as {c}__mu, stddev_pop({c}) as {c}__sd" for c in OUT_COLS)} from ev),
fl as (select ev.*, {", ".join(f"coalesce(abs(({c} - {c}__mu) / nullif({c}__sd, 0)) > 2.0, false) as {c}__outlier" for c in OUT_COLS)}
       from ev cross join lim)"""


def _report_sql(flags):
    return flags + "\n" + "\nunion all\n".join(
        f"select {i} as position, '{c}' as column, count_if({c}__outlier)::bigint as n_outliers, "
        f"round_even(count_if({c}__outlier) * 100.0 / count(*), 2)::double as pct from fl"
        for i, c in enumerate(OUT_COLS))


def _treat_sql(kind):
    cnt = ", ".join(f"count_if({c}__outlier) as {c}__nf" for c in OUT_COLS)
    if kind == "remove":
        any_flag = " or ".join(f"{c}__outlier" for c in OUT_COLS)
        return _IQR_FLAGS + f"""
select event_id, {", ".join(f"{r(c)} as {c}" for c in OUT_COLS)} from fl where not ({any_flag})"""
    if kind == "clip":
        lim = f"lim2 as (select {_fences_sql()} from ev)"
    else:
        parts = []
        for c in OUT_COLS:
            parts.append(f"""(select {c} from (select {c}, row_number() over (order by {c}) - 1 as rn,
                      count(*) over () as n from ev where {c} is not null) where rn = floor(n * 0.05)) as {c}__lo,
            (select {c} from (select {c}, row_number() over (order by {c}) - 1 as rn,
                      count(*) over () as n from ev where {c} is not null) where rn = n - 1 - floor(n * 0.05)) as {c}__hi""")
        lim = "lim2 as (select " + ", ".join(parts) + ")"
    sel = ", ".join(
        f"{r(f'case when {c}__nf > 0 and {c} is not null then greatest(least({c}, {c}__hi), {c}__lo) else {c} end')}"
        f"{'::bigint' if c == 'user_id' and kind != 'clip' else ''} as {c}" for c in OUT_COLS)
    return _IQR_FLAGS + f""", {lim}, nf as (select {cnt} from fl)
select event_id, {sel} from ev cross join lim2 cross join nf"""


SQL = {
    "outliers_iqr_report": _report_sql(_IQR_FLAGS),
    "outliers_zscore_report": _report_sql(_Z_FLAGS),
    "outliers_iqr_flags": _IQR_FLAGS + f"\nselect event_id, {', '.join(c + '__outlier' for c in OUT_COLS)} from fl",
    "outliers_zscore_flags": _Z_FLAGS + f"\nselect event_id, {', '.join(c + '__outlier' for c in OUT_COLS)} from fl",
    "outliers_clip": _treat_sql("clip"),
    "outliers_clip_whole": f"""with ev as (select event_id, floor(value * 4)::bigint as quarters from events),
q as (select quantile_cont(quarters, 0.25) as a, quantile_cont(quarters, 0.75) as b from ev)
select event_id, {r("greatest(least(quarters, b + 1.5 * (b - a)), a - 1.5 * (b - a))::double")} as quarters from ev cross join q""",
    "outliers_remove": _treat_sql("remove"),
    "outliers_winsorize": _treat_sql("winsorize"),
    "encode_onehot": f"""select l_orderkey, l_linenumber, {r("l_quantity")} as l_quantity,
       coalesce((l_returnflag = 'N')::integer, 0) as l_returnflag_N,
       coalesce((l_returnflag = 'R')::integer, 0) as l_returnflag_R,
       coalesce((l_linestatus = 'O')::integer, 0) as l_linestatus_O from lineitem""",
    "encode_label": f"""select l_orderkey, l_linenumber, {r("l_quantity")} as l_quantity,
       dense_rank() over (order by coalesce(l_returnflag, 'nan')) - 1 as l_returnflag,
       dense_rank() over (order by coalesce(l_linestatus, 'nan')) - 1 as l_linestatus from lineitem""",
}


SQL["encode_map"] = """
select 'p_type' as column, 'onehot' as method, p_type as category,
       row_number() over (order by p_type) - 1 as code,
       case when row_number() over (order by p_type) = 1 then null else 'p_type_' || p_type end as output_column
from (select distinct p_type from part where p_type is not null)
union all
select 'p_brand', 'label', category, row_number() over (order by category) - 1, 'p_brand'
from (select distinct coalesce(p_brand, 'nan') as category from part)"""


def _scale_sql(method):
    if method == "standard":
        lim = ", ".join(f"avg({c}) as {c}__c, stddev_pop({c}) as {c}__r" for c in LI_SCALE)
    elif method == "minmax":
        lim = ", ".join(f"min({c}) as {c}__c, max({c}) - min({c}) as {c}__r" for c in LI_SCALE)
    else:
        lim = ", ".join(f"quantile_cont({c}, 0.5) as {c}__c, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) "
                        f"as {c}__r" for c in LI_SCALE)
    sel = ", ".join(f"{r(f'({c} - {c}__c) / (case when {c}__r is null or {c}__r = 0 then 1.0 else {c}__r end)')} as {c}"
                    for c in LI_SCALE)
    return f"""with lim as (select {lim} from lineitem)
select l_orderkey, l_linenumber, {sel} from lineitem cross join lim"""


for _m in ("standard", "minmax", "robust"):
    SQL[f"scale_{_m}"] = _scale_sql(_m)
