"""SPC chart queries (I2-I12) on lineitem and events, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import spc
from kiln.workloads import r, rounded, table
from kiln.workloads.sqlrules import count_exprs, factor_sql, ooc_expr, rule_exprs

XR_POINT_COLS = ["l_orderkey", "point_index", "xbar", "range", "size", "x_cl", "x_ucl", "x_lcl",
                 "x_rule1", "x_rule2", "x_rule3", "x_rule4", "x_ooc",
                 "r_cl", "r_ucl", "r_lcl", "r_rule1", "r_rule2", "r_rule3", "r_rule4", "r_ooc"]


def _li(spark, sf):
    return table(spark, sf, "lineitem")


def xbar_r_points(spark, sf):
    res = spc.xbar_r_chart(_li(spark, sf), "l_quantity", "l_orderkey")
    return rounded(res.points.select(*XR_POINT_COLS))


def xbar_r_stats(spark, sf, lower="lcl"):
    return rounded(spc.xbar_r_chart(_li(spark, sf), "l_quantity", "l_orderkey",
                                    rule1_lower=lower).stats)


def xbar_r_stats_by(spark, sf):
    return rounded(spc.xbar_r_chart(_li(spark, sf), "l_extendedprice", "l_orderkey",
                                    by=["l_returnflag"]).stats, 4)


def xbar_s_stats(spark, sf):
    return rounded(spc.xbar_s_chart(_li(spark, sf), "l_extendedprice", "l_orderkey").stats, 4)


def xbar_s_points(spark, sf):
    p = spc.xbar_s_chart(_li(spark, sf), "l_extendedprice", "l_orderkey").points
    return rounded(p.select("l_orderkey", "point_index", "xbar", "s", "size", "s_ucl", "s_lcl",
                            "x_rule1", "x_rule2", "x_rule3", "x_rule4",
                            "s_rule1", "s_rule2", "s_rule3", "s_rule4", "x_ooc", "s_ooc"))


def _events(spark, sf):
    return table(spark, sf, "events")


def imr_points(spark, sf):
    p = spc.imr_chart(_events(spark, sf), "value", ["ts", "event_id"]).points
    return rounded(p.select("event_id", "point_index", "value", "mr", "i_ucl", "i_lcl",
                            "i_rule1", "i_rule2", "i_rule3", "i_rule4", "i_ooc",
                            "mr_rule1", "mr_rule2", "mr_rule3", "mr_rule4", "mr_ooc"))


def imr_stats(spark, sf):
    return rounded(spc.imr_chart(_events(spark, sf), "value", ["ts", "event_id"]).stats)


def imr_stats_by_type(spark, sf):
    return rounded(spc.imr_chart(_events(spark, sf), "value", ["ts", "event_id"],
                                 by=["event_type"]).stats)


def _daily_errors(spark, sf):
    e = _events(spark, sf)
    return e.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"),
                    (F.col("event_type") == "error").cast("int").alias("is_error"),
                    F.lit(1).alias("one"))


def p_points(spark, sf):
    p = spc.p_chart(_daily_errors(spark, sf), "is_error", "one", subgroup_col="day").points
    return rounded(p.select("day", "point_index", "n_defective", "n_total", "p", "ucl", "lcl", "ooc"))


def p_stats(spark, sf):
    return rounded(spc.p_chart(_daily_errors(spark, sf), "is_error", "one", subgroup_col="day").stats)


def p_returns_by_month(spark, sf):
    """Share of returned lines per order month (lineitem joined to orders)."""
    li = _li(spark, sf).select("l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("ret"))
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"))
    d = li.join(o, li.l_orderkey == o.o_orderkey).withColumn("one", F.lit(1))
    res = spc.p_chart(d, "ret", "one", subgroup_col="month")
    return rounded(res.points.select("month", "point_index", "n_defective", "n_total", "p", "ucl",
                                     "lcl", "ooc"))


def p_rows_stats(spark, sf):
    """Ungrouped P chart: every order is a point (returned lines / lines)."""
    li = _li(spark, sf).groupBy("l_orderkey").agg(
        F.sum((F.col("l_returnflag") == "R").cast("int")).alias("ret"), F.count("*").alias("n"))
    return rounded(spc.p_chart(li, "ret", "n", order_by=["l_orderkey"]).stats)


def c_points(spark, sf):
    p = spc.c_chart(_daily_errors(spark, sf), "is_error", subgroup_col="day").points
    return rounded(p.select("day", "point_index", "c", "c_cl", "c_ucl", "c_lcl", "c_rule1", "c_rule2",
                            "c_rule3", "c_rule4", "c_ooc"))


def dispatch_c_points(spark, sf):
    """The chart dispatcher by name (C chart falls back to value_col)."""
    res = spc.control_chart(_daily_errors(spark, sf), "C Chart", value_col="is_error", subgroup_col="day")
    return rounded(res.points.select("day", "point_index", "c", "c_cl", "c_ucl", "c_lcl", "c_rule1", "c_rule2",
                                     "c_rule3", "c_rule4", "c_ooc"))


def c_rows_stats(spark, sf):
    res = spc.c_chart(_li(spark, sf), "l_linenumber", order_by=["l_orderkey", "l_linenumber"])
    return rounded(res.stats)


QUERIES = {
    "spc_xbar_r_points": xbar_r_points,
    "spc_xbar_r_stats": xbar_r_stats,
    "spc_xbar_r_stats_literal": lambda s, d: xbar_r_stats(s, d, "center"),
    "spc_xbar_r_stats_by": xbar_r_stats_by,
    "spc_xbar_s_points": xbar_s_points,
    "spc_xbar_s_stats": xbar_s_stats,
    "spc_imr_points": imr_points,
    "spc_imr_stats": imr_stats,
    "spc_imr_stats_by_type": imr_stats_by_type,
    "spc_p_points": p_points,
    "spc_p_stats": p_stats,
    "spc_p_returns_by_month": p_returns_by_month,
    "spc_p_rows_stats": p_rows_stats,
    "spc_c_points": c_points,
    "spc_c_rows_stats": c_rows_stats,
    "spc_dispatch_c_points": dispatch_c_points,
}

# ---------------------------------------------------------------- SQL twins


def _xbar_sql(value, stat, stat_expr, cl_name, factors, lower="lcl", by=None, digits=6):
    """Shared SQL for X-bar/R and X-bar/S over lineitem (subgroup l_orderkey)."""
    byc = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    join_on = f"using ({by})" if by else "on true"
    return f"""
with g as (
  select {byc}l_orderkey, avg({value}) as xbar, {stat_expr} as {stat}, count(*) as size
  from lineitem where l_orderkey is not null group by {byc}l_orderkey),
s0 as (
  select {byc}count(*) as n_subgroups, cast(floor(quantile_cont(size, 0.5)) as integer) as subgroup_size,
         avg(xbar) as x_double_bar, avg({stat}) as {cl_name}
  from g {'group by ' + by if by else ''}),
s as (select *, {factors} from s0),
p as (
  select g.*, row_number() over ({part}order by l_orderkey) - 1 as point_index,
         s.x_double_bar as x_cl, s.ucl_x as x_ucl, s.lcl_x as x_lcl,
         s.{cl_name} as {stat[0]}_cl, s.ucl_{stat[0]} as {stat[0]}_ucl, s.lcl_{stat[0]} as {stat[0]}_lcl
  from g join s {join_on}),
f0 as (
  select p.*, {", ".join(rule_exprs("x_", "xbar", "x_cl", "x_ucl", "x_lcl" if lower == "lcl" else "x_cl"))},
         {", ".join(rule_exprs(stat[0] + "_", stat, stat[0] + "_cl", stat[0] + "_ucl",
                               stat[0] + "_lcl" if lower == "lcl" else stat[0] + "_cl"))}
  from p window w as ({part}order by point_index)),
f as (select *, {ooc_expr("x_")}, {ooc_expr(stat[0] + "_")} from f0)
"""


XR_FACTORS = (f"x_double_bar + {factor_sql('A2', 'subgroup_size')} * r_bar as ucl_x, "
              f"x_double_bar - {factor_sql('A2', 'subgroup_size')} * r_bar as lcl_x, "
              f"r_bar + ({factor_sql('D4', 'subgroup_size')} * r_bar - r_bar) as ucl_r, "
              f"greatest(0.0, r_bar - (r_bar - {factor_sql('D3', 'subgroup_size')} * r_bar)) as lcl_r, "
              f"case when r_bar > 0 then (x_double_bar + {factor_sql('A2', 'subgroup_size')} * r_bar - "
              f"(x_double_bar - {factor_sql('A2', 'subgroup_size')} * r_bar)) / "
              f"(6 * r_bar / {factor_sql('d2', 'subgroup_size')}) end as cp_estimate")
XS_FACTORS = (f"x_double_bar + {factor_sql('A3', 'subgroup_size')} * s_bar as ucl_x, "
              f"x_double_bar - {factor_sql('A3', 'subgroup_size')} * s_bar as lcl_x, "
              f"{factor_sql('B4', 'subgroup_size')} * s_bar as ucl_s, "
              f"{factor_sql('B3', 'subgroup_size')} * s_bar as lcl_s")


def _xr_stats_sql(lower="lcl", value="l_quantity", by=None, digits=6):
    byc = f"s.{by}, " if by else ""
    join_on = f"using ({by})" if by else "on true"
    grp = f"group by {by}" if by else ""
    cnt_sel = f"{by}, " if by else ""
    return _xbar_sql(value, "range", "max(%s) - min(%s)" % (value, value), "r_bar", XR_FACTORS,
                     lower, by) + f"""
, c as (select {cnt_sel}{", ".join(count_exprs("x_") + count_exprs("r_"))} from f {grp})
select {byc}s.n_subgroups, s.subgroup_size, {r("s.x_double_bar", digits)} as x_double_bar,
       {r("s.r_bar", digits)} as r_bar, {r("s.ucl_x", digits)} as ucl_x, {r("s.lcl_x", digits)} as lcl_x,
       {r("s.ucl_r", digits)} as ucl_r, {r("s.lcl_r", digits)} as lcl_r,
       {r("s.cp_estimate", digits)} as cp_estimate, c.* {'exclude (' + by + ')' if by else ''}
from s join c {join_on}"""


SQL = {
    "spc_xbar_r_points": _xbar_sql("l_quantity", "range", "max(l_quantity) - min(l_quantity)", "r_bar",
                                   XR_FACTORS) + f"""
select l_orderkey, point_index, {r("xbar")} as xbar, {r("range")} as range, size,
       {r("x_cl")} as x_cl, {r("x_ucl")} as x_ucl, {r("x_lcl")} as x_lcl,
       x_rule1, x_rule2, x_rule3, x_rule4, x_ooc, {r("r_cl")} as r_cl, {r("r_ucl")} as r_ucl,
       {r("r_lcl")} as r_lcl, r_rule1, r_rule2, r_rule3, r_rule4, r_ooc from f""",
    "spc_xbar_r_stats": _xr_stats_sql("lcl"),
    "spc_xbar_r_stats_literal": _xr_stats_sql("center"),
    "spc_xbar_r_stats_by": _xr_stats_sql("lcl", "l_extendedprice", "l_returnflag", 4),
    "spc_xbar_s_points": _xbar_sql("l_extendedprice", "s", "coalesce(stddev_samp(l_extendedprice), 0.0)",
                                   "s_bar", XS_FACTORS) + f"""
select l_orderkey, point_index, {r("xbar")} as xbar, {r("s")} as s, size, {r("s_ucl")} as s_ucl,
       {r("s_lcl")} as s_lcl, x_rule1, x_rule2, x_rule3, x_rule4, s_rule1, s_rule2, s_rule3, s_rule4,
       x_ooc, s_ooc from f""",
    "spc_xbar_s_stats": _xbar_sql("l_extendedprice", "s", "coalesce(stddev_samp(l_extendedprice), 0.0)",
                                  "s_bar", XS_FACTORS) + f"""
, c as (select {", ".join(count_exprs("x_") + count_exprs("s_"))} from f)
select s.n_subgroups, s.subgroup_size, {r("s.x_double_bar", 4)} as x_double_bar, {r("s.s_bar", 4)} as s_bar,
       {r("s.ucl_x", 4)} as ucl_x, {r("s.lcl_x", 4)} as lcl_x, {r("s.ucl_s", 4)} as ucl_s,
       {r("s.lcl_s", 4)} as lcl_s, c.*
from s cross join c""",
}


def _imr_sql(by=None):
    part = f"partition by {by} " if by else ""
    byc = f"{by}, " if by else ""
    grp = f"group by {by}" if by else ""
    join_on = f"using ({by})" if by else "on true"
    return f"""
with d as (
  select {byc}event_id, ts, value, row_number() over ({part}order by ts, event_id) - 1 as point_index
  from events where value is not null),
m as (select d.*, abs(value - lag(value) over ({part}order by point_index)) as mr from d),
s0 as (select {byc}count(*) as n_points, avg(value) as x_bar, avg(mr) as mr_bar from m {grp}),
s as (select *, mr_bar / 1.128 as sigma_hat, x_bar + 3 * (mr_bar / 1.128) as ucl_i,
             x_bar - 3 * (mr_bar / 1.128) as lcl_i, 3.267 * mr_bar as ucl_mr, 0.0::double as lcl_mr from s0),
p as (select m.*, s.x_bar as i_cl, s.ucl_i as i_ucl, s.lcl_i as i_lcl, s.mr_bar as mr_cl,
             s.ucl_mr as mr_ucl, s.lcl_mr as mr_lcl from m join s {join_on}),
f0 as (select p.*, {", ".join(rule_exprs("i_", "value", "i_cl", "i_ucl", "i_lcl"))},
              {", ".join(rule_exprs("mr_", "mr", "mr_cl", "mr_ucl", "mr_lcl", mr_of="value"))}
       from p window w as ({part}order by point_index)),
f as (select *, {ooc_expr("i_")}, {ooc_expr("mr_")} from f0)
"""


def _imr_stats_sql(by=None):
    byc = f"s.{by}, " if by else ""
    grp = f"group by {by}" if by else ""
    sel = f"{by}, " if by else ""
    join_on = f"using ({by})" if by else "on true"
    return _imr_sql(by) + f"""
, c as (select {sel}{", ".join(count_exprs("i_") + count_exprs("mr_"))} from f {grp})
select {byc}s.n_points, {r("s.x_bar")} as x_bar, {r("s.mr_bar")} as mr_bar, {r("s.sigma_hat")} as sigma_hat,
       {r("s.ucl_i")} as ucl_i, {r("s.lcl_i")} as lcl_i, {r("s.ucl_mr")} as ucl_mr, {r("s.lcl_mr")} as lcl_mr,
       c.* {'exclude (' + by + ')' if by else ''}
from s join c {join_on}"""


SQL["spc_imr_points"] = _imr_sql() + f"""
select event_id, point_index, {r("value")} as value, {r("mr")} as mr, {r("i_ucl")} as i_ucl,
       {r("i_lcl")} as i_lcl, i_rule1, i_rule2, i_rule3, i_rule4, i_ooc,
       mr_rule1, mr_rule2, mr_rule3, mr_rule4, mr_ooc from f"""
SQL["spc_imr_stats"] = _imr_stats_sql()
SQL["spc_imr_stats_by_type"] = _imr_stats_sql("event_type")

_DAILY = """daily as (
  select date_trunc('day', ts)::timestamp as day, cast(event_type = 'error' as integer) as is_error,
         1 as one from events)"""


def _p_sql(src, key, dcol, ncol):
    return f"""
with {src},
g as (select {key}, coalesce(sum({dcol}), 0) as n_defective, coalesce(sum({ncol}), 0) as n_total
      from base where {key} is not null group by {key}),
s as (select count(*) as n_subgroups, sum(n_defective)::double / sum(n_total)::double as p_bar from g),
p as (select g.*, row_number() over (order by {key}) - 1 as point_index, s.p_bar,
             n_defective::double / n_total::double as p,
             s.p_bar + 3 * sqrt(s.p_bar * (1 - s.p_bar) / n_total::double) as ucl,
             greatest(0.0, s.p_bar - 3 * sqrt(s.p_bar * (1 - s.p_bar) / n_total::double)) as lcl
      from g cross join s),
f as (select *, coalesce(p > ucl or p < lcl, false) as ooc from p)
"""


_P_DAILY = _p_sql(_DAILY + ", base as (select * from daily)", "day", "is_error", "one")
SQL["spc_p_points"] = _P_DAILY + f"""
select day, point_index, cast(n_defective as bigint) as n_defective, cast(n_total as bigint) as n_total,
       {r("p")} as p, {r("ucl")} as ucl, {r("lcl")} as lcl, ooc from f"""
SQL["spc_p_stats"] = _P_DAILY + f"""
select s.n_subgroups, {r("s.p_bar")} as p_bar, (select cast(count_if(ooc) as bigint) from f) as n_ooc_points
from s"""
SQL["spc_p_returns_by_month"] = _p_sql(
    """base as (select date_trunc('month', o.o_orderdate)::timestamp as month,
                       cast(l.l_returnflag = 'R' as integer) as ret, 1 as one
                from lineitem l join orders o on l.l_orderkey = o.o_orderkey)""",
    "month", "ret", "one") + f"""
select month, point_index, cast(n_defective as bigint) as n_defective, cast(n_total as bigint) as n_total,
       {r("p")} as p, {r("ucl")} as ucl, {r("lcl")} as lcl, ooc from f"""
SQL["spc_p_rows_stats"] = f"""
with g as (select l_orderkey, cast(sum(cast(l_returnflag = 'R' as integer)) as bigint) as ret,
                  count(*) as n from lineitem group by l_orderkey),
s as (select count(*) as n_subgroups, sum(ret)::double / sum(n)::double as p_bar from g),
f as (select coalesce(ret::double / n > s.p_bar + 3 * sqrt(s.p_bar * (1 - s.p_bar) / n)
                      or ret::double / n < greatest(0.0, s.p_bar - 3 * sqrt(s.p_bar * (1 - s.p_bar) / n)),
                      false) as ooc from g cross join s)
select s.n_subgroups, {r("s.p_bar")} as p_bar, (select cast(count_if(ooc) as bigint) from f) as n_ooc_points
from s"""


def _c_sql(src, order, where=""):
    return f"""
with {src},
s as (select count(*) as n_points, avg(c::double) as c_bar from g),
s2 as (select *, c_bar + 3 * sqrt(c_bar) as ucl, greatest(0.0, c_bar - 3 * sqrt(c_bar)) as lcl from s),
p as (select g.*, row_number() over (order by {order}) - 1 as point_index, s2.c_bar as c_cl,
             s2.ucl as c_ucl, s2.lcl as c_lcl from g cross join s2),
f0 as (select p.*, {", ".join(rule_exprs("c_", "c", "c_cl", "c_ucl", "c_lcl"))}
       from p window w as (order by point_index)),
f as (select *, {ooc_expr("c_")} from f0)
"""


SQL["spc_c_points"] = _c_sql(
    _DAILY + ", g as (select day, coalesce(sum(is_error), 0) as c from daily where day is not null group by day)",
    "day") + f"""
select day, point_index, cast(c as bigint) as c, {r("c_cl")} as c_cl, {r("c_ucl")} as c_ucl,
       {r("c_lcl")} as c_lcl, c_rule1, c_rule2, c_rule3, c_rule4, c_ooc from f"""
SQL["spc_c_rows_stats"] = _c_sql(
    "g as (select l_orderkey, l_linenumber, l_linenumber as c from lineitem where l_linenumber is not null)",
    "l_orderkey, l_linenumber") + f"""
, c as (select {", ".join(count_exprs("c_"))} from f)
select s2.n_points, {r("s2.c_bar")} as c_bar, {r("s2.ucl")} as ucl, {r("s2.lcl")} as lcl, c.*
from s2 cross join c"""

SQL["spc_dispatch_c_points"] = SQL["spc_c_points"]
