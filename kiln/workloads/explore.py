"""Correlation and distribution queries."""

from __future__ import annotations


from kiln.operators import corr as co
from kiln.operators import dist
from kiln.workloads import r, rounded, table
from kiln.workloads.common import EVENTS_DIRTY_SQL, events_dirty
from kiln.workloads.prep import EV_OUT_SQL, events_outliers

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]
EV_NUM = ["event_id", "user_id", "value", "value_n", "const"]
PART_NUM = ["p_partkey", "p_size", "p_retailprice"]


QUERIES = {
    "corr_pearson": lambda s, d: rounded(co.correlation_matrix(table(s, d, "lineitem"), "pearson")),
    "corr_pearson_nulls": lambda s, d: rounded(co.correlation_matrix(events_dirty(s, d), "pearson")),
    "corr_spearman": lambda s, d: rounded(co.correlation_matrix(events_dirty(s, d), "spearman")),
    "corr_kendall": lambda s, d: rounded(co.correlation_matrix(table(s, d, "part"), "kendall")),
    "corr_lower_triangle": lambda s, d: rounded(co.lower_triangle(
        co.correlation_matrix(table(s, d, "lineitem"), "pearson"))),
    "hist_columns": lambda s, d: rounded(dist.histogram(table(s, d, "lineitem"))),
    "hist_density_by_group": lambda s, d: rounded(dist.histogram(
        table(s, d, "events"), ["value"], group_by="event_type", density=True)),
    "kde_grid": lambda s, d: rounded(dist.kde(table(s, d, "events"), ["value"])),
    "kde_grid_binned": lambda s, d: rounded(dist.kde(table(s, d, "lineitem"), binned=1024)),
    "box_by_category": lambda s, d: rounded(dist.box_stats_by_category(
        table(s, d, "lineitem"), "l_extendedprice", "l_returnflag")[0]),
    "box_outlier_points": lambda s, d: rounded(dist.box_stats_by_category(
        events_outliers(s, d).join(table(s, d, "events").select("event_id", "event_type"), "event_id"),
        "value_o", "event_type")[1]),
    "hist_violin_margin": lambda s, d: rounded(dist.box_stats_by_category(
        table(s, d, "events"), "value", "event_type")[0]),
    "box_columns": lambda s, d: rounded(dist.box_stats_columns(table(s, d, "lineitem"))[0],
                                        per_column={"mean": 9}),
    "scatter_matrix_bins": lambda s, d: dist.scatter_matrix(table(s, d, "lineitem")),
    "pairplot_cells": lambda s, d: dist.pair_plot(events_dirty(s, d), hue="event_type")[0],
    "pairplot_kde": lambda s, d: rounded(dist.pair_plot(events_dirty(s, d), hue="event_type")[1]),
}


def _corr_sql(src, cols, cell, cte="", diag="pearson"):
    """``cell(a, b)`` gives the SQL of r for the pair (a before b)."""
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                if diag == "kendall":
                    v = f"case when count({a}) >= 1 then 1.0 end"
                else:
                    v = f"case when count({a}) >= 2 and stddev_pop({a}) > 0 then 1.0 end"
                parts.append(f"select '{a}' as column_a, '{b}' as column_b, {i} as pos_a, {j} as pos_b, "
                             f"{r(v)} as r from {src}")
            else:
                x, y = (a, b) if i < j else (b, a)
                parts.append(f"select '{a}' as column_a, '{b}' as column_b, {i} as pos_a, {j} as pos_b, "
                             f"({cell(x, y)}) as r")
    return (f"with {cte}\n" if cte else "") + "\nunion all\n".join(parts)


def _pearson(src):
    return lambda x, y: (f"select {r(f'case when isnan(corr({x}, {y})) then null else corr({x}, {y}) end')} "
                         f"from {src}")


def _spearman(src):
    def cell(x, y):
        return f"""select {r('case when isnan(corr(rx, ry)) then null else corr(rx, ry) end')} from (
  select (rank() over (order by {x}) + (count(*) over (partition by {x}) - 1) / 2.0) as rx,
         (rank() over (order by {y}) + (count(*) over (partition by {y}) - 1) / 2.0) as ry
  from {src} where {x} is not null and {y} is not null)"""
    return cell


def _kendall(src):
    def cell(x, y):
        return f"""select {r('(c - dd) / sqrt((c + dd + tx) * (c + dd + ty))')} from (
  select sum(case when sign(a.x - b.x) * sign(a.y - b.y) > 0 then 1 else 0 end)::double as c,
         sum(case when sign(a.x - b.x) * sign(a.y - b.y) < 0 then 1 else 0 end)::double as dd,
         sum(case when a.x = b.x and a.y <> b.y then 1 else 0 end)::double as tx,
         sum(case when a.y = b.y and a.x <> b.x then 1 else 0 end)::double as ty
  from (select row_number() over () as id, {x}::double as x, {y}::double as y from {src}
        where {x} is not null and {y} is not null) a
  join (select row_number() over () as id, {x}::double as x, {y}::double as y from {src}
        where {x} is not null and {y} is not null) b on a.id < b.id)"""
    return cell


SQL = {
    "corr_pearson": _corr_sql("lineitem", LI_NUM, _pearson("lineitem")),
    "corr_pearson_nulls": _corr_sql("ev", EV_NUM, _pearson("ev"), EVENTS_DIRTY_SQL),
    "corr_spearman": _corr_sql("ev", EV_NUM, _spearman("ev"), EVENTS_DIRTY_SQL),
    "corr_kendall": _corr_sql("p", PART_NUM, _kendall("p"), "p as (select * from part)", diag="kendall"),
}
SQL["corr_lower_triangle"] = f"select * from ({SQL['corr_pearson']}) where pos_a > pos_b"


def _hist_sql(src, cols, bins=30, group=None, density=False, cte=""):
    g = f"{group}, " if group else ""
    longs = "\nunion all\n".join(f"select {g}'{c}' as column, {c}::double as value from {src} where {c} is not null"
                                 for c in cols)
    dens = ""
    if density:
        dens = f", {r('coalesce(c.cnt, 0) / (t.tot * ((rg.hi - rg.lo) / 30.0))')} as density"
    gj = f'join (select distinct {group}, "column" from l) gr using ("column")' if group else ""
    tj = f'join (select {g}"column", count(*) as tot from l group by {g}"column") t using ({g}"column")' if density else ""
    return f"""with {cte + ',' if cte else ''} l as ({longs}),
rg0 as (select "column", min(value) as mn, max(value) as mx from l group by "column"),
rg as (select "column", case when mn = mx then mn - 0.5 else mn end as lo,
              case when mn = mx then mx + 0.5 else mx end as hi from rg0),
b as (select {g}l."column", least(floor((value - lo) * {bins} / (hi - lo))::integer, {bins - 1}) as bin
      from l join rg using ("column")),
c as (select {g}"column", bin, count(*) as cnt from b group by {g}"column", bin),
grid as (select "column", lo, hi, unnest(range(0, {bins})) as bin from rg)
select {'gr.' + group + ', ' if group else ''}grid."column", grid.bin::integer as bin,
       {r(f'grid.lo + grid.bin * (grid.hi - grid.lo) / {bins}.0')} as lower,
       {r(f'grid.lo + (grid.bin + 1) * (grid.hi - grid.lo) / {bins}.0')} as upper,
       coalesce(c.cnt, 0) as count{dens.replace('rg.', 'grid.')}
from grid {gj} left join c on c."column" = grid."column" and c.bin = grid.bin
     {'and c.' + group + ' = gr.' + group if group else ''} {tj.replace('using (' + g + '"column")', 'on t."column" = grid."column"' + (' and t.' + group + ' = gr.' + group if group else '')) if density else ''}"""


SQL["hist_columns"] = _hist_sql("lineitem", LI_NUM)
SQL["hist_density_by_group"] = _hist_sql("events", ["value"], group="event_type", density=True)
SQL["kde_grid"] = f"""with st as (select min(value) as mn, max(value) as mx, count(value) as n,
       stddev_samp(value) * pow(count(value)::double, -0.2) as h from events where value is not null),
g as (select unnest(range(0, 200)) as point)
select 'value' as column, g.point::integer as point, {r('any_value(st.mn) + (any_value(st.mx) - any_value(st.mn)) / 199.0 * g.point')} as x,
       {r('sum(exp(-0.5 * power((st.mn + (st.mx - st.mn) / 199.0 * g.point - e.value) / st.h, 2))) / (any_value(st.n) * any_value(st.h) * sqrt(2 * pi()))')} as density
from events e cross join st cross join g where e.value is not null group by g.point"""

SQL["kde_grid_binned"] = f"""with l as (""" + "\nunion all\n".join(
    f"select '{c}' as column, {c}::double as value from lineitem where {c} is not null" for c in LI_NUM) + f"""),
st as (select "column", min(value) as mn, max(value) as mx, count(*) as n,
              stddev_samp(value) * pow(count(*)::double, -0.2) as h from l group by "column"),
p as (select "column", (value - mn) * 1024 / (mx - mn) as place from l join st using ("column")),
b as (select "column", least(floor(place), 1023)::integer as bin, place - least(floor(place), 1023) as part from p),
e as (select "column", edge, sum(share) as weight from (
        select "column", bin as edge, 1 - part as share from b union all select "column", bin + 1, part from b)
      group by "column", edge),
g as (select unnest(range(0, 200)) as point)
select st."column", g.point::integer as point, {r('any_value(mn) + (any_value(mx) - any_value(mn)) / 199.0 * g.point')} as x,
       {r('sum(weight * exp(-0.5 * power((mn + (mx - mn) / 199.0 * g.point - (mn + (mx - mn) * edge / 1024)) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi()))')} as density
from st join e using ("column") cross join g group by st."column", g.point"""


def _box_sql(src, key, val, with_mean=False, cte=""):
    mean = f", {r(f'avg({val})', 9)} as mean" if with_mean else ""
    return f"""with {cte + ',' if cte else ''} q as (
  select {key}, quantile_cont({val}, 0.25) as q1, quantile_cont({val}, 0.5) as median,
         quantile_cont({val}, 0.75) as q3 from {src} where {val} is not null group by {key}),
f as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as fence_low, q3 + 1.5 * (q3 - q1) as fence_high from q),
a as (select s.{key}, count(*) as n,
             min(case when {val} between fence_low and fence_high then {val} end) as whisker_low,
             max(case when {val} between fence_low and fence_high then {val} end) as whisker_high,
             count_if(not ({val} between fence_low and fence_high))::bigint as n_outliers{mean}
      from {src} s join f using ({key}) where {val} is not null group by s.{key})
select f.{key}, {r('q1')} as q1, {r('median')} as median, {r('q3')} as q3, {r('iqr')} as iqr,
       {r('fence_low')} as fence_low, {r('fence_high')} as fence_high, n, {r('whisker_low::double')} as whisker_low,
       {r('whisker_high::double')} as whisker_high, n_outliers{', mean' if with_mean else ''},
       {r('median - 1.57 * iqr / sqrt(n)')} as notch_low, {r('median + 1.57 * iqr / sqrt(n)')} as notch_high
from f join a using ({key})"""


SQL["box_by_category"] = _box_sql("lineitem", "l_returnflag", "l_extendedprice")
SQL["hist_violin_margin"] = _box_sql("events", "event_type", "value")
SQL["box_columns"] = _box_sql(
    "l", '"column"', "value", True,
    "l as (" + "\nunion all\n".join(f"select '{c}' as column, {c}::double as value from lineitem"
                                    for c in LI_NUM) + ")")
SQL["box_outlier_points"] = f"""with {EV_OUT_SQL},
d as (select e.event_type, ev.value_o from ev join events e using (event_id)),
f as (select event_type, quantile_cont(value_o, 0.25) - 1.5 * (quantile_cont(value_o, 0.75) - quantile_cont(value_o, 0.25)) as lo,
             quantile_cont(value_o, 0.75) + 1.5 * (quantile_cont(value_o, 0.75) - quantile_cont(value_o, 0.25)) as hi
      from d where value_o is not null group by event_type)
select d.event_type, {r('value_o')} as value from d join f using (event_type)
where value_o < lo or value_o > hi"""


def _scatter_sql(src, cols, color=None, dropna=False, cte=""):
    c = f"{color}, " if color else ""
    base = f"select {c}{', '.join(cols)} from {src}" + (
        " where " + " and ".join(f"{x} is not null" for x in cols + ([color] if color else [])) if dropna else "")
    rng = ", ".join(
        f"case when min({x}) = max({x}) then min({x}) - 0.5 else min({x}) end as {x}__lo, "
        f"case when min({x}) = max({x}) then max({x}) + 0.5 else max({x}) end as {x}__hi" for x in cols)
    parts = []
    for i in range(len(cols)):
        for k in range(i):
            a, b = cols[k], cols[i]
            parts.append(f"""select {c}'{a}' as column_x, '{b}' as column_y,
  least(floor(({a} - {a}__lo) * 30 / ({a}__hi - {a}__lo))::integer, 29) as bin_x,
  least(floor(({b} - {b}__lo) * 30 / ({b}__hi - {b}__lo))::integer, 29) as bin_y
from base cross join rng where {a} is not null and {b} is not null""")
    return f"""with {cte + ',' if cte else ''} base as ({base}), rng as (select {rng} from base)
select {c}column_x, column_y, bin_x, bin_y, count(*) as count from ({' union all '.join(parts)})
group by {c}column_x, column_y, bin_x, bin_y"""


SQL["scatter_matrix_bins"] = _scatter_sql("lineitem", LI_NUM)
SQL["pairplot_cells"] = _scatter_sql("ev", EV_NUM, "event_type", True, EVENTS_DIRTY_SQL)
SQL["pairplot_kde"] = f"""with {EVENTS_DIRTY_SQL},
base as (select event_type, {", ".join(EV_NUM)} from ev
         where event_type is not null and {" and ".join(c + " is not null" for c in EV_NUM)}),
l as (""" + "\nunion all\n".join(f"select event_type, '{c}' as column, {c}::double as value from base"
                                 for c in EV_NUM) + f"""),
st as (select event_type, "column", min(value) as mn, max(value) as mx, count(*) as n,
              stddev_samp(value) * pow(count(*)::double, -0.2) as h from l group by event_type, "column"),
g as (select unnest(range(0, 200)) as point)
select l.event_type, l."column", g.point::integer as point, {r('any_value(st.mn) + (any_value(st.mx) - any_value(st.mn)) / 199.0 * g.point')} as x,
       {r('sum(exp(-0.5 * power((st.mn + (st.mx - st.mn) / 199.0 * g.point - l.value) / nullif(st.h, 0), 2))) / (any_value(st.n) * nullif(any_value(st.h), 0) * sqrt(2 * pi()))')} as density
from l join st on l.event_type = st.event_type and l."column" = st."column" cross join g
group by l.event_type, l."column", g.point"""
