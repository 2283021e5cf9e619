"""Physical patterns: ordered index, halo windows, fills, prefix sums, quantiles, ranks."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from kiln.plans.ordering import bounded_window, fill_backward, fill_forward, ordered_index, prefix_sum
from kiln.plans.quantiles import column_quantiles, exact_quantiles, order_statistics
from kiln.plans.ranks import kendall_pairs, spearman_pairs


def test_ordered_index_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 3).alias("g"),
                                     F.concat(F.lit("s"), (F.col("id") * 31 % 997).cast("string"),
                                              F.col("id").cast("string")).alias("s"))
    for order, by in ([["k"], []], [["k"], ["g"]], [["s"], []]):
        x = ordered_index(df, order, by=by, idx_col="i", num_buckets=13)
        w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
        assert x.withColumn("rn", F.row_number().over(w) - 1).filter("i != rn").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100, allow_nan=False)), min_size=1, max_size=60),
       st.integers(2, 9), st.integers(0, 4), st.integers(0, 4))
def test_halo_window_equals_global(spark, vals, bucket, before, after):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, v double")

    def comp(w):
        return [("s", F.sum("v").over(w.rowsBetween(-before, after))),
                ("l", F.lag("v", before).over(w) if before else F.col("v"))]

    got = {r["i"]: (r["s"], r["l"]) for r in bounded_window(df, "i", comp, before, after,
                                                           bucket_rows=bucket).collect()}
    s = pd.Series(vals, dtype="float64")
    for i in range(len(vals)):
        window = s.iloc[max(0, i - before):i + after + 1]
        exp = None if window.isna().all() else float(window.sum())
        lag = vals[i - before] if i - before >= 0 else None
        gs, gl = got[i]
        assert (gs is None and exp is None) or abs(gs - exp) < 1e-9
        assert gl == lag


def test_fills_match_pandas(spark):
    rng = np.random.default_rng(3)
    vals = [None if rng.random() < 0.4 else float(x) for x in rng.integers(0, 100, 400)]
    vals[:5] = [None] * 5
    vals[-5:] = [None] * 5
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "t long, v double")
    s = pd.Series(vals, dtype="float64")
    ff = {r["t"]: r["v"] for r in fill_forward(df, ["v"], ["t"], num_buckets=7, then_backward=True).collect()}
    bf = {r["t"]: r["v"] for r in fill_backward(df, ["v"], ["t"], num_buckets=7).collect()}
    exp_f, exp_b = s.ffill().bfill(), s.bfill()
    for i in range(len(vals)):
        assert ff[i] == exp_f[i]
        assert (bf[i] is None and pd.isna(exp_b[i])) or bf[i] == exp_b[i]


def test_prefix_sum(spark):
    df = spark.range(0, 3000).select((F.col("id") % 4).alias("g"), F.col("id").alias("o"), (F.col("id") % 10).alias("v"))
    x = prefix_sum(df, ["o"], "v", "c", by=["g"], num_buckets=11)
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    assert x.withColumn("e", F.sum("v").over(w)).filter("c != e").count() == 0


def test_exact_quantiles_multi_round(spark):
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = column_quantiles(li, ["l_extendedprice", "l_discount"], probs, max_candidates=400).collect()
    exp = li.select(F.percentile("l_extendedprice", probs).alias("a"), F.percentile("l_discount", probs).alias("b")).first()
    for r in got:
        e = (exp["a"] if r["column"] == "l_extendedprice" else exp["b"])[probs.index(r["prob"])]
        assert abs(r["quantile"] - e) <= 1e-9 * max(1, abs(e))


def test_quantiles_of_tied_values(spark):
    """Eleven distinct values: grid values solve the ranks at once, nothing is sorted."""
    df = spark.range(0, 6000).select((F.pmod(F.xxhash64("id"), F.lit(11)) / 100).alias("v"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, None, "v", probs, max_candidates=20).collect()}
    v = np.array([r["v"] for r in df.collect()])
    for p in probs:
        assert abs(got[p] - np.quantile(v, p)) < 1e-12


def test_quantiles_between_two_heavy_values(spark):
    """Few values between two heavy ones: the heavy ones are taken out as bracket ends."""
    df = spark.range(0, 40000).select(F.when(F.col("id") < 20000, 1.0).when(F.col("id") < 20015, F.col("id") / 10000)
                                      .otherwise(9.0).alias("v"))
    got = exact_quantiles(df, None, "v", [20007 / 39999, 0.5], max_candidates=5).collect()
    v = np.array([r["v"] for r in df.collect()])
    for r in got:
        assert abs(r["quantile"] - np.quantile(v, r["prob"])) < 1e-9


def test_quantiles_null_groups_and_order_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("b", None)], "k string, v double")
    q = {(r["k"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["k"], "v", [0.5, 0.75]).collect()}
    assert q[("a", 0.5)] == 2.0 and q[("a", 0.75)] == 6.0 and q[("b", 0.5)] is None
    o = {r["stat"]: r["value"] for r in order_statistics(df, ["k"], "v", {"lo": lambda n: n * 0, "hi": lambda n: n - 1})
         .filter("k = 'a'").collect()}
    assert o == {"lo": 1.0, "hi": 10.0}


def _tau_b(x, y):
    c = d = tx = ty = 0
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            if a == 0 and b == 0:
                continue
            if a == 0:
                tx += 1
            elif b == 0:
                ty += 1
            elif a == b:
                c += 1
            else:
                d += 1
    return (c - d) / np.sqrt((c + d + tx) * (c + d + ty))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9)), min_size=3, max_size=40))
def test_kendall_and_spearman_brute_force(spark, pts):
    xs = [float(a) for a, _ in pts]
    ys = [float(b) for _, b in pts]
    df = spark.createDataFrame([(0, a, b) for a, b in zip(xs, ys)], "pair int, x double, y double")
    k = kendall_pairs(df).first()["r"]
    exp = _tau_b(xs, ys)
    assert (k is None and not np.isfinite(exp)) or abs(k - exp) < 1e-9
    s = spearman_pairs(df).first()["r"]
    e2 = pd.Series(xs).rank().corr(pd.Series(ys).rank())
    assert (s is None and not np.isfinite(e2)) or abs(s - e2) < 1e-9


def test_no_python_udf_in_plans(spark):
    import io
    from contextlib import redirect_stdout
    from kiln.operators import spc
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    res = spc.xbar_r_chart(li, "l_quantity", "l_orderkey")
    buf = io.StringIO()
    with redirect_stdout(buf):
        res.points.explain("formatted")
    plan = buf.getvalue()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    from kiln.operators import dist
    buf = io.StringIO()
    with redirect_stdout(buf):
        dist.histogram(li, ["l_quantity"]).explain("formatted")
    plan = buf.getvalue()
    # column pruning reaches the scan: only the histogrammed column is read
    assert "ReadSchema: struct<l_quantity:double>" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_hot_key_is_split(spark):
    """A first-column value holding a third of the rows, or equal rows, are spread
    over buckets, and the index is exact (ties broken by the second order column)."""
    import kiln.plans.ordering as o
    same = o.assign_buckets(spark.range(0, 4000).select(F.lit(1).alias("a")), ["a"], num_buckets=8)
    assert max(r["count"] for r in same.groupBy("__bk").count().collect()) < 1000
    df = spark.range(0, 4000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("a"),
                                     F.col("id").alias("b"))
    b = o.assign_buckets(df, ["a", "b"], num_buckets=8)
    sizes = [r["count"] for r in b.groupBy("__bk").count().collect()]
    assert max(sizes) < 1000              # the hot value (1333 rows) is spread
    x = ordered_index(df, ["a", "b"], idx_col="i", num_buckets=8)
    w = Window.orderBy("a", "b")
    assert x.withColumn("rn", F.row_number().over(w) - 1).filter("i != rn").count() == 0


def test_fills_use_running_frames_only(spark):
    """Frames ending at unboundedFollowing are re-aggregated per row (quadratic)."""
    import io
    from contextlib import redirect_stdout
    df = spark.range(0, 100).select(F.col("id").alias("t"),
                                    F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("v"))
    for out in (fill_forward(df, ["v"], ["t"], then_backward=True), fill_backward(df, ["v"], ["t"])):
        buf = io.StringIO()
        with redirect_stdout(buf):
            out.explain("formatted")
        assert "unboundedfollowing" not in buf.getvalue().lower()


def test_approx_quantiles_close(spark):
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    a = {r["prob"]: r["quantile"] for r in exact_quantiles(li.withColumn("k", F.lit(1)), ["k"], "l_extendedprice",
                                                            [0.1, 0.5, 0.9], approx=True).collect()}
    e = {r["prob"]: r["quantile"] for r in exact_quantiles(li.withColumn("k", F.lit(1)), ["k"], "l_extendedprice",
                                                            [0.1, 0.5, 0.9]).collect()}
    for p in e:
        assert abs(a[p] - e[p]) / e[p] < 0.01


def test_box_statistics_send_no_rows_to_the_task_of_their_group(spark):
    """Rows meet the brackets and fences of their group by broadcast: a group of most of the rows is in no one task."""
    from kiln.operators.dist import box_stats_long
    df = spark.range(0, 30000).select(F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("k"),
                                      F.pmod(F.xxhash64("id"), F.lit(7919)).cast("double").alias("value"))
    stats, outliers = box_stats_long(df, ["k"])
    for frame in (stats, outliers):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in plan.splitlines() if "Join" in x and "LogicalRDD" not in x]
        assert joins and all("broadcast" in x for x in joins)
    q = exact_quantiles(df, ["k"], "value", [0.25, 0.5], max_candidates=100)
    got = {(r["k"], r["prob"]): r["quantile"] for r in q.collect()}
    for k in ("hot", "rare"):
        v = [r["value"] for r in df.filter(F.col("k") == k).collect()]
        assert [got[k, p] for p in (0.25, 0.5)] == pytest.approx(list(np.quantile(v, [0.25, 0.5])))
