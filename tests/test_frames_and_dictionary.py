"""Wide frame sums (H20), the value dictionary of schema inference (B1) and pair cells."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from kiln.operators import dist, schema, series
from kiln.plans.ordering import frame_sums


@pytest.mark.parametrize("before,after,block", [(0, 0, 4), (3, 3, 100), (4, 3, 3), (7, 8, 4), (30, 29, 7), (60, 60, 5)])
def test_frame_sums_equal_a_plain_loop(spark, before, after, block):
    rnd = random.Random(before)
    vals = [rnd.uniform(-5, 5) for _ in range(101)]
    df = spark.createDataFrame([(i, v, f"t{i}") for i, v in enumerate(vals)], "i long, v double, t string")
    got = {r["i"]: r for r in frame_sums(df, "i", "v", before, after, ["t"], block_rows=block).collect()}
    assert sorted(got) == list(range(101))
    for i, v in enumerate(vals):
        assert got[i]["v"] == v and got[i]["t"] == f"t{i}"
        if i < before or i + after > 100:
            assert got[i]["__sum"] is None
        else:
            assert abs(got[i]["__sum"] - sum(vals[i - before:i + after + 1])) < 1e-9


def test_frame_sums_keep_digits_after_huge_values(spark):
    df = spark.range(4000).select(F.col("id").alias("t"), F.when(F.col("id") < 1000, 1e17).otherwise(0.1).alias("v"))
    out = {r["point_index"]: r["trend"] for r in series.trend_decomposition(df, "t", "v", window=200).collect()}
    assert all(abs(out[i] - 0.1) < 1e-14 for i in range(1101, 3900))
    assert out[99] is None and out[3901] is None and out[500] == 1e17


def test_trend_at_a_large_level(spark):
    vals = [1e9 + (i * 37 % 101) * 1e-3 for i in range(900)]
    df = spark.createDataFrame(list(enumerate(vals)), "t long, v double")
    for r in series.trend_decomposition(df, "t", "v").collect():       # window 45: 22 rows on each side
        i = r["point_index"]
        if 22 <= i < 878:
            frame = vals[i - 22:i + 23]
            assert abs(r["trend"] - (1e9 + sum(x - 1e9 for x in frame) / 45)) < 1e-6


def test_trend_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (None, 3.0)], "t long, v double")
    assert [tuple(r) for r in series.trend_decomposition(df, "t", "v").collect()] == [(0, 1, 2.0, None, None)]
    assert series.trend_decomposition(df.limit(0), "t", "v").count() == 0


def test_schema_dictionary_counts_values_of_every_type(spark):
    t = dt.datetime(2024, 10, 27, 0, 30, 0, 1)
    rows = [(0.0, 1, "2024-01-05", [1, None], b"\x00", t, True),
            (-0.0, 1, "2024-01-05", [1], b"\x00", t + dt.timedelta(microseconds=1), False),
            (float("nan"), 2, "x", [1, None], b"00", t, None),
            (float("nan"), None, None, None, None, None, True)]
    df = spark.createDataFrame(rows, "d double, l long, s string, a array<int>, b binary, t timestamp, f boolean")
    got = {r["column"]: r for r in schema.detect_schema(df).collect()}
    assert {c: got[c]["n_unique"] for c in df.columns} == {"d": 2, "l": 2, "s": 2, "a": 2, "b": 2, "t": 2, "f": 2}
    assert {c: got[c]["n_missing"] for c in df.columns} == {"d": 0, "l": 1, "s": 1, "a": 1, "b": 1, "t": 1, "f": 1}
    assert got["s"]["inferred_type"] == "categorical" and got["s"]["datetime_format"] is None


def test_schema_parse_rate_counts_rows_not_values(spark):
    # 9 of 10 rows parse, but only 1 of 2 distinct values
    df = spark.createDataFrame([("2024-01-05",)] * 9 + [("soon",)], "s string")
    assert schema.detect_schema(df).first()["datetime_format"] == "auto"


def test_schema_has_no_expand_and_equals_the_approximate_way(spark):
    df = spark.range(50).select((F.col("id") % 7).alias("k"), F.col("id").cast("string").alias("s"),
                                F.when(F.col("id") % 3 == 0, F.lit("05/01/2024")).alias("day"))
    exact = schema.detect_schema(df)
    assert "Expand" not in exact._jdf.queryExecution().executedPlan().toString()
    pick = ["column", "inferred_type", "n_missing", "datetime_format"]
    assert exact.select(pick).collect() == schema.detect_schema(df, approx=True).select(pick).collect()


def test_schema_of_an_empty_table(spark):
    got = schema.detect_schema(spark.createDataFrame([], "a long, s string")).collect()
    assert [(r["column"], r["n_unique"], r["n_missing"], r["pct_missing"]) for r in got] == [
        ("a", 0, 0, None), ("s", 0, 0, None)]


def test_scatter_cells_equal_a_plain_count(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("xy"), *[rnd.random() if rnd.random() < 0.9 else None for _ in range(3)]) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, a double, b double, `c` double")
    want = {}
    cols = {"a": 1, "b": 2, "c": 3}
    lim = {c: (min(r[p] for r in rows if r[p] is not None), max(r[p] for r in rows if r[p] is not None))
           for c, p in cols.items()}
    cell = lambda c, v: min(int((v - lim[c][0]) * 4 / (lim[c][1] - lim[c][0])), 3)
    for r in rows:
        for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
            if r[cols[x]] is not None and r[cols[y]] is not None:
                key = (r[0], x, y, cell(x, r[cols[x]]), cell(y, r[cols[y]]))
                want[key] = want.get(key, 0) + 1
    got = dist.scatter_matrix(df, color_col="g", bins=4).collect()
    assert {tuple(r)[:5]: r["count"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("points", [7, 120])
def test_kde_exact_and_binned(spark, points):
    rnd = random.Random(5)
    data = {"x": [rnd.gauss(0, 1) for _ in range(80)] + [None], "c": [4.0] * 81}
    df = spark.createDataFrame(list(zip(data["x"], data["c"])), "x double, c double")
    vals = data["x"][:80]
    mean = sum(vals) / 80
    h = math.sqrt(sum((v - mean) ** 2 for v in vals) / 79) * 80 ** -0.2
    lo, hi = min(vals), max(vals)
    want = [sum(math.exp(-0.5 * ((lo + (hi - lo) / (points - 1) * k - v) / h) ** 2) for v in vals)
            / (80 * h * math.sqrt(2 * math.pi)) for k in range(points)]
    exact = dist.kde(df, points=points).collect()
    assert len(exact) == 2 * points and all(r["density"] is None for r in exact if r["column"] == "c")
    got = {r["point"]: r["density"] for r in exact if r["column"] == "x"}
    assert all(abs(got[k] - want[k]) < 1e-12 for k in range(points))
    for bins in (8, 256):
        near = {r["point"]: r["density"] for r in dist.kde(df, ["x"], points, binned=bins).collect()}
        bound = ((hi - lo) / bins) ** 2 / (8 * math.sqrt(2 * math.pi) * h ** 3)
        assert all(abs(near[k] - want[k]) <= bound + 1e-12 for k in range(points)) and len(near) == points
