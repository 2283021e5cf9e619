"""Edge cases of the table operators: NULLs, constants, single rows, empty frames."""

import math

import pytest
from pyspark.sql import functions as F

from kiln.operators import clean, corr, dist, encode, outliers, resample, schema, series, summary
from kiln.sources import io


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(1, None, 5.0, "a", None, "2024-01-03", True),
            (2, None, 5.0, "b", None, "2024-01-01", False),
            (3, None, 5.0, "a", None, "2024-01-02", None),
            (4, None, 5.0, None, None, None, True)]
    return spark.createDataFrame(rows, "id long, allnull double, const double, cat string, "
                                       "nullstr string, d string, flag boolean")


def test_schema_edge(edge):
    info = schema.schema_dict(schema.detect_schema(edge))
    assert info["allnull"]["inferred_type"] == "numeric" and info["allnull"]["n_missing"] == 4
    assert info["nullstr"]["inferred_type"] == "datetime"       # vacuous parse, as the reference
    assert info["d"]["inferred_type"] == "datetime" and info["d"]["datetime_format"] == "yyyy-M-d"
    assert info["cat"]["inferred_type"] == "categorical" and info["flag"]["inferred_type"] == "boolean"
    assert info["id"]["pct_missing"] == 0.0 and info["cat"]["pct_missing"] == 25.0
    parsed = schema.parse_datetime_columns(edge, info)
    assert dict(parsed.dtypes)["d"] == "timestamp_ntz"


def test_summary_edge(edge):
    s = {r["column"]: r for r in summary.numeric_summary(edge).collect()}
    assert s["allnull"]["count"] == 0 and s["allnull"]["mean"] is None
    assert s["const"]["std"] == 0.0 and s["const"]["skewness"] is None and s["const"]["p50"] == 5.0
    c = {r["column"]: r for r in summary.categorical_summary(edge).collect()}
    assert c["cat"]["top_value"] == "a" and c["cat"]["top_freq"] == 2 and c["cat"]["missing"] == 1
    assert c["nullstr"]["n_unique"] == 0 and c["nullstr"]["top_value"] is None
    m = [r["column"] for r in summary.missing_by_column(edge).collect()]
    assert m[:2] == ["allnull", "nullstr"]


def test_missing_and_dedup_edge(edge, spark):
    info = schema.schema_dict(schema.detect_schema(edge))
    out, rep = clean.handle_missing_values(edge, info, "mean", order_by=["id"])
    r = {x["id"]: x for x in out.collect()}
    assert r[4]["cat"] == "a" and r[1]["allnull"] is None
    assert {x["column"] for x in rep.collect()} == {"allnull", "cat", "nullstr", "d", "flag"}
    out2, _ = clean.handle_missing_values(edge, info, "drop")
    assert out2.count() == 0
    d, n = clean.remove_duplicates(edge.unionByName(edge.limit(2)))
    assert d.count() == 4 and n.first()["n_removed"] == 2


def test_mean_fill_of_integer_column_keeps_fraction(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, k long")
    out, _ = clean.handle_missing_values(df, {"k": {"inferred_type": "numeric"}}, "mean")
    assert dict(out.dtypes)["k"] == "double" and out.filter("id = 3").first()["k"] == 1.5


def test_outliers_constant_and_single_row(spark):
    df = spark.createDataFrame([(1.0, 7.0)], "x double, y double")
    flagged, rep = outliers.detect_outliers(df, ["x", "y"], "zscore", 1.5)
    assert [r["n_outliers"] for r in rep.collect()] == [0, 0]
    flagged, _ = outliers.detect_outliers(df, ["x"], "iqr")
    assert outliers.treat_outliers(flagged, ["x"], "winsorize").first()["x"] == 1.0


def test_encoding_and_scaling_edge(edge):
    out, m = encode.encode_categoricals(edge, ["cat", "flag"], "onehot")
    cols = out.columns
    assert "cat_b" in cols and "cat_a" not in cols and "flag_True" in cols
    assert out.filter(F.col("id") == 4).first()["cat_b"] == 0
    lab, _ = encode.encode_categoricals(edge, ["cat"], "label")
    assert {r["id"]: r["cat"] for r in lab.collect()} == {1: 0, 2: 1, 3: 0, 4: 2}   # 'nan' sorts last
    scaled, _ = encode.scale_features(edge, ["const"], "standard")
    assert {r["const"] for r in scaled.collect()} == {0.0}


def test_resample_gap(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00", 1.0), ("2024-01-04 11:00:00", 3.0)], "t string, v double") \
        .select(F.col("t").cast("timestamp_ntz").alias("t"), "v")
    d = resample.group_by_time(df, "t", "D", {"v": "sum"}).orderBy("t").collect()
    assert [r["v"] for r in d] == [1.0, 0.0, 0.0, 3.0]
    m = resample.group_by_time(df, "t", "D").orderBy("t").collect()
    assert m[1]["v"] is None
    w = resample.group_by_time(df, "t", "W", {"v": "max"}).collect()
    assert [str(r["t"].date()) for r in w] == ["2024-01-07"]


def test_corr_and_dist_edge(edge, spark):
    assert corr.correlation_matrix(edge.select("id"), "pearson") is None
    c = {(r["column_a"], r["column_b"]): r["r"] for r in corr.correlation_matrix(edge, "pearson").collect()}
    assert c[("id", "const")] is None and c[("const", "const")] is None and c[("id", "id")] == 1.0
    h = dist.histogram(edge, ["const"], bins=4).collect()
    assert sum(r["count"] for r in h) == 4 and len(h) == 4
    xs = [0.0, 1.0, 1.5, 4.0, 9.0]
    k = {r["point"]: r for r in dist.kde(spark.createDataFrame([(x,) for x in xs], "x double"), ["x"]).collect()}
    import numpy as np
    h = np.std(xs, ddof=1) * len(xs) ** -0.2
    for p in (0, 57, 199):
        g = k[p]["x"]
        exp = np.exp(-0.5 * ((g - np.array(xs)) / h) ** 2).sum() / (len(xs) * h * math.sqrt(2 * math.pi))
        assert abs(k[p]["density"] - exp) < 1e-12


def test_kde_constant_column(spark):
    k = dist.kde(spark.createDataFrame([(2.0,), (2.0,)], "x double"), ["x"]).collect()
    assert len(k) == 200 and all(r["density"] is None for r in k)


def test_trend_window(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(30)], "t long, v double")
    out = {r["point_index"]: r for r in series.trend_decomposition(df, "t", "v", window=8).collect()}
    vals = [float(i % 5) for i in range(30)]
    assert out[3]["trend"] is None and out[27]["trend"] is None and out[26]["trend"] is not None
    assert abs(out[4]["trend"] - sum(vals[0:8]) / 8) < 1e-12          # 4 before, 3 after


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, float("nan"))], "id int, s string, x double")
    path = str(tmp_path / "out")
    io.write_csv(df, path)
    back = io.read_csv(spark, path).orderBy("id").collect()
    assert back[0]["s"] == "a" and back[1]["x"] is None
    prof = io.table_profile(df).first()
    assert prof["rows"] == 2 and prof["duplicate_rows"] == 0
    assert io.select_columns(df, "numeric", max_columns=1).columns == ["id"]
    assert [r["id"] for r in io.preview(df, ["id"], 1).collect()] == [1]


def test_ml_small(spark):
    from kiln.operators import ml
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_quantity", "l_extendedprice",
                                                                           "l_discount")
    res = ml.train_model(li, "l_extendedprice", "Linear Regression", cv_folds=3)
    met = {r["metric"]: r["value"] for r in res.metrics.collect()}
    assert set(met) == {"RMSE", "MAE", "R2"} and all(math.isfinite(v) for v in met.values())
    assert res.cv_scores.count() == 3
    sizes = res.sizes.first()
    assert sizes["n_test"] == math.ceil(0.2 * (sizes["n_train"] + sizes["n_test"]))
    cls = li.withColumn("big", (F.col("l_quantity") > 25).cast("int")).drop("l_quantity")
    r2 = ml.train_model(cls, "big", "Logistic Regression", cv_folds=2)
    names = {r["metric"] for r in r2.metrics.collect()}
    assert {"Accuracy", "F1 (weighted)", "ROC-AUC"} <= names
    with pytest.raises(ValueError):
        ml.get_estimator("Nope", ml.REGRESSION)


def test_split_of_repeated_rows_is_exact(spark):
    from kiln.operators import ml
    df = spark.range(0, 1003).select((F.col("id") % 3).alias("x"), F.when(F.col("id") < 200, "a").otherwise("b")
                                     .alias("label"))
    plain = ml.split(df, 0.2).groupBy("is_test").count().collect()
    assert {r["is_test"]: r["count"] for r in plain} == {True: 201, False: 802}
    by = ml.split(df, 0.2, stratify=True).filter("is_test").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in by} == {"a": 40, "b": 161}


def test_first_and_last_of_tied_timestamps(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, 2, 5.0), (t, 1, 7.0), (t, 3, None), (t, 3, 6.0)], "t timestamp_ntz, k int, v double")
    first = resample.group_by_time(df, "t", "D", {"v": "first"}, order_by=["k"]).first()["v"]
    last = resample.group_by_time(df, "t", "D", {"v": "last"}, order_by=["k"]).first()["v"]
    assert (first, last) == (7.0, 6.0)


def test_scaled_coefficient_uses_the_population_deviation(spark):
    from kiln.operators import ml
    df = spark.createDataFrame([(float(i), 3.0 * i + 1, i % 5 == 0) for i in range(20)], "x double, y double, t boolean")
    res = ml.train_model(df, "y", "Linear Regression", ["x"], problem_type=ml.REGRESSION, test_flag="t", cv_folds=2)
    import statistics
    std = statistics.pstdev([float(i) for i in range(20) if i % 5])
    assert abs(res.importance.first()["importance"] - 3 * std) < 1e-9


def test_report_without_class_grid(spark):
    from kiln.operators import metrics
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), (None, "a"), ("a", None)], "y string, p string")
    rep = {r["class"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert rep["a"]["support"] == 2 and rep["a"]["precision"] == 0.5 and rep["a"]["recall"] == 0.5
    assert rep["b"]["precision"] == 0.5 and rep["b"]["recall"] == 1.0 and rep["c"]["f1"] == 0.0
    assert rep["accuracy"]["f1"] == 0.5
