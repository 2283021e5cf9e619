"""A sample of registered queries against their DuckDB SQL twins (sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as ent
from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"
SAMPLE = ["spc_xbar_r_stats", "spc_imr_points", "schema_detect", "summary_numeric", "outliers_winsorize",
          "missing_ffill", "resample_weekly_aggs", "corr_kendall", "box_by_category", "pipeline_output",
          "ml_roc_curve", "ml_classification_report"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = ent.entry(spark)
    assert df.count() > 0 and "point_index" in df.columns


def test_every_sql_query_is_registered():
    assert set(ent.oracle_sql()) <= set(ent.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    sdf = ent.queries()[name](spark, SF)
    rows = [tuple(r) for r in sdf.collect()]
    rel = con.execute(ent.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(cols)
    assert len(rows) == len(drows)
    assert digest(rows, sdf.columns)[0] == digest(drows, cols)[0]
