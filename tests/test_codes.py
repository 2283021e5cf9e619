"""Column types of numeric codes; plots keep every column; previews have no cap."""

import pandas as pd

from kiln.operators import dist, schema
from kiln.sources.io import preview


def test_codes_are_no_datetimes(spark):
    df = spark.createDataFrame(pd.DataFrame({
        "zip": ["90210", "10001", "60614"], "code": ["2101", "1042", "9999"], "clock": ["10:30", "11:00:05", "09:15"],
        "phone": ["5551234567", "5559876543", "5550001111"], "day": ["2024-01-05", "2024-02-06", "2024-03-07"]}))
    kinds = {r["column"]: r["inferred_type"] for r in schema.detect_schema(df).collect()}
    assert kinds["day"] == "datetime"
    assert "datetime" not in {kinds[c] for c in ("zip", "code", "clock", "phone")}


def test_no_column_cap(spark):
    df = spark.createDataFrame(pd.DataFrame({f"c{i}": [1.0, 2.0, 3.0] for i in range(15)}))
    assert dist.histogram(df).select("column").distinct().count() == 15
    assert preview(df, "c0", 20_000).count() == 3
