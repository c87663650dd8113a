import math

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.operators import numeric_profile

SF = "/root/testdata/sf0.001"


def test_entry_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view lineitem as from '{SF}/lineitem.parquet'")
    want = con.sql(entry.oracle_sql()["numeric_profile"]).df().sort_values("column_name").reset_index(drop=True)
    got = entry.entry(spark).toPandas()[list(want.columns)].sort_values("column_name").reset_index(drop=True)
    assert got.astype(str).equals(want.astype(str))


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None,), (2.0,), (2.0,), (4.0,)], "column_name double")
    (row,) = numeric_profile(df, ["column_name"]).collect()
    assert (row.n_rows, row.n_null, row.n_distinct, row.min_value, row.max_value, row.mean_value) == (4, 1, 2, 2.0, 4.0, 2.6667)
    assert numeric_profile(df.limit(0), ["column_name"]).collect() == []
    (row,) = numeric_profile(df.selectExpr("cast(null as double) as x"), ["x"]).collect()
    assert (row.n_rows, row.n_null, row.n_distinct, row.min_value, row.mean_value) == (4, 4, 0, None, None)


def test_large_and_undefined_values(spark):
    rows = [(float("nan"), 1e17, float("inf"), 1e17), (1.0, 1e17, 1.0, -1.0), (1.0, 3e17, 2.0, None)]
    got = {r.column_name: r for r in numeric_profile(spark.createDataFrame(rows, "a double, b double, c double, d double"), ["a", "b", "c", "d"]).collect()}
    assert math.isnan(got["a"].mean_value) and math.isnan(got["a"].max_value) and (got["a"].n_rows, got["a"].n_distinct, got["a"].min_value) == (3, 2, 1.0)
    assert got["b"].mean_value == pytest.approx(5e17 / 3) and got["c"].mean_value == float("inf")
    assert got["d"].mean_value == pytest.approx((1e17 - 1) / 2) and got["d"].n_null == 1
