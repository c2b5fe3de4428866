"""The driver's contract: every SQL has a query, and queries agree with DuckDB on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillframe.functions import ieee
from quillframe.plans import queries as engine

DIR = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(engine.QUERIES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", ["column_summary", "linear_regression", "recycling_large", "filter_by_other_rows", "factor_numbers", "scorecard", "tree_ensemble", "type_inference", "fold_training", "area_under_curve"])
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = engine.QUERIES[name](spark, DIR)
    want = con.sql(engine.SQL[name])
    cols = want.columns
    assert sorted(cols) == sorted(got.columns)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name, column, keys", [
    # scaled to nine digits these logarithms are just below a half, and their shortest decimal form is one
    ("log_vector", "o_custkey", [1, 2, 9364126, 11493395, 12099367, 13659283, 13931893, 14434433, 15494955, 15891940, 18033756]),
    ("arith_div", "o_custkey", [0, 1, 6, 7, 8, 9364126, 9_007_199_254_740_991]),
])
def test_large_keys(spark, tmp_path, name, column, keys):
    spark.createDataFrame([(k, c, 1001.91 + k) for k, c in enumerate(keys)], f"o_orderkey long, {column} long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(map(tuple, engine.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.sql(engine.SQL[name]).fetchall())


def test_rounded(spark):
    values = [0.5, 1.5, -0.5, -2.5, 2.675, 1.005, 0.49999999999999994, 1e300, -1e308, 16.0523964565, float("inf"), float("-inf"), float("nan"), None, 4503599627370497.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for d in (0, 2, 9):
        want = [r[0] for r in duckdb.connect().execute(f"select round(unnest($1::double[]), {d})", [values]).fetchall()]
        assert list(map(repr, want)) == [repr(r[0]) for r in df.coalesce(1).select(ieee.rounded(F.col("v"), d)).collect()]
