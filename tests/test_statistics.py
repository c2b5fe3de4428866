"""Summaries, samples, factors and statistics on small rows with missing values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.frame import RID, Frame, number_rows
from quillframe.ml.arguments import Case, class_numbers, columns, default_case, sequence
from quillframe.operators import aggregate, factor, rows, stats, summary


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    data = [(k, float(rng.normal()), float(rng.normal()) if k % 7 else None, "xyz"[k % 3], 5) for k in range(60)]
    return Frame.of(spark.createDataFrame(data, "id long, a double, b double, c string, k int"), "id")


def test_row_numbers(spark):
    df = spark.range(0, 5000, 3).withColumn("s", F.concat(F.lit("é"), F.col("id").cast("string"))).repartition(7)
    for order in (["id"], ["s"], ["s", "id"]):
        got = [r[RID] for r in number_rows(df, order, 6).orderBy(*order).collect()]
        assert got == list(range(df.count()))
    assert number_rows(df.limit(0), ["id"], 3).count() == 0


def test_summary(frame):
    r = {x["name"]: x for x in summary.summary(frame).collect()}
    b = np.array([x["b"] for x in frame.df.collect() if x["b"] is not None])
    assert (r["b"]["n"], r["b"]["na"]) == (len(b), 60 - len(b)) and r["b"]["sigma"] == pytest.approx(b.std()) and r["b"]["mean"] == pytest.approx(b.mean())
    assert (r["c"]["type"], r["c"]["domain"], r["c"]["max"]) == ("enum", 3, 2.0) and r["k"]["min"] == r["k"]["max"] == 5
    assert summary.trim(frame).names == ["id", "a", "b", "c"] and summary.default_columns(frame, "a") == ["id", "c"]
    p = summary.page(frame, 7, 2).orderBy(RID).collect()
    assert [x[RID] for x in p] == [7, 8] and p[0]["b"] == "NA" and summary.page(frame, -1).count() == 0


def test_covariance_and_regression(frame):
    pairs = np.array([(x["a"], x["b"]) for x in frame.df.collect() if x["b"] is not None])
    c = stats.covariance(frame.df, F.col("a"), F.col("b")).first()
    assert c["n"] == len(pairs) and c["covariance"] == pytest.approx(np.cov(pairs.T)[0, 1]) and c["correlation"] == pytest.approx(np.corrcoef(pairs.T)[0, 1])
    r = stats.linear_regression(frame.df, F.col("a"), F.col("b")).first()
    x = np.column_stack([np.ones(len(pairs)), pairs[:, 0]])
    beta, res, *_ = np.linalg.lstsq(x, pairs[:, 1], rcond=None)
    se = np.sqrt(res[0] / (len(pairs) - 2) * np.diag(np.linalg.inv(x.T @ x)))
    assert (r["beta0"], r["beta1"]) == pytest.approx(tuple(beta)) and (r["beta0_std_err"], r["beta1_std_err"]) == pytest.approx(tuple(se)) and r["sse"] == pytest.approx(res[0])


def test_classes_and_density(frame, spark):
    d = {r["class"]: (r["count"], r["ratio"]) for r in aggregate.class_ratios(frame.df, F.col("id") % 4).collect()}
    assert d == {k: (15, 0.25) for k in range(4)} and aggregate.majority_rows(frame.df, F.lit(1)) == 60
    many = spark.range(1000).select(F.lit(1.0).alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    assert sorted(r["count"] for r in stats.density(many, F.col("x"), F.col("y"), 2, 2).collect()) == [255, 255]


def test_thresholds(spark):
    df = spark.createDataFrame([(1.0, 0.9), (1.0, 0.4), (0.0, 0.5), (0.0, 0.1), (None, 0.3)], "a double, p double")
    m = [tuple(r) for r in stats.threshold_counts(df, F.col("a"), F.col("p"), [0.0, 0.45, 0.95]).collect()]
    assert m == [(0.0, 0, 2, 0, 2), (0.45, 1, 1, 1, 1), (0.95, 2, 0, 2, 0)]
    assert stats.best_threshold(m) == 0 and stats.auc(m) == pytest.approx(0.5) and stats.class_errors(0, 0, 0, 3) == (0.0, 0.0)


def test_samples(frame, spark):
    assert rows.exact_sample(frame.df, F.col("id"), 0, 1).count() == 0 and rows.exact_sample(frame.df, F.col("id"), 99, 1).count() == 60
    a = {r["id"] for r in rows.exact_sample(frame.df, F.col("id"), 11, 1).collect()}
    assert len(a) == 11 and a != {r["id"] for r in rows.exact_sample(frame.df, F.col("id"), 11, 2).collect()}
    s = rows.stratified(frame.df, F.col("c"), {"x": 3, "z": 100}, F.col("id"), 5).groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in s} == {"x": 3, "z": 20}
    parts = [rows.fold(frame, 4, k, complement=True).df.count() for k in range(4)]
    assert sum(parts) == 60 and rows.fold(frame, 4, 1).df.count() == 45
    n = rows.bernoulli(spark.range(20_000), F.col("id"), 0.3, 1).count()
    assert abs(n - 6000) < 300


def test_factors(frame):
    v = factor.factor(frame.vec("c"))
    assert v.domain == ("x", "y", "z") and [r[0] for r in frame.rows.df.orderBy("id").select(v.expr).limit(4).collect()] == [0.0, 1.0, 2.0, 0.0]
    assert factor.one_hot(frame, "c").names == ["id", "a", "b", "k", "c.x", "c.y", "c.z"]
    z = factor.standardize(frame, ["a", "k"]).df.agg(F.avg("a"), F.stddev_pop("a"), F.max("k")).first()
    assert tuple(z) == pytest.approx((0, 1, 0), abs=1e-9)
    assert factor.merge_domains(["a", "c"], ["b", "c"]) == (["a", "b", "c"], [0, 2], [1, 2]) and factor.bin_edges(frame.df, F.col("k")) == [5.0]


def test_arguments(frame):
    assert sequence("0:1:0.25") == [0, 0.25, 0.5, 0.75] and sequence("1,3") == [1, 3] and sequence("1:20:*3") == [1, 3, 9] and sequence("7") == [7]
    assert len(sequence("0:1:0.01")) == 100 and class_numbers("a=1, b = 2.5") == {"a": 1.0, "b": 2.5} and columns(frame, "a,2,a") == ["a", "b"]
    assert Case.parse(">=3") == Case(">=", "3") and default_case(frame, "c") == Case("=", "z") and default_case(frame, "id").op == ">"
    with pytest.raises(KeyError):
        columns(frame, "nosuch")


def test_row_numbers_of_equal_beginnings_nulls_and_times(spark):
    """A prefix that all texts share, repeated first columns and nulls don't stop rows from being cut into ranges."""
    df = spark.range(500).select(F.when(F.col("id") % 50 != 0, F.concat(F.lit("prefix-prefix-"), (F.col("id") % 7).cast("string"))).alias("t"), F.timestamp_seconds(F.col("id") % 3).alias("ts"), "id")
    got = number_rows(df, ["t", "ts", "id"], 16).orderBy("_rid").collect()
    want = sorted(df.collect(), key=lambda r: (r["t"] is not None, r["t"] or "", r["ts"], r["id"]))
    assert [r["_rid"] for r in got] == list(range(500)) and [r["id"] for r in got] == [r["id"] for r in want]
    assert number_rows(df.limit(0), ["id"], 4).count() == 0 and number_rows(df, ["id"], 1).agg(F.max("_rid")).first()[0] == 499


def test_exact_sample_goes_down_to_few_rows(spark, monkeypatch):
    df = spark.range(3000)
    for ordered in (rows._ORDERED, 1):
        monkeypatch.setattr(rows, "_ORDERED", ordered)
        found = [{r["id"] for r in rows.exact_sample(df, F.col("id"), n, 3).collect()} for n in (1, 700, 2999, 3000)]
        assert [len(x) for x in found] == [1, 700, 2999, 3000] and found[0] < found[1] < found[2]


def test_samples_with_replacement(spark):
    df = spark.range(20_000)
    counts = {r["id"]: r["count"] for r in rows.with_replacement(df, F.col("id"), 0.67, 5).groupBy("id").count().collect()}
    assert abs(sum(counts.values()) - 13_400) < 400 and max(counts.values()) > 3
    some = rows.stratified_with_replacement(df, F.col("id") % 2, {0: 2.0}, F.col("id"), 5)
    assert abs(some.count() - 20_000) < 600 and some.filter("id % 2 = 1").isEmpty()


def test_codes_of_many_values(spark):
    values = [f"v{k:05d}é" for k in range(5000)]
    df = spark.createDataFrame([(v,) for v in values[::97]] + [(None,), ("other",)], "s string")
    got = {r["s"]: r["c"] for r in df.select("s", factor.encode(F.col("s"), values).alias("c")).collect()}
    assert got.pop(None) is None and got.pop("other") is None and got == {v: float(k) for k, v in enumerate(values) if k % 97 == 0}


def test_moments_of_many_columns_are_those_of_few(spark):
    df = spark.range(300).select(*(F.when(F.col("id") % 41 != k, F.rand(k) * k + F.col("id") % (k + 2)).alias(f"x{k}") for k in range(15)), (F.col("id") * 0.5).alias("y"), (F.col("id") % 3).alias("w")).persist()
    xs = [F.col(f"x{k}") for k in range(15)]
    n, xx, xy = stats.moments(df, xs, F.col("y"), F.col("w"))
    r = stats.gram(df, xs, F.col("y"), F.col("w")).first()
    assert n == r["n"] and xx[3, 7] == pytest.approx(r["xx_3_7"]) == pytest.approx(xx[7, 3]) and xy[15] == pytest.approx(r["xy_15"]) and xx[15, 15] == pytest.approx(r["xx_15_15"])
    few = stats.moments(df, xs[:3], F.col("y"))
    assert few[1].shape == (4, 4) and few[1][0, 1] == pytest.approx(stats.gram(df, xs[:3], F.col("y")).first()["xx_0_1"])
    df.unpersist()
