"""Whole-column aggregates; missing values and NaN don't count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.frame import Vec
from quillframe.functions import ieee

AGGREGATES = {
    "min": lambda c: F.min(ieee.valid(c)),
    "max": lambda c: F.max(ieee.valid(c)),
    "sum": lambda c: F.coalesce(F.sum(ieee.valid(c)), F.lit(0.0)),
    "mean": lambda c: F.avg(ieee.valid(c)),
    "sigma": lambda c: F.stddev_pop(ieee.valid(c)),
}


def column_aggregate(v: Vec, name: str) -> float:
    """One number of a column; NaN where no value counts (0 for a sum)."""
    x = v.rows.df.agg(AGGREGATES[name](v.expr).alias("x")).first()["x"]
    return float("nan") if x is None else float(x)


def aggregates(v: Vec, names: list[str]) -> DataFrame:
    """Several aggregates of a column in one pass: one row, a column each."""
    return v.rows.df.agg(*(AGGREGATES[n](v.expr).alias(n) for n in names))


def class_counts(df: DataFrame, label: Column) -> DataFrame:
    """class, count for each value of a whole-number label that isn't missing."""
    return df.select(label.cast("long").alias("class")).filter("class is not null").groupBy("class").agg(F.count("*").alias("count"))


def class_ratios(df: DataFrame, label: Column) -> DataFrame:
    """class, count, ratio to all rows with a class."""
    counts = class_counts(df, label)
    total = df.agg(F.count(label.cast("long"))).first()[0]
    return counts.select("class", "count", (F.col("count") / F.lit(total)).alias("ratio"))


def majority_rows(df: DataFrame, label: Column) -> int:
    """Rows of the most frequent class."""
    return class_counts(df, label).agg(F.max("count")).first()[0] or 0


def rows_of_classes(df: DataFrame, label: Column, classes: list[int]) -> DataFrame:
    """Rows whose class is one of those given."""
    return df.filter(label.cast("long").isin(classes))
