"""Column summaries and pages of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.frame import RID, Frame
from quillframe.functions import ieee


def summary(f: Frame) -> DataFrame:
    """name, type, min, max, mean, sigma (population), n, na, domain: a row for each column, out of one pass."""
    n = len(f.columns)
    kinds = dict(f.df.dtypes)
    aggs = []
    for i, (c, e) in enumerate(f.columns.items()):
        text = kinds[c] == "string"
        x = ieee.valid(e) if not text and kinds[c] != "timestamp" else F.lit(None).cast("double")
        if kinds[c] == "timestamp":
            x = F.unix_millis(e).cast("double")
        if text:
            aggs += [
                F.when(F.count(e) > 0, F.lit(0.0)).alias(f"min{i}"), (F.nullif(F.countDistinct(e), F.lit(0).cast("bigint")) - 1).cast("double").alias(f"max{i}"),
                F.lit(None).cast("double").alias(f"mean{i}"), F.lit(None).cast("double").alias(f"sigma{i}"), F.count(e).alias(f"n{i}"),
                (F.count(F.lit(1)) - F.count(e)).alias(f"na{i}"), F.countDistinct(e).alias(f"domain{i}"),
            ]
        else:
            aggs += [
                F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_pop(x).alias(f"sigma{i}"),
                F.count(x).alias(f"n{i}"), (F.count(F.lit(1)) - F.count(x)).alias(f"na{i}"), F.lit(len(f.domains.get(c, ()))).cast("long").alias(f"domain{i}"),
            ]
    row = f.rows.df.agg(*aggs)
    kind = lambda c: "enum" if kinds[c] == "string" or f.domains.get(c) else "time" if kinds[c] == "timestamp" else "float" if kinds[c] in ("double", "float") or kinds[c].startswith("decimal") else "int"
    parts = F.array(*(
        F.struct(F.lit(c).alias("name"), F.lit(kind(c)).alias("type"), *(F.col(f"{k}{i}").alias(k) for k in ("min", "max", "mean", "sigma", "n", "na", "domain")))
        for i, c in enumerate(f.columns)
    ))
    return row.select(F.explode(parts).alias("x")).select("x.*") if n else row.limit(0)


def cell(c: Column) -> Column:
    """A cell as text; a missing value is NA."""
    return F.coalesce(c.cast("string"), F.lit("NA"))


def page(f: Frame, offset: int = 0, view: int = 100) -> DataFrame:
    """_rid and cells as text of up to 10000 rows from offset on; offset -1 gives no rows."""
    view = min(view, 10_000)
    columns = []
    for c, e in f.columns.items():
        d = f.domains.get(c)
        columns.append(cell(F.get(F.array(*(F.lit(s) for s in d)), e.cast("int")) if d else e).alias(c))
    if offset < 0:
        return f.rows.df.select(F.lit(0).cast("long").alias(RID), *columns).limit(0)
    return f.rows.numbered.filter((F.col(RID) >= offset) & (F.col(RID) < offset + view)).select(RID, *columns)


def trim(f: Frame, need_mean: bool = False) -> Frame:
    """f without constant columns, and without those that have no mean if that is asked for."""
    rows = {r["name"]: r for r in summary(f).collect()}
    keep = [c for c in f.names if rows[c]["n"] and rows[c]["min"] != rows[c]["max"] and (not need_mean or rows[c]["mean"] is not None)]
    return f.select(keep)


def default_columns(f: Frame, response: str) -> list[str]:
    """Predictors by default: columns that aren't constant and miss at most a tenth of their values."""
    return [r["name"] for r in summary(f).collect() if r["name"] != response and r["n"] and r["min"] != r["max"] and r["na"] <= 0.1 * (r["n"] + r["na"])]
