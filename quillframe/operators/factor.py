"""Categoricals: codes of sorted distinct strings."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.frame import Frame, Vec, col
from quillframe.functions import ieee

#: Distinct values of a categorical at most.
MAX_DOMAIN = 65_535


def domain(df: DataFrame, c: Column) -> list[str]:
    """The sorted distinct strings of a column; beyond the limit an error."""
    found = df.select(c.cast("string").alias("s")).filter("s is not null").distinct().limit(MAX_DOMAIN + 1).collect()
    if len(found) > MAX_DOMAIN:
        raise ValueError(f"more than {MAX_DOMAIN} distinct values")
    return sorted((r["s"] for r in found), key=lambda s: s.encode())


def encode(c: Column, values: list[str]) -> Column:
    """The code of a string: its place among values; NULL if it isn't one of them.

    The limit on values bounds the constant. Many values lie in buckets by
    their checksum, so that a lookup compares a few of them only.
    """
    if not values:
        return F.lit(None).cast("double")
    s = c.cast("string")
    if len(values) <= 64:
        return F.nullif(F.array_position(F.array(*(F.lit(v) for v in values)), s), F.lit(0).cast("bigint")).cast("double") - 1
    buckets: list[tuple[list[str], list[int]]] = [([], []) for _ in range(len(values) // 2)]
    for k, v in enumerate(values):
        names, codes = buckets[zlib.crc32(v.encode()) % len(buckets)]
        names.append(v)
        codes.append(k)
    table = F.from_json(F.lit(json.dumps([{"v": v, "c": k} for v, k in buckets])), "array<struct<v: array<string>, c: array<double>>>")
    one = F.get(table, F.pmod(F.crc32(s.cast("binary")), F.lit(len(buckets))).cast("int"))
    return F.get(one["c"], (F.array_position(one["v"], s) - 1).cast("int"))


def encode_by_join(df: DataFrame, name: str, out: str) -> DataFrame:
    """df with a column of codes, by a join with the numbered domain: for wide domains."""
    from pyspark.sql.window import Window

    values = df.select(col(name).cast("string").alias("_s")).filter("_s is not null").distinct()
    codes = values.select("_s", (F.row_number().over(Window.orderBy("_s")) - 1).cast("double").alias(out))  # at most MAX_DOMAIN rows
    return df.join(F.broadcast(codes), col(name).cast("string") == codes["_s"], "left").drop("_s")


def factor(v: Vec) -> Vec:
    """A column of codes with its domain. Numbers become strings as they print, so 10.0 comes before 9.0."""
    if v.domain:
        return v
    values = domain(v.rows.df, v.expr)
    return Vec(v.rows, encode(v.expr, values), v.name, tuple(values))


def one_hot(f: Frame, name: str) -> Frame:
    """A 0/1 column name.value for every value of a categorical, none left out."""
    v = f.vec(name)
    # strings are compared themselves, codes where the column has a domain already
    values = v.domain or domain(f.rows.df, v.expr)
    x = v.expr if v.domain else v.expr.cast("string")
    columns = {c: e for c, e in f.columns.items() if c != name}
    columns |= {f"{name}.{s}": (x == (k if v.domain else s)).cast("double") for k, s in enumerate(values)}
    return Frame(f.rows, columns, {c: d for c, d in f.domains.items() if c != name})


def standardize(f: Frame, names: list[str]) -> Frame:
    """(x - mean) / population deviation of numeric columns; constant columns become 0."""
    aggs = [g(ieee.valid(f.columns[c])).alias(f"{k}{i}") for i, c in enumerate(names) for k, g in (("m", F.avg), ("s", F.stddev_pop))]
    r = f.rows.df.agg(*aggs).first()
    scaled = {c: (ieee.dbl(f.columns[c]) - F.lit(r[f"m{i}"])) / F.lit(r[f"s{i}"] or 1.0) for i, c in enumerate(names)}
    return Frame(f.rows, {c: scaled.get(c, e) for c, e in f.columns.items()}, f.domains)


def bin_edges(df: DataFrame, c: Column, limit: int = 1024) -> list[float]:
    """Upper edges of up to limit ordered bins: each distinct value if there are few enough, else quantiles."""
    x = ieee.valid(c)
    few = df.select(x.alias("x")).filter("x is not null").distinct().limit(limit + 1).collect()
    if len(few) <= limit:
        return sorted(r["x"] for r in few)
    return sorted(set(df.agg(F.percentile_approx(x, [k / limit for k in range(1, limit + 1)], 100 * limit).alias("q")).first()["q"]))


def merge_domains(a: list[str], b: list[str]) -> tuple[list[str], list[int], list[int]]:
    """The union of two sorted domains, and where each code of either goes."""
    both = sorted(set(a) | set(b), key=lambda s: s.encode())
    at = {s: k for k, s in enumerate(both)}
    return both, [at[s] for s in a], [at[s] for s in b]
