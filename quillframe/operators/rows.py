"""Filters, slices and samples of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.frame import RID, Frame, Rows, Vec, align
from quillframe.functions import ieee

#: Rows of an exact-size sample's last bucket that are ordered at once.
_ORDERED = 100_000


def keeps(bits: Column) -> Column:
    """Whether a bit keeps its row: its whole part isn't 0. Missing and NaN drop it."""
    b = ieee.dbl(bits)
    return F.coalesce(~F.isnan(b) & (F.abs(b) >= 1), F.lit(False))


def filter_rows(f: Frame, bits: Vec) -> Frame:
    """The rows of f whose bit isn't 0, in their order; lengths must be the same."""
    if bits.rows is f.rows:
        return f.filter(keeps(bits.expr))
    if f.rows.count != bits.rows.count:
        raise ValueError("the bit vector's length isn't the frame's")
    on, exprs = align([*(f.vec(c) for c in f.names), bits])
    return Frame(Rows(on.df.filter(keeps(exprs[-1])), on.order), dict(zip(f.names, exprs[:-1], strict=True)), f.domains)


def slice_rows(f: Frame, start: int, count: int = -1) -> Frame:
    """count rows from row start on; -1: all that follow."""
    n = f.rows.count
    if not 0 <= start < n:
        raise ValueError(f"start must be in 0 to {n - 1}")
    if count >= 0 and start + count > n:
        raise ValueError("the slice ends after the last row")
    rid = F.col(RID)
    test = rid >= start if count < 0 else (rid >= start) & (rid < start + count)
    df = f.rows.numbered.filter(test)
    return Frame(Rows(df, f.rows.order if f.rows.order != (RID,) else (RID,)), f.columns, f.domains)


def exact_sample(df: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    """Exactly n rows (all, if there are fewer), those with the least hash of a unique key and seed.

    A histogram of the hashes' upper bits finds the one bucket that is taken
    in part, and further ones of the bits below cut it until few rows are
    left; only those are ordered.
    """
    if n <= 0:
        return df.limit(0)
    h = F.xxhash64(key, F.lit(seed))
    with_hash = df.withColumn("_h", h)

    def top(bits: int) -> Column:
        return F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("long")

    bits, prefix, before = 0, 0, 0
    while bits < 60:
        counts = with_hash.filter(top(bits) == prefix).groupBy(top(bits + 10).alias("b")).count().collect()  # at most 1024 rows
        for r in sorted(counts):
            if before + r["count"] >= n:
                break
            before += r["count"]
        else:
            return df  # fewer rows than asked for; that shows in the first histogram
        bits, prefix = bits + 10, r["b"]
        if r["count"] <= _ORDERED:
            break
    part = with_hash.filter(top(bits) == prefix).orderBy("_h", key).limit(n - before)
    return with_hash.filter(top(bits) < prefix).unionByName(part).drop("_h")


def random_rows(f: Frame, n: int, seed: int = 0) -> Frame:
    """n rows at random, always the same for a seed, in their order."""
    if n > f.rows.count:
        raise ValueError("more rows are asked for than there are")
    key = F.struct(*(F.col(f"`{c}`") for c in f.rows.order))
    return Frame(Rows(exact_sample(f.rows.df, F.to_json(key), n, seed), f.rows.order), f.columns, f.domains)


def random_bits(spark: SparkSession, size: int, selected: int, seed: int = 0) -> Frame:
    """A column "bits" of size values, exactly selected of them 1."""
    if selected > size:
        raise ValueError("more bits are selected than there are")
    every = spark.range(size).withColumnRenamed("id", RID)
    on = exact_sample(every, F.col(RID), selected, seed).select(F.col(RID).alias("_on"))
    df = every.join(on, every[RID] == on["_on"], "left").select(RID, F.when(F.col("_on").isNotNull(), 1.0).otherwise(0.0).alias("bits"))
    df._quillframe_numbered = True
    return Frame.of(df, RID, ["bits"])


def fold(f: Frame, k: int, which: int, complement: bool = False) -> Frame:
    """Systematic folds: training rows leave out every k-th row from which on; complement gives just those."""
    rid = F.pmod(F.col(RID) - which, F.lit(k)) == 0
    return Frame(Rows(f.rows.numbered.filter(rid if complement else ~rid), f.rows.order), f.columns, f.domains)


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) for a key and a seed: the first 52 bits of a digest of both as text, so that any engine can repeat it."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def bernoulli(df: DataFrame, key: Column, rate: float, seed: int) -> DataFrame:
    """Each row with probability rate, decided by its key and seed: a run can be repeated."""
    return df.filter(uniform(key, seed) < rate)


def in_bag(key: Column, rate: float, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(rate * (1 << 30))


def poisson_steps(rate: float) -> list[float]:
    """Where the count of a Poisson variable goes up by one as its uniform number grows."""
    p = total = math.exp(-rate)
    out = []
    for k in range(1, 60):
        out.append(total)
        p *= rate / k
        if total + p == total:
            break
        total += p
    return out


def _times(df: DataFrame, n: Column) -> DataFrame:
    """Every row as often as n says."""
    often = df.withColumn("_n", n).filter("_n > 0")
    return often.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_k")


def _drawn(key: Column, rate: float, seed: int) -> Column:
    u = uniform(key, seed)
    return F.size(F.filter(F.array(*map(F.lit, poisson_steps(rate))), lambda c: u >= c))


def with_replacement(df: DataFrame, key: Column, rate: float, seed: int) -> DataFrame:
    """Each row as often as a Poisson variable of mean rate says, which its key and seed decide: draws with replacement whose size is near rate times the rows."""
    return _times(df, _drawn(key, rate, seed))


def stratified_with_replacement(df: DataFrame, label: Column, rates: dict, key: Column, seed: int = 0) -> DataFrame:
    """with_replacement() at a rate of its own for each class; other classes give no rows."""
    n = F.lit(0)
    for c, rate in rates.items():
        n = F.when(label == c, _drawn(key, rate, seed)).otherwise(n)
    return _times(df, n)


def stratified(df: DataFrame, label: Column, sizes: dict, key: Column, seed: int = 0) -> DataFrame:
    """Up to sizes[class] rows of each class, exactly that many where the class has them."""
    out = None
    for c, n in sizes.items():
        part = exact_sample(df.filter(label == c), key, n, seed)
        out = part if out is None else out.unionByName(part)
    return df.limit(0) if out is None else out
