"""Types of text columns, found in one pass, and the typed projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.frame import col
from quillframe.operators.factor import MAX_DOMAIN

#: A numeric column of which more values than this share are no numbers is given up.
MAX_BAD = 0.2
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_TIME = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,3})?$"


def text_of(c: Column) -> Column:
    """A cell without outer blanks; empty is missing."""
    return F.nullif(F.trim(c), F.lit(""))


def number_of(c: Column) -> Column:
    """The number that a text is, else NULL: sign, fraction, exponent, a leading $, a trailing % that divides by 100."""
    t = F.regexp_replace(F.trim(c), r"^\$", "")
    percent = t.endswith("%")
    t = F.regexp_replace(t, r"%$", "")
    x = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    return F.when(percent, x / 100).otherwise(x)


def time_of(c: Column) -> Column:
    """A time yyyy-MM-dd HH:mm:ss[.SSS] from 1970 on, in UTC; else NULL."""
    t = F.trim(c)
    return F.when(t.rlike(_TIME) & (F.substring(t, 1, 4).try_cast("int") >= 1970), F.try_to_timestamp(t))


def infer(df: DataFrame, names: Sequence[str], give_up_wide: bool = False) -> dict[str, str]:
    """int, float, time, enum, none (nothing but missing values) or bad (given up) for each text column.

    Text of more distinct values than a domain may have is kept as text, or
    given up if give_up_wide says so.
    """
    aggs = []
    for i, n in enumerate(names):
        t = text_of(col(n))
        x, ts = number_of(t), time_of(t)
        text = t.isNotNull() & x.isNull() & ts.isNull()
        whole = x.isNotNull() & t.rlike(r"^\$?[+-]?[0-9]{1,18}$")
        aggs += [
            F.count(x).alias(f"num{i}"), F.count(ts).alias(f"ts{i}"), F.count(F.when(text, 1)).alias(f"text{i}"), F.count(F.when(whole, 1)).alias(f"whole{i}"),
            F.approx_count_distinct(F.when(text, t), 0.02).alias(f"near{i}"),
        ]
    r = df.agg(*aggs).first()
    out = {}
    for i, n in enumerate(names):
        num, ts, text, near = (r[f"{k}{i}"] for k in ("num", "ts", "text", "near"))
        if ts:
            out[n] = "time"
        elif num:
            out[n] = "bad" if text > MAX_BAD * (num + text) else "int" if r[f"whole{i}"] == num else "float"
        elif text:
            wide = give_up_wide and near > 0.9 * MAX_DOMAIN and df.select(text_of(col(n))).distinct().limit(MAX_DOMAIN + 2).count() > MAX_DOMAIN
            out[n] = "bad" if wide else "enum"
        else:
            out[n] = "none"
    return out


def typed(c: Column, kind: str) -> Column:
    t = text_of(c)
    return {
        "int": lambda: number_of(t).cast("bigint"), "float": lambda: number_of(t), "time": lambda: time_of(t),
        "enum": lambda: t, "none": lambda: F.lit(None).cast("tinyint"), "bad": lambda: F.lit(None).cast("double"),
    }[kind]()


def project(df: DataFrame, kinds: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*(col(k) for k in keep), *(typed(col(n), k).alias(n) for n, k in kinds.items()))
