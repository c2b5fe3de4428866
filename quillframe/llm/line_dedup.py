"""Line dedup over overlapping three-line windows, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines in a window.
WINDOW = 3


def _key(d: str, h: str) -> Column:
    """A place in the order of documents, with nulls first."""
    return F.struct(F.col(d), F.col(h))


def _windows(docs: DataFrame) -> DataFrame:
    """d, h (the row's key), i, w1, w2: the window that starts at line i and its 128-bit hash."""
    lines = docs.select("d", "h", F.split("text", "\n").alias("_q_lines"))
    at = F.when(
        F.size("_q_lines") >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size("_q_lines") - (WINDOW - 1)),
            lambda i: F.struct(
                (i - 1).alias("i"),
                F.xxhash64(*(F.element_at("_q_lines", i + k) for k in range(WINDOW))).alias("w1"),
                F.xxhash64(F.lit(11), *(F.element_at("_q_lines", i + k) for k in range(WINDOW))).alias("w2"),
                F.concat(*(F.element_at("_q_lines", i + k) for k in range(WINDOW))).eqNullSafe("").alias("blank"),
            ),
        ),
    )
    return lines.select("d", "h", F.explode(at).alias("x")).select("d", "h", "x.*").filter("not blank").drop("blank")


def repeated_starts(docs: DataFrame) -> DataFrame:
    """d, h, starts: for each document the windows that repeat one that came before."""
    windows = _windows(docs)
    first = (
        windows.groupBy("w1", "w2")
        .agg(F.min(F.struct("d", "h", "i")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1").drop("n")
    )
    later = windows.join(first, ["w1", "w2"]).filter(F.struct("d", "h", "i") > F.col("first"))
    return later.groupBy("d", "h").agg(F.collect_set("i").alias("_q_starts"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text, and the other columns of docs as they were.

    Lines end at \\n. Every window of three consecutive lines, blank ones
    excepted if all three are blank, is looked up among the windows of all
    documents; all but the first (least doc_id, nulls first, then least line)
    are covered, and lines under any covered window go. A document of fewer
    than three lines keeps them all; null texts stay null with n_lines 0; a
    text that loses every line becomes empty. Rows with the same doc_id and the
    same text count as one document and get the same result. Of the columns
    of docs, n_lines and n_removed are replaced if they exist.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_q_row"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text")
    starts = repeated_starts(keyed.select("d", "h", "text"))
    starts = starts.select(F.col("d").alias("_q_d"), F.col("h").alias("_q_h"), "_q_starts")
    both = keyed.join(starts, F.col("d").eqNullSafe(F.col("_q_d")) & (F.col("h") == F.col("_q_h")), "left")
    lines = F.split("text", "\n")
    gone = F.array_distinct(F.flatten(F.transform("_q_starts", lambda i: F.sequence(i, i + (WINDOW - 1)))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(F.col("_q_starts").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    )
    return both.select(
        *(F.col("_q_row")[c].alias(c) for c in keep if c != "text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("int").alias("n_lines"),
        F.coalesce(F.size(F.when(F.col("_q_starts").isNotNull(), gone)), F.lit(0)).alias("n_removed"),
        text.alias("text"),
    )


SQL = """
with l as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
w as (
  select doc_id, i, lines[i] as a, lines[i + 1] as b, lines[i + 2] as c
  from (select doc_id, lines, unnest(range(1, len(lines) - 1)) as i from l where len(lines) >= 3)
),
f as (
  select *, row_number() over (partition by a, b, c order by doc_id, i) as k
  from w where a || b || c <> ''
),
gone as (select distinct doc_id, i - 1 + unnest([0, 1, 2]) as i from f where k > 1),
g as (select doc_id, list(i) as places from gone group by doc_id)
select l.doc_id, cast(coalesce(len(lines), 0) as integer) as n_lines, cast(coalesce(len(places), 0) as integer) as n_removed,
  case when places is null then text else
    coalesce(array_to_string(list_filter(lines, lambda x, i: not list_contains(places, i - 1)), chr(10)), '') end as text
from l left join g on l.doc_id = g.doc_id
"""
