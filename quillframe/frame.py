"""Frames: named columns over a set of rows that has an order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RID = "_rid"
#: Rows up to which the shorter side of a positional join is broadcast.
BROADCAST_ROWS = 100_000


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def number_rows(df: DataFrame, order: Sequence[str], buckets: int = 0) -> DataFrame:
    """df with _rid, 0 to n - 1 in the order of columns.

    Rows are cut into ranges at bounds that a sample of the order columns
    gives, numbered within their range, and moved up by the counts of the
    ranges before; the driver holds a bound and a count for each range. No
    task sorts more than a range, and a frequent value of the first columns is
    cut by the others.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(df.dtypes)
    keys = [_orderable(col(c), kinds[c]).alias(f"k{i}") for i, c in enumerate(order)]
    bounds = []
    if n > 1:
        sample = df.select(*keys).orderBy(F.xxhash64(*keys)).limit(min(20 * n, 20_000)).orderBy(*(f"k{i}" for i in range(len(order)))).collect()
        bounds = list(dict.fromkeys(tuple(sample[len(sample) * k // n]) for k in range(1, n))) if sample else []
    bucket = F.lit(0)
    if bounds:
        of = [c.dataType.simpleString() for c in df.select(*keys).schema]
        array = F.array(*(F.struct(*(F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(b, of, strict=True)))) for b in bounds))
        # how many bounds are below the key: a binary search over one constant
        strides = [1 << k for k in reversed(range(len(bounds).bit_length()))]
        bucket = F.aggregate(
            F.array(*map(F.lit, strides)), F.lit(0),
            lambda at, step: F.when((at + step <= len(bounds)) & (F.get(array, at + step - 1) < F.struct(*keys)), at + step).otherwise(at),
        )
    with_bucket = df.withColumn("_bucket", bucket)
    counts = {r["_bucket"]: r["count"] for r in with_bucket.groupBy("_bucket").count().collect()}
    offsets, at = [], 0
    for k in range(len(bounds) + 1):
        offsets.append(at)
        at += counts.get(k, 0)
    w = Window.partitionBy("_bucket").orderBy(*(col(c) for c in order))
    return with_bucket.withColumn(RID, F.get(F.array(*(F.lit(x).cast("long") for x in offsets)), F.col("_bucket")) + F.row_number().over(w) - 1).drop("_bucket")


def _orderable(c: Column, kind: str) -> Column:
    """c, or whole numbers in the same order where a constant of its type isn't safe to pass through the driver."""
    return F.unix_micros(c) if kind == "timestamp" else F.unix_date(c) if kind == "date" else c


@dataclass(frozen=True, eq=False)
class Rows:
    """A DataFrame and the columns that order it; what has the same Rows is aligned row by row."""

    df: DataFrame
    order: tuple[str, ...]

    @cached_property
    def count(self) -> int:
        return self.df.count()

    @cached_property
    def numbered(self) -> DataFrame:
        """df with _rid."""
        if self.order == (RID,) and self._contiguous:
            return self.df
        return number_rows(self.df.drop(RID) if RID in self.df.columns and RID not in self.order else self.df, self.order)

    @property
    def _contiguous(self) -> bool:
        return getattr(self.df, "_quillframe_numbered", False)

    def filter(self, test: Column) -> Rows:
        return Rows(self.df.filter(test), self.order)


@dataclass(frozen=True, eq=False)
class Vec:
    """A column over some rows; frame is where it was selected from."""

    rows: Rows
    expr: Column
    name: str = "0"
    domain: tuple[str, ...] | None = None
    frame: Frame | None = None

    def as_frame(self) -> Frame:
        return Frame(self.rows, {self.name: self.expr}, {self.name: self.domain} if self.domain else {})


@dataclass(frozen=True, eq=False)
class Frame:
    """Named columns over rows. domains: sorted distinct strings of a categorical column, whose values are codes."""

    rows: Rows
    columns: dict[str, Column]
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @staticmethod
    def of(df: DataFrame, order: str | Sequence[str], columns: Sequence[str] | None = None) -> Frame:
        """All (or some) columns of df, ordered by one or more columns whose values are unique together."""
        order = (order,) if isinstance(order, str) else tuple(order)
        names = list(columns) if columns is not None else [c for c in df.columns if c != RID]
        return Frame(Rows(df, order), {c: col(c) for c in names})

    @property
    def names(self) -> list[str]:
        return list(self.columns)

    def __len__(self) -> int:
        return self.rows.count

    def vec(self, which: int | str) -> Vec:
        """A column by its 0-based place or exact name."""
        if isinstance(which, str):
            if which not in self.columns:
                raise KeyError(f"no column {which}")
            name = which
        else:
            if not 0 <= which < len(self.columns):
                raise IndexError(f"column {which} of {len(self.columns)}")
            name = self.names[which]
        return Vec(self.rows, self.columns[name], name, self.domains.get(name), self)

    def only(self) -> Vec:
        """The column of a one-column frame."""
        if len(self.columns) != 1:
            raise ValueError("a frame of one column, or a column of it, is needed here")
        return self.vec(0)

    def select(self, names: Sequence[str]) -> Frame:
        return Frame(self.rows, {c: self.columns[c] for c in names}, {c: d for c, d in self.domains.items() if c in names})

    def with_column(self, name: str, v: Vec) -> Frame:
        """Replace or add a column; rows of another source are aligned by their place."""
        if v.rows is not self.rows:
            rows, exprs = align([*(self.vec(c) for c in self.names), v])
            columns = dict(zip([*self.names, name] if name not in self.columns else self.names, exprs, strict=False))
            columns[name] = exprs[-1]
            out = Frame(rows, columns, dict(self.domains))
        else:
            out = Frame(self.rows, {**self.columns, name: v.expr}, dict(self.domains))
        domains = {**out.domains, name: v.domain} if v.domain else {c: d for c, d in out.domains.items() if c != name}
        return Frame(out.rows, out.columns, domains)

    def filter(self, test: Column) -> Frame:
        return Frame(self.rows.filter(test), self.columns, self.domains)

    @property
    def df(self) -> DataFrame:
        """The columns alone, in no order."""
        return self.rows.df.select(*(e.alias(c) for c, e in self.columns.items()))

    @property
    def with_rid(self) -> DataFrame:
        """_rid and the columns."""
        return self.rows.numbered.select(RID, *(e.alias(c) for c, e in self.columns.items()))

    def head(self, n: int, offset: int = 0) -> DataFrame:
        return self.with_rid.filter((F.col(RID) >= offset) & (F.col(RID) < offset + n))


def align(vecs: Sequence[Vec]) -> tuple[Rows, list[Column]]:
    """Columns of several row sets on common rows: as many as the longest has, shorter ones repeated from their start."""
    groups: list[Rows] = []
    for v in vecs:
        if all(v.rows is not g for g in groups):
            groups.append(v.rows)
    if len(groups) == 1:
        return groups[0], [v.expr for v in vecs]
    longest = max(groups, key=lambda g: g.count)
    names = [f"_v{k}" for k in range(len(vecs))]

    def part(g: Rows) -> DataFrame:
        return g.numbered.select(RID, *(v.expr.alias(n) for v, n in zip(vecs, names, strict=True) if v.rows is g))

    out = part(longest)
    for g in groups:
        if g is longest:
            continue
        side = part(g).withColumnRenamed(RID, "_other")
        if g.count <= BROADCAST_ROWS:
            side = F.broadcast(side)
        at = F.col(RID) if g.count == longest.count else F.pmod(F.col(RID), F.lit(max(1, g.count)))
        out = out.join(side, at == F.col("_other")).drop("_other")
    out._quillframe_numbered = True
    return Rows(out, (RID,)), [F.col(n) for n in names]
