"""Named frames and numbers: the catalog that expressions refer to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.frame import Frame

#: Values that put_vector() takes at most.
MAX_VECTOR = 200_000


class Registry:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._items: dict[str, Frame | float] = {}

    def put(self, name: str, value: Frame | float) -> Frame | float:
        self._items[name] = value
        return value

    def put_df(self, name: str, df: DataFrame, order: str | Sequence[str], columns: Sequence[str] | None = None) -> Frame:
        return self.put(name, Frame.of(df, order, columns))

    def put_vector(self, name: str, values: str | Sequence[float]) -> Frame:
        """One column named 0 from numbers, or from text with numbers between spaces."""
        numbers = [float(x) for x in (values.split() if isinstance(values, str) else values)]
        if len(numbers) > MAX_VECTOR:
            raise ValueError(f"at most {MAX_VECTOR} values")
        df = self.spark.createDataFrame(list(enumerate(numbers)), "_rid long, `0` double")
        df._quillframe_numbered = True
        return self.put_df(name, df, "_rid", ["0"])

    def put_value(self, name: str, text: str) -> Frame:
        """A one-cell frame of text."""
        df = self.spark.createDataFrame([(0, text)], "_rid long, `0` string")
        df._quillframe_numbered = True
        return self.put_df(name, df, "_rid", ["0"])

    def get(self, name: str) -> Frame | float:
        if name not in self._items:
            raise KeyError(f"no such key: {name}")
        return self._items[name]

    def __contains__(self, name: str) -> bool:
        return name in self._items

    def get_vector(self, name: str, limit: int = 10_000) -> dict[str, list]:
        """Columns as lists of the first rows; missing values are "NaN"."""
        f = self.get(name)
        rows = f.head(limit).orderBy("_rid").collect()
        return {c: ["NaN" if r[c] is None else r[c] for r in rows] for c in f.names}

    def remove(self, name: str) -> None:
        self._items.pop(name, None)

    def view(self, like: str = "", offset: int = 0, limit: int = 1024) -> list[dict]:
        """Names that contain like, sorted, with rows, columns, and min, mean, max of the first five columns."""
        from quillframe.operators.summary import summary

        out = []
        for name in sorted(n for n in self._items if like in n)[offset : offset + limit]:
            f = self._items[name]
            if not isinstance(f, Frame):
                out.append({"key": name, "rows": 1, "columns": 1, "value": f})
                continue
            stats = summary(f.select(f.names[:5])).select("name", "min", "mean", "max").collect()
            out.append({"key": name, "rows": len(f), "columns": len(f.names), "stats": [r.asDict() for r in stats]})
        return out

    def export(self, name: str, path: str, form: str = "parquet") -> None:
        """Write a frame's columns: parquet, or csv with a header."""
        w = self.get(name).df.write
        w.option("header", True).csv(path) if form == "csv" else w.parquet(path)

    def as_table(self, name: str) -> DataFrame:
        """A named frame as a DataFrame; a number is one row."""
        f = self.get(name)
        return f.df if isinstance(f, Frame) else self.spark.range(1).select(F.lit(f).alias("value"))
