"""One object with a verb for each thing a user can ask of the engine: names in, frames, models and DataFrames out."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.frame import Frame
from quillframe.jobs import Jobs
from quillframe.lang.evaluate import evaluate
from quillframe.ml import forest as forests
from quillframe.ml import glm as glms
from quillframe.ml import kmeans as clusters
from quillframe.ml.arguments import Case, class_numbers, columns, default_case
from quillframe.operators import stats, summary
from quillframe.registry import Registry
from quillframe.score import rforest
from quillframe.score.pmml import Pmml
from quillframe.sources import files

Model = glms.GlmModel | clusters.KMeansModel | forests.Forest | Pmml


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark, self.registry, self.models, self.jobs = spark, Registry(spark), {}, Jobs(spark)

    def background(self, verb: str, *args, **options) -> str:
        """Begin a verb, such as "glm", beside the caller; jobs has its state, progress, result, and cancels it."""
        return self.jobs.start(verb, lambda: getattr(self, verb)(*args, **options))

    # data

    def parse(self, path: str, key: str, header: bool | None = None, separator: str | None = None) -> Frame:
        """Delimited text, a workbook or Parquet at any path that Spark reads, under a name; what isn't given is found out."""
        options = {k: v for k, v in (("header", header), ("separator", separator)) if v is not None}
        return self.registry.put(key, files.import_path(self.spark, path, **options))

    def import_url(self, url: str, key: str) -> Frame:
        return self.registry.put(key, files.import_url(self.spark, url))

    def put(self, key: str, df: DataFrame, order: str | Sequence[str]) -> Frame:
        return self.registry.put_df(key, df, order)

    def put_value(self, key: str, text: str) -> Frame:
        return self.registry.put_value(key, text)

    def put_vector(self, key: str, values: str | Sequence[float]) -> Frame:
        return self.registry.put_vector(key, values)

    def get_vector(self, key: str, limit: int = 10_000) -> dict[str, list]:
        return self.registry.get_vector(key, limit)

    def get(self, key: str) -> DataFrame:
        return self.registry.as_table(key)

    def export(self, key: str, path: str, form: str = "parquet") -> None:
        self.registry.export(key, path, form)

    def remove(self, key: str) -> None:
        self.registry.remove(key)
        self.models.pop(key, None)

    def store_view(self, like: str = "", offset: int = 0, limit: int = 1024) -> list[dict]:
        return self.registry.view(like, offset, limit)

    def inspect(self, key: str, offset: int = 0, view: int = 100) -> tuple[DataFrame, DataFrame] | dict:
        """A frame's summary and a page of its rows; a model's values; of a path that no key has, what a parse would make of it."""
        if key not in self.models and key not in self.registry and "/" in key:
            return files.inspect_path(self.spark, key)
        if key in self.models:
            return self._values(self.models[key])
        f = self.registry.get(key)
        if not isinstance(f, Frame):
            return {"value": f}
        return summary.summary(f), summary.page(f, offset, view)

    @staticmethod
    def _values(model: Model) -> dict:
        if isinstance(model, Pmml):
            return {"kind": "pmml"}
        return json.loads(model.to_json()) if hasattr(model, "to_json") else dict(model.__dict__)

    # expressions

    def exec(self, expression: str, key: str = "Result") -> Frame | float:
        """The value of an expression, kept under a name."""
        return self.registry.put(key, evaluate(self.registry, expression))

    def slice(self, key: str, start: int, count: int = -1) -> Frame:
        return evaluate(self.registry, f"slice(|{key}|, {start}, {count})" if count >= 0 else f"slice(|{key}|, {start})")

    def filter(self, key: str, condition: str) -> Frame:
        return evaluate(self.registry, f"filter(|{key}|, {condition})")

    # statistics

    def covariance(self, key: str, x: str, y: str) -> DataFrame:
        f = self.registry.get(key)
        return stats.covariance(f.rows.df, f.columns[x], f.columns[y])

    def linear_regression(self, key: str, x: str, y: str) -> DataFrame:
        f = self.registry.get(key)
        return stats.linear_regression(f.rows.df, f.columns[x], f.columns[y])

    # models

    def glm(self, key: str, y: str, x: str = "", to: str = "GLM", xval: int = 10, family: str = "gaussian", case: str = "", **options) -> glms.GlmModel:
        """x: columns by name or place, with commas; without it all that vary. case: such as >=3; found out for a binomial response that needs one."""
        f = self.registry.get(key)
        self.models[to] = glms.fit(f, y, columns(f, x) if x else None, family=family, case=self._case(f, y, family, case), folds=xval, **options)
        return self.models[to]

    def glm_grid(self, key: str, y: str, x: str = "", lambdas: str = "1e-5", alphas: str = "0.5", family: str = "gaussian", case: str = "", **options) -> list[glms.GlmModel]:
        f = self.registry.get(key)
        return glms.grid(f, y, lambdas, alphas, predictors=columns(f, x) if x else None, family=family, case=self._case(f, y, family, case), **options)

    @staticmethod
    def _case(f: Frame, y: str, family: str, case: str) -> Case | None:
        return Case.parse(case) if case else default_case(f, y) if family == "binomial" else None

    def glm_score(self, model: str, key: str, thresholds: str = "0:1:0.01") -> glms.Validation:
        """A model's validation over another frame."""
        return glms.validate(self.models[model], self.registry.get(key), thresholds)

    def kmeans(self, key: str, k: int, cols: str = "", to: str = "KMeans", epsilon: float = 1e-6, **options) -> clusters.KMeansModel:
        f = self.registry.get(key)
        self.models[to] = clusters.fit(f, k, columns(f, cols) if cols else None, epsilon, **options)
        return self.models[to]

    def random_forest(self, key: str, response: str, to: str = "RF", ignore: str = "", weights: str = "", strata: str = "", **options) -> forests.Forest:
        f = self.registry.get(key)
        left = {response, *columns(f, ignore)} if ignore else {response}
        self.models[to] = forests.fit(f, response, [c for c in f.names if c not in left], weights=class_numbers(weights), strata=class_numbers(strata), **options)
        return self.models[to]

    def rf_view(self, model: str, key: str, oob: bool = True) -> dict:
        """Classes, confusion matrix, error and the trees' sizes."""
        m = self.models[model]
        names, counts = forests.confusion(m, self.registry.get(key), oob)
        total = int(counts.sum())
        return {
            "classes": names, "confusion": counts.tolist(), "rows": total, "error": 1 - int(counts.trace()) / total if total else 0.0,
            "depth": [t.depth for t in m.trees], "leaves": [t.leaves for t in m.trees], "usage": m.usage(),
        }

    def rf_tree(self, model: str, tree: int, form: str = "code") -> str:
        """A tree as nested conditions, or in Graphviz's language."""
        m = self.models[model]
        t = m.trees[tree]
        return t.dot(m.names, m.classes) if form == "dot" else t.code(m.names, m.classes)

    def import_pmml(self, text: str | bytes, to: str) -> Pmml:
        self.models[to] = Pmml(text)
        return self.models[to]

    def import_r(self, data: bytes, to: str) -> forests.Forest:
        self.models[to] = rforest.forest(data)
        return self.models[to]

    def score(self, model: str, key: str) -> DataFrame:
        """A frame's columns with the model's score."""
        m, f = self.models[model], self.registry.get(key)
        if isinstance(m, Pmml):
            return m.score(f.df)
        if isinstance(m, forests.Forest):
            return forests.predict(m, f, keep=f.names)
        c = m.classify(f) if isinstance(m, glms.GlmModel) and m.family == "binomial" else m.predict(f)
        return f.rows.df.select(*(e.alias(n) for n, e in f.columns.items()), c.alias("score"))

    def score_row(self, model: str, row: Mapping[str, float | int | str | None]) -> float | str | None:
        """One row of named values; what is missing is NULL."""
        made = self.spark.range(1).select(F.lit(0).cast("long").alias("_rid"), *(F.lit(v).alias(k) for k, v in row.items()))
        self.registry.put_df("_row", made, "_rid", list(row))
        try:
            out = self.score(model, "_row").first()
        finally:
            self.registry.remove("_row")
        return out["predicted" if isinstance(self.models[model], forests.Forest) else "score"]
