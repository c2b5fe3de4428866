"""Random forests: Spark grows one tree a bag, bags are decided by hashes so that out-of-bag rows are known again."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.frame import Frame
from quillframe.functions import ieee
from quillframe.operators.factor import MAX_DOMAIN, domain, encode
from quillframe.operators.rows import in_bag


#: Trees that grow at the same time.
TOGETHER = 8
#: Rows of a part that one task reads for each level of a tree.
PART_ROWS = 500_000


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1. A row goes left if its value is at most the threshold."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    prediction: list[int]

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right, prediction = map(np.asarray, (self.feature, self.threshold, self.left, self.right, self.prediction))
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := np.flatnonzero(feature[at] >= 0)).size:
            n = at[inner]
            at[inner] = np.where(x[inner, feature[n]] <= threshold[n], left[n], right[n])
        return prediction[at]

    @property
    def depth(self) -> int:
        deep = [0] * len(self.feature)
        for i, f in enumerate(self.feature):
            if f >= 0:
                for j in (self.left[i], self.right[i]):
                    deep[j] = deep[i] + 1
        return max(deep)

    @property
    def leaves(self) -> int:
        return sum(f < 0 for f in self.feature)

    def code(self, names: Sequence[str], classes: Sequence[str], i: int = 0, indent: int = 0) -> str:
        """The tree as nested conditions."""
        pad = "  " * indent
        if self.feature[i] < 0:
            return f"{pad}return {classes[self.prediction[i]]}"
        return (
            f"{pad}if {names[self.feature[i]]} <= {self.threshold[i]:g}:\n{self.code(names, classes, self.left[i], indent + 1)}\n"
            f"{pad}else:\n{self.code(names, classes, self.right[i], indent + 1)}"
        )

    def dot(self, names: Sequence[str], classes: Sequence[str]) -> str:
        """The tree in Graphviz's language."""
        out = ["digraph tree {"]
        for i, f in enumerate(self.feature):
            out.append(f'  n{i} [label="{classes[self.prediction[i]] if f < 0 else f"{names[f]} <= {self.threshold[i]:g}"}"];')
            if f >= 0:
                out += [f"  n{i} -> n{self.left[i]} [label=yes];", f"  n{i} -> n{self.right[i]} [label=no];"]
        return "\n".join([*out, "}"])

    @staticmethod
    def from_debug_string(text: str) -> Tree:
        """From Spark's printed form of a tree over numeric features."""
        t = Tree([], [], [], [], [])
        lines = [x.strip() for x in text.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]
        at = 0

        def node() -> int:
            nonlocal at
            i = len(t.feature)
            for a, v in zip((t.feature, t.threshold, t.left, t.right, t.prediction), (-1, 0.0, -1, -1, 0), strict=True):
                a.append(v)
            line = lines[at]
            at += 1
            if m := re.match(r"Predict: (\S+)", line):
                t.prediction[i] = int(float(m[1]))
                return i
            m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
            t.feature[i], t.threshold[i] = int(m[1]), float(m[2])
            t.left[i] = node()
            at += 1  # Else
            t.right[i] = node()
            return i

        node()
        return t


@dataclass
class Forest:
    names: list[str]
    response: str
    classes: list[str]
    trees: list[Tree]
    seeds: list[int] = field(default_factory=list)
    rate: float = 1.0
    weights: dict[str, float] = field(default_factory=dict)
    domains: dict[str, list[str]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(self.__dict__ | {"trees": [t.__dict__ for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Forest:
        d = json.loads(text)
        return Forest(**{**d, "trees": [Tree(**t) for t in d["trees"]]})

    def inputs(self, f: Frame) -> list[Column]:
        return [encode(_strings(f, c), self.domains[c]) if c in self.domains else ieee.valid(f.columns[c]) for c in self.names]

    def usage(self) -> dict[str, int]:
        """Splits by each column."""
        out = dict.fromkeys(self.names, 0)
        for t in self.trees:
            for i in t.feature:
                if i >= 0:
                    out[self.names[i]] += 1
        return out


def _strings(f: Frame, c: str) -> Column:
    d = f.domains.get(c)
    return F.get(F.array(*(F.lit(s) for s in d)), f.columns[c].cast("int")) if d else f.columns[c].cast("string")


def fit(
    f: Frame, response: str, predictors: Sequence[str] | None = None, ntree: int = 50, gini: bool = False, weights: dict[str, float] | None = None, strata: dict[str, float] | None = None,
    features: int | None = None, sample: int = 67, bin_limit: int = 1024, depth: int = 20, seed: int = 784834182943470027, key: Column | None = None,
) -> Forest:
    """A forest over rows without missing values. Trees see all rows of their bag, wherever those lie.

    sample is the share of rows in a bag, in percent; strata gives the share
    for single classes instead. depth is at most 30.
    """
    names = [c for c in (predictors or f.names) if c != response]
    kinds = dict(f.df.dtypes)
    classes = list(f.domains.get(response) or ()) or _classes(f, response)
    domains = {c: list(f.domains.get(c) or domain(f.rows.df, f.columns[c])) for c in names if kinds[c] == "string" or f.domains.get(c)}
    forest = Forest(names, response, classes, [], [], sample / 100, weights or {}, domains)
    y = encode(_strings(f, response), classes)
    df = f.rows.df.select(_key(f, key).alias("key"), y.alias("y"), *(x.cast("double").alias(f"x{k}") for k, x in enumerate(forest.inputs(f)))).na.drop()
    w = F.lit(1.0)
    for c, v in (weights or {}).items():
        w = F.when(F.col("y") == classes.index(c), float(v)).otherwise(w)
    seeds = [(seed + n * 7919) % (1 << 31) for n in range(ntree)]

    def bag(s: int) -> Column:
        out = in_bag(F.col("key"), sample / 100, s)
        for c, share in (strata or {}).items():
            out = F.when(F.col("y") == classes.index(c), in_bag(F.col("key"), share / 100, s)).otherwise(out)
        return out

    # a row keeps a bit for each bag in place of its key, and its values as they are: vectors are made of them when a tree reads them
    masks = [sum((F.when(bag(s), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, s in enumerate(seeds[i : i + 60])), F.lit(0).cast("long")).alias(f"bags{i // 60}") for i in range(0, ntree, 60)]
    xs = [f"x{k}" for k in range(len(names))]
    parts = _in_parts(df.select(F.xxhash64("key").alias("h"), "y", *xs, *masks), "h", len(f)).drop("h").persist()
    per_split = features or max(1, int(len(names) ** 0.5))
    try:
        def grow(n: int) -> tuple[Tree, int]:
            bag_seed = seeds[n]
            rows = parts.filter(F.col(f"bags{n // 60}").bitwiseAND(F.lit(1 << n % 60)) != 0).select("y", *xs)
            rows = VectorAssembler(inputCols=xs, outputCol="features").transform(rows).select("y", w.alias("w"), "features")
            rf = RandomForestClassifier(
                labelCol="y", featuresCol="features", weightCol="w", numTrees=1, bootstrap=False, subsamplingRate=1.0, impurity="gini" if gini else "entropy",
                maxBins=max(2, bin_limit), maxDepth=min(30, depth), featureSubsetStrategy=str(min(per_split, len(names))), seed=bag_seed,
            )
            return Tree.from_debug_string(rf.fit(rows).trees[0].toDebugString), bag_seed

        # bags don't depend on each other: several trees grow at a time, so that the cluster isn't idle between levels
        with ThreadPoolExecutor(max(1, min(TOGETHER, ntree))) as pool:
            for tree, bag_seed in pool.map(inheritable_thread_target(df.sparkSession)(grow), range(ntree)):
                forest.trees.append(tree)
                forest.seeds.append(bag_seed)
    finally:
        parts.unpersist()
    return forest


def _in_parts(df: DataFrame, by: str, rows: int) -> DataFrame:
    """df in parts whose size doesn't grow with it, dealt by a hash and in its order, so that a part is the same each time; few rows stay as they are."""
    if rows <= PART_ROWS:
        return df
    parts = max(-(-rows // PART_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts, by).sortWithinPartitions(by)


def _classes(f: Frame, response: str) -> list[str]:
    if dict(f.df.dtypes)[response] in ("int", "bigint", "smallint", "tinyint"):
        # whole numbers keep their own order
        found = f.rows.df.select(f.columns[response].alias("c")).filter("c is not null").distinct().limit(MAX_DOMAIN + 1).collect()
        if len(found) > MAX_DOMAIN:
            raise ValueError(f"more than {MAX_DOMAIN} classes")
        return [str(v) for v in sorted(r["c"] for r in found)]
    return domain(f.rows.df, f.columns[response])


def _key(f: Frame, key: Column | None) -> Column:
    return key if key is not None else F.to_json(F.struct(*(F.col(f"`{c}`") for c in f.rows.order)))


def vote(votes: np.ndarray, counts: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Class of each row by weighted majority, the lowest of equals; -1 without votes. votes: rows x trees, counts: which of them count."""
    total = np.zeros((len(votes), len(scale)))
    for t in range(votes.shape[1]):
        on = counts[:, t]
        np.add.at(total, (np.flatnonzero(on), votes[on, t]), scale[votes[on, t]])
    return np.where(total.max(axis=1) > 0, total.argmax(axis=1), -1)


def predict(forest: Forest, f: Frame, oob: bool = False, key: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """keep, actual, predicted (strings) for rows without missing predictors; out of bag, trees that saw a row don't vote on it, and rows without a vote go."""
    xs = forest.inputs(f)
    actual = _strings(f, forest.response) if forest.response in f.columns else F.lit(None).cast("string")
    bags = F.array(*(~in_bag(F.col("key"), forest.rate, s) for s in forest.seeds)) if oob else F.array().cast("array<boolean>")
    df = f.rows.df.select(*(f.columns[c].alias(c) for c in keep), _key(f, key).alias("key"), actual.alias("actual"), *(x.cast("double").alias(f"_x{k}") for k, x in enumerate(xs)))
    df = df.filter(" and ".join(f"_x{k} is not null" for k in range(len(xs)))) if xs else df
    df = df.withColumn("_out", bags).drop("key")
    shared = f.rows.df.sparkSession.sparkContext.broadcast(forest.to_json())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Forest.from_json(shared.value)
        scale = np.array([model.weights.get(c, 1.0) for c in model.classes])
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(f"_x{k}").to_numpy(zero_copy_only=False) for k in range(len(model.names))])
            votes = np.column_stack([t.predict(x) for t in model.trees])
            counts = np.array(b.column("_out").to_pylist()) if oob else np.ones(votes.shape, dtype=bool)
            best = vote(votes, counts, scale)
            labels = [model.classes[i] if i >= 0 else None for i in best]
            yield pa.record_batch([*(b.column(c) for c in keep), b.column("actual"), pa.array(labels, pa.string())], [*keep, "actual", "predicted"])

    kinds = dict(f.df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "actual string", "predicted string"])
    out = df.mapInArrow(run, schema)
    return out.filter("predicted is not null") if oob else out


def confusion(forest: Forest, f: Frame, oob: bool = False, key: Column | None = None) -> tuple[list[str], np.ndarray]:
    """The union of the model's and the data's classes, and counts of actual (rows) by predicted (columns)."""
    rows = predict(forest, f, oob, key).filter("actual is not null").groupBy("actual", "predicted").count().collect()
    extra = {r["actual"] for r in rows} - set(forest.classes)
    try:
        names = sorted({*forest.classes, *extra}, key=float)
    except ValueError:
        names = sorted({*forest.classes, *extra})
    m = np.zeros((len(names), len(names)), dtype=np.int64)
    for r in rows:
        m[names.index(r["actual"]), names.index(r["predicted"])] += r["count"]
    return names, m


def majority_vote(df: DataFrame, rid: str, prediction: str) -> DataFrame:
    """rid, predicted: the most frequent of a row's predictions, the least of equals."""
    n = df.groupBy(rid, prediction).agg(F.count("*").alias("n"))
    best = n.groupBy(rid).agg(F.max(F.struct("n", (-F.col(prediction)).alias("c"))).alias("b"))
    return best.select(rid, (-F.col("b.c")).alias("predicted"))
