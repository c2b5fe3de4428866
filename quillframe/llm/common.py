"""Shared plumbing of the training-data operators: worker code, shared folder, batches, components."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.shared import new_path, remove

#: Bytes of text that one step of a Python operator holds at once.
BATCH_BYTES = 4 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name, buf = os.path.basename(root), io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for top, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(top, f)
                    z.write(p, os.path.join(name, os.path.relpath(p, root)))
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it from there as long as the session lives
    path = os.path.join(folder, f"{name}.zip")
    with open(path, "wb") as out:
        out.write(buf.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillframe_path = path
    # The step's shuffle files go once the JVM sees that nothing refers to them: on disk they may
    # outweigh the table, and a collection of the driver's small heap costs less than keeping them.
    spark.sparkContext._jvm.System.gc()
    return out


def drop_table(df: DataFrame) -> None:
    """Delete what table() wrote, once nothing reads it any more."""
    path = getattr(df, "_quillframe_path", None)
    if path:
        remove(df.sparkSession, path)


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose texts have about limit bytes; a longer text is a run alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def lower_ascii(col):
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Edges that one task joins into a forest at once.
FOREST = 1_000_000


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the edges u, v: (node, least node of its component) for all but the least."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, up = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        a, b = up[a], up[b]
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        np.minimum.at(up, b, a)
        while (up[up] != up).any():
            up = up[up]
    hung = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[hung], nodes[up[hung]]


def forests(edges: DataFrame, n: int) -> DataFrame:
    """u, v: edges with the same components as edges (u, v: long), fewer than nodes for each of n tasks' million."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > FOREST:
                held = [_forest(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) > FOREST // 2:
                    yield pa.record_batch([pa.array(x) for x in held.pop()], ["u", "v"])
                size = sum(len(x) for x, _ in held)
        if held:
            yield pa.record_batch([pa.array(x) for x in _forest(*map(np.concatenate, zip(*held, strict=True)))], ["u", "v"])

    return map_batches(edges.select("u", "v").coalesce(n), run, "u long, v long")


def _stars(hung: DataFrame) -> DataFrame:
    """node, root of the nodes u that hang under roots v, and of these roots."""
    return hung.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        hung.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps: (node, root), root the least node.

    Nodes are longs. Only nodes that stand on an edge between different nodes
    come back. Edges are first joined into forests, a million at a time; where
    that makes one forest, it is the answer. Every step deals out edges by one
    end and looks only at that end's least neighbour, an aggregate with a
    map-side part, so no group is gathered; the edge list never grows. Lineage
    is cut by a written table after each round.
    """
    e = table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v"))
    n = e.count()
    current, sign = table(forests(e, max(1, n // FOREST))), None
    drop_table(e)
    if n <= FOREST:  # one task had all edges: every node hangs under its component's least already
        return _stars(current)
    for _ in range(rounds):
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u hangs itself under u's least neighbour
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours hang under the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct()
        )
        following = table(small)
        now = following.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        drop_table(current)
        current = following
        if sign == tuple(now):
            return _stars(current)
        sign = tuple(now)
    raise RuntimeError("components did not settle")
