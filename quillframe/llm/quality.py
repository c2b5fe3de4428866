"""Quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import map_batches, pieces

#: Rows of the table of indicators.
BITS = 16
#: Labelled documents that the model is fitted on, at most.
MAX_ROWS = 6000


def indicators(text: bytes | None, bits: int = BITS) -> np.ndarray:
    """Which of 2**bits hashed n-grams occur: byte 3-grams, and pairs and triples of word shapes.

    A word's shape says how it starts and ends, whether it is the word before,
    and roughly how long it is; pairs of shapes see repetition and layout.
    """
    flags = np.zeros(1 << bits, dtype=bool)
    b = np.frombuffer(text or b"", dtype=np.uint8)
    if len(b) >= 3:
        c = b.astype(np.uint32)
        code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
        flags[(code * np.uint32(2654435761)) >> np.uint32(32 - bits)] = True
    if len(b):
        space = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        if len(start):
            head, tail = _KIND[b[start]], _KIND[b[end - 1]]
            size = np.minimum((end - start) // 4, 3).astype(np.uint32)
            word = _words_hash(b, start, end)
            same = np.zeros(len(start), dtype=np.uint32)
            same[1:] = word[1:] == word[:-1]
            shape = head + 6 * tail + 36 * size + 144 * same
            for n in (1, 2, 3):
                if len(shape) >= n:
                    code = np.full(len(shape) - n + 1, n, dtype=np.uint32)
                    for k in range(n):
                        code = code * np.uint32(289) + shape[k : len(shape) - n + 1 + k]
                    flags[(code * np.uint32(2246822519)) >> np.uint32(32 - bits)] = True
    return flags


def _words_hash(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words: a sum over bytes weighted by their place in the word."""
    n = end - start
    owner = np.repeat(np.arange(len(start)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    inside = np.repeat(start, n) + place
    weight = _POWERS[np.minimum(place, len(_POWERS) - 1)]
    total = np.concatenate(([np.uint64(0)], np.cumsum(b[inside].astype(np.uint64) * weight, dtype=np.uint64)))
    at = np.concatenate(([0], np.cumsum(n)))
    return total[at[1:]] - total[at[:-1]]


_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
_KIND = np.full(256, 5, dtype=np.uint32)  # letters beyond ASCII
_KIND[:128] = 4
_KIND[[*range(97, 123)]] = 0
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(48, 58)]] = 2
_KIND[[ord(x) for x in ".,;:"]] = 3


@dataclass
class Model:
    """score = sigmoid(a * (weights of the indicators present + bias) + c)."""

    weights: np.ndarray
    bias: float
    a: float = 1.0
    c: float = 0.0
    bits: int = BITS

    def margin(self, text: bytes | None) -> float:
        on = np.flatnonzero(indicators(text, self.bits))
        return float(self.weights[on].sum() + self.bias)

    def score(self, text: bytes | None) -> float:
        z = min(30.0, max(-30.0, self.a * self.margin(text) + self.c))
        return 1 / (1 + math.exp(-z))


def _packed(flags: np.ndarray) -> bytes:
    """The places of the flags that are set, in two bytes each, or a bit for each flag where that isn't longer."""
    on = np.flatnonzero(flags)
    return on.astype("<u2").tobytes() if 2 * len(on) < len(flags) // 8 else np.packbits(flags).tobytes()


def _places(packed: bytes, bits: int = BITS) -> np.ndarray:
    """The places that _packed() was given, in two bytes each."""
    if len(packed) < (1 << bits) // 8:
        return np.frombuffer(packed, dtype="<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, dtype=np.uint8))).astype("<u2")


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    """log of (share of an indicator in class 1 / in class 0), smoothed by alpha."""
    p, q = np.full(size, alpha), np.full(size, alpha)
    for x, y in zip(rows, labels, strict=True):
        (p if y else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, labels: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model with L2 penalty over the features scale[row].

    Every class has the same total cost. The bias is a feature of value 1.
    """
    rng, n = np.random.default_rng(seed), len(rows)
    y = np.where(labels > 0, 1.0, -1.0)
    share = {s: max(1, int((y == s).sum())) for s in (1.0, -1.0)}
    upper = np.array([cost * n / (2 * share[s]) for s in y])
    w, bias, dual = np.zeros(len(scale)), 0.0, np.zeros(n)
    # scale[row] is taken anew at every step: kept, it would be the larger part of the driver's memory
    square = np.array([float(v @ v) + 1 for v in (scale[x] for x in rows)])
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(n):
            x = rows[i]
            v = scale[x]
            grad = y[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(dual[i] - grad / square[i], 0.0), upper[i])
            if (step := (new - dual[i]) * y[i]) != 0:
                w[x] += step * v
                bias += step
                most = max(most, abs(step) * math.sqrt(square[i]))
                dual[i] = new
        if most < tolerance:
            break
    return w, bias


def _calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """a, c of the logistic curve through the margins, by Newton's method with a little ridge."""
    sd = float(margins.std()) or 1.0
    m, t, theta = margins / sd, labels.astype(float), np.zeros(2)
    # targets short of 0 and 1, so that separable margins have a finite fit
    pos, neg = float(t.sum()), float((1 - t).sum())
    t = np.where(t > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([m, np.ones_like(m)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-6 * theta)
        theta += step
        if np.abs(step).max() < 1e-9:
            break
    return (theta[0] / sd, theta[1]) if theta[0] > 0 else (1.0, 0.0)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> Model:
    """The model of indicator rows (sorted positions) and 0/1 labels; margins for calibration come from two-fold fits."""
    size = 1 << bits

    def one(take: np.ndarray) -> tuple[np.ndarray, float]:
        part, y = [rows[i] for i in take], labels[take]
        r = log_count_ratios(part, y, size)
        w, b = dual_coordinate_descent(part, r, y, cost=0.01)
        return w * r, b

    if not len(labels) or labels.min() == labels.max():
        base = float(labels.mean()) if len(labels) else 0.5
        p = min(0.99, max(0.01, base))
        return Model(np.zeros(size), 0.0, 1.0, math.log(p / (1 - p)), bits)
    w, b = one(np.arange(len(rows)))
    margins = np.zeros(len(rows))
    for fold in (0, 1):
        held, kept = np.arange(fold, len(rows), 2), np.arange(1 - fold, len(rows), 2)
        if labels[kept].min() == labels[kept].max():
            fw, fb = w, b
        else:
            fw, fb = one(kept)
        margins[held] = [fw[rows[i]].sum() + fb for i in held]
    a, c = _calibrate(margins, labels)
    return Model(w, b, a, c, bits)


def training_labels(labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, y of the rows that may be learnt from: crc32 of doc_id's text mod 5 is not 0."""
    return labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).select(
        "doc_id", F.col(label).cast("int").alias("y")
    )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most max_rows labelled documents, taken in the order of a hash of doc_id.

    Executors turn the whole texts into indicators; the driver gets their
    positions only, at most max_rows times 2**BITS / 8 bytes, and holds them in
    two bytes for each indicator that a document has.
    Repeated labels of a document count once (the larger), and so do rows that
    repeat a doc_id. Without any usable
    row every score is one half.
    """
    chosen = training_labels(labels, label).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # of rows that repeat a doc_id, the text with the least hash: so no id brings more than one row to the driver
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    known = known.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "y", "x.text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            packed = [_packed(indicators(t)) for t in texts]
            yield pa.record_batch([part.column("doc_id"), part.column("y"), pa.array(packed, pa.binary())], ["doc_id", "y", "x"])

    found = map_batches(known, rows, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, x binary").collect()
    found.sort(key=lambda r: r["doc_id"])
    at = [_places(r["x"]) for r in found]
    return fit_rows(at, np.array([r["y"] for r in found], dtype=np.int64))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; empty and null texts get the score of no indicator."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float64), model.bias, model.a, model.c, model.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for part in pieces(batches, "text"):
            scores = [m.score(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
            rest = [part.column(n) for n in part.schema.names if n != "text"]
            names = [n for n in part.schema.names if n != "text"]
            yield pa.record_batch([*rest, pa.array(scores, pa.float64())], [*names, "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        (F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1)) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores at least threshold, with all their columns."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float64), model.bias, model.a, model.c, model.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for part in pieces(batches, "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            yield part.filter(pa.array([m.score(t) >= threshold for t in texts], pa.bool_()))

    return map_batches(docs, run, docs.schema)
