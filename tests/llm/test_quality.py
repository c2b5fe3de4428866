import tracemalloc
import zlib

import brute
import numpy as np
from pyspark.sql import functions as F

from quillframe.llm import quality
from quillframe.llm.queries import op7_quality

DIR = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def labels(spark, rows):
    return spark.createDataFrame([(i, q, "t", 0.1) for i, q in rows], "doc_id long, quality int, text string, score double")


def sample(n=80):
    """Good rows are sentences, bad ones junk."""
    return [(k, f"The {k}th sentence of a text. It goes on, and then it ends." if k % 2 else f"### {k} $$$ win%%% {k * 7} &&& now### ###") for k in range(n)]


def test_held_out_accuracy(spark):
    out = op7_quality(spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").filter("held_out")
    right = {q: out.filter(F.col("quality") == q).agg(F.avg((F.col("predicted") == q).cast("int"))).first()[0] for q in (0, 1)}
    assert right[0] >= 0.85 and right[1] >= 0.98


def test_query_covers_every_row(spark, small):
    out = op7_quality(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in small("documents"))
    for r in out:
        assert r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_labels_are_never_learnt(spark, docs):
    rows = sample()
    right = [(i, i % 2) for i, _ in rows]
    wrong = [(i, 1 - q if held(i) else q) for i, q in right]
    scores = [{r["doc_id"]: r["score"] for r in quality.score(docs(rows), quality.fit(docs(rows), labels(spark, x))).collect()} for x in (right, wrong)]
    assert scores[0] == scores[1]
    assert all((s >= 0.3) == bool(i % 2) for i, s in scores[0].items())


def test_odd_rows(spark, docs):
    rows = [*sample(), (900, None), (901, ""), (None, "The end of a text. And so on."), (902, "The end, " * 40_000), (1, sample()[1][1])]
    found = labels(spark, [*((i, i % 2) for i in range(80)), (3, 0), (None, 1), (5, None), (7777, 1), (900, 0), (901, 1)])
    df = docs(rows)
    model = quality.fit(df, found)
    out = quality.score(df, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    same = [r["score"] for r in out if r["doc_id"] in (900, 901)]
    assert same[0] == same[1] and [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in out)


def test_without_labels_or_rows(spark, docs):
    for found in ([], [(1, 1), (2, None)], [(1, 0), (3, 0)]):
        model = quality.fit(docs(sample()), labels(spark, found))
        out = quality.score(docs(sample()), model).collect()
        assert len({r["score"] for r in out}) == 1 and 0 <= out[0]["score"] <= 1
    assert quality.score(docs([]), quality.fit(docs([]), labels(spark, [(1, 1)]))).count() == 0


def test_bound_on_the_sample(spark, docs, monkeypatch):
    seen = []
    real = quality.fit_rows
    monkeypatch.setattr(quality, "fit_rows", lambda rows, y, **k: seen.append(len(y)) or real(rows, y, **k))
    quality.fit(docs(sample()), labels(spark, [(i, i % 2) for i in range(80)]), max_rows=20)
    assert seen == [20]


def test_dual_coordinate_descent_reaches_the_optimum():
    """The primal objective comes within a thousandth of what a subgradient method finds."""
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(60)]
    y = np.array([int(3 in x or rng.random() < 0.2) for x in rows])
    scale, cost, n = rng.normal(size=12), 0.5, 60
    w, b = quality.dual_coordinate_descent(rows, scale, y, cost=cost, epochs=2000, tolerance=1e-9)
    x = np.zeros((n, 13))
    for k, r in enumerate(rows):
        x[k, r] = scale[r]
    x[:, 12] = 1
    s = np.where(y > 0, 1, -1)
    c = cost * n / (2 * np.where(y > 0, (y > 0).sum(), (y == 0).sum()))
    value = lambda v: v @ v / 2 + (c * np.maximum(0, 1 - s * (x @ v))).sum()
    v, best = np.zeros(13), np.inf
    for k in range(1, 30_000):
        v -= (v - ((c * s * (s * (x @ v) < 1))[:, None] * x).sum(axis=0)) / (k + 20)
        best = min(best, value(v))
    assert value(np.append(w, b)) <= best * 1.001


def test_query_against_brute_force(spark, small):
    """Labels, indicators, ratios and scores in plain Python; the optimum has its own test."""
    texts = {r[0]: r[1] for r in small("documents")}
    known = {}
    for i, q, *_ in small("labels"):
        if q is not None and not held(i) and i in texts:
            known[i] = max(q, known.get(i, 0))
    ids = sorted(known)
    rows = [brute.indicators(texts[i], quality.BITS) for i in ids]
    assert all(np.flatnonzero(quality.indicators(t.encode())).tolist() == brute.indicators(t, quality.BITS) for t in list(texts.values())[:60])
    y = np.array([known[i] for i in ids])
    counts = [[1 + sum(1 for x, k in zip(rows, y, strict=True) if k == c and j in x) for c in (1, 0)] for j in rows[0][:50]]
    total = [sum(len(x) for x, k in zip(rows, y, strict=True) if k == c) + (1 << quality.BITS) for c in (1, 0)]
    ratios = quality.log_count_ratios([np.array(x) for x in rows], y, 1 << quality.BITS)
    assert np.allclose(ratios[rows[0][:50]], [np.log(p / total[0]) - np.log(q / total[1]) for p, q in counts])
    model = quality.fit_rows([np.array(x) for x in rows], y)
    for r in op7_quality(spark, "/root/testdata/sf0.001").collect():
        z = model.a * (sum(model.weights[j] for j in brute.indicators(texts[r["doc_id"]], quality.BITS)) + model.bias) + model.c
        assert abs(r["score"] - 1 / (1 + np.exp(-min(30, max(-30, z))))) < 1e-9


def test_rows_that_repeat_an_id_count_once(spark, docs, monkeypatch):
    seen = []
    real = quality.fit_rows
    monkeypatch.setattr(quality, "fit_rows", lambda rows, y, **k: seen.append(len(y)) or real(rows, y, **k))
    rows = sample(20)
    quality.fit(docs([*rows, *((1, f"text {k}") for k in range(50))]), labels(spark, [(i, i % 2) for i, _ in rows]))
    assert seen == [sum(not held(i) for i, _ in rows)]


def test_driver_holds_two_bytes_for_an_indicator(spark, docs, monkeypatch):
    """The fit's rows are small, and it makes no copy of them in eight bytes each."""
    seen, rng = [], np.random.default_rng(2)
    monkeypatch.setattr(quality, "fit_rows", lambda rows, y, f=quality.fit_rows, **k: seen.extend(rows) or f(rows, y, **k))
    texts = sample(20) + [(100, "".join(map(chr, rng.integers(33, 1000, 40_000)))), (101, "")]
    quality.fit(docs(texts), labels(spark, [(i, i % 2) for i, _ in texts]))
    want = [np.flatnonzero(quality.indicators(t.encode())) for i, t in texts if not held(i)]
    assert sorted(map(list, seen)) == sorted(map(list, want)) and max(map(len, want)) > 4096
    assert sum(x.nbytes for x in seen) == 2 * sum(map(len, want))
    rows = [np.sort(rng.choice(1 << quality.BITS, 2000, replace=False)).astype(np.uint16) for _ in range(1000)]
    tracemalloc.start()
    try:
        quality.dual_coordinate_descent(rows, np.ones(1 << quality.BITS), np.arange(1000) % 2, epochs=1)
        assert tracemalloc.get_traced_memory()[1] < 4_000_000  # the rows in eight bytes are 16 MB
    finally:
        tracemalloc.stop()
