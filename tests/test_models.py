"""Models against closed forms, known generators and independent optima."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.frame import Frame
from quillframe.ml import forest, glm, kmeans
from quillframe.ml.arguments import Case
from quillframe.ml.solver import admm, generalized_gradient


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=300), rng.integers(0, 3, size=300)
    eta = 0.5 * x + np.array([0, 1, -1])[z]
    y = rng.binomial(1, 1 / (1 + np.exp(-eta)))
    n = rng.poisson(np.exp(0.3 * x + 1))
    data = [(k, float(x[k]), "abc"[z[k]], int(y[k]), int(n[k]), float(2 + 3 * x[k]), None if k % 50 == 0 else 1.0) for k in range(300)]
    return Frame.of(spark.createDataFrame(data, "id long, x double, z string, y int, n int, line double, gap double"), "id")


def test_exact_line(frame):
    m = glm.fit(frame, "line", ["x"], lam=0.0)
    assert m.coefficients == pytest.approx({"x": 3.0, "Intercept": 2.0}) and m.converged and m.validation.deviance == pytest.approx(0, abs=1e-9)
    assert glm.fit(frame, "line", ["x"], lam=0.0, standardize=False).coefficients["x"] == pytest.approx(3.0)
    assert glm.GlmModel.from_json(m.to_json()).coefficients == m.coefficients


def _irls(x, y, inverse, var, steps=50):
    beta = np.zeros(x.shape[1])
    beta[-1] = 0.1
    for _ in range(steps):
        eta = x @ beta
        mu, d = inverse(eta)
        w = d * d / var(mu)
        beta = np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (w * (eta + (y - mu) / d)))
    return beta


def test_families_against_numpy(frame):
    rows = frame.df.orderBy("id").collect()
    x = np.array([[r["x"], 1.0] for r in rows])
    logit = lambda e: ((m := 1 / (1 + np.exp(-e))), m * (1 - m))
    m = glm.fit(frame, "y", ["x"], family="binomial", lam=0.0, beta_eps=1e-9)
    assert m.beta == pytest.approx(list(_irls(x, np.array([r["y"] for r in rows]), logit, lambda u: u * (1 - u))), rel=1e-5)
    v = m.validation
    assert v.n == 300 and 0.5 < v.auc < 1 and len(v.matrices) == 100 and v.deviance < v.null_deviance and v.aic == pytest.approx(v.deviance + 4)
    p = glm.fit(frame, "n", ["x"], family="poisson", lam=0.0, beta_eps=1e-9)
    assert p.beta == pytest.approx(list(_irls(x, np.array([r["n"] for r in rows]), lambda e: (np.exp(e), np.exp(e)), lambda u: u)), rel=1e-5)
    by = frame.rows.df.select(m.classify(frame).alias("c"), "y").groupBy("c", "y").count().collect()
    assert sum(r["count"] for r in by) == 300


def test_case_folds_and_missing(frame):
    m = glm.fit(frame, "z", ["x"], family="binomial", case=Case.parse("=b"), folds=3, max_iter=5)
    assert sum(v.n for v in m.folds) == 300 and len(glm.pooled(m.folds)) == 100
    assert glm.fit(frame, "line", ["x", "gap"], lam=0.0).validation.n == 294


def test_solvers_find_the_optimum():
    rng = np.random.default_rng(0)
    a = np.column_stack([rng.normal(size=(200, 4)), np.ones(200)])
    y = a @ np.array([2, 0, -1, 0.01, 3]) + rng.normal(size=200)
    xx, xy = a.T @ a / 200, a.T @ y / 200
    for lam, alpha in ((0.0, 0.5), (0.1, 0.0), (0.1, 0.5), (0.5, 1.0)):
        b, c = admm(xx, xy, lam, alpha), generalized_gradient(xx, xy, lam, alpha)
        assert b == pytest.approx(c, abs=1e-5)
        grad = xx @ b - xy + np.array([lam] * 4 + [0]) * (1 - alpha) * b
        for g, v, free in zip(grad, b, [0, 0, 0, 0, 1], strict=True):
            l1 = 0 if free else lam * alpha
            assert abs(g + l1 * np.sign(v)) < 1e-4 if abs(v) > 1e-7 else abs(g) <= l1 + 1e-4
    singular = np.array([[1.0, 1, 0], [1, 1, 0], [0, 0, 1]])
    assert np.isfinite(admm(singular, np.array([1.0, 1, 0]))).all()


def test_grid_order(frame):
    ms = glm.grid(frame, "y", "0.001,0.1", [0.5], predictors=["x", "z"], family="binomial", max_iter=6)
    assert [m.validation.auc for m in ms] == sorted((m.validation.auc for m in ms), reverse=True) and {m.lam for m in ms} == {0.001, 0.1}


def test_kmeans(spark):
    f = Frame.of(spark.createDataFrame([(k, v) for k, v in enumerate([1.2, 5.6, 3.7, 0.6, 0.1, 2.6])], "id long, v double"), "id")
    m = kmeans.fit(f, 2, ["v"], standardize=False)
    assert sorted(c[0] for c in m.centres) == pytest.approx([1.125, 4.65])
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0], [10, 0], [0, 10], [10, 10]])
    pts = (centres[:, None] + rng.normal(size=(4, 50, 2))).reshape(-1, 2)
    g = Frame.of(spark.createDataFrame([(k, float(a), float(b), 1.0) for k, (a, b) in enumerate(pts)], "id long, a double, b double, c double"), "id")
    m = kmeans.fit(g, 4, ["a", "b", "c"])
    assert m.names == ["a", "b"] and sorted([round(a, -1) + 0.0, round(b, -1) + 0.0] for a, b in m.centres) == sorted(map(list, centres.astype(float).tolist()))
    assert sorted(r["n"] for r in kmeans.score(m, g).collect()) == [50] * 4


def test_forest(spark):
    rng = np.random.default_rng(2)
    data = [(k, float(a), float(b), "hot" if a + b > 0 else "cold", "uv"[k % 2]) for k, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    f = Frame.of(spark.createDataFrame(data, "id long, a double, b double, y string, s string"), "id")
    m = forest.fit(f, "y", ["a", "b", "s"], ntree=6, depth=6, features=2)
    names, cm = forest.confusion(m, f)
    assert names == ["cold", "hot"] and cm.sum() == 400 and np.trace(cm) > 350
    _, oob = forest.confusion(m, f, oob=True)
    assert 350 <= oob.sum() <= 400 and np.trace(oob) > 0.8 * oob.sum()
    again = forest.Forest.from_json(m.to_json())
    assert again.trees[0].predict(np.array([[5.0, 5.0, 0.0]])) == m.trees[0].predict(np.array([[5.0, 5.0, 0.0]]))
    assert "return" in m.trees[0].code(m.names, m.classes) and m.trees[0].dot(m.names, m.classes).startswith("digraph") and sum(m.usage().values()) > 0
    assert m.trees[0].leaves >= 2 and m.trees[0].depth <= 6
    # classes that the model hasn't seen, and rows with missing values
    g = Frame.of(spark.createDataFrame([(1, 3.0, 3.0, "new", "u"), (2, None, 1.0, "hot", "u")], "id long, a double, b double, y string, s string"), "id")
    names, cm = forest.confusion(m, g)
    assert names == ["cold", "hot", "new"] and cm.sum() == 1


def test_votes():
    v = forest.vote(np.array([[0, 1, 1], [0, 1, 2], [2, 2, 0]]), np.array([[1, 1, 1], [1, 1, 1], [0, 0, 0]], dtype=bool), np.array([1.0, 1.0, 1.0]))
    assert v.tolist() == [1, 0, -1]
    assert forest.vote(np.array([[0, 1, 1]]), np.ones((1, 3), dtype=bool), np.array([3.0, 1.0])).tolist() == [0]


def test_majority_vote(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (1, 0), (2, 1), (2, 0)], "r long, p int")
    assert {tuple(r) for r in forest.majority_vote(df, "r", "p").collect()} == {(1, 2), (2, 0)}
    assert df.filter(F.lit(False)).count() == 0


def test_too_many_classes_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(forest, "MAX_DOMAIN", 5)
    f = Frame.of(spark.range(20).selectExpr("id", "id % 6 as y", "id * 2 as x"), "id")
    with pytest.raises(ValueError):
        forest.fit(f, "y", ["x"], ntree=1)


def test_forest_reads_bounded_parts(spark, monkeypatch):
    """However many rows a part of the table has, a task that grows trees reads few; the forest is the same."""
    df = spark.range(0, 20_000, 1, 1).selectExpr("id", "cast(hash(id) % 1000 as double) as a", "cast(hash(id, 1) % 50 as double) as b", "if(hash(id) % 1000 + hash(id, 2) % 300 > 0, 'u', 'v') as y")
    f = Frame.of(df, "id")
    once = dict(ntree=2, depth=4, features=2, strata={"u": 50.0}, weights={"v": 2.0})
    whole = forest.fit(f, "y", ["a", "b"], **once)
    seen = []

    class Watched(forest.RandomForestClassifier):
        def fit(self, rows):
            seen.append(max(r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()))
            return super().fit(rows)

    monkeypatch.setattr(forest, "PART_ROWS", 2000, raising=False)
    monkeypatch.setattr(forest, "RandomForestClassifier", Watched)
    assert forest.fit(f, "y", ["a", "b"], **once).to_json() == whole.to_json()
    assert len(seen) == 2 and max(seen) <= 2000


def test_grid_takes_the_passes_of_one_model(spark, frame):
    """However many pairs: each model is the one that is fitted alone."""
    options = dict(predictors=["x", "z"], family="binomial", max_iter=4, beta_eps=0.0)

    def jobs(name: str, *pairs) -> tuple[list, int]:
        spark.sparkContext.setJobGroup(name, name)
        try:
            return glm.grid(frame, "y", *pairs, **options), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        finally:
            spark.sparkContext.setJobGroup("", "")

    alone, n = jobs("grid-1", "0.1", "0.5")
    all_, m = jobs("grid-6", "0.001,0.01,0.1", "0,0.5")
    assert len(all_) == 6 and m == n and alone[0].beta == next(x for x in all_ if (x.lam, x.alpha) == (0.1, 0.5)).beta
    for x in all_:
        one = glm.fit(frame, "y", lam=x.lam, alpha=x.alpha, **options)
        assert one.beta == pytest.approx(x.beta) and one.validation.matrices == x.validation.matrices and one.validation.deviance == pytest.approx(x.validation.deviance)
    assert glm.grid(frame, "y", [], [], **options) == []
