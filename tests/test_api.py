"""The verbs of the engine, end to end on small frames."""

import pytest

from quillframe.api import Engine
from quillframe.plans.queries import SCORECARD


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark)
    lines = [f"{k},{k % 7},{2 * k + 1},{'yes' if k % 7 > 3 else 'no'}" for k in range(60)]
    (tmp_path / "t.csv").write_text("id,a,b,flag\n" + "\n".join(lines) + "\n")
    e.parse(str(tmp_path / "t.csv"), "t")
    return e


def test_data_verbs(engine, tmp_path):
    stats, page = engine.inspect("t", 5, 3)
    assert {r["name"]: r["type"] for r in stats.collect()} == {"id": "int", "a": "int", "b": "int", "flag": "enum"}
    assert [r["id"] for r in page.orderBy("_rid").collect()] == ["5", "6", "7"]
    engine.put_vector("v", "1 2 3")
    engine.put_value("w", "text")
    assert engine.get_vector("v") == {"0": [1.0, 2.0, 3.0]} and engine.get("w").first()[0] == "text"
    assert [x["key"] for x in engine.store_view()] == ["t", "v", "w"]
    engine.export("v", str(tmp_path / "out"))
    engine.parse(str(tmp_path / "out"), "back")
    assert engine.get("back").count() == 3
    engine.remove("back")
    with pytest.raises(KeyError):
        engine.get("back")


def test_expressions(engine):
    assert engine.exec("sum(t$b)") == sum(2 * k + 1 for k in range(60)) and engine.inspect("Result") == {"value": 3600.0}
    assert len(engine.slice("t", 50)) == 10 and len(engine.slice("t", 10, 5)) == 5 and len(engine.filter("t", "t$a > 3")) == 24
    assert engine.covariance("t", "id", "b").first()["correlation"] == pytest.approx(1)
    assert engine.linear_regression("t", "id", "b").first()["beta1"] == pytest.approx(2)


def test_models(engine):
    m = engine.glm("t", "b", "id", xval=2, lam=0.0)
    assert m.coefficients["id"] == pytest.approx(2) and len(m.folds) == 2 and engine.inspect("GLM")["response"] == "b"
    assert engine.score_row("GLM", {"id": 10}) == pytest.approx(21) and engine.glm_score("GLM", "t").deviance == pytest.approx(0, abs=1e-6)
    b = engine.glm("t", "flag", "1,id", to="B", family="binomial", case="=yes", xval=0, max_iter=6, lam=1e-3)
    assert b.validation.auc > 0.9 and {r["score"] for r in engine.score("B", "t").collect()} <= {0.0, 1.0}
    assert len(engine.glm_grid("t", "b", "id", "0.001,0.01", "0.5")) == 2
    k = engine.kmeans("t", 2, "id")
    assert len(k.centres) == 2 and len({r["score"] for r in engine.score("KMeans", "t").collect()}) == 2
    engine.random_forest("t", "flag", ignore="id", weights="yes=2", ntree=2, depth=3, features=2)
    view = engine.rf_view("RF", "t", oob=False)
    assert view["classes"] == ["no", "yes"] and view["rows"] == 60 and view["error"] == 0
    assert "return" in engine.rf_tree("RF", 0) and engine.rf_tree("RF", 1, "dot").startswith("digraph") and engine.score_row("RF", {"a": 6, "b": 13}) == "yes"


def test_scorecard(engine):
    engine.import_pmml(SCORECARD, "card")
    assert engine.score_row("card", {"quantity": 20.0, "flag": "R", "tax": 0.05}) == 15.75
    assert engine.score_row("card", {"quantity": None, "flag": "N", "tax": 0.0}) == 4.0 and engine.inspect("card") == {"kind": "pmml"}


def test_jobs(engine):
    key = engine.background("linear_regression", "t", "a", "b")
    assert engine.jobs.result(key, 120).first()["rows"] == 60
    assert engine.jobs.list()[0] | {"start": 0} == {"key": key, "description": "linear_regression", "start": 0, "state": "done", "progress": 1.0}
    bad = engine.background("linear_regression", "nosuch", "a", "b")
    with pytest.raises(KeyError):
        engine.jobs.result(bad, 60)
    slow = engine.jobs.start("slow", lambda: engine.spark.range(0, 10**13, 1, 4).selectExpr("sum(id * id % 7)").collect())
    while not engine.spark.sparkContext.statusTracker().getJobIdsForGroup(slow):
        pass
    assert engine.jobs.progress(slow) < 1
    with pytest.raises(ValueError):
        engine.jobs.remove(slow)
    engine.jobs.cancel(slow)
    with pytest.raises(Exception):  # noqa: B017  Spark's own error
        engine.jobs.result(slow, 120)
    assert [x["state"] for x in engine.jobs.list()] == ["failed", "failed", "done"]
    engine.jobs.remove(slow)
    assert len(engine.jobs.list()) == 2


def test_inspect_of_a_path(engine, tmp_path):
    assert engine.inspect(str(tmp_path / "t.csv"))["names"] == ["id", "a", "b", "flag"]
