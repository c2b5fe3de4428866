import random

import brute
import pytest

from quillframe.llm import common


@pytest.mark.parametrize("forest", [1_000_000, 40])
def test_components_against_brute_force(spark, monkeypatch, forest):
    """Stars, chains and single edges, repeated and in both directions, in one forest and in many that star steps join."""
    monkeypatch.setattr(common, "FOREST", forest)
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(-5, 7), (7, -5), (9, 9)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges * 2, "a long, b long").repartition(5)
    got = {r["node"]: r["root"] for r in common.components(df).collect()}
    pairs = {frozenset(e) for e in edges}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == brute.groups(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("forest", "tables"), [(1_000_000, 2), (40, None)])
def test_edges_of_one_forest_take_no_star_steps(spark, monkeypatch, forest, tables):
    """Rounds of joins over few edges are no more than plans, stages and tasks for the driver to hold."""
    monkeypatch.setattr(common, "FOREST", forest)
    written = []
    monkeypatch.setattr(common, "table", lambda df, f=common.table: written.append(1) or f(df))
    edges = [(k, k + 1) for k in range(99, 0, -1)] + [(200, 300), (300, 250)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {k: 1 for k in range(1, 101)} | {200: 200, 250: 200, 300: 200}
    assert len(written) == tables if tables else len(written) > 2
