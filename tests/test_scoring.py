"""Scorecards, voting trees and saved R forests."""

import gzip
import struct

import numpy as np
import pytest

from quillframe.plans.queries import ENSEMBLE, SCORECARD
from quillframe.score.pmml import Pmml
from quillframe.score.rforest import forest, read_r


def test_scorecard(spark):
    df = spark.createDataFrame([("5", "R", 0.05), ("10.5", "A", 0.0), (None, "Q", 0.0), ("x", None, None), ("30", "N", 1.0)], "quantity string, flag string, tax double")
    assert [r["score"] for r in Pmml(SCORECARD).score(df).collect()] == [15.0, 11.25, 5.0, 5.0, 13.0]
    assert [r["score"] for r in Pmml(SCORECARD).score(df.select("flag")).collect()][:2] == [8.0, 4.0]  # missing columns are missing values


@pytest.mark.parametrize("op, value, hits", [
    ("lessThan", "2", [1.0]), ("lessOrEqual", "2", [1.0, 2.0]), ("greaterThan", "2", [3.0]), ("greaterOrEqual", "2", [2.0, 3.0]), ("equal", "2", [2.0]), ("isMissing", None, [None]), ("isNotMissing", None, [1.0, 2.0, 3.0]),
])
def test_predicates(spark, op, value, hits):
    v = f'value="{value}"' if value else ""
    card = f'<PMML><DataDictionary><DataField name="a" dataType="integer"/></DataDictionary><Scorecard initialScore="0"><Characteristics><Characteristic><Attribute partialScore="1"><SimplePredicate field="a" operator="{op}" {v}/></Attribute></Characteristic></Characteristics></Scorecard></PMML>'
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "a double")
    assert [r["a"] for r in Pmml(card).score(df).collect() if r["score"] == 1] == hits


def test_duplicate_field():
    with pytest.raises(ValueError):
        Pmml('<PMML><DataDictionary><DataField name="a" dataType="double"/><DataField name="a" dataType="double"/></DataDictionary><Scorecard/></PMML>')


def test_ensemble(spark):
    df = spark.createDataFrame([(10.0, 1.0), (25.0, 40000.0), (40.0, 1.0), (None, None)], "quantity double, price double")
    assert [r["c"] for r in Pmml(ENSEMBLE).score(df, "c").collect()] == ["low", "high", "high", "low"]


def _r(value, names=None):
    """A value in R's XDR form."""
    has = 0x200 if names else 0
    if isinstance(value, list) and value and isinstance(value[0], str):
        out = struct.pack(">ii", 16 | has, len(value)) + b"".join(struct.pack(">ii", 9, len(s)) + s.encode() for s in value)
    elif isinstance(value, list):
        out = struct.pack(">ii", 19 | has, len(value)) + b"".join(value)
    elif value.dtype.kind == "i":
        out = struct.pack(">ii", 13 | has, len(value)) + value.astype(">i4").tobytes()
    else:
        out = struct.pack(">ii", 14 | has, len(value)) + value.astype(">f8").tobytes()
    if names:
        out += struct.pack(">i", 2 | 0x400) + struct.pack(">ii", 1, 9) + struct.pack(">i", 5) + b"names" + _r(names) + struct.pack(">i", 254)
    return out


def test_r_forest():
    i, d = (lambda *x: np.array(x, dtype=np.int32)), (lambda *x: np.array(x, dtype=float))
    inner = {
        "ntree": _r(d(1)), "nrnodes": _r(i(3)), "treemap": _r(i(2, 0, 0, 3, 0, 0)), "nodestatus": _r(i(1, -1, -1)), "bestvar": _r(i(2, 0, 0)), "nodepred": _r(i(0, 1, 2)),
        "xbestsplit": _r(d(1.5, 0, 0)), "ndbigtree": _r(i(3)), "xlevels": _r([_r(i(0)), _r(i(0))], ["a", "b"]),
    }
    top = {"classes": _r(["no", "yes"]), "forest": _r(list(inner.values()), list(inner))}
    data = gzip.compress(b"X\n" + struct.pack(">iii", 2, 0, 0) + _r(list(top.values()), list(top)))
    f = forest(data)
    assert f.names == ["a", "b"] and f.classes == ["no", "yes"]
    assert f.trees[0].predict(np.array([[9.0, 1.0], [0.0, 2.0]])).tolist() == [0, 1]
    with pytest.raises(ValueError):
        read_r(b"nothing")
