"""The expression language: grammar, positions of errors, and values against plain Python."""

import math

import pytest

from quillframe.lang.evaluate import evaluate
from quillframe.lang.parser import Assign, Binary, Name, Number, ParseError, Select, parse
from quillframe.registry import Registry


@pytest.fixture()
def reg(spark):
    r = Registry(spark)
    df = spark.createDataFrame([(k, float(k * k), float(k % 3), None if k == 4 else k, "abc"[k % 3]) for k in range(10)], "id long, sq double, m double, gap int, s string")
    r.put_df("t", df, "id")
    r.put_vector("v", "1 2 3")
    return r


def column(frame):
    return [r[-1] for r in frame.with_rid.orderBy("_rid").collect()]


@pytest.mark.parametrize("text, value", [
    ("1+2*3", 7), ("(1+2)*3", 9), ("8/4/2", 1), ("7%4%2", 1), ("1-2-3", -4), ("-2*3", -6), ("1/0", math.inf), ("-1/0", -math.inf), ("5e-1 + .5", 1),
    ("2 > 1", 1), ("1 == 2 || 3 == 3", 1), ("1 && 0", 0), ("1 ? 2 : nosuch", 2), ("0 ? nosuch : 3", 3), ("1 < 2 == 1", 1), ("a = 4", 4), ("4 -> a", 4), ("|12| + 1", 13), ("-7 % 3", -1),
])
def test_scalars(reg, text, value):
    assert evaluate(reg, text) == value


def test_zero_by_zero(reg):
    assert math.isnan(evaluate(reg, "0/0")) and math.isnan(evaluate(reg, "1%0"))


def test_tree():
    assert parse("a <- b$c + 1") == Assign(0, "a", Binary(0, "+", Select(0, Name(0, "b"), "c"), Number(0, 1.0)))


@pytest.mark.parametrize("text, at", [("1 +", 3), ("(1", 2), ("t[x]", 2), ("1 2", 2), ("f(a=1, 2)", 7), ("1 ~ 2", 2), ("", 0), ("t$", 2)])
def test_parse_errors(text, at):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert e.value.at == at


@pytest.mark.parametrize("text", [
    "nosuch + 1", "t$nosuch", "t[9]", "t + 1", "sum(1)", "sum()", "sum(t$sq, t$m)", "nosuch(1)", "slice(t, 10)", "slice(t, 2, 20)", "slice(t, 1.5)",
    "randomBitVector(0, 0, 1)", "randomBitVector(2, 3, 1)", "filter(t, v)", '"text" + 1', "sum(vec=t$sq, vec=t$m)", "sum(other=t$sq)",
])
def test_evaluation_errors(reg, text):
    with pytest.raises(ParseError):
        evaluate(reg, text)


def test_vectors(reg):
    sq = [float(k * k) for k in range(10)]
    assert column(evaluate(reg, "t$sq + 1")) == [x + 1 for x in sq]
    assert column(evaluate(reg, "2 - t[1]")) == [2 - x for x in sq]
    assert column(evaluate(reg, "t$m == 0 ? t$sq : -1")) == [x if k % 3 == 0 else -1.0 for k, x in enumerate(sq)]
    assert column(evaluate(reg, "t$sq + v")) == [x + 1 + k % 3 for k, x in enumerate(sq)]
    assert column(evaluate(reg, "t$gap > 2")) == [None if k == 4 else float(k > 2) for k in range(10)]
    assert column(evaluate(reg, "log(t$m)"))[0] == -math.inf


def test_nan_rules(reg):
    nan = "(t$m / t$m)"  # NaN where m is 0
    assert column(evaluate(reg, f"{nan} == {nan}"))[:3] == [0.0, 1.0, 1.0]
    assert column(evaluate(reg, f"{nan} != {nan}"))[:3] == [1.0, 0.0, 0.0]
    assert column(evaluate(reg, f"{nan} > 0"))[0] == 0.0 and column(evaluate(reg, f"{nan} ? 1 : 2"))[0] == 1.0
    assert evaluate(reg, f"sum({nan})") == 6.0 and evaluate(reg, f"mean({nan})") == 1.0


def test_aggregates_skip_missing(reg):
    assert [evaluate(reg, f"{f}(t$gap)") for f in ("min", "max", "sum")] == [0.0, 9.0, 41.0]
    assert evaluate(reg, "mean(t$gap)") == pytest.approx(41 / 9)
    assert math.isnan(evaluate(reg, "max(filter(t, t$m > 5)$sq)")) and evaluate(reg, "sum(filter(t, t$m > 5)$sq)") == 0


def test_filter_slice_swap(reg):
    assert column(evaluate(reg, "filter(t, t$sq > 30)$id")) == [6, 7, 8, 9]
    assert column(evaluate(reg, "filter(t$sq, t$m / 2)$id")) == [2, 5, 8]  # 0.5 drops a row, and a column stands for its frame
    assert column(evaluate(reg, "slice(t, 2, 3)$id")) == [2, 3, 4] and column(evaluate(reg, "slice(filter(t, t$m == 0), 2)$id")) == [6, 9]
    assert column(evaluate(reg, "colSwap(t, 1, t$sq * 2)$sq"))[3] == 18.0 and column(evaluate(reg, 'colSwap(t, "m", v)$m'))[:4] == [1, 2, 3, 1]
    assert evaluate(reg, 'colSwap(t, "m", v)').names == ["id", "sq", "m", "gap", "s"]


def test_factor_and_samples(reg):
    f = evaluate(reg, "factor(t$sq)")
    d = f.domains["sq"]
    assert list(d) == sorted(d) and "9.0" in d and d.index("16.0") < d.index("9.0")
    assert [d[int(c)] for c in column(f)] == [str(float(k * k)) for k in range(10)]
    assert evaluate(reg, "sum(randomBitVector(100, 17, 3))") == 17
    a, b = (column(evaluate(reg, "randomFilter(t, 4, 9)$id")) for _ in range(2))
    assert a == b == sorted(a) and len(set(a)) == 4


def test_registry(reg):
    evaluate(reg, "w = t$sq * 2")
    assert "w" in reg and reg.get_vector("w", 3) == {"sq": [0.0, 2.0, 8.0]} or reg.get_vector("w", 3) == {"0": [0.0, 2.0, 8.0]}
    assert [x["key"] for x in reg.view()] == ["t", "v", "w"]
    reg.remove("w")
    assert "w" not in reg
    assert reg.put_value("x", "hi").df.collect()[0][0] == "hi"
