"""PMML scorecards and voting tree ensembles as column expressions."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {
    "lessThan": lambda a, b: a < b, "lessOrEqual": lambda a, b: a <= b, "greaterThan": lambda a, b: a > b, "greaterOrEqual": lambda a, b: a >= b,
    "equal": lambda a, b: a == b, "notEqual": lambda a, b: a != b,
}
_KINDS = {"double": "double", "float": "double", "integer": "double", "int": "double", "boolean": "boolean", "string": "string"}


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _children(e: ET.Element, *tags: str) -> list[ET.Element]:
    return [c for c in e if _tag(c) in tags]


def _find(e: ET.Element, tag: str) -> ET.Element | None:
    return next((c for c in e.iter() if _tag(c) == tag), None)


@dataclass(frozen=True)
class Inputs:
    """Fields of a model as columns; one that the data doesn't have is missing in every row."""

    kinds: Mapping[str, str]
    columns: Mapping[str, Column]
    types: Mapping[str, str] = field(default_factory=dict)  # of the columns, where they are known

    def typed(self, name: str) -> tuple[Column, str]:
        kind = self.kinds.get(name, "string")
        c = self.columns.get(name)
        if c is None:
            return F.lit(None).cast("string" if kind == "string" else "double"), kind
        if kind == "string":
            return c.cast("string"), kind
        known = self.types.get(name, "string")
        if known in _WHOLE or known.startswith("decimal"):
            return c.cast("double"), kind
        if known in ("double", "float"):
            return F.when(~F.isnan(c), c.cast("double")), kind
        # text that isn't a number is missing; true and false are 1 and 0
        s = c.cast("string")
        number = F.when(F.lower(s) == "true", 1.0).when(F.lower(s) == "false", 0.0).otherwise(s.try_cast("double"))
        return F.when(~F.isnan(number), number), kind


def _value(text: str, kind: str) -> Column:
    if kind == "string":
        return F.lit(text)
    return F.lit({"true": 1.0, "false": 0.0}[text.lower()] if text.lower() in ("true", "false") else float(text))


_WHOLE = ("tinyint", "smallint", "int", "bigint")
PREDICATES = ("SimplePredicate", "CompoundPredicate", "SimpleSetPredicate", "True", "False")


def predicate(e: ET.Element, inputs: Inputs) -> Column:
    """A predicate's truth; a comparison with a missing value doesn't hold."""
    kind = _tag(e)
    if kind in ("True", "False"):
        return F.lit(kind == "True")
    if kind == "SimplePredicate":
        c, t = inputs.typed(e.get("field"))
        op = e.get("operator")
        if op in ("isMissing", "isNotMissing"):
            return c.isNull() if op == "isMissing" else c.isNotNull()
        if op not in _COMPARE:
            raise ValueError(f"unknown operator {op}")
        return F.coalesce(_COMPARE[op](c, _value(e.get("value"), t)), F.lit(False))
    if kind == "SimpleSetPredicate":
        c, t = inputs.typed(e.get("field"))
        values = _array(_find(e, "Array"))
        inside = F.coalesce(c.isin([v if t == "string" else float(v) for v in values]), F.lit(False))
        return inside if e.get("booleanOperator") == "isIn" else c.isNotNull() & ~inside
    if kind == "CompoundPredicate":
        parts = [predicate(x, inputs) for x in _children(e, *PREDICATES)]
        out = parts[0]
        for p in parts[1:]:
            op = e.get("booleanOperator")
            out = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b}[op](out, p)
        return out
    raise ValueError(f"unknown predicate {kind}")


def _array(e: ET.Element) -> list[str]:
    import shlex

    return shlex.split(e.text or "")


class Pmml:
    """A parsed document: a scorecard or an ensemble of trees that vote."""

    def __init__(self, text: str | bytes):
        root = ET.fromstring(text)
        fields = [e for e in root.iter() if _tag(e) == "DataField"]
        names = [e.get("name") for e in fields]
        if len(set(names)) != len(names):
            raise ValueError("a field is named twice")
        self.kinds = {e.get("name"): _KINDS.get(e.get("dataType"), "string") for e in fields}
        self.card, self.mining = _find(root, "Scorecard"), _find(root, "MiningModel")
        tree = _find(root, "TreeModel")
        self.trees = [t for t in root.iter() if _tag(t) == "TreeModel"] if self.mining is not None or tree is not None else []
        if self.card is None and not self.trees:
            raise ValueError("neither a scorecard nor trees")
        mined = [e for e in root.iter() if _tag(e) == "MiningField" and e.get("usageType") in ("predicted", "target")]
        self.target = mined[0].get("name") if mined else None
        self.features = [n for n in names if n != self.target]

    def inputs(self, df: DataFrame, fields: Mapping[str, str] | None = None) -> Inputs:
        """Model fields over a DataFrame's columns, renamed by fields (model's name to column)."""
        fields = fields or {}
        types = dict(df.dtypes)
        found = {n: fields.get(n, n) for n in self.kinds if fields.get(n, n) in types}
        return Inputs(self.kinds, {n: F.col(f"`{c}`") for n, c in found.items()}, {n: types[c] for n, c in found.items()})

    def expression(self, inputs: Inputs) -> Column:
        return self._scorecard(inputs) if self.card is not None else self._vote(inputs)

    def score(self, df: DataFrame, name: str = "score", fields: Mapping[str, str] | None = None) -> DataFrame:
        """df with the model's score, or the class that most trees say."""
        return df.withColumn(name, self.expression(self.inputs(df, fields)))

    def _scorecard(self, inputs: Inputs) -> Column:
        total = F.lit(float(self.card.get("initialScore", 0)))
        for c in (x for x in self.card.iter() if _tag(x) == "Characteristic"):
            part = F.lit(0.0)
            for a in reversed(_children(c, "Attribute")):
                test = _children(a, *PREDICATES)
                hit = predicate(test[0], inputs) if test else F.lit(True)
                part = F.when(hit, float(a.get("partialScore", 0))).otherwise(part)
            total = total + part
        return total

    def votes(self, inputs: Inputs) -> Column:
        """What each tree says, as an array; NULL where a row fits no branch."""
        return F.array(*(self._node(_children(t, "Node")[0], inputs) for t in self.trees))

    def _node(self, e: ET.Element, inputs: Inputs) -> Column:
        out = F.lit(e.get("score")).cast("string")
        for child in reversed(_children(e, "Node")):
            out = F.when(predicate(_children(child, *PREDICATES)[0], inputs), self._node(child, inputs)).otherwise(out)
        return out

    def _vote(self, inputs: Inputs) -> Column:
        names = F.array(*(F.lit(n) for n in sorted({e.get("score") for t in self.trees for e in t.iter() if _tag(e) == "Node"} - {None})))

        def best(votes: Column) -> Column:
            """The class with most votes, the first of equals, NULL without votes."""
            counted = F.transform(names, lambda n, k: F.struct(F.size(F.filter(votes, lambda v: v.eqNullSafe(n))).alias("n"), (-k).alias("k"), n.alias("name")))
            top = F.array_max(counted)
            return F.when(top["n"] > 0, top["name"])

        # bound as a lambda's argument, the trees are evaluated once a row
        return F.get(F.transform(F.array(self.votes(inputs)), best), F.lit(0))


def load(path: str) -> Pmml:
    with open(path, "rb") as f:
        return Pmml(f.read())
