"""Evaluates expressions over a registry: a number, or a frame whose plan is still lazy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from quillframe.frame import Frame, Vec, align
from quillframe.functions import ieee
from quillframe.lang.parser import Assign, Binary, Call, Choice, Name, Negate, Node, Number, ParseError, Select, Text, parse
from quillframe.operators import aggregate, factor, rows
from quillframe.registry import Registry

Value = float | str | Vec | Frame


@dataclass(frozen=True)
class Arg:
    name: str
    kind: str  # vec, frame, scalar, int, positive, text, column
    default: float | str | None = None
    optional: bool = False


#: Arguments of each function, in order.
FUNCTIONS: dict[str, list[Arg]] = {
    "min": [Arg("vec", "vec")],
    "max": [Arg("vec", "vec")],
    "sum": [Arg("vec", "vec")],
    "mean": [Arg("vec", "vec")],
    "log": [Arg("vec", "vec")],
    "factor": [Arg("vec", "vec")],
    "filter": [Arg("src", "frame"), Arg("bitVect", "vec")],
    "slice": [Arg("src", "frame"), Arg("start", "int"), Arg("count", "int", -1.0, True)],
    "randomBitVector": [Arg("size", "positive"), Arg("selected", "int"), Arg("seed", "int", 0.0, True)],
    "randomFilter": [Arg("src", "frame"), Arg("rows", "int"), Arg("seed", "int", 0.0, True)],
    "colSwap": [Arg("source", "frame"), Arg("col", "column"), Arg("newCol", "vec")],
}


class Evaluator:
    def __init__(self, registry: Registry):
        self.registry = registry

    def run(self, text: str) -> Value:
        """The value of an expression; a column comes back as a frame of one column."""
        self.text = text
        v = self.value(parse(text))
        return v.as_frame() if isinstance(v, Vec) else v

    def fail(self, node: Node, message: str) -> ParseError:
        return ParseError(message, self.text, node.at)

    def value(self, n: Node) -> Value:
        if isinstance(n, Number):
            return n.value
        if isinstance(n, Text):
            return n.value
        if isinstance(n, Name):
            return self.name(n)
        if isinstance(n, Assign):
            return self.assign(n)
        if isinstance(n, Select):
            return self.select(n)
        if isinstance(n, Negate):
            v = self.operand(n.value)
            return -v if isinstance(v, float) else Vec(v.rows, -ieee.dbl(v.expr))
        if isinstance(n, Binary):
            return self.binary(n)
        if isinstance(n, Choice):
            return self.choice(n)
        if isinstance(n, Call):
            return self.call(n)
        raise TypeError(n)

    def name(self, n: Name) -> Value:
        if n.value in self.registry:
            return self.registry.get(n.value)
        try:
            return float(n.value)  # |12| is a number unless a key has that name
        except ValueError:
            raise self.fail(n, f"no such key: {n.value}") from None

    def assign(self, n: Assign) -> Value:
        v = self.value(n.value)
        if isinstance(v, str):
            raise self.fail(n, "a text can't be assigned")
        return self.registry.put(n.name, v.as_frame() if isinstance(v, Vec) else v)

    def select(self, n: Select) -> Vec:
        source = self.value(n.source)
        if isinstance(source, Vec):
            source = source.as_frame()
        if not isinstance(source, Frame):
            raise self.fail(n, "only a frame has columns")
        try:
            return source.vec(n.which)
        except (KeyError, IndexError) as e:
            raise self.fail(n, str(e.args[0])) from None

    def operand(self, n: Node) -> float | Vec:
        v = self.value(n)
        if isinstance(v, str):
            raise self.fail(n, "a text can't be calculated with")
        return self.one(v, n) if isinstance(v, Frame) else v

    def one(self, f: Frame, n: Node) -> Vec:
        try:
            return f.only()
        except ValueError as e:
            raise self.fail(n, str(e)) from None

    def binary(self, n: Binary) -> float | Vec:
        a, b = self.operand(n.left), self.operand(n.right)
        if isinstance(a, float) and isinstance(b, float):
            return ieee.scalar(n.op, a, b)
        vecs = [v for v in (a, b) if isinstance(v, Vec)]
        on, exprs = align(vecs)
        it = iter(exprs)
        x, y = (next(it) if isinstance(v, Vec) else F.lit(v) for v in (a, b))
        return Vec(on, ieee.BINARY[n.op](x, y))

    def choice(self, n: Choice) -> Value:
        test = self.operand(n.test)
        if isinstance(test, float):
            return self.value(n.yes if test != 0 else n.no)  # the other branch isn't evaluated
        parts = [test, self.operand(n.yes), self.operand(n.no)]
        on, exprs = align([v for v in parts if isinstance(v, Vec)])
        it = iter(exprs)
        return Vec(on, ieee.choose(*(next(it) if isinstance(v, Vec) else F.lit(v) for v in parts)))

    def call(self, n: Call) -> Value:
        if n.name not in FUNCTIONS:
            raise self.fail(n, f"no such function: {n.name}")
        wanted = FUNCTIONS[n.name]
        if len(n.args) > len(wanted):
            raise self.fail(n, f"{n.name} takes at most {len(wanted)} arguments")
        given = dict(zip((a.name for a in wanted), n.args, strict=False))
        for k, v in n.named:
            if k not in {a.name for a in wanted}:
                raise self.fail(v, f"{n.name} has no argument {k}")
            if k in given:
                raise self.fail(v, f"argument {k} is given twice")
            given[k] = v
        missing = [a.name for a in wanted if a.name not in given and not a.optional]
        if missing:
            raise self.fail(n, f"{n.name} needs {', '.join(missing)}")
        values = {a.name: self.argument(a, given[a.name]) if a.name in given else a.default for a in wanted}
        try:
            return self.apply(n.name, values)
        except (ValueError, KeyError, IndexError) as e:
            if isinstance(e, ParseError):
                raise
            raise self.fail(n, str(e.args[0])) from None

    def argument(self, a: Arg, n: Node) -> Value:
        v = self.value(n)
        if a.kind == "frame":
            # a column stands for the whole frame that it was selected from
            if isinstance(v, Vec):
                return v.frame or v.as_frame()
            if not isinstance(v, Frame):
                raise self.fail(n, f"{a.name} must be a frame")
            return v
        if a.kind == "vec":
            if isinstance(v, Frame):
                return self.one(v, n)
            if not isinstance(v, Vec):
                raise self.fail(n, f"{a.name} must be a column")
            return v
        if a.kind == "column":
            if isinstance(v, str) or isinstance(v, float) and v.is_integer():
                return v if isinstance(v, str) else int(v)
            raise self.fail(n, f"{a.name} must be a column's name or place")
        if not isinstance(v, float):
            raise self.fail(n, f"{a.name} must be a number")
        if a.kind in ("int", "positive") and not v.is_integer():
            raise self.fail(n, f"{a.name} must be a whole number")
        if a.kind == "positive" and v <= 0:
            raise self.fail(n, f"{a.name} must be above 0")
        return v

    def apply(self, name: str, v: dict[str, Value]) -> Value:
        if name in ("min", "max", "sum", "mean"):
            return aggregate.column_aggregate(v["vec"], name)
        if name == "log":
            return Vec(v["vec"].rows, ieee.log(v["vec"].expr))
        if name == "factor":
            return factor.factor(v["vec"])
        if name == "filter":
            return rows.filter_rows(v["src"], v["bitVect"])
        if name == "slice":
            return rows.slice_rows(v["src"], int(v["start"]), int(v["count"]))
        if name == "randomBitVector":
            return rows.random_bits(self.registry.spark, int(v["size"]), int(v["selected"]), int(v["seed"]))
        if name == "randomFilter":
            return rows.random_rows(v["src"], int(v["rows"]), int(v["seed"]))
        source, which = v["source"], v["col"]
        return source.with_column(source.vec(which).name, v["newCol"])


def evaluate(registry: Registry, text: str) -> Value:
    return Evaluator(registry).run(text)
