"""Arguments in text: number sequences, cases of a response, weights and strata of classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.frame import Frame
from quillframe.functions import ieee

_TESTS = {"<": ieee.lt, ">": ieee.gt, "<=": ieee.le, ">=": ieee.ge, "=": ieee.eq, "!=": ieee.ne}


def sequence(text: str) -> list[float]:
    """a, a,b,c, or from:to:step without the end; a step *k multiplies."""
    text = text.strip()
    if ":" not in text:
        return [float(x) for x in text.split(",") if x.strip()]
    lo, hi, step = (text.split(":") + ["1"])[:3]
    times = step.strip().startswith("*")
    a, b, s = float(lo), float(hi), float(step.strip().lstrip("*"))
    if times:
        if s <= 1 or a <= 0:
            raise ValueError("a multiplying sequence needs a start above 0 and a step above 1")
        out = []
        while a < b:
            out.append(a)
            a *= s
        return out
    if s == 0:
        raise ValueError("the step is 0")
    return [a + k * s for k in range(max(0, int((b - a) / s + 1e-9)))]


@dataclass(frozen=True)
class Case:
    """A test that makes a response 0 or 1, such as ">=3" or "=R"."""

    op: str
    value: str

    @property
    def text(self) -> str:
        return self.op + self.value

    @staticmethod
    def parse(text: str) -> Case:
        op = next(o for o in ("<=", ">=", "!=", "<", ">", "=") if text.startswith(o))
        return Case(op, text[len(op) :].strip())

    def apply(self, c: Column, f: Frame, name: str) -> Column:
        if f.domains.get(name) and self.value in f.domains[name]:
            return _TESTS[self.op](c, F.lit(float(f.domains[name].index(self.value))))
        if dict(f.df.dtypes)[name] == "string":
            return {"=": c == self.value, "!=": c != self.value}[self.op].cast("double")
        return _TESTS[self.op](c, F.lit(float(self.value)))


def default_case(f: Frame, response: str) -> Case | None:
    """For a binomial response outside 0 to 1: above its mean if it is a number, else its last value."""
    from quillframe.operators.summary import summary

    r = summary(f.select([response])).first()
    if r["type"] == "enum":
        d = f.domains.get(response)
        return Case("=", d[-1] if d else f.rows.df.agg(F.max(f.columns[response])).first()[0])
    if r["min"] < 0 or r["max"] > 1:
        return Case(">", repr(r["mean"]))
    return None


def class_numbers(text: str) -> dict[str, float]:
    """class=value,... as weights or strata."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, eq, value = part.rpartition("=")
        if not eq or not name:
            raise ValueError(f"class=value was expected: {part}")
        out[name.strip()] = float(value)
    return out


def columns(f: Frame, text: str) -> list[str]:
    """Names of columns given by name or 0-based place, with commas."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        name = part if part in f.columns else f.names[int(part)] if part.isdigit() and int(part) < len(f.names) else None
        if name is None:
            raise KeyError(f"no column {part}")
        if name not in out:
            out.append(name)
    return out
