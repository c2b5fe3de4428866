"""Double arithmetic as IEEE-754 has it, where ANSI SQL raises or gives NULL. NULL stays NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def dbl(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(float(c))).cast("double")


def div(a: Column, b: Column) -> Column:
    """x/0 is an infinity of x's sign, 0/0 is NaN."""
    a, b = dbl(a), dbl(b)
    return F.when(b == 0, a * F.lit(INF)).otherwise(a / F.when(b != 0, b))


def mod(a: Column, b: Column) -> Column:
    """The remainder with the dividend's sign; x % 0 is NaN."""
    a, b = dbl(a), dbl(b)
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, F.lit(NAN)).otherwise(a % F.when(b != 0, b))


def log(a: Column) -> Column:
    a = dbl(a)
    return F.when(F.isnan(a) | (a < 0), F.lit(NAN)).when(a == 0, F.lit(-INF)).otherwise(F.ln(a))


def rounded(a: Column, digits: int) -> Column:
    """To so many digits as SQL rounds doubles: scaled, rounded to a whole number with halves away from 0, scaled back.

    Spark's own round() goes through the shortest decimal form, which can be
    half where the scaled number is just below.
    """
    a, scale = dbl(a), F.lit(10.0**digits)
    t = a * scale
    whole = F.rint(t)
    # rint takes halves to the even side
    whole = F.when((t - whole == 0.5) & (t > 0), whole + 1).when((t - whole == -0.5) & (t < 0), whole - 1).otherwise(whole)
    out = whole / scale
    return F.when(F.isnan(out) | (F.abs(out) == INF), a).otherwise(out)


def xlogx(a: Column) -> Column:
    """x ln x, 0 for x below 1e-6."""
    a = dbl(a)
    return F.when(a < 1e-6, 0.0).otherwise(a * F.ln(a))


def _ordered(a: Column, b: Column, test: Column) -> Column:
    # Spark orders NaN above all and holds it equal to itself
    return (test & ~F.isnan(a) & ~F.isnan(b)).cast("double")


def eq(a, b) -> Column:
    a, b = dbl(a), dbl(b)
    return _ordered(a, b, a == b)


def ne(a, b) -> Column:
    return 1.0 - eq(a, b)


def lt(a, b) -> Column:
    a, b = dbl(a), dbl(b)
    return _ordered(a, b, a < b)


def le(a, b) -> Column:
    a, b = dbl(a), dbl(b)
    return _ordered(a, b, a <= b)


def gt(a, b) -> Column:
    return lt(b, a)


def ge(a, b) -> Column:
    return le(b, a)


def true(a) -> Column:
    """Whether a value counts as true: anything but 0, NaN included."""
    return dbl(a) != 0


def both(a, b) -> Column:
    return (true(a) & true(b)).cast("double")


def either(a, b) -> Column:
    return (true(a) | true(b)).cast("double")


def choose(test, yes, no) -> Column:
    return F.when(dbl(test).isNull(), None).when(true(test), dbl(yes)).otherwise(dbl(no))


def valid(c: Column) -> Column:
    """c where it is a number, else NULL, so that aggregates skip NaN as they skip NULL."""
    c = dbl(c)
    return F.when(~F.isnan(c), c)


BINARY = {
    "+": lambda a, b: dbl(a) + dbl(b), "-": lambda a, b: dbl(a) - dbl(b), "*": lambda a, b: dbl(a) * dbl(b),
    "/": div, "%": mod, "==": eq, "!=": ne, "<": lt, "<=": le, ">": gt, ">=": ge, "&&": both, "||": either,
}


def scalar(op: str, a: float, b: float) -> float:
    """A binary operator on two numbers."""
    import math

    if op == "/":
        if b == 0:
            return NAN if a == 0 or math.isnan(a) else math.copysign(INF, a)
        return a / b
    if op == "%":
        return NAN if b == 0 or math.isinf(a) or math.isnan(a) or math.isnan(b) else math.fmod(a, b)
    return float({
        "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b,
        "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "&&": lambda: a != 0 and b != 0, "||": lambda: a != 0 or b != 0,
    }[op]())
