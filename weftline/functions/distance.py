"""Two-part distances: compared by the first part, then by the second; arithmetic goes part by part."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair(inf: Column | float, num: Column | float = 0.0) -> Column:
    """A distance as a struct; structs compare by their fields in order."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.struct(as_column(inf).cast("double").alias("inf"), as_column(num).cast("double").alias("num"))


def _parts(x: Column | float, both: bool) -> tuple[Column, Column]:
    if isinstance(x, Column):
        return x["inf"], x["num"]
    return (F.lit(float(x)) if both else F.lit(0.0)), F.lit(float(x))


def apply(op, a: Column, b: Column | float) -> Column:
    """A sum or difference with a number concerns the second part alone; other operations concern both."""
    both = op not in (operator.add, operator.sub)
    (ai, an), (bi, bn) = _parts(a, both), _parts(b, both)
    return pair(op(ai, bi), op(an, bn))


def add(a: Column, b: Column | float) -> Column:
    return apply(operator.add, a, b)


def sub(a: Column, b: Column | float) -> Column:
    return apply(operator.sub, a, b)


def mul(a: Column, b: Column | float) -> Column:
    return apply(operator.mul, a, b)


def div(a: Column, b: Column | float) -> Column:
    return apply(operator.truediv, a, b)


def floordiv(a: Column, b: Column | float) -> Column:
    return apply(lambda x, y: F.floor(x / y), a, b)


def mod(a: Column, b: Column | float) -> Column:
    """The remainder with the divisor's sign."""
    return apply(lambda x, y: x - F.floor(x / y) * y, a, b)


def power(a: Column, b: Column | float) -> Column:
    return apply(F.pow, a, b)


def each(f, a: Column) -> Column:
    """A function of one number on both parts: ``F.negative``, ``F.abs``, ``F.floor``, ``F.ceil``."""
    return pair(f(a["inf"]), f(a["num"]))


def rounded(a: Column, digits: int = 0) -> Column:
    return pair(F.round(a["inf"], digits), F.round(a["num"], digits))
