"""Derivatives and integrals of series, one series for each key; see ``ranges.scan`` for series of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import scan


def gradient(df: DataFrame, y: str, x: str, keys: list[str], order: list[str], out: str = "gradient") -> DataFrame:
    """The derivative of ``y`` by ``x``: second order inside for uneven steps, one-sided at both ends, NULL for a lone point."""
    point = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rows = scan(df, keys, order, previous={"__a": point}, following={"__b": point})
    rows = rows.withColumns({"__hs": F.col(x) - F.col("__a.x"), "__hd": F.col("__b.x") - F.col(x), "__y0": F.col("__a.y"), "__y2": F.col("__b.y")})
    hs, hd, y1 = F.col("__hs"), F.col("__hd"), F.col(y)
    inside = F.try_divide(hs * hs * F.col("__y2") + (hd * hd - hs * hs) * y1 - hd * hd * F.col("__y0"), hs * hd * (hs + hd))
    ends = F.when(hs.isNull(), F.try_divide(F.col("__y2") - y1, hd)).when(hd.isNull(), F.try_divide(y1 - F.col("__y0"), hs))
    return rows.withColumn(out, F.coalesce(ends, inside)).drop("__hs", "__hd", "__y0", "__y2", "__a", "__b")


def cumulative_integral(df: DataFrame, y: str, x: str, keys: list[str], order: list[str], out: str = "integral") -> DataFrame:
    """The integral of ``y`` over ``x`` from the series' first point, by trapezia; 0 there."""
    rows = scan(df, keys, order, previous={"__a": F.struct(F.col(x).alias("x"), F.col(y).alias("y"))})
    part = (F.col(y) + F.col("__a.y")) / 2 * (F.col(x) - F.col("__a.x"))
    return scan(rows, keys, order, {out: part}).drop("__a")


def convert(value: Column, steps: list[float]) -> Column:
    """A quantity along a path of unit conversions."""
    for factor in steps:
        value = value * F.lit(factor)
    return value
