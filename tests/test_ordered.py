"""Scans, folds and as-of joins over keys with any number of rows, against plain windows and loops."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import algebra, fold, ledger, ranges, series
from weftline.operators.asof import asof_join
from weftline.plans.graph import FormulaGraph


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def many_ranges(spark):
    names = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("window_rows", [0, 1 << 17])
def test_scan_against_windows(spark, many_ranges, window_rows):
    """A hot key, a null key, null values; columns that are called like results are replaced."""
    df = spark.range(3000).select(F.when(F.col("id") % 13 > 3, "hot").when(F.col("id") % 2 == 0, "b").alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"), F.lit("x").alias("s"))
    got = ranges.scan(df, ["k"], ["o"], {"s": F.col("v")}, {"p": F.col("v")}, {"f": F.col("v")}, {"l": F.col("v")}, window_rows=window_rows)
    w = Window.partitionBy("k").orderBy("o")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.drop("s").withColumns({"s": F.coalesce(F.sum("v").over(upto), F.lit(0)), "p": F.lag("v").over(w), "f": F.lead("v").over(w), "l": F.last("v", True).over(upto)})
    assert got.columns == want.columns and rows(got) == rows(want)
    assert ranges.scan(df.limit(0), ["k"], ["o"], {"s": F.col("v")}, window_rows=window_rows).collect() == []


def test_a_hot_key_lies_in_all_ranges(spark, many_ranges):
    dealt = ranges.ranged(spark.range(9000).withColumn("k", F.lit(1)), ["k"], ["id"]).groupBy("__scan_range").count().collect()
    assert len(dealt) == 9 and max(r["count"] for r in dealt) < 2500


def test_users_of_scans_on_one_hot_key(spark, many_ranges, monkeypatch):
    """Derivatives, integrals, discounts and unique names give the same by ranges as by a window."""
    df = spark.range(500).select(F.lit("k").alias("k"), F.col("id"), (F.col("id") * 1.5 + F.col("id") % 3).alias("t"), (F.col("id") % 17).cast("double").alias("v"))
    rules = spark.createDataFrame([("k", 10.0, None), ("k", None, 900)], "product string, percent double, flat int")
    lines = df.select(F.col("k").alias("product"), F.col("id").alias("line"), F.col("v").alias("amount"))

    def all_of_them():
        return [rows(series.gradient(df, "v", "t", ["k"], ["id"]).withColumn("gradient", F.round("gradient", 9))), rows(series.cumulative_integral(df, "v", "t", ["k"], ["id"]).withColumn("integral", F.round("integral", 6))),
                rows(ledger.discounted(lines, rules)), rows(algebra.numbered(df.select("id", F.col("k").alias("name"))))]

    plain = all_of_them()
    monkeypatch.setattr(ranges, "WINDOW_ROWS", 0)
    assert all_of_them() == plain


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("window_rows", [0, 1 << 17])
def test_asof_against_a_loop(spark, many_ranges, strict, window_rows):
    rng = random.Random(3)
    key = lambda: rng.choice(["hot"] * 5 + ["b", None])
    left = [(i, key(), rng.choice([None, *range(60)])) for i in range(400)]
    right = [(i, key(), rng.choice([None, *range(60)]), rng.choice([None, i])) for i in range(150)]
    want = []
    for i, k, t in left:
        some = [r for r in right if r[1] == k and r[2] is not None and t is not None and (r[2] < t or (r[2] == t and not strict))]
        best = max(some, key=lambda r: (r[2], r[0]), default=None)
        want.append((i, k, t, best and best[3], best and best[0]))
    a = spark.createDataFrame(left, "i int, k string, t int")
    b = spark.createDataFrame(right, "n int, k string, t int, v int")
    got = asof_join(a, b, ["k"], "t", {"v": "v", "n": "n"}, strict=strict, tie="n", window_rows=window_rows)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert asof_join(a, b.limit(0), ["k"], "t", {"v": "v"}).where("v is not null").count() == 0 and asof_join(a.limit(0), b, ["k"], "t", {"v": "v"}).count() == 0


def test_a_million_rows_of_one_key(spark):
    """The number of rounds doesn't grow with a key, and the time only in proportion."""
    g = FormulaGraph()
    g.formula(lambda a, b: (a + b) % 1000003, ["a", "b"], "c", name="add", domain=lambda a, b: a % 10 != 3)
    g.formula(lambda a: a, ["a"], "c", name="anew", weight=5)
    n = 1_000_000
    df = spark.range(n).select(F.lit("hot").alias("k"), "id", F.col("id").alias("a"), F.when(F.col("id") == 0, F.lit(0).cast("long")).alias("b"))
    began = time.perf_counter()
    total = fold.fold_model(df, g, {"c": "b"}, ["k"], ["id"], {"c": "long"}).agg(F.count("*"), F.sum("c"), F.max_by("c", "id")).first()
    want = last = 0
    for i in range(n):
        last = i if i % 10 == 3 else (i + last) % 1000003
        want += last
    assert tuple(total) == (n, want, last)
    assert time.perf_counter() - began < 300
