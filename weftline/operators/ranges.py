"""Running values over ordered rows of a key, in which a key may have any number of rows.

A window by key puts all of a key's rows in one task. Here rows are dealt out by ranges of (key, order), so that a hot
key lies in many ranges; each range is summed up in one row for each of its keys, these rows are added up before
the windows run, and a window covers the rows of one key in one range alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.tables import materialize


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` written once, with ``__scan_range``: the number of a row's range of (keys, order), nulls first."""
    cut = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*keys, *order)])
    return materialize(cut.withColumn("__scan_range", F.spark_partition_id()))


#: Rows of a key up to which one window by key is as good: it then fits a task.
WINDOW_ROWS = 1 << 17


def longest(df: DataFrame, keys: list[str]) -> int:
    """The rows of the key that has the most."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def scan(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, previous: dict[str, Column] | None = None,
         following: dict[str, Column] | None = None, latest: dict[str, Column] | None = None, window_rows: int | None = None) -> DataFrame:
    """``df`` with running columns of each key's rows in ``order`` (ascending, nulls first; it should be total).

    ``sums``: sums from the key's first row to this one, a null adds nothing (0 at first). ``previous`` and ``following``: the
    value in the row before and after, NULL at the ends. ``latest``: the last value up to this row that isn't NULL. Null keys are a key.

    The rows are written and shuffled twice; what is joined to them has a row for each key and range. Rows that are
    equal in keys and order lie in one range. Where no key has more than ``window_rows`` rows (2**17), which are counted first,
    one window does the same in one shuffle; with 0 nothing is counted.
    """
    sums, previous, following, latest = ({k: v for k, v in (x or {}).items()} for x in (sums, previous, following, latest))
    most = WINDOW_ROWS if window_rows is None else window_rows
    if most and longest(df, keys) <= most:
        own = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
        upto = own.rowsBetween(Window.unboundedPreceding, 0)
        out = {x: F.sum(F.coalesce(c, F.lit(0))).over(upto) for x, c in sums.items()}
        out |= {x: F.lag(c).over(own) for x, c in previous.items()} | {x: F.lead(c).over(own) for x, c in following.items()}
        out |= {x: F.last(c, ignorenulls=True).over(upto) for x, c in latest.items()}
        return df.select(*[c for c in df.columns if c not in out], *[c.alias(x) for x, c in out.items()])
    named = {f"__scan_s{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())}
    named |= {f"__scan_p{i}": c for i, c in enumerate(previous.values())} | {f"__scan_f{i}": c for i, c in enumerate(following.values())} | {f"__scan_l{i}": c for i, c in enumerate(latest.values())}
    rows = ranged(df.select("*", *[c.alias(k) for k, c in named.items()]), keys, order)
    place = F.struct(*order)
    value = lambda k: F.struct(F.col(k).alias("v"))  # noqa: E731  (a null value is a value)
    ends = rows.groupBy(*keys, "__scan_range").agg(
        *[F.sum(k).alias(k) for k in named if k.startswith("__scan_s")], *[F.max_by(value(k), place).alias(k) for k in named if k.startswith("__scan_p")],
        *[F.min_by(value(k), place).alias(k) for k in named if k.startswith("__scan_f")],
        *[F.max_by(F.when(F.col(k).isNotNull(), value(k)), F.when(F.col(k).isNotNull(), place)).alias(k) for k in named if k.startswith("__scan_l")])
    by = Window.partitionBy(*keys).orderBy("__scan_range")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(k).over(before).alias(f"{k}c") if k[7] == "s" else F.lag(k).over(by).alias(f"{k}c") if k[7] == "p" else F.lead(k).over(by).alias(f"{k}c") if k[7] == "f"
               else F.last(k, ignorenulls=True).over(before).alias(f"{k}c") for k in named]
    ends = ends.select(*[F.col(c).alias(f"__scan_k{i}") for i, c in enumerate(keys)], F.col("__scan_range").alias("__scan_at"), *carried)
    same = F.col("__scan_range") == F.col("__scan_at")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__scan_k{i}"))
    joined = rows.join(ends, same)
    own = Window.partitionBy(*keys, "__scan_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for i, x in enumerate(sums):
        out[x] = F.sum(f"__scan_s{i}").over(upto) + F.coalesce(F.col(f"__scan_s{i}c"), F.lit(0))
    for i, x in enumerate(previous):
        out[x] = F.coalesce(F.lag(value(f"__scan_p{i}")).over(own), F.col(f"__scan_p{i}c"))["v"]
    for i, x in enumerate(following):
        out[x] = F.coalesce(F.lead(value(f"__scan_f{i}")).over(own), F.col(f"__scan_f{i}c"))["v"]
    for i, x in enumerate(latest):
        out[x] = F.coalesce(F.last(F.when(F.col(f"__scan_l{i}").isNotNull(), value(f"__scan_l{i}")), ignorenulls=True).over(upto), F.col(f"__scan_l{i}c"))["v"]
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, *[c.alias(x) for x, c in out.items()])
