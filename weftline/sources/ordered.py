"""Documents laid out by category and order, with an index of zones, so that a page reads few row groups.

The writer deals rows out by ranges of (category, order) and sorts them, so each row group covers a short stretch. Beside
the rows lies a table of zones: first row, last row and number of rows of each few thousand neighbours of a category. A page is found
in the zones; its bounds then are filters on plain columns, which the Parquet reader checks against its row groups' statistics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.ranges import scan

#: Rows of a zone.
ZONE_ROWS = 1 << 12


def write_ordered(docs: DataFrame, path: str, order: tuple[str, ...] = ("updated_at", "_id"), by: str = "category", group_bytes: int = 1 << 20, zone_rows: int = ZONE_ROWS) -> None:
    """Write ``docs`` sorted by ``by`` and ``order`` (ascending, nulls first) with row groups of ``group_bytes``, and their zones in ``_zones``.

    One shuffle by ranges, sized by adaptive execution, so a hot category lies in many files; a second job reads back the
    sorting columns alone. ``order`` should be total; of rows equal in all of it any may come first. An empty table has no zones.
    """
    keys = [F.col(c).asc_nulls_first() for c in (by, *order)]
    rows = docs.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows.write.option("parquet.block.size", group_bytes).option("parquet.page.size", max(1 << 12, group_bytes >> 4)).parquet(path)
    written = docs.sparkSession.read.schema(docs.schema).parquet(path)
    place = F.struct(*order)
    zone = F.expr(f"_metadata.row_index div {zone_rows}")
    zones = written.select(by, place.alias("__place"), F.col("_metadata.file_name").alias("__file"), zone.alias("__zone"))
    zones = zones.withColumn("__top", F.max("__place").over(Window.partitionBy(by, "__file", "__zone")))  # a zone's rows at most
    zones.groupBy(by, "__file", "__zone").agg(F.min("__place").alias("__first"), F.max("__place").alias("__last"), F.count("*").alias("__n"),
                                              F.count_if(F.col("__place") == F.col("__top")).alias("__at_last")).write.parquet(f"{path}/_zones")


def _bounded(names: tuple[str, ...], bound: tuple, upper: bool) -> Column:
    """Whether a row's place is not before (``upper``: not behind) a bound, nulls first; its first column's part reaches the scan."""
    name, value = names[0], bound[0]
    c = F.col(name)
    if len(names) > 1:
        rest = _bounded(names[1:], bound[1:], upper)
    else:
        rest = F.lit(True)
    if value is None:
        return c.isNull() & rest if upper else c.isNotNull() | rest
    beyond = c.isNull() | (c < value) if upper else c > value
    near = c.isNull() | (c <= value) if upper else c >= value
    return near & (beyond | ((c == value) & rest))


def _of(by: str, category: str | None) -> Column:
    return F.col(by).isNull() if category is None else F.col(by) == category


def _place(zones: DataFrame, order: tuple[str, ...], values: tuple) -> Column:
    return F.struct(*[F.lit(v).alias(c) for c, v in zip(order, values)]).cast(zones.schema["__first"].dataType)


def ordered_page(spark: SparkSession, path: str, category: str | None, limit: int, offset: int = 0, descending: bool = False,
                 order: tuple[str, ...] = ("updated_at", "_id"), by: str = "category") -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a category in ``order``, from a folder that ``write_ordered`` made.

    The zones up to each zone are counted in ranges; the driver gets three values, the page's bounds and the rows to
    skip behind the first. Pages behind the last row are empty; ``None`` is the category of rows without one. Descending is
    the exact reverse, nulls last.
    """
    zones = spark.read.parquet(f"{path}/_zones").where(_of(by, category))
    if descending:
        total = zones.agg(F.sum("__n")).first()[0] or 0
        low, high = max(0, total - offset - limit), total - offset
    else:
        low, high = offset, offset + limit
    order_of_zones = ["__first", "__last", "__file", "__zone"]
    placed = scan(zones.withColumn("__all", F.lit(0)), ["__all"], order_of_zones, {"__upto": F.col("__n")})
    before = F.col("__upto") - F.col("__n")
    found = placed.where((F.col("__upto") > low) & (before < high)).agg(F.min("__first").alias("first"), F.max("__last").alias("last"), F.min(before).alias("before")).first()
    rows = spark.read.parquet(path).where(_of(by, category))
    if found["first"] is None:
        return rows.where("false")
    rows = rows.where(_bounded(order, tuple(found["first"]), False) & _bounded(order, tuple(found["last"]), True))
    # Rows at the page's first place may lie at the end of zones before it, too.
    also = placed.where((F.col("__upto") <= low) & (F.col("__last") == _place(zones, order, tuple(found["first"])))).agg(F.sum("__at_last")).first()[0] or 0
    skip = low - found.before + also
    forward = rows.orderBy(*[F.col(c).asc_nulls_first() for c in order]).offset(skip).limit(high - low)
    return forward.orderBy(*[F.col(c).desc_nulls_last() for c in order]) if descending else forward


def ordered_after(spark: SparkSession, path: str, category: str | None, last: tuple, limit: int, descending: bool = False,
                  order: tuple[str, ...] = ("updated_at", "_id"), by: str = "category") -> DataFrame:
    """The ``limit`` rows behind the place ``last`` of the row that a client saw last: a cursor over the whole order, not over ids alone.

    Rows equal to it in all of ``order`` are passed over. The bound comes from the zones next to the place that hold
    enough rows together; the driver gets ``limit + 1`` zones at most.
    """
    zones = spark.read.parquet(f"{path}/_zones").where(_of(by, category))
    place = _place(zones, order, last)
    near = zones.where(F.col("__first") < place).orderBy(F.col("__last").desc()) if descending else zones.where(F.col("__last") > place).orderBy("__first")
    whole = F.col("__last") < place if descending else F.col("__first") > place  # of a zone that the place parts no row is sure to be behind it
    have, bound = 0, None
    for z in near.select("__first", "__last", F.when(whole, F.col("__n")).otherwise(0).alias("sure")).limit(limit + 1).collect():
        have += z.sure
        end = tuple(z["__first"] if descending else z["__last"])
        bound = end if have >= limit else None
        if bound:
            break
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(order, last)])
    rows = spark.read.parquet(path).where(_of(by, category)).where(_bounded(order, last, descending) & ~same)
    rows = rows if bound is None else rows.where(_bounded(order, bound, not descending))
    return rows.orderBy(*[F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in order]).limit(limit)
