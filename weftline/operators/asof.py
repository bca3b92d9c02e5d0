"""As-of joins: each left row with the last right row of its key up to its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import scan


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, fields: dict[str, str], strict: bool = False, within: str | None = None,
              tie: str | None = None, window_rows: int | None = None) -> DataFrame:
    """``left`` with ``fields`` (right column -> name) of the key's last right row at or before ``time``; NULL where there is none.

    ``strict``: before it. ``within``: an interval (SQL text, as ``interval 1 hour``) that the right row may be older at most. Of right rows at one
    time the one with the largest ``tie`` column holds. Null keys match null keys; a row without a time matches nothing.

    Both sides are merged and put in order by key and time, in ranges for keys with many rows; the last right row is
    carried along, from range to range (see ``ranges.scan``). Nothing is joined by key, so hot keys and many matches cost no more than
    their rows.
    """
    kept = left.select(F.struct(*[left[c] for c in left.columns]).alias("__left"), *[left[c].alias(f"__k{i}") for i, c in enumerate(keys)], left[time].alias("__t"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    value = F.struct(right[time].alias("t"), *[right[c].alias(f"f{i}") for i, c in enumerate(fields)])
    events = right.where(right[time].isNotNull()).select(
        F.lit(None).cast(kept.schema["__left"].dataType).alias("__left"), *[right[c].cast(left.schema[c].dataType).alias(f"__k{i}") for i, c in enumerate(keys)],
        right[time].cast(left.schema[time].dataType).alias("__t"), value.alias("__right"), F.lit(1 if strict else 0).alias("__side"), (right[tie] if tie else F.lit(0)).alias("__tie"))
    asks = kept.withColumns({"__right": F.lit(None).cast(events.schema["__right"].dataType), "__side": F.lit(0 if strict else 1), "__tie": none(right, tie) if tie else F.lit(0)})
    by = [f"__k{i}" for i in range(len(keys))]
    merged = scan(asks.unionByName(events), by, ["__t", "__side", "__tie"], latest={"__last": F.col("__right")}, window_rows=window_rows).where("__left is not null")
    found = F.col("__t").isNotNull() & F.col("__last").isNotNull()
    if within is not None:
        found = found & (F.col("__last.t") >= F.col("__t") - F.expr(within))
    return merged.select("__left.*", *[F.when(found, F.col(f"__last.f{i}")).alias(name) for i, name in enumerate(fields.values())])
