"""Formula graphs on streams: the row-wise plan as it is, and the ordered fold with state for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.graph import FormulaGraph


def compute_stream(stream: DataFrame, graph: FormulaGraph, outputs: tuple[str, ...] | None = None, **how) -> DataFrame:
    """The graph on each row of a stream: the plan has no state, so a stream runs it as a table does."""
    return graph.compute(stream, outputs, **how)


def fold_stream(stream: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], tuple], step: Callable[[tuple, tuple], tuple], state: str, schema: str) -> DataFrame:
    """``step(state, row) -> (state, results)`` over each key's rows in the order of arrival, by ``order`` within a batch.

    ``state`` is the schema of the state tuple. Spark keeps it with the query's checkpoint; a result row for each row.
    """
    names = [f.split()[0] for f in schema.split(",")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        now = tuple(kept.get) if kept.exists else start()
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for row in rows[[*order, *columns]].itertuples(index=False, name=None):
            now, results = step(now, row[len(order):])
            out.append((*key, *row[: len(order)], *results))
        kept.update(now)
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, state, "append", "NoTimeout")


def windowed(stream: DataFrame, time: str, width: str, late: str, keys: list[str], aggregates: dict[str, str]) -> DataFrame:
    """Aggregates by event-time window; rows later than the watermark are left out."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return grouped.agg(*[F.expr(text).alias(name) for name, text in aggregates.items()])
