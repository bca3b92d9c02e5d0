"""Models over many records: with defaults for each, and as an ordered fold in which each feeds the next."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.compile import as_column, lenient
from weftline.plans.graph import FormulaGraph
from weftline.sources.tables import materialize

from .ranges import longest, scan


def map_model(df: DataFrame, graph: FormulaGraph, defaults: dict[str, object] | None = None, outputs: list[str] | None = None, **how) -> DataFrame:
    """The model on every row; ``defaults`` stand in for what a row lacks."""
    missing = {c: F.lit(v) if c not in df.columns else F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()}
    return graph.compute(df.withColumns(missing) if missing else df, outputs, **how)


#: Rows of a key that one round folds at least and at most, the rounds it is cut into in between, and rows of a block.
CHUNK_ROWS, MOST_ROWS, ROUNDS, BLOCK_ROWS = 1 << 14, 1 << 20, 4, 512


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], zero: Column, step: Callable[[Column, Column], Column],
                 emit: Callable[[Column], dict[str, Column]] | None = None) -> DataFrame:
    """Ordered fold of each key's rows within the JVM: ``step(state, row)`` gives the next state, from ``zero`` on.

    ``row`` has ``columns`` and ``order``. With ``emit`` a result row for each row, ``keys, order`` and what it makes of the
    state behind that row; without, ``keys, state`` at the end. Null keys are a key, nulls come first in ``order``, which should be total.

    Consecutive rows of a key are an array, which one aggregate folds. A key with more than ``CHUNK_ROWS`` rows is cut into
    ``ROUNDS`` chunks that follow each other, each round over the keys that have so many: the rounds don't grow with a key
    up to 4 million rows, after which a chunk's ``MOST_ROWS`` rows bound a task's memory. Rows are put in order by ranges, so
    no task holds more of a key than a chunk.
    """
    rows = df.select(*dict.fromkeys([*keys, *order, *columns]))
    most = longest(rows, keys)
    row = F.struct(*[c for c in dict.fromkeys([*order, *columns]) if c not in keys])
    if most <= CHUNK_ROWS:
        packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("__rows")).withColumn("__turn", F.lit(1))
        blocks, turns = F.transform(F.sequence(F.lit(0), (F.size("__rows") - 1).cast("int"), F.lit(BLOCK_ROWS)), lambda i: F.slice("__rows", i + 1, F.lit(BLOCK_ROWS))), 1
    else:
        chunk = min(MOST_ROWS, max(CHUNK_ROWS, -(-most // ROUNDS)))
        placed = scan(rows, keys, order, {"__at": F.lit(1).cast("long")}, window_rows=0)
        places = [F.expr(f"(__at - 1) div {chunk} + 1").cast("int").alias("__turn"), F.expr(f"(__at - 1) div {BLOCK_ROWS}").alias("__block")]
        packed = placed.groupBy(*keys, *places).agg(F.sort_array(F.collect_list(row)).alias("__r"))
        packed = packed.groupBy(*keys, "__turn").agg(F.sort_array(F.collect_list(F.struct("__block", "__r"))).alias("__rows"))
        packed, turns = materialize(packed, partition_by=("__turn",)), -(-most // chunk)
        blocks = F.transform("__rows", lambda b: b["__r"])

    def one(state: Column, row: Column) -> Column:
        after = step(state["state"], row)
        if emit is None:
            return F.struct(after.alias("state"))
        return F.transform(F.array(after), lambda s: F.struct(s.alias("state"), F.array_append(state["out"], F.struct(*[row[c].alias(c) for c in order], *[c.alias(k) for k, c in emit(s).items()])).alias("out")))[0]

    def block(state: Column, rows: Column) -> Column:  # results are appended to a short list, and this to the others
        begin = F.struct(state["state"].alias("state"), *([F.expr(f"cast(array() as {out})").alias("out")] if emit else []))
        inner = F.aggregate(rows, begin, one)
        if emit is None:
            return inner
        return F.transform(F.array(inner), lambda s: F.struct(s["state"].alias("state"), F.array_append(state["out"], s["out"]).alias("out")))[0]

    kind = df.limit(0).select(zero.alias("s")).schema["s"].dataType.simpleString()
    if emit:
        shown = df.limit(0).select(*order, zero.alias("s")).select(*order, *[c.alias(k) for k, c in emit(F.col("s")).items()])
        out = shown.schema
        out = f"array<struct<{','.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in out)}>>"
    start = F.struct(F.col("__begin").alias("state"), *([F.expr(f"cast(array() as array<{out}>)").alias("out")] if emit else []))
    whole, done, states = F.aggregate(blocks, start, block).alias("__f"), [], None
    for turn in range(1, turns + 1):
        part = packed.where(F.col("__turn") == turn).withColumn("__begin", zero.cast(kind))
        if states is not None:
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)])
            part = part.drop("__begin").join(states.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.col("__state").alias("__begin")), same)
        folded = part.select(*keys, whole)
        folded = folded.select(*keys, F.col("__f.state").alias("__state"), *([F.flatten("__f.out").alias("__out")] if emit else []))
        if turns > 1:
            folded = materialize(folded)
        done.append(folded)
        states = folded
    if emit:
        return reduce(DataFrame.unionByName, [d.select(*keys, F.explode("__out").alias("__o")).select(*keys, "__o.*") for d in done])
    if turns == 1:
        return done[0].withColumnRenamed("__state", "state")
    last = [d.select(*keys, F.struct(F.lit(i).alias("i"), F.col("__state").alias("s")).alias("l")) for i, d in enumerate(done)]
    return reduce(DataFrame.unionByName, last).groupBy(*keys).agg(F.max_by("l", "l.i").alias("l")).select(*keys, F.col("l.s").alias("state"))


def fold_model(df: DataFrame, graph: FormulaGraph, carried: dict[str, str], keys: list[str], order: list[str], fields: dict[str, str]) -> DataFrame:
    """Ordered fold in which results of a row are inputs of the next one: ``carried`` maps outputs to inputs.

    What a row gives itself wins over what is carried. Each step is the whole graph, whatever its size, with its domains,
    distances, defaults, merges, cycles and SQL texts (see ``compile.as_column``); what fails is absent. ``fields`` names the
    outputs wanted, with types; an output that a row can't have is NULL and carries nothing. See ``ordered_fold`` for keys with very many rows.
    """
    if missing := [o for o in carried if o not in fields]:
        raise ValueError(f"carried outputs need a type in fields: {missing}")
    inputs = [c for c in df.columns if c in graph.data_nodes]
    feed = {i: o for o, i in carried.items()}
    copied = df.withColumns({f"__own_{c}": F.col(c) for c in inputs if c in keys})  # a key may be an input, too

    def step(state: Column, row: Column) -> Column:
        given = {}
        for x in dict.fromkeys([*inputs, *feed]):
            own = [row[f"__own_{x}" if x in keys else x]] if x in inputs else []
            given[x] = F.coalesce(*own, *([state[feed[x]]] if x in feed else []))
        return as_column(graph, given, fields, kinds=fields)

    zero = F.expr(f"cast(null as struct<{', '.join(f'`{k}`: {t}' for k, t in fields.items())}>)")
    with lenient(df.sparkSession):
        return ordered_fold(copied, keys, order, [f"__own_{c}" if c in keys else c for c in inputs], zero, step, lambda s: {k: s[k] for k in fields})


def fold_rows(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple], columns: list[str], schema: str) -> DataFrame:
    """Ordered fold of each key's rows by ``step(state, row) -> (state, results)``; a result row for each row.

    Spark deals rows out by key and sorts them; a task streams through its rows and holds one key's state at a
    time, so a key may have any number of rows. ``schema`` has the keys, the order columns and the results.
    """
    rows = df.select(*keys, *order, *columns).repartition(*keys).sortWithinPartitions(*keys, *order)
    n, m = len(keys), len(keys) + len(order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                if row[:n] != now:
                    now, state = row[:n], start()
                state, results = step(state, row[m:])
                out.append((*row[:m], *results))
            yield pd.DataFrame(out, columns=names)

    names = [f.split()[0] for f in schema.split(",")]
    return rows.mapInPandas(run, schema)
