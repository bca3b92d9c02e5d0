"""Models that rows name: each row is computed by the model in one of its columns; functions that are called once for equal inputs."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.graph import FormulaGraph
from weftline.sources import graphs
from weftline.sources.tables import materialize

#: Models that one plan may hold; more belong in several tables.
MOST_MODELS = 64


def read_models(specs: DataFrame, name: str = "name", spec: str = "spec") -> dict[str, FormulaGraph]:
    """The models of a table of specifications (JSON, see ``sources.graphs.load``); more than ``MOST_MODELS`` are an error."""
    rows = specs.select(name, spec).orderBy(name).limit(MOST_MODELS + 1).collect()  # a row for each model
    if len(rows) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    return {r[0]: graphs.load(json.loads(r[1])) for r in rows}


def compute_named(df: DataFrame, models: dict[str, FormulaGraph], by: str, outputs: list[str], lineage: bool = False, **how) -> DataFrame:
    """``df`` with ``outputs`` of the model that column ``by`` names in each row; NULL where it names none or that model lacks them.

    Each model is nested in one graph behind a domain that tests ``by``, so all of them are compiled into one plan: a
    table is read once, a row takes its own branch, and nothing is shuffled. Defaults of a model are its own. With ``lineage``
    ``workflow`` shows the columns had, those of the models by ``model/column``.
    """
    if taken := [x for x in outputs if x in df.columns]:
        raise ValueError(f"columns that are given already: {taken}")
    whole = FormulaGraph("by name")
    for name, model in models.items():
        given = {c: c for c in df.columns if c in model.data_nodes and c != by}
        made = {x: x for x in outputs if x in model.data_nodes}
        if made:
            whole.model(model, given | {by: ()}, made, name=name, domain=_names(by, name))
    if missing := [x for x in outputs if x not in whole.data_nodes]:
        raise ValueError(f"outputs of no model: {missing}")
    found = whole.compute(df, outputs, lineage=lineage, cutoff=False, **how)
    return found.select(*df.columns, *outputs, *(["workflow"] if lineage else []))


def _names(by: str, name: str):
    def domain(values: dict[str, Column]) -> Column:
        return F.coalesce(values[by] == F.lit(name), F.lit(False))

    return domain


def call_once(df: DataFrame, inputs: list[str], function: Callable[..., Column], name: str, max_broadcast: int = 1_000_000) -> DataFrame:
    """``df`` with ``function(*inputs)`` as column ``name``; it is called once for each distinct combination of inputs.

    For functions that cost more than a shuffle of their inputs (Spark interprets a graph's). The results are written; rows
    find theirs by a join, in which a null equals a null, and up to ``max_broadcast`` are broadcast. -0.0 counts as 0.0. The
    function must be deterministic.
    """
    keys = [f"__in{i}" for i in range(len(inputs))]
    distinct = df.select(*[F.col(c).alias(k) for c, k in zip(inputs, keys)]).distinct()
    done = materialize(distinct.select(*keys, function(*map(F.col, keys)).alias(name)))
    done = F.broadcast(done) if done.count() <= max_broadcast else done
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(inputs, keys)])
    return df.join(done, same).drop(*keys)
