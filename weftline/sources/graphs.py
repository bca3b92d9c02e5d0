"""Graphs as tables: nodes, edges, default values, and specifications whose formulas are SQL text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from weftline.plans.graph import FormulaGraph

NODES = "id string, type string, weight double, waits boolean, description string"
EDGES = "src string, dst string, length double"


def nodes(spark: SparkSession, graph: FormulaGraph) -> DataFrame:
    return spark.createDataFrame(graph.node_rows(), NODES)


def edges(spark: SparkSession, graph: FormulaGraph) -> DataFrame:
    return spark.createDataFrame(graph.edges(), EDGES)


def defaults(spark: SparkSession, graph: FormulaGraph) -> DataFrame:
    """Default values as JSON, with their distances."""
    rows = [(d.name, json.dumps(d.default), d.distance) for d in graph.data_nodes.values() if d.default is not None]
    return spark.createDataFrame(rows, "id string, value string, distance double")


def set_defaults(graph: FormulaGraph, table: DataFrame) -> FormulaGraph:
    out = graph.copy()
    for row in table.collect():  # a row for each data column of a graph
        out.set_default(row["id"], json.loads(row["value"]), row["distance"])
    return out


def load(spec: dict) -> FormulaGraph:
    """A graph from a specification: ``{name, data: [{name, default, ...}], formulas: [{name, build, inputs, outputs, domain, ...}]}``.

    ``build`` and ``domain`` are SQL texts in which ``$1``, ``$2``, ... stand for the inputs in their order; a list
    of texts gives several outputs.
    """
    graph = FormulaGraph(spec.get("name", ""), spec.get("description", ""))
    graph.add_all(spec.get("data", ()), [{"name": str(f["build"]), **f} for f in spec.get("formulas", ())])
    return graph


def spec(graph: FormulaGraph) -> dict:
    """The specification of a graph whose formulas are all SQL texts (Column builders have none)."""
    if bad := [f.name for f in graph.formulas.values() if callable(f.build) or callable(f.domain) or f.filters]:
        raise ValueError(f"formulas without SQL text: {bad}")
    data = [{"name": d.name, "default": d.default, "distance": d.distance, "weight": d.weight, "dtype": d.dtype, "description": d.description} for d in graph.data_nodes.values()]
    formulas = [{"name": f.name, "build": f.build, "inputs": list(f.inputs), "outputs": list(f.outputs), "domain": f.domain, "weight": f.weight,
                 "input_weights": f.input_weights, "output_weights": f.output_weights, "description": f.description} for f in graph.formulas.values()]
    return {"name": graph.name, "description": graph.description, "data": data, "formulas": formulas}


def write_spec(spark: SparkSession, graph: FormulaGraph, path: str) -> None:
    """The specification as one JSON document, in any file system that Spark writes to."""
    spark.createDataFrame([(json.dumps(spec(graph)),)], "value string").coalesce(1).write.text(path)


def read_spec(spark: SparkSession, path: str) -> FormulaGraph:
    return load(json.loads("\n".join(r["value"] for r in spark.read.text(path).collect())))
