"""Graph algebra on node and edge tables: parts, unions and differences, reachability, traces and durations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.tables import materialize

from .ranges import scan


def sub_graph(nodes: DataFrame, edges: DataFrame, keep: DataFrame, drop_edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The part of a graph on the ``keep`` ids: formulas that lost an input or all outputs go, and lone columns.

    Tables that several steps read are written once.
    """
    nodes, edges = materialize(nodes), materialize(edges)
    inside = materialize(nodes.join(keep.select("id"), "id", "left_semi"))
    kept = edges if drop_edges is None else edges.join(drop_edges.select("src", "dst"), ["src", "dst"], "left_anti")
    within = materialize(kept.join(inside.select(F.col("id").alias("src")), "src", "left_semi").join(inside.select(F.col("id").alias("dst")), "dst", "left_semi"))
    formulas = inside.where("type = 'formula'").select("id")
    lost = edges.join(formulas, edges.dst == formulas.id, "left_semi").join(within, ["src", "dst"], "left_anti").select(F.col("dst").alias("id"))
    whole = formulas.join(lost, "id", "left_anti").join(within.select(F.col("src").alias("id")), "id", "left_semi")
    gone = materialize(formulas.join(whole, "id", "left_anti"))
    links = materialize(within.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    ends = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct()
    return inside.join(ends, "id", "left_semi"), links


def reachable(edges: DataFrame, sources: DataFrame, reverse: bool = False, blockers: DataFrame | None = None, max_steps: int = 1000) -> DataFrame:
    """``id, step`` of all nodes that can be reached from ``sources`` (backwards with ``reverse``).

    Blocked nodes are reached but not left. Breadth first: a step is one join with the edges; each step's new nodes are
    written once; cycles end since nodes are entered once. A graph deeper than ``max_steps`` is an error.
    """
    way = materialize(edges).select(F.col("dst" if reverse else "src").alias("id"), F.col("src" if reverse else "dst").alias("next"))
    parts = [materialize(sources.select("id").distinct().withColumn("step", F.lit(0)))]
    for step in range(1, max_steps + 1):
        leaving = parts[-1] if blockers is None else parts[-1].join(blockers.select("id"), "id", "left_anti")
        seen = reduce(DataFrame.unionByName, parts)
        front = materialize(leaving.join(way, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("step", F.lit(step)))
        if front.isEmpty():
            return seen
        if len(parts) == 32:  # few tables to read, each node rewritten every 32 steps at most
            parts = [materialize(reduce(DataFrame.unionByName, parts))]
        parts.append(front)
    raise RuntimeError(f"nodes are farther than {max_steps} steps")


def computable(nodes: DataFrame, edges: DataFrame, inputs: DataFrame, max_steps: int = 1000) -> DataFrame:
    """``id`` of the columns that can be had from ``inputs`` and ``START``, and of the formulas that can be called.

    A formula needs all of its inputs. Each round calls the formulas that have just got their last one.
    """
    formulas = materialize(nodes.where("type = 'formula'").select("id"))
    needs = materialize(edges.join(formulas.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    gives = materialize(edges.join(formulas.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst"))
    starts = edges.where("src = 'START'").join(formulas.withColumnRenamed("id", "dst"), "dst", "left_anti").select(F.col("dst").alias("id"))
    have = materialize(inputs.select("id").unionByName(starts).distinct())
    for _ in range(max_steps):
        lacking = needs.where("src <> 'START'").join(have.withColumnRenamed("id", "src"), "src", "left_anti").select(F.col("dst").alias("id")).distinct()
        called = formulas.join(lacking, "id", "left_anti")
        fresh = materialize(called.unionByName(gives.join(called.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))).distinct().join(have, "id", "left_anti"))
        if fresh.isEmpty():
            return have
        have = materialize(have.unionByName(fresh))
    raise RuntimeError(f"columns are farther than {max_steps} formulas")


def distances(nodes: DataFrame, edges: DataFrame, inputs: DataFrame, max_steps: int = 1000) -> DataFrame:
    """``id, distance, via`` of all that can be had from ``inputs`` (``id, distance``) and ``START``: shortest ways where formulas wait for all inputs.

    ``edges`` has ``src, dst, length``; lengths may be negative, and a way round that gets shorter each time is an error. A formula is as far as its farthest input with the way into it; a
    column is as far as its nearest formula with the way out of it, of several the first by name (``via``; NULL for inputs).

    Label-correcting: each step takes formulas that read a column which has just come nearer, and what they give. Distances
    only shrink, so steps are appended and the least of a node's distances holds. A shortest way calls no formula twice, so
    what still shrinks after as many steps as there are formulas goes round in a cycle.
    """
    formulas = materialize(nodes.where("type = 'formula'").select("id"))
    links = edges.select("src", "dst", F.col("length").cast("double").alias("length"))
    needs = materialize(links.join(formulas.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    gives = materialize(links.join(formulas.withColumnRenamed("id", "src"), "src", "left_semi"))
    none = F.lit(None).cast("string")
    given = inputs.select("id", F.col("distance").cast("double").alias("distance"), none.alias("via"))
    plain = links.where("src = 'START'").join(formulas.withColumnRenamed("id", "dst"), "dst", "left_anti").select(F.col("dst").alias("id"), F.col("length").alias("distance"), none.alias("via"))
    start = formulas.sparkSession.range(1).select(F.lit("START").alias("id"), F.lit(0.0).alias("distance"), none.alias("via"))
    nearest = lambda df: df.groupBy("id").agg(F.min(F.struct("distance", "via")).alias("__m")).select("id", "__m.*")
    parts = [materialize(nearest(given.unionByName(plain).unionByName(start)))]
    fresh, most = parts[0], formulas.count() + 1
    for _ in range(min(max_steps, most)):
        known = nearest(reduce(DataFrame.unionByName, parts))
        touched = needs.join(fresh.select(F.col("id").alias("src")), "src", "left_semi").select("dst").distinct()
        inward = needs.join(touched, "dst", "left_semi").join(known.select(F.col("id").alias("src"), "distance"), "src", "left")
        called = inward.groupBy("dst").agg(F.max(F.col("distance") + F.col("length")).alias("distance"), F.count_if(F.col("distance").isNull()).alias("__lacks")).where("__lacks = 0")
        called = called.select(F.col("dst").alias("id"), "distance", none.alias("via"))
        out = gives.join(called.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("distance") + F.col("length")).alias("distance"), F.col("src").alias("via"))
        found = nearest(called.unionByName(out)).join(known.select("id", F.col("distance").alias("__d"), F.col("via").alias("__v")), "id", "left")
        nearer = F.col("__d").isNull() | (F.col("distance") < F.col("__d")) | ((F.col("distance") == F.col("__d")) & (F.col("via") < F.col("__v")))
        fresh = materialize(found.where(nearer).select("id", "distance", "via"))
        if fresh.isEmpty():
            return known.where("id <> 'START'")
        if len(parts) == 32:
            parts = [materialize(nearest(reduce(DataFrame.unionByName, parts)))]
        parts.append(fresh)
    if most <= max_steps:
        raise ValueError("contradictory paths: a way round gets shorter each time")
    raise RuntimeError(f"columns are farther than {max_steps} formulas")


def shrunk(nodes: DataFrame, edges: DataFrame, inputs: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The smallest part of a graph with all ways from the inputs to the outputs, alternatives for failing domains included.

    Formulas that lack an input go, with all that only they could give, and so does what no output needs. An output that
    can't be had isn't in it.
    """
    nodes, edges = materialize(nodes), materialize(edges)
    live = computable(nodes, edges, inputs)
    usable = edges.join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi")
    usable = materialize(usable)
    needed = reachable(usable, outputs.select("id").join(live, "id", "left_semi"), reverse=True, blockers=inputs)
    return sub_graph(nodes, usable, materialize(needed.select("id")))


def prune_models(edges: DataFrame, inputs: DataFrame | None = None, outputs: DataFrame | None = None) -> DataFrame:
    """``edges`` without the links of nested models (``model<column``, ``model>column``) that lead from or to nothing.

    A way in is kept if its target is read within the model or asked for, a way out if its source is estimated or given.
    """
    end = lambda df, name: df.select(F.col("id").alias(name)) if df is not None else None
    link = F.col("dst").rlike(r"[<>][^<>]*$") & (F.col("dst") != "START")
    ways_in = edges.where(F.col("src").rlike(r"^.+<[^<>]+$")).select(F.col("src").alias("link"), F.col("dst").alias("column"))
    ways_out = edges.where(link & F.col("dst").rlike(r"^.+>[^<>]+$")).select(F.col("dst").alias("link"), F.col("src").alias("column"))
    dead_in = ways_in.join(edges.select(F.col("src").alias("column")), "column", "left_anti")
    dead_in = dead_in if outputs is None else dead_in.join(end(outputs, "column"), "column", "left_anti")
    dead_out = ways_out.join(edges.select(F.col("dst").alias("column")), "column", "left_anti")
    dead_out = dead_out if inputs is None else dead_out.join(end(inputs, "column"), "column", "left_anti")
    dead = dead_in.select("link").unionByName(dead_out.select("link"))
    return edges.join(dead.withColumnRenamed("link", "src"), "src", "left_anti").join(dead.withColumnRenamed("link", "dst"), "dst", "left_anti")


def union(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of both graphs; of a node in both the second holds."""
    (an, ae), (bn, be) = a, b
    return an.join(bn, "id", "left_anti").unionByName(bn), ae.join(be, ["src", "dst"], "left_anti").unionByName(be)


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys), keys, "left_anti")


def find_node(nodes: DataFrame, text: str) -> DataFrame:
    """The node with that id, else the first whose id contains the text."""
    return nodes.where(F.col("id").contains(text)).orderBy(F.col("id") != text, "id").limit(1)


def node_types(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("type") == kind)


def trace(workflow: DataFrame, keys: list[str], steps: str = "workflow") -> DataFrame:
    """The execution trace of each row: ``place, node, formula, distance`` in the order of visits."""
    rows = workflow.select(*keys, F.posexplode(steps).alias("place", "s"))
    return rows.select(*keys, "place", F.col("s.node").alias("node"), F.col("s.formula").alias("formula"), F.col("s.distance").alias("distance"))


def durations(timings: DataFrame, path: str = "path", seconds: str = "seconds") -> DataFrame:
    """Total and own time of each node of a tree, from leaf timings by path (``a/b/c``).

    ``total`` adds up all timings at or below a path, ``own`` is what its children don't account for.
    """
    parts = F.split(F.col(path), "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = timings.select(F.explode(levels).alias("node"), seconds, (F.col(path)).alias("__leaf"))
    total = up.groupBy("node").agg(F.sum(seconds).alias("total"), F.sum(F.when(F.col("node") == F.col("__leaf"), F.col(seconds)).otherwise(0)).alias("own"))
    return total.withColumn("depth", F.size(F.split("node", "/")))


def numbered(names: DataFrame, name: str = "name", order: str = "id") -> DataFrame:
    """Names made unique: the first stays, the others get ``<0>``, ``<1>``, ..."""
    place = F.col("__place")
    numbers = scan(names, [name], [order], {"__place": F.lit(1)})
    return numbers.withColumn("unique_name", F.when(place == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("<"), (place - 2).cast("string"), F.lit(">")))).drop("__place")


def summary(text: Column) -> Column:
    """The first sentence of a description."""
    return F.trim(F.regexp_extract(F.trim(text), r"^([^.\n]*\.?)", 1))


def documented(text: Column, what: str) -> Column:
    """The text behind ``:what:`` of a docstring's field list, to the end of its line."""
    return F.trim(F.regexp_extract(text, rf":{what}:[ \t]*([^\n]*)", 1))
