"""Weighted ways through graph tables against a plain loop, and models that rows name."""

import random

import pytest

from weftline.operators import algebra, latebound
from weftline.plans.graph import FormulaGraph


@pytest.mark.parametrize("seed", [1, 2])
def test_distances_against_a_loop(spark, seed):
    """Random graphs with cycles, formulas without inputs, and inputs that are estimated, too."""
    rng = random.Random(seed)
    data, formulas = [f"x{i}" for i in range(12)], [f"f{i}" for i in range(16)]
    edges, needs, gives = [], {}, {}
    for f in formulas:
        needs[f] = {x: float(rng.randrange(6)) for x in rng.sample(data, rng.choice([1, 1, 2, 3]))} if f != "f0" else {"START": 2.0}
        gives[f] = {x: float(rng.randrange(1, 6)) for x in rng.sample(data, rng.choice([1, 2]))}
        edges += [(x, f, n) for x, n in needs[f].items()] + [(f, x, n) for x, n in gives[f].items()]
    edges.append(("START", "x11", 9.0))
    at = {"START": (0.0, ""), "x0": (1.0, ""), "x1": (3.0, ""), "x11": (9.0, "")}
    while True:
        new = dict(at)
        for f in formulas:
            if all(x in at for x in needs[f]):
                d = max(at[x][0] + n for x, n in needs[f].items())
                new[f] = min(new.get(f, (d, "")), (d, ""))
                for x, n in gives[f].items():
                    new[x] = min(new.get(x, (d + n, f)), (d + n, f))
        if new == at:
            break
        at = new
    nodes = spark.createDataFrame([(x, "data") for x in data] + [(f, "formula") for f in formulas], "id string, type string")
    got = algebra.distances(nodes, spark.createDataFrame(edges, "src string, dst string, length double"), spark.createDataFrame([("x0", 1.0), ("x1", 3.0)], "id string, distance double"))
    assert {r.id: (r.distance, r.via or "") for r in got.collect()} == {k: v for k, v in at.items() if k != "START"}


def test_rows_without_a_model(spark):
    g = FormulaGraph()
    g.formula("$1 + 1", ["a"], "b", name="one")
    rows = spark.createDataFrame([(1, "g"), (2, "other"), (3, None), (None, "g")], "a int, m string")
    assert [r.b for r in latebound.compute_named(rows, {"g": g}, "m", ["b"]).collect()] == [2, None, None, None]
    with pytest.raises(ValueError):
        latebound.compute_named(rows, {"g": g}, "m", ["z"])
    with pytest.raises(ValueError):
        latebound.compute_named(rows, {"g": g}, "m", ["a"])
    too_many = spark.range(65).selectExpr("cast(id as string) as name", "'{}' as spec")
    with pytest.raises(ValueError):
        latebound.read_models(too_many)
