"""Known results of formula graphs, and random graphs against a plain shortest-path loop."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from weftline.plans.graph import SINK, FormulaGraph, far
from weftline.plans.q_dispatch import fixture
from weftline.sources import graphs


def one(spark, **given):
    return spark.createDataFrame([tuple(float(v) for v in given.values())], ", ".join(f"{x} double" for x in given))


def had(df):
    return {k: v for k, v in df.collect()[0].asDict().items() if v is not None}


def test_shortest_path_and_pass_through(spark):
    assert had(fixture().compute(one(spark, a=5, b=6, f=9))) == {"a": 5, "b": 6, "c": 0, "d": 0, "e": 2, "f": 9}


def test_domain_falls_back_to_the_long_way(spark):
    assert had(fixture().compute(one(spark, a=5, b=3))) == {"a": 5, "b": 3, "c": 3, "d": 1, "e": 1}


def test_targets_cut_off(spark):
    assert had(fixture().compute(one(spark, a=5, b=6), ["d"])) == {"a": 5, "b": 6, "c": 0, "d": 0}


def test_wildcards(spark):
    assert had(fixture().compute(one(spark, a=5, b=6), ["a", "b"], wildcard=True)) == {"b": 1, "c": 0, "d": 0, "e": 2}
    assert had(fixture().compute(one(spark, a=5, b=6), ["a", "b"], wildcard=2)) == {"a": 5, "b": 1, "c": 0, "d": 0, "e": 2}
    assert had(fixture().compute(one(spark, a=5, b=6, d=0), ["a", "b", "d"], wildcard=True, distances={"a": 1})) == {"b": 1, "c": 6, "d": 5, "e": 2}


def test_distances_of_inputs(spark):
    assert had(fixture(weights=False).compute(one(spark, a=5, b=6), distances={"b": 1})) == {"a": 5, "b": 6, "c": 0, "d": 1, "e": 1}


def test_ties_go_to_the_first_name(spark):
    for first, second, want in ((F.greatest, F.least, 3), (F.least, F.greatest, 1)):
        g = FormulaGraph()
        g.formula(lambda a, b, f=second: f(a, b), ["a", "b"], "c", name="B")
        g.formula(lambda a, b, f=first: f(a, b), ["a", "b"], "c", name="A")
        assert had(g.compute(one(spark, a=1, b=3)))["c"] == want


def test_default_of_last_resort(spark):
    g = FormulaGraph()
    g.data("c", default=0.0, distance=far(1, 1))
    g.formula(lambda a, b: F.greatest(a, b), ["a", "b"], "c", name="max")
    g.formula(lambda c, b: F.least(c, b), ["c", "b"], "d", name="min")
    assert had(g.compute(one(spark, a=6, b=5))) == {"a": 6, "b": 5, "c": 6, "d": 5}
    assert had(g.compute(one(spark, a=6, b=5), distances={"a": far(2)})) == {"a": 6, "b": 5, "c": 0, "d": 0}


def test_waiting_average_filters_and_sink(spark):
    g = FormulaGraph()
    g.formula(lambda a, b=1.0: b - a, outputs="c", name="diff")
    g.data("d", default=4.0, merge=lambda parts: sum(parts.values()) / len(parts))
    g.formula(lambda c: F.ln(c), ["c"], "d", name="log", domain=lambda c: c > 0)
    assert had(g.compute(one(spark, a=0))) == {"a": 0, "b": 1, "c": 1, "d": 2}
    g = FormulaGraph()
    g.data("a", default=0.0, filters=[lambda x: x + 1] * 3)
    g.formula(lambda a: a + 1, ["a"], "b", name="f", filters=[lambda x: x + 4])
    g.formula(lambda a: a + 1, ["a"], "c", name="g", filters=[lambda x: F.lit(None).cast("double")])
    assert had(g.compute(spark.range(1).drop("id"))) == {"a": 3, "b": 8}
    assert had(g.compute(one(spark, a=1))) == {"a": 4, "b": 9}
    g = FormulaGraph()
    g.formula(lambda: (F.lit(3), F.lit(5)), [], ["a", SINK], name="f")
    g.formula(lambda: (F.lit(3), F.lit(5)), [], [SINK, "b"], name="g")
    assert had(g.compute(spark.range(1).drop("id"))) == {"a": 3, "b": 5}


def test_nested_models(spark):
    inner = FormulaGraph("inner")
    inner.formula(lambda c: (c + 3, c - 3), ["c"], ["d", "e"], name="shift")
    child = FormulaGraph("child")
    child.formula(lambda a, b: F.least(a, b), ["a", "b"], "c", name="min")
    child.model(inner, {"c": "c"}, {"d": "x", "e": "y"})
    parent = FormulaGraph("parent")
    parent.model(child, {"p": "a", "q": "b"}, {"c": ("low", "low2"), "x": "up"}, domain=lambda v: v["p"] > 0)
    assert had(parent.compute(one(spark, p=3, q=5))) == {"p": 3, "q": 5, "low": 3, "low2": 3, "up": 6}
    assert had(parent.compute(one(spark, p=-3, q=5))) == {"p": -3, "q": 5}


def test_construction_rules():
    g = FormulaGraph()
    assert g.formula(lambda a: a, ["a"], "b", name="f") == "f" and g.formula(lambda a: a, ["a"], "c", name="f") == "f<0>"
    assert g.data() == "unknown" and g.data() == "unknown<0>"
    with pytest.raises(ValueError):
        g.data("f")
    with pytest.raises(ValueError):
        g.formula(lambda a: a, ["a"], "b", weight=-1)
    other = FormulaGraph()
    other.formula(lambda z: z, ["z"], "b", name="f")
    assert set(g.extend(other).formulas) == {"f", "f<0>", "f<1>"} and set(g.formulas) == {"f", "f<0>"}


def test_plan_without_data():
    assert fixture().plan(["a", "b"]) == [(0, "a", "START"), (0, "b", "START"), (2, "c", "log(b - a)"), (4, "d", "min"), (6, "e", "2 / (d + 1)")]
    assert [x for _, x, _ in fixture().plan(["a"])] == ["a", "d", "e", "b", "c"]
    assert fixture().find("log") == "log(b - a)" and fixture().find("a") == "a"


def test_planning_many_formulas_is_fast():
    import time

    g = FormulaGraph()
    for i in range(700):
        g.formula(lambda x: x, [f"c{i}"], f"c{i + 1}", name=f"f{i}")
    began = time.perf_counter()
    assert len(g.plan(["c0"])) == 701 and time.perf_counter() - began < 5


def test_specification_round_trip(spark, tmp_path):
    spec = {"name": "s", "data": [{"name": "b", "default": 2.0}],
            "formulas": [{"build": "$1 + $2", "inputs": ["a", "b"], "outputs": "c"}, {"build": ["$1 * 2", "$1 - 1"], "inputs": ["c"], "outputs": ["d", "e"], "domain": "$1 > 0", "name": "two"}]}
    graphs.write_spec(spark, graphs.load(spec), str(tmp_path / "spec"))
    g = graphs.read_spec(spark, str(tmp_path / "spec"))
    assert had(g.compute(one(spark, a=5))) == {"a": 5, "b": 2, "c": 7, "d": 14, "e": 6}
    assert graphs.set_defaults(g, graphs.defaults(spark, g)).data_nodes["b"].default == 2.0


def shortest(formulas, given):
    """Settle the nearest column first; a formula sees settled values alone."""
    done, heap = {}, [(0.0, x, "", v) for x, v in given.items() if v is not None]
    heapq.heapify(heap)
    called = set()
    while heap:
        d, x, name, v = heapq.heappop(heap)
        if x in done:
            continue
        done[x] = (d, v)
        for f, (inputs, output, weight, function) in formulas.items():
            if f not in called and all(i in done for i in inputs):
                called.add(f)
                got = function(*[done[i][1] for i in inputs])
                if got is not None and output not in done:
                    heapq.heappush(heap, (max(done[i][0] for i in inputs) + 2 + weight, output, f, got))
    return {x: v for x, (_, v) in done.items()}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    columns = "abcdef"
    formulas, g = {}, FormulaGraph()
    for x in columns:
        g.data(x, dtype="double")
    for i in range(9):
        inputs, output = rng.sample(columns, rng.choice((1, 2))), rng.choice(columns)
        if output in inputs:
            continue
        weight, k, limit = rng.randrange(4) + i / 64, rng.randrange(1, 5), rng.choice((-2, 0, 100))
        name = f"f{i}"
        formulas[name] = (inputs, output, weight, lambda *v, k=k, limit=limit: (sum(v) * k) % 17 - 8 if v[0] < limit or limit == 100 else None)
        g.formula(lambda *v, k=k: F.pmod(sum(v[1:], v[0]) * k, F.lit(17.0)) - 8, inputs, output, name=name, weight=weight,
                  domain=None if limit == 100 else lambda *v, limit=limit: v[0] < limit)
    rows = [tuple(float(rng.randrange(-6, 7)) if rng.random() < 0.4 else None for _ in columns) for _ in range(8)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{x} double" for x in columns))
    for got in g.compute(df).collect():
        want = shortest(formulas, dict(zip(columns, rows[got["id"]])))
        assert {x: got[x] for x in columns if got[x] is not None} == want


def test_failures_are_recorded_or_raised(spark):
    g = FormulaGraph()
    g.formula(lambda a, b: a / b, ["a", "b"], "c", name="divide")
    g.formula(lambda a: a, ["a"], "c", name="plain", weight=5)
    g.formula("cast($1 as string)", ["c"], "d", name="text")
    rows = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert [r.c for r in g.compute(rows).collect()] == [1.0, 0.5]  # a division by zero takes the next path
    got = g.compute(rows, raises="record").collect()
    assert [r.errors for r in got] == [["divide"], []] and [r.c for r in got] == [1.0, 0.5]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|divide failed"):
        g.compute(rows, raises="error").collect()
    with pytest.raises(Exception, match="none failed"):
        h = FormulaGraph()
        h.formula(lambda a: F.when(a > 1, a), ["a"], "z", name="none")
        h.compute(rows, raises="error").collect()
    with pytest.raises(ValueError):
        g.compute(rows, ["c", "nowhere"])
    with pytest.raises(ValueError):
        g.compute(rows, raises="now and then")


def test_models_as_functions(spark):
    g = FormulaGraph()
    g.formula(lambda a, b: F.ln(b - a), ["a", "b"], "c", name="log", domain=lambda a, b: a < b)
    g.formula(lambda a: a - 4, ["a"], "c", name="far", weight=20)
    f = g.function(["a", "b"], ["c"], {"c": "double"}, "value")
    got = spark.createDataFrame([(5.0, 6.0), (5.0, 3.0)], "a double, b double").select(f(F.col("a"), b=F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [0.0, 1.0]
    for wrong in (lambda: f(F.lit(1), F.lit(2), F.lit(3)), lambda: f(F.lit(1)), lambda: f(F.lit(1), a=F.lit(2)), lambda: f(F.lit(1), z=F.lit(2))):
        with pytest.raises(TypeError):
            wrong()
    with pytest.raises(ValueError):
        FormulaGraph().function([], ["x"])()


def test_any_graph_as_a_function(spark):
    """The fixture with its cycle, domains and long way, and a chain of 60 formulas."""
    rows = spark.createDataFrame([(5.0, 6.0), (5.0, 3.0), (None, 2.0), (-1.0, 0.0)], "a double, b double")
    names = ["c", "d", "e"]
    f = fixture().function(["a", "b"], names, dict.fromkeys(names, "double"))
    want = fixture().compute(rows, cutoff=False).select(*names)
    assert rows.select(f(F.col("a"), F.col("b")).alias("s")).select("s.*").collect() == want.collect()
    g = FormulaGraph()
    for i in range(60):
        g.formula(lambda x: x + 1, [f"x{i}"], f"x{i + 1}", name=f"f{i}")
    assert rows.select(g.function(["x0"], "x60", {"x60": "double"}, "value")(F.col("b")).alias("x")).collect()[0].x == 66.0
    child = FormulaGraph("child")
    child.formula(lambda a, b: f(a, b)["d"], ["a", "b"], "m", name="a graph as a formula")
    assert [r.m for r in child.compute(rows).collect()] == [r.d for r in want.collect()]


def test_filters_on_results_stay_above_the_layers(spark):
    out = fixture().compute(spark.createDataFrame([(5.0, 6.0), (5.0, 3.0)], "a double, b double")).where("c > 1 and e > 0")
    assert [(r.c, r.d, r.e) for r in out.collect()] == [(3.0, 1.0, 1.0)]


def test_decorator_bulk_and_copies():
    g = FormulaGraph()

    @g.adds("b")
    def twice(a):
        return a * 2

    other = g.copy()
    assert g.add_all([{"name": "x"}], [{"build": "$1", "inputs": ["x"], "outputs": "y", "name": "f"}]) == ["x", "f"]
    child = FormulaGraph("m")
    child.formula(lambda u: u, ["u"], "v", name="id")
    g.model(child, {"x": "u"}, {"v": "z"}, domain=lambda v: v["x"] > 0)
    assert "twice" in other.formulas and "f" not in other.formulas and not other.guards and list(g.guards) == ["m"]


def test_columns_that_are_called_like_layers(spark):
    rows = spark.createDataFrame([(5.0, 6.0, 1, 2, 3)], "a double, b double, __n0 int, __nfar int, _prefix int")
    assert [tuple(r[c] for c in ("d", "__n0", "__nfar", "_prefix")) for r in fixture().compute(rows, ["d"]).collect()] == [(0.0, 1, 2, 3)]


def test_a_domain_waits_for_all_it_is_offered(spark):
    """The domain of a nested model reads a column that is computed, and one that the model doesn't take."""
    child = FormulaGraph("child")
    child.formula(lambda u: u * 10, ["u"], "v", name="ten")
    g = FormulaGraph("parent")
    g.formula(lambda a: a + 1, ["a"], "b", name="one")
    g.model(child, {"a": "u", "b": (), "k": ()}, {"v": "out"}, domain=lambda v: (v["b"] > 2) & (v["k"] == "yes"))
    rows = spark.createDataFrame([(1, "yes"), (2, "yes"), (2, "no"), (3, None)], "a int, k string")
    assert [r.out for r in g.compute(rows, ["out"]).collect()] == [None, 20, None, None]
