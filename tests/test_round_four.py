"""Deep merges, negative weights and the ordered layout of documents against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.operators import algebra, latebound, ledger
from weftline.plans.graph import FormulaGraph
from weftline.plans.q_dispatch import fixture
from weftline.sources import ordered


def plain_merge(left, right):
    if not isinstance(right, dict):
        return right
    out = dict(left) if isinstance(left, dict) else {}
    for k, v in right.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = plain_merge(out.get(k), v)
    return out


def some_json(rng, depth=4):
    kind = rng.random()
    if depth and kind < 0.6:
        return {rng.choice(["a", "b", "a.b", 'q"', "é", ""]): some_json(rng, depth - 1) for _ in range(rng.randrange(4))}
    if depth and kind < 0.7:
        return [some_json(rng, depth - 1) for _ in range(rng.randrange(3))]
    return rng.choice([None, True, 1, -2.5, 10**20, "", "null", 'a"b\\', "ü"])


def test_deep_merges_against_a_loop(spark):
    rng = random.Random(5)
    given = [[some_json(rng) for _ in range(3)] for _ in range(300)]
    df = spark.createDataFrame([(i, *map(json.dumps, x)) for i, x in enumerate(given)], "id int, a string, b string, c string")
    merged = df.select("id", C.merge_json(F.col("a"), F.col("b"), F.col("c")).alias("m"))
    for r in merged.collect():
        a, b, c = given[r.id]
        assert json.loads(r.m) == plain_merge(plain_merge(a, b), c)
    assert "Python" not in merged._jdf.queryExecution().executedPlan().toString()
    one = lambda *x: spark.range(1).select(C.merge_json(*[F.lit(v).cast("string") for v in x]).alias("m")).first().m
    assert one(None, '{"a":null}') == '{"a":null}' and one('{"a":1}', None) == '{"a":1}' and one(None, None) is None and one("{}") == "{}"


def test_deep_merges_end_with_an_error(spark):
    nested = lambda n: '{"a":' * n + "1" + "}" * n
    merge = lambda x, y, **k: spark.range(1).select(C.merge_json(F.lit(x), F.lit(y), **k).alias("m")).first().m
    assert merge("{}", nested(12)) == nested(12) and merge(nested(40), '{"b":2}') == nested(40)[:-1] + ',"b":2}'
    for x, y in (("{}", nested(13)), ("{}", "no json"), ("{}", '{"a":1,"a":2}')):
        with pytest.raises(Exception, match="nested deeper|MALFORMED|DUPLICATE"):
            merge(x, y)


def shortest(formulas, given):
    """Distances and values relaxed until nothing changes; a formula is as far as its farthest input."""
    best = {x: (0.0, "", v) for x, v in given.items() if v is not None}
    for _ in range(50):
        new = {x: b for x, b in best.items() if b[1] == ""}
        for f in sorted(formulas):
            inputs, output, weight, k = formulas[f]
            if all(x in best for x in inputs):
                d = max(best[x][0] for x in inputs) + 2 + weight
                if output not in new or d < new[output][0]:
                    new[output] = (d, f, sum(best[x][2] for x in inputs) * k % 17)
        if new == best:
            return {x: v for x, (_, _, v) in best.items()}
        best = new
    return None


@pytest.mark.parametrize("seed", range(4))
def test_negative_weights_against_a_loop(spark, seed):
    rng = random.Random(seed)
    columns, tried = "abcde", 0
    while True:  # a graph in which no way round gets shorter
        tried += 1
        formulas, g = {}, FormulaGraph(negative_weights=True)
        for x in columns:
            g.data(x, dtype="double")
        for i in range(7):
            inputs, output = rng.sample(columns, rng.choice((1, 1, 2))), rng.choice(columns)
            if output not in inputs:
                formulas[f"f{i}"] = (inputs, output, rng.choice([-5, -3, 0, 1, 4, 6]) + i / 64, rng.randrange(1, 5))
                g.formula(lambda *v, k=formulas[f"f{i}"][3]: F.pmod(sum(v[1:], v[0]) * k, F.lit(17.0)), inputs, output, name=f"f{i}", weight=formulas[f"f{i}"][2])
        rows = [tuple(float(rng.randrange(1, 9)) if rng.random() < 0.4 else None for _ in columns) for _ in range(8)]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{x} double" for x in columns))
        if not any(w < -2 for _, _, w, _ in formulas.values()):
            continue
        try:
            found = g.compute(df)
        except ValueError:
            continue
        break
    wants = [shortest(formulas, dict(zip(columns, r))) for r in rows]
    assert None not in wants
    for r in found.collect():
        given = {x for x, v in zip(columns, rows[r.id]) if v is not None}
        assert {x: r[x] for x in columns if r[x] is not None and x not in given} == {x: v for x, v in wants[r.id].items() if x not in given}, (formulas, rows[r.id])


def test_contradictory_paths(spark):
    g = FormulaGraph(negative_weights=True)
    g.formula("$1 + 1", ["a"], "b", name="ab", weight=-5)
    g.formula("$1 + 1", ["b"], "a", name="ba")
    g.formula("$1 + 1", ["z"], "a", name="za")
    with pytest.raises(ValueError, match="contradictory"):
        g.compute(spark.createDataFrame([(1,)], "z int"), ["b"])
    with pytest.raises(ValueError, match="contradictory"):
        g.plan(["z"])
    nodes = spark.createDataFrame([("a", "data"), ("b", "data"), ("f", "formula"), ("g", "formula")], "id string, type string")
    edges = spark.createDataFrame([("a", "f", 1.0), ("f", "b", -3.0), ("b", "g", 1.0), ("g", "a", 0.5)], "src string, dst string, length double")
    start = spark.createDataFrame([("a", 0.0)], "id string, distance double")
    with pytest.raises(ValueError, match="contradictory"):
        algebra.distances(nodes, edges, start)
    mended = edges.withColumn("length", F.when(F.col("src") == "g", 5.0).otherwise(F.col("length")))
    assert {r.id: r.distance for r in algebra.distances(nodes, mended, start).collect()} == {"a": 0.0, "f": 1.0, "b": -2.0, "g": -1.0}


def test_plans_with_negative_weights():
    g = FormulaGraph(negative_weights=True)
    g.formula("$1", ["a"], "x", name="ax", weight=1)
    g.formula("$1", ["b"], "y", name="by", weight=3)
    g.formula("$1", ["y"], "x", name="yx", weight=-5)
    g.formula("$1", ["x"], "y", name="xy", weight=2)
    assert g.plan(["a", "b"]) == [(0, "a", "START"), (0, "b", "START"), (2, "x", "yx"), (5, "y", "by")]


def scanned_rows(df):
    """Rows that came out of a table's scan, behind its row groups' statistics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan).collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_ordered_layout_against_a_sort(spark, tmp_path):
    """Pages in both directions and cursors, with null times, equal places and a category without a name; few rows are read."""
    rng = random.Random(3)
    at = lambda: None if rng.random() < 0.05 else rng.randrange(300)
    docs = [(i % 5900, None if i % 50 == 0 else "hot" if i % 3 else "b", at() if i < 5900 else 7, "%030x" % rng.getrandbits(2000)) for i in range(6000)]
    df = spark.createDataFrame(docs, "_id long, category string, updated_at long, data string")
    path = str(tmp_path / "docs")
    ordered.write_ordered(df.repartition(3), path, group_bytes=1 << 16, zone_rows=100)
    assert spark.read.parquet(path).count() == 6000
    by = lambda r: (r[1] is not None, r[1] or 0, r[0])
    for category in ("hot", "b", None, "none"):
        want = sorted(((d[0], d[2]) for d in docs if d[1] == category), key=by)
        for limit, offset, down in ((20, 0, False), (20, 0, True), (50, 333, True), (7, 95, False), (30, len(want) - 10, False), (30, len(want) - 10, True), (10, len(want) + 5, True), (10, len(want) + 5, False)):
            if offset < 0:
                continue
            page = ordered.ordered_page(spark, path, category, limit, offset, down)
            ranked = want[::-1] if down else want
            assert [(r._id, r.updated_at) for r in page.collect()] == ranked[offset:offset + limit], (category, limit, offset, down)
    want = sorted(((d[0], d[2]) for d in docs if d[1] == "hot"), key=by)
    for down in (False, True):
        ranked = want[::-1] if down else want
        for k in (0, 150, 2000, len(ranked) - 3):
            last = (ranked[k][1], ranked[k][0])
            rest = [r for r in ranked[k + 1:] if r != ranked[k]]
            page = ordered.ordered_after(spark, path, "hot", last, 40, down)
            assert [(r._id, r.updated_at) for r in page.collect()] == rest[:40], (k, down)
    page = ordered.ordered_page(spark, path, "hot", 20, 2000)
    assert scanned_rows(page) < 1000
    assert scanned_rows(ordered.ordered_after(spark, path, "hot", (200, 5), 20)) < 1000
    assert "GreaterThanOrEqual(updated_at" in page._jdf.queryExecution().executedPlan().toString()
    ordered.write_ordered(df.limit(0), str(tmp_path / "none"))
    assert ordered.ordered_page(spark, str(tmp_path / "none"), "hot", 5).collect() == []


def test_paths_are_made(spark):
    """Missing objects are made, what is there stays, and nothing is made behind what is no object."""
    make = lambda doc, path, new="1": tuple(spark.range(1).select(C.path_or_create(F.lit(doc).cast("string"), path, F.lit(new)).alias("m")).first().m)
    assert make("{}", "a.b.c") == ('{"a":{"b":{"c":1}}}', "1")
    assert make('{"a":{"x":2}}', "a.b", '{"z":[]}') == ('{"a":{"b":{"z":[]},"x":2}}', '{"z":[]}')
    assert make('{"a":{"b":null}}', "a.b") == ('{"a":{"b":null}}', "null") and make('{"a":[1]}', "a") == ('{"a":[1]}', "[1]")
    assert make('{"a":5}', "a.b.c") == ('{"a":5}', None) and make("[1]", "a") == ("[1]", None) and make('{"a":null}', "a.b") == ('{"a":null}', None)
    assert make(None, "a") == (None, None) and make("{}", "a.b", '{"n":null}') == ('{"a":{"b":{"n":null}}}', '{"n":null}')
    assert make('{"a.b":{}}', ["a.b", "c"]) == ('{"a.b":{"c":1}}', "1")


def test_functions_are_called_once_for_equal_inputs(spark):
    """The graph's function on a table with few distinct inputs: nulls and both kinds of join give what a call in each row gives, and the calls don't grow with the rows."""
    rows = spark.range(2000).select("id", F.when(F.col("id") % 7 > 0, (F.col("id") % 5).cast("double")).alias("a"), F.when(F.col("id") % 3 > 0, (F.col("id") % 4 * 2).cast("double")).alias("b"))
    names = ["c", "d", "e"]
    f = fixture().function(["a", "b"], names, dict.fromkeys(names, "double"))
    want = {r.id: (r.a, r.b, r.s) for r in rows.withColumn("s", f(F.col("a"), F.col("b"))).collect()}
    calls = spark.sparkContext.accumulator(0)
    for most in (100, 0):
        got = latebound.call_once(rows, ["a", "b"], f, "s", max_broadcast=most)
        assert got.columns == ["id", "a", "b", "s"] and {r.id: (r.a, r.b, r.s) for r in got.collect()} == want
    counted = F.udf(lambda a, b: calls.add(1) or 1, "int")
    assert latebound.call_once(rows, ["a", "b"], counted, "s").agg(F.sum("s")).first()[0] == 2000 and calls.value == len({x[:2] for x in want.values()})


def test_balance_with_many_open_expiries(spark):
    """Debits empty the first buckets and lower the next one: against a plain loop, with expiries that are full, new, past, and none."""
    rng = random.Random(8)
    rows = [(i, rng.randrange(3), "p", rng.choice([-60, -7, 5, 9, 40]), rng.randrange(100), rng.choice([None, rng.randrange(0, 200)])) for i in range(900)]
    got = {r.wallet: r.balance for r in ledger.balance(spark.createDataFrame(rows, "id long, wallet long, product string, credits long, valid_from long, expired_at long"), 80).collect()}
    want = {}
    for w in range(3):
        open_, over = {}, 0
        for _, _, _, n, at, e in sorted((r for r in rows if r[1] == w and r[4] <= 80), key=lambda r: (r[4], r[0])):
            e = ledger.NEVER if e is None else e
            if n > 0:
                open_[e] = open_.get(e, 0) + n
                continue
            n = -n
            for x in sorted(k for k in open_ if k >= at):
                taken = min(n, open_[x])
                open_[x], n = open_[x] - taken, n - taken
            over += n
        want[w] = sum(v for e, v in open_.items() if e >= 80) - over
    assert got == want
