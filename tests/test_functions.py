"""Functions on maps, nested values and two-part distances; graph algebra; pricing."""

from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.functions import distance
from weftline.operators import algebra, docquery, ledger


def value(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def test_maps(spark):
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    assert value(spark, C.combine_maps(m, F.create_map(F.lit("b"), F.lit(3), F.lit("c"), F.lit(4)))) == {"a": 1, "b": 3, "c": 4}
    assert value(spark, C.rename_keys(m, {"a": "x"})) == {"x": 1, "b": 2}
    assert value(spark, C.select_keys(m, ["b", "a"], "values")) == [2, 1] and value(spark, C.select_keys(m, ["z"])) is None
    assert value(spark, C.select_keys(m, ["a", "z"], allow_missing=True)) == {"a": 1}
    assert value(spark, C.name_values(["p", "q"], F.array(F.lit(1), F.lit(2)))).asDict() == {"p": 1, "q": 2}
    assert value(spark, C.summation(F.lit(1), F.lit(2), F.lit(3))) == 6 and value(spark, C.replicate(F.lit(1), 3)) == [1, 1, 1]
    assert value(spark, C.bypass(F.lit(1), F.lit(2)).getField("col1")) == 1


def test_nested(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": {"c": 1}}, "d": null}'), (2, "no json")], "id int, doc string")
    got = {(r.id, "/".join(r.path), r.value) for r in C.stack_nested(rows, "doc", 2).collect()}
    assert got == {(1, "a/b", '{"c":1}'), (1, "d", "null")}
    merged = rows.limit(1).select(C.merge_json(F.lit('{"a":{"b":1,"c":2},"x":1}'), F.lit('{"a":{"b":{"z":1},"c":null},"y":[1]}')).alias("m")).collect()[0].m
    assert merged == '{"a":{"b":{"z":1}},"x":1,"y":[1]}'
    exists = rows.select("id", C.path_exists(F.col("doc"), "d").alias("d"), C.path_exists(F.col("doc"), "a.z").alias("z")).collect()
    assert {(r.id, r.d, r.z) for r in exists} == {(1, True, False), (2, False, False)}
    assert value(spark, C.prune_nulls(F.lit('{"a":null,"b":1}'))) == '{"b":1}'


def test_nulls_are_pruned_at_every_level(spark):
    import json

    def plain(x):
        return {k: plain(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [plain(v) for v in x if v is not None] if isinstance(x, list) else x

    pruned = lambda text: value(spark, C.prune_nulls(F.lit(text)))
    for given in ({"a": [1, None, 3], "b": {"c": None, "d": [None, {"e": None, "f": 2}]}, "g": [[None, 1], None], "z": 9}, {"b": None, "m": {"x": None, "y": [None]}}, [1, None], [None],
                  {"s": 'null, "x":null,', "t\\": None, "null": "a\\", "u": [",null]", None, "é:null"]}, {"only": None}, "null", 5):
        assert json.loads(pruned(json.dumps(given))) == plain(given)
    assert value(spark, C.prune_nulls(F.lit(None).cast("string"))) is None and value(spark, C.prune_nulls(F.lit("no json"))) is None


def test_files_without_content_are_kept(spark):
    rows = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "id int, data string")
    assert {r.id: (r.first_file, r.copies) for r in docquery.deduplicate_files(rows, "data", "id").collect()} == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


def test_distances(spark):
    a, b = distance.pair(1, 2), distance.pair(0, 100)
    assert value(spark, a > b) and value(spark, distance.add(a, 3)).asDict() == {"inf": 1, "num": 5} and value(spark, distance.mul(a, 2)).asDict() == {"inf": 2, "num": 4}


def test_far_nodes_are_an_error(spark):
    import pytest

    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(5)], "src string, dst string")
    assert algebra.reachable(chain, spark.createDataFrame([("0",)], "id string"), max_steps=6).count() == 6
    with pytest.raises(RuntimeError):
        algebra.reachable(chain, spark.createDataFrame([("0",)], "id string"), max_steps=3)


def test_shrunk_needs_all_inputs(spark):
    nodes = spark.createDataFrame([(x, "formula" if x[0] == "f" else "data") for x in ("a", "m", "x", "y", "z", "f1", "f2", "f3", "f4")], "id string, type string")
    edges = spark.createDataFrame([("a", "f1"), ("m", "f1"), ("f1", "x"), ("x", "f2"), ("f2", "y"), ("a", "f3"), ("f3", "z"), ("z", "f4"), ("f4", "z")], "src string, dst string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert algebra.shrunk(nodes, edges, ids("a"), ids("y"))[0].count() == 0  # f1 lacks m, so f2 lacks x
    assert {r.id for r in algebra.shrunk(nodes, edges, ids("a", "m"), ids("y"))[0].collect()} == {"a", "m", "f1", "x", "f2", "y"}
    links = spark.createDataFrame([("a", "m<x"), ("m<x", "m/x"), ("m/x", "m/f"), ("m/f", "m/y"), ("m/y", "m>b"), ("m>b", "b"), ("c", "m<z"), ("m<z", "m/z"), ("m/w", "m>d"), ("m>d", "d")], "src string, dst string")
    assert {r.dst for r in algebra.prune_models(links).collect()} == {"m<x", "m/x", "m/f", "m/y", "m>b", "b"}


def test_algebra(spark):
    edges = spark.createDataFrame([("a", "f"), ("f", "b"), ("b", "g"), ("g", "a")], "src string, dst string")
    source = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.step for r in algebra.reachable(edges, source).collect()} == {"a": 0, "f": 1, "b": 2, "g": 3}
    assert {r.id for r in algebra.reachable(edges, source, blockers=spark.createDataFrame([("f",)], "id string")).collect()} == {"a", "f"}
    assert value(spark, algebra.summary(F.lit(" First one. Second."))) == "First one." and value(spark, algebra.documented(F.lit("x\n:return: the value\n"), "return")) == "the value"


def test_prices(spark):
    tiers = spark.createDataFrame([("p", 10, 1, 0), ("p", 20, 1, 0), ("p", None, 1, 0)], "product string, last_unit int, per_unit int, flat_fee int")
    lines = spark.createDataFrame([(1, "p", 25), (2, "p", 10)], "line int, product string, quantity int")
    got = sorted((r.line, r.units) for r in ledger.tiered(lines, tiers).collect())
    assert got == [(1, 5), (1, 10), (1, 10), (2, 10)]
    assert [(r.line, r.units) for r in ledger.tiered(lines, tiers, volume=True).where("line = 2").collect()] == [(2, 10)]
    months = spark.sql("select timestamp_ntz'2024-01-31' as a, timestamp_ntz'2024-07-31' as b")
    assert [str(r.interval_to)[:10] for r in ledger.intervals(months, "a", "b", months=1).collect()] == ["2024-03-31", "2024-05-31", "2024-07-31"]


def test_files(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id int, data string")
    assert {r.id: (r.first_file, r.copies) for r in docquery.deduplicate_files(rows, "data", "id").collect()} == {1: (1, 2), 2: (2, 1), 3: (1, 2)}
    assert value(spark, docquery.valid_name(F.lit("a.txt"))) and not value(spark, docquery.valid_name(F.lit("../a")))
