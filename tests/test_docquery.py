"""Limits, access and paging of the document service."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import docquery as Q


def docs(spark):
    return spark.createDataFrame([(1, "docs", '{"title": "a", "n": null}', 1, False, 1, 1), (2, "docs", '{"title": "b"}', 1, True, 2, 2)],
                                 "_id int, category string, data string, user_id int, is_public boolean, created_at int, updated_at int")


def total(spark, user, **how):
    return Q.query(docs(spark), user, "docs", **how)[1].collect()[0].total


def test_access(spark):
    assert [total(spark, u) for u in (Q.User(), Q.User(2), Q.User(1), Q.User(9, admin=True))] == [1, 1, 2, 2]


def test_protected_fields_are_dropped(spark):
    assert total(spark, Q.User(1), where={"user_id": 7, "_id": 5}) == 2


def test_exists_and_null(spark):
    assert total(spark, Q.User(1), where={"n": {"$exists": True}}) == 1
    assert total(spark, Q.User(1), where={"n": None}) == 2
    assert total(spark, Q.User(1), where={"missing": {"$ne": 3}}) == 2


def test_rejected():
    deep = {"a": 1}
    for _ in range(12):
        deep = {"$and": [deep]}
    for bad in (deep, {f"k{i}": 1 for i in range(250)}, {"a": {"$regex": "x" * 200}}, {"a": {"$where": "1"}}):
        with pytest.raises(Q.QueryError):
            Q.sanitize(bad)


def test_paging(spark):
    assert Q.page_bounds({"limit": 1000, "offset": -3}) == (200, 0) and Q.page_bounds({"page": 2, "page_size": 2}) == (2, 2)
    with pytest.raises(Q.QueryError):
        Q.sort_columns("title")
    with pytest.raises(Q.QueryError):
        Q.query(docs(spark), Q.User(1), after=1)
    assert [r._id for r in Q.query(docs(spark), Q.User(1), sort="-_id", after=2)[0].collect()] == [1]
    assert Q.next_page(5, 2, 2) == 4 and Q.next_page(4, 2, 2) is None


def test_malformed_filters_are_query_errors(spark):
    for bad in ({"$and": []}, {"$or": 3}, {"a": {"$in": 1}}, {"a": {"$regex": "("}}, {"$eq": 3}, {"a": {"$gt": {"y": 1}}}, {"a": {"$and": [{}]}}):
        with pytest.raises(Q.QueryError):
            Q.query(docs(spark), Q.User(1), "docs", where=bad)


def test_values_of_documents(spark):
    rows = spark.createDataFrame([(1, '{"c": {"y": 1, "x": [1, 2]}, "n": 2.5, "big": 9007199254740993}'), (2, '{"c": 1, "n": 2}')], "_id int, data string")
    found = lambda q: [r._id for r in rows.where(Q.predicate(Q.sanitize(q), Q.json_field("data"))).collect()]
    assert found({"c": {"x": [1, 2], "y": 1}}) == [1] and found({"n": {"$gt": 2}}) == [1] and found({"n": {"$in": [2, "x"]}}) == [2]
    assert found({"big": 9007199254740992}) == [] and found({"big": 9007199254740993}) == [1] and found({"n": 2.5}) == [1]


def test_schemas(spark):
    rows = spark.createDataFrame([(1, "a", '{"t": "x", "n": [1, 2]}'), (2, "a", '{"n": [1, "2"]}'), (3, "b", '{"t": 5}'), (4, "b", "no json"), (5, "a", '{"t": "long", "n": [], "z": 1}')], "id int, kind string, data string")
    schema = {"type": "object", "required": ["t"], "properties": {"t": {"type": "string", "maxLength": 3}, "n": {"type": "array", "items": {"type": "integer"}}}, "additionalProperties": False}
    got = rows.select("id", Q.valid_documents(rows.data, rows.kind, {"a": schema}, {"properties": {"t": {"type": "number"}}}).alias("ok")).collect()
    assert {r.id: r.ok for r in got} == {1: True, 2: False, 3: True, 4: False, 5: False}
    with pytest.raises(Q.QueryError):
        Q.valid(rows.data, {"format": "date"})


def test_columns_are_compared_within_their_types(spark):
    from datetime import date

    rows = [(1, 1e300, "7", True, date(2020, 1, 2)), (1 << 62, -1.5, "10", False, date(2021, 1, 1)), (None, None, None, None, None), (-3, float("inf"), "x", True, date(1999, 1, 1))]
    df = spark.createDataFrame(rows, "n long, d double, s string, b boolean, t date")
    numbers = [5, 2.5, 1, 1.0, 1 << 62, (1 << 62) + 1, 10**30, -(10**30), 1e300, float("inf"), 0, -3]
    ops = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b, "$eq": lambda a, b: a == b}
    found, want = [], []
    for at, c in enumerate("ndsb"):
        for v in [*numbers, "7", "z", True, None]:
            for op, test in ops.items():
                def passes(x):
                    if v is None:
                        return op == "$eq" and x is None
                    same = (type(x) in (int, float) and type(v) in (int, float)) or type(x) is type(v)
                    return x is not None and same and test(x, v)

                found.append(F.count_if(Q.predicate({c: {op: v}}, Q.column_field(of=df))))
                want.append(((c, op, v), sum(passes(r[at]) for r in rows)))
    got = [n for at in range(0, len(found), 70) for n in df.agg(*found[at : at + 70]).first()]
    assert [(k, n) for (k, _), n in zip(want, got)] == want
    assert df.where(Q.predicate({"t": {"$gte": "2020-01-02"}, "s": {"$regex": "^[0-9]"}}, Q.column_field(of=df))).count() == 2
    assert df.where(Q.predicate({"n": {"$regex": "1"}}, Q.column_field(of=df))).count() == 0


def test_comparisons_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as double) as v", "cast(id as string) as s").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for asked, pushed, n in (({"id": {"$gt": 2.5}}, "GreaterThanOrEqual(id,3)", 7), ({"v": {"$lte": 8}}, "LessThanOrEqual(v,8.0)", 9), ({"s": "7"}, "EqualTo(s,7)", 1)):
        found = df.where(Q.predicate(asked, Q.column_field(of=df)))
        assert pushed in found._jdf.queryExecution().executedPlan().toString() and found.count() == n


@pytest.mark.parametrize("query,want", [
    ({"a": 5}, [0, 3]), ({"a": "5"}, [1]), ({"a": {"$gt": 4}}, [0, 3]), ({"a": {"$ne": 5}}, [1, 2, 4, 5, 6, 7]), ({"a": None}, [2, 6, 7]), ({"a": {"$exists": False}}, [6, 7]), ({"a.1": 5}, [3]), ({"a.b": 2}, [4, 5]),
    ({"a.0.b": 2}, [5]), ({"a": {"$in": [5, None]}}, [0, 2, 3, 6, 7]), ({"a": {"$nin": [5, "5"]}}, [2, 4, 5, 6, 7]), ({"a": {"$regex": "^5"}}, [1]), ({"a": [1, 5]}, [3]), ({"x'y": True}, [6])])
def test_documents_as_a_store_reads_them(spark, query, want):
    docs = ['{"a": 5}', '{"a": "5"}', '{"a": null}', '{"a": [1, 5]}', '{"a": {"b": 2}}', '{"a": [{"b": 2}, {"c": 1}]}', '{"x\'y": true}', "no json"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, data string")
    assert [r.i for r in df.where(Q.predicate(Q.sanitize(query), Q.json_field("data"))).orderBy("i").collect()] == want


def test_required_keys_with_dots(spark):
    df = spark.createDataFrame([('{"a.b": {"c\'d": 1}}',), ('{"a": {"b": 1}}',)], "data string")
    schema = {"required": ["a.b"], "properties": {"a.b": {"required": ["c'd"]}}}
    assert [r.ok for r in df.select(Q.valid_documents(F.col("data"), F.lit("x"), {"x": schema}).alias("ok")).collect()] == [True, False]


@pytest.mark.parametrize("sort", ["_id", "-_id"])
def test_cursors_walk_over_all_pages(spark, sort):
    docs = spark.range(1, 24).select(F.col("id").alias("_id"), F.lit("c").alias("category"), F.lit("{}").alias("data"), F.lit(1).alias("user_id"), F.lit(True).alias("is_public"))
    seen, after, ends = [], None, []
    while True:
        page = Q.query(docs, Q.User(), sort=sort, after=after, limit=5)[0] if after is not None else Q.query(docs, Q.User(), sort=sort, limit=5)[0]
        ids = [r._id for r in page.collect()]
        after = Q.next_cursor(page, sort).first().next_after
        if not ids:
            assert after is None
            break
        assert after == ids[-1]
        seen, ends = seen + ids, ends + [(len(ends) + 1, len(ids), after)]
    assert seen == sorted(range(1, 24), reverse=sort == "-_id")
    assert sorted(map(tuple, Q.cursor_walk(docs, 5, sort).collect())) == ends


def test_schemas_that_are_recursive(spark):
    """References are written out to a depth; a deeper document ends the query instead of being judged by a part of the rules."""
    schema = {"$defs": {"list": {"type": "object", "properties": {"next": {"$ref": "#/$defs/list"}, "v": {"type": "integer"}}, "additionalProperties": False}}, "$ref": "#/$defs/list"}
    nested = lambda n, end: '{"next":' * n + end + "}" * n
    ask = lambda text: spark.createDataFrame([(text,)], "data string").select(Q.valid_documents(F.col("data"), F.lit("x"), {"x": schema}).alias("ok")).first().ok
    assert ask(nested(4, '{"v":1}')) and not ask(nested(4, '{"v":"1"}')) and not ask(nested(3, '{"w":1}'))
    with pytest.raises(Exception, match="nested deeper"):
        ask(nested(9, '{"v":1}'))
    with pytest.raises(Q.QueryError):
        Q.valid(F.lit(None), {"$ref": "#/$defs/none"})
    with pytest.raises(Q.QueryError):
        Q.valid(F.lit(None), {"$ref": "http://elsewhere"})


@pytest.mark.parametrize("rule,good,bad", [
    ({"oneOf": [{"minimum": 2}, {"maximum": 5}]}, ["1", "9"], ["3"]), ({"contains": {"const": 2}}, ["[1,2]"], ["[1]", "[]"]), ({"uniqueItems": True}, ["[1,2]", '[{"a":1},{"a":2}]'], ['[{"a":1},{"a":1}]']),
    ({"exclusiveMinimum": 2, "multipleOf": 0.5}, ["2.5"], ["2", "2.6"]), ({"minProperties": 1, "maxProperties": 2}, ['{"a":1}'], ["{}", '{"a":1,"b":2,"c":3}']),
    ({"patternProperties": {"^n": {"type": "number"}}, "additionalProperties": {"type": "string"}}, ['{"n1":1,"s":"x"}'], ['{"n1":"x"}', '{"s":1}']),
    ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"type": "null"}}, ['"ab"', "null"], ['"a"', "1"]), ({"properties": {"a": False}}, ['{"b":1}'], ['{"a":1}']), ({"anyOf": [True, False]}, ["1"], [])])
def test_rules_of_schemas(spark, rule, good, bad):
    df = spark.createDataFrame([(x,) for x in good + bad], "data string")
    assert [r.ok for r in df.select(Q.valid_documents(F.col("data"), F.lit("x"), {"x": rule}).alias("ok")).collect()] == [True] * len(good) + [False] * len(bad)
