"""Registered queries of the document service, nested values, files and the ledger."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.functions import distance
from weftline.operators import algebra, ledger
from weftline.operators import docquery as Q
from weftline.plans.q_dispatch import query
from weftline.sources import ordered, sheets
from weftline.sources.tables import shared_dir, table


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as items: category by language, five users, every third one public."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("_id"), F.col("lang").alias("category"), (F.col("doc_id") % 5).alias("user_id"), (F.col("doc_id") % 3 == 0).alias("is_public"),
                    F.col("n_chars").alias("updated_at"), F.col("doc_id").alias("created_at"),
                    F.to_json(F.struct("source", "n_chars", F.struct(F.when(F.col("doc_id") % 4 == 0, F.col("lang")).alias("lang")).alias("meta"))).alias("data"))


_ITEMS = """SELECT doc_id AS _id, lang AS category, doc_id % 5 AS user_id, doc_id % 3 = 0 AS is_public, n_chars AS updated_at, source, n_chars,
  CASE WHEN doc_id % 4 = 0 THEN lang END AS mlang FROM documents"""


@query(f"SELECT _id FROM ({_ITEMS}) WHERE (source = 'src1' OR n_chars < 500) AND NOT (coalesce(mlang = 'en', false) OR n_chars > 5000)")
def doc_filter_and_or_nor(spark: SparkSession, sf: str) -> DataFrame:
    asked = {"$and": [{"$or": [{"source": "src1"}, {"n_chars": {"$lt": 500}}]}, {"$nor": [{"meta.lang": "en"}, {"n_chars": {"$gt": 5000}}]}]}
    return _items(spark, sf).where(Q.predicate(Q.sanitize(asked), Q.json_field("data"))).select("_id")


@query("SELECT event_id FROM events WHERE value >= 10 AND value < 90 AND event_type <> 'click' AND CAST(props->>'k' AS INTEGER) > 20")
def doc_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Comparisons of plain columns, which reach the scan, and of a JSON field."""
    rows = table(spark, sf, "events")
    plain = Q.predicate(Q.sanitize({"value": {"$gte": 10, "$lt": 90}, "event_type": {"$ne": "click"}}), Q.column_field(of=rows))
    return rows.where(plain).where(Q.predicate({"k": {"$gt": 20}}, Q.json_field("props"))).select("event_id")


@query(f"SELECT _id FROM ({_ITEMS}) WHERE source IN ('src1', 'src2', 'src3') AND (mlang IS NULL OR mlang NOT IN ('de', 'fr'))")
def doc_in_nin(spark: SparkSession, sf: str) -> DataFrame:
    asked = {"source": {"$in": ["src1", "src2", "src3"]}, "meta.lang": {"$nin": ["de", "fr"]}}
    return _items(spark, sf).where(Q.predicate(Q.sanitize(asked), Q.json_field("data"))).select("_id")


@query(f"SELECT _id FROM ({_ITEMS}) WHERE mlang IS NOT NULL")
def doc_exists(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).where(Q.predicate({"meta.lang": {"$exists": True}, "nothing": {"$exists": False}}, Q.json_field("data"))).select("_id")


@query(f"SELECT _id FROM ({_ITEMS}) WHERE regexp_matches(source, '(?i)^SRC1[0-9]$')")
def doc_regex(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).where(Q.predicate(Q.sanitize({"source": {"$regex": "^SRC1[0-9]$", "$options": "i"}}), Q.json_field("data"))).select("_id")


@query(f"SELECT count(*) FILTER (WHERE is_public) AS anon, count(*) FILTER (WHERE is_public OR user_id = 1) AS one, count(*) FILTER (WHERE user_id = 1) AS writes, count(*) AS admin FROM ({_ITEMS})")
def doc_acl_public_own(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda rule: F.count_if(rule)
    return _items(spark, sf).agg(count(Q.access(Q.User())).alias("anon"), count(Q.access(Q.User(1))).alias("one"), count(Q.access(Q.User(1), action="update")).alias("writes"),
                                 count(Q.access(Q.User(9, admin=True))).alias("admin"))


@query(f"SELECT _id, updated_at FROM ({_ITEMS}) WHERE is_public OR user_id = 2 ORDER BY updated_at DESC, _id DESC LIMIT 20 OFFSET 20")
def doc_page(spark: SparkSession, sf: str) -> DataFrame:
    return Q.query(_items(spark, sf), Q.User(2), page=2, page_size=20)[0].select("_id", "updated_at")


@query(f"SELECT _id FROM ({_ITEMS}) WHERE is_public AND _id > 100 ORDER BY _id LIMIT 25")
def doc_cursor(spark: SparkSession, sf: str) -> DataFrame:
    return Q.query(_items(spark, sf), Q.User(), sort="_id", after=100, limit=25)[0].select("_id")


@query(f"SELECT count(*) AS total FROM ({_ITEMS}) WHERE category = 'en' AND (is_public OR user_id = 3) AND n_chars >= 1000")
def doc_total(spark: SparkSession, sf: str) -> DataFrame:
    return Q.query(_items(spark, sf), Q.User(3), "en", '{"n_chars": {"$gte": 1000}, "user_id": 4}', limit=10)[1]


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 5 ELSE 1 END AS quota FROM documents")
def doc_category_config(spark: SparkSession, sf: str) -> DataFrame:
    configs = spark.createDataFrame([("en", 3), ("de", 5)], "category string, quota int")
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("category"))
    return Q.category_config(rows, configs, {"quota": 1}).select("doc_id", "quota")


@query(f"SELECT _id, CASE WHEN user_id = 2 THEN user_id ELSE -1 END AS user_id FROM ({_ITEMS})")
def doc_projection(spark: SparkSession, sf: str) -> DataFrame:
    return Q.shown(_items(spark, sf), Q.User(2), "no").select("_id", F.coalesce("user_id", F.lit(-1)).alias("user_id"))


@query("""SELECT event_id, '{"k":' || (props->>'k') || ',"list":[1,{"s":"a,null:\\"null"},[]]}' AS pruned FROM events""")
def doc_prune_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls go at every level; texts that look like them stay."""
    rest = F.lit(', "gone": null, "list": [1, null, {"s": "a,null:\\"null", "t": null}, [null]]}')
    text = F.concat(F.expr("substring(props, 1, length(props) - 1)"), rest)
    return table(spark, sf, "events").select("event_id", C.prune_nulls(text).alias("pruned"))


@query("""SELECT event_id, coalesce(CAST(m->>'k' AS INTEGER), -1) AS k, CAST(m->>'extra' AS INTEGER) AS extra, coalesce(m->>'$.deep.b', '') AS b
FROM (SELECT event_id, json_merge_patch(props, CASE WHEN event_id % 2 = 0 THEN '{"k":null,"extra":1,"deep":{"b":"x"}}' ELSE '{"extra":2}' END) AS m FROM events)""")
def doc_patch_merge(spark: SparkSession, sf: str) -> DataFrame:
    patch = F.when(F.col("event_id") % 2 == 0, F.lit('{"k":null,"extra":1,"deep":{"b":"x"}}')).otherwise(F.lit('{"extra":2}'))
    rows = table(spark, sf, "events").select("event_id", C.merge_json(F.col("props"), patch).alias("m"))
    return rows.select("event_id", F.coalesce(C.path_value(F.col("m"), "k", "int"), F.lit(-1)).alias("k"), C.path_value(F.col("m"), "extra", "int").alias("extra"), F.coalesce(C.path_value(F.col("m"), "deep.b"), F.lit("")).alias("b"))


@query("""WITH m AS (SELECT doc_id, json_merge_patch(json_object('a', json_object('source', source, 'n', n_chars, 'deep', json_object('lang', lang, 'z', 1)), 'list', json('[1,{"x":null}]')),
  CASE doc_id % 4 WHEN 0 THEN json('{"a":null,"b":{"c":{"d":null,"e":[null]}}}') WHEN 1 THEN json_object('a', json_object('deep', json_object('lang', NULL, 'new', json_object('y', doc_id))), 'list', json('[2]'))
    WHEN 2 THEN json('{"a":5,"list":{"first":{"second":null}}}') ELSE json('{"a":{"source":{"is":"object"},"n":null}}') END) AS m FROM documents)
SELECT doc_id, m->>'$.a.source' AS source, coalesce(CAST(m->>'$.a.n' AS BIGINT), -1) AS n, m->>'$.a.deep.lang' AS lang, coalesce(CAST(m->>'$.a.deep.new.y' AS BIGINT), -1) AS y, coalesce(CAST(m->>'$.a.deep.z' AS BIGINT), -1) AS z,
  m->>'$.b.c' AS c, m->>'$.list' AS list, CASE WHEN json_type(m, '$.a') = 'OBJECT' THEN NULL ELSE m->>'$.a' END AS a FROM m""")
def doc_deep_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Objects merged at any level: null against object, object against scalar and array, arrays as a whole."""
    d = table(spark, sf, "documents")
    facts = F.struct("source", F.col("n_chars").alias("n"), F.struct("lang", F.lit(1).alias("z")).alias("deep"))
    left = F.concat(F.lit('{"a":'), F.to_json(facts, {"ignoreNullFields": "false"}), F.lit(',"list":[1,{"x":null}]}'))
    case = F.col("doc_id") % 4
    right = (F.when(case == 0, F.lit('{"a":null,"b":{"c":{"d":null,"e":[null]}}}')).when(case == 1, F.format_string('{"a":{"deep":{"lang":null,"new":{"y":%d}}},"list":[2]}', "doc_id"))
             .when(case == 2, F.lit('{"a":5,"list":{"first":{"second":null}}}')).otherwise(F.lit('{"a":{"source":{"is":"object"},"n":null}}')))
    m = F.col("m")
    at = lambda path, kind="string": C.path_value(m, path, kind)
    number = lambda path: F.coalesce(at(path, "bigint"), F.lit(-1))
    part = lambda path: F.coalesce(at(path), F.to_json(F.try_variant_get(F.try_parse_json(m), f"$.{path}", "variant")))
    return d.select("doc_id", C.merge_json(left, right).alias("m")).select(
        "doc_id", part("a.source").alias("source"), number("a.n").alias("n"), at("a.deep.lang").alias("lang"), number("a.deep.new.y").alias("y"), number("a.deep.z").alias("z"),
        part("b.c").alias("c"), part("list").alias("list"), F.when(~at("a").startswith("{"), at("a")).alias("a"))


@query(f"""WITH i AS (SELECT category, updated_at, _id FROM ({_ITEMS}))
SELECT * FROM (SELECT 'newest' AS page, _id, updated_at FROM i WHERE category = 'en' ORDER BY updated_at DESC, _id DESC LIMIT 20 OFFSET 30)
UNION ALL SELECT * FROM (SELECT 'oldest', _id, updated_at FROM i WHERE category = 'en' ORDER BY updated_at, _id LIMIT 20 OFFSET 10)
UNION ALL SELECT * FROM (SELECT 'behind', _id, updated_at FROM i WHERE category = 'de' AND (updated_at > 500 OR (updated_at = 500 AND _id > 10)) ORDER BY updated_at, _id LIMIT 20)""")
def doc_ordered_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by offset and by cursor from documents that are laid out by category and time, each read by its bounds."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    ordered.write_ordered(_items(spark, sf), path)
    pages = {"newest": ordered.ordered_page(spark, path, "en", 20, 30, descending=True), "oldest": ordered.ordered_page(spark, path, "en", 20, 10),
             "behind": ordered.ordered_after(spark, path, "de", (500, 10), 20)}
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("page"), "_id", "updated_at") for name, rows in pages.items()])


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN NULL WHEN doc_id % 4 = 0 THEN lang ELSE 'new ' || source END AS there, CASE doc_id % 4 WHEN 2 THEN 'text' END AS meta, n_chars AS kept FROM documents""")
def nested_get_or_create(spark: SparkSession, sf: str) -> DataFrame:
    """The value at a path, made where it is missing: in an object without the key, without the object, behind a text."""
    d, case = table(spark, sf, "documents"), F.col("doc_id") % 4
    meta = F.when(case == 0, F.concat(F.lit(',"meta":{"lang":"'), "lang", F.lit('"}'))).when(case == 1, F.lit(',"meta":{}')).when(case == 2, F.lit(',"meta":"text"')).otherwise(F.lit(""))
    data = F.concat(F.lit('{"n":'), F.col("n_chars").cast("string"), meta, F.lit("}"))
    made = d.select("doc_id", C.path_or_create(data, "meta.lang", F.concat(F.lit('"new '), "source", F.lit('"'))).alias("m"))
    text = C.path_value(F.col("m.document"), "meta")
    return made.select("doc_id", C.path_value(F.col("m.document"), "meta.lang").alias("there"), F.when(~text.startswith("{"), text).alias("meta"), C.path_value(F.col("m.document"), "n", "bigint").alias("kept"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sheet_nation(spark: SparkSession, sf: str) -> DataFrame:
    """Nations written as a workbook and read back."""
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return _through_sheets(spark, rows)


@query("""SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last,
  CAST(sum(o_orderkey % 1000) AS BIGINT) AS keys FROM orders GROUP BY 1""")
def sheet_orders(spark: SparkSession, sf: str) -> DataFrame:
    """All orders written as workbooks, read back in ranges of rows and added up: numbers, times and texts."""
    read = _through_sheets(spark, table(spark, sf, "orders"))
    day = F.col("o_orderdate").cast("date")
    return read.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min(day).cast("string").alias("first"), F.max(day).cast("string").alias("last"),
                                               F.sum(F.col("o_orderkey") % 1000).alias("keys"))


def _through_sheets(spark: SparkSession, rows: DataFrame) -> DataFrame:
    sheets.register(spark)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    rows.write.format("sheets").mode("append").save(path)
    return spark.read.format("sheets").schema(rows.schema).load(path)


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    ref = lambda n: F.concat(F.lit('{"$ref": "/files/'), n, F.lit('"}'))
    name = lambda x: F.concat(F.lit("f"), (F.col("page_id") % x).cast("string"))
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit('{"a": '), ref(name(7)), F.lit(', "b": ['), ref(name(5)), F.lit("]}")).alias("data"),
                                            F.array(F.lit("f0"), name(7)).alias("files"))


@query("SELECT page_id, CASE WHEN page_id % 7 = page_id % 5 THEN 'f' || (page_id % 7) ELSE 'f' || least(page_id % 7, page_id % 5) || ',f' || greatest(page_id % 7, page_id % 5) END AS refs FROM pages")
def doc_file_refs(spark: SparkSession, sf: str) -> DataFrame:
    return _refs(spark, sf).select("page_id", F.array_join(Q.file_refs(F.col("data")), ",").alias("refs"))


@query("""SELECT page_id, CASE WHEN page_id % 5 NOT IN (0, page_id % 7) THEN 'f' || (page_id % 5) ELSE '' END AS missing,
  CASE WHEN page_id % 7 <> 0 AND page_id % 5 <> 0 THEN 'f0' ELSE '' END AS orphan FROM pages""")
def doc_ref_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = _refs(spark, sf).withColumn("e", Q.ref_errors(Q.file_refs(F.col("data")), F.array_distinct("files")))
    return rows.select("page_id", F.array_join("e.missing", ",").alias("missing"), F.array_join("e.orphan", ",").alias("orphan"))


@query("SELECT event_id, 'k' AS path, props->>'k' AS value FROM events")
def nested_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return C.stack_nested(table(spark, sf, "events").select("event_id", "props"), "props", 2).select("event_id", F.array_join("path", "/").alias("path"), "value")


@query("SELECT event_id, user_id AS a, CASE WHEN event_id % 2 = 0 THEN event_id ELSE user_id END AS b FROM events")
def nested_merge(spark: SparkSession, sf: str) -> DataFrame:
    left = F.create_map(F.lit("a"), F.col("user_id"), F.lit("b"), F.col("user_id"))
    right = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("b"), F.col("event_id"))).otherwise(F.expr("cast(map() as map<string, bigint>)"))
    rows = table(spark, sf, "events").select("event_id", C.combine_maps(left, right).alias("m"))
    return rows.select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("SELECT event_id, user_id AS a FROM events")
def nested_select(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(F.lit("a"), F.col("user_id"), F.lit("b"), F.col("event_id"))
    return table(spark, sf, "events").select("event_id", C.select_keys(m, ["a"], "values")[0].alias("a"))


@query("SELECT event_id, user_id AS x FROM events")
def nested_rename(spark: SparkSession, sf: str) -> DataFrame:
    m = C.rename_keys(F.create_map(F.lit("a"), F.col("user_id"), F.lit("b"), F.col("event_id")), {"a": "x"})
    return table(spark, sf, "events").select("event_id", m["x"].alias("x"))


@query("SELECT event_id, true AS has_k, false AS has_z FROM events")
def nested_exists(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", C.path_exists(F.col("props"), "k").alias("has_k"), C.path_exists(F.col("props"), "z.y").alias("has_z"))


@query("SELECT user_id, CAST(min(event_id) FILTER (WHERE value = top) AS BIGINT) AS event_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS top FROM events) GROUP BY user_id")
def distance_order(spark: SparkSession, sf: str) -> DataFrame:
    """Two-part distances are compared by their first part, then by the second."""
    d = distance.sub(distance.pair(F.lit(0.0) - F.col("value"), F.col("event_id").cast("double")), 0)
    rows = table(spark, sf, "events").select("user_id", d.alias("d"))
    return rows.groupBy("user_id").agg(F.min("d").alias("d")).select("user_id", F.col("d.num").cast("long").alias("event_id"))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as ledger entries: every third one is a debit, every tenth never expires."""
    o = table(spark, sf, "orders")
    day = F.datediff(F.col("o_orderdate"), F.lit("1992-01-01"))
    amount = F.floor(F.col("o_totalprice") / 1000).cast("long")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("wallet"), F.col("o_orderpriority").alias("product"),
                    F.when(F.col("o_orderkey") % 3 == 0, -amount).otherwise(amount).alias("credits"), day.cast("long").alias("valid_from"),
                    F.when(F.col("o_orderkey") % 10 != 0, (day + 30 * (F.col("o_orderkey") % 10)).cast("long")).alias("expired_at"))


_ENTRIES = """SELECT o_orderkey AS id, o_custkey % 100 AS wallet, o_orderpriority AS product,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN -floor(o_totalprice / 1000) ELSE floor(o_totalprice / 1000) END AS BIGINT) AS credits,
  CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS valid_from,
  CASE WHEN o_orderkey % 10 <> 0 THEN CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + 30 * (o_orderkey % 10) AS BIGINT) END AS expired_at FROM orders"""


_OPEN = "CASE WHEN y.e >= valid_from AND y.v > 0 THEN y.v ELSE 0 END"


@query(f"""WITH RECURSIVE x AS (SELECT *, coalesce(expired_at, 4611686018427387904) AS e, row_number() OVER (PARTITION BY wallet, product ORDER BY valid_from, id) AS k
  FROM ({_ENTRIES}) WHERE valid_from <= 1500 AND credits <> 0),
f AS (SELECT wallet, product, 0::BIGINT AS k, []::STRUCT(e BIGINT, v BIGINT)[] AS b FROM x GROUP BY ALL
  UNION ALL SELECT wallet, product, k, CASE WHEN credits > 0 THEN list_sort(list_append(b, {{'e': e, 'v': credits}})) ELSE
      list_append(list_transform(b, lambda y, i: {{'e': y.e, 'v': y.v - greatest(0, least({_OPEN}, -credits - coalesce(list_sum(list_transform(b[1:i - 1], lambda y: {_OPEN})), 0)::BIGINT))}}),
                  {{'e': 4611686018427387904, 'v': -greatest(0, -credits - coalesce(list_sum(list_transform(b, lambda y: {_OPEN})), 0)::BIGINT)}}) END
    FROM (SELECT x.*, f.b FROM f JOIN x ON x.wallet = f.wallet AND x.product = f.product AND x.k = f.k + 1))
SELECT wallet, product, CAST(coalesce(list_sum(list_transform(b, lambda y: CASE WHEN y.e >= 1500 THEN y.v ELSE 0 END)), 0) AS BIGINT) AS balance
FROM (SELECT *, max(k) OVER (PARTITION BY wallet, product) AS last FROM f) WHERE k = last""")
def ledger_balance_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Balances on day 1500: an ordered fold over each product's credits and debits of a wallet."""
    return ledger.balance(_entries(spark, sf), 1500)


@query(f"SELECT id, CASE WHEN expired_at IS NULL OR expired_at > 1500 THEN 1500 ELSE expired_at END AS expired_at FROM ({_ENTRIES}) WHERE valid_from <= 1500")
def ledger_refund(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.refund(_entries(spark, sf), F.lit(1500).cast("long")).select("id", "expired_at")


@query(f"SELECT wallet, product, arg_max(id, (valid_from, id)) AS id FROM ({_ENTRIES}) WHERE valid_from < 1200 GROUP BY wallet, product")
def ledger_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = _entries(spark, sf).select("wallet", "product", F.struct("valid_from", "id").alias("at"), "valid_from").where("valid_from < 1200")
    return Q.latest(rows.select("wallet", "product", "at"), ["wallet", "product"], "at").select("wallet", "product", F.col("at.id").alias("id"))


@query("""SELECT o_orderkey, a AS interval_from, b AS interval_to FROM (
  SELECT o_orderkey, d AS a, lead(d) OVER (PARTITION BY o_orderkey ORDER BY d) AS b FROM (
    SELECT o_orderkey, d0 + to_months(CAST(i AS INTEGER)) AS d, d0 FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS d0 FROM orders), range(0, 7) AS r(i))
  WHERE day(d) = day(d0)) WHERE b IS NOT NULL""")
def ledger_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Half a year of monthly intervals for each order; months that lack the day are skipped."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.to_timestamp_ntz(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("a"))
    rows = rows.withColumn("b", F.col("a") + F.make_interval(months=F.lit(6)))
    return ledger.intervals(rows, "a", "b", months=1).select("o_orderkey", "interval_from", "interval_to")



@query("""SELECT p_partkey, coalesce(last_unit, 0) AS last_unit, CAST(least(p_size, coalesce(last_unit, p_size)) - before AS BIGINT) AS units,
  CAST((least(p_size, coalesce(last_unit, p_size)) - before) * per_unit + flat_fee AS BIGINT) AS amount
FROM part, (VALUES (10, 0, 5, 100), (25, 10, 4, 50), (NULL, 25, 3, 0)) AS t(last_unit, before, per_unit, flat_fee) WHERE p_size > before""")
def ledger_tiered(spark: SparkSession, sf: str) -> DataFrame:
    tiers = spark.createDataFrame([("p", 10, 5, 100), ("p", 25, 4, 50), ("p", None, 3, 0)], "product string, last_unit int, per_unit int, flat_fee int")
    lines = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("quantity"), F.lit("p").alias("product"))
    return ledger.tiered(lines, tiers).select("p_partkey", F.coalesce("last_unit", F.lit(0)).alias("last_unit"), F.col("units").cast("long").alias("units"), F.col("amount").cast("long").alias("amount"))


@query("""WITH l AS (SELECT o_orderkey, o_orderpriority AS product, floor(o_totalprice) * CASE o_orderpriority WHEN '1-URGENT' THEN 0.72::DOUBLE ELSE 1.0::DOUBLE END AS net,
    CASE o_orderpriority WHEN '1-URGENT' THEN 500000 ELSE 0 END AS flat FROM orders),
b AS (SELECT *, coalesce(sum(net) OVER (PARTITION BY product ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT o_orderkey, CAST(ceil(round(greatest(net - greatest(flat - before, 0), 0), 6)) AS BIGINT) AS net FROM b""")
def ledger_discounts(spark: SparkSession, sf: str) -> DataFrame:
    """Two percentages multiply, two flat discounts are one budget."""
    rules = spark.createDataFrame([("1-URGENT", 20.0, None), ("1-URGENT", 10.0, None), ("1-URGENT", None, 200000), ("1-URGENT", None, 300000)], "product string, percent double, flat int")
    lines = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("product"), F.floor("o_totalprice").cast("double").alias("amount"))
    return ledger.discounted(lines, rules, order="o_orderkey").select("o_orderkey", "net")


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 3)")
def ledger_member_semi(spark: SparkSession, sf: str) -> DataFrame:
    wallets = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("user_id"))
    members = table(spark, sf, "orders").select(F.col("o_custkey").alias("wallet_id"), (F.col("o_orderkey") % 50).alias("user_id"))
    return ledger.accessible(wallets, members, 3).select("id")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def ledger_idempotent_anti(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    return ledger.new_entries(table(spark, sf, "orders").select("o_custkey"), known, "o_custkey")


@query("SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS first_file, CAST(count(*) OVER (PARTITION BY text) AS BIGINT) AS copies FROM documents")
def file_dedup_hash(spark: SparkSession, sf: str) -> DataFrame:
    return Q.deduplicate_files(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "first_file", "copies")


@query("SELECT doc_id, trim(regexp_extract(trim(text), '^([^.\\n]*\\.?)', 1)) AS summary FROM documents")
def doc_summary_first_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", algebra.summary(F.col("text")).alias("summary"))


@query("""SELECT event_id, event_id % 3 = 0 AND value > 50 AS number, event_id % 3 = 1 AND event_type > 'm' AS text, event_id % 3 = 2 AND value > 50 AS item, event_id % 3 = 2 AND value <= 50 AS inner_item,
  event_id % 3 <> 0 OR value <> 7 AS differs FROM events""")
def doc_mixed_types(spark: SparkSession, sf: str) -> DataFrame:
    """A field that holds a number, a text or an array: tests hold within a type, and for arrays if they hold for an element."""
    e = table(spark, sf, "events")
    part = lambda c: F.to_json(F.struct(c.alias("x")))
    some = F.when(F.col("event_id") % 3 == 0, part(F.col("value"))).when(F.col("event_id") % 3 == 1, part(F.col("event_type")))
    held = F.when(F.col("value") > 50, part(F.array(F.lit(1.0), F.col("value")))).otherwise(part(F.array(F.struct(F.col("event_type").alias("y")))))
    e = e.withColumn("data", some.otherwise(held))
    is_ = lambda q: Q.predicate(Q.sanitize(q), Q.json_field("data"))
    third = F.col("event_id") % 3
    return e.select("event_id", ((third == 0) & is_({"x": {"$gt": 50}})).alias("number"), is_({"x": {"$gt": "m"}}).alias("text"), ((third == 2) & is_({"x": {"$gt": 50}})).alias("item"),
                    is_({"x.0.y": {"$exists": True}, "x.y": {"$regex": "."}}).alias("inner_item"), is_({"x": {"$ne": 7}}).alias("differs"))


@query(f"""SELECT (r - 1) // 40 + 1 AS page, CAST(count(*) AS BIGINT) AS n, min(_id) AS next_after FROM (SELECT _id, row_number() OVER (ORDER BY _id DESC) AS r FROM ({_ITEMS}) WHERE is_public OR user_id = 2) GROUP BY 1""")
def doc_cursor_walk(spark: SparkSession, sf: str) -> DataFrame:
    """All pages that a descending cursor walks through."""
    return Q.cursor_walk(_items(spark, sf).where(Q.access(Q.User(2))), 40, "-_id")


_TREE = {"$defs": {"node": {"type": "object", "required": ["n"], "properties": {"n": {"type": "number", "exclusiveMaximum": 95}, "kids": {"type": "array", "uniqueItems": True, "items": {"$ref": "#/$defs/node"}}},
                            "patternProperties": {"^x_": {"oneOf": [{"type": "integer", "multipleOf": 5}, {"type": "integer", "minimum": 40}]}}, "additionalProperties": False}},
         "$ref": "#/$defs/node", "if": {"properties": {"n": {"minimum": 50}}}, "then": {"required": ["kids"]}, "else": {"maxProperties": 2}}


@query("""SELECT event_id, value < 95 AND (value < 50 OR event_id % 2 = 0) AND NOT (event_id % 2 = 0 AND value < 50 AND k % 3 = 0) AND (event_id % 2 = 1 OR user_id % 4 <> 0) AND (k % 3 <> 0 OR ((k % 5 = 0) <> (k >= 40))) AS ok
FROM (SELECT *, CAST(props->>'k' AS INTEGER) AS k FROM events)""")
def doc_validate_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Trees against a recursive schema with alternatives, conditions, patterns of keys and unique elements."""
    e = table(spark, sf, "events").withColumn("k", C.path_value(F.col("props"), "k", "int"))
    leaf = lambda n: F.struct(n.alias("n"))
    twice = F.col("user_id") % 4 == 0  # two equal children
    kids = F.array(F.struct(F.lit(1).alias("n"), F.array(leaf(F.lit(2)), F.when(twice, leaf(F.lit(2))).otherwise(leaf(F.lit(3)))).alias("kids")), F.struct(F.lit(4).alias("n"), F.lit(None).cast("array<struct<n: int>>").alias("kids")))
    doc = F.to_json(F.struct(F.col("value").alias("n"), F.when(F.col("event_id") % 2 == 0, kids).alias("kids"), F.when(F.col("k") % 3 == 0, F.col("k")).alias("x_k")))
    return e.select("event_id", Q.valid_documents(doc, F.lit("tree"), {"tree": _TREE}).alias("ok"))
