"""Registered queries of single functions: graph tables, validation, access by role, pricing, folds with domains, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.functions import distance
from weftline.operators import algebra, fold, ledger
from weftline.operators import docquery as Q
from weftline.plans.graph import FormulaGraph
from weftline.plans.q_dispatch import query, rounded
from weftline.plans.q_docs import _ENTRIES, _ITEMS, _entries, _items
from weftline.sources import graphs
from weftline.sources.tables import table
from weftline.streaming.models import windowed


def _geography(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nations, suppliers and customers as formulas: each needs its region or nation, a customer its nation and a supplier."""
    n, s, c = (table(spark, sf, t) for t in ("nation", "supplier", "customer"))
    name = lambda kind, key: F.concat(F.lit(f"{kind} "), key.cast("string"))
    edges = []
    for kind, out, rows, key, needs in (("nat", "N", n, "n_nationkey", [("R", F.col("n_regionkey"))]), ("sup", "S", s, "s_suppkey", [("N", F.col("s_nationkey"))]),
                                        ("cust", "C", c, "c_custkey", [("N", F.col("c_nationkey")), ("S", F.col("c_custkey") % 10 + 1)])):
        edges += [rows.select(name(k, v).alias("src"), name(kind, F.col(key)).alias("dst")) for k, v in needs]
        edges.append(rows.select(name(kind, F.col(key)).alias("src"), name(out, F.col(key)).alias("dst")))
    links = edges[0]
    for more in edges[1:]:
        links = links.unionByName(more)
    ids = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ids.withColumn("type", F.when(F.col("id").rlike("^[a-z]"), "formula").otherwise("data")), links


@query("""WITH n AS (SELECT * FROM nation WHERE n_regionkey IN (1, 2, 3)), s AS (SELECT * FROM supplier JOIN n ON s_nationkey = n_nationkey),
c AS (SELECT c_custkey, n.n_nationkey AS cn, n.n_regionkey AS cr, s.* FROM customer JOIN n ON c_nationkey = n.n_nationkey JOIN s ON s_suppkey = c_custkey % 10 + 1 WHERE c_custkey % 5 = 0)
SELECT DISTINCT unnest(['cust ' || c_custkey, 'C ' || c_custkey, 'S ' || s_suppkey, 'sup ' || s_suppkey, 'N ' || cn, 'nat ' || cn, 'R ' || cr, 'N ' || s_nationkey, 'nat ' || s_nationkey, 'R ' || n_regionkey]) AS id FROM c""")
def graph_shrink_tables(spark: SparkSession, sf: str) -> DataFrame:
    """What every fifth customer needs, of what three regions can give."""
    nodes, edges = _geography(spark, sf)
    inputs = spark.createDataFrame([("R 1",), ("R 2",), ("R 3",)], "id string")
    wanted = table(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.concat(F.lit("C "), F.col("c_custkey").cast("string")).alias("id"))
    return algebra.shrunk(nodes, edges, inputs, wanted)[0].select("id")


@query("""SELECT 'R ' || n_regionkey AS id, 2 AS step FROM nation WHERE n_nationkey % 4 = 1 GROUP BY ALL
UNION ALL SELECT 'nat ' || n_nationkey, 1 FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT 'N ' || n_nationkey, 0 FROM nation WHERE n_nationkey % 4 = 1""")
def graph_reach_tables(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _geography(spark, sf)
    return algebra.reachable(edges, nodes.where("id rlike '^N ' and cast(substring(id, 3) as int) % 4 = 1"), reverse=True)


_LINKS = """SELECT 'R ' || n_regionkey AS src, 'nat ' || n_nationkey AS dst, n_nationkey AS n FROM nation UNION ALL SELECT 'nat ' || n_nationkey, 'N ' || n_nationkey, n_nationkey FROM nation
UNION ALL SELECT 'N ' || s_nationkey, 'sup ' || s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 'sup ' || s_suppkey, 'S ' || s_suppkey, s_nationkey FROM supplier
UNION ALL SELECT 'N ' || c_nationkey, 'cust ' || c_custkey, c_nationkey FROM customer UNION ALL SELECT 'S ' || (c_custkey % 10 + 1), 'cust ' || c_custkey, c_nationkey FROM customer
UNION ALL SELECT 'cust ' || c_custkey, 'C ' || c_custkey, c_nationkey FROM customer"""


@query(f"SELECT src, dst FROM ({_LINKS}) WHERE n % 3 <> 0")
def graph_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    """The part of a graph without every third nation: formulas that lose an input go, and those that lose all outputs."""
    nodes, edges = _geography(spark, sf)
    return algebra.sub_graph(nodes, edges, nodes.where("not (id rlike '^N ' and cast(substring(id, 3) as int) % 3 = 0)").select("id"))[1].select("src", "dst")


@query("""WITH c AS (SELECT * FROM customer WHERE c_custkey % 5 = 1)
SELECT 'C ' || c_custkey AS id, 0 AS step FROM c UNION ALL SELECT 'cust ' || c_custkey, 1 FROM c UNION ALL SELECT DISTINCT 'N ' || c_nationkey, 2 FROM c UNION ALL SELECT DISTINCT 'S ' || (c_custkey % 10 + 1), 2 FROM c
UNION ALL SELECT DISTINCT 'nat ' || c_nationkey, 3 FROM c UNION ALL SELECT DISTINCT 'R ' || n_regionkey, 4 FROM c JOIN nation ON c_nationkey = n_nationkey""")
def graph_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """What every fifth customer depends on, not beyond the suppliers."""
    nodes, edges = _geography(spark, sf)
    return algebra.reachable(edges, nodes.where("id rlike '^C ' and cast(substring(id, 3) as int) % 5 = 1"), reverse=True, blockers=nodes.where("id rlike '^S '"))


@query("""WITH s AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (0, 4))
SELECT DISTINCT unnest(['S ' || s_suppkey, 'sup ' || s_suppkey, 'N ' || n_nationkey, 'nat ' || n_nationkey, 'R ' || n_regionkey]) AS id FROM s""")
def graph_shrink(spark: SparkSession, sf: str) -> DataFrame:
    """What all suppliers need, of what two regions can give."""
    nodes, edges = _geography(spark, sf)
    inputs = spark.createDataFrame([("R 0",), ("R 4",)], "id string")
    return algebra.shrunk(nodes, edges, inputs, nodes.where("id rlike '^S '").select("id"))[0].select("id")


@query(f"SELECT id, CASE WHEN regexp_matches(id, '^[a-z]') THEN 'formula' ELSE 'data' END AS type FROM (SELECT src AS id FROM ({_LINKS}) UNION SELECT dst FROM ({_LINKS})) WHERE contains(id, 't 1') ORDER BY id LIMIT 1")
def graph_fuzzy_node(spark: SparkSession, sf: str) -> DataFrame:
    """The first node by name that contains a text."""
    return algebra.find_node(_geography(spark, sf)[0], "t 1").select("id", "type")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS weight FROM supplier WHERE s_suppkey % 5 <> 0 OR s_suppkey % 3 = 0")
def graph_union(spark: SparkSession, sf: str) -> DataFrame:
    """Of nodes in both graphs the second graph's hold."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("src"), F.col("s_suppkey").alias("dst"))
    part = lambda rows, w: (rows.select("id", F.lit(w).alias("weight")), rows.select("src", "dst"))
    nodes, edges = algebra.union(part(s.where("id % 5 <> 0"), 1), part(s.where("id % 3 = 0"), 2))
    return nodes.join(edges, nodes.id == edges.dst, "left_semi")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0")
def graph_difference(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey")
    return algebra.difference(o, o.where("o_orderkey % 7 = 0"), ["o_orderkey"])


@query(f"""SELECT _id, CASE category WHEN 'en' THEN n_chars >= 500 AND source <> 'src1' WHEN 'de' THEN coalesce(mlang = 'de', false) ELSE n_chars <= 4000 END AS ok FROM ({_ITEMS})""")
def doc_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Documents against their category's JSON schema, or the default one."""
    schemas = {"en": {"type": "object", "required": ["source"], "properties": {"n_chars": {"type": "integer", "minimum": 500}, "source": {"not": {"const": "src1"}}}},
               "de": {"properties": {"meta": {"type": "object", "required": ["lang"], "properties": {"lang": {"enum": ["de"]}}, "additionalProperties": False}}}}
    default = {"properties": {"n_chars": {"maximum": 4000}}}
    return _items(spark, sf).select("_id", Q.valid_documents(F.col("data"), F.col("category"), schemas, default).alias("ok"))


@query(f"""SELECT count(*) FILTER (WHERE is_public OR user_id = 1) AS reader, count(*) AS editor, count(*) FILTER (WHERE user_id = 1) AS writes, 0 AS stranger, count(*) AS admin FROM ({_ITEMS})""")
def doc_acl_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Access by configured roles; the first configured role decides, and a role that isn't configured gives nothing."""
    acl = {"roles": {"reader": {"list": "own"}, "editor": {"list": "all", "update": "own"}, "admin": {}}, "default_role": "reader"}
    rule = lambda user, action="list": F.count_if(Q.access(user, acl, action))
    return _items(spark, sf).agg(rule(Q.User(1)).alias("reader"), rule(Q.User(1, ("x", "editor", "reader"))).alias("editor"), rule(Q.User(1, ("editor",)), "update").alias("writes"),
                                 rule(Q.User(1, ("x",))).cast("int").alias("stranger"), rule(Q.User(1, ("admin",)), "delete").alias("admin"))


@query("SELECT event_id, (event_id + 9007199254740992) = 9007199254740993 AS same FROM events")
def doc_exact_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Whole numbers above 2**53 are compared exactly."""
    rows = table(spark, sf, "events").select("event_id", F.concat(F.lit('{"big":'), (F.col("event_id") + 9007199254740992).cast("string"), F.lit("}")).alias("data"))
    return rows.select("event_id", Q.predicate({"big": 9007199254740993}, Q.json_field("data")).alias("same"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 4 <> 0")
def doc_upsert_delete(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = old.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("status"))
    return Q.delete(Q.upsert(old, new, ["o_orderkey"]), old.where("o_orderkey % 4 = 0"), ["o_orderkey"])


@query("""SELECT n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') AS digest FROM nation""")
def doc_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", Q.content_hash(F.col("n_nationkey"), F.col("n_name")).alias("digest"))


@query("SELECT page_id, page_id % 2 = 0 AND length(url) <= 120 AS ok FROM pages")
def doc_valid_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names with a leading letter or digit and nothing but letters, digits, dots, dashes and underscores."""
    stem = F.rpad(F.lit("a"), F.length("url").cast("int") + 8, F.lit("x"))
    name = F.when(F.col("page_id") % 2 == 0, stem).otherwise(F.concat(F.lit("../"), stem))
    return table(spark, sf, "pages").select("page_id", Q.valid_name(name).alias("ok"))


@query("SELECT p_partkey, p_size AS a, p_size + 1 AS b, p_size * 2 + 1 AS total, p_size * 3 AS thrice, p_size + 5 AS rest FROM part")
def map_names(spark: SparkSession, sf: str) -> DataFrame:
    """Positional values under names, sums, several columns as one, copies, and a map without some keys."""
    a, b = F.col("p_size"), F.col("p_size") + 1
    named, pair = C.name_values(["a", ["b"]], F.array(F.array(a), F.array(b))), C.bypass(a, b)
    kept = C.select_except(F.create_map(F.lit("x"), a, F.lit("y"), F.col("p_size") + 5), list(C.key_names("x")))
    return table(spark, sf, "part").select("p_partkey", named["a"][0].alias("a"), named["b"].alias("b"), C.summation(pair["p_size"], b).alias("total"),
                                           F.aggregate(C.replicate(a, 3), F.lit(0), lambda s, x: s + x).alias("thrice"), F.map_values(kept)[0].alias("rest"))


@query("SELECT doc_id, lang || ' text' AS said, 'Text ' || doc_id || '.' AS first FROM documents")
def doc_documented(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit(" Text "), F.col("doc_id").cast("string"), F.lit(". More.\n\n:return: "), F.col("lang"), F.lit(" text\n:param x: none\n"))
    return table(spark, sf, "documents").select("doc_id", algebra.documented(text, "return").alias("said"), algebra.summary(text).alias("first"))


@query(f"SELECT wallet, CAST(sum(credits) AS BIGINT) AS balance, sum(credits) >= 100000 AS allowed FROM ({_ENTRIES}) GROUP BY wallet")
def ledger_may_use(spark: SparkSession, sf: str) -> DataFrame:
    entries = _entries(spark, sf)
    balances = entries.groupBy("wallet").agg(F.sum("credits").alias("balance"))
    requests = entries.select("wallet").distinct().withColumn("amount", F.lit(100000))
    return ledger.may_use(balances, requests, ["wallet"]).select("wallet", "balance", "allowed")


@query("SELECT wallet, CAST(sum(credits) AS BIGINT) AS credits FROM (SELECT o_custkey AS wallet, -CAST(o_orderkey AS BIGINT) AS credits FROM orders UNION ALL SELECT o_custkey + 1, o_orderkey FROM orders) GROUP BY wallet")
def ledger_transfer(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_custkey") + 1).alias("target"), F.col("o_orderkey").alias("amount"))
    return ledger.transfer(requests).groupBy("wallet").agg(F.sum("credits").alias("credits"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_retailprice AS price FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) ON l_partkey = p_partkey")
def ledger_priced(spark: SparkSession, sf: str) -> DataFrame:
    prices = table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("price"))
    return ledger.priced(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), prices, "l_partkey")


@query("SELECT event_id, event_id % 5 = 0 OR value <= 50 AS allowed FROM events")
def ledger_usage_allowed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", ledger.usage_allowed(F.col("value"), F.lit(50.0), F.col("event_id") % 5 == 0).alias("allowed"))


@query("SELECT p_partkey, CAST(p_size * CASE WHEN p_size <= 10 THEN 5 WHEN p_size <= 25 THEN 4 ELSE 3 END + CASE WHEN p_size <= 10 THEN 100 WHEN p_size <= 25 THEN 50 ELSE 0 END AS BIGINT) AS amount FROM part")
def ledger_volume(spark: SparkSession, sf: str) -> DataFrame:
    """The whole quantity at the price of the first tier that covers it."""
    tiers = spark.createDataFrame([("p", 10, 5, 100), ("p", 25, 4, 50), ("p", None, 3, 0)], "product string, last_unit int, per_unit int, flat_fee int")
    lines = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("quantity"), F.lit("p").alias("product"))
    return ledger.tiered(lines, tiers, volume=True).select("p_partkey", F.col("amount").cast("long").alias("amount"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_hours(CAST(6 * i AS INTEGER)) AS interval_from FROM orders, range(0, 4) AS r(i)")
def ledger_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of six hours."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.to_timestamp_ntz(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("a"))
    return ledger.intervals(rows.withColumn("b", F.expr("a + interval 1 day")), "a", "b", **ledger.frequency("6h")).select("o_orderkey", "interval_from")


@query("SELECT event_id, round(value / 2, 6) AS half, floor(value / 7)::DOUBLE AS whole, round(value - floor(value / 7) * 7, 6) AS rest, round(value * value, 4) AS square, -value AS minus FROM events")
def distance_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    d = distance.pair(F.lit(1.0), F.col("value"))
    return table(spark, sf, "events").select("event_id", F.round(distance.div(d, 2)["num"], 6).alias("half"), distance.floordiv(d, 7)["num"].cast("double").alias("whole"), F.round(distance.mod(d, 7)["num"], 6).alias("rest"),
                                             F.round(distance.power(d, 2)["num"], 4).alias("square"), distance.each(F.negative, d)["num"].alias("minus"))


@query("""SELECT o_orderkey, round(coalesce(CASE WHEN k <> 0 THEN p / k END, p), 6) AS unit, CASE WHEN k = 0 THEN 'divide' ELSE '' END AS failed
FROM (SELECT o_orderkey, o_totalprice AS p, (o_custkey % 4)::DOUBLE AS k FROM orders)""")
def dispatch_errors(spark: SparkSession, sf: str) -> DataFrame:
    """A division by zero fails without ending the query; the next path is taken and the failure recorded."""
    g = FormulaGraph("errors")
    g.formula(lambda p, k: p / k, ["p", "k"], "unit", name="divide")
    g.formula(lambda p: p, ["p"], "unit", name="whole", weight=5)
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"), (F.col("o_custkey") % 4).cast("double").alias("k"))
    return rounded(g.compute(rows, ["unit"], raises="record"), "unit").select("o_orderkey", "unit", F.array_join("errors", ",").alias("failed"))


@query("SELECT p_partkey, round(p_size * 0.0254 * 100, 7) AS centimetres FROM part")
def dispatch_function(spark: SparkSession, sf: str) -> DataFrame:
    """A model as a function of a Column."""
    g = graphs.load({"formulas": [{"build": "$1 * 0.0254D", "inputs": "inches", "outputs": "metres"}, {"build": "$1 * 100", "inputs": ["metres"], "outputs": ["centimetres"], "domain": "$1 >= 0"}]})
    f = g.function(["inches"], "centimetres", {"centimetres": "double"}, "value")
    return table(spark, sf, "part").select("p_partkey", F.round(f(F.col("p_size").cast("double")), 7).alias("centimetres"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, CASE WHEN a % 3 <> 0 THEN a + 7 ELSE a * 2 END AS c FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN a % 3 <> 0 THEN (a + c) % 100003 ELSE a * 2 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, CAST(c AS BIGINT) AS c FROM r""")
def map_fold_domain(spark: SparkSession, sf: str) -> DataFrame:
    """An ordered fold of a graph with a domain, a default and a longer way: where the domain rejects a row, that way is taken."""
    g = FormulaGraph("fold")
    g.data("b", default=F.lit(7).cast("long"))
    g.formula(lambda a: a * 2, ["a"], "c", name="a far", weight=5)
    g.formula("pmod($1 + $2, 100003L)", ["a", "b"], "c", name="near", domain=lambda a, b: a % 3 != 0)
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("a"))
    return fold.fold_model(rows, g, {"c": "b"}, ["user_id"], ["ts", "event_id"], {"c": "long"}).select("user_id", "event_id", "c")


@query("SELECT event_type, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS hour, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Event-time windows; a table is a stream that has ended."""
    out = windowed(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "1 day", ["event_type"], {"n": "count(*)"})
    return out.select("event_type", F.unix_timestamp("window.start").alias("hour"), "n")
