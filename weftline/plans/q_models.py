"""Registered queries of weighted ways through graph tables, of models that rows name, and of ledgers on streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.operators import algebra, latebound
from weftline.plans.graph import FormulaGraph
from weftline.plans.q_dispatch import query, rounded
from weftline.sources import graphs
from weftline.sources.tables import shared_dir, stream, table
from weftline.streaming import credits, models


def _weighted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nations, suppliers and customers as formulas with lengths; a customer can also be had from a region, by a longer way."""
    n, s, c = (table(spark, sf, t) for t in ("nation", "supplier", "customer"))
    name = lambda kind, key: F.concat(F.lit(f"{kind} "), key.cast("string"))
    edge = lambda rows, src, dst, length: rows.select(src.alias("src"), dst.alias("dst"), F.lit(length).cast("double").alias("length") if isinstance(length, int) else length.cast("double").alias("length"))
    k, sk, ck = F.col("n_nationkey"), F.col("s_suppkey"), F.col("c_custkey")
    edges = [edge(n, name("R", F.col("n_regionkey")), name("nat", k), 1), edge(n, name("nat", k), name("N", k), k % 4 + 1),
             edge(s, name("N", F.col("s_nationkey")), name("sup", sk), 2), edge(s, name("sup", sk), name("S", sk), 1),
             edge(c, name("N", F.col("c_nationkey")), name("cust", ck), 1), edge(c, name("S", ck % 10 + 1), name("cust", ck), ck % 3), edge(c, name("cust", ck), name("C", ck), 1),
             edge(c, name("R", ck % 5), name("alt", ck), ck % 7 + 4), edge(c, name("alt", ck), name("C", ck), 1)]
    links = edges[0]
    for more in edges[1:]:
        links = links.unionByName(more)
    ids = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ids.withColumn("type", F.when(F.col("id").rlike("^[a-z]"), "formula").otherwise("data")), links


_REGIONS = [("R 0", 0.0), ("R 1", 2.0), ("R 2", 1.0), ("R 3", 0.0)]


@query("""WITH r AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 2.0::DOUBLE), (2, 1.0::DOUBLE), (3, 0.0::DOUBLE)) AS t(k, d)),
n AS (SELECT n_nationkey AS k, d + 1 AS f, d + 1 + n_nationkey % 4 + 1 AS d FROM nation JOIN r ON n_regionkey = r.k),
s AS (SELECT s_suppkey AS k, n.d + 2 AS f, n.d + 3 AS d FROM supplier JOIN n ON s_nationkey = n.k),
c AS (SELECT c_custkey AS k, greatest(n.d + 1, s.d + c_custkey % 3) AS f FROM customer JOIN n ON c_nationkey = n.k JOIN s ON s.k = c_custkey % 10 + 1),
a AS (SELECT c_custkey AS k, r.d + c_custkey % 7 + 4 AS f FROM customer JOIN r ON r.k = c_custkey % 5)
SELECT 'R ' || k AS id, d AS distance, NULL AS via FROM r UNION ALL SELECT 'nat ' || k, f, NULL FROM n UNION ALL SELECT 'N ' || k, d, 'nat ' || k FROM n
UNION ALL SELECT 'sup ' || k, f, NULL FROM s UNION ALL SELECT 'S ' || k, d, 'sup ' || k FROM s UNION ALL SELECT 'cust ' || k, f, NULL FROM c UNION ALL SELECT 'alt ' || k, f, NULL FROM a
UNION ALL SELECT 'C ' || coalesce(c.k, a.k), least(c.f, a.f) + 1, CASE WHEN c.f IS NULL OR a.f <= c.f THEN 'alt ' ELSE 'cust ' END || coalesce(c.k, a.k) FROM c FULL JOIN a ON c.k = a.k""")
def graph_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Shortest ways from four regions to all that can be had, where a customer waits for its nation and its supplier."""
    nodes, edges = _weighted(spark, sf)
    return algebra.distances(nodes, edges, spark.createDataFrame(_REGIONS, "id string, distance double"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN b IS NOT NULL THEN 2 * b - 1 WHEN a IS NOT NULL THEN a + 1 END, 6) AS x, round(CASE WHEN b IS NOT NULL THEN 2 * b WHEN a IS NOT NULL THEN a + 11 END, 6) AS y
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END AS b FROM lineitem)""")
def dispatch_negative(spark: SparkSession, sf: str) -> DataFrame:
    """A cycle with a negative length: where both are given, x is nearer by the farther y than from a."""
    g = FormulaGraph("negative", negative_weights=True)
    g.formula(lambda a: a + 1, ["a"], "x", name="x of a", weight=1)
    g.formula(lambda b: b * 2, ["b"], "y", name="y of b", weight=3)
    g.formula(lambda y: y - 1, ["y"], "x", name="x of y", weight=-5)
    g.formula(lambda x: x + 10, ["x"], "y", name="y of x", weight=2)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("a"),
                                               F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).alias("b"))
    return rounded(g.compute(rows, ["x", "y"]), "x", "y").select("l_orderkey", "l_linenumber", "x", "y")


_MODELS = {
    "click": {"formulas": [{"build": "$1 * 2", "inputs": ["value"], "outputs": ["x"], "name": "twice"}, {"build": "$1 + 1", "inputs": ["x"], "outputs": ["score"], "name": "one more"}]},
    "purchase": {"data": [{"name": "rate", "default": 0.25}], "formulas": [
        {"build": "$1 * $2", "inputs": ["value", "rate"], "outputs": ["score"], "name": "share", "domain": "$1 > 20"}, {"build": "-$1", "inputs": ["value"], "outputs": ["score"], "name": "loss", "weight": 5}]},
    "view": {"formulas": [{"build": "CAST($1 AS DOUBLE)", "inputs": ["user_id"], "outputs": ["score"], "name": "user"}]},
}


@query("""SELECT event_id, round(CASE event_type WHEN 'click' THEN value * 2 + 1 WHEN 'purchase' THEN CASE WHEN value > 20 THEN value * 0.25 ELSE -value END WHEN 'view' THEN user_id END, 6) AS score,
  CASE event_type WHEN 'click' THEN value * 2 END AS x FROM events""")
def dispatch_named_models(spark: SparkSession, sf: str) -> DataFrame:
    """Each event by the model that its type names, of a table of specifications; other types have none."""
    specs = spark.createDataFrame([(k, json.dumps(v)) for k, v in _MODELS.items()], "name string, spec string")
    rows = table(spark, sf, "events").select("event_id", "event_type", "user_id", "value")
    return rounded(latebound.compute_named(rows, latebound.read_models(specs), "event_type", ["score", "x"]), "score").select("event_id", "score", "x")


_WALLETS = """SELECT user_id, event_id, ts, epoch_us(ts) AS t0, CAST(CASE WHEN event_type = 'purchase' THEN -ceil(value) ELSE ceil(value) END AS BIGINT) AS credits,
  CASE WHEN event_id % 5 = 0 THEN 4611686018427387904 ELSE epoch_us(ts) + 86400000000 * (event_id % 9 + 1) END AS e FROM events WHERE event_type IN ('purchase', 'click', 'signup')"""
_USABLE = "CASE WHEN y.e >= t0 AND y.v > 0 THEN y.v ELSE 0 END"


@query(f"""WITH RECURSIVE x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM ({_WALLETS})),
f AS (SELECT user_id, 0::BIGINT AS k, CAST(NULL AS BIGINT) AS event_id, 0::BIGINT AS t0, 0::BIGINT AS debt, []::STRUCT(e BIGINT, v BIGINT)[] AS b FROM x GROUP BY user_id
  UNION ALL SELECT user_id, k, event_id, t0, debt + CASE WHEN credits < 0 THEN greatest(0, -credits - coalesce(list_sum(list_transform(b, lambda y: {_USABLE})), 0)::BIGINT) ELSE 0 END,
    CASE WHEN credits >= 0 THEN list_sort(list_append(b, {{'e': e, 'v': credits}})) ELSE
      list_transform(b, lambda y, i: {{'e': y.e, 'v': y.v - greatest(0, least({_USABLE}, -credits - coalesce(list_sum(list_transform(b[1:i - 1], lambda y: {_USABLE})), 0)::BIGINT))}}) END
    FROM (SELECT x.*, f.b, f.debt FROM f JOIN x ON x.user_id = f.user_id AND x.k = f.k + 1))
SELECT user_id, event_id, CAST(coalesce(list_sum(list_transform(b, lambda y: CASE WHEN y.e >= t0 THEN y.v ELSE 0 END)), 0) - debt AS BIGINT) AS balance FROM f WHERE k > 0""")
def stream_balances(spark: SparkSession, sf: str) -> DataFrame:
    """Balances behind each entry, from a stream of events with state and timers that ends with what there is."""
    events = stream(spark, sf, "events").where("event_type in ('purchase', 'click', 'signup')")
    amount = F.ceil("value").cast("long")
    at = F.col("ts").cast("timestamp")
    expires = F.when(F.col("event_id") % 5 != 0, F.timestamp_micros(F.unix_micros(at) + 86_400_000_000 * (F.col("event_id") % 9 + 1)))
    entries = events.select("user_id", at.alias("at"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", -amount).otherwise(amount).alias("credits"), expires.alias("expires"))
    out = credits.run_available(credits.balances(entries, ["user_id"], "30 days"))
    return out.where("id is not null").select("user_id", F.col("id").alias("event_id"), "balance")


@query("SELECT event_id, round(CASE WHEN value > 50 THEN value * 2 ELSE value + user_id END, 6) AS score, CASE WHEN value > 50 THEN 'twice' ELSE 'with user' END AS way FROM events")
def stream_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """A graph on a stream of events: each row takes its own way, as in a table."""
    g = FormulaGraph("score")
    g.formula(lambda value: value * 2, ["value"], "score", name="twice", domain=lambda value: value > 50)
    g.formula(lambda value, user_id: value + user_id, ["value", "user_id"], "score", name="with user", weight=3)
    out = models.compute_stream(stream(spark, sf, "events").select("event_id", "value", "user_id"), g, ("score",), lineage=True)
    step = F.filter("workflow", lambda s: s["node"] == "score")[0]["formula"]
    return rounded(credits.run_available(out.select("event_id", "score", step.alias("way"))), "score")


@query("SELECT p_partkey, round(p_size * 0.0254::DOUBLE, 9) AS metres, p_size * 10 + 1 AS tenfold FROM part")
def dispatch_stored_model(spark: SparkSession, sf: str) -> DataFrame:
    """A model that was written as a specification, read back and given default values from a table."""
    g = graphs.load({"data": [{"name": "one", "default": 7}], "formulas": [{"build": "$1 * 0.0254D", "inputs": ["size"], "outputs": ["metres"], "name": "inch to metre"},
                                                                           {"build": "$1 * 10 + $2", "inputs": ["size", "one"], "outputs": ["tenfold"], "name": "tenfold"}]})
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    graphs.write_spec(spark, g, path)
    g = graphs.set_defaults(graphs.read_spec(spark, path), spark.createDataFrame([("one", "1", 0.0)], "id string, value string, distance double"))
    return rounded(g.compute(table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("size")), ["metres", "tenfold"]), "metres", digits=9).select("p_partkey", "metres", "tenfold")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE 'old' END AS status, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice ELSE -1 END AS price, o_custkey AS kept FROM orders")
def nested_merge_known(spark: SparkSession, sf: str) -> DataFrame:
    """Structs merged deeply by built-in functions: right values hold where there are any."""
    o = table(spark, sf, "orders")
    left = F.struct(F.struct(F.lit("old").alias("status"), F.lit(-1.0).alias("price")).alias("facts"), F.col("o_custkey").alias("kept"))
    right = F.struct(F.struct(F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_totalprice")).alias("price")).alias("facts"),
                     F.lit(None).cast("long").alias("kept"))
    merged = C.merge_known(left, right, {"facts": {"status": "string", "price": "double"}, "kept": "long"})
    return o.select("o_orderkey", merged.alias("m")).select("o_orderkey", F.col("m.facts.status").alias("status"), F.col("m.facts.price").alias("price"), F.col("m.kept").alias("kept"))
