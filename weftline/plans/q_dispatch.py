"""Registered queries of formula graphs: dispatch, models, maps and folds, graph algebra, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import algebra, fold, series
from weftline.plans.graph import SINK, FormulaGraph, far
from weftline.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def fixture(weights: bool = True, fallible: bool = False) -> FormulaGraph:
    """Six formulas over five columns, with a cycle, two domains and a long way round."""
    g = FormulaGraph("fixture")
    g.formula(lambda a, c: F.least(a, c), ["a", "c"], "d", name="min")
    g.formula(lambda b, d: F.greatest(b, d), ["b", "d"], "c", name="max")
    if fallible:
        g.formula(lambda a, b: F.ln(b - a), ["a", "b"], "c", name="log(b - a)")
    else:
        g.formula(lambda a, b: F.ln(b - a), ["a", "b"], "c", name="log(b - a)", domain=lambda a, b: a < b)
    g.formula(lambda d: F.try_divide(F.lit(2.0), d + 1), ["d"], "e", name="2 / (d + 1)", domain=lambda d: d != -1)
    long = {"weight": 20, "input_weights": {"a": 20}, "output_weights": {"d": 20}} if weights else {}
    g.formula(lambda a: a - 4, ["a"], "d", name="x - 4", **long)
    g.formula(lambda e, d: F.pow(e, d), ["e", "d"], "b", name="x ^ y", domain=lambda e, d: ~((e == 0) & (d == 0)))
    return g


def _ab(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_discount") * 500).alias("b"))


_AB = "SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount * 500 AS b FROM lineitem"
_CDE = f"""SELECT *, CASE WHEN d <> -1 THEN 2 / (d + 1) END AS e FROM (
    SELECT *, CASE WHEN a < b THEN least(a, ln(b - a)) ELSE a - 4 END AS d FROM ({_AB}))"""
_C = "CASE WHEN a < b THEN ln(b - a) ELSE greatest(b, d) END"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"SELECT l_orderkey, l_linenumber, a, round(b, 6) AS b, round({_C}, 6) AS c, round(d, 6) AS d, round(e, 6) AS e FROM ({_CDE})")
def dispatch_fixture(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fixture().compute(_ab(spark, sf)), "b", "c", "d", "e").select("l_orderkey", "l_linenumber", "a", "b", "c", "d", "e")


@query(f"SELECT l_orderkey, l_linenumber, a, round(b, 6) AS b, round(CASE WHEN a < b THEN ln(b - a) END, 6) AS c, round(d, 6) AS d FROM ({_CDE})")
def dispatch_targets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fixture().compute(_ab(spark, sf), ["d"], complete=("a", "b")), "b", "c", "d")


@query("""SELECT l_orderkey, l_linenumber, round(coalesce(p, CASE WHEN net IS NOT NULL THEN net / (1 - l_discount) END, l_quantity * p_retailprice), 4) AS price
FROM (SELECT *, CASE WHEN l_orderkey % 3 <> 0 THEN l_extendedprice END AS p, CASE WHEN l_orderkey % 6 <> 0 THEN l_extendedprice * (1 - l_discount) END AS net
      FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def dispatch_impute_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Every third price is missing; it comes back from the net price, or else from the list price."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("p_retailprice").alias("retail"),
                       F.when(F.col("l_orderkey") % 3 != 0, F.col("l_extendedprice")).alias("price"),
                       F.when(F.col("l_orderkey") % 6 != 0, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    g = FormulaGraph("prices")
    g.formula(lambda net, discount: F.try_divide(net, 1 - discount), ["net", "discount"], "price", name="from net")
    g.formula(lambda quantity, retail: quantity * retail, ["quantity", "retail"], "price", name="from list", weight=5)
    return rounded(g.compute(rows, ["price"]), "price", digits=4).select("l_orderkey", "l_linenumber", "price")


@query("""SELECT o_orderkey, greatest(a, b) AS c, least(greatest(a, b), b) AS d, 0.0::DOUBLE AS c_far, least(0.0::DOUBLE, b) AS d_far
FROM (SELECT o_orderkey, o_totalprice AS a, (o_custkey * 100)::DOUBLE AS b FROM orders)""")
def dispatch_defaults_distance(spark: SparkSession, sf: str) -> DataFrame:
    """A default of last resort loses to a formula, and wins where the formula's input is farther still."""
    g = FormulaGraph("defaults")
    g.data("c", default=0.0, distance=far(1, 1))
    g.formula(lambda a, b: F.greatest(a, b), ["a", "b"], "c", name="max")
    g.formula(lambda c, b: F.least(c, b), ["c", "b"], "d", name="min")
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("a"), (F.col("o_custkey") * 100).cast("double").alias("b"))
    near = g.compute(rows)
    wide = near.withColumnsRenamed({"c": "c_near", "d": "d_near"})
    again = g.compute(wide, distances={"a": far(2)})
    return again.select("o_orderkey", F.col("c_near").alias("c"), F.col("d_near").alias("d"), F.col("c").alias("c_far"), F.col("d").alias("d_far"))


@query("""SELECT l_orderkey, l_linenumber, round(c, 6) + 0.0 AS c, round(CASE WHEN c > 0 THEN (4 + ln(c)) / 2 END, 6) AS d
FROM (SELECT l_orderkey, l_linenumber, l_quantity - l_discount * 300 AS c FROM lineitem)""")
def dispatch_wait_average(spark: SparkSession, sf: str) -> DataFrame:
    """A column that waits for all its estimations, the default included, and averages them."""
    g = FormulaGraph("average")
    g.formula(lambda a, b: a - b, ["a", "b"], "c", name="difference")
    g.formula(lambda c: F.ln(c), ["c"], "d", name="log", domain=lambda c: c > 0)
    g.data("d", default=4.0, merge=lambda parts: sum(parts.values()) / len(parts))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_discount") * 300).alias("b"))
    return rounded(g.compute(rows).select("l_orderkey", "l_linenumber", "c", "d"), "c", "d").withColumn("c", F.col("c") + 0.0)


@query(f"SELECT l_orderkey, l_linenumber, round(CASE WHEN NOT (e = 0 AND d = 0) THEN pow(e, d) END, 6) AS b FROM ({_CDE})")
def dispatch_wildcard(spark: SparkSession, sf: str) -> DataFrame:
    """``b`` feeds the formulas and is computed anew from what they make of it."""
    out = fixture().compute(_ab(spark, sf), ["a", "b"], wildcard=True)
    return rounded(out, "b").select("l_orderkey", "l_linenumber", "b")


@query("SELECT o_orderkey, o_totalprice + 3 AS a, round((o_totalprice + 3) * 2 + 1, 2) AS b FROM orders")
def dispatch_filters(spark: SparkSession, sf: str) -> DataFrame:
    g = FormulaGraph("filters")
    g.data("a", filters=[lambda x: x + 1] * 3)
    g.formula(lambda a: a * 2, ["a"], "b", name="double", filters=[lambda x: x + 1])
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("a"))
    return rounded(g.compute(rows), "b", digits=2)


@query("SELECT o_orderkey, o_totalprice AS a, CASE WHEN o_totalprice > 100000 THEN o_totalprice - 100000 END AS b, o_totalprice / 2 AS c FROM orders")
def dispatch_none_output(spark: SparkSession, sf: str) -> DataFrame:
    """A formula may leave out one of its outputs."""
    g = FormulaGraph("none")
    g.formula(lambda a: (F.when(a > 100000, a - 100000), a / 2), ["a"], ["b", "c"], name="two")
    return g.compute(table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("a")))


@query("SELECT o_orderkey, o_custkey * 2 AS b FROM orders")
def dispatch_sink(spark: SparkSession, sf: str) -> DataFrame:
    g = FormulaGraph("sink")
    g.formula(lambda a: (a + 1, a * 2), ["a"], [SINK, "b"], name="two")
    return g.compute(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("a"))).select("o_orderkey", "b")


@query("SELECT o_orderkey, 3 AS a, 5 AS b FROM orders")
def dispatch_start(spark: SparkSession, sf: str) -> DataFrame:
    g = FormulaGraph("start")
    g.formula(lambda: (F.lit(3), F.lit(4)), [], ["a", SINK], name="f")
    g.formula(lambda: (F.lit(4), F.lit(5)), [], [SINK, "b"], name="g")
    return g.compute(table(spark, sf, "orders").select("o_orderkey"))


@query("SELECT c_custkey, greatest(c_acctbal, c_custkey) AS first, least(c_acctbal, c_custkey) AS second FROM customer")
def dispatch_tie_break(spark: SparkSession, sf: str) -> DataFrame:
    """Two formulas as near as each other: the first by name is taken, in whatever order they were declared."""
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("a"), F.col("c_custkey").cast("double").alias("b"))
    for out, (one, other) in (("first", (F.greatest, F.least)), ("second", (F.least, F.greatest))):
        g = FormulaGraph(out)
        g.formula(lambda a, b, f=other: f(a, b), ["a", "b"], out, name="B")
        g.formula(lambda a, b, f=one: f(a, b), ["a", "b"], out, name="A")
        rows = g.compute(rows)
    return rows.select("c_custkey", "first", "second")


@query(f"SELECT l_orderkey, l_linenumber, round(CASE WHEN a < b THEN ln(b - a) ELSE greatest(b, a - 4) END, 6) AS c0, a - 4 AS d FROM ({_AB})")
def dispatch_input_dists(spark: SparkSession, sf: str) -> DataFrame:
    """Without weights and with ``b`` a step farther away, the short way to ``d`` comes first."""
    out = fixture(weights=False).compute(_ab(spark, sf), distances={"b": 1})
    return out.select("l_orderkey", "l_linenumber", F.round("c", 6).alias("c0"), "d")


@query(f"SELECT l_orderkey, l_linenumber, round(d, 6) AS d FROM ({_CDE})")
def dispatch_fail_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """No domain: the logarithm of a negative number fails, and the long way is taken."""
    return rounded(fixture(fallible=True).compute(_ab(spark, sf), ["d"], complete=("a", "b")).select("l_orderkey", "l_linenumber", "d"), "d")


@query(f"SELECT CASE WHEN a < b THEN 'min' ELSE 'x - 4' END AS formula, CASE WHEN a < b THEN 4.0::DOUBLE ELSE 60.0::DOUBLE END AS distance, count(*) AS n FROM ({_AB}) GROUP BY ALL")
def dispatch_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Which formula ``d`` came from, and how far."""
    steps = algebra.trace(fixture().compute(_ab(spark, sf), lineage=True), ["l_orderkey"])
    return steps.where("node = 'd'").groupBy("formula", "distance").agg(F.count("*").alias("n"))


def _child() -> FormulaGraph:
    g = FormulaGraph("child")
    g.formula(lambda a, b: F.least(a, b), ["a", "b"], "c", name="min")
    g.formula(lambda c: (c + 3, c - 3), ["c"], ["d", "e"], name="shift")
    return g


def _orders_customers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("y"))
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_totalprice").alias("x"), "y")


_OC = "SELECT o_orderkey, o_totalprice AS x, c_acctbal AS y FROM orders JOIN customer ON o_custkey = c_custkey"


@query(f"SELECT o_orderkey, x, y, CASE WHEN x > 50000 THEN round(least(x, y) + 3, 4) END AS up, CASE WHEN x > 50000 THEN round(least(x, y) - 3, 4) END AS down FROM ({_OC})")
def subdsp_domain(spark: SparkSession, sf: str) -> DataFrame:
    g = FormulaGraph("parent")
    g.model(_child(), {"x": "a", "y": "b"}, {"d": "up", "e": "down"}, domain=lambda v: v["x"] > 50000)
    return rounded(g.compute(_orders_customers(spark, sf)), "up", "down", digits=4)


@query(f"SELECT o_orderkey, x, y, x AS low, x AS low2, round(x + 3, 4) AS up FROM ({_OC})")
def subdsp_one_to_many(spark: SparkSession, sf: str) -> DataFrame:
    """One column goes to two of the model's, one of the model's to two."""
    g = FormulaGraph("parent")
    g.model(_child(), {"x": ("a", "b")}, {"c": ("low", "low2"), "d": "up"})
    return rounded(g.compute(_orders_customers(spark, sf)), "up", digits=4)


@query(f"SELECT o_orderkey, x, least(x, 1000.0::DOUBLE) AS low FROM ({_OC})")
def subdsp_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """A default of the model's input comes along to the parent."""
    child = _child()
    child.set_default("b", 1000.0)
    g = FormulaGraph("parent")
    g.model(child, {"x": "a", "z": "b"}, {"c": "low"}, include_defaults=True)
    return g.compute(_orders_customers(spark, sf).drop("y")).select("o_orderkey", "x", "low")


@query(f"SELECT l_orderkey, l_linenumber, round({_C}, 6) AS first_c, round(CASE WHEN first_a < {_C} THEN ln({_C} - first_a) ELSE greatest({_C}, first_a - 4) END, 6) AS c FROM (SELECT *, a + 1 AS first_a FROM ({_CDE}))")
def pipe_prepared(spark: SparkSession, sf: str) -> DataFrame:
    """One graph used twice as a transformation of DataFrames: the second run takes results of the first."""
    g = fixture()
    first = _ab(spark, sf).transform(g.compute, ["c"], cutoff=False).select("l_orderkey", "l_linenumber", (F.col("a") + 1).alias("a"), F.col("c").alias("b"))
    second = first.withColumn("first_c", F.round("b", 6)).transform(g.compute, ["c"], cutoff=False)
    return rounded(second, "c").select("l_orderkey", "l_linenumber", "first_c", "c")


def _sum_model() -> FormulaGraph:
    g = FormulaGraph("sum")
    g.formula(lambda a, b: a + b, ["a", "b"], "c", name="add")
    g.formula(lambda a, b: a - b, ["a", "b"], "d", name="subtract")
    return g


@query("SELECT event_id, round(value + coalesce(CASE WHEN event_id % 2 = 0 THEN 5.0 END, 2), 6) AS c, round(value - coalesce(CASE WHEN event_id % 2 = 0 THEN 5.0 END, 2), 6) AS d FROM events")
def map_defaults(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.col("value").alias("a"), F.when(F.col("event_id") % 2 == 0, 5.0).alias("b"))
    return rounded(fold.map_model(rows, _sum_model(), {"b": 2.0}), "c", "d").select("event_id", "c", "d")


_EVENTS = "SELECT user_id, ts, event_id, CAST(round(value * 100) AS BIGINT) AS v FROM events"


@query(f"SELECT user_id, event_id, CAST(sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS c, CAST(2 * v - sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS d FROM ({_EVENTS})")
def map_recursive_fold(spark: SparkSession, sf: str) -> DataFrame:
    """``c = a + b`` where ``b`` is the ``c`` of the user's event before: the model as an ordered fold."""
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("a"))
    rows = rows.withColumn("b", F.when(F.row_number().over(_first()) == 1, F.lit(0).cast("long")))
    out = fold.fold_model(rows, _sum_model(), {"c": "b"}, ["user_id"], ["ts", "event_id"], {"c": "long", "d": "long"})
    return out.select("user_id", "event_id", "c", "d")


def _first():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("""WITH t AS (SELECT event_type || '/' || (user_id % 7) || '/' || (event_id % 3) AS path, CAST(round(value * 100) AS BIGINT) AS s FROM events),
l AS (SELECT path, s, string_split(path, '/') AS p FROM t), e AS (SELECT path, s, array_to_string(list_slice(p, 1, i), '/') AS node FROM l, unnest(range(1, len(p) + 1)) AS u(i))
SELECT node, CAST(sum(s) AS BIGINT) AS total, CAST(sum(CASE WHEN node = path THEN s ELSE 0 END) AS BIGINT) AS own, CAST(len(string_split(node, '/')) AS INTEGER) AS depth FROM e GROUP BY node""")
def graph_durations(spark: SparkSession, sf: str) -> DataFrame:
    """Times rolled up a tree of paths."""
    rows = table(spark, sf, "events").select(F.concat_ws("/", "event_type", (F.col("user_id") % 7).cast("string"), (F.col("event_id") % 3).cast("string")).alias("path"),
                                             F.round(F.col("value") * 100).cast("long").alias("seconds"))
    return algebra.durations(rows)


@query("SELECT c_custkey, c_mktsegment AS name, c_mktsegment || CASE WHEN n = 1 THEN '' ELSE '<' || (n - 2) || '>' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer)")
def graph_unique_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("name"))
    return algebra.numbered(rows, "name", "c_custkey")


_SERIES = "SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, value AS v, ts FROM events"


def _series(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("v"))


@query(f"""SELECT user_id, event_id, round(CASE WHEN hs IS NULL THEN (y2 - v) / hd WHEN hd IS NULL THEN (v - y0) / hs
  ELSE (hs * hs * y2 + (hd * hd - hs * hs) * v - hd * hd * y0) / (hs * hd * (hs + hd)) END, 6) AS slope
FROM (SELECT *, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd, lag(v) OVER w AS y0, lead(v) OVER w AS y2 FROM ({_SERIES}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def series_gradient(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.gradient(_series(spark, sf), "v", "t", ["user_id"], ["ts", "event_id"], "slope"), "slope").select("user_id", "event_id", "slope")


@query(f"""SELECT user_id, event_id, round(sum(part) OVER (PARTITION BY user_id ORDER BY ts, event_id), 2) AS area
FROM (SELECT *, coalesce((v + lag(v) OVER w) / 2 * (t - lag(t) OVER w), 0) AS part FROM ({_SERIES}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def series_cumtrapz(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.cumulative_integral(_series(spark, sf), "v", "t", ["user_id"], ["ts", "event_id"], "area"), "area", digits=2).select("user_id", "event_id", "area")


@query("SELECT p_partkey, round(p_size * 0.0254, 9) AS metres, round(p_size * 0.0254 * 100, 7) AS centimetres, round(p_size / 12.0, 9) AS feet FROM part")
def unit_conversion_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Conversions between neighbouring units; any unit follows from any other along the shortest path."""
    g = FormulaGraph("units")
    g.formula(lambda inches: inches * 0.0254, ["inches"], "metres", name="inch to metre")
    g.formula(lambda metres: metres / 0.0254, ["metres"], "inches", name="metre to inch")
    g.formula(lambda metres: metres * 100, ["metres"], "centimetres", name="metre to centimetre")
    g.formula(lambda inches: inches / 12, ["inches"], "feet", name="inch to foot")
    g.formula(lambda feet: feet * 12, ["feet"], "inches", name="foot to inch")
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("inches"))
    out = g.compute(rows, ["metres", "centimetres", "feet"])
    return out.select("p_partkey", F.round("metres", 9).alias("metres"), F.round("centimetres", 7).alias("centimetres"), F.round("feet", 9).alias("feet"))
