"""Registered queries over ordered rows of a key: folds of whole graphs, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import asof, fold, latebound, ranges
from weftline.plans.q_dispatch import _C, _CDE, _ab, fixture, query, rounded
from weftline.sources.tables import table


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, value / 10 AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, a, (event_id % 7)::DOUBLE AS b, CASE WHEN a < event_id % 7 THEN least(a, ln((event_id % 7)::DOUBLE - a)) ELSE a - 4 END AS d FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.event_id, o.k, o.a, r.d, CASE WHEN o.a < r.d THEN least(o.a, ln(r.d - o.a)) ELSE o.a - 4 END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, event_id, round(CASE WHEN a < b THEN ln(b - a) ELSE greatest(b, d) END, 4) AS c, round(d, 4) AS d, round(CASE WHEN d <> -1 THEN 2 / (d + 1) END, 3) AS e FROM r""")
def map_fold_fixture(spark: SparkSession, sf: str) -> DataFrame:
    """The fixture graph, with its cycle and domains, as an ordered fold: each ``d`` is the next row's ``b``."""
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("value") / 10).alias("a"), (F.col("event_id") % 7).cast("double").alias("b"))
    rows = ranges.scan(rows, ["user_id"], ["ts", "event_id"], previous={"before": F.col("event_id")}).withColumn("b", F.when(F.col("before").isNull(), F.col("b")))
    out = fold.fold_model(rows, fixture(), {"d": "b"}, ["user_id"], ["ts", "event_id"], {"c": "double", "d": "double", "e": "double"})
    return out.select("user_id", "event_id", F.round("c", 4).alias("c"), F.round("d", 4).alias("d"), F.round("e", 3).alias("e"))


@query(f"SELECT l_orderkey, l_linenumber, round({_C}, 6) AS c, round(d, 6) AS d, round(e, 6) AS e FROM ({_CDE})")
def dispatch_function_fixture(spark: SparkSession, sf: str) -> DataFrame:
    """A graph with a cycle, domains and a long way as one function of Columns, called once for equal inputs."""
    names = ["c", "d", "e"]
    f = fixture().function(["a", "b"], names, dict.fromkeys(names, "double"))
    called = latebound.call_once(_ab(spark, sf), ["a", "b"], lambda a, b: f(a, b), "s")
    return rounded(called.select("l_orderkey", "l_linenumber", "s.*"), *names)


@query("""SELECT e.event_id, coalesce(arg_max(o.event_id, (o.ts, o.event_id)), -1) AS other, arg_max(o.event_type, (o.ts, o.event_id)) AS other_type
FROM events e LEFT JOIN events o ON o.user_id = e.user_id AND o.event_type <> e.event_type AND (o.ts, o.event_id) < (e.ts, e.event_id) GROUP BY e.event_id""")
def asof_other_type(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with its user's last event of another type: the one before the latest change of type."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    changes = ranges.scan(e, ["user_id"], ["at"], previous={"p": F.struct("event_id", "event_type")}).where("event_type <> p.event_type")
    changes = changes.select("user_id", "at", F.col("p.event_id").alias("o"), F.col("p.event_type").alias("ot"))
    return asof.asof_join(e, changes, ["user_id"], "at", {"o": "other", "ot": "other_type"}).select("event_id", F.coalesce("other", F.lit(-1)).alias("other"), "other_type")


@query("""SELECT l.event_id, CASE WHEN r.ts >= l.ts - INTERVAL 2 DAY THEN r.value END AS last_value, coalesce(CASE WHEN r.ts >= l.ts - INTERVAL 2 DAY THEN epoch_us(l.ts) - epoch_us(r.ts) END, -1) AS age
FROM events l ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) r ON l.user_id = r.user_id AND l.ts > r.ts""")
def asof_within(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with its user's last click before it, of two days at most."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts", "value")
    clicks = e.where("event_type = 'click'").withColumn("at", F.col("ts"))
    out = asof.asof_join(e, clicks, ["user_id"], "ts", {"value": "last_value", "at": "then"}, strict=True, within="interval 2 days", tie="event_id")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("event_id", "last_value", F.coalesce(micros("ts") - micros("then"), F.lit(-1)).alias("age"))
