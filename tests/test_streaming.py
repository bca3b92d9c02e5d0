"""A stream gives the same as a table."""

from pyspark.sql import functions as F

from weftline.plans.q_dispatch import fixture
from weftline.streaming.models import compute_stream, fold_stream


def run(df, name):
    query = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(map(tuple, df.sparkSession.table(name).collect()), key=str)


def test_rows(spark, tmp_path):
    rows = spark.range(40).select(F.col("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5 + 1).cast("double").alias("b"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    graph = fixture()
    assert run(compute_stream(stream, graph), "rows_out") == sorted(map(tuple, graph.compute(rows).collect()), key=str)


def test_fold(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1, 2.0), ("k", 2, 2.0), ("k", 3, 3.0), ("l", 1, 5.0)], "k string, t int, a double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = fold_stream(stream, ["k"], ["t"], ["a"], lambda: (0.0,), lambda s, r: ((s[0] + r[0],), (s[0] + r[0],)), "total double", "k string, t int, c double")
    assert run(out, "fold_out") == [("k", 1, 2.0), ("k", 2, 4.0), ("k", 3, 7.0), ("l", 1, 5.0)]


def test_balances_with_timers_late_rows_and_a_restart(spark, tmp_path):
    """Files come one by one; the stream is stopped and started anew between them and keeps its credits."""
    from weftline.streaming import credits

    schema = "w string, at timestamp, id long, credits long, expires timestamp"

    def add(name, rows):
        spark.createDataFrame(rows, "w string, at string, id long, credits long, expires string").select("w", F.to_timestamp("at").alias("at"), "id", "credits", F.to_timestamp("expires").alias("expires")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def go():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = credits.run_available(credits.balances(stream, ["w"], "1 day"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        return {(r.w, r.id): r.balance for r in out.where("id is not null").collect()}, sorted(r.balance for r in out.where("id is null").collect())

    add("a", [("k", "2024-01-01", 1, 10, "2024-01-05"), ("k", "2024-01-02", 2, 10, "2024-01-09"), ("k", "2024-01-03", 3, -12, None), ("l", "2024-01-01", 4, 5, None)])
    assert go() == ({("k", 1): 10, ("k", 2): 20, ("k", 3): 8, ("l", 4): 5}, [])
    add("b", [("k", "2024-01-20", 5, 1, None), ("l", "2024-01-21", 6, -7, None), ("k", "2024-01-19", 7, -3, None)])
    got, expired = go()  # what was left of the second credit had expired by then
    assert got[("k", 7)] == -3 and got[("k", 5)] == -2 and got[("l", 6)] == -2
    add("c", [("k", "2024-01-02", 8, 100, None), ("k", "2024-02-01", 9, 4, None)])  # the first is older than the watermark
    got, expired = go()
    assert ("k", 8) not in got and got[("k", 9)] == 2 and expired == []
    add("d", [("m", "2024-02-01", 10, 6, "2024-02-03"), ("k", "2024-02-10", 11, 1, None)])
    got, expired = go()
    add("e", [("k", "2024-02-11", 12, 1, None)])
    got, expired = go()
    assert expired == [0] and got[("m", 10)] == 6
