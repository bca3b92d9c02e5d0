"""Every registered query against its oracle SQL, and the folds against plain loops."""

import duckdb
import pytest

import __spark_entry__
from weftline.operators import ledger
from weftline.operators.fold import fold_rows
from weftline.plans import q_docs, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def text(frame, columns):
    return sorted(frame[columns].astype(str).replace({"<NA>": "nan", "None": "nan", "NaN": "nan"}).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert text(got, sorted(got.columns)) == text(want, sorted(got.columns))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_a_session_that_started_before():
    """Python workers find the package although their session started without it."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
import sys
sys.path.insert(0, {str(Path(__spark_entry__.__file__).parent)!r})
import __spark_entry__
assert __spark_entry__.queries()["doc_patch_merge"](spark, {SF!r}).count() > 0
assert __spark_entry__.queries()["doc_patch_merge"](spark, {SF!r}).where("k = -1").count() > 0
print("found")
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd="/", capture_output=True, text=True, timeout=300)
    assert "found" in done.stdout, done.stderr[-2000:]


def test_balance(spark):
    entries = q_docs._entries(spark, SF)
    groups = {}
    for r in sorted(entries.collect(), key=lambda r: (r.valid_from, r.id)):
        groups.setdefault((r.wallet, r.product), []).append(r)
    want = {}
    for key, rows in groups.items():
        buckets, seen = {}, False
        for r in rows:
            if r.valid_from > 1500 or not r.credits:
                continue
            seen, end = True, r.expired_at if r.expired_at is not None else 10**9
            if r.credits > 0:
                buckets[end] = buckets.get(end, 0) + r.credits
                continue
            left = -r.credits
            for k in sorted(k for k in buckets if k >= r.valid_from and buckets[k] > 0):
                used = min(left, buckets[k])
                buckets[k] -= used
                left -= used
            buckets[10**9] = buckets.get(10**9, 0) - left
        if seen:
            want[key] = sum(v for k, v in buckets.items() if k >= 1500)
    assert {(r.wallet, r.product): r.balance for r in ledger.balance(entries, 1500).collect()} == want


def test_balance_example(spark):
    entries = spark.createDataFrame([(1, "w", "p", 10, 1, 5), (2, "w", "p", 10, 1, 9), (3, "w", "p", -12, 3, None)], "id int, wallet string, product string, credits long, valid_from long, expired_at long")
    assert [ledger.balance(entries, d).collect()[0].balance for d in (4, 10)] == [8, 0]


def test_fold_rows(spark):
    rows = spark.createDataFrame([("k", 2, 2.0), ("k", 1, 2.0), ("k", 3, 3.0), ("l", 1, 5.0)], "k string, t int, a double")
    out = fold_rows(rows, ["k"], ["t"], lambda: 0.0, lambda s, r: (s + r[0], (s + r[0],)), ["a"], "k string, t int, c double")
    assert sorted(map(tuple, out.collect())) == [("k", 1, 2.0), ("k", 2, 4.0), ("k", 3, 7.0), ("l", 1, 5.0)]


@pytest.mark.parametrize("small", [False, True])
def test_fold_of_a_graph_in_chunks(spark, monkeypatch, small):
    """A hot key in many chunks, nulls, a domain, a carried result that is missing."""
    from weftline.operators import fold
    from weftline.operators.fold import fold_model

    if small:
        monkeypatch.setattr(fold, "CHUNK_ROWS", 4)
        monkeypatch.setattr(fold, "BLOCK_ROWS", 3)
    from weftline.plans.graph import FormulaGraph

    g = FormulaGraph()
    g.data("b", default=100)
    g.formula(lambda a, b: a + b, ["a", "b"], "c", name="add", domain=lambda a, b: a != 3)
    rows = [("hot", t, t % 5 if t % 7 else None, 1 if t == 40 else None) for t in range(50)] + [("one", 0, 3, None), ("two", 1, 2, 9)] + [(None, t, 1, None) for t in range(9)]
    df = spark.createDataFrame(rows, "k string, t int, a int, b int")
    want, last = {}, {}
    for k, t, a, b in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        b = b if b is not None else last.get(k) if last.get(k) is not None else 100
        last[k] = a + b if a is not None and a != 3 else None
        want[k, t] = last[k]
    got = fold_model(df, g, {"c": "b"}, ["k"], ["t"], {"c": "int"})
    assert {(r.k, r.t): r.c for r in got.collect()} == want
