"""The pipeline's stages: columns kept, decisions in effect, awkward tables, and each stage's choice against a plain one."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import decontaminate, mixing, quality, sharding

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_operators import _fingerprint  # noqa: E402

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_stage_keeps_what_scores_high(spark, docs):
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality.score(docs, model).collect() if r.score >= 0.7}
    kept = STAGES["quality"](spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns and 0 < len(want) < docs.count()


def test_dedup_stage_keeps_the_first_of_each_class(spark, docs):
    rows = sorted((r.doc_id, _fingerprint(r.text)) for r in docs.select("doc_id", "text").collect())
    prints, label = np.array([p for _, p in rows], np.uint64), np.array([i for i, _ in rows])
    near = np.bitwise_count(prints[:, None] ^ prints) <= 3
    while not np.array_equal(label, new := np.array([label[n].min() for n in near])):
        label = new
    assert {r.doc_id for r in STAGES["near_dedup"](spark, docs, SF).collect()} == set(label.tolist())


def test_decontamination_stage_drops_what_holds_a_passage(spark, docs):
    bench = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in STAGES["decontaminate"](spark, docs, SF).collect()}
    exact = {r.doc_id for r in docs.collect() if any(f" {' '.join(b)} " in f" {' '.join(r.text.lower().split())} " for b in bench)}
    assert exact and not exact & kept and len(kept) > docs.count() / 2
    assert decontaminate.find_passages(STAGES["decontaminate"](spark, docs, SF), spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0


def test_mix_stage_drops_only_what_is_above_a_quarter(spark, docs):
    before, after = ({r["source"]: r["count"] for r in d.groupBy("source").count().collect()} for d in (docs, STAGES["mix"](spark, docs, SF)))
    total = sum(after.values())
    assert all(after[s] == n or after[s] <= total / 4 + 1 for s, n in before.items()) and set(after) == set(before)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_awkward_tables(spark, name):
    long = "word " * 30_000 + "end"
    rows = [(1, "Some plain text here, of nine or so words.", "en", "s1"), (1, "Some plain text here, of nine or so words.", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (4, " \n\t", "en", None),
            (5, long, "en", "s2"), (5, "another text of the same id", "en", "s2"), (None, "no id", None, "s2"), (7, long, "de", "s2")]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in ("score", "fp", "class", "block", "taken", "slot", "shard", "size", "k", "node", "h", "key"))
    awkward = spark.createDataFrame([(*r, *"abcdefghijkl") for r in rows], schema)
    for table, most in ((awkward, 9), (awkward.limit(0), 0)):
        out = STAGES[name](spark, table, SF)
        got = out.collect()
        assert len(got) <= most and (name in ("quality", "mix") or not most or got)
        if name == "shard":
            assert len(got) == most and set(out.columns) == set(awkward.columns)
        else:
            assert out.columns == awkward.columns and all(r.score == "a" and r.key == "l" for r in got)
    if name == "near_dedup":
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in STAGES[name](spark, awkward, SF).collect()) == [(False, 1), (False, 2), (False, 5), (False, 5), (True, 0)]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert len(out) and not out.duplicated("doc_id").any() and {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} == set(out.columns)
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_shards_follow_the_mixture(spark, docs):
    """The mixture decides which shard a document is in and where: each shard holds every source at its share, in the mixture's order."""
    mixture = STAGES["mix"](spark, docs, SF)
    total = mixture.count()
    out = sharding.shard_mixture(mixture, mixing.order(), target_bytes=docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] // 4 + 1).collect()
    order = [r.doc_id for r in mixture.orderBy(*mixing.order()).collect()]
    copies = docs.groupBy("text").agg(F.collect_list("doc_id").alias("ids")).where("size(ids) > 1").collect()
    moved = {i for r in copies for i in r.ids}
    place = {r.doc_id: r.slot for r in mixture.collect()}
    shards = [[r.doc_id for r in sorted(out, key=lambda r: r.slot) if r.shard == s and r.doc_id not in moved] for s in range(4)]
    assert len(out) == total and all(x == [i for i in order if i in set(x)] for x in shards)
    assert all(max(place[i] for i in x) <= min(place[i] for i in y) for x, y in zip(shards, shards[1:]))
    assert {r.shard for r in out} == {0, 1, 2, 3} and all(len({r.source for r in out if r.shard == s}) >= 3 for s in range(4))
    one = sorted(STAGES["shard"](spark, mixture, SF).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in one if r.doc_id not in moved] == [i for i in order if i not in moved]
