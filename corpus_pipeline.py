"""The training-data pipeline: classify, deduplicate, decontaminate, mix, shard.

Each stage takes all documents that the stage before it kept. ``run`` writes each stage's result in the shared
folder and reads it again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, mixing, quality, sharding, simhash
from weftline.llm import shared as S

#: Bytes of text in a shard at the end.
SHARD_BYTES = 1 << 26


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (2) accepts, with a score of 0.7 or more.

    A null text is scored like an empty one; equal rows have equal scores; an empty table stays empty, with whatever
    labels. All columns of ``docs`` stay as they are.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, keep=tuple(docs.columns), name="__quality").where("__quality >= 0.7").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates by SimHash (4) the document with the smallest id; of equal rows, one.

    Null, empty and blank texts are one group; a null id stays only if its group has no other; of one id with several
    texts one text stays. An empty table stays empty.
    """
    return simhash.keep_one(docs).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage (3). Null and empty texts hold none; each row is judged by itself."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of all sources (5), none above a quarter: only rows of a larger source beyond its share are left out.

    ``slot`` is the row's place in the mixture, by which the next stage cuts and orders its shards; a column that is called
    so already is replaced. Rows without a source are a source of their own, a null id comes first, equal rows count as rows.
    """
    rows = docs.select("doc_id", "source", F.struct(*docs.columns).alias("__doc"))  # no column of the mixture meets one of docs
    kept = mixing.mix_shares(rows).where("taken")
    columns = [F.col("slot") if c == "slot" else F.col("__doc")[c].alias(c) for c in dict.fromkeys([*docs.columns, "slot"])]
    return kept.select(*columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their slot in it (1); columns that are called so already are replaced.

    Documents that have a place in the mixture are sharded by it: each shard is a piece of the mixture, so it holds every
    source at its share, and its slots follow the mixture. Null texts have no bytes, null places lie at their dimension's
    lower end, equal texts lie together.
    """
    if dict(docs.dtypes).get("slot") == "bigint":
        return sharding.shard_mixture(docs, mixing.order(), target_bytes=SHARD_BYTES)
    return sharding.shard_documents(docs, target_bytes=SHARD_BYTES)


STAGES = [("quality", classify), ("near_dedup", deduplicate), ("decontaminate", decontaminated), ("mix", mixed), ("shard", sharded)]
#: The classifier's training has no SQL form; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again before the next; what a stage wrote besides, and what the stage before it kept, is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with S.intermediates():
            done = stage(spark, docs, sf_dir)
            kept = S.materialize(done, keep=True)
        S.discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
