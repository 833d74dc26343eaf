"""The training-data pipeline over ``documents``: quality rules, one document of each near-duplicate
group, no benchmark passages, target weights, shards. Each stage works on what its predecessor kept.

Odd input, for all stages: an empty table gives an empty one; further columns are kept, whatever their names, up to
the last stage; rows without doc_id take part and stay unless their own text decides otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import decontaminate, mixing, ngram_join, quality, sharding
from ferrule.llm.common import small, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep. Null and empty texts fail the base rule; without
    labels of both kinds the list is empty; repeated rows are judged alike."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, rules).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (5-word shingles, 0.8 or more);
    of repeated rows with one doc_id, one. Rows without doc_id stay."""
    found, _ = stored(ngram_join.ngram_join(docs).select("doc_id", "component_id"), "groups")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    again = found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    left = docs.join(small(gone), "doc_id", "left_anti")
    again = small(again)
    single = left.join(again, "doc_id", "left_anti")
    return single.unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word passage of the benchmark. Null texts have none; an empty benchmark removes nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row stands as often as its source's budget has it. Null levels are a source of their own; rows
    without tokens go with the rows about them; rows that share a doc_id are taken or left together."""
    mix = mixing.mixture(docs).where("copies > 0")
    return mix.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row of the mixture lies: 40 shards of equal bytes. A null text has no bytes; repeated rows are
    placed one by one; without rows there are none."""
    return sharding.digest(sharding.reshard(docs.select("doc_id", "text"), 40, sharding.old_by_hash()))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", target_weights),
    ("sharding", shards),
]

#: The learned decision list and the flow can't be told in SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
