"""A corpus from raw documents to shards: each stage is a Spark job over all that the stage before kept.

No stage's rows can be written in SQL (a trained classifier, linked components, BM25, differencing), so
ORACLE_SQL is None; tests/llm compares the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimweave.llm.common import materialize, release, scratch
from claimweave.llm.decontamination import drop_contaminated
from claimweave.llm.mixing import mixed_rows
from claimweave.llm.sharding import sharding_result
from claimweave.llm.simhash import keep_one_of_each
from claimweave.llm.toxicity import drop_toxic


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding_result(docs)


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("simhash", keep_one_copy),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of ``documents``; each stage's rows are written to the shared folder and read again.

    What a stage wrote on its way is deleted when its rows are written, and its input when the next rows are.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as kept:
            kept.append(materialize(stage(spark, docs, sf_dir), name))
        release(docs)
        docs = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)
