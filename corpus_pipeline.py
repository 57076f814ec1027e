"""A training-corpus pipeline: five stages, each of them one operator of tidemark.llm.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet
to shared storage and read again as the next one's docs, so that a lost executor
never costs more than the stage that runs.  All stages but the last return the
columns of documents.  Null or empty texts, repeated rows, empty tables and extra
columns pass through every stage as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import col, cut, fresh, read
from tidemark.llm.decontamination import decontaminate
from tidemark.llm.mixing import mix_documents
from tidemark.llm.sharding import shard_documents
from tidemark.llm.simhash import keep_one
from tidemark.llm.toxicity import fit, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict as toxic."""
    model = fit(docs, read(spark, sf_dir, "labels"))
    score, predicted = fresh(docs.columns, "score", "predicted")
    return score_toxicity(docs, model, (score, predicted)).where(F.col(predicted) == 0).select(*map(col, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no full window of a benchmark item, and few words of short items."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy that is taken, in order of virtual finish time."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and their shard."""
    return shard_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# Kernel scores, XXH64 and rendezvous draws can't be expressed in DuckDB SQL;
# tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
