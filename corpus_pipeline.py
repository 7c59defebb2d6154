"""The corpus pipeline: toxicity, near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs``
with the same columns; the last one returns the encoded documents. A stage is
written as Parquet and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillflow.llm import bpe, decontaminate, simhash, toxicity
from tillflow.llm.frames import settings, table
from tillflow.session import written


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier rejects."""
    return toxicity.drop_toxic(docs, table(settings(spark), sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    settings(spark)
    return simhash.drop_near_duplicates(docs)


def keep_unseen_by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(settings(spark), sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    settings(spark)
    return bpe.encode_documents(docs)


STAGES = [("toxicity", keep_civil), ("simhash", keep_one_of_near_copies),
          ("decontaminate", keep_unseen_by_benchmark), ("bpe", encode)]

# the classifier of the first stage cannot be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(settings(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
