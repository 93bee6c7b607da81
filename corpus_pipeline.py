"""Pipeline that turns `documents` into tokens: each stage works on all that the one before it kept.

Every stage but the last returns the columns of its input. Documents without an id cannot be named by the join, so
that stage keeps them; of rows that are equal in id and text it keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulake.llm import bpe, decontaminate, jaccard, quality_rules, toxicity
from granulake.llm.fitting import fold
from granulake.llm.q_bpe import vocabulary
from granulake.llm.q_toxicity import THRESHOLD
from granulake.llm.registry import table
from granulake.session import scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at the threshold or above go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity.drop_toxic(docs, model, THRESHOLD)


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest id stays."""
    return jaccard.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a whole window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and digests of the ids and of the bytes that they decode to."""
    return bpe.digest(docs, vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("quality rules", reject_bad),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", remove_contaminated),
    ("byte-level BPE", encode),
]

#: Learned models decide, which SQL cannot express; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number + 1 == len(STAGES):
            return out
        path = scratch(spark, f"stage-{number}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
