"""Query of the toxicity models."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulake.llm import toxicity
from granulake.llm.fitting import fold
from granulake.llm.registry import query, table

THRESHOLD = 0.7


@query("op10_toxicity")
def op10(spark, sf_dir):
    """Toxicity of every document; a third of the labels is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, fold("doc_id", 3) != 1)
    return toxicity.scored(docs, model).select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
