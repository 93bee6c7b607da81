"""Queries of the quality rules and the quality classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulake.llm import quality_rules, rule_ensemble
from granulake.llm.fitting import fold
from granulake.llm.registry import query, table

SCORE = 0.3


@query("op7_quality_rules")
def op7(spark, sf_dir):
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, rules, [F.col("doc_id")]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    """Quality score of every document; a fifth of the labels is held out."""
    docs = table(spark, sf_dir, "documents")
    model = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return rule_ensemble.scored(docs, model, [F.col("doc_id")]).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= SCORE).cast("int").alias("predicted"),
    )
