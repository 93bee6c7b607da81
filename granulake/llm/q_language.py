"""Query of language identification."""

from __future__ import annotations

from granulake.llm import language
from granulake.llm.fitting import fold
from granulake.llm.registry import query, table


@query("op8_language_id")
def op8(spark, sf_dir):
    """Language of every document; a quarter of the documents is held out."""
    docs = table(spark, sf_dir, "documents")
    network = language.fit(docs, fold("doc_id", 4) != 2)
    return language.predict(docs, network).select(
        "kept.doc_id", (fold("kept.doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )
