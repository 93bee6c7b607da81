"""Query of the language-model scores."""

from __future__ import annotations

from granulake.llm import scoring
from granulake.llm.registry import query, table


@query("op3_lm_scoring")
def op3(spark, sf_dir):
    """Masked pseudo-likelihood of every document."""
    docs = table(spark, sf_dir, "documents")
    return scoring.fit_score(docs).select("kept.doc_id", "n_words", "log_likelihood", "per_word")
