"""Query of the token counts."""

from __future__ import annotations

import public_tokenizers

from granulake.llm import token_counts
from granulake.llm.registry import query, table


@query("op12_token_counts")
def op12(spark, sf_dir):
    """Bytes and tokens of every document, and whether it is over the limit."""
    merges = token_counts.load_merges(public_tokenizers.path("byte_bpe_50k.json"))
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), merges, limit=1024)
    return counted.select("kept.doc_id", "n_bytes", "n_tokens", "over_limit")
