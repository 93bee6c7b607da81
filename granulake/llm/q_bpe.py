"""Query of byte-level BPE encoding and decoding."""

from __future__ import annotations

import public_tokenizers

from granulake.llm import bpe
from granulake.llm.registry import query, table


def vocabulary() -> bpe.Vocabulary:
    return bpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op1_byte_bpe")
def op1(spark, sf_dir):
    """Ids of every document, and the bytes that they decode to."""
    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary())
