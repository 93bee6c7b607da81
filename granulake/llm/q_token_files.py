"""Query of the token files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from granulake.llm import token_files
from granulake.llm.registry import query, table
from granulake.session import cut, scratch

END = 2


@query("op5_token_files")
def op5(spark, sf_dir):
    """Every document's ids written to files and read back."""
    tokenizer = token_files.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"), END)
    path = scratch(spark, "token-files")
    token_files.write(cut(token_files.tokenize(table(spark, sf_dir, "documents"), tokenizer), "tokens"), path)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
