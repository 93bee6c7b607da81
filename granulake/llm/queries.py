"""Imports every query of this package."""

from importlib import import_module

PARTS = ("q_bpe", "q_licenses", "q_scoring", "q_jaccard", "q_token_files", "q_decontaminate", "q_quality", "q_language", "q_toxicity", "q_divergence", "q_token_counts", "q_conversations")


def load():
    """The registry with every query in it."""
    for part in PARTS:
        import_module(f"granulake.llm.{part}")
    return import_module("granulake.llm.registry")
