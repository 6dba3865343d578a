"""Queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import bpe, exact_dedup, fingerprint, html_text, merkle, mixing, near_dedup, pii, prefix_trie, quality, sharding, simhash_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.query,
        "op2_byte_bpe": bpe.query,
        "op3_exact_dedup": exact_dedup.query,
        "op4_quality": quality.query,
        "op5_sharding": sharding.query,
        "op6_mixing": mixing.query,
        "op7_toxicity": toxicity.query,
        "op8_html_text": html_text.query,
        "op9_fingerprint": fingerprint.query,
        "op10_near_dedup": near_dedup.query,
        "op11_merkle": merkle.query,
        "op12_simhash_dedup": simhash_dedup.query,
        "op13_prefix_trie": prefix_trie.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact_dedup.ORACLE,
        "op6_mixing": mixing.ORACLE,
        "op11_merkle": merkle.ORACLE,
        "op13_prefix_trie": prefix_trie.ORACLE,
    }
