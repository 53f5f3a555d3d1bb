"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from augsearch.llm import bpe, chat, embedding_dedup, exact_dedup, langid, lexical, ngram_join, packing, quality, shards, spelling, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.query,
        "op2_embedding_dedup": embedding_dedup.query,
        "op3_language_id": langid.query,
        "op4_toxicity": toxicity.query,
        "op5_best_fit_packing": packing.query,
        "op6_suffix_dedup": suffix_dedup.query,
        "op7_byte_bpe": bpe.query,
        "op8_chat_format": chat.query,
        "op9_ngram_jaccard_join": ngram_join.query,
        "op10_training_shards": shards.query,
        "op11_lexical_search": lexical.query,
        "op12_spelling_variants": spelling.query,
        "op13_quality_rules": quality.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op8_chat_format": chat.SQL, "op11_lexical_search": lexical.SQL, "op12_spelling_variants": spelling.SQL}
