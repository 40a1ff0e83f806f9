"""The opN_ queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.base import documents
from tidewire.llm.sql import SQL  # noqa: F401


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.decontamination import leaks

    return leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "score", "start_word")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.ordinal import graded

    return graded(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.html_text import extract

    return extract(documents(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.rules import judged

    return judged(documents(spark, sf_dir), keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewire.llm.bpe import round_trip

    path = _tokenizer("byte_bpe_50k.tiktoken")
    tokens = round_trip(documents(spark, sf_dir).select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.substrings import without_repeats

    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.token_files import round_trip

    return round_trip(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), 2)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.shards import shards

    return shards(documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.pii import find

    found = find(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.token_counts import over

    return over(documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"), 4096).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.ranked_search import search

    return search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.divergence import audit

    return audit(documents(spark, sf_dir))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_rules": op5_quality_rules,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_files": op8_token_files,
    "op9_sharding": op9_sharding,
    "op10_pii": op10_pii,
    "op11_token_counts": op11_token_counts,
    "op12_ranked_search": op12_ranked_search,
    "op13_source_divergence": op13_source_divergence,
}

