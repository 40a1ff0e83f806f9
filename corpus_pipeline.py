"""Training-data pipeline over ``documents``: quality rules, near-dedup, decontamination, redaction, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared
folder and read again as the next stage's docs; so a lost executor costs the work of one stage at most.
All but the last return the columns of ``documents``.

Defined cases, of every stage: an empty table gives no rows; columns other than those of ``documents`` are
dropped, so names can't clash; texts are read whole, whatever their length; repeated rows are treated alike.
The stages' docstrings say what becomes of nulls, empty texts and ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import bpe, decontamination, minhash, pii, rules
from tidewire.llm.base import documents, joinable, materialize
from tidewire.plans.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their group's thresholds. A null or empty text fails the base rule; a
    null language or source is a group of its own; a value equal to a threshold passes."""
    ship(spark)
    return rules.judged(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of least doc_id; rows of one doc_id are one document and stay
    or go together. A row without doc_id, and a text that is null, empty or without words, is no copy and stays."""
    ship(spark)
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(joinable(materialize(gone, "gone")), "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks. A null or empty text, or one without doc_id, is read like others
    and stays unless an item leaks into it; a score equal to the bound is a leak."""
    ship(spark)
    return decontamination.decontaminated(docs.select(*COLUMNS), documents(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in brackets; n_chars is that of the new text. A null text
    stays null and keeps its n_chars, an empty one stays empty. Where spans overlap, the first one's kind is shown."""
    ship(spark)
    redacted = pii.redact(docs.select(*COLUMNS))
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens, their ids, and whether the decoded bytes are the text again. A null text has no
    tokens, like an empty one. A null doc_id is passed on."""
    import public_tokenizers

    ship(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe.round_trip(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    same = F.coalesce(F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.lit(False))
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", redact_pii),
    ("byte-level BPE", tokenize),
]

#: SQL expresses neither the field of the PII stage nor the merges of the last one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
