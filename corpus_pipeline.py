"""A corpus pipeline: toxicity, repeated lines, near copies, benchmark passages, packing.

Each stage is a function of the session, the documents that its predecessor kept
and the folder of tables.  All but the last return the columns of ``documents``.

In every stage a null text counts as empty and texts of any length are read
whole; repeated rows and rows with one id are treated alike, but that near copies
keeps one of equal rows; further columns are passed on under their names, whatever
an operator adds; no rows give no rows.  Ties: of near copies the smallest id stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.common import materialize, table

TOXIC_AT = 0.7


def _apart(docs: DataFrame) -> DataFrame:
    """The documents with all columns but id and text under names that no operator adds."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"_{i}") for i, c in enumerate(docs.columns)])


def _again(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names, from what an operator made of ``_apart``."""
    return kept.select(*[F.col("`" + (c if c in ("doc_id", "text") else f"_{i}") + "`").alias(c) for i, c in enumerate(docs.columns)])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under TOXIC_AT stay."""
    from graphlake.llm.toxicity import score_toxicity, train_classifier

    classifier = train_classifier(docs, table(spark, sf_dir, "labels"))
    return _again(score_toxicity(_apart(docs), classifier).filter(F.col("score") < TOXIC_AT), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; the other lines of a document stay."""
    from graphlake.llm.line_dedup import dedup_lines

    kept = _again(dedup_lines(_apart(docs)), docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    from graphlake.llm.ngram_join import keep_one

    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of any benchmark item occurs go."""
    from graphlake.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with the checksum of their ids."""
    from graphlake.llm.packing import pack_documents
    from graphlake.llm.registry import tokenizer_path

    packed = pack_documents(docs, tokenizer_path())
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
