"""The corpus pipeline: raw documents to token ids, one operator per stage.

Columns besides ``doc_id`` and ``text`` travel as one, so they may have any names.
Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. ``run``
writes each stage's result to the shared folder and reads it again, so a lost executor costs a
stage's tasks and not the stages before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksift.llm import forest, pieces, quality, repeats, winnow
from worksift.llm.common import packed, small_batches, table, unpacked
from worksift.llm.registry import tokenizer_file
from worksift.plans.storage import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id. Near copies share
    0.8 of their strings of five words or more."""
    small_batches(spark)
    return forest.deduplicate(docs, forest.AT_80)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that came earlier are cut from the texts."""
    small_batches(spark, 64)
    return repeats.cleaned(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    return winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))


MADE = ("ids", "starts", "ends", "n_tokens", "decoded_sha256")  # columns of the last stage's own


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns but the text, with its ids, the original bytes each stands for, their number
    and the decoded text's digest. A column of ``docs`` that is called like one of these gives way to it."""
    small_batches(spark)
    encoded = pieces.encode(packed(docs.drop(*MADE)), tokenizer_file("piece_bpe_32k.model")).withColumns(
        {"n_tokens": F.size("ids").cast("bigint"), "decoded_sha256": F.sha2("decoded", 256)}
    )
    kept = docs.drop("text", *MADE)
    return unpacked(encoded, docs.drop(*MADE), MADE).select(*[F.col(f"`{c}`") for c in (*kept.columns, *MADE)])


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


ORACLE_SQL = None  # a fitted classifier and the library's pieces are not expressible in SQL
