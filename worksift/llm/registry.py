"""The registered queries of this subpackage with their production parameters, and SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from worksift.llm import forest, idfiles, merkle, pieces, quality, repeats, ring, rules, sql, tiles, urls, variants, warc, winnow
from worksift.llm.common import small_batches, table

# Host, path, verdict.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
END_ID = 2
BYTE_VOCABULARY = 50_257


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 64)
    return repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return idfiles.read(
        idfiles.write(docs, tokenizer_file("byte_bpe_50k.json"), byte_pattern(), BYTE_VOCABULARY, END_ID)
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return forest.groups(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).drop("reasons")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 256)
    return warc.read(warc.write(table(spark, sf_dir, "pages"), least=0))


def op8_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard(table(spark, sf_dir, "documents"), shards=8, copies=64)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).drop("text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 64)
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return tiles.join(table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_arrays,
        op2_sentencepiece,
        op3_id_files,
        op4_url_filters,
        op5_minhash_forest,
        op6_quality_rules,
        op7_warc,
        op8_ring_shards,
        op9_decontamination,
        op10_quality_classifier,
        op11_merkle_manifest,
        op12_spelling_variants,
        op13_jaccard_tiles,
    )
}
LLM_ORACLES: dict[str, str] = {
    "op1_suffix_arrays": sql.OP1,
    "op4_url_filters": sql.OP4,
    "op5_minhash_forest": sql.OP5,
    "op6_quality_rules": sql.OP6,
    "op9_decontamination": sql.OP9,
    "op11_merkle_manifest": sql.OP11,
    "op12_spelling_variants": sql.OP12,
    "op13_jaccard_tiles": sql.OP13,
}
