"""The registered queries of this subpackage: one for each operator, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reelspan.llm import class_lm, decontaminate, html_text, licenses, ngram_join, packing, pii, prefix_trie, quality, tiff, token_blocks, token_counts, whitening
from reelspan.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents leak."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the class bigram model."""
    return class_lm.score(table(spark, sf_dir, "documents"))


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.detect(table(spark, sf_dir, "documents")).drop("redacted")


def op4_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as TIFF pages, read back by the page operator and digested."""
    stored = tiff.encode_pages(table(spark, sf_dir, "documents"))
    return tiff.page_digests(tiff.decode_pages(stored, carry=("n_bytes",)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by the rule ensemble."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license statements in all documents."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-copy components of all documents."""
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents, written in token blocks and read back."""
    return token_blocks.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened along their first components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {f.__name__: f for f in (op1_decontaminate, op2_class_lm, op3_pii_spans, op4_tiff_pages, op5_quality_rules, op6_token_counts, op7_html_text, op8_license_scan, op9_ngram_join, op10_packing, op11_token_blocks, op12_prefix_trie, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return {}
