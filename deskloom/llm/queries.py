"""One registered query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deskloom.llm import prefix_trie, quality, repair, word_bpe
from deskloom.llm.common import documents
from deskloom.llm.jaccard import jaccard_components
from deskloom.llm.language import identify
from deskloom.llm.leaks import benchmark_leaks
from deskloom.llm.licenses import license_notices
from deskloom.llm.passages import repeated_passages
from deskloom.llm.pieces import encoding_digests
from deskloom.llm.pii import private_spans
from deskloom.llm.secrets import secret_spans
from deskloom.llm.token_ids import token_id_files


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    return license_notices(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages that other documents have too, and what of them is to go."""
    return repeated_passages(documents(spark, sf_dir))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, exact or with a few edits."""
    return benchmark_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents, written as patched blocks and read back."""
    return token_id_files(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the byte network."""
    return identify(documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under the 4-word Jaccard join at 0.85."""
    return jaccard_components(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: fixed patterns and literals assigned to telling names."""
    return secret_spans(documents(spark, sf_dir))


def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document and the terms near it that disclose it."""
    return private_spans(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures of every document and the verdict of line-first cleaning."""
    return quality.quality_figures(documents(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces and back."""
    return encoding_digests(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and the cheapest edits that mend its structure."""
    rows = repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair.repair_figures(rows, gone="gone")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in byte-level BPE ids and back."""
    return word_bpe.encoding_digests(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    return prefix_trie.trie_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    f.__name__: f for f in (op1_license_scan, op2_substring_dedup, op3_benchmark_leaks, op4_token_id_files, op5_language_id, op6_jaccard_join, op7_secret_scan, op8_private_data, op9_quality_rules, op10_sentencepiece, op11_conversation_repair, op12_byte_bpe, op13_prefix_trie)
}
SQL: dict[str, str] = {
    "op9_quality_rules": quality.SQL, "op11_conversation_repair": repair.SQL, "op13_prefix_trie": prefix_trie.SQL,
}
