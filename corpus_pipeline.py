"""Documents to training ids: language, copies, benchmark passages, secrets, pieces.

Each stage takes the documents that its predecessor kept and returns the columns of ``documents``;
the last returns the encoded documents. Tables between the stages are Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deskloom.llm import jaccard, language, leaks, pieces, secrets
from deskloom.llm.common import documents, shared_folder
from deskloom.llm.queries import tokenizer_file
from deskloom.session import ship_package

#: Near duplicates share so many percent of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: A document stays when its language is found with at least this score.
MIN_SCORE = 0.3
#: Characters of chunks that a worker of the last stage keeps; it also holds what the stages before left.
KNOWN_CHARS = 2_000_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network finds; texts without a letter or with no clear language go."""
    ship_package(spark)
    return language.keep_known(docs, language.fit(docs), min_score=MIN_SCORE)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of the Jaccard join; rows without an id stay.

    Rows are told apart by id and text, so an id that stands for several texts loses duplicates alone.
    """
    ship_package(spark)
    return jaccard.one_of_each(docs, k=NEAR_WORDS, percent=NEAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    ship_package(spark)
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every character of a secret replaced."""
    ship_package(spark)
    return secrets.mask(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the documents in pieces."""
    ship_package(spark)
    return pieces.encoding_digests(docs, tokenizer_file("piece_bpe_32k.model"), known_chars=KNOWN_CHARS)


STAGES = [
    ("language", known_language),
    ("near duplicates", one_of_each),
    ("benchmark passages", without_benchmark),
    ("secrets", masked_secrets),
    ("pieces", encoded),
]

#: SQL has neither the network nor the encoder; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table of documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
