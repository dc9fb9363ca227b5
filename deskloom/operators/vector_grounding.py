"""Grounding by vectors: every sentence of a draft against the passages found for its ticket.

A draft is judged once however often it was written, under the digest of its text and its passages.
Sentences are rows of their own; each carries the vectors of at most top-k passages to the Arrow batch
that multiplies them, so neither a long draft nor a chatty ticket becomes one large row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from deskloom.functions.text import is_blank, substantive_sentences
from deskloom.operators.guardrails import NO_STRINGS
from deskloom.session import cut_lineage
from deskloom.settings import GuardrailSettings

#: Sentences whose products are held at once.
TOGETHER = 512
SUPPORT = "draft string, sentence_no int, sentence string, support double"


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Vectors of equal length, one a row."""
    flat = column.flatten()
    while pa.types.is_list(flat.type) or pa.types.is_large_list(flat.type):
        flat = flat.flatten()
    return _unit(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1))


def _best_support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for low in range(0, whole.num_rows, TOGETHER):
            batch = whole.slice(low, TOGETHER)
            passages = batch.column("passages")
            counts = passages.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            support = np.zeros(batch.num_rows)
            sizes = batch.column("vec").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):  # one embedding model has one size; more are handled apart
                at = np.flatnonzero(sizes == size)
                picked = pa.array(at)
                sentences = _matrix(batch.column("vec").take(picked), len(at))
                sources = _matrix(passages.take(picked), int(counts[at].sum()))
                products = np.einsum("ij,ij->i", np.repeat(sentences, counts[at], axis=0), sources)
                support[at] = np.maximum.reduceat(products, np.cumsum(counts[at]) - counts[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("draft"), batch.column("sentence_no"), batch.column("sentence"), pa.array(support)],
                ["draft", "sentence_no", "sentence", "support"],
            )


def _draft_key(text: Column, chunk_ids: Column) -> Column:
    return F.sha2(F.to_json(F.struct(text.alias("text"), chunk_ids.alias("chunks"))), 256)


def with_vector_grounding(
    drafts: DataFrame, embed: Callable[[DataFrame], DataFrame], chunk_vectors: DataFrame,
    settings: GuardrailSettings | None = None,
) -> DataFrame:
    """Add ``vector_grounding``: struct(ratio, unsupported, method), or null where words must decide.

    ``drafts`` has ``draft_text`` and ``retrieved``; ``embed`` takes the distinct sentences (``text``)
    and returns (``text``, ``vec``); ``chunk_vectors`` is (``chunk_id``, ``vec``), one row each. A sentence
    is supported when its best cosine with a passage reaches ``support_dense``. A draft is judged by
    words as a whole when a sentence or passage of it has no vector, an empty one or one of another
    size than the others; so is one without passages or without a substantive sentence. A vector of
    zeros supports nothing. Of several vectors for one sentence or chunk any one is taken.
    """
    s = settings or GuardrailSettings()
    ids = F.transform(F.coalesce("retrieved", F.slice("retrieved", 1, 0)), lambda p: p["chunk_id"])
    rows = cut_lineage(drafts.withColumn("_draft", _draft_key(F.col("draft_text"), ids)))
    judged = (
        rows.filter(~is_blank(F.col("draft_text")) & (F.size("retrieved") > 0))
        .select(F.col("_draft").alias("draft"), "draft_text", F.array_distinct(ids).alias("chunk_ids"))
        .dropDuplicates(["draft"])
    )
    claims = judged.select(
        "draft", F.posexplode(substantive_sentences(F.col("draft_text"))).alias("sentence_no", "sentence")
    )
    vectors = embed(claims.select(F.col("sentence").alias("text")).distinct())
    vectors = vectors.select(F.col("text").alias("sentence"), "vec").dropDuplicates(["sentence"])
    wanted = judged.select("draft", F.explode("chunk_ids").alias("chunk_id"))
    # Only vectors of found passages are moved; Spark takes the others out before it looks them up.
    asked = chunk_vectors.select("chunk_id", "vec").join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi")
    found = wanted.join(asked.dropDuplicates(["chunk_id"]), "chunk_id", "left")
    size = F.coalesce(F.size("vec"), F.lit(0))
    sources = found.groupBy("draft").agg(  # at most top-k vectors a draft
        F.collect_list("vec").alias("passages"), F.min(size).alias("least"), F.max(size).alias("most")
    )
    pairs = claims.join(vectors, "sentence", "left").join(sources, "draft")
    fits = (F.col("least") > 0) & (F.col("least") == F.col("most")) & (size == F.col("least"))
    usable = fits & F.forall("vec", lambda x: x.isNotNull()) & F.forall(
        "passages", lambda p: F.forall(p, lambda x: x.isNotNull())
    )
    pairs = pairs.withColumn("usable", F.coalesce(usable, F.lit(False)))
    support = pairs.filter("usable").select("draft", "sentence_no", "sentence", "vec", "passages").mapInArrow(
        _best_support, SUPPORT
    )
    unusable = pairs.filter("NOT usable").select("draft", "sentence_no", "sentence", F.lit(None).cast("double").alias("support"))
    weak = F.col("support") < s.support_dense
    verdicts = support.unionByName(unusable).groupBy("draft").agg(
        F.count("*").alias("n"), F.count_if(weak).alias("n_weak"), F.count("support").alias("n_usable"),
        F.collect_list(F.when(weak, F.struct("sentence_no", "sentence"))).alias("weak"),
    )
    verdict = F.struct(
        F.round(1.0 - F.col("n_weak") / F.col("n"), 4).alias("ratio"),
        F.transform(F.sort_array("weak"), lambda w: w["sentence"]).cast(NO_STRINGS).alias("unsupported"),
        F.lit("embedding").alias("method"),
    )
    by_draft = verdicts.filter("n_usable = n").select(F.col("draft").alias("_draft"), verdict.alias("vector_grounding"))
    return rows.join(by_draft, "_draft", "left").drop("_draft")
