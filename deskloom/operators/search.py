"""Ranked passages per query: relevance floor, per-document cap, top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deskloom.functions.scoring import saturate
from deskloom.functions.text import is_blank
from deskloom.operators import dense as dn
from deskloom.operators import lexical as lex
from deskloom.operators.chunking import chunk_documents
from deskloom.session import cut_lineage, shared_folder
from deskloom.settings import SearchSettings

KEY = lex.KEY
#: Found documents whose numbers are broadcast, some hundred bytes each.
BROADCAST_DOCUMENTS = 1_000_000


def take_ranked(scored: DataFrame, s: SearchSettings, floor: float | None = None) -> DataFrame:
    """Apply the floor, keep the best ``per_document`` chunks of each document, then the best ``top_k``.

    Both limits are applied before the shuffles, so few rows for each query travel.
    """
    floor = s.min_score if floor is None else floor
    order = [lex.settled(F.col("score")).desc(), *KEY]
    per_document = Window.partitionBy("query_id", "doc_ord").orderBy(*order)
    per_query = Window.partitionBy("query_id").orderBy(*order)
    return (
        scored.filter(F.col("score") >= floor)
        .withColumn("of_document", F.row_number().over(per_document))
        .filter(F.col("of_document") <= s.per_document)
        .withColumn("rank", F.row_number().over(per_query))
        .filter(F.col("rank") <= s.top_k)
        .drop("of_document")
    )


def _pad_with_zero_scores(scored: DataFrame, queries: DataFrame, chunks: DataFrame, s: SearchSettings):
    """Without a floor, chunks that match nothing rank after the others in corpus order.

    Fewer than ``top_k`` documents can be used up by matches where a filler is needed at all, and a
    document that is not has less than ``per_document`` matches. So the first chunks of the first
    2 * ``top_k`` documents are enough; they are read once as one array of fixed length.
    """
    first = chunks.select("doc_ord").distinct().orderBy("doc_ord").limit(2 * s.top_k)
    place = F.row_number().over(Window.partitionBy("doc_ord").orderBy("chunk_no"))
    head = (
        chunks.select(*KEY).join(first, "doc_ord").withColumn("place", place)
        .filter(F.col("place") < 2 * s.per_document)
        .agg(F.sort_array(F.collect_list(F.struct(*KEY))).alias("head"))
        .scalar()
    )
    filler = (
        queries.filter(~is_blank(F.col("text")))
        .select(F.col("query_id"), F.explode(head).alias("c"))
        .select("query_id", *[F.col(f"c.{k}").alias(k) for k in KEY])
        .join(scored.select("query_id", *KEY), ["query_id", *KEY], "left_anti")
    )
    zeros = [F.lit(0.0).alias(c) for c in scored.columns if c not in ("query_id", *KEY)]
    return scored.unionByName(filler.select("query_id", *KEY, *zeros))


def _unsaturated(score: Column, saturation: float) -> Column:
    """The BM25 score that saturates to ``score``; never reached from 1 on."""
    return F.when(score <= 0, F.lit(0.0)).when(score < 1, saturation * score / (1 - score)).otherwise(F.lit(1e300))


def search_lexical(
    queries: DataFrame, chunks: DataFrame, settings: SearchSettings | None = None,
    floor: float | None = None, index: lex.LexicalIndex | None = None, prune: bool = True,
) -> DataFrame:
    """Lexical-only ranking: (query_id, rank, chunk key, score, lexical), unrounded.

    ``queries`` is (query_id, text). Blank queries return nothing.
    """
    s = settings or SearchSettings()
    floor = s.min_score if floor is None else floor
    terms = cut_lineage(lex.query_terms(queries))
    index = index or lex.build_index(chunks, terms)
    least = terms.select("query_id").distinct().withColumn("at_least", _unsaturated(F.lit(float(floor)), s.saturation))
    scores = lex.bm25_scores(terms, index, s, s.top_k, least, s.per_document) if prune else lex.bm25_scores(terms, index, s)
    scored = scores.select("query_id", *KEY, saturate(F.col("bm25"), s.saturation).alias("lexical"))
    if floor <= 0:
        scored = _pad_with_zero_scores(scored, queries, chunks, s)
    return take_ranked(scored.withColumn("score", F.col("lexical")), s, floor)


def search_hybrid(
    queries: DataFrame, chunks: DataFrame, query_vectors: DataFrame, chunk_vectors: DataFrame,
    settings: SearchSettings | None = None, floor: float | None = None,
    index: lex.LexicalIndex | None = None,
) -> DataFrame:
    """Weighted sum of clamped cosine and saturated BM25, exactly, without scoring all pairs.

    The dense list holds the best ``dense_depth`` chunks of each query, ``per_document`` of a document
    at most. All matching chunks of its documents are scored at once; the ``top_k``-th best sum among
    them is a bound of the last ranked sum. A chunk of another document has no cosine above the
    last of the list, so its BM25 score must make up the rest of the bound; only such chunks are
    looked for, and vectors are fetched for what is left.
    """
    s = settings or SearchSettings()
    floor = s.min_score if floor is None else floor
    w, depth = s.dense_weight, s.dense_depth
    asked = queries.filter(~is_blank(F.col("text")))
    query_vectors = query_vectors.join(asked.select("query_id"), "query_id", "left_semi")
    cells = dn.build_cells(chunk_vectors)
    # A few rows for each query, read more than once.
    by_vector = cut_lineage(dn.nearest(query_vectors, cells, depth, per_document=s.per_document))
    if cells is not None:
        chunk_vectors = cells.celled
    terms = cut_lineage(lex.query_terms(queries))
    index = index or lex.build_index(chunks, terms)

    def lexical(scores: DataFrame) -> DataFrame:
        return scores.select("query_id", *KEY, saturate(F.col("bm25"), s.saturation).alias("lexical"))

    near = lexical(lex.bm25_within(terms, index, by_vector.select("query_id", "doc_ord").distinct(), s))
    pairs = by_vector.select("query_id", *KEY).union(near.select("query_id", *KEY)).distinct().join(
        near, ["query_id", *KEY], "left"
    ).fillna(0.0, ["lexical"])
    total = w * F.col("dense") + (1 - w) * F.col("lexical")
    close = cut_lineage(dn.score_pairs(pairs, query_vectors, chunk_vectors))
    order = [F.desc("score"), *KEY]
    ranked = (
        close.withColumn("score", total)
        .withColumn("n", F.row_number().over(Window.partitionBy("query_id", "doc_ord").orderBy(*order)))
        .filter(F.col("n") <= s.per_document)
        .withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
        .filter(F.col("n") == s.top_k).select("query_id", F.col("score").alias("bound"))
    )
    last = by_vector.groupBy("query_id").agg(
        F.when(F.count("*") >= depth, F.min("dense")).otherwise(F.lit(0.0)).alias("last_dense")
    )
    # What BM25 has to bring where the vector brings no more than the end of the list.
    missing = (F.coalesce("bound", F.lit(0.0)) - w * F.coalesce("last_dense", F.lit(0.0)) - lex.BOUND_SLACK) / (1 - w)
    least = terms.select("query_id").distinct().join(ranked, "query_id", "left").join(last, "query_id", "left").select(
        "query_id", _unsaturated(missing, s.saturation).alias("at_least")
    )
    least = cut_lineage(least)
    matches = lexical(
        lex.bm25_scores(terms, index, s, None, least).join(least, "query_id").filter(
            F.col("bm25") * (1 + lex.BOUND_SLACK) + lex.BOUND_SLACK >= F.col("at_least")
        )
    )
    far = matches.join(close.select("query_id", *KEY), ["query_id", *KEY], "left_anti")
    scored = close.unionByName(dn.score_pairs(far, query_vectors, chunk_vectors))
    if floor <= 0:
        scored = _pad_with_zero_scores(scored, queries, chunks, s)
    return take_ranked(scored.withColumn("score", total), s, floor)


def with_passages(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Join chunk identity and text, and round scores for output."""
    scores = [c for c in ("score", "dense", "lexical") if c in ranked.columns]
    return (
        ranked.join(chunks, KEY)
        .withColumns({c: F.round(c, 4) for c in scores})
        .withColumnRenamed("dense", "dense_score")
        .withColumnRenamed("lexical", "lexical_score")
    )


def with_passages_from(ranked: DataFrame, articles: DataFrame, settings: SearchSettings | None = None):
    """Like :func:`with_passages`, but cuts only the articles that were found, and only their ranked chunks leave them.

    The ranking is a few rows per query and is read more than once, so it is written down first, in Parquet.
    Its documents, with the numbers of their ranked chunks, are broadcast while there are no more than
    ``BROADCAST_DOCUMENTS``, and then no article is shuffled.
    """
    path = shared_folder(ranked.sparkSession, "ranked")
    ranked.write.parquet(path)
    ranked = ranked.sparkSession.read.parquet(path)
    wanted = ranked.groupBy("doc_ord").agg(F.collect_set("chunk_no").alias("ranked_chunks"))
    if ranked.select("doc_ord").distinct().count() <= BROADCAST_DOCUMENTS:
        wanted = F.broadcast(wanted)
    chunks = chunk_documents(articles.join(wanted, "doc_ord", "left_semi"), settings)
    is_ranked = (chunks["doc_ord"] == wanted["doc_ord"]) & F.array_contains(wanted["ranked_chunks"], chunks["chunk_no"])
    return with_passages(ranked, chunks.join(wanted, is_ranked, "left_semi"))


def nest_passages(passages: DataFrame, query: str = "query_id") -> DataFrame:
    """One row per query with an array of at most ``top_k`` passages in rank order."""
    dense_score: Column = (
        F.col("dense_score") if "dense_score" in passages.columns else F.lit(None).cast("double")
    )
    passage = F.struct(
        "rank", "chunk_id", "doc_id", "title", "text", "score",
        F.when(F.col("section") != "", F.col("section")).alias("section"),
        "url", dense_score.alias("dense_score"), "lexical_score",
    )
    return passages.groupBy(query).agg(F.sort_array(F.collect_list(passage)).alias("retrieved"))


def resolve_citations(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Follow (…, chunk_id) back to the chunk it names; dangling citations are dropped."""
    return citations.join(chunks, "chunk_id")


#: Chunks of one bucket of a chunk table, about.
CHUNKS_PER_BUCKET = 200_000


def write_chunk_table(chunks: DataFrame, path: str, table: str, buckets: int | None = None) -> DataFrame:
    """Chunks under ``path`` as a table in buckets by ``chunk_id``, sorted inside them.

    Lookups by ``chunk_id`` (:func:`resolve_citations`) then move the citations alone. The number of
    buckets grows with the corpus, so a bucket stays what one task can sort and read.
    """
    spark = chunks.sparkSession
    if buckets is None:
        # Cut twice rather than kept twice: a copy of all text takes more disk than the table.
        buckets = max(spark.sparkContext.defaultParallelism, -(-chunks.count() // CHUNKS_PER_BUCKET))
    # One task a bucket writes one file a bucket.
    chunks.repartition(buckets, "chunk_id").write.bucketBy(buckets, "chunk_id").sortBy("chunk_id").option(
        "path", path
    ).saveAsTable(table)
    return spark.table(table)


def index_summary(chunks: DataFrame, dense_available: bool = False) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents")
    ).withColumn("dense_available", F.lit(dense_available))
