"""The whole triage of a set of tickets as one plan: classify, retrieve, draft, check, route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deskloom import lexicon as lx
from deskloom.functions.text import is_blank
from deskloom.operators import classify as cl
from deskloom.operators import drafting as dr
from deskloom.operators import guardrails as gr
from deskloom.operators import routing as rt
from deskloom.operators import search as se
from deskloom.operators.calibration import calibrator
from deskloom.operators.chunking import chunk_documents
from deskloom.operators.lexical import LexicalIndex
from deskloom.operators.vector_grounding import with_vector_grounding
from deskloom.session import cut_lineage
from deskloom.settings import Settings

PASSAGES = (
    "array<struct<rank:int,chunk_id:string,doc_id:string,title:string,text:string,score:double,"
    "section:string,url:string,dense_score:double,lexical_score:double>>"
)


def retrieve(
    tickets: DataFrame, articles: DataFrame, settings: Settings, chunks: DataFrame | None = None,
    index: LexicalIndex | None = None,
) -> DataFrame:
    """Add ``retrieved``: at most top-k passages per ticket, an empty array when none qualify.

    The query is the customer's text alone. Identical texts are searched once, so a message
    sent a million times costs one query. Queries carry a fixed-width id, which keeps the
    (query, chunk) sums narrow; ids are not deterministic, so the query table is written.
    """
    chunks = chunks if chunks is not None else chunk_documents(articles, settings.search)
    keyed = tickets.withColumn("_digest", F.sha2("model_text", 256))
    queries = cut_lineage(
        keyed.filter(~is_blank(F.col("model_text")))
        .groupBy("_digest")
        .agg(F.any_value("model_text").alias("text"))
        .withColumn("query_id", F.monotonically_increasing_id())
    )
    ranked = se.search_lexical(queries.select("query_id", "text"), chunks, settings.search, index=index)
    # Rankings get the digest while they are narrow, so passages are shuffled by it alone.
    ranked = ranked.join(queries.select("query_id", "_digest"), "query_id").drop("query_id")
    by_text = se.nest_passages(se.with_passages_from(ranked, articles, settings.search), "_digest")
    return (
        keyed.join(by_text, "_digest", "left")
        .withColumn("retrieved", F.coalesce("retrieved", F.array().cast(PASSAGES)))
        .drop("_digest")
    )


def decide(rows: DataFrame, settings: Settings | None = None, model: dict | DataFrame | None = None,
           calibrate=None, calibration: DataFrame | None = None, embed=None,
           chunk_vectors: DataFrame | None = None) -> DataFrame:
    """Classify, draft, check and route tickets that already carry ``retrieved``.

    ``calibration`` is a fit of one row, read as a scalar; it stands in for ``calibrate``.

    ``reply`` is the drafting model's text (null: provider unavailable). All of it happens
    inside the ticket's own row; only with ``embed`` and ``chunk_vectors`` do sentences leave it, to be
    judged by vectors (``with_vector_grounding``).
    """
    s = settings or Settings()
    if calibration is not None:
        rows = rows.withColumn("_fit", calibration.select(F.struct("*").alias("f")).scalar())
        calibrate = calibrator(F.col("_fit"))
    rows = cl.classify(rows, s, calibrate).drop("_fit")
    rows = dr.draft(rows)
    rows = rows.withColumn(
        "degraded",
        cl.is_fallback(F.col("classification.method")) | F.coalesce("draft_degraded", F.lit(False)),
    )
    if embed is not None and chunk_vectors is not None:
        rows = with_vector_grounding(rows, embed, chunk_vectors, s.guardrails)
    rows = gr.validate(rows, s)
    return rt.route(rows, s.routing, model)


def outcomes(
    rows: DataFrame, run_id: str = "adhoc", processed_at: Column | None = None,
    latency: Column | None = None, note: Column | None = None,
) -> DataFrame:
    """Decided rows as outcome rows: only an answered ticket with a draft carries a response."""
    send = (F.col("routing.action") == "answer") & F.coalesce(F.col("draft_text") != "", F.lit(False))
    strings = "array<string>"
    return rows.withColumns(
        {
            "action": F.col("routing.action"),
            "response_text": F.when(send, F.col("draft_text")),
            "citations": F.coalesce("draft.citations", F.array().cast(strings)),
            "escalation_package": dr.escalation_package(note),
            "latency_seconds": F.round(latency, 4) if latency is not None else F.lit(0.0),
            "error": F.lit(None).cast("string"),
            "run_id": F.lit(run_id),
            "processed_at": processed_at if processed_at is not None else F.lit(None).cast("string"),
        }
    )


def quarantine(rows: DataFrame, problem: Column) -> DataFrame:
    """Rows with a non-null ``problem`` become escalations that name it; nothing is dropped.

    What the plan worked out for such a row is not trusted: no class, passages, findings or citations.
    """
    failed = problem.isNotNull()
    routing = F.struct(
        F.lit("escalate").alias("action"), F.lit(lx.R11).alias("rule_fired"),
        F.lit("The ticket could not be processed and was passed to a person.").alias("reason"),
    )
    unknown = {"intent": "other", "urgency": "unknown", "confidence": 0.0, "raw_confidence": 0.0, "method": "pipeline_error"}
    judged = F.col("classification")
    for name, value in unknown.items():
        judged = judged.withField(name, F.lit(value))
    package = F.col("escalation_package")
    replaced = {
        "classification": judged.withField("alternatives", F.slice("classification.alternatives", 1, 0)),
        "retrieved": F.slice("retrieved", 1, 0),
        "citations": F.slice("citations", 1, 0),
        "findings": F.slice("findings", 1, 0),
        "draft_text": F.lit(None).cast("string"),
        "escalation_package": F.struct(
            "ticket_id", "channel", "customer_tier", F.lit("other").alias("intent"), F.lit("unknown").alias("urgency"),
            F.lit(0.0).alias("confidence"), F.lit("processing error").alias("why_escalated"),
            F.slice(package["suggested_sources"], 1, 0).alias("suggested_sources"),
            F.lit("This ticket could not be processed automatically.").alias("note"), F.lit("deterministic").alias("note_method"),
            F.lit(None).cast("string").alias("draft_for_review"), F.lit(None).cast("boolean").alias("draft_blocked"),
        ) if "escalation_package" in rows.columns else package,
    }
    return rows.withColumns(
        {
            "routing": F.when(failed, routing).otherwise(F.col("routing")),
            "action": F.when(failed, F.lit("escalate")).otherwise(F.col("action")),
            "response_text": F.when(~failed, F.col("response_text")),
            "degraded": failed | F.col("degraded"),
            "error": problem,
            **{name: F.when(failed, value).otherwise(F.col(name)) for name, value in replaced.items() if name in rows.columns},
        }
    )


def triage(
    tickets: DataFrame, articles: DataFrame, settings: Settings | None = None, *,
    run_id: str = "adhoc", model: dict | DataFrame | None = None, calibrate=None,
    calibration: DataFrame | None = None,
    chunks: DataFrame | None = None, index: LexicalIndex | None = None,
    processed_at: Column | None = None, embed=None, chunk_vectors: DataFrame | None = None,
) -> DataFrame:
    """Tickets with ``model_text``, ``ingest_warnings`` and optional ``reply`` to outcomes.

    A column ``problem`` (as ``with_guarded`` adds it) names what failed in a ticket's own row; such
    tickets are escalated with it and the others are not affected.
    """
    s = settings or Settings()
    if "reply" not in tickets.columns:
        tickets = tickets.withColumn("reply", F.lit(None).cast("string"))
    found = retrieve(tickets, articles, s, chunks, index)
    done = outcomes(decide(found, s, model, calibrate, calibration, embed, chunk_vectors), run_id, processed_at)
    return quarantine(done, F.col("problem")) if "problem" in tickets.columns else done
