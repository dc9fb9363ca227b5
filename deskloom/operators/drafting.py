"""Drafts from model replies, citation resolution and the escalation package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deskloom import lexicon as lx
from deskloom.functions.text import let, strip

MARKER = r"(?U)\[S\d+\]"


def resolve_markers(text: Column, passages: Column) -> Column:
    """struct(text, cited, dangling) for ``[S1]`` markers against the positional passages.

    Markers in range become chunk ids in order of first use; the others are removed from
    the text and reported. Spaces are tidied after removal.
    """
    count = F.coalesce(F.size(passages), F.lit(0))

    def number(marker: Column) -> Column:
        return F.regexp_extract(marker, r"(?U)(\d+)", 1).try_cast("int")

    def valid(marker: Column) -> Column:
        return F.coalesce(number(marker).between(1, count), F.lit(False))

    def resolved(markers: Column) -> Column:
        cited = F.array_distinct(
            F.transform(
                F.filter(markers, valid), lambda m: F.get(passages, number(m) - 1)["chunk_id"]
            )
        )
        dangling = F.filter(markers, lambda m: ~valid(m))
        cleaned = F.aggregate(
            F.array_distinct(dangling), text, lambda acc, m: F.replace(acc, m, F.lit(""))
        )
        cleaned = F.regexp_replace(cleaned, r"[ \t]{2,}", " ")
        cleaned = F.regexp_replace(cleaned, r"(?U)[\s\x1c-\x1f]+([.,;:!?])", "$1")
        return F.struct(
            strip(cleaned).alias("text"), cited.alias("cited"), dangling.alias("dangling")
        )

    return let(F.regexp_extract_all(text, F.lit(MARKER), F.lit(0)), resolved)


def draft(tickets: DataFrame) -> DataFrame:
    """Add ``draft`` (struct or null), ``draft_text``, ``declined`` and ``draft_degraded``.

    Reads ``reply`` (the drafting model's text; null means the provider was unavailable)
    and ``retrieved``. Without passages nothing is drafted and nothing is degraded.
    """
    reply = strip(F.col("reply"))
    has_sources = F.coalesce(F.size("retrieved"), F.lit(0)) > 0
    insufficient = F.upper(reply).startswith(lx.INSUFFICIENT)

    def built(text, cited, dangling, declined, method) -> Column:
        strings = "array<string>"
        return F.struct(
            text.alias("text"), cited.cast(strings).alias("citations"),
            dangling.cast(strings).alias("claims_without_support"),
            F.lit(declined).alias("admitted_uncertainty"), F.lit(method).alias("method"),
        )

    drafted = F.when(has_sources & reply.isNotNull() & (reply != ""), F.when(
        insufficient,
        built(F.lit(""), F.array(), F.array(), True, "declined_insufficient_context"),
    ).otherwise(
        let(
            resolve_markers(reply, F.col("retrieved")),
            lambda r: built(r["text"], r["cited"], r["dangling"], False, "llm"),
        )
    ))
    return (
        tickets.withColumn("draft", drafted)
        .withColumn("draft_text", F.col("draft.text"))
        .withColumn("declined", F.coalesce("draft.admitted_uncertainty", F.lit(False)))
        .withColumn("draft_degraded", has_sources & F.col("reply").isNull())
    )


def handover_note(subject: Column, body: Column, passages: Column, reason: Column, intent: Column,
                  urgency: Column) -> Column:
    """Four labelled lines that need no model."""
    subject, body = F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))
    words = strip(F.when(subject != "", subject).otherwise(body))
    first_line = F.get(F.split(words, r"\r\n|[\n\r]", 2), F.lit(0))
    known = F.array_join(
        F.transform(
            passages,
            lambda p: F.concat(
                p["title"],
                F.when(F.coalesce(p["section"], F.lit("")) != "",
                       F.concat(F.lit(" ("), p["section"], F.lit(")"))).otherwise(F.lit("")),
            ),
        ),
        "; ",
    )
    return F.concat(
        F.lit("WHAT THEY WANT: "),
        F.when(words == "", F.lit("the message holds no text")).otherwise(first_line),
        F.lit("\nWHAT WE KNOW: "),
        F.when(F.coalesce(F.size(passages), F.lit(0)) > 0, known)
        .otherwise(F.lit("no article of the documentation matches")),
        F.lit("\nWHY THIS CAME TO YOU: "), reason,
        F.lit("\nSUGGESTED FIRST STEP: Read the message beside what is listed here. Its category was taken to be "),
        intent, F.lit(", its urgency "), urgency, F.lit("."),
    )


def escalation_package(row_note: Column | None = None) -> Column:
    """The package that travels with an escalated or blocked ticket; null for an answered one.

    ``row_note`` is a model-written note where there is one.
    """
    note = handover_note(
        F.col("subject"), F.col("body"), F.col("retrieved"), F.col("routing.reason"),
        F.col("classification.intent"), F.col("classification.urgency"),
    )
    written = row_note if row_note is not None else F.lit(None).cast("string")
    has_draft = F.coalesce(F.col("draft_text") != "", F.lit(False))
    sources = F.transform(
        F.col("retrieved"),
        lambda p: F.struct(p["chunk_id"].alias("chunk_id"), p["doc_id"].alias("doc_id"),
                           p["title"].alias("title"), p["section"].alias("section"),
                           p["score"].alias("score")),
    )
    return F.when(
        F.col("routing.action").isin("escalate", "blocked"),
        F.struct(
            "ticket_id", "channel", "customer_tier",
            F.col("classification.intent").alias("intent"),
            F.col("classification.urgency").alias("urgency"),
            F.col("classification.confidence").alias("confidence"),
            F.col("routing.reason").alias("why_escalated"),
            sources.alias("suggested_sources"),
            F.coalesce(strip(written), note).alias("note"),
            F.when(written.isNotNull(), F.lit("llm")).otherwise(F.lit("deterministic")).alias("note_method"),
            F.when(has_draft, F.col("draft_text")).alias("draft_for_review"),
            F.when(has_draft, F.col("routing.action") == "blocked").alias("draft_blocked"),
        ),
    )
