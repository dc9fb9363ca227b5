"""The decision log: one flat row per decision, reconciliation, operations and audit reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deskloom.operators import quantiles


def decision_rows(outcomes: DataFrame) -> DataFrame:
    """Outcomes (still carrying their ticket's columns) as log rows."""
    names = F.transform(F.filter("findings", lambda f: f["triggered"]), lambda f: f["name"])
    no_findings = F.array().cast("array<struct<name:string>>")
    return outcomes.select(
        "run_id", "ticket_id", "processed_at", "channel", "customer_tier", "region",
        F.col("model_text").alias("input_text"),
        F.col("classification.intent").alias("predicted_intent"),
        F.col("classification.urgency").alias("predicted_urgency"),
        F.col("classification.confidence").alias("confidence"),
        F.col("classification.calibrated").alias("confidence_calibrated"),
        F.col("classification.method").alias("classification_method"),
        F.to_json("classification.alternatives").alias("alternatives"),
        F.to_json(F.transform("retrieved", lambda p: p["chunk_id"])).alias("sources_used"),
        F.get("retrieved", F.lit(0))["score"].alias("top_source_score"),
        F.size("retrieved").alias("retrieved_count"),
        "action", F.col("routing.rule_fired").alias("rule_fired"),
        F.coalesce("routing.reason", F.lit("")).alias("reason"),
        "response_text", F.to_json("citations").alias("citations"),
        F.coalesce(F.to_json(names), F.lit("[]")).alias("guardrails_triggered"),
        F.coalesce(F.exists("findings", lambda f: f["blocked"]), F.lit(False)).alias("guardrails_blocked"),
        F.coalesce(F.to_json("findings"), F.to_json(no_findings)).alias("guardrail_detail"),
        F.col("signals.grounding_score").alias("grounding_score"),
        "latency_seconds", "degraded", "error",
    )


def rows_of_run(log: DataFrame, run_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Oldest first within a run; newest first over the whole log. All rows unless a limit is asked for."""
    rows = log.orderBy(F.desc("id")) if run_id is None else log.filter(F.col("run_id") == run_id).orderBy("id")
    return rows if limit is None else rows.limit(limit)


def count(log: DataFrame, run_id: str | None = None) -> DataFrame:
    chosen = log if run_id is None else log.filter(F.col("run_id") == run_id)
    return chosen.agg(F.count("*").alias("n"))


def decisions_for(log: DataFrame, ticket_id: str) -> DataFrame:
    """All decisions about one ticket; the filter reaches the scan of the log."""
    return log.filter(F.col("ticket_id") == ticket_id)


def reconcile(log: DataFrame, processed: DataFrame) -> DataFrame:
    """Per run: does every processed ticket have exactly one decision?

    ``processed`` is (run_id, tickets_processed).
    """
    logged = log.groupBy("run_id").agg(
        F.count("*").alias("decisions_logged"),
        F.countDistinct("ticket_id").alias("distinct_tickets_logged"),
    )
    a, b, c = (F.col(n) for n in ("decisions_logged", "tickets_processed", "distinct_tickets_logged"))
    return (
        processed.join(logged, "run_id", "left")
        .fillna(0, ["decisions_logged", "distinct_tickets_logged"])
        .withColumn("reconciles", (a == b) & (b == c))
    )


def by_action(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id", "action").agg(F.count("*").alias("n"))


def per_run(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id").agg(
        F.count("*").alias("decisions"), F.countDistinct("ticket_id").alias("tickets")
    )


def operations(log: DataFrame) -> DataFrame:
    """Counters and nearest-rank p95 over the whole log, in one row. For a time span filter the log."""
    p95 = quantiles.nearest_rank(log, F.coalesce("latency_seconds", F.lit(0.0)), {"p95": 0.95})
    return log.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("action") == "answer").alias("answered"),
        F.count_if(F.col("action") == "escalate").alias("escalated"),
        F.count_if(F.col("action") == "blocked").alias("blocked"),
        F.count_if(F.col("degraded")).alias("degraded"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"),
    ).withColumn("p95_seconds", F.coalesce(p95.scalar(), F.lit(0.0)))


def blast_radius(log: DataFrame, intent: str, since: str) -> DataFrame:
    """Automated answers of one intent after a moment; ISO timestamps compare as text."""
    return log.filter(
        (F.col("action") == "answer")
        & (F.col("predicted_intent") == intent)
        & (F.col("processed_at") > since)
    )


def last_runs(headers: DataFrame, order: str = "updated_at") -> DataFrame:
    """Run headers where the last write per run wins."""
    rest = [c for c in headers.columns if c != "run_id"]
    return (
        headers.groupBy("run_id")
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("h"))
        .select("run_id", "h.*")
    )


def not_yet_done(tickets: DataFrame, done: DataFrame) -> DataFrame:
    """Tickets without an outcome from an earlier attempt."""
    return tickets.join(done.select("ticket_id").distinct(), "ticket_id", "left_anti")
