"""Streaming front end: tickets in, decisions out, windowed counts, a stateful breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from deskloom.operators.chunking import chunk_documents
from deskloom.operators.decision_log import decision_rows
from deskloom.operators.lexical import build_index
from deskloom.plans.triage import triage
from deskloom.settings import ProviderSettings, Settings


def triage_stream(
    tickets: DataFrame, articles: DataFrame, log_path: str, checkpoint: str,
    settings: Settings | None = None, run_id: str = "stream", trigger: dict | None = None,
):
    """Run the batch triage on every micro-batch and append its decisions.

    Ranking needs windows over all passages of a ticket, which is a batch notion; the
    micro-batch is that batch. The batch id names its output folder, so a replayed batch
    overwrites itself and no decision is logged twice. The documentation is indexed once, when
    the stream starts.
    """
    s = settings or Settings()
    chunks = chunk_documents(articles, s.search)
    index = build_index(chunks)

    def write(batch: DataFrame, batch_id: int) -> None:
        decided = triage(
            batch, articles, s, run_id=run_id, chunks=chunks, index=index,
            processed_at=F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
        )
        decision_rows(decided).write.mode("overwrite").parquet(
            f"{log_path}/run_id={run_id}/batch={batch_id}"
        )

    writer = tickets.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(decisions: DataFrame, ts: str = "ts", width: str = "5 minutes", late: str = "10 minutes"):
    """Decisions by action per event-time window, late rows up to the watermark included."""
    return (
        decisions.withWatermark(ts, late)
        .groupBy(F.window(ts, width), "action")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), "action", "n")
    )


def first_decisions(decisions: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Decisions without repeats of a ticket inside the watermark."""
    return decisions.withWatermark(ts, late).dropDuplicatesWithinWatermark(["ticket_id"])


def undecided_tickets(
    tickets: DataFrame, decisions: DataFrame, *, within: str = "30 minutes", late: str = "10 minutes",
    received: str = "received_at", decided: str = "processed_at",
) -> DataFrame:
    """Tickets of a stream (columns as they are) without a decision in ``within`` of their receipt.

    The reconciliation of a run, on streams: a left outer join of tickets and decisions on ``ticket_id``
    whose state is bounded by the watermarks of both sides. A ticket comes out once ``late`` has passed
    after its time was up; a decision later than that no longer counts, a second one changes nothing. A
    repeated ticket is reported as often as it came in. A ticket without an id or a time of receipt can
    have no decision and comes out at once.
    """
    lacking = F.col("ticket_id").isNull() | F.col(received).isNull()
    came = tickets.filter(~lacking).withWatermark(received, late).alias("t")
    done = decisions.select(
        F.col("ticket_id").alias("_decided_id"), F.col(decided).alias("_decided_at")
    ).filter("_decided_id IS NOT NULL AND _decided_at IS NOT NULL").withWatermark("_decided_at", late)
    in_time = (F.col("_decided_at") >= F.col(f"t.{received}")) & (
        F.col("_decided_at") <= F.col(f"t.{received}") + F.expr(f"INTERVAL {within}")
    )
    joined = came.join(done, (F.col("t.ticket_id") == F.col("_decided_id")) & in_time, "left")
    open_ = joined.filter("_decided_id IS NULL").drop("_decided_id", "_decided_at")
    return open_.unionByName(tickets.filter(lacking))


BREAKER_OUTPUT = "provider string, ts timestamp, call_id long, allowed boolean, opened boolean, failures int"
BREAKER_STATE = "failures int, opened_at double"


def breaker_step(failures: int, opened_at: float, now: float, failed: bool, threshold: int,
                 cooldown: float) -> tuple[int, float, bool, bool]:
    """One call through the breaker: (failures, opened_at, allowed, opened now).

    An open breaker refuses calls until the cooldown has passed, then forgets the failures
    and lets one through. ``opened_at`` below zero means closed.
    """
    if opened_at >= 0:
        if now - opened_at < cooldown:
            return failures, opened_at, False, False
        failures, opened_at = 0, -1.0
    if not failed:
        return 0, -1.0, True, False
    failures += 1
    if failures >= threshold:
        return failures, now, True, True
    return failures, opened_at, True, False


def circuit_breaker(calls: DataFrame, settings: ProviderSettings | None = None) -> DataFrame:
    """(provider, ts, call_id, failed) stream to allowed and refused calls per provider."""
    s = settings or ProviderSettings()

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, opened_at = state.get if state.exists else (0, -1.0)
        for batch in batches:
            batch = batch.sort_values(["ts", "call_id"])
            out = []
            for row in batch.itertuples(index=False):
                now = row.ts.timestamp()
                failures, opened_at, allowed, opened = breaker_step(
                    failures, opened_at, now, bool(row.failed), s.breaker_threshold, s.breaker_cooldown
                )
                out.append((key[0], row.ts, row.call_id, allowed, opened, failures))
            yield pd.DataFrame(
                out, columns=["provider", "ts", "call_id", "allowed", "opened", "failures"]
            )
        state.update((int(failures), float(opened_at)))

    return calls.groupBy("provider").applyInPandasWithState(
        advance, BREAKER_OUTPUT, BREAKER_STATE, "append", GroupStateTimeout.NoTimeout
    )
