"""Unattended run over a ticket file: load, triage what is left, log, reconcile, report.

    python -m deskloom.plans.harness --input tickets.json --docs documentation.json --output out
"""

from __future__ import annotations

import argparse
import sys
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from deskloom.operators import decision_log as dl
from deskloom.operators.metrics import flatten
from deskloom.plans.report import build_report, write_report
from deskloom.plans.triage import triage
from deskloom.session import build_session, ship_package
from deskloom.settings import Settings
from deskloom.sinks import artefacts as sk
from deskloom.sources.corpus import load_articles
from deskloom.sources.tickets import load_tickets

EXIT_OK, EXIT_NO_INPUT, EXIT_INCOMPLETE = 0, 2, 3


def _completed(spark: SparkSession, path: str) -> DataFrame | None:
    """Outcomes of earlier attempts, on any storage that Spark reads; none before the first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def run(
    spark: SparkSession, input_path: str, docs_path: str, output: str, *, limit: int | None = None,
    resume: bool = False, run_id: str | None = None, settings: Settings | None = None,
    models: tuple[str, ...] = (),
) -> dict:
    """One attempt. Outcomes are appended as one committed job, so an attempt counts whole or not.

    ``models``: folders of published fits, asked in order; what none of them has stays built in.
    """
    ship_package(spark)
    now = datetime.now(timezone.utc)
    run_id = run_id or f"run-{now:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:6]}"
    outcome_path, log_path, runs_path = (f"{output}/{n}" for n in ("outcomes", "decisions", "runs"))
    started = now.isoformat()
    tickets = load_tickets(spark, input_path)
    if limit:
        tickets = tickets.orderBy("position").limit(limit)
    sk.write_run_header(
        spark, runs_path, run_id=run_id, started_at=started, input_path=input_path, output_path=output
    )
    earlier = _completed(spark, outcome_path) if resume else None
    todo = tickets if earlier is None else dl.not_yet_done(tickets, earlier)
    decided = triage(
        todo, load_articles(spark, docs_path), settings, run_id=run_id, processed_at=F.lit(started),
        model=sk.load_answerability(spark, *models), calibration=sk.load_calibration(spark, *models),
    )
    decided.select(
        "run_id", "ticket_id", "position", "channel", "customer_tier", "region", "model_text",
        "classification", "retrieved", "action", "routing", "signals", "findings", "response_text",
        "citations", "escalation_package", "latency_seconds", "degraded", "error", "processed_at",
    ).write.mode("append" if resume else "overwrite").partitionBy("run_id").parquet(outcome_path)

    outcomes = spark.read.parquet(outcome_path)
    fresh = outcomes.filter(F.col("run_id") == run_id)
    sk.append_decisions(dl.decision_rows(fresh), log_path)
    # A resumed run is reconciled over all the attempts it consists of.
    attempts = outcomes.select("run_id").distinct()
    log = sk.read_decisions(spark, log_path).join(attempts, "run_id", "left_semi")
    processed = outcomes.agg(F.count("*").alias("tickets_processed")).withColumn("run_id", F.lit(run_id))
    reconciled = dl.reconcile(log.withColumn("run_id", F.lit(run_id)), processed)
    flat = flatten(outcomes).join(
        tickets.groupBy("ticket_id").agg(F.max("position").alias("ticket_ord")), "ticket_id", "left"
    )
    report = build_report(flat, tickets, reconciled, {"run_id": run_id, "started_at": started})
    write_report(report, output)
    n = report["volume"]["tickets_processed"]
    sk.write_run_header(
        spark, runs_path, run_id=run_id, started_at=started, input_path=input_path, output_path=output,
        finished_at=datetime.now(timezone.utc).isoformat(), ticket_count=n,
        notes=f"{n}/{report['run']['tickets_in_file']} tickets",
    )
    return report


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--input", required=True)
    parser.add_argument("--docs", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--limit", type=int)
    parser.add_argument("--resume", action="store_true")
    parser.add_argument("--run-id")
    parser.add_argument("--models", nargs="*", default=[], help="folders of published fits")
    args = parser.parse_args(argv)
    if "://" not in args.input and not Path(args.input).exists():
        print(f"no such input: {args.input}", file=sys.stderr)
        return EXIT_NO_INPUT
    report = run(
        build_session("deskloom-run"), args.input, args.docs, args.output, limit=args.limit,
        resume=args.resume, run_id=args.run_id, models=tuple(args.models),
    )
    return EXIT_OK if report["run"]["completed_fully"] else EXIT_INCOMPLETE


if __name__ == "__main__":
    raise SystemExit(main())
