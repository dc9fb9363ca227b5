"""Metrics report: one small frame per section, assembled to JSON and Markdown at the sink."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from deskloom import lexicon as lx
from deskloom.operators import metrics as m

#: Rows that the report shows of tables that can be long.
LISTED, TOPICS, EXAMPLES = 20, 10, 25


def _one(df: DataFrame) -> dict:
    row = df.first()
    return row.asDict(recursive=True) if row is not None else {}


def _many(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def build_report(
    outcomes: DataFrame, tickets: DataFrame, reconciliation: DataFrame | None = None,
    run: dict | None = None, taxonomy=lx.TAXONOMY,
) -> dict:
    """All sections from flat outcomes (with ``ticket_ord``) and normalised tickets.

    Every frame collected here has a bounded number of rows: one, one per category, or a
    top-k list.
    """
    gold = m.with_gold(tickets)
    rows = m.joined(outcomes, gold)
    intents = m.per_class(m.confusion(m.intent_pairs(rows, taxonomy)))
    urgencies = m.per_class(m.confusion(m.urgency_pairs(rows)))
    routes = m.routing_agreement(rows)
    groups = m.fairness_groups(rows)
    return {
        "run": {**(run or {}), **_one(m.run_summary(outcomes, tickets))},
        "volume": {
            **_one(m.volume(outcomes)),
            "by_channel": _many(m.volume_by(outcomes, "channel"), "channel"),
            "by_intent": _many(m.volume_by(outcomes, "intent"), "intent"),
        },
        "business": {**_one(m.business(outcomes)), **_one(m.human_baseline(tickets))},
        "technical": {
            "intent_classification": {**_one(m.class_summary(intents)), "per_class": _many(intents, "class")},
            "urgency_classification": {**_one(m.class_summary(urgencies)), "per_class": _many(urgencies, "class")},
            "retrieval": {**_one(m.retrieval(rows)), **_one(m.document_accuracy(rows))},
            "citations": _one(m.citations(outcomes)),
            "grounding": _one(m.grounding(outcomes)),
            "latency_seconds": _one(m.latency(outcomes)),
            "routing": {**_one(m.routing_summary(routes)), "confusion": _many(routes, "truth", "predicted")},
        },
        "safety": {
            **_one(m.safety(rows)),
            # Shown in the report; the full list is safety_violations().
            "violating_ticket_ids": ",".join(
                r["ticket_id"] for r in m.safety_violations(rows).orderBy("ticket_ord", "ticket_id").limit(LISTED).collect()
            ),
        },
        "governance": {
            "guardrails": _many(m.guardrail_activity(outcomes), "name"),
            **_one(m.private_data(outcomes)),
            "confidence_calibration": _one(m.calibration_check(rows, taxonomy)),
        },
        "fairness": {
            "groups": _many(groups, "attribute", "group"),
            "gaps": _many(m.fairness_gaps(groups), "attribute"),
        },
        "documentation_gaps": {
            **_one(m.gap_summary(outcomes)),
            "priority_order": [r.asDict() for r in m.gap_priorities(outcomes, k=TOPICS).collect()],
            "examples": [r.asDict() for r in m.gap_examples(rows, k=EXAMPLES).collect()],
        },
        "reconciliation": _one(reconciliation) if reconciliation is not None else {},
    }


def percent(value) -> str:
    return "—" if value is None else f"{float(value) * 100:.1f}%"


def verdict(value, target: float, higher_is_better: bool = True) -> str:
    if value is None:
        return "not measured"
    if value >= target if higher_is_better else value <= target:
        return "meets target"
    return "below target" if higher_is_better else "above target"


def _table(header: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(header) + " |", "|" + "---|" * len(header)] + [
        "| " + " | ".join(str(c) for c in r) + " |" for r in rows
    ]


def markdown(report: dict) -> str:
    """The report for readers, with targets, baselines and a warning on thin samples."""
    run, v, b, t = (report[k] for k in ("run", "volume", "business", "technical"))
    n = v["tickets_processed"] or 1
    intents, g = t["intent_classification"], report["governance"]
    out = [
        "# Evaluation run report", "",
        f"Run `{run.get('run_id', 'unknown')}`: {v['tickets_processed']} of {run.get('tickets_in_file')} "
        f"tickets processed, {run.get('tickets_with_warnings')} arrived damaged.", "",
        "## What the system did", "",
        *_table(["Outcome", "Tickets", "Share"], [
            [name, v[key], percent(v[key] / n)] for name, key in (
                ("Answered automatically", "answered_automatically"),
                ("Escalated to a person", "escalated"),
                ("Blocked by a guardrail", "blocked_by_guardrails"),
                ("Processing errors", "processing_errors"),
                ("Processed in degraded mode", "processed_in_degraded_mode"),
            )
        ]), "",
        "## Business outcomes", "",
        *_table(["Measure", "Baseline", "Target", "This run", "Verdict"], [
            ["First contact resolution", percent(b["first_contact_resolution_baseline"]), percent(lx.TARGET_FCR),
             percent(b["first_contact_resolution"]), verdict(b["first_contact_resolution"], lx.TARGET_FCR)],
            ["Escalation rate", percent(b["escalation_rate_baseline"]), percent(lx.TARGET_ESCALATION),
             percent(b["escalation_rate"]), verdict(b["escalation_rate"], lx.TARGET_ESCALATION, False)],
        ]), "",
        "## Technical performance", "",
    ]
    if intents.get("n"):
        thin = [c["class"] for c in intents["per_class"] if 0 < c["support"] < lx.MIN_GROUP]
        out += [
            f"Intent classification over {intents['n']} labelled tickets: accuracy {percent(intents['accuracy'])}, "
            f"macro precision {percent(intents['macro_precision'])}, macro recall {percent(intents['macro_recall'])}.", "",
            *_table(["Intent", "Support", "Precision", "Recall", "F1"], [
                [c["class"], c["support"], percent(c["precision"]), percent(c["recall"]), percent(c["f1"])]
                for c in sorted(intents["per_class"], key=lambda c: (-c["support"], c["class"]))
            ]), "",
        ]
        if thin:
            out += [f"Fewer than {lx.MIN_GROUP} examples, so not a measurement: {', '.join(thin)}.", ""]
    else:
        out += ["Intent classification: the input carries no intent labels.", ""]
    latency, cal = t["latency_seconds"], g["confidence_calibration"]
    out += [
        f"Citations: {t['citations'].get('resolvable')} of {t['citations'].get('total')} resolve "
        f"({percent(t['citations'].get('citation_accuracy'))}, target {percent(lx.TARGET_CITATIONS)}).", "",
        f"Latency: median {latency['median']:.2f}s, p95 {latency['p95']:.2f}s "
        f"({verdict(latency['p95'], lx.TARGET_P95_SECONDS, False)}).", "",
        "## Governance", "",
        f"Decision log reconciles: {report['reconciliation'].get('reconciles')}.", "",
        f"Private data detected: {g['private_data_detections']}; released: {g['private_data_released']}.", "",
        f"Calibration error: {cal.get('expected_calibration_error')} over {cal.get('n_with_labels')} labelled "
        f"tickets (condition {lx.MAX_ECE}).", "",
        "## Fairness across customer groups", "",
        *_table(["Attribute", "Group", "Tickets", "Automated", "Comparable"], [
            [r["attribute"], r["group"], r["n"], percent(r["automation_rate"]),
             "yes" if r["sufficient_sample"] else "too small"] for r in report["fairness"]["groups"]
        ]), "",
        "## Documentation gaps", "",
        *_table(["Topic", "Tickets without an answer"], [
            [r["intent"], r["tickets"]] for r in report["documentation_gaps"]["priority_order"]
        ]), "",
    ]
    return "\n".join(out)


def _put(folder: str, name: str, text: str) -> None:
    """A small text file, through Hadoop's file systems where the folder names one."""
    if "://" not in folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        (Path(folder) / name).write_text(text, encoding="utf-8")
        return
    spark = SparkSession.getActiveSession()
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()


def write_report(report: dict, folder: str) -> None:
    """metrics.json, documentation_gaps.json and metrics.md; a few kilobytes from the driver."""
    dump = lambda x: json.dumps(x, indent=2, ensure_ascii=False, default=str)
    _put(folder, "metrics.json", dump(report))
    _put(folder, "documentation_gaps.json", dump(report["documentation_gaps"]))
    _put(folder, "metrics.md", markdown(report))
