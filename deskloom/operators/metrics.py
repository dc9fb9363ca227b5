"""Run metrics. Each section is one aggregate over flat outcomes, joined to tickets once.

Flat outcomes carry: ticket_id, channel, action, error, degraded, intent, urgency,
confidence, calibrated, grounding_score, latency_seconds, retrieved_docs, retrieved_chunks,
citations, findings, escalation_note, rule_fired, top_score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deskloom import lexicon as lx
from deskloom.functions import labels as lb
from deskloom.operators import quantiles
from deskloom.operators.calibration import expected_calibration_error


def flatten(outcomes: DataFrame) -> DataFrame:
    """Nested outcome rows to the flat columns the metrics read."""
    return outcomes.select(
        "ticket_id", "channel", "action", "error", "degraded",
        F.col("classification.intent").alias("intent"),
        F.col("classification.urgency").alias("urgency"),
        F.col("classification.confidence").alias("confidence"),
        F.col("classification.calibrated").alias("calibrated"),
        F.col("signals.grounding_score").alias("grounding_score"),
        "latency_seconds",
        F.transform("retrieved", lambda p: p["doc_id"]).alias("retrieved_docs"),
        F.transform("retrieved", lambda p: p["chunk_id"]).alias("retrieved_chunks"),
        "citations", "findings",
        F.col("escalation_package.note").alias("escalation_note"),
        F.col("routing.rule_fired").alias("rule_fired"),
        F.coalesce(F.get("retrieved", F.lit(0))["score"], F.lit(0.0)).alias("top_score"),
    )


def last_by_id(tickets: DataFrame, order: str = "position") -> DataFrame:
    """One row per ticket id, the last in input order.

    max_by combines before the shuffle, so an id repeated on a third of the rows is no
    hot group. There is one for each column, all of the same row, so columns that nobody reads
    are pruned and are neither sorted nor shuffled.
    """
    rest = [c for c in tickets.columns if c != "ticket_id"]
    return tickets.groupBy("ticket_id").agg(*[F.max_by(c, order).alias(c) for c in rest])


def with_gold(tickets: DataFrame) -> DataFrame:
    """Add the gold label columns to tickets that carry ``labels`` and ``extra``."""
    def gold(name: str) -> Column:
        return lb.label(F.col("labels"), F.col("extra"), name)

    docs = gold("cited_docs")
    as_list = F.when(docs.startswith("["), F.from_json(docs, "array<string>"))
    return tickets.withColumns(
        {
            "gold_intent_raw": gold("intent"),
            "gold_urgency_raw": gold("urgency"),
            "gold_escalate": lb.expected_escalation(gold("routing")),
            "gold_answerable": lb.as_bool(gold("answerable")),
            "gold_must_not": lb.as_bool(gold("must_not_auto")),
            "gold_docs": F.when(
                docs.isNotNull() & ~docs.isin("", "[]"), F.coalesce(as_list, F.array(docs))
            ),
        }
    )


def joined(outcomes: DataFrame, tickets: DataFrame) -> DataFrame:
    """Outcomes with their ticket; the last duplicate ticket wins, unmatched outcomes stay."""
    clash = [c for c in tickets.columns if c in outcomes.columns and c != "ticket_id"]
    return outcomes.join(last_by_id(tickets).drop(*clash), "ticket_id", "left")


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def _rate(condition: Column) -> Column:
    """Share of rows, nulls left out; null without any."""
    return F.round(F.avg(condition.cast("double")), 4)


def volume(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count("*").alias("tickets_processed"),
        _count(F.col("action") == "answer").alias("answered_automatically"),
        _count(F.col("action") == "escalate").alias("escalated"),
        _count(F.col("action") == "blocked").alias("blocked_by_guardrails"),
        _count(F.coalesce(F.col("error"), F.lit("")) != "").alias("processing_errors"),
        _count(F.col("degraded")).alias("processed_in_degraded_mode"),
    )


def volume_by(outcomes: DataFrame, column: str) -> DataFrame:
    return outcomes.groupBy(column).agg(F.count("*").alias("n"))


def business(outcomes: DataFrame) -> DataFrame:
    human = F.col("action").isin("escalate", "blocked")
    middle = quantiles.interpolated(outcomes, "latency_seconds", {"median": 0.5})
    return outcomes.agg(
        F.coalesce(_rate(F.col("action") == "answer"), F.lit(0.0)).alias("first_contact_resolution"),
        F.coalesce(_rate(human), F.lit(0.0)).alias("escalation_rate"),
        F.coalesce(F.round(F.avg("latency_seconds"), 4), F.lit(0.0)).alias("mean_response_seconds"),
        F.coalesce(F.round(middle.scalar(), 4), F.lit(0.0)).alias("median_response_seconds"),
        _count(F.coalesce(F.col("escalation_note"), F.lit("")) != "").alias(
            "escalations_with_context_package"
        ),
    )


def _first_key(history: Column, keys) -> Column:
    """Value of the first of ``keys`` present, even when it is unusable."""
    chosen = F.lit(None).cast("string")
    for key in reversed(keys):
        chosen = F.when(F.map_contains_key(history, key), F.try_element_at(history, F.lit(key))).otherwise(chosen)
    return chosen


def _truthy(value: Column) -> Column:
    """Truth of a JSON scalar held as text; null stays null only when the key is absent."""
    return ~F.coalesce(F.lower(value), F.lit("null")).isin("false", "", "0", "0.0", "null", "[]", "{}")


def human_baseline(tickets: DataFrame) -> DataFrame:
    """What people did with these tickets, from ``history``; stated figures where unmeasured."""
    h = F.col("history")

    def has(key: str) -> Column:
        return F.map_contains_key(h, key)

    def flag(key: str) -> Column:
        return F.when(has(key), _truthy(F.try_element_at(h, F.lit(key))))

    has_minutes = F.lit(False)
    for key in lx.RESOLUTION_MINUTE_KEYS:
        has_minutes = has_minutes | has(key)
    seconds = F.when(
        has_minutes, _first_key(h, lx.RESOLUTION_MINUTE_KEYS).try_cast("double") * 60.0
    ).otherwise(_first_key(h, lx.RESPONSE_HOUR_KEYS).try_cast("double") * 3600.0)
    csat = F.try_element_at(h, F.lit("csat_rating")).try_cast("double")
    return tickets.agg(
        F.coalesce(_rate(flag("first_contact_resolution")), F.lit(lx.STATED_FCR)).alias(
            "first_contact_resolution_baseline"
        ),
        F.count(flag("first_contact_resolution")).alias("first_contact_resolution_n"),
        F.coalesce(_rate(flag("escalated")), F.lit(lx.STATED_ESCALATION)).alias("escalation_rate_baseline"),
        F.round(F.avg(seconds), 1).alias("response_time_baseline_seconds"),
        F.round(F.avg(seconds) / 3600.0, 2).alias("response_time_baseline_hours"),
        F.count(seconds).alias("response_time_baseline_n"),
        F.round(F.avg(csat), 3).alias("csat_baseline"),
        _rate(flag("repeat_contact")).alias("repeat_contact_baseline"),
    )


def latency(outcomes: DataFrame) -> DataFrame:
    """Mean, interpolated percentiles and maximum, exact whatever the number of distinct latencies."""
    x = F.col("latency_seconds")

    def rounded(value: Column) -> Column:
        return F.coalesce(F.round(value, 4), F.lit(0.0))

    points = quantiles.interpolated(outcomes, x, {"median": 0.5, "p95": 0.95, "p99": 0.99})
    ends = outcomes.agg(rounded(F.avg(x)).alias("mean"), rounded(F.max(x)).alias("max"))
    # Two frames of one row each.
    return ends.join(F.broadcast(points)).select(
        "mean", *[rounded(F.col(p)).alias(p) for p in ("median", "p95", "p99")], "max"
    )


def confusion(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def per_class(matrix: DataFrame) -> DataFrame:
    """Support, predicted count, precision, recall and F1 per class from a confusion table."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = matrix.select(
        F.explode(
            F.array(
                F.struct(F.col("truth").alias("class"), F.col("n").alias("support"),
                         F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("tp")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"),
                         F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
            )
        ).alias("x")
    ).select("x.*")
    counts = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    precision = F.when(predicted > 0, tp / predicted).otherwise(F.lit(0.0))
    recall = F.when(support > 0, tp / support).otherwise(F.lit(0.0))
    f1 = F.when(tp > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return counts.select(
        "class", "support", "predicted", F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"), "tp",
    )


def class_summary(classes: DataFrame) -> DataFrame:
    """Accuracy plus macro averages over classes that occur, from rounded class figures."""
    present = F.col("support") > 0

    def macro(name: str) -> Column:
        return F.coalesce(F.round(F.avg(F.when(present, F.col(name))), 4), F.lit(0.0))

    accuracy = F.coalesce(F.round(F.try_divide(F.sum("tp"), F.sum("support")), 4), F.lit(0.0))
    return classes.agg(
        F.coalesce(F.sum("support"), F.lit(0)).alias("n"),
        accuracy.alias("accuracy"),
        macro("precision").alias("macro_precision"),
        macro("recall").alias("macro_recall"),
        macro("f1").alias("macro_f1"),
        accuracy.alias("micro_precision"),
        _count(present).alias("classes_present"),
    )


def thin_classes(classes: DataFrame, limit: int | Column = lx.MIN_GROUP) -> DataFrame:
    """Classes with fewer examples than the limit, a number or a share of their total."""
    return classes.filter((F.col("support") > 0) & (F.col("support") < limit)).select("class", "support")


def intent_pairs(rows: DataFrame, taxonomy=lx.TAXONOMY) -> DataFrame:
    labelled = F.coalesce(F.col("gold_intent_raw"), F.lit("")) != ""
    return rows.filter(labelled).select(
        lb.canonical_intent(F.col("gold_intent_raw"), taxonomy).alias("truth"),
        F.coalesce(F.nullif("intent", F.lit("")), F.lit("other")).alias("predicted"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def urgency_pairs(rows: DataFrame) -> DataFrame:
    labelled = F.coalesce(F.col("gold_urgency_raw"), F.lit("")) != ""
    return rows.filter(labelled).select(
        lb.canonical_urgency(F.col("gold_urgency_raw")).alias("truth"),
        F.coalesce(F.nullif("urgency", F.lit("")), F.lit("medium")).alias("predicted"),
    )


def retrieval(rows: DataFrame) -> DataFrame:
    """Hit rate on answerable tickets, false retrieval on the others, empty results."""
    found = F.size("retrieved_docs") > 0
    yes = F.col("gold_answerable") == F.lit(True)
    no = F.col("gold_answerable") == F.lit(False)
    return rows.agg(
        _count(yes).alias("labelled_answerable"),
        _rate(F.when(yes, found)).alias("hit_rate_on_answerable"),
        _count(no).alias("labelled_not_answerable"),
        _rate(F.when(no, found)).alias("false_retrieval_rate_on_unanswerable"),
        _count(~found).alias("returned_nothing"),
        F.coalesce(F.round(F.avg(F.size("retrieved_docs")), 3), F.lit(0.0)).alias("mean_passages_returned"),
    )


def citations(outcomes: DataFrame) -> DataFrame:
    """Citations of sent replies that resolve to a passage retrieved for the same ticket."""
    good = F.size(
        F.filter("citations", lambda c: F.array_contains(F.col("retrieved_chunks"), c))
    ).cast("long")
    total = F.sum(F.size("citations").cast("long"))
    return outcomes.filter(F.col("action") == "answer").agg(
        F.coalesce(total, F.lit(0)).alias("total"),
        F.coalesce(F.sum(good), F.lit(0)).alias("resolvable"),
        F.round(F.try_divide(F.sum(good), total), 4).alias("citation_accuracy"),
        _count(F.size("citations") == 0).alias("answered_without_any_citation"),
    )


def grounding(outcomes: DataFrame) -> DataFrame:
    g = F.col("grounding_score")
    return outcomes.agg(
        F.count(g).alias("n"), F.round(F.avg(g), 4).alias("mean"), F.round(F.median(g), 4).alias("median")
    )


def routing_agreement(rows: DataFrame) -> DataFrame:
    """Confusion of the expected route and what happened; blocked counts as seen by a person."""
    name = lambda c: F.when(c, F.lit("escalate")).otherwise(F.lit("auto_respond"))
    return confusion(
        rows.filter(F.col("gold_escalate").isNotNull()).select(
            name(F.col("gold_escalate")).alias("truth"),
            name(F.col("action").isin("escalate", "blocked")).alias("predicted"),
        )
    )


def routing_summary(matrix: DataFrame) -> DataFrame:
    n, t, p = F.col("n"), F.col("truth"), F.col("predicted")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    return matrix.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_with_labels"),
        F.round(F.try_divide(total(t == p), F.sum(n)), 4).alias("accuracy"),
        total((t == "auto_respond") & (p == "escalate")).alias("over_escalated"),
        total((t == "escalate") & (p == "auto_respond")).alias("under_escalated"),
    )


def document_accuracy(rows: DataFrame) -> DataFrame:
    """Whether an expected document came first, came at all, and was cited."""
    expected, got = F.col("gold_docs"), F.col("retrieved_docs")
    cited = F.transform("citations", lambda c: F.substring_index(c, "#", 1))
    top1 = F.coalesce(F.array_contains(expected, F.get(got, F.lit(0))), F.lit(False))
    answered = F.col("action") == "answer"
    return rows.filter(F.size("gold_docs") > 0).agg(
        F.count("*").alias("n_with_expected_documents"),
        _rate(top1).alias("expected_document_ranked_first"),
        _rate(F.arrays_overlap(expected, got)).alias("expected_document_in_top_k"),
        _rate(F.when(answered, F.arrays_overlap(expected, cited))).alias("cited_the_expected_document"),
        _count(answered).alias("cited_the_expected_document_n"),
    )


def safety(rows: DataFrame) -> DataFrame:
    """Automated replies to tickets that must never get one, counted; see ``safety_violations``."""
    flagged = F.coalesce(F.col("gold_must_not"), F.lit(False))
    violating = flagged & (F.col("action") == "answer")
    total, bad = _count(flagged), _count(violating)
    return rows.agg(
        total.alias("flagged"), bad.alias("violations"),
        F.when(total > 0, bad == 0).alias("condition_met"),
    )


def safety_violations(rows: DataFrame) -> DataFrame:
    """Every ticket that got an automated reply although it must never get one."""
    flagged = F.coalesce(F.col("gold_must_not"), F.lit(False))
    return rows.filter(flagged & (F.col("action") == "answer")).select("ticket_ord", "ticket_id")


def guardrail_activity(outcomes: DataFrame) -> DataFrame:
    return (
        outcomes.select(F.explode("findings").alias("f"))
        .groupBy(F.col("f.name").alias("name"))
        .agg(
            _count(F.col("f.triggered")).alias("triggered"),
            _count(F.col("f.blocked")).alias("blocked"),
        )
    )


def private_data(outcomes: DataFrame) -> DataFrame:
    """Detections in drafts, and how many of those drafts were sent."""
    hit = F.coalesce(
        F.exists("findings", lambda f: (f["name"] == "private_data") & f["triggered"]), F.lit(False)
    )
    return outcomes.agg(
        _count(hit).alias("private_data_detections"),
        _count(hit & (F.col("action") == "answer")).alias("private_data_released"),
    )


def calibration_check(rows: DataFrame, taxonomy=lx.TAXONOMY) -> DataFrame:
    """Calibration error over labelled tickets; withheld below 20 of them."""
    pairs = intent_pairs(rows, taxonomy).select(
        "confidence", (F.col("truth") == F.col("predicted")).alias("correct")
    )
    checked = expected_calibration_error(pairs)
    enough = F.col("n") >= lx.MIN_ECE_SAMPLES
    overall = rows.agg(
        F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 4).alias("c"),
        _count(~F.coalesce("calibrated", F.lit(False))).alias("u"),
    )
    return checked.select(
        F.col("n").alias("n_with_labels"),
        F.when(enough, F.col("ece")).alias("expected_calibration_error"),
        F.when(enough, F.col("ece") <= lx.MAX_ECE).alias("condition_met"),
        overall.select("c").scalar().alias("mean_stated_confidence"),
        overall.select("u").scalar().alias("responses_uncalibrated"),
    )


FAIRNESS_ATTRIBUTES = ("customer_tier", "region", "language_fluency")


def fairness_groups(rows: DataFrame, attributes=FAIRNESS_ATTRIBUTES) -> DataFrame:
    """Outcome figures per attribute and group; a missing group is ``unknown``."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("attribute"),
                F.coalesce(F.nullif(F.col(a), F.lit("")), F.lit("unknown")).alias("group"),
            )
            for a in attributes
        ]
    )
    return (
        rows.select("action", "confidence", "grounding_score", F.explode(pairs).alias("x"))
        .groupBy("x.attribute", "x.group")
        .agg(
            F.count("*").alias("n"),
            _rate(F.col("action") == "answer").alias("automation_rate"),
            F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 4).alias("mean_confidence"),
            F.round(F.avg("grounding_score"), 4).alias("mean_grounding"),
        )
        .withColumn("sufficient_sample", F.col("n") >= lx.MIN_GROUP)
    )


def fairness_gaps(groups: DataFrame) -> DataFrame:
    """Largest difference in automation rate between groups that can be compared."""
    comparable = F.col("sufficient_sample") & (F.col("group") != "unknown")
    rate = F.when(comparable, F.col("automation_rate"))
    gap = F.when(F.count(rate) >= 2, F.round(F.max(rate) - F.min(rate), 4))
    return groups.groupBy("attribute").agg(
        F.count(rate).alias("comparable_groups"),
        gap.alias("automation_rate_gap"),
        (gap < lx.MAX_FAIRNESS_GAP).alias("condition_met"),
    )


def gap_summary(outcomes: DataFrame, rules=(lx.R5,)) -> DataFrame:
    gap = F.col("rule_fired").isin(*rules)
    return outcomes.agg(
        _count(gap).alias("tickets_with_no_documentation_answer"),
        F.coalesce(_rate(gap), F.lit(0.0)).alias("share_of_all_tickets"),
    )


def gap_priorities(outcomes: DataFrame, rules=(lx.R5,), k: int | None = None) -> DataFrame:
    """Intents most often without an answer; ties by first occurrence."""
    ranked = (
        outcomes.filter(F.col("rule_fired").isin(*rules))
        .groupBy("intent")
        .agg(F.count("*").alias("tickets"), F.min("ticket_ord").alias("first_seen"))
        .orderBy(F.desc("tickets"), "first_seen")
        .select("intent", "tickets")
    )
    return ranked if k is None else ranked.limit(k)


def gap_examples(rows: DataFrame, rules=(lx.R5,), k: int | None = None) -> DataFrame:
    """Unanswered questions in input order, for whoever writes the documentation."""
    question = F.coalesce(F.nullif("subject", F.lit("")), F.col("body"), F.lit(""))
    found = (
        rows.filter(F.col("rule_fired").isin(*rules))
        .orderBy("ticket_ord", "ticket_id")
        .select("ticket_id", "channel", "intent", question.alias("question"),
                F.col("top_score").alias("best_score_found"))
    )
    return found if k is None else found.limit(k)


def run_summary(outcomes: DataFrame, tickets: DataFrame) -> DataFrame:
    """Tickets in the file, how many were processed, and how many arrived damaged."""
    done = outcomes.agg(F.count("*").alias("n")).scalar()
    return tickets.agg(
        F.count("*").alias("tickets_in_file"),
        _count(F.size("ingest_warnings") > 0).alias("tickets_with_warnings"),
    ).select(
        "*", done.alias("tickets_processed"), (done == F.col("tickets_in_file")).alias("completed_fully")
    )


def most_common(rows: DataFrame, column: str, order: str, k: int | None = None) -> DataFrame:
    counted = (
        rows.groupBy(column)
        .agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
        .orderBy(F.desc("n"), "first_seen")
    )
    return counted if k is None else counted.limit(k)

