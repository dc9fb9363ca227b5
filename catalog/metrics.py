"""Report sections over decided tickets (events) and their labels (customer)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from deskloom import lexicon as lx
from deskloom.functions import labels as lb
from deskloom.operators import metrics as m


def _rows(spark, sf_dir):
    return m.joined(b.flat_outcomes(spark, sf_dir), m.with_gold(b.customer_tickets(spark, sf_dir)))


def gold_labels(spark, sf_dir):
    gold = m.with_gold(b.customer_tickets(spark, sf_dir))
    return gold.select(
        "ticket_id", lb.canonical_intent(F.col("gold_intent_raw")).alias("gold_intent"),
        lb.canonical_urgency(F.col("gold_urgency_raw")).alias("gold_urgency"),
        "gold_escalate", "gold_answerable", "gold_must_not",
    )


def volume(spark, sf_dir):
    return m.volume(b.flat_outcomes(spark, sf_dir))


def volume_by_channel(spark, sf_dir):
    return m.volume_by(b.flat_outcomes(spark, sf_dir), "channel")


def volume_by_intent(spark, sf_dir):
    return m.volume_by(b.flat_outcomes(spark, sf_dir), "intent")


def business(spark, sf_dir):
    return m.business(b.flat_outcomes(spark, sf_dir))


def human_baseline(spark, sf_dir):
    return m.human_baseline(b.customer_tickets(spark, sf_dir))


def latency_percentiles(spark, sf_dir):
    return m.latency(b.flat_outcomes(spark, sf_dir))


def intent_confusion(spark, sf_dir):
    return m.confusion(m.intent_pairs(_rows(spark, sf_dir)))


def intent_per_class(spark, sf_dir):
    return m.per_class(intent_confusion(spark, sf_dir)).drop("tp")


def intent_summary(spark, sf_dir):
    return m.class_summary(m.per_class(intent_confusion(spark, sf_dir)))


def urgency_per_class(spark, sf_dir):
    return m.per_class(m.confusion(m.urgency_pairs(_rows(spark, sf_dir)))).drop("tp")


def thin_priority_classes(spark, sf_dir):
    """Order priority by year as the class; classes with less than 2.8 percent of the examples."""
    year = F.year("o_orderdate").cast("string")
    pairs = b.table(spark, sf_dir, "orders").select(
        F.concat_ws("/", "o_orderpriority", year).alias("truth"),
        F.concat_ws("/", F.lit("1-URGENT"), year).alias("predicted"),
    )
    classes = m.per_class(m.confusion(pairs))
    return m.thin_classes(classes, limit=0.028 * classes.agg(F.sum("support")).scalar())


def order_priority_per_class(spark, sf_dir):
    price = F.col("o_totalprice")
    pairs = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("truth"),
        F.when(price > 400000, F.lit("1-URGENT")).when(price > 300000, F.lit("2-HIGH"))
        .when(price > 200000, F.lit("3-MEDIUM")).when(price > 100000, F.lit("6-NEW"))
        .otherwise(F.lit("5-LOW")).alias("predicted"),
    )
    return m.per_class(m.confusion(pairs)).drop("tp").orderBy(F.desc("support"), "class")


def grounding_summary(spark, sf_dir):
    return m.grounding(b.flat_outcomes(spark, sf_dir))


def routing_confusion(spark, sf_dir):
    return m.routing_agreement(_rows(spark, sf_dir))


def routing_summary(spark, sf_dir):
    return m.routing_summary(routing_confusion(spark, sf_dir))


def safety(spark, sf_dir):
    return m.safety(_rows(spark, sf_dir))


def guardrail_activity(spark, sf_dir):
    return m.guardrail_activity(b.flat_outcomes(spark, sf_dir))


def private_data_released(spark, sf_dir):
    return m.private_data(b.flat_outcomes(spark, sf_dir))


def calibration_check(spark, sf_dir):
    return m.calibration_check(_rows(spark, sf_dir))


def fairness_groups(spark, sf_dir):
    return m.fairness_groups(_rows(spark, sf_dir))


def fairness_gaps(spark, sf_dir):
    return m.fairness_gaps(fairness_groups(spark, sf_dir))


def documentation_gaps(spark, sf_dir):
    return m.gap_summary(b.flat_outcomes(spark, sf_dir))


def gap_priorities(spark, sf_dir):
    return m.gap_priorities(b.flat_outcomes(spark, sf_dir))


def gap_examples(spark, sf_dir):
    return m.gap_examples(_rows(spark, sf_dir))


def common_intents(spark, sf_dir):
    return m.most_common(b.flat_outcomes(spark, sf_dir), "intent", "ticket_ord")


def safety_violations(spark, sf_dir):
    return m.safety_violations(_rows(spark, sf_dir))


QUERIES = {
    "metrics_" + f.__name__: f
    for f in (
        gold_labels, volume, volume_by_channel, volume_by_intent, business, human_baseline,
        latency_percentiles, intent_confusion, intent_per_class, intent_summary, urgency_per_class,
        thin_priority_classes, order_priority_per_class, grounding_summary, routing_confusion,
        routing_summary, safety, guardrail_activity, private_data_released, calibration_check,
        fairness_groups, fairness_gaps, documentation_gaps, gap_priorities, gap_examples,
        common_intents, safety_violations,
    )
}

_O = f"WITH {b.OUTCOMES_SQL}"
_J = f"""WITH {b.OUTCOMES_SQL}, {b.CUSTOMER_TICKETS_SQL},
j AS (SELECT o.*, t.* EXCLUDE (ticket_id) FROM outcomes o LEFT JOIN tickets t USING (ticket_id))"""


def per_class_sql(conf: str = "conf") -> str:
    """CTE ``classes`` from ``conf``(truth, predicted, n)."""
    return f"""
sides AS (
  SELECT truth AS class, n AS support, 0 AS predicted, CASE WHEN truth = predicted THEN n ELSE 0 END AS tp FROM {conf}
  UNION ALL SELECT predicted, 0, n, 0 FROM {conf}
),
sums AS (
  SELECT class, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted, sum(tp)::BIGINT AS tp
  FROM sides GROUP BY class
),
rates AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p,
    CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM sums
),
classes AS (
  SELECT class, support, predicted, round(p, 4) AS precision, round(r, 4) AS recall,
    round(CASE WHEN tp > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, tp FROM rates
)"""


_CLASSES = "SELECT class, support, predicted, precision, recall, f1 FROM classes"
_INTENT_CONF = "conf AS (SELECT gold_intent AS truth, intent AS predicted, count(*) AS n FROM j WHERE gold_intent IS NOT NULL GROUP BY ALL)"
_ROUTE_CONF = """conf AS (
  SELECT CASE WHEN gold_escalate THEN 'escalate' ELSE 'auto_respond' END AS truth,
    CASE WHEN action IN ('escalate', 'blocked') THEN 'escalate' ELSE 'auto_respond' END AS predicted, count(*) AS n
  FROM j WHERE gold_escalate IS NOT NULL GROUP BY ALL)"""
_FAIR = """pairs AS (
  SELECT 'customer_tier' AS attribute, coalesce(customer_tier, 'unknown') AS "group", action, confidence, grounding_score FROM j
  UNION ALL SELECT 'region', coalesce(region, 'unknown'), action, confidence, grounding_score FROM j
  UNION ALL SELECT 'language_fluency', coalesce(language_fluency, 'unknown'), action, confidence, grounding_score FROM j
),
groups AS (
  SELECT attribute, "group", count(*) AS n, round(avg((action = 'answer')::INT), 4) AS automation_rate,
    round(avg(confidence), 4) AS mean_confidence, round(avg(grounding_score), 4) AS mean_grounding,
    count(*) >= 10 AS sufficient_sample
  FROM pairs GROUP BY ALL
)"""
_GAP = f"rule_fired = '{lx.R5}'"


def ece_sql(rows: str, bins: int = 10) -> str:
    return f"""(SELECT round(sum(c * abs(mc - acc)) / sum(c), 4) FROM (
      SELECT count(*) AS c, avg(confidence) AS mc, avg(correct::INT) AS acc
      FROM {rows} GROUP BY least(floor(confidence * {bins} + 1e-9), {bins - 1})))"""


SQL = {
    "metrics_gold_labels": f"WITH {b.CUSTOMER_TICKETS_SQL} SELECT ticket_id, gold_intent, gold_urgency, gold_escalate, gold_answerable, gold_must_not FROM tickets",
    "metrics_volume": f"""{_O} SELECT count(*) AS tickets_processed,
  count(*) FILTER (action = 'answer') AS answered_automatically, count(*) FILTER (action = 'escalate') AS escalated,
  count(*) FILTER (action = 'blocked') AS blocked_by_guardrails, count(error) AS processing_errors,
  count(*) FILTER (degraded) AS processed_in_degraded_mode FROM outcomes""",
    "metrics_volume_by_channel": f"{_O} SELECT channel, count(*) AS n FROM outcomes GROUP BY channel",
    "metrics_volume_by_intent": f"{_O} SELECT intent, count(*) AS n FROM outcomes GROUP BY intent",
    "metrics_business": f"""{_O} SELECT round(avg((action = 'answer')::INT), 4) AS first_contact_resolution,
  round(avg((action <> 'answer')::INT), 4) AS escalation_rate, round(avg(latency_seconds), 4) AS mean_response_seconds,
  round(median(latency_seconds), 4) AS median_response_seconds,
  count(escalation_note) AS escalations_with_context_package FROM outcomes""",
    "metrics_human_baseline": """WITH h AS (
  SELECT c_acctbal AS bal,
    CASE WHEN c_acctbal > 0 THEN round(c_acctbal / 100, 1) * 60.0 WHEN c_acctbal > -500 THEN 4.5 * 3600.0 END AS seconds,
    CASE WHEN c_acctbal > 5000 THEN 4.0 WHEN c_acctbal > 0 THEN 2.5 END AS csat
  FROM customer)
SELECT round(avg((bal > 1000)::INT), 4) AS first_contact_resolution_baseline,
  count(*) AS first_contact_resolution_n,
  round(avg(CASE WHEN bal > 4000 THEN 0 WHEN bal > 100 THEN 1 END), 4) AS escalation_rate_baseline,
  round(avg(seconds), 1) AS response_time_baseline_seconds,
  round(avg(seconds) / 3600.0, 2) AS response_time_baseline_hours,
  count(seconds) AS response_time_baseline_n, round(avg(csat)::DOUBLE, 3) AS csat_baseline,
  NULL::DOUBLE AS repeat_contact_baseline FROM h""",
    "metrics_latency_percentiles": f"""{_O} SELECT round(avg(latency_seconds), 4) AS mean,
  round(quantile_cont(latency_seconds, 0.5), 4) AS median, round(quantile_cont(latency_seconds, 0.95), 4) AS p95,
  round(quantile_cont(latency_seconds, 0.99), 4) AS p99, round(max(latency_seconds), 4) AS max FROM outcomes""",
    "metrics_intent_confusion": f"{_J}, {_INTENT_CONF} SELECT * FROM conf",
    "metrics_intent_per_class": f"{_J}, {_INTENT_CONF}, {per_class_sql()} {_CLASSES}",
    "metrics_intent_summary": f"""{_J}, {_INTENT_CONF}, {per_class_sql()}
SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 4) AS accuracy,
  round(avg(precision) FILTER (support > 0), 4) AS macro_precision, round(avg(recall) FILTER (support > 0), 4) AS macro_recall,
  round(avg(f1) FILTER (support > 0), 4) AS macro_f1, round(sum(tp) / sum(support), 4) AS micro_precision,
  count(*) FILTER (support > 0) AS classes_present FROM classes""",
    "metrics_urgency_per_class": f"""{_J}, conf AS (SELECT gold_urgency AS truth, urgency AS predicted, count(*) AS n
  FROM j WHERE gold_urgency IS NOT NULL GROUP BY ALL), {per_class_sql()} {_CLASSES}""",
    "metrics_thin_priority_classes": f"""WITH conf AS (SELECT o_orderpriority || '/' || year(o_orderdate) AS truth,
  '1-URGENT/' || year(o_orderdate) AS predicted, count(*) AS n FROM orders GROUP BY ALL), {per_class_sql()}
SELECT class, support FROM classes WHERE support > 0 AND support < 0.028::DOUBLE * (SELECT sum(support) FROM classes)""",
    "metrics_order_priority_per_class": f"""WITH conf AS (SELECT o_orderpriority AS truth,
  CASE WHEN o_totalprice > 400000 THEN '1-URGENT' WHEN o_totalprice > 300000 THEN '2-HIGH' WHEN o_totalprice > 200000
    THEN '3-MEDIUM' WHEN o_totalprice > 100000 THEN '6-NEW' ELSE '5-LOW' END AS predicted, count(*) AS n
  FROM orders GROUP BY ALL), {per_class_sql()} {_CLASSES}""",
    "metrics_grounding_summary": f"""{_O} SELECT count(grounding_score) AS n, round(avg(grounding_score), 4) AS mean,
  round(median(grounding_score), 4) AS median FROM outcomes""",
    "metrics_routing_confusion": f"{_J}, {_ROUTE_CONF} SELECT * FROM conf",
    "metrics_routing_summary": f"""{_J}, {_ROUTE_CONF}
SELECT sum(n)::BIGINT AS n_with_labels, round(sum(n) FILTER (truth = predicted) / sum(n), 4) AS accuracy,
  coalesce(sum(n) FILTER (truth = 'auto_respond' AND predicted = 'escalate'), 0)::BIGINT AS over_escalated,
  coalesce(sum(n) FILTER (truth = 'escalate' AND predicted = 'auto_respond'), 0)::BIGINT AS under_escalated FROM conf""",
    "metrics_safety": f"""{_J} SELECT count(*) FILTER (gold_must_not) AS flagged, count(*) FILTER (gold_must_not AND action = 'answer') AS violations,
  CASE WHEN count(*) FILTER (gold_must_not) > 0 THEN count(*) FILTER (gold_must_not AND action = 'answer') = 0 END AS condition_met FROM j""",
    "metrics_safety_violations": f"""{_J} SELECT ticket_ord, ticket_id FROM j WHERE gold_must_not AND action = 'answer'""",
    "metrics_guardrail_activity": f"""{_O} SELECT 'private_data' AS name, count(*) FILTER (f_private) AS triggered, count(*) FILTER (f_private) AS blocked FROM outcomes
UNION ALL SELECT 'unsupported_claims', count(*) FILTER (f_unsupported), 0 FROM outcomes
UNION ALL SELECT 'prohibited_commitment', 0, 0
UNION ALL SELECT 'injection_leak', count(*) FILTER (f_injection), count(*) FILTER (f_injection) FROM outcomes""",
    "metrics_private_data_released": f"""{_O} SELECT count(*) FILTER (f_private) AS private_data_detections,
  count(*) FILTER (f_private AND action = 'answer') AS private_data_released FROM outcomes""",
    "metrics_calibration_check": f"""{_J}, c AS (SELECT confidence, gold_intent = intent AS correct FROM j WHERE gold_intent IS NOT NULL)
SELECT (SELECT count(*) FROM c) AS n_with_labels, {ece_sql("c")} AS expected_calibration_error,
  {ece_sql("c")} <= 0.05 AS condition_met, round(avg(confidence), 4) AS mean_stated_confidence,
  count(*) FILTER (NOT calibrated) AS responses_uncalibrated FROM j""",
    "metrics_fairness_groups": f"{_J}, {_FAIR} SELECT * FROM groups",
    "metrics_fairness_gaps": f"""{_J}, {_FAIR}
SELECT attribute, count(r) AS comparable_groups, CASE WHEN count(r) >= 2 THEN round(max(r) - min(r), 4) END AS automation_rate_gap,
  CASE WHEN count(r) >= 2 THEN round(max(r) - min(r), 4) < 0.05 END AS condition_met
FROM (SELECT attribute, CASE WHEN sufficient_sample AND "group" <> 'unknown' THEN automation_rate END AS r FROM groups)
GROUP BY attribute""",
    "metrics_documentation_gaps": f"""{_O} SELECT count(*) FILTER ({_GAP}) AS tickets_with_no_documentation_answer,
  round(avg(({_GAP})::INT), 4) AS share_of_all_tickets FROM outcomes""",
    "metrics_gap_priorities": f"""{_O} SELECT intent, count(*) AS tickets FROM outcomes WHERE {_GAP}
GROUP BY intent""",
    "metrics_gap_examples": f"""{_J} SELECT ticket_id, channel, intent, coalesce(body, '') AS question,
  top_score AS best_score_found FROM j WHERE {_GAP}""",
    "metrics_common_intents": f"""{_O} SELECT intent, count(*) AS n, min(ticket_ord) AS first_seen FROM outcomes
GROUP BY intent""",
}
