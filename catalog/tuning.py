"""Fitting, calibration, sweeps and policy discovery over labelled, scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.metrics import ece_sql
from deskloom.functions.scoring import shrink_uncalibrated
from deskloom.operators import answerability as an
from deskloom.operators import calibration as ca
from deskloom.operators import policy as po
from deskloom.operators import sweeps as sw
from deskloom.operators.routing import never_automates
from deskloom.session import cut_lineage

rows = b.scored_rows


def answerability_scores(spark, sf_dir):
    return rows(spark, sf_dir).select(
        "doc_id", "intent", F.round("prior", 6).alias("prior"), "score", "p",
        shrink_uncalibrated(F.col("confidence")).alias("shrunk_confidence"),
        never_automates(F.col("intent")).alias("never_automated"),
    )


def intent_priors(spark, sf_dir):
    return an.intent_priors(rows(spark, sf_dir)).select(
        "intent", "n", "positives", F.round("prior", 6).alias("prior")
    )


def auc_of_scorers(spark, sf_dir):
    return an.compare_scorers(
        rows(spark, sf_dir), {"retrieval_score": "score", "intent_prior": "prior", "combined": "p"}
    )


def auc_of_amounts(spark, sf_dir):
    """Rank AUC on a large table: discounts against returned lines."""
    lines = b.table(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice") / 200000).alias("score"), (F.col("l_returnflag") == "R").alias("answerable")
    )
    return an.auc(lines)


def fitted_model(spark, sf_dir):
    """Weights after the specified gradient steps, with the AUC they reach on the same rows."""
    source = rows(spark, sf_dir).drop("p", "prior")
    model = cut_lineage(an.fit_descent(source))
    known = source.withColumn("_model", model.select(F.struct("*").alias("m")).scalar())
    scored = known.withColumn("p", an.fitted_probability(F.col("_model"), F.col("intent"), F.col("score")))
    return model.select("w_prior", "w_score", "bias", "base_rate", "n_samples").crossJoin(an.auc(scored, "p").select("auc"))


def reliability_bins(spark, sf_dir):
    r = ca.reliability(rows(spark, sf_dir))
    return r.select("bin", "n", F.round("mean_confidence", 4).alias("mean_confidence"),
                    F.round("accuracy", 4).alias("accuracy"))


def calibration_error(spark, sf_dir):
    return ca.expected_calibration_error(rows(spark, sf_dir))


def isotonic_fit(spark, sf_dir):
    """Calibrated value per occupied bin."""
    fit = ca.fit_isotonic(rows(spark, sf_dir).withColumn("correct", F.col("answerable") & F.col("correct")))
    steps = F.arrays_zip("breakpoints", "values")
    return fit.select(F.explode(steps).alias("s")).select(
        F.col("s.breakpoints").alias("breakpoint"), F.round("s.values", 4).alias("value")
    )


def calibration_fit_summary(spark, sf_dir):
    return ca.fit_summary(rows(spark, sf_dir))


def calibrated_rows(spark, sf_dir):
    source = rows(spark, sf_dir)
    return ca.apply_fit(source, ca.fit_isotonic(source)).select("doc_id", "calibrated")


def calibration_sample(spark, sf_dir):
    """200 labelled rows, the same ones for the same seed."""
    return ca.seeded_sample(rows(spark, sf_dir).select("doc_id", "intent"), "doc_id", 200)


def calibration_sample_of_intents(spark, sf_dir):
    """20 labelled rows of each intent, the same ones for the same seed."""
    return ca.stratified_sample(rows(spark, sf_dir).select("doc_id", "intent"), "doc_id", "intent", 20)


def sampled_isotonic_fit(spark, sf_dir):
    """The fit of a reproducible sample, with its size."""
    source = rows(spark, sf_dir).withColumns({"method": F.lit("model"), "gold_intent": F.col("intent")})
    fit = ca.fit_of_sample(source, "doc_id", 150)
    return fit.select("n_samples", F.explode(F.arrays_zip("breakpoints", "values")).alias("s")).select(
        "n_samples", F.col("s.breakpoints").alias("breakpoint"), F.round("s.values", 4).alias("value")
    )


def answerability_sweep(spark, sf_dir):
    s = sw.answerability_sweep(rows(spark, sf_dir))
    return s.select("threshold", "tp", "fp", "fn", *[
        F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "cost")
    ])


def best_thresholds(spark, sf_dir):
    best = sw.best_points(sw.answerability_sweep(rows(spark, sf_dir)))
    return best.withColumn("best_f1", F.round("best_f1", 6))


def cost_sensitivity(spark, sf_dir):
    return sw.cost_sensitivity(rows(spark, sf_dir))


def confidence_sweep(spark, sf_dir):
    return sw.confidence_sweep(rows(spark, sf_dir))


def confidence_sensitivity(spark, sf_dir):
    return sw.confidence_sensitivity(rows(spark, sf_dir))


def floor_sweep(spark, sf_dir):
    s = sw.floor_sweep(rows(spark, sf_dir))
    return s.select("floor", "kept", "false_hits", "nothing", F.round("recall", 4).alias("recall"),
                    F.round("false_rate", 4).alias("false_rate"))


def chosen_floor(spark, sf_dir):
    chosen = sw.choose_floor(sw.floor_sweep(rows(spark, sf_dir)))
    return chosen.select("chosen_floor", *[
        F.round(c, 4).alias(c) for c in ("recall_at_floor", "false_retrieval_at_floor")
    ])


def routing_curve(spark, sf_dir):
    return sw.routing_curve(rows(spark, sf_dir))


def routing_curve_by_split(spark, sf_dir):
    return sw.routing_curve(rows(spark, sf_dir), by=["split"])


def routing_plateau(spark, sf_dir):
    return sw.routing_plateau(sw.routing_curve(rows(spark, sf_dir)))


def route_accuracy(spark, sf_dir):
    return sw.route_accuracy(rows(spark, sf_dir), 0.58)


def policy_crosstab(spark, sf_dir):
    return po.crosstab(rows(spark, sf_dir))


def policy_never_automated(spark, sf_dir):
    return po.never_automated(rows(spark, sf_dir))


def policy_residual(spark, sf_dir):
    source = rows(spark, sf_dir)
    return po.residual_pairs(po.residual(source, po.never_automated(source)))


def policy_recovered(spark, sf_dir):
    p = po.recovered(rows(spark, sf_dir))
    return p.select("n", *[
        F.array_join(c, ",").alias(c)
        for c in ("never_automate_intents", "high_risk_intents", "high_risk_urgency")
    ])


def policy_agreement(spark, sf_dir):
    return po.agreement(rows(spark, sf_dir))


def taxonomy_counts(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents")
    spelled = F.initcap(F.replace(b.intent_of_source(F.col("source")), F.lit("_"), F.lit(" ")))
    named = docs.select("doc_id", F.when(F.col("lang") == "en", spelled).otherwise(
        b.intent_of_source(F.col("source"))).alias("intent"))
    return po.build_taxonomy(named, "doc_id")


QUERIES = {
    "tuning_" + f.__name__: f
    for f in (
        answerability_scores, intent_priors, auc_of_scorers, auc_of_amounts, fitted_model,
        reliability_bins, calibration_error, isotonic_fit, calibration_fit_summary, calibrated_rows,
        calibration_sample, calibration_sample_of_intents, sampled_isotonic_fit, answerability_sweep, best_thresholds, cost_sensitivity, confidence_sweep,
        confidence_sensitivity, floor_sweep, chosen_floor, routing_curve, routing_curve_by_split,
        routing_plateau, route_accuracy, policy_crosstab, policy_never_automated, policy_residual,
        policy_recovered, policy_agreement, taxonomy_counts,
    )
}

_R = f"WITH {b.SCORED_SQL}"


def _auc_sql(source: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"""ranked AS (SELECT *, rank() OVER ({part} ORDER BY s) + (count(*) OVER (PARTITION BY {sel}s) - 1) / 2 AS r FROM {source})
SELECT {sel}count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives,
  CASE WHEN count(*) FILTER (y) = 0 OR count(*) FILTER (NOT y) = 0 THEN 0.5 ELSE
  round((sum(r) FILTER (y) - count(*) FILTER (y)::DOUBLE * (count(*) FILTER (y) + 1) / 2)
    / (count(*) FILTER (y)::DOUBLE * count(*) FILTER (NOT y)), 4) END AS auc
FROM ranked {f"GROUP BY {by}" if by else ""}"""


_BINS = "SELECT least(floor(confidence * 10 + 1e-9), 9)::INT AS bin, count(*) AS n, avg(confidence) AS mc, avg(({c})::INT) AS acc FROM rows GROUP BY 1"


def pav_sql(correct: str) -> str:
    return f"""bins AS ({_BINS.format(c=correct)}),
spans AS (
  SELECT j.bin AS j, k.bin AS k, sum(b.n * b.acc) / sum(b.n) AS m
  FROM bins j JOIN bins k ON k.bin >= j.bin JOIN bins b ON b.bin BETWEEN j.bin AND k.bin GROUP BY ALL
),
lows AS (SELECT i.bin, s.j, min(s.m) AS m FROM bins i JOIN spans s ON s.j <= i.bin AND s.k >= i.bin GROUP BY ALL),
fit AS (SELECT bin, max(m) AS value FROM lows GROUP BY bin)"""


_APPLIED = """applied AS (
  SELECT r.doc_id, r.correct, round(coalesce(
    (SELECT f.value FROM fit f WHERE f.bin / 10 <= r.confidence ORDER BY f.bin DESC LIMIT 1),
    (SELECT f.value FROM fit f ORDER BY f.bin LIMIT 1)), 4) AS confidence FROM rows r
)"""
_GRID = "grid AS (SELECT range / {n} AS t FROM range(0, {last} + 1))"
_SWEEP = f"""{_GRID.format(n="100.0::DOUBLE", last=100)},
counts AS (
  SELECT t, count(*) FILTER (p >= t AND answerable) AS tp, count(*) FILTER (p >= t AND NOT answerable) AS fp,
    count(*) FILTER (p < t AND answerable) AS fn, count(*) FILTER (p < t) AS below, count(*) AS n
  FROM grid, rows GROUP BY t
),
sweep AS (
  SELECT t AS threshold, tp, fp, fn, below, n, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS precision,
    tp / (tp + fn) AS recall, 8.0::DOUBLE * fp + fn AS cost FROM counts
),
full_sweep AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM sweep)"""
_CONF = f"""{_GRID.format(n="20.0::DOUBLE", last=20)},
conf AS (
  SELECT t AS threshold, count(*) FILTER (confidence >= t AND answerable) AS automated,
    count(*) FILTER (confidence >= t AND answerable AND correct) AS correct_auto,
    count(*) FILTER (confidence >= t AND answerable AND NOT correct) AS wrong_auto,
    count(*) FILTER (confidence < t AND answerable AND correct) AS unnecessary,
    round(count(*) FILTER (confidence >= t AND answerable) / count(*), 4) AS deflection
  FROM grid, rows GROUP BY t
)"""
_FLOOR = f"""{_GRID.format(n="100.0::DOUBLE", last=60)},
floors AS (
  SELECT t AS floor, count(*) FILTER (score >= t AND answerable) AS kept,
    count(*) FILTER (score >= t AND NOT answerable) AS false_hits, count(*) FILTER (score < t) AS nothing,
    count(*) FILTER (score >= t AND answerable) / count(*) FILTER (answerable) AS recall,
    count(*) FILTER (score >= t AND NOT answerable) / count(*) FILTER (NOT answerable) AS false_rate
  FROM grid, rows GROUP BY t
)"""
_ROUTED = f"CASE WHEN NOT (p >= t) OR {b.RESERVED_SQL} THEN 'escalate' ELSE 'auto_respond' END"


def _curve(by: str = "") -> str:
    sel = f"{by}, " if by else ""
    return f"""{_GRID.format(n="100.0::DOUBLE", last=100)},
curve AS (
  SELECT {sel}t AS threshold, count(*) FILTER ({_ROUTED} = expected_route) AS correct,
    count(*) FILTER (must_not AND {_ROUTED} = 'auto_respond') AS unsafe, count(*) FILTER (p < t) AS gaps, count(*) AS n
  FROM grid, rows GROUP BY {sel}t
)"""


#: Gradient steps on merged rows; ``fitted``: one row of weights, ``fitted_priors``: one of each intent.
DESCENT_SQL = f"""fitted_priors AS (SELECT intent, (count(*) FILTER (answerable) + 1) / (count(*) + 2) AS q FROM rows GROUP BY intent),
points AS (
  SELECT score AS s, ln(least(greatest(q, 1e-4), 1 - 1e-4) / (1 - least(greatest(q, 1e-4), 1 - 1e-4)))::DOUBLE AS f,
    count(*)::DOUBLE AS m, count(*) FILTER (answerable)::DOUBLE AS hits
  FROM rows JOIN fitted_priors USING (intent) GROUP BY ALL
),
descent(k, a, c, d) AS (
  SELECT 0, 1::DOUBLE, 0::DOUBLE, 0::DOUBLE
  UNION ALL
  SELECT k + 1, any_value(a) - {an.RATE}::DOUBLE * (sum(e * f) / sum(m) + {an.L2}::DOUBLE * any_value(a)),
    any_value(c) - {an.RATE}::DOUBLE * (sum(e * s) / sum(m) + {an.L2}::DOUBLE * any_value(c)),
    any_value(d) - {an.RATE}::DOUBLE * (sum(e) / sum(m))
  FROM (SELECT k, a, c, d, f, s, m, m / (1 + exp(-(d + a * f + c * s))) - hits AS e FROM descent, points WHERE k < {an.EPOCHS})
  GROUP BY k
),
fitted AS (
  SELECT round(a, 5) AS w_prior, round(c, 5) AS w_score, round(d, 5) AS bias,
    (SELECT round(avg(answerable::INT), 4) FROM rows) AS base_rate, (SELECT count(*) FROM rows) AS n_samples
  FROM descent WHERE k = {an.EPOCHS}
)"""


def fitted_probability_sql(intent: str, score: str) -> str:
    """Probability by the tables of ``DESCENT_SQL``."""
    q = f"coalesce((SELECT any_value(q) FROM fitted_priors fp WHERE fp.intent = {intent}), (SELECT base_rate FROM fitted))"
    q = f"least(greatest({q}, 1e-4), 1 - 1e-4)"
    z = f"(SELECT bias FROM fitted) + (SELECT w_prior FROM fitted) * ln({q} / (1 - {q})) + (SELECT w_score FROM fitted) * {score}"
    return f"round(1 / (1 + exp(-({z}))), 4)"


_RATIOS = "(VALUES (2.0), (4.0), (6.0), (8.0), (12.0), (20.0)) v(r)"
_NEVER = """never AS (SELECT intent, count(*) AS n FROM {src} GROUP BY intent
  HAVING avg((expected_route = 'escalate')::INT) = 1 AND avg(must_not::INT) = 1)"""
_RESIDUAL = """rest AS (SELECT * FROM {src} WHERE expected_route = 'escalate' AND answerable
  AND intent NOT IN (SELECT intent FROM never))"""

SQL = {
    "tuning_answerability_scores": f"""{_R} SELECT doc_id, intent, round(prior, 6) AS prior, score, p,
  round(least(0.85, confidence * 0.8::DOUBLE), 4) AS shrunk_confidence, intent IN {b._NEVER_SQL} AS never_automated FROM rows""",
    "tuning_intent_priors": f"""{_R} SELECT intent, count(*) AS n, count(*) FILTER (answerable) AS positives,
  round((count(*) FILTER (answerable) + 1) / (count(*) + 2), 6) AS prior FROM rows GROUP BY intent""",
    "tuning_auc_of_scorers": f"""{_R}, long AS (SELECT 'retrieval_score' AS scorer, score AS s, answerable AS y FROM rows
  UNION ALL SELECT 'intent_prior', prior, answerable FROM rows UNION ALL SELECT 'combined', p, answerable FROM rows),
{_auc_sql("long", "scorer")}""",
    "tuning_auc_of_amounts": f"""WITH src AS (SELECT l_extendedprice / 200000 AS s, l_returnflag = 'R' AS y FROM lineitem),
{_auc_sql("src")}""",
    "tuning_fitted_model": f"""WITH RECURSIVE {b.SCORED_SQL}, {DESCENT_SQL},
graded AS (SELECT {fitted_probability_sql("r.intent", "r.score")} AS s, answerable AS y FROM rows r),
graded_auc AS ({_auc_sql("graded").replace("ranked AS", "WITH ranked AS", 1)})
SELECT w_prior, w_score, bias, base_rate, n_samples, (SELECT auc FROM graded_auc) AS auc FROM fitted""",
    "tuning_reliability_bins": f"""{_R}, bins AS ({_BINS.format(c="correct")})
SELECT bin, n, round(mc, 4) AS mean_confidence, round(acc, 4) AS accuracy FROM bins""",
    "tuning_calibration_error": f"{_R} SELECT count(*) AS n, {ece_sql('rows')} AS ece FROM rows",
    "tuning_isotonic_fit": f"""{_R}, {pav_sql("answerable AND correct")}
SELECT bin / 10 AS breakpoint, round(value, 4) AS value FROM fit""",
    "tuning_calibration_sample": f"{_R} SELECT doc_id, intent FROM rows ORDER BY md5('42:' || doc_id), doc_id LIMIT 200",
    "tuning_calibration_sample_of_intents": f"""{_R} SELECT doc_id, intent FROM rows
QUALIFY row_number() OVER (PARTITION BY intent ORDER BY md5('42:' || doc_id), doc_id) <= 20""",
    "tuning_sampled_isotonic_fit": f"""{_R}, sampled AS (SELECT * FROM rows WHERE intent <> '' ORDER BY md5('42:' || doc_id), doc_id LIMIT 150),
{pav_sql("correct").replace("FROM rows", "FROM sampled")}
SELECT (SELECT count(*) FROM sampled) AS n_samples, bin / 10 AS breakpoint, round(value, 4) AS value FROM fit""",
    "tuning_calibration_fit_summary": f"""{_R}, {pav_sql("correct")}, {_APPLIED}
SELECT *, ece_after <= 0.05 AS condition_met FROM (SELECT count(*) AS n_samples, round(avg(correct::INT), 4) AS accuracy,
  round(avg(confidence), 6) AS mean_confidence, {ece_sql("rows")} AS ece_before, {ece_sql("applied")} AS ece_after FROM rows)""",
    "tuning_calibrated_rows": f"{_R}, {pav_sql('correct')}, {_APPLIED} SELECT doc_id, confidence AS calibrated FROM applied",
    "tuning_answerability_sweep": f"""{_R}, {_SWEEP} SELECT threshold, tp, fp, fn, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, cost FROM full_sweep""",
    "tuning_best_thresholds": f"""{_R}, {_SWEEP} SELECT
  (SELECT threshold FROM full_sweep ORDER BY f1 DESC, threshold LIMIT 1) AS best_f1_threshold, round(max(f1), 6) AS best_f1,
  (SELECT threshold FROM full_sweep ORDER BY cost, threshold LIMIT 1) AS best_cost_threshold, min(cost) AS best_cost FROM full_sweep""",
    "tuning_cost_sensitivity": f"""{_R}, {_SWEEP}, priced2 AS (SELECT r::DOUBLE AS cost_ratio, threshold, r::DOUBLE * fp + fn AS c, below / n AS e
  FROM full_sweep, {_RATIOS}), pick AS (SELECT *, row_number() OVER (PARTITION BY cost_ratio ORDER BY c, threshold) AS i FROM priced2)
SELECT cost_ratio, threshold, c AS cost, round(e, 4) AS escalation_share FROM pick WHERE i = 1""",
    "tuning_confidence_sweep": f"{_R}, {_CONF} SELECT *, 8.0::DOUBLE * wrong_auto + unnecessary AS cost FROM conf",
    "tuning_confidence_sensitivity": f"""{_R}, {_CONF}, pick AS (SELECT r::DOUBLE AS cost_ratio, threshold, r::DOUBLE * wrong_auto + unnecessary AS cost,
  row_number() OVER (PARTITION BY r ORDER BY r * wrong_auto + unnecessary, threshold) AS i FROM conf, {_RATIOS})
SELECT cost_ratio, threshold, cost FROM pick WHERE i = 1""",
    "tuning_floor_sweep": f"""{_R}, {_FLOOR} SELECT floor, kept, false_hits, nothing, round(recall, 4) AS recall,
  round(false_rate, 4) AS false_rate FROM floors""",
    "tuning_chosen_floor": f"""{_R}, {_FLOOR} SELECT min(floor) AS chosen_floor, round(min_by(recall, floor), 4) AS recall_at_floor,
  round(min_by(false_rate, floor), 4) AS false_retrieval_at_floor FROM floors WHERE false_rate <= 0.35""",
    "tuning_routing_curve": f"{_R}, {_curve()} SELECT * FROM curve",
    "tuning_routing_curve_by_split": f"{_R}, {_curve('split')} SELECT * FROM curve",
    "tuning_routing_plateau": f"""{_R}, {_curve()}, top AS (SELECT * FROM curve WHERE correct = (SELECT max(correct) FROM curve))
SELECT max(threshold) AS chosen_threshold, max(correct) AS correct, min(threshold) AS plateau_min, max(threshold) AS plateau_max,
  max_by(gaps, threshold) AS gaps_at_choice, min_by(gaps, threshold) AS gaps_at_lowest FROM top""",
    "tuning_route_accuracy": f"""{_R}, t AS (SELECT 0.58::DOUBLE AS t)
SELECT split, count(*) AS n, count(*) FILTER ({_ROUTED} = expected_route) AS correct_predicted,
  count(*) FILTER (CASE WHEN NOT answerable OR {b.RESERVED_SQL} THEN 'escalate' ELSE 'auto_respond' END = expected_route) AS correct_labelled,
  count(*) FILTER (must_not AND {_ROUTED} = 'auto_respond') AS unsafe FROM rows, t GROUP BY split""",
    "tuning_policy_crosstab": f"{_R} SELECT answerable, expected_route, count(*) AS n FROM rows GROUP BY ALL",
    "tuning_policy_never_automated": f"{_R}, {_NEVER.format(src='rows')} SELECT * FROM never",
    "tuning_policy_residual": f"""{_R}, {_NEVER.format(src='rows')}, {_RESIDUAL.format(src='rows')}
SELECT intent, urgency, count(*) AS n FROM rest GROUP BY ALL""",
    "tuning_policy_recovered": f"""{_R}, {_NEVER.format(src='rows')}, {_RESIDUAL.format(src='rows')}
SELECT count(*) AS n, (SELECT coalesce(string_agg(intent, ',' ORDER BY intent), '') FROM never) AS never_automate_intents,
  (SELECT coalesce(string_agg(DISTINCT intent, ',' ORDER BY intent), '') FROM rest) AS high_risk_intents,
  (SELECT coalesce(string_agg(DISTINCT urgency, ',' ORDER BY urgency), '') FROM rest) AS high_risk_urgency FROM rows""",
    "tuning_policy_agreement": f"""{_R}, dev AS (SELECT * FROM rows WHERE split = 'dev'), {_NEVER.format(src='dev')}, {_RESIDUAL.format(src='dev')},
routed AS (SELECT *, CASE WHEN NOT answerable OR intent IN (SELECT intent FROM never)
  OR (intent IN (SELECT intent FROM rest) AND urgency IN (SELECT urgency FROM rest)) THEN 'escalate' ELSE 'auto_respond' END AS route FROM rows)
SELECT split, count(*) AS n, count(*) FILTER (route = expected_route) AS correct,
  count(*) FILTER (must_not AND route = 'auto_respond') AS violations,
  round(count(*) FILTER (route = expected_route) / count(*), 4) AS accuracy FROM routed GROUP BY split""",
    "tuning_taxonomy_counts": f"""SELECT {b.INTENT_SQL} AS intent, count(*) AS n, min(doc_id) AS first_seen, count(*) < 3 AS rare
FROM documents GROUP BY 1""",
}
