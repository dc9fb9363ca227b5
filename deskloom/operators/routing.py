"""The ordered rule table: one CASE chain, first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deskloom import lexicon as lx
from deskloom.functions.scoring import answerability, prior_for
from deskloom.operators.answerability import fitted_probability
from deskloom.operators.guardrails import any_blocked
from deskloom.settings import RoutingSettings


def top_score(passages: Column) -> Column:
    return F.coalesce(F.get(passages, F.lit(0))["score"], F.lit(0.0))


def predict_answerable(probability: Column, n_passages: Column, s: RoutingSettings) -> Column:
    return (n_passages > 0) & (probability >= s.answerable_threshold)


def _percent(value: Column) -> Column:
    return F.format_string("%.0f%%", value * 100)


def decide(
    intent: Column, urgency: Column, confidence: Column, warnings: Column, n_passages: Column,
    best_score: Column, probability: Column, grounding: Column, degraded: Column,
    settings: RoutingSettings | None = None,
) -> Column:
    """struct(action, rule_fired, reason) before draft- and guardrail-based overrides."""
    s = settings or RoutingSettings()
    spoken = F.replace(intent, F.lit("_"), F.lit(" "))
    answerable = predict_answerable(probability, n_passages, s)

    def rule(name: str, action: str, reason: Column) -> Column:
        return F.struct(
            F.lit(action).alias("action"), F.lit(name).alias("rule_fired"), reason.alias("reason")
        )

    def escalate(name: str, *parts) -> Column:
        words = [p if isinstance(p, Column) else F.lit(p) for p in parts]
        return rule(name, "escalate", F.concat(*words))

    chain = (
        F.when(
            intent.isin(*s.never_automate),
            escalate(lx.R1, "Tickets of kind '", spoken, "' are always handled by a person, "
                     "however confident the system is."),
        )
        .when(
            intent.isin(*s.high_risk_intents) & urgency.isin(*s.high_risk_urgency),
            escalate(lx.R2, "A ", spoken, " at ", urgency, " urgency goes to an engineer."),
        )
        .when(
            F.exists(warnings, lambda w: w.contains(lx.EMPTY_TICKET_MARKER)),
            escalate(lx.R3, "The ticket arrived without readable content."),
        )
        .when(
            confidence < s.min_confidence,
            escalate(lx.R4, "The category is only ", _percent(confidence), " certain; ",
                     f"{s.min_confidence:.0%} is required."),
        )
        .when(
            ~answerable,
            escalate(lx.R5, "The documentation probably has no answer: chance ",
                     _percent(probability), f" against {s.answerable_threshold:.0%}, best passage ",
                     F.format_string("%.2f", best_score), ". Recorded as a documentation gap."),
        )
        .when(
            grounding.isNotNull() & (grounding < s.min_grounding),
            escalate(lx.R6, "Only ", _percent(grounding), " of the draft traces to its sources; ",
                     f"{s.min_grounding:.0%} is required."),
        )
        .when(
            degraded,
            escalate(lx.R7, "The model provider was unavailable; nothing is sent while degraded."),
        )
    )
    if not s.automation_enabled:
        chain = chain.when(
            F.lit(True), escalate(lx.R9, "Automated replies are switched off by an operator.")
        )
    return chain.otherwise(
        rule(lx.R8, "answer", F.concat(
            F.lit("Understood as "), spoken, F.lit(" with "), _percent(confidence),
            F.lit(" confidence; documentation scoring "), F.format_string("%.2f", best_score),
            F.lit(" covers it and supports the reply.")))
    )


def override(decision: Column, declined: Column, findings: Column) -> Column:
    """The model declining turns an answer into an escalation; a blocking finding always wins."""
    blocked_by = F.array_join(
        F.transform(
            F.filter(findings, lambda f: f["blocked"]),
            lambda f: F.replace(f["name"], F.lit("_"), F.lit(" ")),
        ),
        ", ",
    )
    return (
        F.when(
            F.coalesce(any_blocked(findings), F.lit(False)),
            F.struct(
                F.lit("blocked").alias("action"), F.lit(lx.R0).alias("rule_fired"),
                F.concat(F.lit("The draft was stopped by the "), blocked_by,
                         F.lit(" check and handed to a person.")).alias("reason"),
            ),
        )
        .when(
            declined & (decision["action"] == "answer"),
            F.struct(
                F.lit("escalate").alias("action"), F.lit(lx.R10).alias("rule_fired"),
                F.lit("The model judged the documentation insufficient and declined to guess.")
                .alias("reason"),
            ),
        )
        .otherwise(decision)
    )


def route(rows: DataFrame, settings: RoutingSettings | None = None, model: dict | DataFrame | None = None) -> DataFrame:
    """Add ``signals`` and ``routing`` to rows that carry

    classification, retrieved, grounding (struct or null), findings, declined, degraded,
    ingest_warnings and customer_tier. ``model`` overrides the fitted answerability weights
    (keys: priors, base_rate, w_prior, w_score, bias); an empty dict means none was fitted. A frame
    of one row, as ``fit_descent`` gives it, is read as a scalar.
    """
    s = settings or RoutingSettings()
    best = top_score(F.col("retrieved"))
    if isinstance(model, DataFrame):
        rows = rows.withColumn("_model", model.select(F.struct("*").alias("m")).scalar())
        probability, method = fitted_probability(F.col("_model"), F.col("classification.intent"), best), "fitted_model"
    elif model == {}:
        probability, method = best, "retrieval_score_only"
    else:
        m = model or {}
        prior = prior_for(
            F.col("classification.intent"), m.get("priors", lx.INTENT_PRIORS),
            m.get("base_rate", lx.BASE_RATE),
        )
        probability = answerability(
            prior, best, m.get("w_prior", lx.WEIGHT_PRIOR), m.get("w_score", lx.WEIGHT_SCORE),
            m.get("bias", lx.BIAS),
        )
        method = "fitted_model"
    n = F.coalesce(F.size("retrieved"), F.lit(0))
    rows = rows.withColumn("_p", probability).withColumn("_ratio", F.col("grounding.ratio"))
    signals = F.struct(
        F.col("classification.intent").alias("intent"),
        F.col("classification.urgency").alias("urgency"),
        F.round("classification.confidence", 4).alias("classification_confidence"),
        F.col("classification.calibrated").alias("classification_calibrated"),
        F.col("classification.method").alias("classification_method"),
        predict_answerable(F.col("_p"), n, s).alias("predicted_answerable_from_docs"),
        F.round("_p", 4).alias("answerability_probability"),
        F.lit(method).alias("answerability_method"),
        n.alias("retrieved_count"),
        F.round(best, 4).alias("top_retrieval_score"),
        F.round("_ratio", 4).alias("grounding_score"),
        F.col("ingest_warnings").alias("ingest_warnings"),
        F.col("degraded").alias("degraded_mode"),
        F.col("customer_tier").alias("customer_tier"),
    )
    decision = decide(
        F.col("classification.intent"), F.col("classification.urgency"),
        F.col("classification.confidence"), F.col("ingest_warnings"), n, best, F.col("_p"),
        F.col("_ratio"), F.col("degraded"), s,
    )
    final = override(F.col("_decision"), F.col("declined"), F.col("findings"))
    return (
        rows.withColumn("signals", signals)
        .withColumn("_decision", decision)
        .withColumn("routing", final)
        .drop("_p", "_ratio", "_decision", "_model")
    )


def is_documentation_gap(rule_fired: Column) -> Column:
    return rule_fired == lx.R5


def never_automates(intent: Column, settings: RoutingSettings | None = None) -> Column:
    return intent.isin(*(settings or RoutingSettings()).never_automate)
