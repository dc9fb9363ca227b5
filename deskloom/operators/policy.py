"""Routing policy recovered from labelled tickets, and the taxonomy built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deskloom.functions.text import strip

RARE = 3


def crosstab(rows: DataFrame) -> DataFrame:
    return rows.groupBy("answerable", "expected_route").agg(F.count("*").alias("n"))


def never_automated(rows: DataFrame) -> DataFrame:
    """Intents escalated on every ticket and flagged must-not-automate on every ticket."""
    escalate = F.avg((F.col("expected_route") == "escalate").cast("double"))
    must_not = F.avg(F.col("must_not").cast("double"))
    return (
        rows.groupBy("intent")
        .agg(F.count("*").alias("n"), escalate.alias("e"), must_not.alias("m"))
        .filter((F.col("e") == 1.0) & (F.col("m") == 1.0))
        .select("intent", "n")
    )


def residual(rows: DataFrame, never: DataFrame) -> DataFrame:
    """Escalations of answerable tickets that the never-automate intents do not explain."""
    return rows.filter((F.col("expected_route") == "escalate") & F.col("answerable")).join(
        never.select("intent"), "intent", "left_anti"
    )


def residual_pairs(unexplained: DataFrame) -> DataFrame:
    return unexplained.groupBy("intent", "urgency").agg(F.count("*").alias("n"))


def recovered(rows: DataFrame) -> DataFrame:
    """The recovered policy in one row: sorted lists over at most one entry per category."""
    never = never_automated(rows)
    rest = residual(rows, never)
    listed = lambda df, c: df.agg(F.sort_array(F.collect_set(c)).alias("x")).scalar()
    return rows.agg(F.count("*").alias("n")).select(
        "n",
        listed(never, "intent").alias("never_automate_intents"),
        listed(rest, "intent").alias("high_risk_intents"),
        listed(rest, "urgency").alias("high_risk_urgency"),
    )


def agreement(rows: DataFrame, policy: DataFrame | None = None, fit_split: str = "dev") -> DataFrame:
    """Per split, how often the recovered policy gives the labelled route, and violations.

    The policy is fitted on one split only; its lists are read as scalars.
    """
    policy = policy if policy is not None else recovered(rows.filter(F.col("split") == fit_split))
    lists = policy.select(
        F.struct("never_automate_intents", "high_risk_intents", "high_risk_urgency").alias("p")
    ).scalar()
    never, risky, urgent = (
        F.col(f"_p.{c}") for c in ("never_automate_intents", "high_risk_intents", "high_risk_urgency")
    )
    escalates = (
        ~F.col("answerable")
        | F.array_contains(never, F.col("intent"))
        | (F.array_contains(risky, F.col("intent")) & F.array_contains(urgent, F.col("urgency")))
    )
    routed = F.when(escalates, F.lit("escalate")).otherwise(F.lit("auto_respond"))
    return (
        rows.withColumn("_p", lists)
        .withColumn("routed", routed)
        .groupBy("split")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("routed") == F.col("expected_route")).alias("correct"),
            F.count_if(F.col("must_not") & (F.col("routed") == "auto_respond")).alias("violations"),
        )
        .withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 4))
    )


def build_taxonomy(labels: DataFrame, order: str) -> DataFrame:
    """Category names by frequency (ties by first occurrence) with a flag on rare ones."""
    name = F.replace(
        F.replace(F.lower(strip(F.col("intent"))), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_")
    )
    return (
        labels.filter(F.coalesce("intent", F.lit("")) != "")
        .groupBy(name.alias("intent"))
        .agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
        .withColumn("rare", F.col("n") < RARE)
        .orderBy(F.desc("n"), "first_seen")
    )
