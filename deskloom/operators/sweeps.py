"""Threshold sweeps. Rows are counted once per threshold step, never once per threshold.

Each sweep maps a value to the largest step it reaches, aggregates per step (at most a
hundred rows), and obtains "at or above the threshold" as a running sum over those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deskloom import lexicon as lx
from deskloom.functions.scoring import threshold_step


def at_or_above(rows: DataFrame, value: str, steps: int, counts: dict[str, Column],
                last: int | None = None, by: list[str] | None = None) -> DataFrame:
    """One row per threshold step / steps with each count over rows whose value reaches it.

    Also ``total_<name>`` over all rows. ``last`` ends the grid early.
    """
    by = by or []
    last = steps if last is None else last
    names = list(counts)
    per_step = (
        rows.withColumn("step", F.greatest(threshold_step(F.col(value), steps), F.lit(-1)))
        .groupBy(*by, "step")
        .agg(*[F.sum(c.cast("long")).alias(n) for n, c in counts.items()])
    )
    spark = rows.sparkSession
    # Thresholds of the grid plus one slot for values below zero; rows of the grid per group.
    grid = F.explode(F.sequence(F.lit(-1), F.lit(steps))).alias("step")
    if by:
        frame = per_step.select(*by).distinct().select(*by, grid)
    else:
        frame = spark.range(1).select(grid)
    everything = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    downward = everything.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    filled = frame.join(per_step, [*by, "step"], "left").fillna(0, names)
    sums = {n: F.sum(n).over(downward) for n in names}
    totals = {f"total_{n}": F.sum(n).over(everything) for n in names}
    return (
        filled.withColumns({**{f"_{n}": c for n, c in sums.items()}, **totals})
        .drop(*names)
        .withColumnsRenamed({f"_{n}": n for n in names})
        .filter((F.col("step") >= 0) & (F.col("step") <= last))
        .withColumn("threshold", F.col("step") / F.lit(float(steps)))
        .drop("step")
    )


def ratio(a: Column, b: Column, default: float) -> Column:
    return F.when(b == 0, F.lit(default)).otherwise(a / b)


def answerability_sweep(rows: DataFrame, cost_ratio: float = 8.0) -> DataFrame:
    """(p, answerable): precision, recall, F1 and cost for thresholds 0.00 to 1.00."""
    label = F.col("answerable")
    counts = at_or_above(rows, "p", 100, {"tp": label, "fp": ~label})
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("total_tp") - tp
    precision = ratio(tp, tp + fp, 1.0)
    recall = ratio(tp, F.col("total_tp"), 0.0)
    f1 = ratio(2 * precision * recall, precision + recall, 0.0)
    return counts.select(
        "threshold", "tp", "fp", fn.alias("fn"), precision.alias("precision"),
        recall.alias("recall"), f1.alias("f1"), (cost_ratio * fp + fn).alias("cost"),
    )


def best_points(sweep: DataFrame) -> DataFrame:
    """First threshold with the best F1 and first with the lowest cost."""
    t = F.col("threshold")
    return sweep.agg(
        F.max_by("threshold", F.struct("f1", -t)).alias("best_f1_threshold"),
        F.max("f1").alias("best_f1"),
        F.min_by("threshold", F.struct(F.col("cost"), t)).alias("best_cost_threshold"),
        F.min("cost").alias("best_cost"),
    )


def cost_sensitivity(rows: DataFrame, ratios=lx.COST_RATIOS) -> DataFrame:
    """Cheapest threshold per cost ratio and the escalation share it implies."""
    label = F.col("answerable")
    sweep = at_or_above(rows, "p", 100, {"tp": label, "fp": ~label})
    total = F.col("total_tp") + F.col("total_fp")
    priced = sweep.select(
        "threshold", F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("cost_ratio"),
        "fp", (F.col("total_tp") - F.col("tp")).alias("fn"),
        (1.0 - (F.col("tp") + F.col("fp")) / total).alias("escalation_share"),
    ).withColumn("cost", F.col("cost_ratio") * F.col("fp") + F.col("fn"))
    first = F.struct(F.col("cost"), F.col("threshold"))
    return priced.groupBy("cost_ratio").agg(
        F.min_by("threshold", first).alias("threshold"),
        F.min("cost").alias("cost"),
        F.round(F.min_by("escalation_share", first), 4).alias("escalation_share"),
    )


def confidence_sweep(rows: DataFrame, cost_ratio: float = 8.0) -> DataFrame:
    """(confidence, answerable, correct): what automating at each confidence would do."""
    answerable, correct = F.col("answerable"), F.col("correct")
    counts = at_or_above(
        rows, "confidence", 20,
        {"automated": answerable, "right": answerable & correct, "n": F.lit(True)},
    )
    unnecessary = F.col("total_right") - F.col("right")
    wrong = F.col("automated") - F.col("right")
    return counts.select(
        "threshold", "automated", F.col("right").alias("correct_auto"), wrong.alias("wrong_auto"),
        unnecessary.alias("unnecessary"),
        F.round(ratio(F.col("automated"), F.col("total_n"), 0.0), 4).alias("deflection"),
        (cost_ratio * wrong + unnecessary).alias("cost"),
    )


def confidence_sensitivity(rows: DataFrame, ratios=lx.COST_RATIOS) -> DataFrame:
    """Cheapest confidence threshold per cost ratio, first on ties."""
    sweep = confidence_sweep(rows).withColumn(
        "cost_ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios]))
    )
    cost = F.col("cost_ratio") * F.col("wrong_auto") + F.col("unnecessary")
    return sweep.withColumn("cost", cost).groupBy("cost_ratio").agg(
        F.min_by("threshold", F.struct("cost", "threshold")).alias("threshold"),
        F.min("cost").alias("cost"),
    )


def floor_sweep(rows: DataFrame) -> DataFrame:
    """(score, answerable): kept and falsely retrieved shares for floors 0.00 to 0.60."""
    label = F.col("answerable")
    counts = at_or_above(rows, "score", 100, {"kept": label, "false_hits": ~label}, last=60)
    return counts.select(
        F.col("threshold").alias("floor"), "kept", "false_hits",
        (F.col("total_kept") + F.col("total_false_hits") - F.col("kept") - F.col("false_hits"))
        .alias("nothing"),
        ratio(F.col("kept"), F.col("total_kept"), 0.0).alias("recall"),
        ratio(F.col("false_hits"), F.col("total_false_hits"), 0.0).alias("false_rate"),
    )


def choose_floor(sweep: DataFrame, max_false_rate: float = 0.35) -> DataFrame:
    """Lowest floor within the allowed false retrieval rate; null when there is none."""
    ok = F.col("false_rate") <= max_false_rate
    first = F.when(ok, F.col("floor"))
    return sweep.agg(
        F.min(first).alias("chosen_floor"),
        F.min_by("recall", first).alias("recall_at_floor"),
        F.min_by("false_rate", first).alias("false_retrieval_at_floor"),
    )


def policy_escalates(intent: Column, urgency: Column, never, high_risk, high_urgency) -> Column:
    return intent.isin(*never) | (intent.isin(*high_risk) & urgency.isin(*high_urgency))


def routing_curve(
    rows: DataFrame, never=lx.NEVER_AUTOMATE, high_risk=lx.HIGH_RISK_INTENTS,
    high_urgency=lx.HIGH_RISK_URGENCY, by: list[str] | None = None,
) -> DataFrame:
    """(p, intent, urgency, expected_route, must_not): routing agreement per threshold.

    Above the threshold a ticket is automated unless the policy escalates it; below it is
    escalated. Agreement at a threshold is therefore one running sum and its complement.
    """
    reserved = policy_escalates(F.col("intent"), F.col("urgency"), never, high_risk, high_urgency)
    expects_auto = F.coalesce(F.col("expected_route") == "auto_respond", F.lit(False))
    expects_escalate = F.coalesce(F.col("expected_route") == "escalate", F.lit(False))
    agrees_above = F.when(reserved, expects_escalate).otherwise(expects_auto)
    counts = at_or_above(
        rows, "p", 100,
        {
            "agree_above": agrees_above,
            "escalate_above": expects_escalate,
            "unsafe": F.col("must_not") & ~reserved,
            "n": F.lit(True),
        },
        by=by,
    )
    return counts.select(
        *(by or []), "threshold",
        (F.col("agree_above") + F.col("total_escalate_above") - F.col("escalate_above")).alias("correct"),
        "unsafe",
        (F.col("total_n") - F.col("n")).alias("gaps"),
        F.col("total_n").alias("n"),
    )


def routing_plateau(curve: DataFrame) -> DataFrame:
    """Highest threshold with the best agreement, the whole plateau, and gaps at both ends."""
    t, c = F.col("threshold"), F.col("correct")
    top = F.struct(c, t)
    return curve.agg(
        F.max_by("threshold", top).alias("chosen_threshold"),
        F.max("correct").alias("correct"),
        F.max_by("threshold", F.struct(c, -t)).alias("plateau_min"),
        F.max_by("threshold", top).alias("plateau_max"),
        F.max_by("gaps", top).alias("gaps_at_choice"),
        F.max_by("gaps", F.struct(c, -t)).alias("gaps_at_lowest"),
    )


def route_accuracy(
    rows: DataFrame, threshold: float, never=lx.NEVER_AUTOMATE, high_risk=lx.HIGH_RISK_INTENTS,
    high_urgency=lx.HIGH_RISK_URGENCY,
) -> DataFrame:
    """Per split: agreement with predicted and with labelled answerability, and unsafe answers."""
    reserved = policy_escalates(F.col("intent"), F.col("urgency"), never, high_risk, high_urgency)

    def routed(answerable: Column) -> Column:
        return F.when(~answerable | reserved, F.lit("escalate")).otherwise(F.lit("auto_respond"))

    predicted, labelled = routed(F.col("p") >= threshold), routed(F.col("answerable"))
    agree = lambda r: F.sum((r == F.col("expected_route")).cast("long"))
    return rows.groupBy("split").agg(
        F.count("*").alias("n"),
        agree(predicted).alias("correct_predicted"),
        agree(labelled).alias("correct_labelled"),
        F.sum((F.col("must_not") & (predicted == "auto_respond")).cast("long")).alias("unsafe"),
    )
