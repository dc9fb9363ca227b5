"""Answerability: intent priors, a two-feature logistic blend, rank-based AUC."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from deskloom.functions.scoring import answerability, logit

MIN_SAMPLES = 50
L2 = 0.01
AUC_BUCKETS = 4096
EPOCHS, RATE = 4000, 0.08
#: Scores of one intent that lie closer than this are one row of the descent's table.
CELL = 1e-4
MODEL = (
    "intent_priors map<string,double>, base_rate double, w_prior double, w_score double, bias double, "
    "n_samples long, enough boolean"
)


def intent_priors(rows: DataFrame) -> DataFrame:
    """(intent, answerable) to Laplace-smoothed rates per intent."""
    return (
        rows.groupBy(F.coalesce(F.nullif("intent", F.lit("")), F.lit("__unknown__")).alias("intent"))
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col("answerable").cast("long")).alias("positives"),
        )
        .withColumn("prior", (F.col("positives") + 1.0) / (F.col("n") + 2.0))
    )


def with_priors(rows: DataFrame, priors: DataFrame, base_rate: Column) -> DataFrame:
    """Attach ``prior``; unseen intents get the base rate. AQE broadcasts the priors if small."""
    return rows.join(priors.select("intent", "prior"), "intent", "left").withColumn(
        "prior", F.coalesce("prior", base_rate)
    )


def auc(rows: DataFrame, score: str = "score", label: str = "answerable", by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve with half credit for ties; 0.5 when one class is missing.

    Equal scores are merged first, so a score shared by a third of the rows is one row.
    The running count of negatives is taken in two levels (bucket totals, then inside the
    bucket), so no task ever sorts the whole set.
    """
    by = by or []
    positive = F.col(label).cast("long")
    merged = (
        rows.groupBy(*by, F.col(score).alias("s"))
        .agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
        .withColumn("bucket", F.floor(F.col("s") * AUC_BUCKETS))
    )
    buckets = merged.groupBy(*by, "bucket").agg(F.sum("neg").alias("bneg"))
    # At most one row per bucket: scores live in [0, 1].
    earlier = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("bneg").over(earlier), F.lit(0))).drop("bneg")
    inside = Window.partitionBy(*by, "bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    wins = merged.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(
        starts, [*by, "bucket"]
    )
    u = F.sum(F.col("pos") * (F.col("start") + F.col("below") + 0.5 * F.col("neg")))
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    value = F.when((n_pos == 0) | (n_neg == 0), F.lit(0.5)).otherwise(
        F.round(u / (n_pos.cast("double") * n_neg), 4)
    )
    return wins.groupBy(*by).agg(
        F.coalesce(n_pos, F.lit(0)).alias("positives"),
        F.coalesce(n_neg, F.lit(0)).alias("negatives"),
        F.coalesce(value, F.lit(0.5)).alias("auc"),
    )


def fit_logistic(rows: DataFrame, l2: float = L2) -> dict:
    """Weights for [logit(prior), score] and the bias.

    The penalty covers the weights and not the bias, on unstandardised features. Rows that
    agree on intent, score and label are merged into one weighted row before the
    distributed optimiser sees them. Only three numbers and the priors reach the driver.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = rows.select(
        F.coalesce(F.nullif("intent", F.lit("")), F.lit("__unknown__")).alias("intent"),
        "score", F.col("answerable").cast("double").alias("label"),
    )
    n = rows.count()
    if n < MIN_SAMPLES:
        raise ValueError(f"only {n} samples; too few to fit")
    priors = intent_priors(rows.withColumn("answerable", F.col("label")))
    merged = rows.groupBy("intent", "score", "label").agg(F.count("*").cast("double").alias("weight"))
    features = (
        merged.join(priors.select("intent", "prior"), "intent")
        .withColumn("logit_prior", logit(F.col("prior")))
    )
    vectors = VectorAssembler(inputCols=["logit_prior", "score"], outputCol="features").transform(features)
    model = LogisticRegression(
        regParam=l2, elasticNetParam=0.0, standardization=False, weightCol="weight",
        maxIter=200, tol=1e-10,
    ).fit(vectors)
    base_rate = rows.agg(F.avg("label")).first()[0]
    return {
        "priors_table": priors,
        "base_rate": round(base_rate, 4),
        "w_prior": round(float(model.coefficients[0]), 5),
        "w_score": round(float(model.coefficients[1]), 5),
        "bias": round(float(model.intercept), 5),
        "n_samples": n,
    }


def descent_cells(rows: DataFrame) -> DataFrame:
    """intent, cell, n, positives, total and hit_total (sums of scores, of all and of answerable rows) of each cell.

    One shuffle of sums. For scores in [0, 1] there are no more than 10 001 cells for each intent,
    whatever the number of rows; scores of four decimals lose nothing, others are off by less than
    1e-9 in a probability. A null score counts as 0, a null label as not answerable.
    """
    score, hit = F.coalesce(F.col("score").cast("double"), F.lit(0.0)), F.coalesce("answerable", F.lit(False)).cast("double")
    known = rows.select(
        F.coalesce(F.nullif("intent", F.lit("")), F.lit("__unknown__")).alias("intent"),
        score.alias("score"), hit.alias("hit"), F.round(score / CELL).cast("long").alias("cell"),
    )
    return known.groupBy("intent", "cell").agg(
        F.count("*").cast("double").alias("n"), F.sum("hit").alias("positives"), F.sum("score").alias("total"),
        F.sum(F.col("score") * F.col("hit")).alias("hit_total"),
    )


def _descend(epochs: int, rate: float, l2: float):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["intent", "cell"])
        sums = cells.groupby("intent")[["positives", "n"]].sum()
        priors = (sums["positives"] + 1) / (sums["n"] + 2)
        clamped = priors.clip(1e-4, 1 - 1e-4)
        f = cells["intent"].map(np.log(clamped / (1 - clamped))).to_numpy()
        n, hits, total, hit_total = (cells[c].to_numpy() for c in ("n", "positives", "total", "hit_total"))
        score, rows = total / n, n.sum()
        # The parts of the gradient that the labels alone give.
        of_prior, of_score, of_bias = (hits * f).sum(), hit_total.sum(), hits.sum()
        w_prior, w_score, bias = 1.0, 0.0, 0.0
        for _ in range(epochs):
            p = 1 / (1 + np.exp(-np.clip(bias + w_prior * f + w_score * score, -700, 700)))
            step = np.array([(n * p * f).sum() - of_prior, (total * p).sum() - of_score, (n * p).sum() - of_bias])
            w_prior, w_score, bias = np.array([w_prior, w_score, bias]) - rate * (
                step / rows + l2 * np.array([w_prior, w_score, 0.0])
            )
        return pd.DataFrame(
            [{
                "intent_priors": priors.to_dict(), "base_rate": round(float(of_bias / rows), 4),
                "w_prior": round(float(w_prior), 5), "w_score": round(float(w_score), 5), "bias": round(float(bias), 5),
                "n_samples": int(rows), "enough": bool(rows >= MIN_SAMPLES),
            }]
        )

    return run


def fit_descent(rows: DataFrame, epochs: int = EPOCHS, rate: float = RATE, l2: float = L2) -> DataFrame:
    """One row of ``MODEL``: the weights that so many full-batch gradient steps reach; none for no rows.

    Rows are (intent, score, answerable). Spark merges them into the cells of :func:`descent_cells`;
    that table's size does not grow with the rows, and one task takes the steps on it. Small sets are
    fitted like others, ``enough`` says whether there were ``MIN_SAMPLES`` rows.
    """
    return descent_cells(rows).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_descend(epochs, rate, l2), MODEL)


def fitted_probability(model: Column, intent: Column, score: Column) -> Column:
    """Probability by a struct of ``MODEL``; an intent that the fit has not seen gets the base rate."""
    prior = F.coalesce(F.try_element_at(model["intent_priors"], intent), model["base_rate"])
    return answerability(prior, score, model["w_prior"], model["w_score"], model["bias"])


def with_probability(rows: DataFrame, model: dict) -> DataFrame:
    """Add ``p`` from a model of :func:`fit_logistic`."""
    scored = with_priors(rows, model["priors_table"], F.lit(model["base_rate"]))
    return scored.withColumn(
        "p",
        answerability(
            F.col("prior"), F.col("score"), model["w_prior"], model["w_score"], model["bias"]
        ),
    )


def compare_scorers(rows: DataFrame, scorers: dict[str, str], label: str = "answerable") -> DataFrame:
    """AUC of several score columns side by side, from one pass over the rows."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("scorer"), F.col(c).alias("score")) for n, c in scorers.items()]
    )
    long = rows.select(F.explode(pairs).alias("x"), label).select("x.scorer", "x.score", label)
    return auc(long, "score", label, ["scorer"])
