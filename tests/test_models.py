"""Fits that are published and loaded again, and what triage does with them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from deskloom import lexicon as lx
from deskloom.operators import answerability as an
from deskloom.operators import calibration as ca
from deskloom.plans import triage as tr
from deskloom.sinks import artefacts as sk

ROWS = "intent string, score double, answerable boolean"


def labelled(n, seed=3):
    rng = random.Random(seed)
    rates = {"how_to_question": 0.9, "bug_report": 0.4, None: 0.2}
    out = []
    for _ in range(n):
        intent = rng.choice(list(rates))
        score = round(rng.random(), 4)
        out.append((intent, score, rng.random() < rates[intent] * (0.6 + 0.4 * score)))
    return out


def plain_descent(data, epochs):
    key = [i or "__unknown__" for i, _, _ in data]
    prior = {k: (sum(y for j, (_, _, y) in zip(key, data) if j == k) + 1) / (key.count(k) + 2) for k in set(key)}
    points = [(math.log(prior[k] / (1 - prior[k])), s, float(y)) for k, (_, s, y) in zip(key, data)]
    a, c, d = 1.0, 0.0, 0.0
    for _ in range(epochs):
        errors = [1 / (1 + math.exp(-(d + a * f + c * s))) - y for f, s, y in points]
        ga, gc = (sum(e * p[i] for e, p in zip(errors, points)) / len(points) for i in (0, 1))
        a, c, d = a - 0.08 * (ga + 0.01 * a), c - 0.08 * (gc + 0.01 * c), d - 0.08 * sum(errors) / len(points)
    return prior, (a, c, d)


def test_descent_takes_the_same_steps(spark):
    data = labelled(120)
    model = an.fit_descent(spark.createDataFrame(data, ROWS).repartition(3), epochs=500).first()
    prior, weights = plain_descent(data, 500)
    assert model.intent_priors == pytest.approx(prior)
    assert (model.w_prior, model.w_score, model.bias) == pytest.approx(weights, abs=1.1e-5)
    assert (model.n_samples, model.enough) == (120, True)
    # Not fully converged: the number of steps is part of the result.
    assert (model.w_prior, model.bias) != pytest.approx(plain_descent(data, 4)[1][::2], abs=1e-3)


def test_descent_of_few_rows_nulls_and_none(spark):
    rows = spark.createDataFrame([("a", 0.5, True), ("a", None, None), (None, 0.2, False)], ROWS)
    model = an.fit_descent(rows, epochs=10).first()
    assert (model.n_samples, model.enough) == (3, False) and set(model.intent_priors) == {"a", "__unknown__"}
    assert an.fit_descent(rows.limit(0)).collect() == []


def test_cells_do_not_grow_with_the_rows(spark):
    rows = spark.range(60_000).select(
        F.lit("a").alias("intent"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003).alias("score"),
        (F.col("id") % 3 == 0).alias("answerable"),
    )
    cells = an.descent_cells(rows).agg(F.count("*").alias("cells"), F.sum("n").alias("n")).first()
    assert cells.cells <= 10_001 and cells.n == 60_000


def model_row(spark, **change):
    fields = {"intent_priors": {"bug_report": 0.5}, "base_rate": 0.5, "w_prior": 1.0, "w_score": 2.0, "bias": 0.0,
              "n_samples": 90, "enough": True} | change
    return spark.createDataFrame([tuple(fields.values())], an.MODEL)


def test_published_versions_and_fallbacks(spark, tmp_path):
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    assert sk.load_answerability(spark, first, second) is None
    sk.publish(model_row(spark, bias=1.0), second, "answerability")
    assert sk.load_answerability(spark, first, second).first().bias == 1.0
    old = sk.publish(model_row(spark, bias=2.0), first, "answerability")
    assert sk.load_answerability(spark, first, second).first().bias == 2.0
    sk.publish(model_row(spark, bias=3.0), first, "answerability")
    assert sk.load_answerability(spark, first, second).first().bias == 3.0
    sk.point_to(spark, first, "answerability", old)
    assert sk.load_answerability(spark, first).first().bias == 2.0
    # A version that was never pointed to, one of too few rows, one that is broken and one that is gone.
    model_row(spark, bias=9.0).write.json(f"{first}/answerability/versions/alone")
    sk.publish(model_row(spark, bias=4.0, enough=False), first, "answerability")
    broken = sk.publish(model_row(spark, w_score=None), first, "answerability")
    assert sk.load_answerability(spark, first).first().bias == 2.0
    sk.point_to(spark, first, "answerability", "gone")
    assert broken and sk.load_answerability(spark, first, second).first().bias == 1.0  # only three are looked at
    assert sk.load_taxonomy(spark, first) == tuple(lx.TAXONOMY)
    sk.publish(spark.createDataFrame([(["x", "y"],)], sk.TAXONOMY), first, "taxonomy")
    assert sk.load_taxonomy(spark, first) == ("x", "y")


def test_triage_uses_what_was_published(spark, tmp_path):
    intent = next(i for i in lx.TAXONOMY if i not in lx.NEVER_AUTOMATE and i not in lx.HIGH_RISK_INTENTS)
    reply = f'{{"intent": "{intent}", "urgency": "low", "confidence": 0.9}}'
    text = "How do I export the quarterly report as a spreadsheet?"
    tickets = spark.createDataFrame(
        [(0, "t-1", "email", text, text, [], None, reply, "Open the report and choose export. [S1]")],
        "position long, ticket_id string, channel string, model_text string, raw_text string, ingest_warnings array<string>, "
        "customer_tier string, classifier_reply string, reply string",
    )
    passages = spark.createDataFrame([([(1, "c", "d", "Export", text, 0.5, None, None, None, 0.5)],)], f"retrieved {tr.PASSAGES}")
    rows = tickets.join(passages)
    folder = str(tmp_path)
    sk.publish(spark.createDataFrame([(40, [0.0, 0.8], [0.2, 0.7])], ca.FIT), folder, "calibration")
    sk.publish(model_row(spark, intent_priors={"other": 0.9}, base_rate=0.75), folder, "answerability")
    fitted = tr.decide(rows, model=sk.load_answerability(spark, folder), calibration=sk.load_calibration(spark, folder)).first()
    built_in = tr.decide(rows, model=sk.load_answerability(spark, f"{folder}/x"), calibration=sk.load_calibration(spark, f"{folder}/x")).first()
    assert (fitted.classification.confidence, fitted.classification.calibrated) == (0.7, True)
    assert (built_in.classification.confidence, built_in.classification.calibrated) == (0.72, False)
    assert fitted.signals.answerability_probability == round(1 / (1 + math.exp(-(math.log(3) + 2.0 * 0.5))), 4)
    assert built_in.signals.answerability_probability != fitted.signals.answerability_probability
    assert not {"_fit", "_model"} & set(fitted.asDict())
