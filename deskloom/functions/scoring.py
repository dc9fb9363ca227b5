"""Numeric column expressions: squashing, calibration lookups, answerability, vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from deskloom import lexicon as lx
from deskloom.functions.text import sql_list


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def sigmoid(z: Column) -> Column:
    """Logistic function in the form that cannot overflow."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def logit(p: Column) -> Column:
    p = clamp(p, 1e-4, 1 - 1e-4)
    return F.ln(p / (1.0 - p))


def saturate(score: Column, half: float) -> Column:
    return F.when(score > 0, score / (score + half)).otherwise(F.lit(0.0))


def confidence(value: Column) -> Column:
    """A stated confidence as a number in [0, 1]; percentages accepted, nonsense is 0.4."""
    number = value.try_cast("double")
    return F.when(number.isNull(), F.lit(0.4)).otherwise(
        clamp(F.when(number > 1.0, number / 100.0).otherwise(number))
    )


def shrink_uncalibrated(raw: Column) -> Column:
    return F.round(F.least(F.lit(0.85), raw * 0.80), 4)


def step_lookup(raw: Column, breakpoints: Column, values: Column) -> Column:
    """Value of the greatest breakpoint not above ``raw``; the first below the range."""
    below = F.size(F.filter(breakpoints, lambda b: b <= clamp(raw)))
    chosen = F.element_at(values, F.greatest(below, F.lit(1)))
    return F.when(F.size(breakpoints) == 0, raw).otherwise(F.round(clamp(chosen), 4))


def literal_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def prior_for(intent: Column, priors: Mapping[str, float] = lx.INTENT_PRIORS,
              base_rate: float = lx.BASE_RATE) -> Column:
    table = ", ".join(f"{sql_list([k])}, {float(v)!r}D" for k, v in priors.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({table})"), intent), F.lit(base_rate))


def answerability(prior: Column, score: Column, w_prior: float = lx.WEIGHT_PRIOR,
                  w_score: float = lx.WEIGHT_SCORE, bias: float = lx.BIAS) -> Column:
    return F.round(sigmoid(F.lit(bias) + w_prior * logit(prior) + w_score * score), 4)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def threshold_step(value: Column, steps: int) -> Column:
    """Largest s in 0..steps with s / steps <= value; -1 when there is none.

    The first guess can be off by one at a boundary, so it is compared with the
    exact thresholds s / steps on both sides.
    """
    guess = F.floor(value * steps)
    step = (
        F.when((guess + 1) / F.lit(float(steps)) <= value, guess + 1)
        .when(guess / F.lit(float(steps)) > value, guess - 1)
        .otherwise(guess)
    )
    return F.greatest(F.lit(-1), F.least(F.lit(steps), step)).cast("int")
