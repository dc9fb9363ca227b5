"""Confidence calibration: reliability bins, isotonic fit, calibration error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deskloom import lexicon as lx
from deskloom.functions.scoring import step_lookup, threshold_step

MIN_SAMPLES = 30


def bin_of(confidence: Column, bins: int = 10) -> Column:
    """Equal-width bin; 1.0 belongs to the last one."""
    return F.least(threshold_step(confidence, bins), F.lit(bins - 1))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(confidence, correct) to one row per occupied bin. At most ``bins`` rows leave the shuffle."""
    return (
        rows.withColumn("bin", bin_of(F.col("confidence"), bins))
        .groupBy("bin")
        .agg(
            F.count("*").alias("n"),
            F.avg("confidence").alias("mean_confidence"),
            F.avg(F.col("correct").cast("double")).alias("accuracy"),
        )
    )


def expected_calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row (n, ece): population-weighted gap between stated confidence and accuracy."""
    gap = F.abs(F.col("mean_confidence") - F.col("accuracy"))
    return reliability(rows, bins).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.round(F.sum(F.col("n") * gap) / F.sum("n"), 4), F.lit(0.0)).alias("ece"),
    )


def pool_adjacent(bins: Column) -> Column:
    """Isotonic values of an ordered array<struct<bin, n, accuracy>>, as array<double>.

    Pooled value of position i is max over j<=i of min over k>=i of the weighted mean of
    j..k. The array never has more elements than there are bins.
    """

    def mean(j: Column, k: Column) -> Column:
        part = F.slice(bins, j, k - j + 1)
        total = F.aggregate(part, F.lit(0.0), lambda acc, b: acc + b["n"] * b["accuracy"])
        weight = F.aggregate(part, F.lit(0.0), lambda acc, b: acc + b["n"])
        return total / weight

    size = F.size(bins)
    return F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.array_max(
            F.transform(
                F.sequence(F.lit(1), i),
                lambda j: F.array_min(F.transform(F.sequence(i, size), lambda k: mean(j, k))),
            )
        ),
    )


def fit_isotonic(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row: n_samples, breakpoints array, values array. No row below 30 samples."""
    ordered = F.sort_array(F.collect_list(F.struct("bin", "n", "accuracy")))
    return (
        reliability(rows, bins)
        .agg(F.sum("n").alias("n_samples"), ordered.alias("b"))
        .filter(F.col("n_samples") >= MIN_SAMPLES)
        .select(
            "n_samples",
            F.transform("b", lambda x: x["bin"] / F.lit(float(bins))).alias("breakpoints"),
            pool_adjacent(F.col("b")).alias("values"),
        )
    )


def apply_fit(rows: DataFrame, fit: DataFrame, raw: str = "confidence") -> DataFrame:
    """Add ``calibrated``: the fit is one row of at most ``bins`` steps, read as a scalar."""
    steps = fit.select(F.struct("breakpoints", "values").alias("s")).scalar()
    return rows.withColumn("_s", steps).withColumn(
        "calibrated", step_lookup(F.col(raw), F.col("_s.breakpoints"), F.col("_s.values"))
    ).drop("_s")


#: A published isotonic fit.
FIT = "n_samples long, breakpoints array<double>, values array<double>"


def calibrator(fit: Column):
    """A function from stated to calibrated confidence by a column that holds a struct of ``FIT``."""
    return lambda raw: step_lookup(raw, fit["breakpoints"], fit["values"])


def fit_summary(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Samples, accuracy and calibration error before and after the fit, in one row."""
    fit = fit_isotonic(rows, bins)
    before = expected_calibration_error(rows, bins).select(F.col("ece").alias("ece_before"))
    after = expected_calibration_error(
        apply_fit(rows, fit, "confidence").select(
            F.col("calibrated").alias("confidence"), "correct"
        ),
        bins,
    )
    return rows.agg(
        F.count("*").alias("n_samples"),
        F.round(F.avg(F.col("correct").cast("double")), 4).alias("accuracy"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    ).select(
        "*",
        before.scalar().alias("ece_before"),
        after.select("ece").scalar().alias("ece_after"),
    ).withColumn("condition_met", F.col("ece_after") <= lx.MAX_ECE)


def usable_for_fit(rows: DataFrame) -> DataFrame:
    """Rows classified by the model and labelled; keyword fallbacks say nothing about it."""
    return rows.filter(~F.col("method").startswith("rules_fallback")).filter(
        F.col("gold_intent").isNotNull() & (F.col("gold_intent") != "")
    )


#: Parts of a stratum that are ranked by themselves before the stratum is.
SALTS = 64


def sample_order(key: str, seed: int) -> Column:
    """A digest of seed and key: the same order in every engine, and for any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest digests, without replacement.

    A bottom-k sketch: each task keeps its ``n`` smallest, and the sample of a union is the sample
    of the parts' samples.
    """
    return rows.orderBy(sample_order(key, seed), key).limit(n)


def stratified_sample(rows: DataFrame, key: str, by: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each value of ``by`` (all, where there are fewer), by the same order.

    Ranked within salted parts of a stratum first, so that no task sorts a whole stratum.
    """
    # The order goes by the first digits of the digest, the salt by the last ones.
    salt = F.conv(F.substring("_order", -2, 2), 16, 10).cast("int") % SALTS
    marked = rows.withColumn("_order", sample_order(key, seed)).withColumn("_salt", salt)
    for part in ((by, "_salt"), (by,)):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy("_order", key))
        marked = marked.withColumn("_rank", rank).filter(F.col("_rank") <= n)
    return marked.drop("_order", "_salt", "_rank")


def fit_of_sample(rows: DataFrame, key: str, n: int, bins: int = 10, seed: int = 42) -> DataFrame:
    """The isotonic fit of a reproducible sample of the rows that say something about the model."""
    return fit_isotonic(seeded_sample(usable_for_fit(rows), key, n, seed), bins)
