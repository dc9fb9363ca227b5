"""Order-dependent figures per key without sorting a whole key in one task.

Each key's history is cut into time buckets. Figures inside a bucket come from a window
on (key, bucket); what earlier buckets contribute comes from one aggregated row per
bucket. A key that holds a third of all rows is as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MICROS = 1_000_000


def with_bucket(rows: DataFrame, ts: str, seconds: int) -> DataFrame:
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return rows.withColumn("_us", micros).withColumn(
        "_bucket", F.floor(F.col("_us") / (seconds * MICROS))
    )


def with_index(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``_i``, the zero-based position within the key; needs ``_bucket``."""
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_r", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_bucket"])
        .withColumn("_i", F.col("_offset") + F.col("_r"))
        .drop("_offset", "_r")
    )


def with_running_max(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Add the maximum of ``value`` over the key's rows up to and including this one; needs ``_i``."""
    rows = rows.withColumn("_v", value)
    peaks = rows.groupBy(*keys, "_bucket").agg(F.max("_v").alias("_peak"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = peaks.select(*keys, "_bucket", F.max("_peak").over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_local", F.max("_v").over(inside))
        .join(carried, [*keys, "_bucket"])
        .withColumn(name, F.greatest("_local", "_carry"))
        .drop("_local", "_carry", "_v")
    )


def trailing_counts(rows: DataFrame, keys: list[str], ts: str, seconds: int = 60) -> DataFrame:
    """Add ``in_window``: the key's rows in the ``seconds`` up to this one.

    A row can only matter to its own bucket and the next, so each row is sent to both.
    """
    cut = with_bucket(rows, ts, seconds)
    sent = cut.withColumn("_home", F.col("_bucket")).withColumn(
        "_bucket", F.explode(F.array(F.col("_bucket"), F.col("_bucket") + 1))
    )
    window = (
        Window.partitionBy(*keys, "_bucket").orderBy("_us").rangeBetween(-seconds * MICROS, 0)
    )
    return (
        sent.withColumn("in_window", F.count("*").over(window))
        .filter(F.col("_bucket") == F.col("_home"))
        .drop("_home", "_bucket", "_us")
    )


def paced_admissions(
    rows: DataFrame, keys: list[str], ts: str, tie: str, per_minute: int = 20,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Add ``wait_seconds``: how long a sliding-window limiter would hold each request.

    At most ``per_minute`` requests enter in any 60 seconds, in arrival order. Request i
    enters at max(arrival, entry of request i - per_minute + 60 s). Unrolled along every
    per_minute-th request this is 60 q + max(arrival - 60 q), a running maximum.
    """
    minute = 60 * MICROS
    cut = with_index(with_bucket(rows, ts, bucket_seconds), keys, ["_us", tie])
    cut = cut.withColumn("_chain", F.pmod("_i", F.lit(per_minute))).withColumn(
        "_q", F.floor(F.col("_i") / per_minute)
    )
    paced = with_running_max(cut, [*keys, "_chain"], F.col("_us") - F.col("_q") * minute, "_slack")
    entry = F.col("_slack") + F.col("_q") * minute
    return paced.withColumn("wait_seconds", (entry - F.col("_us")) / MICROS).drop(
        "_us", "_bucket", "_i", "_chain", "_q", "_slack"
    )


def failure_runs(
    rows: DataFrame, keys: list[str], ts: str, tie: str, failed: Column,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Add ``consecutive_failures``: failures since the key's last success, 0 on a success."""
    cut = with_index(with_bucket(rows, ts, bucket_seconds), keys, ["_us", tie])
    last = with_running_max(cut, keys, F.when(~failed, F.col("_i")), "_last_ok")
    return last.withColumn(
        "consecutive_failures", F.col("_i") - F.coalesce("_last_ok", F.lit(-1))
    ).drop("_us", "_bucket", "_i", "_last_ok")


def breaker_openings(runs: DataFrame, threshold: int = 5) -> DataFrame:
    """Moments at which a run of failures reaches the threshold."""
    return runs.filter(F.col("consecutive_failures") == threshold)
