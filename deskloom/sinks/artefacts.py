"""Sinks: decision log, run headers, fitted artefacts, reply cache, metric exposition."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deskloom import lexicon as lx
from deskloom.operators import answerability, calibration
from deskloom.operators.decision_log import last_runs


def append_decisions(rows: DataFrame, path: str) -> None:
    """One partition folder per run, so reads of one run touch nothing else."""
    rows.write.mode("append").partitionBy("run_id").parquet(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_run_header(spark: SparkSession, path: str, **fields: str | int | None) -> None:
    """Append a header version; readers take the last one per run."""
    schema = (
        "run_id string, started_at string, finished_at string, input_path string, "
        "output_path string, ticket_count long, notes string"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    row = spark.createDataFrame([tuple(fields.get(n) for n in names)], schema)
    row.withColumn("updated_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_run_headers(spark: SparkSession, path: str) -> DataFrame:
    return last_runs(spark.read.parquet(path)).drop("updated_at")


def write_artefact(one_row: DataFrame, path: str) -> None:
    """Taxonomy, calibration, answerability, policy, sweep or floor as JSON."""
    one_row.write.mode("overwrite").json(path)


def read_artefact(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The first readable artefact among a fitted path and its fallbacks."""
    for path in paths:
        try:
            found = spark.read.json(path)
            if found.columns:
                return found
        except AnalysisException:
            continue
    return None


def publish(one_row: DataFrame, path: str, name: str) -> str:
    """Write a version of an artefact, then point to it; returns the version.

    Readers follow the pointers, so they never meet a version that is half written, and a publisher
    that dies between the two writes changes nothing. A pointer is one appended row; pointing to an
    earlier version again (:func:`point_to`) takes a newer one back.
    """
    version = uuid.uuid4().hex
    one_row.coalesce(1).write.mode("errorifexists").json(f"{path}/{name}/versions/{version}")
    point_to(one_row.sparkSession, path, name, version)
    return version


POINTER = "seq long, version string"


def point_to(spark: SparkSession, path: str, name: str, version: str) -> None:
    last = _pointers(spark, path, name)
    seq = 0 if last is None else last.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    row = spark.range(1, numPartitions=1).select(F.lit(seq + 1).cast("long").alias("seq"), F.lit(version).alias("version"))
    row.write.mode("append").json(f"{path}/{name}/pointers")


def newest_version(spark: SparkSession, path: str, name: str) -> str | None:
    """The version last pointed to, or None."""
    pointers = _pointers(spark, path, name)
    return None if pointers is None else pointers.agg(F.max_by("version", F.struct("seq", "version"))).first()[0]


def _pointers(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    try:
        return spark.read.schema(POINTER).json(f"{path}/{name}/pointers")
    except AnalysisException:  # nothing published there
        return None


def load_published(
    spark: SparkSession, name: str, schema: str, *paths: str, back: int = 3, usable: str | None = None
) -> DataFrame | None:
    """The newest readable version of an artefact, as a frame of one row, or None.

    The folders are tried in order, in each the last ``back`` published versions, newest first. A
    version counts when it is one row with every column of ``schema`` filled, for which ``usable``
    (a condition) holds. Only version names and those conditions reach the driver.
    """
    for path in paths:
        pointers = _pointers(spark, path, name)
        if pointers is None:
            continue
        newest = pointers.groupBy("version").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq"), "version").limit(back)
        for row in newest.collect():
            try:
                found = spark.read.schema(schema).json(f"{path}/{name}/versions/{row.version}")
            except AnalysisException:  # deleted since
                continue
            filled = F.expr(usable) if usable else F.lit(True)
            for column in found.columns:
                filled &= F.col(column).isNotNull()
            if found.agg(F.count("*"), F.count_if(filled)).first() == (1, 1):
                return found
    return None


TAXONOMY = "intents array<string>"


def load_taxonomy(spark: SparkSession, *paths: str) -> tuple[str, ...]:
    """The published list of intents, or the built-in one."""
    found = load_published(spark, "taxonomy", TAXONOMY, *paths, usable="size(intents) > 0")
    return tuple(found.first().intents) if found is not None else tuple(lx.TAXONOMY)


def load_calibration(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The published isotonic fit; without one, confidences are shrunk."""
    usable = "size(breakpoints) > 0 and size(breakpoints) = size(values)"
    return load_published(spark, "calibration", calibration.FIT, *paths, usable=usable)


def load_answerability(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The published model that was fitted on enough rows; without one, the built-in weights hold."""
    return load_published(spark, "answerability", answerability.MODEL, *paths, usable="enough")


def cache_key(model: Column, temperature: Column, max_tokens: Column, json_mode: Column,
              messages: Column) -> Column:
    """Digest of everything that affects a reply, keys in alphabetical order."""
    payload = F.struct(
        json_mode.alias("json_mode"), max_tokens.alias("max_tokens"), messages.alias("messages"),
        model.alias("model"), temperature.alias("temperature"),
    )
    return F.sha2(F.to_json(payload), 256)


def with_cached_replies(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (``key``) with the cached ``content``; null is a miss."""
    return requests.join(cache.select("key", "content"), "key", "left")


def cache_stats(answered: DataFrame) -> DataFrame:
    return answered.agg(
        F.count("content").alias("hits"), F.count_if(F.col("content").isNull()).alias("misses")
    )


def append_cache(replies: DataFrame, path: str) -> None:
    """New replies, one per key, under a two-character shard."""
    (
        replies.dropDuplicates(["key"])
        .withColumn("shard", F.left("key", F.lit(2)))
        .withColumn("cached_at", F.current_timestamp())
        .write.mode("append").partitionBy("shard").parquet(path)
    )


METRICS = (
    ("tickets_total", "counter", "Tickets processed.", "total", "%d"),
    ("tickets_by_action{action=\"answer\"}", "counter", "Tickets by routing action.", "answered", "%d"),
    ("tickets_by_action{action=\"escalate\"}", "counter", "Tickets by routing action.", "escalated", "%d"),
    ("tickets_by_action{action=\"blocked\"}", "counter", "Tickets by routing action.", "blocked", "%d"),
    ("degraded_total", "counter", "Tickets processed without the model provider.", "degraded", "%d"),
    ("errors_total", "counter", "Tickets that hit a processing error.", "errors", "%d"),
    ("latency_p95_seconds", "gauge", "95th percentile processing latency.", "p95_seconds", "%.4f"),
)


def exposition(operations: DataFrame, brand: str) -> DataFrame:
    """One row of Prometheus text from the one-row operations counters."""
    lines, seen = [], set()
    for name, kind, help_text, column, pattern in METRICS:
        base = name.split("{")[0]
        if base not in seen:
            seen.add(base)
            lines += [F.lit(f"# HELP {brand}_{base} {help_text}"), F.lit(f"# TYPE {brand}_{base} {kind}")]
        lines.append(F.format_string(f"{brand}_{name} {pattern}", F.col(column)))
    return operations.select(F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("exposition"))
