"""Content-addressed replies: one table of (key, content), read by key, appended without repeats.

The rows lie in folders by the first two characters of the key, below the generation that a pointer
names. An append adds only keys that its folders lack, so a replayed batch adds nothing. Two writers
that race may both add a key; readers take its earliest row. ``compact`` writes a new generation of
one file a folder and points to it; a row appended to the old one meanwhile is asked for again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from deskloom.sinks.artefacts import newest_version, point_to

NAME = "replies"
SCHEMA = "key string, content string, cached_at timestamp, shard string"


def _generation(spark: SparkSession, path: str) -> str:
    """Folder of the generation in use; the first is named when nothing was pointed to."""
    return f"{path}/{NAME}/generations/{newest_version(spark, path, NAME) or 'first'}"


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(folder)


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """(shard, key, content): the earliest reply of each key, of equally early ones the least."""
    first = F.min(F.struct("cached_at", "content"))
    return _rows(spark, _generation(spark, path)).groupBy("shard", "key").agg(first.alias("r")).select(
        "shard", "key", F.col("r.content").alias("content")
    )


def append_replies(replies: DataFrame, path: str) -> None:
    """Add the replies (``key``, ``content``) whose keys are not stored; null keys and contents are left out.

    Of several replies to one key in the batch the least is stored, so that a replay stores the same.
    Only the folders of the batch's keys are read, and of them only the keys.
    """
    spark = replies.sparkSession
    folder = _generation(spark, path)
    new = (
        replies.filter(F.col("key").isNotNull() & F.col("content").isNotNull())
        .groupBy("key").agg(F.min("content").alias("content")).withColumn("shard", F.left("key", F.lit(2)))
    )
    stored = _rows(spark, folder).select("shard", "key")
    (
        new.join(stored, ["shard", "key"], "left_anti")
        .withColumn("cached_at", F.current_timestamp())
        .select("key", "content", "cached_at", "shard")
        .write.mode("append").partitionBy("shard").parquet(folder)
    )


def compact(spark: SparkSession, path: str) -> str:
    """One row a key and one file a folder, in a new generation; returns its name."""
    generation = uuid.uuid4().hex
    rows = _rows(spark, _generation(spark, path)).groupBy("shard", "key").agg(
        F.min(F.struct("cached_at", "content")).alias("r")
    )
    (
        rows.select("key", "r.content", "r.cached_at", "shard")
        .repartition("shard").sortWithinPartitions("shard", "key")
        .write.partitionBy("shard").parquet(f"{path}/{NAME}/generations/{generation}")
    )
    point_to(spark, path, NAME, generation)
    return generation


def with_stored_replies(requests: DataFrame, path: str) -> DataFrame:
    """Requests (``key``, …) with ``content``; null is a miss. Equal requests share one stored row."""
    stored = read_replies(requests.sparkSession, path).drop("shard")
    return requests.join(stored, "key", "left")
