"""Exact order statistics without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deskloom.session import cut_lineage


def running_counts(rows: DataFrame, value: str | Column) -> DataFrame:
    """(v, c, upto): each distinct value, its count, and the count of all values up to it.

    Equal values are merged first. Values are dealt out by ranges, so each task sorts its own
    range; only one total for each range meets in one place.
    """
    column = F.col(value) if isinstance(value, str) else value
    merged = rows.select(column.alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    # Written down, as the numbers of the ranges are read twice.
    dealt = cut_lineage(merged.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("c").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("here", F.sum("c").over(inside)).join(starts, "part").select(
        "v", "c", (F.col("here") + F.col("start")).alias("upto")
    )


def _at(place: Column) -> Column:
    """The value at a zero-based place."""
    return F.min(F.when(F.col("upto") > place, F.col("v")))


def nearest_rank(rows: DataFrame, value: str | Column, fractions: dict[str, float]) -> DataFrame:
    """One row: for each name the value at floor(n * fraction), null without rows."""
    counts = running_counts(rows, value)
    total = counts.agg(F.max("upto").alias("n"))
    return counts.join(F.broadcast(total)).agg(
        *[_at(F.floor(F.col("n") * F.lit(p))).alias(name) for name, p in fractions.items()]
    )


def interpolated(rows: DataFrame, value: str | Column, fractions: dict[str, float]) -> DataFrame:
    """One row: for each name the percentile between the two neighbouring values."""
    counts = running_counts(rows, value)
    total = counts.agg(F.max("upto").alias("n"))
    places = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in fractions.items()}
    found = counts.join(F.broadcast(total)).agg(
        F.max("n").alias("n"),
        *[_at(F.floor(at)).alias(f"low_{name}") for name, at in places.items()],
        *[_at(F.ceil(at)).alias(f"high_{name}") for name, at in places.items()],
    )
    return found.select(
        *[
            (F.col(f"low_{name}") + (F.col(f"high_{name}") - F.col(f"low_{name}")) * (at - F.floor(at))).alias(name)
            for name, at in places.items()
        ]
    )
