"""Connected components of links that live in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deskloom.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``links`` (a, b: long).

    Each round points every node at the smallest node it knows, first for larger neighbours, then
    for smaller ones, so a chain of n nodes takes about log n rounds. Aggregates run before the
    shuffles; rounds are cut by checkpoints in the shared folder. Links to null are left out.
    """
    edges = links.select("a", "b").filter("a <> b").distinct()
    edges = cut_lineage(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct())
    nodes = edges.select(F.col("low").alias("node")).union(edges.select("high")).distinct()
    state = None
    while True:
        # Larger neighbours of a node are linked to the smallest of its neighbours and itself.
        both = edges.union(edges.select(F.col("high").alias("low"), F.col("low").alias("high"))).toDF("n", "other")
        least = both.groupBy("n").agg(F.least(F.min("other"), F.col("n")).alias("m"))
        large = both.join(least, "n").filter("other > n").select(F.col("m").alias("low"), F.col("other").alias("high"))
        large = large.filter("low <> high").distinct()
        # Smaller neighbours and the node itself are linked to the smallest of them.
        least = large.groupBy(F.col("high").alias("n")).agg(F.min("low").alias("m"))
        small = large.join(least, large["high"] == least["n"]).select("m", F.explode(F.array("low", "n")).alias("high"))
        edges = cut_lineage(small.filter("m <> high").select(F.col("m").alias("low"), "high").distinct())
        # The edges have settled when they are the same stars as before.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
