"""Exact n-gram Jaccard join by a token-group matrix, and the components of its links.

Documents with equal sets form one class, which is the node of all that follows. MinHash bands name
leaders for each class: in each bucket and size range the class with most documents and the one with
the smallest set, and the smallest one of the next lower range. Verified pairs of class and leader
give the groups, so that similar documents share one. Which documents share a group changes the cost
only, not the result.

Every token has a place in one order: rare before frequent (by counts of all tokens in a table of
fixed size), then by hash. Two sets whose Jaccard index reaches the threshold share one of their
first n - ceil(threshold * n) + 1 tokens in that order. The matrix holds, for each group of up to
``GROUP_ROWS`` classes, the union of its members' first tokens; each class's first tokens are looked
up in it. The tokens found and those that can still be shared bound the overlap of query and group
from above; only groups that reach the threshold are opened and their members compared with the
query set by set. A group's members are linked already, so its first link with a query is enough, and
a query never opens its own component: a group of copies costs as many look-ups as it has rows, not
their square. The texts themselves are never shuffled; each step reads them once more and sends
only the tokens it needs.

A text's words are runs without white space, A-Z lower-cased. Fewer words than a shingle make one
element of the whole sequence. A null or empty text has an empty set and no links. Repeated ids
are told apart by their texts; rows with a null id have a null component. Empty table: no rows.
Tokens and classes are 64-bit hashes. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from deskloom.llm.chunks import forget
from deskloom.llm.common import admits, kept, key_filter, pick, text_buffers, text_slices
from deskloom.llm.graph import components
from deskloom.llm.hashing import bands, min_hashes, mix, set_digest, shingle_sets, words
from deskloom.session import cut_lineage

WORDS = 4
PERCENT = 85
#: Bands of MinHash rows that pick the leaders.
BANDS, ROWS = 8, 4
#: Counters of the token order (2 ** SKETCH_BITS); sent to the driver and back to the tasks.
SKETCH_BITS = 20
_SLICE = 1 << 12
#: Documents of a group of the matrix.
GROUP_ROWS = 16
#: Bits of a token's hash below its level; the sign stays free, since Spark compares keys as signed numbers.
_KEY_BITS = np.uint64(57)

SUMMARY = "doc_id long, text_key long, n long, node long, bands array<long>, slice int, counts binary"


def sets_in(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows a to b of the batch with their token sets (values, bounds)."""
    data, offsets = text_buffers(batch.column("text"))
    for a, b in text_slices(batch, "text"):
        hashes, group, _, _ = words(data, offsets[a : b + 1])
        yield a, b, *shingle_sets(hashes, group, b - a, k)


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for a, b, values, bounds in sets_in(batch, k):
                counts += np.bincount((values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
                n = b - a
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids[a:b], "text_key": keys[a:b], "n": pa.array(np.diff(bounds), pa.int64()),
                        "node": pa.array(set_digest(values, bounds)[0]),
                        "bands": pa.FixedSizeListArray.from_arrays(
                            pa.array(bands(min_hashes(values, bounds, BANDS * ROWS), ROWS).ravel()), BANDS
                        ).cast(pa.list_(pa.int64())),
                        "slice": pa.nulls(n, pa.int32()), "counts": pa.nulls(n, pa.binary()),
                    }
                )
        if counts.any():
            rows = counts.astype("<u4").reshape(-1, _SLICE)
            m = len(rows)
            yield pa.RecordBatch.from_pydict(
                {c: pa.nulls(m, pa.int64()) for c in ("doc_id", "text_key", "n", "node")}
                | {"bands": pa.nulls(m, pa.list_(pa.int64())), "slice": pa.array(range(m), pa.int32())}
                | {"counts": pa.array([r.tobytes() for r in rows], pa.binary())}
            )

    return run


def _add_counts(part: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, "<u4").astype(np.int64) for c in part["counts"])
    return pd.DataFrame({"slice": part["slice"].iloc[:1], "counts": [np.asarray(total, "<i8").tobytes()]})


def _levels(slices: list) -> np.ndarray:
    """Place of each counter in the order: quarter powers of two above the mean, 0 to 63."""
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in slices:
        total[row["slice"] * _SLICE : (row["slice"] + 1) * _SLICE] = np.frombuffer(row["counts"], "<i8")
    ratio = np.maximum(total / max(total.mean(), 1.0), 1.0)
    return np.minimum(np.log2(ratio) * 4, 63).astype(np.uint64)


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least number of shared tokens for a link of a set of n."""
    return -((-percent * n) // 100)


def _first_tokens(k: int, percent: int, levels, bits=None):
    """Each set's first tokens in the common order; with ``bits`` only those that the filter admits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        for batch in batches:
            for a, b, values, bounds in sets_in(batch, k):
                level = table[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                key = (level << _KEY_BITS) | (mix(values) >> np.uint64(7))
                size = np.diff(bounds)
                owner = np.repeat(np.arange(b - a), size)
                key = key[np.lexsort((key, owner))]
                first = size - _needed(size, percent) + 1
                keep = np.arange(len(key)) - np.repeat(bounds[:-1], size) < first[owner]
                if bits is not None:
                    keep &= admits(bits.value, key)
                at = owner[keep]
                rows = {
                    "key": pa.array(key[keep].view(np.int64)), "node": pa.array(set_digest(values, bounds)[0][at])
                }
                if bits is not None:
                    rows |= {
                        "n": pa.array(size[at]), "last": pa.array(key[(bounds[:-1] + first - 1)[at]].view(np.int64))
                    }
                yield pa.RecordBatch.from_pydict(rows)

    return run


def _sets(k: int, bits):
    """Token sets of the classes that the filter admits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, values, bounds in sets_in(batch, k):
                node = set_digest(values, bounds)[0]
                wanted = np.flatnonzero(admits(bits.value, node.view(np.uint64)) & (np.diff(bounds) > 0))
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": pa.array(node[wanted]),
                        "tokens": pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in wanted], pa.binary()),
                    }
                )

    return run


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Shared elements of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = overlap(a, b)
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; ``sets``: node, tokens."""
    left = pairs.join(sets.toDF("a", "x"), "a")
    both = left.join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_verify(percent), "a long, b long")


def _with_sets(own: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """node, tokens of the classes that the pairs name, one row for each."""
    named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    bits = own.sparkSession.sparkContext.broadcast(key_filter(named.select(F.col("node").alias("key"))))
    found = own.mapInArrow(_sets(k, bits), "node long, tokens binary").join(named, "node", "left_semi")
    return found.groupBy("node").agg(F.first("tokens").alias("tokens"))


def _leaders(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a class and the leaders that most of its bands name."""
    # Linked sets lie in the same size range or in neighbouring ones.
    size_range = F.floor(F.log("n") / float(np.log(100 / percent))).cast("int")
    spread = classes.select("node", "n", "size", size_range.alias("range"), F.posexplode("bands").alias("band", "low"))
    bucket = ["band", "low", "range"]
    chosen = spread.groupBy(*bucket).agg(
        F.max_by("node", F.struct("size", "node")).alias("most"), F.min_by("node", F.struct("n", "node")).alias("least"),
    )
    above = chosen.select("band", "low", (F.col("range") + 1).alias("range"), F.col("least").alias("lower"))
    met = spread.join(chosen, bucket).join(above, bucket, "left").select(
        "node", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("leader")) for k, c in enumerate(("most", "least", "lower"))])).alias("x")
    ).select("node", "x.*").filter("leader <> node").groupBy("node", "kind", "leader").count()
    best = met.groupBy("node", "kind").agg(F.max_by("leader", F.struct("count", "leader")).alias("leader"))
    return best.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()


def _can_reach(shared, m, percent: int):
    """Whether a set of n and one of m in a group can be linked with no more than so many shared first tokens.

    Of the set whose first tokens end earlier all others may be shared, as many as the threshold asks
    for, less one. Near copies below the threshold share most tokens, yet each has too few first
    tokens that another has: this keeps them from meeting each other.
    """
    n, last, g_last, single = (F.col(c) for c in ("n", "last", "g_last", "g_single"))
    ends = F.when(last < g_last, n).when(single & (last > g_last), m).when(single, F.least(n, m)).otherwise(F.greatest(n, m))
    rest = F.ceil(F.lit(percent) * ends / 100) - 1
    return (100 + percent) * (shared + rest) >= percent * (n + m)


def _met(member: DataFrame, percent: int) -> DataFrame:
    """``member`` (key, node, n, last, component, salt) with the groups of other components that hold the key,
    where the two can be linked: one row for each class, group and shared first token."""
    # How many of its first tokens a class can share with another component at all, and the place of each
    # among them.
    of_node = Window.partitionBy("node")
    member = member.withColumns(
        {"c": F.count("*").over(of_node), "place": F.row_number().over(of_node.orderBy("key"))}
    )
    group = ["component", "salt"]
    of_group = member.groupBy(*group).agg(
        F.min("n").alias("g_low"), F.max("n").alias("g_high"), F.min("last").alias("g_last"),
        (F.min("node") == F.max("node")).alias("g_single"), F.max("c").alias("g_c"),
    )
    places = member.groupBy("key", *group).agg(F.min("place").alias("g_first"), F.max("place").alias("g_end"))
    matrix = places.join(of_group, group).withColumnsRenamed({"component": "g_component", "salt": "g_salt"})
    # Shared ones before this token, itself, and shared ones after it: near copies whose places differ lack
    # tokens of each other. Two sets that share enough keep all their rows.
    most = F.least("place", "g_end") + F.least(F.col("c") - F.col("place"), F.col("g_c") - F.col("g_first"))
    ratio = F.lit(percent)
    return member.join(matrix, "key").filter(
        (F.col("component") != F.col("g_component")) & (100 * F.col("g_high") >= ratio * F.col("n"))
        & (ratio * F.col("g_low") <= 100 * F.col("n"))
        # Sizes between the ends reach no further than one of them.
        & (_can_reach(most, F.col("g_low"), percent) | _can_reach(most, F.col("g_high"), percent))
    )


def jaccard_components(docs: DataFrame, *, k: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    return rows_of_components(docs, k=k, percent=percent, doc_id=doc_id, text=text).drop("text_key")


def rows_of_components(docs: DataFrame, *, k: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, text_key (a 64-bit hash of the text) for each row."""
    spark: SparkSession = docs.sparkSession
    own = pick(docs, doc_id=doc_id, text=text).withColumn("text_key", F.xxhash64("text"))
    texts = own.select("text")
    summary = kept(own.mapInArrow(_summaries(k), SUMMARY), "sets")
    rows = summary.filter("slice is null").drop("slice", "counts")
    slices = summary.filter("slice is not null").select("slice", "counts").groupBy("slice").applyInPandas(
        _add_counts, "slice int, counts binary"
    )
    levels = spark.sparkContext.broadcast(_levels(slices.collect()))
    classes = kept(
        rows.filter("n > 0").groupBy("node").agg(
            F.first("n").alias("n"), F.count("*").alias("size"), F.min("doc_id").alias("least_id"),
            F.first("bands").alias("bands"),
        ),
        "classes",
    )

    # Groups: components of the links between classes and their leaders.
    first = kept(_leaders(classes, percent), "leaders")
    links = cut_lineage(verified(first, _with_sets(texts, first, k), percent))
    grouped = cut_lineage(
        classes.select("node", "n").join(components(links), "node", "left").select(
            "node", "n", F.coalesce("component", "node").alias("component")
        )
    )

    # The matrix of first tokens and groups. A first pass over the texts finds the tokens of more than
    # one class, a second one brings their rows alone; tokens of one component cannot add a link.
    keys = texts.mapInArrow(_first_tokens(k, percent, levels), "key long, node long")
    several = keys.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("key")
    bits = spark.sparkContext.broadcast(key_filter(several))
    found = texts.mapInArrow(_first_tokens(k, percent, levels, bits), "key long, node long, n long, last long")
    placed = kept(found.distinct().join(grouped.select("node", "component"), "node"), "first-tokens")
    shared = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    # Members of a large component are grouped by their size first, which keeps the bounds close.
    large = grouped.groupBy("component").agg(F.count("*").alias("of")).filter(F.col("of") > GROUP_ROWS).select("component")
    big = grouped.join(large, "component", "left_semi").groupBy("component", "n").agg(F.count("*").alias("members"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / GROUP_ROWS))
    salt = F.when(F.col("members").isNotNull(), F.xxhash64("n", part)).otherwise(F.lit(0))
    member = cut_lineage(
        placed.join(shared.select("key"), "key", "left_semi").join(big, ["component", "n"], "left").withColumn("salt", salt)
        .drop("members")
    )
    met, ratio = _met(member, percent), F.lit(percent)
    # All shared tokens up to the smaller of the two last first tokens are found. Beyond it the set
    # that ends there has as many left as the threshold asks for, less one.
    left = F.ceil(ratio * F.col("n") / 100) - 1
    left_of_member = F.ceil(ratio * F.col("g_high") / 100) - 1
    rest = F.when(F.col("last") <= F.col("g_last"), left).when(F.col("g_single"), left_of_member).otherwise(F.col("n"))
    bound = met.groupBy("node", "g_component", "g_salt").agg(
        F.count("*").alias("hits"), F.max(rest).alias("rest"), F.min("n").alias("n"), F.min("g_low").alias("g_low"),
    )
    # Shared tokens are at least percent / (100 + percent) of both sizes, and percent / 100 of the query.
    least = F.greatest(
        F.ceil(ratio * (F.col("n") + F.col("g_low")) / (100 + percent)), F.ceil(ratio * F.col("n") / 100)
    )
    opened = bound.filter(F.col("hits") + F.col("rest") >= least).select("node", "g_component", "g_salt", "n")
    members = grouped.join(big, ["component", "n"], "left").select(
        F.col("component").alias("g_component"), salt.alias("g_salt"), F.col("node").alias("b"), F.col("n").alias("b_n")
    )
    pairs = opened.join(members, ["g_component", "g_salt"]).filter(
        (100 * F.col("b_n") >= ratio * F.col("n")) & (ratio * F.col("b_n") <= 100 * F.col("n"))
    )
    pairs = kept(pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct(), "opened")
    more = verified(pairs, _with_sets(texts, pairs, k), percent)

    ends = classes.select("node", "least_id").join(components(links.union(more)), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    least_ids = ends.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = ends.select("node", "component").join(least_ids, "component").select("node", "component_id")
    named = rows.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(of_class, "node", "left")
    own_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), own_id.alias("component_id"), "text_key")


def one_of_each(docs: DataFrame, *, k: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each component: the one with the smallest id.

    Rows are told apart by id and text: an id that stands for several texts loses those alone that
    have a near duplicate, and of equal rows under one id one stays. Of several texts under the
    smallest id the one with the smallest hash stays. Rows with a null id and rows with an empty
    set all stay, in whatever number.
    """
    rows = rows_of_components(docs, k=k, percent=percent, doc_id=doc_id, text=text).filter(
        "doc_id is not null and n_shingles > 0"
    )
    # Three numbers for each distinct row; merged before the shuffle.
    distinct = kept(rows.groupBy("doc_id", "text_key").agg(
        F.first("component_id").alias("component_id"), F.count("*").alias("copies")
    ), "distinct-rows")
    stays = distinct.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("least"))
    judged = distinct.join(stays, "component_id").withColumn("stays", F.struct("doc_id", "text_key") == F.col("least"))
    own, own_text = docs[f"`{doc_id}`"], docs[f"`{text}`"]

    def matched(named: DataFrame, how: str) -> DataFrame:
        same = (own == named["doc_id"]) & (F.xxhash64(own_text) == named["text_key"])
        return docs.join(named.select("doc_id", "text_key"), same, how)

    alone = matched(judged.filter("not stays or copies > 1"), "left_anti")
    again = matched(judged.filter("stays and copies > 1"), "left_semi").dropDuplicates([doc_id, text])
    return alone.union(again)
