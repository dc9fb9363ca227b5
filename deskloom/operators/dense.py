"""Exact cosine top-k over unit vectors, pruned by cells and computed in bounded blocks.

Vectors are assigned to the nearest of some pivots. By the triangle
inequality on angles, a cell can be skipped for a query when even its best possible
vector is worse than the query's ``depth``-th best from the nearest cells. Neighbouring
cells form bins, and a query goes once to each bin with a cell that it cannot skip: where
nothing can be skipped, a vector is copied as often as there are bins, not cells. What remains
is an equi-join on (bin, slice, query block): both sides of every group are bounded, so
a cell holding a third of the corpus is many tasks, and each task emits only its top
``depth`` per query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from deskloom.session import cut_lineage

KEY = ["doc_ord", "chunk_no"]
PIVOTS = 64
MOST_PIVOTS = 4096
# Corpus vectors of a bin and of a slice of a large cell, and queries that meet them in one group.
SLICE_ROWS = 16384
QUERY_BLOCK = 16384
# Fewer queries than this are not worth a block of their own.
LEAST_BLOCK = 1024
# Rows of a table of products or angles that exists at once.
TILE_ROWS = 256
ANGLE_SLACK = 1e-6
# Rounding of a product of unit vectors, which may exceed 1.
SIM_SLACK = 1e-9


def unit_rows(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def choose_pivots(corpus: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """At most ``count`` corpus vectors, chosen by hash: a fixed-size read, whatever the corpus."""
    rows = corpus.select("vec").orderBy(F.xxhash64(*KEY), *KEY).limit(count).collect()
    return unit_rows([r["vec"] for r in rows]) if rows else np.empty((0, 0))


def _tiles(pdf: pd.DataFrame):
    """The frame in pieces of ``TILE_ROWS`` rows."""
    for at in range(0, len(pdf), TILE_ROWS):
        yield pdf.iloc[at : at + TILE_ROWS]


def assign_cells(corpus: DataFrame, pivots: np.ndarray) -> DataFrame:
    def assign(batches):
        for pdf in batches:
            for tile in _tiles(pdf):
                angles = _angles(unit_rows(tile["vec"]), pivots)
                cell = angles.argmin(axis=1)
                yield tile.assign(
                    cell=cell.astype("int32"), angle=angles[np.arange(len(tile)), cell]
                )

    return corpus.select(*KEY, "vec").mapInPandas(
        assign, "doc_ord long, chunk_no int, vec array<float>, cell int, angle double"
    )


def _block_top(depth: int, per_document: int | None = None):
    columns = ["query_id", *KEY, "dense"]

    def top(corpus: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(corpus) or not len(queries):
            return pd.DataFrame(columns=columns)
        # In key order: ties go to the earlier chunk.
        corpus = corpus.sort_values(KEY, kind="stable")
        doc, chunk = corpus["doc_ord"].to_numpy(), corpus["chunk_no"].to_numpy()
        vectors = unit_rows(corpus["vec"])
        new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if per_document is not None else np.arange(len(doc))
        found = []
        for tile in _tiles(queries):
            sims = np.clip(unit_rows(tile["vec"]) @ vectors.T, 0.0, 1.0)
            # What ``depth`` documents reach is a bound; a chunk below it is not among the best.
            if len(new) > depth:
                best = np.maximum.reduceat(sims, new, axis=1)
                bound = np.partition(best, len(new) - depth, axis=1)[:, len(new) - depth]
            else:
                bound = np.zeros(len(tile))
            row, col = np.nonzero(sims >= bound[:, None])
            dense = sims[row, col]
            order = np.lexsort((col, -dense, row))
            row, col, dense = row[order], col[order], dense[order]
            if per_document is not None:
                of_document = pd.DataFrame({"row": row, "doc": doc[col]}).groupby(["row", "doc"]).cumcount()
                few = (of_document < per_document).to_numpy()
                row, col, dense = row[few], col[few], dense[few]
            ahead = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, dense = row[ahead < depth], col[ahead < depth], dense[ahead < depth]
            found.append(pd.DataFrame(
                {"query_id": tile["query_id"].to_numpy()[row], "doc_ord": doc[col], "chunk_no": chunk[col], "dense": dense}
            ))
        return pd.concat(found)

    return top


@dataclass(frozen=True)
class CellIndex:
    """Corpus vectors with their cell as a written table, and one entry per cell."""

    celled: DataFrame
    centres: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray

    @property
    def bins(self) -> np.ndarray:
        """The bin of each cell: neighbours together, about ``SLICE_ROWS`` vectors; a larger cell is its own."""
        few = self.centres[: max(1, int(self.sizes.sum()) // SLICE_ROWS)]
        order = np.argsort(_angles(self.centres, few).argmin(axis=1), kind="stable")
        bins, current, held = np.empty(len(order), dtype="int32"), 0, 0
        for cell in order:
            if held and held + self.sizes[cell] > SLICE_ROWS:
                current, held = current + 1, 0
            bins[cell], held = current, held + self.sizes[cell]
        return bins


def build_cells(corpus: DataFrame, pivots: int | None = None) -> CellIndex | None:
    """Assign every vector of (doc_ord, chunk_no, vec) once; None for an empty corpus.

    The number of cells grows as the square root of the corpus, up to a table that fits each task.
    """
    if pivots is None:
        pivots = min(max(PIVOTS, math.isqrt(corpus.count())), MOST_PIVOTS)
    points = choose_pivots(corpus, pivots)
    if not len(points):
        return None
    celled = cut_lineage(assign_cells(corpus, points))
    # One row per pivot: at most ``pivots`` rows reach the driver.
    cells = (
        celled.groupBy("cell")
        .agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        .orderBy("cell")
        .collect()
    )
    ids = np.array([r["cell"] for r in cells], dtype="int32")
    return CellIndex(
        celled, points[ids], ids, np.array([r["n"] for r in cells]), np.array([r["radius"] for r in cells])
    )


def _lookup(values: dict, key: str):
    return F.element_at(F.create_map(*[F.lit(int(x)) for pair in values.items() for x in pair]), F.col(key))


def _probe(index: CellIndex, visits: DataFrame, blocks: int, depth: int, per_document: int | None):
    """Score each visit (query_id, vec, bin) against its bin and keep the best ``depth``."""
    bins = index.bins
    slices = -(-np.bincount(bins, weights=index.sizes).astype("int64") // SLICE_ROWS)
    n_slices = _lookup(dict(enumerate(slices)), "bin")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    right = visits.withColumn("slice", F.explode(F.sequence(F.lit(0), n_slices - 1))).withColumn("block", block)
    # A bin's vectors go to the blocks of queries that visit it, and to no others.
    visited = visits.select("bin", block.alias("block")).distinct()
    celled = index.celled.select(*KEY, "vec", _lookup(dict(zip(index.ids, bins)), "cell").alias("bin"))
    left = celled.withColumn("slice", F.pmod(F.xxhash64(*KEY), n_slices).cast("int")).join(visited, "bin")
    groups = ["bin", "slice", "block"]
    local = (
        left.groupBy(*groups)
        .cogroup(right.groupBy(*groups))
        .applyInPandas(
            _block_top(depth, per_document), "query_id string, doc_ord long, chunk_no int, dense double"
        )
    )
    return keep_best(local, depth, per_document)


def keep_best(scored: DataFrame, depth: int, per_document: int | None = None) -> DataFrame:
    order = [F.desc("dense"), *KEY]
    if per_document is not None:
        of_document = Window.partitionBy("query_id", "doc_ord").orderBy(*order)
        scored = scored.withColumn("n", F.row_number().over(of_document)).filter(F.col("n") <= per_document).drop("n")
    best = Window.partitionBy("query_id").orderBy(*order)
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= depth)
        .drop("rank")
    )


def nearest(queries: DataFrame, corpus: DataFrame | CellIndex | None, depth: int, pivots: int | None = None,
            per_document: int | None = None) -> DataFrame:
    """(query_id, chunk key, dense): the ``depth`` best chunks by clamped cosine, exactly, and of a
    document at most ``per_document``.

    ``queries`` is (query_id string, vec); ``corpus`` is (doc_ord, chunk_no, vec) or its index.
    """
    index = build_cells(corpus, pivots) if isinstance(corpus, DataFrame) else corpus
    if index is None:
        return queries.sparkSession.createDataFrame(
            [], "query_id string, doc_ord long, chunk_no int, dense double"
        )
    sizes, radii, centres, bins = index.sizes, index.radii, index.centres, index.bins
    asked, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-asked // QUERY_BLOCK), min(cores, asked // LEAST_BLOCK))

    def visits(tile: pd.DataFrame, cells: np.ndarray) -> pd.DataFrame:
        """A row for each query and bin that holds a cell marked for it."""
        of_bin = np.zeros((len(tile), bins.max() + 1), dtype=bool)
        row, cell = np.nonzero(cells)
        of_bin[row, bins[cell]] = True
        row, to = np.nonzero(of_bin)
        return tile[["query_id", "vec"]].iloc[row].assign(bin=to.astype("int32"))

    def home_bins(batches):
        """The bins of the nearest cells of each query, just enough of them to hold ``depth`` vectors."""
        for pdf in batches:
            for tile in _tiles(pdf):
                order = np.argsort(_angles(unit_rows(tile["vec"]), centres), axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                cells = np.zeros(order.shape, dtype=bool)
                np.put_along_axis(cells, order, before < depth, axis=1)
                yield visits(tile, cells)

    def open_bins(batches):
        """Bins of cells that may still hold something at least as good as the query's bound."""
        for pdf in batches:
            for tile in _tiles(pdf):
                gap = _angles(unit_rows(tile["vec"]), centres) - radii - ANGLE_SLACK
                reach = np.maximum(np.cos(np.clip(gap, 0.0, np.pi)), 0.0)
                yield visits(tile, reach + SIM_SLACK >= tile["bound"].to_numpy()[:, None])

    visit = "query_id string, vec array<float>, bin int"
    queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "vec")
    first = _probe(index, queries.mapInPandas(home_bins, visit), blocks, depth, per_document)
    bounds = first.groupBy("query_id").agg(
        F.when(F.count("*") >= depth, F.min("dense")).otherwise(F.lit(0.0)).alias("bound")
    )
    bounded = queries.join(bounds, "query_id", "left").select(
        "query_id", "vec", F.coalesce("bound", F.lit(0.0)).alias("bound")
    )
    return _probe(index, bounded.mapInPandas(open_bins, visit), blocks, depth, per_document)


def score_pairs(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Attach the clamped cosine to given (query_id, chunk key) pairs; no vector means 0."""

    def cosine(batches):
        for pdf in batches:
            dense = np.zeros(len(pdf))
            known = (pdf["qvec"].notna() & pdf["cvec"].notna()).to_numpy()
            if known.any():
                a, b = unit_rows(pdf["qvec"][known]), unit_rows(pdf["cvec"][known])
                dense[known] = np.clip((a * b).sum(axis=1), 0.0, 1.0)
            yield pdf.drop(columns=["qvec", "cvec"]).assign(dense=dense)

    joined = (
        pairs.select("query_id", *KEY, "lexical")
        .join(queries.select("query_id", F.col("vec").alias("qvec")), "query_id", "left")
        .join(corpus.select(*KEY, F.col("vec").alias("cvec")), KEY, "left")
    )
    return joined.mapInPandas(
        cosine, "query_id string, doc_ord long, chunk_no int, lexical double, dense double"
    )
