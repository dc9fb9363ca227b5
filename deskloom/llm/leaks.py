"""Benchmark passages in documents, exact or with a few edits, by the q-gram lemma.

An item of m characters with at most k edits keeps m - q + 1 - k * q of its q-grams, all within k
diagonals of each other (diagonal: place in the document less place in the item). So the q-grams
that a document shares with the items are counted in overlapping diagonal bands; bands that reach
an item's bound are regions, and each region is verified by an alignment that stays within the
band. Nothing with up to k edits is missed, and nothing with more is reported.

Texts are compared in lower case (A-Z) with runs of white space as one space. An item's edit budget
is ``RATE`` of its length; items too short for the lemma have no budget and must occur exactly.
The benchmark is the stated query set: it goes to the tasks in blocks of a fixed size, as many as
it needs, and each block meets all documents.

Null or empty texts and items match nothing. Null ids stay null. Repeated ids
give one row each. Documents without a leak are not in the result. Empty tables: no rows.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deskloom.llm.common import pick, text_buffers, text_slices
from deskloom.llm.hashing import _LOWER, _VALUES, _tables, mix

Q = 12
RATE = 0.05
#: Characters of the items that are sent to the tasks at once, about.
BLOCK_CHARS = 4_000_000
#: Bytes of a document that are searched at once; pieces overlap by the longest item.
PIECE = 1 << 20
_BITS = 22

SCHEMA = "doc_id long, item_id long, distance int, start long, end long"


def normal(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case with runs of white space as one space, and the place each had."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    if len(data):
        keep[0] = not space[0]
    at = np.flatnonzero(keep)
    out = _LOWER[data[at]]
    out[space[at]] = 0x20
    return out, at


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q bytes from each place on."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _tables(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUES[data] * power[: len(data)], out=total[1:])
    return mix((total[q:] - total[:n]) * inverse[:n])


@dataclass
class Index:
    """The q-grams of a block of items."""

    ids: list[int]
    items: list[bytes]
    budgets: np.ndarray
    least: np.ndarray  # shared q-grams that a region needs
    width: int  # diagonals of half a band, a power of two above every budget
    keys: np.ndarray
    bounds: np.ndarray  # of the keys' places
    item_at: np.ndarray
    place_at: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]], rate: float = RATE) -> Index:
        found = [(i, normal(np.frombuffer(t.encode(), np.uint8))[0].tobytes().strip()) for i, t in rows if t]
        found = [(i, t) for i, t in found if t]
        ids, items = [i for i, _ in found], [t for _, t in found]
        sizes = np.array([len(t) for t in items], np.int64)
        budgets = (sizes * rate).astype(np.int64)
        least = sizes - Q + 1 - budgets * Q
        budgets[least < 1] = 0
        least = np.maximum(sizes - Q + 1 - budgets * Q, 1)
        width = 1 << int(max(budgets.max(initial=0), 1)).bit_length()
        hashes = [grams(np.frombuffer(t, np.uint8)) for t in items]
        owner = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        keys, first = np.unique(every[order], return_index=True)
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[(keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        return cls(
            ids, items, budgets, least, width, keys, np.append(first, len(every)), owner[order], place[order], bitmap
        )

    @property
    def short(self) -> list[int]:
        """Items without a q-gram: found by plain search."""
        return [n for n, t in enumerate(self.items) if len(t) < Q]

    def regions(self, data: np.ndarray) -> list[tuple[int, int]]:
        """(item, lowest diagonal) of the bands that reach their item's bound."""
        hashes = grams(data)
        at = np.flatnonzero(self.bitmap[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return []
        slot = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[slot] == hashes[at]
        at, slot = at[hit], slot[hit]
        count = self.bounds[slot + 1] - self.bounds[slot]
        if not count.sum():
            return []
        place = np.repeat(at, count)
        nth = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
        posting = np.repeat(self.bounds[slot], count) + nth
        item, diagonal = self.item_at[posting], place - self.place_at[posting]
        # A band is two half bands wide and starts at each half band, so any budget fits in one.
        half = diagonal // self.width
        half = np.concatenate((half, half - 1)) + 1_000_000
        key, n = np.unique((np.concatenate((item, item)) << 44) | half, return_counts=True)
        item, half = key >> 44, (key & ((1 << 44) - 1)) - 1_000_000
        good = n >= self.least[item]
        return list(zip(item[good].tolist(), (half[good] * self.width).tolist()))

    def align(self, data: np.ndarray, item: int, low: int) -> tuple[int, int, int] | None:
        """Edits, first and end byte of the best match within a band, None above the budget."""
        word, k = self.items[item], int(self.budgets[item])
        m = len(word)
        base = low - k
        span = 2 * self.width + 2 * k + 1
        window = data[max(base, 0) : max(base + span + m, 0)]
        exact = window.tobytes().find(word)
        if exact >= 0:
            return 0, max(base, 0) + exact, max(base, 0) + exact + m
        if not k:
            return None
        # Column o of row i stands for i bytes of the item and base + i + o bytes of the text. A cell
        # holds edits and the first byte of the match in one number.
        text = np.full(m + span, -1, np.int16)
        ahead = max(-base, 0)  # places before the text, where no match can start
        text[ahead : ahead + len(window)] = window[: len(text) - ahead]
        columns = np.arange(span)
        edit = 1 << 24
        cells = np.where(columns >= ahead, columns, 1 << 60)
        for i, byte in enumerate(word):
            taken = cells + np.where(text[i : i + span] == byte, 0, edit)
            taken[:-1] = np.minimum(taken[:-1], cells[1:] + edit)  # a byte of the item left out
            # A byte of the text left out: from any cell to the left, one edit for each step.
            cells = np.minimum.accumulate(taken - columns * edit) + columns * edit
        ends = columns + m
        cells = np.where(ends <= ahead + len(window), cells, 1 << 60)
        o = int(cells.argmin())
        distance, first = int(cells[o]) >> 24, int(cells[o]) & (edit - 1)
        return (distance, base + first, base + m + o) if distance <= k else None

    def find(self, data: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Best match of each item in some text."""
        best: dict[int, tuple[int, int, int]] = {}
        for item, low in self.regions(data):
            if (match := self.align(data, item, low)) and (item not in best or match < best[item]):
                best[item] = match
        whole = data.tobytes() if self.short else b""
        for item in self.short:
            at = whole.find(self.items[item])
            if at >= 0:
                best[item] = (0, at, at + len(self.items[item]))
        return best


def matches(own: Index, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, start, end) of the best match of each item in each text of a column."""
    overlap = max(map(len, own.items), default=0) * 2 + 4 * own.width
    data, offsets = text_buffers(texts)
    rows: list[tuple] = []
    for a, b in text_slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
        block = data[offsets[a] : offsets[b]]
        if b - a == 1 and len(block) > PIECE:
            best: dict[int, tuple] = {}
            for x in range(0, len(block), PIECE):
                for item, match in _placed(own, block[x : x + PIECE + overlap], x):
                    best[item] = min(best.get(item, match), match)
            rows += [(a, item, *_points(block, match)) for item, match in best.items()]
            continue
        # All texts of the slice at once; regions are looked at text by text.
        bounds = offsets[a : b + 1] - offsets[a]
        for row in _texts_with_hits(own, block, bounds):
            text = block[bounds[row] : bounds[row + 1]]
            rows += [(a + row, item, *_points(text, match)) for item, match in _placed(own, text, 0)]
    return rows


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        for batch in batches:
            rows = matches(own, batch.column("text"))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())),
                    "item_id": pa.array([own.ids[r[1]] for r in rows], pa.int64()),
                    "distance": pa.array([r[2] for r in rows], pa.int32()),
                    "start": pa.array([r[3] for r in rows], pa.int64()),
                    "end": pa.array([r[4] for r in rows], pa.int64()),
                }
            )

    return run


def _drop(index, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r[0] for r in matches(index.value, batch.column(batch.schema.get_field_index(text)))]] = False
            yield batch.filter(pa.array(keep))

    return run


def _placed(index: Index, raw: np.ndarray, shift: int) -> list[tuple[int, tuple[int, int, int]]]:
    """Items and their matches, as bytes of the text as it stands."""
    data, at = normal(raw)
    return [(i, (d, int(at[x]) + shift, int(at[y - 1]) + 1 + shift)) for i, (d, x, y) in index.find(data).items()]


def _points(raw: np.ndarray, match: tuple[int, int, int]) -> tuple[int, int, int]:
    """The match in code points; a character that is cut counts whole."""
    distance, x, y = match
    while y < len(raw) and raw[y] & 0xC0 == 0x80:
        y += 1
    while x > 0 and raw[x] & 0xC0 == 0x80:
        x -= 1
    before = int(((raw[:x] & 0xC0) != 0x80).sum())
    return distance, before, before + int(((raw[x:y] & 0xC0) != 0x80).sum())


def _texts_with_hits(index: Index, block: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Texts that share enough q-grams with the items of the block, whatever the diagonal."""
    if index.short:
        return list(range(len(offsets) - 1))
    data, at = normal(block)
    hashes = grams(data)
    hits = np.flatnonzero(index.bitmap[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
    owner = np.searchsorted(offsets, at[hits], side="right") - 1
    count = np.bincount(owner, minlength=len(offsets) - 1)
    return np.flatnonzero(count >= index.least.min(initial=1)).tolist()


def blocks(benchmark: DataFrame, *, item_id: str = "item_id", item_text: str = "text", rate: float = RATE,
           block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """The benchmark in indexes of about ``block_chars`` characters each."""
    items = pick(benchmark, item_id=item_id, text=item_text).filter(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for block in range(n):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).dropDuplicates()
        rows = sorted(((r["item_id"], r["text"]) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        index = Index.of(rows, rate)
        if index.items:
            yield index


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                    **of_benchmark) -> DataFrame:
    """doc_id, item_id, distance, start, end (code points): the best match of each item in each row."""
    spark = docs.sparkSession
    own = pick(docs, doc_id=doc_id, text=text)
    found = [
        own.mapInArrow(_search(spark.sparkContext.broadcast(index)), SCHEMA)
        for index in blocks(benchmark, **of_benchmark)
    ]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], SCHEMA)


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **of_benchmark) -> DataFrame:
    """The rows, all columns, that hold no item."""
    for index in blocks(benchmark, **of_benchmark):
        docs = docs.mapInArrow(_drop(docs.sparkSession.sparkContext.broadcast(index), text), docs.schema)
    return docs
