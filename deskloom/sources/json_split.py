"""Records of JSON files of any size, each file read by many tasks.

The text scan is told that lines end with ``}``, so files split into blocks like any text and a row
holds what lies between two closing braces. Whether a block begins inside a string, and how deep,
depends on everything before it. So a first pass sums up each block for both cases: is a string open
at its end, how far did the depth move, which key was last at each level. A scan over the blocks of
a file, one small row each, turns that into the state every block begins in. A second pass cuts the
elements of the outermost list, of the lists under wrapper keys, or the entries of the outermost
object. Only elements that cross a block's end meet in a shuffle. Memory of a task is one Arrow
batch and one element.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from deskloom.session import cut_lineage

STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*("|\\?\Z)', re.S)
TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("|\\?\Z)|[{}\[\],:]', re.S)
SUMMARY = "path string, block long, inside boolean, bytes long, size long, ends_inside boolean, moved int, keys string, first string"
STATE = "path string, block long, inside boolean, depth int, key string, listed boolean, kind string"
PIECE = "path string, block long, seq long, key string, part string, text string"
#: Parts of an element, a list under a wrapper key that begins here, and text after the outermost value.
WHOLE, HEAD, MIDDLE, TAIL, LIST, MORE, SKIP = "whole", "head", "middle", "tail", "list", "more", "skip"
#: Rows of a small side up to which it is sent to all tasks.
BROADCAST_ROWS = 100_000


def _name(raw: str) -> str:
    try:
        return json.loads(raw)
    except ValueError:
        return raw


class Scanner:
    """Follows strings, depth and keys through text that comes in slices."""

    def __init__(self, inside: bool = False, depth: int = 0):
        self.inside, self.escaped, self.depth = inside, False, depth
        self.keys: dict[int, list] = {}
        self.open_string: list[str] = []
        self.last = self.before = ""

    def tokens(self, text: str) -> Iterator[tuple[str, int]]:
        """(sign, place) of each structural sign outside strings, the depth being that before the sign."""
        at = 0
        if self.inside and text:
            if self.escaped:
                at, self.escaped = 1, False
            found = STRING_END.match(text, at)
            self.open_string.append(text[: found.end()])
            if found.group(1) != '"':
                self.escaped = found.group(1) == "\\"
                return
            self.inside, at = False, found.end()
            self._string("".join(self.open_string))
        for found in TOKEN.finditer(text, at):
            sign = text[found.start()]
            if sign == '"':
                if found.group(1) == '"':
                    self._string(found.group())
                else:
                    self.inside, self.escaped, self.open_string = True, found.group(1) == "\\", [found.group()]
                continue
            if sign == ":":
                self.keys[self.depth] = [self.last, False]
            elif sign == "[" and self.before == ":":
                self.keys[self.depth][1] = True
            yield sign, found.start()
            self.depth += (sign in "{[") - (sign in "}]")
            self.before = sign

    def _string(self, raw: str) -> None:
        self.last, self.before, self.open_string = raw, '"', []


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, list[bytes]]]:
    """(path, block), file size and pieces, in order; a block comes in one run after the other."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("path", "block", "size", "value")]
        run: list[bytes] = []
        now = size = None
        for path, block, length, value in zip(*columns, strict=True):
            if (path, block) != now:
                if run:
                    yield now, size, run
                now, size, run = (path, block), length, []
            run.append(value)
        if run:
            yield now, size, run


def _text(run: list[bytes]) -> str:
    return "".join([v.decode(errors="replace") + "}" for v in run])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block does to the state, for a beginning outside and inside of a string."""
    now, size, count, first, both = None, 0, 0, "", ()

    def close() -> pa.RecordBatch:
        rows = [
            (*now, start, count, size, s.inside, s.depth, json.dumps({r: k for r, k in s.keys.items() if r <= 1}), first)
            for start, s in zip((False, True), both)
        ]
        names = [part.split()[0] for part in SUMMARY.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for block, length, run in _runs(batches):
        if block != now:
            if now is not None:
                yield close()
            now, size, count, first, both = block, length, 0, "", (Scanner(), Scanner(inside=True))
        text = _text(run)
        count += sum(map(len, run)) + len(run)
        first = first or text.lstrip()[:1]
        for scanner in both:
            for _ in scanner.tokens(text):
                pass
    if now is not None:
        yield close()


def _states(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of one file begins, and what kind of file it is."""
    by_block = {b: g.set_index("inside") for b, g in blocks.groupby("block")}
    inside, depth, key, listed, total = False, 0, None, False, 0
    rows, first = [], ""
    for block in sorted(by_block):
        own = by_block[block].loc[inside]
        rows.append((own["path"], block, inside, depth, key, listed))
        first = first or own["first"]
        keys = {int(r): k for r, k in json.loads(own["keys"]).items()}
        key, listed = keys.get(1 - depth, (key, listed))
        inside, depth, total = bool(own["ends_inside"]), depth + int(own["moved"]), total + int(own["bytes"])
    # After the last piece of a file that does not end with a brace one was counted too many.
    depth += total != int(own["size"])
    whole = not inside and depth == 0
    kind = {"[": "list", "{": "object"}.get(first, "lines") if whole else "lines"
    return pd.DataFrame([(*r, kind) for r in rows], columns=[p.split()[0] for p in STATE.split(", ")])


def _pieces(wrappers: tuple[str, ...]):
    """Blocks with their states -> elements, and the parts of elements that cross a block's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now = cutter = None

        def close() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = [p.split()[0] for p in PIECE.split(", ")]
            columns = zip(*out) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            states = {
                (p, b): (i, d, k, li, kind)
                for p, b, i, d, k, li, kind in zip(*[batch.column(c).to_pylist() for c in ("path", "block", "inside", "depth", "key", "listed", "kind")])
            }
            for block, _, pieces in _runs(iter([batch])):
                if block != now:
                    if cutter:
                        out += cutter.end()
                    now, cutter = block, _Cutter(*block, *states[block], wrappers)
                out += cutter.feed(_text(pieces))
            yield close()
            out = []
        if cutter:
            out += cutter.end()
        yield close()

    return run


class _Cutter:
    """Cuts one block of known beginning into elements, and tells which parts belong to other blocks' elements."""

    def __init__(self, path, block, inside, depth, key, listed, kind, wrappers):
        self.path, self.block, self.kind, self.wrappers = path, block, kind, wrappers
        self.scan = Scanner(inside, depth)
        if key is not None:
            self.scan.keys[1] = [key, listed]
        self.seqs: dict[str | None, int] = {}
        self.held: list[str] = []
        self.level = 2 if self._in_list() and depth >= 2 else 1
        # A block ends with a brace, so what begins deeper than the outermost value goes on with an element.
        self.part = TAIL if depth else WHOLE
        self.over = not depth and block > 0
        self.begun_deep, self.listed = depth > 0, False

    def _in_list(self) -> bool:
        key = self.scan.keys.get(1)
        return self.kind == "object" and key is not None and key[1] and _name(key[0]) in self.wrappers

    def _row(self, part: str, text: str | None) -> tuple:
        key = _name(self.scan.keys[1][0]) if self.level == 2 else None
        seq = self.seqs.get(key, 0)
        if part in (WHOLE, HEAD):
            self.seqs[key] = seq + 1
        return self.path, self.block, seq, key, part, text

    def _element(self, more: str) -> Iterator[tuple]:
        """The element that ends here, if there is one."""
        text = "".join([*self.held, more])
        if self.part == TAIL or self.part == WHOLE and text.strip():
            yield self._row(self.part, text)
        self.held, self.part = [], WHOLE

    def feed(self, text: str) -> list[tuple]:
        out, begun = [], 0
        for sign, place in self.scan.tokens(text):
            depth = self.scan.depth
            if depth == 0:
                if sign in "}]":
                    self.scan.depth = 1  # the brace that was not there: the depth stays at 0
                elif self.over or sign in ",:":
                    out.append(self._row(MORE, None))
                begun = place + 1
            elif depth == self.level and sign in ",}]":
                out += self._element(text[begun:place])
                begun = place + 1
                if sign == "]" and depth == 2:
                    self.level, self.part = 1, SKIP
                elif sign != ",":
                    self.over = True
                    if sign == "}" and not self.seqs and not self.begun_deep and not self.listed:
                        out.append(self._row(WHOLE, ""))  # an object without entries is still a record
            elif depth == 1 and sign == "[" and self._in_list():
                self.held, begun, self.level, self.part = [], place + 1, 2, WHOLE
                self.listed = True
                out.append(self._row(LIST, None))
        if not self.over:
            self.held.append(text[begun:])
        elif text[begun:].strip("} \t\r\n"):
            out.append(self._row(MORE, None))
        return out

    def end(self) -> list[tuple]:
        """The head of an element that goes on in the next block, or more of one that began before."""
        text = "".join(self.held)
        if self.over or self.part == SKIP or not self.scan.depth:
            return []
        return [self._row(MIDDLE if self.part == TAIL else HEAD, text)]


def _joined(parts: pd.DataFrame) -> pd.DataFrame:
    """The parts of one file's elements that cross blocks -> whole elements."""
    # Within a block what goes on comes before what begins.
    rows = sorted(parts.itertuples(index=False), key=lambda r: (r.block, r.part == HEAD))
    out, head, held = [], None, []
    for r in rows:
        if r.part == HEAD:
            head, held = r, [r.text]
            continue
        held.append(r.text)
        if r.part == TAIL and head is not None:
            out.append((r.path, head.block, head.seq, head.key, WHOLE, "".join(held)))
            head = None
    return pd.DataFrame(out, columns=[p.split()[0] for p in PIECE.split(", ")])


def _small(df: DataFrame) -> DataFrame:
    """Sent to all tasks if it is small; otherwise the join's own way."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _numbered(rows: DataFrame, *more: str) -> DataFrame:
    """Adds ``at``: place among the rows of a path (and ``more``), from (block, seq), seq counting from 0 in each block."""
    keys = ["path", *more]
    counts = rows.groupBy(*keys, "block").count()
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(counts.select(*keys, "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")))
    same = [rows[k].eqNullSafe(starts[k]) for k in (*keys, "block")]
    at = (F.col("start") + F.col("seq")).alias("at")
    return rows.join(_small(starts), same).select(*[rows[c] for c in rows.columns], at)


@dataclass
class SplitFiles:
    """What a path's JSON files hold, by kind; ``at`` counts from 0 in each file.

    ``elements``: (path, at, text) of outermost lists and of the first wrapper list a file has.
    ``entries``: (path, at, text) ``"key": value`` of objects without such a list; of ``{}`` one empty text.
    ``lines``: (path, at, text) of files that are not one list or object, by lines of any kind.
    ``files``: (path, file_no), numbered in the order of the paths.
    """

    elements: DataFrame
    entries: DataFrame
    lines: DataFrame
    files: DataFrame


def split_json(spark: SparkSession, path: str, wrappers: tuple[str, ...], lines_of) -> SplitFiles:
    """``lines_of``: column function from a stretch of text without a line end to its records' texts."""
    wrappers = tuple(wrappers)
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"),
    )
    states = cut_lineage(raw.mapInArrow(_summaries, SUMMARY).groupBy("path").applyInPandas(_states, STATE))
    few = states.count() <= BROADCAST_ROWS
    one = states.filter("kind <> 'lines'")
    # A broadcast join leaves the rows of a block in order; any other has to put them back.
    numbered = raw if few else raw.withColumn("row", F.monotonically_increasing_id())
    stated = numbered.join(F.broadcast(one) if few else one, ["path", "block"])
    if not few:
        stated = stated.repartition("path", "block").sortWithinPartitions("path", "block", "row").drop("row")
    pieces = stated.mapInArrow(_pieces(wrappers), PIECE)
    parts = pieces.filter(F.col("part").isin(HEAD, MIDDLE, TAIL)).groupBy("path").applyInPandas(_joined, PIECE)
    cut = pieces.filter(F.col("part") == WHOLE).unionByName(parts)
    place = F.array_position(F.array(*[F.lit(w) for w in wrappers]), F.col("key"))
    seen = pieces.filter(F.col("part").isin(LIST, MORE)).groupBy("path").agg(
        F.min(F.when(F.col("part") == LIST, place)).alias("list"), F.max(F.col("part") == MORE).alias("more")
    )
    files = states.groupBy("path").agg(F.first("kind").alias("kind")).join(seen, "path", "left")
    files = cut_lineage(
        files.select(
            "path", F.when(F.coalesce("more", F.lit(False)), F.lit("lines")).otherwise(F.col("kind")).alias("kind"),
            F.get(F.array(*[F.lit(w) for w in wrappers]), (F.col("list") - 1).cast("int")).alias("list"),
            (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("file_no"),
        )
    )
    kinds = _small(files.select("path", "kind", "list"))
    found = _numbered(cut, "key").join(kinds, "path").filter("kind <> 'lines'")
    wanted = F.col("key").eqNullSafe(F.col("list"))
    elements = found.filter((F.col("kind") == "list") | F.col("list").isNotNull() & wanted)
    entries = found.filter((F.col("kind") == "object") & F.col("list").isNull())
    text = (
        spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
        .join(_small(files.filter("kind = 'lines'").select("path")), "path", "left_semi")
        .select("path", "block", F.monotonically_increasing_id().alias("row"), F.posexplode(lines_of(F.col("value"))).alias("sub", "text"))
    )
    in_block = Window.partitionBy("path", "block").orderBy("row", "sub")
    lines = _numbered(text.select("path", "block", (F.row_number().over(in_block) - 1).cast("long").alias("seq"), "text"))
    return SplitFiles(*[x.select("path", "at", F.trim("text").alias("text")) for x in (elements, entries, lines)], files.select("path", "file_no"))


def whole_objects(entries: DataFrame) -> DataFrame:
    """(path, text): each file's object again, from its entries; such a file is one record."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda e: e["text"])
    return entries.groupBy("path").agg(F.concat(F.lit("{"), F.array_join(ordered, ","), F.lit("}")).alias("text"))
