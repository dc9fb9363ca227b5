"""Articles to retrievable chunks: heading split, paragraph packing, context restoration.

Everything stays inside the article's own row until the final explode, so chunking
never shuffles whatever the corpus size.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from deskloom.functions.text import LINE_BREAK, OTHER_BREAKS, SPACE, is_blank, let, strip
from deskloom.settings import SearchSettings

SECTION = "struct<heading:string,body:string>"
MIN_CHUNK_CHARS = 40
# Without either of these a text has no heading, and its lines need not be looked at.
HASH_LINE = rf"(?U)(?:^|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{{2028}}\x{{2029}}]){SPACE}*#"
COLON_LINE = rf"(?U):{SPACE}*(?:{LINE_BREAK}|$)"
LONG_PARAGRAPH = 1.8


def _is_heading(line: Column) -> Column:
    s = strip(line)
    return s.rlike(rf"(?U)^#{{1,6}}{SPACE}+[^\s\x1c-\x1f]") | (
        (F.length(s) > 3) & (F.length(s) < 80) & s.endswith(":") & ~s.rlike(r"^[-*|]")
    )


def _heading_text(line: Column) -> Column:
    bare = F.regexp_replace(strip(line), rf"(?U)^#{{1,6}}{SPACE}+", "")
    return strip(F.regexp_replace(bare, ":+$", ""))


def split_sections(content: Column) -> Column:
    """array<struct<heading, body>>: text cut at headings, empty-bodied sections dropped."""

    def cut(lines: Column) -> Column:
        headings = F.filter(
            F.transform(lines, lambda line, i: F.when(_is_heading(line), i + 1)),
            lambda i: i.isNotNull(),
        )
        return let(headings, lambda marks: sections(lines, marks))

    def sections(lines: Column, marks: Column) -> Column:
        def section(start: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(marks, k), F.size(lines) + 1)
            body = F.array_join(F.slice(lines, start + 1, stop - start - 1), "\n")
            heading = F.when(start == 0, F.lit("")).otherwise(
                _heading_text(F.element_at(lines, F.greatest(start, F.lit(1))))
            )
            return F.struct(heading.alias("heading"), strip(body).alias("body"))

        return F.transform(F.concat(F.array(F.lit(0)), marks), section)

    whole = F.coalesce(content, F.lit(""))
    plain = ~(F.contains(whole, F.lit("#")) & whole.rlike(HASH_LINE)) & ~(
        F.contains(whole, F.lit(":")) & whole.rlike(COLON_LINE)
    )
    # Most texts break their lines by line feeds alone and are not copied.
    other = functools.reduce(Column.__or__, [F.contains(whole, F.lit(c)) for c in OTHER_BREAKS])
    body = strip(F.when(other, F.regexp_replace(whole, LINE_BREAK, "\n")).otherwise(whole))
    one = F.array(F.struct(F.lit("").alias("heading"), body.alias("body")))
    lines = F.split(whole, LINE_BREAK, -1)
    return F.filter(F.when(plain, one).otherwise(let(lines, cut)), lambda s: s["body"] != "")


def pack(text: Column, target: int, overlap: int) -> Column:
    """Paragraphs packed up to ``target`` characters, carrying ``overlap`` characters over.

    A paragraph beyond 1.8 targets is taken sentence by sentence. The fold runs over
    one section's pieces and keeps only finished chunks plus the open one.
    """
    paragraphs = F.filter(
        F.transform(F.split(F.coalesce(text, F.lit("")), rf"(?U)\n{SPACE}*\n", -1), strip),
        lambda p: p != "",
    )
    def piece(text: Column, sentence: bool) -> Column:
        return F.struct(text.alias("text"), F.length(text).alias("n"), F.lit(sentence).alias("sentence"))

    pieces = F.flatten(
        F.transform(
            paragraphs,
            lambda p: F.when(
                F.length(p) > target * LONG_PARAGRAPH,
                F.transform(
                    F.split(p, rf"(?U)(?<=[.!?]){SPACE}+", -1),
                    lambda s: piece(s, True),
                ),
            ).otherwise(F.array(piece(p, False))),
        )
    )

    def step(state: Column, piece: Column) -> Column:
        # Lengths are carried along: the open text would be measured several times for each piece.
        open_, n = state["open"], state["n"]
        joiner = F.when(piece["sentence"], F.lit(1)).otherwise(F.lit(2))
        full = (n + piece["n"] + joiner > target) & (n > 0)
        kept = (
            F.when(full, F.right(open_, F.lit(overlap)) if overlap else F.lit("")).otherwise(open_)
        )
        kept_n = F.when(full, F.least(n, F.lit(max(overlap, 0)))).otherwise(n)
        gap_n = F.when(piece["sentence"], F.lit(1)).when(kept_n > 0, F.lit(2)).otherwise(F.lit(0))
        gap = F.when(piece["sentence"], F.lit(" ")).when(kept_n > 0, F.lit("\n\n")).otherwise(F.lit(""))
        return F.struct(
            F.when(full, F.array_append(state["done"], strip(open_)))
            .otherwise(state["done"])
            .alias("done"),
            F.concat(kept, gap, piece["text"]).alias("open"),
            (kept_n + gap_n + piece["n"]).alias("n"),
        )

    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n")
    )

    def finish(state: Column) -> Column:
        last = strip(state["open"])
        return F.filter(
            F.when(last != "", F.array_append(state["done"], last)).otherwise(state["done"]),
            lambda c: F.length(c) > MIN_CHUNK_CHARS,
        )

    return F.aggregate(pieces, start, step, finish)


def indexed_text(title: Column, section: Column, text: Column) -> Column:
    """Chunk text with its context restored; a section already named in the title is omitted."""
    named = (section != "") & ~F.contains(F.lower(title), F.lower(section))
    head = F.when(named, F.concat(title, F.lit(" — "), section)).otherwise(title)
    return F.concat(head, F.lit("\n"), text)


def chunk_documents(docs: DataFrame, settings: SearchSettings | None = None) -> DataFrame:
    """(doc_ord, doc_id, title, url, content[, sections]) to chunks numbered per document.

    ``sections`` (array<struct<heading, body>>) is used as given when present and not
    empty; otherwise ``content`` is split at headings. ``doc_ord`` and ``chunk_no`` carry
    corpus order, which breaks ties in ranking.
    """
    s = settings or SearchSettings()
    sections = split_sections(F.col("content"))
    if "sections" in docs.columns:
        given = F.col("sections").cast(f"array<{SECTION}>")
        sections = F.when(F.size(given) > 0, given).otherwise(sections)
    # A document without a parseable body is still found by its title.
    by_title = F.array(F.struct(F.lit("").alias("heading"), F.col("title").alias("body")))

    def chunks_of(section: Column) -> Column:
        def texts(packed: Column) -> Column:
            whole = F.filter(F.array(section["body"]), lambda t: ~is_blank(t))
            return F.transform(
                F.when(F.size(packed) > 0, packed).otherwise(whole),
                lambda t: F.struct(section["heading"].alias("section"), t.alias("text")),
            )

        return let(pack(section["body"], s.chunk_chars, s.chunk_overlap), texts)

    pieces = let(
        sections,
        lambda found: F.flatten(
            F.transform(F.when(F.size(found) > 0, found).otherwise(by_title), chunks_of)
        ),
    )
    return (
        docs.select(
            "doc_ord", "doc_id", "title", "url",
            F.posexplode(pieces).alias("chunk_no", "chunk"),
        )
        .select(
            F.concat("doc_id", F.lit("#"), F.col("chunk_no").cast("string")).alias("chunk_id"),
            "doc_ord", "chunk_no", "doc_id", "title", "url",
            F.col("chunk.section").alias("section"),
            F.col("chunk.text").alias("text"),
        )
    )
