"""Line-first cleaning and the fixed quality figures, as column expressions only.

Lines are judged one by one: closing punctuation, navigation, boilerplate, symbols and capitals;
lines that fail or repeat an earlier one are taken out, and a document that loses more than
``MAX_LOST`` percent of its characters is rejected. No shuffle, no Python.

Null text: no words, figures of zero, ``base_failed``. Ids may be null or repeat; each row is judged
on its own. Empty table: no rows. Further columns are ignored by ``quality_figures`` and kept by
``clean_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deskloom.llm.common import pick

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20
#: Percent of a document's characters that its failing lines may hold.
MAX_LOST = 50
SPACE = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Rules for lines, as Java regular expressions. A line passes a rule when it does not match.
#: A line of prose ends its last sentence; quotes and brackets may follow.
CLOSED = r"[.!?…。！？:;]['\"”’»)\]]*[\x20\x09-\x0D]*$"
#: Lines up to so many words are not asked for closing punctuation.
HEADING_WORDS = 8
LONG_LINE = rf"([^\x20\x09-\x0D]+{SPACE}){{{HEADING_WORDS}}}[^\x20\x09-\x0D]"
NAVIGATION = (
    r"(?i)^[\x20\x09-\x0D]*(home|menu|log ?in|log ?out|sign ?in|sign ?up|next|previous|back to top|skip to (main )?content"
    r"|read more|share this|print this page|search)[\x20\x09-\x0D]*[>»|]?[\x20\x09-\x0D]*$"
)
#: A bread crumb or menu: so many of these marks, with not more than so many characters to each.
SEPARATORS, MIN_SEPARATORS, PER_SEPARATOR = "|>»", 4, 40
#: A line is boilerplate with one phrase or more for each so many characters, at any length.
PER_PHRASE = 300
BOILERPLATE = (
    r"(?i)(enable javascript|javascript is (disabled|required)|uses? cookies|cookie (policy|settings)|all rights reserved"
    r"|terms of (use|service)|privacy policy|lorem ipsum|subscribe to our newsletter|click here to)"
)
#: Percent of a line that may be symbols, and percent of its ASCII letters that may be capitals.
MAX_SYMBOLS, MAX_CAPITALS = 10, 70


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _letters(line: Column, low: str, high: str) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, f"[{low}-{high}]", ""))


def line_passes(line: Column) -> Column:
    """Whether a line that has a word stays."""
    length = F.length(line)
    capitals, small = _letters(line, "A", "Z"), _letters(line, "a", "z")
    marks = length - F.length(_without(line, SEPARATORS))
    closed = line.rlike(CLOSED) | ~line.rlike(LONG_LINE)
    return (
        closed
        & ~line.rlike(NAVIGATION)
        & ((marks < MIN_SEPARATORS) | (marks * PER_SEPARATOR < length))
        & (~line.rlike(BOILERPLATE) | (F.regexp_count(line, F.lit(BOILERPLATE)) * PER_PHRASE < length))
        & (F.lit(100) * (length - F.length(_without(line, SYMBOLS))) <= F.lit(MAX_SYMBOLS) * length)
        & ((capitals < 20) | (F.lit(100) * capitals <= F.lit(MAX_CAPITALS) * (capitals + small)))
    )


def lines_of(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def _windows(hashes: Column) -> Column:
    """Hash of each run of WINDOW words; lambdas refer to their own argument only."""
    n = F.size(hashes) - (WINDOW - 1)
    shifted = [F.slice(hashes, k + 1, F.greatest(n, F.lit(0))).alias(f"w{k}") for k in range(WINDOW)]
    zipped = F.arrays_zip(*shifted)
    return F.transform(zipped, lambda s: F.xxhash64(*[s[f"w{k}"] for k in range(WINDOW)]))


def quality_figures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    n_lines, n_lines_removed, chars_removed of the cleaning."""
    own = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    hashed = own.select(
        "doc_id", "text", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"),
        lines_of(F.col("text")).alias("lines"),
    )
    windowed = hashed.select(
        "doc_id", "text", "lines", F.size("hashes").alias("n_words"), _windows(F.col("hashes")).alias("windows"),
        F.array_distinct("lines").alias("once"),
    )
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    empty = F.expr("array()").cast("array<struct<h:bigint,p:int>>")
    sorted_ = windowed.withColumn(
        "placed",
        F.when(
            repeats,
            F.sort_array(
                F.arrays_zip(F.col("windows").alias("h"), F.sequence(F.lit(0), F.size("windows") - 1).alias("p"))
            ),
        ).otherwise(empty),
    ).withColumn("passing", F.filter("once", line_passes))
    n = F.size("placed")
    none = F.array(F.lit(None).cast("struct<h:bigint,p:int>"))
    neighbours = F.arrays_zip(
        F.col("placed").alias("c"), F.concat(none, F.slice("placed", 1, F.greatest(n - 1, F.lit(0)))).alias("b"),
        F.concat(F.slice("placed", 2, n), none).alias("a"),
    )
    twice = F.filter(
        neighbours,
        lambda s: s["c"].isNotNull() & (s["c"]["h"].eqNullSafe(s["b"]["h"]) | s["c"]["h"].eqNullSafe(s["a"]["h"])),
    )
    found = sorted_.withColumn(
        "places", F.sort_array(F.transform(twice, lambda s: s["c"]["p"]))
    )
    steps = F.arrays_zip(F.col("places").alias("p"), F.slice("places", 2, F.size("placed") + 1).alias("q"))
    covered = F.aggregate(
        steps, F.lit(0).cast("long"),
        lambda total, s: total + F.least(F.lit(WINDOW), F.coalesce(s["q"] - s["p"], F.lit(WINDOW))),
    )
    figures = found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.length(_without(F.col("text"), WHITE)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size("once")).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), F.size("passing").cast("long").alias("n_passing"),
        _total(F.transform("lines", lambda x: F.length(x))).alias("chars"),
        _total(F.transform("passing", lambda x: F.length(x))).alias("chars_passing"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    lost = F.col("chars") - F.col("chars_passing")
    return figures.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (100 * lost <= MAX_LOST * F.col("chars"))).alias("kept"),
        "n_lines", (F.col("n_lines") - F.col("n_passing")).alias("n_lines_removed"), lost.alias("chars_removed"),
    )


def clean_lines(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The same rows and columns; texts keep the lines that pass, the first of equal ones."""
    kept = F.array_join(F.filter(F.array_distinct(lines_of(F.col(f"`{text}`"))), line_passes), "\n")
    return docs.select(*[kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


# --- the same in SQL ----------------------------------------------------------------

_W = r"[\x20\x09-\x0D]"


def _sql_letters(low: str, high: str) -> str:
    return f"(length(l) - length(regexp_replace(l, '[{low}-{high}]', '', 'g')))"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS ws FROM d),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
win AS (
  SELECT * FROM (
    SELECT doc_id, p, {" || chr(10) || ".join(f"lead(word, {k}) OVER o" if k else "word" for k in range(WINDOW))} AS g
    FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY p)
  ) WHERE g IS NOT NULL
),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
cover AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(q - p, {WINDOW})))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM twice WHERE c > 1) GROUP BY doc_id
),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
),
once AS (
  SELECT doc_id, unnest(list_distinct(ls)) AS l FROM lines
),
passing AS (
  SELECT doc_id, count(*) AS n, sum(length(l)) AS c FROM once
  WHERE (regexp_matches(l, {_quoted(CLOSED)})
         OR NOT regexp_matches(l, '{LONG_LINE}'))
    AND NOT regexp_matches(l, {_quoted(NAVIGATION)})
    AND (length(l) - length(translate(l, '{SEPARATORS}', '')) < {MIN_SEPARATORS}
         OR {PER_SEPARATOR} * (length(l) - length(translate(l, '{SEPARATORS}', ''))) < length(l))
    AND (NOT regexp_matches(l, {_quoted(BOILERPLATE)}) OR len(regexp_extract_all(l, {_quoted(BOILERPLATE)})) * {PER_PHRASE} < length(l))
    AND 100 * (length(l) - length(translate(l, '{SYMBOLS}', ''))) <= {MAX_SYMBOLS} * length(l)
    AND ({_sql_letters("A", "Z")} < 20
         OR 100 * {_sql_letters("A", "Z")} <= {MAX_CAPITALS} * ({_sql_letters("A", "Z")} + {_sql_letters("a", "z")}))
  GROUP BY doc_id
),
f AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_passing,
    coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0)::BIGINT AS chars, coalesce(c, 0)::BIGINT AS chars_passing
  FROM d JOIN w USING (doc_id) JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN passing USING (doc_id)
),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * (chars - chars_passing) <= {MAX_LOST} * chars AS kept,
  n_lines, n_lines - n_passing AS n_lines_removed, chars - chars_passing AS chars_removed
FROM v"""
