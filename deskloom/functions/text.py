"""Text column expressions: cleaning, tokens, sentences."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from deskloom import lexicon as lx

# Whitespace as Unicode defines it plus the four ASCII separators.
SPACE = r"[\s\x1c-\x1f]"
# The same characters, for TRIM.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
# Its characters but the line feed.
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A column used inside a lambda is otherwise inlined and recomputed per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind(body: str, **args: Column) -> Column:
    """SQL ``body`` over ``x.<name>`` for each argument, evaluated once per row.

    Long expressions are one parsed string instead of a call into the JVM per literal.
    """
    row = F.array(F.struct(*[c.alias(n) for n, c in args.items()]))
    return F.get(F.call_function("transform", row, F.expr(f"x -> {body}")), F.lit(0))


def sql_array(values) -> str:
    return f"array({sql_list(values)})"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normalisation: Spark has no built-in for it."""
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def clean_text(text: Column, normalise: bool = True) -> Column:
    """Normalise, drop control characters, collapse runaway whitespace, strip. Null becomes ''."""
    value = F.coalesce(text, F.lit(""))
    if normalise:
        value = nfkc(value)
    value = F.regexp_replace(value, r"[\p{C}&&[^\n\t]]", "")
    value = F.regexp_replace(value, r"[ \t]{3,}", "  ")
    value = F.regexp_replace(value, r"\n{4,}", "\n\n\n")
    return strip(value)


def tokenise(text: Column) -> Column:
    """Lower-cased tokens in order, stopwords dropped. Dots and slashes are token characters."""
    found = F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(lx.TOKEN_PATTERN), F.lit(0)
    )
    return F.call_function("filter", found, F.expr(f"t -> t NOT IN ({sql_list(lx.STOPWORDS)})"))


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokenise(text))


def sentences(text: Column) -> Column:
    """Sentences (and lines) longer than 15 characters, stripped."""
    parts = F.split(
        F.coalesce(text, F.lit("")), rf"(?U)(?<=[.!?]){SPACE}+|\n+", -1
    )
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 15)


PLEASANTRY_PATTERN = "(?iu)^(" + "|".join(lx.PLEASANTRIES) + ")"


def is_substantive(sentence: Column) -> Column:
    bare = strip(F.regexp_replace(sentence, r"(?U)\[S\d+\]", ""))
    return (F.length(bare) >= 25) & ~bare.rlike(PLEASANTRY_PATTERN)


def substantive_sentences(text: Column) -> Column:
    return F.filter(sentences(text), is_substantive)


def text_for_model(subject: Column, body: Column) -> Column:
    """Subject and body joined by a blank line, either alone, or the empty marker."""
    s, b = strip(F.coalesce(subject, F.lit(""))), strip(F.coalesce(body, F.lit("")))
    return (
        F.when((s != "") & (b != ""), F.concat(s, F.lit("\n\n"), b))
        .when(s != "", s)
        .when(b != "", b)
        .otherwise(F.lit(lx.EMPTY_TICKET))
    )


def wrap_customer_text(text: Column) -> Column:
    """Put customer text between delimiters it cannot close itself."""
    safe = F.coalesce(text, F.lit(""))
    for marker in (lx.TICKET_OPEN, lx.TICKET_CLOSE):
        safe = F.replace(safe, F.lit(marker), F.lit(""))
    return F.concat(F.lit(lx.TICKET_OPEN + "\n"), safe, F.lit("\n" + lx.TICKET_CLOSE))
