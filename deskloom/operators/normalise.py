"""Loosely structured ticket records to one schema. Nothing here raises on bad input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deskloom import lexicon as lx
from deskloom.functions import labels as lb
from deskloom.functions.text import clean_text, nfkc, sql_list, strip, text_for_model

RECORD = "map<string,string>"
KNOWN_KEYS = tuple(
    sorted({lb._canon(a) for aliases in lx.TICKET_ALIASES.values() for a in aliases})
)
PLAIN_FIELDS = (
    "customer_id", "customer_tier", "region", "language_fluency", "language", "created_at",
)


def parse_record(text: Column) -> Column:
    """The record as a key-ordered map, null when it is not a JSON object."""
    looks_like_object = F.coalesce(F.trim(text).startswith("{"), F.lit(False))
    return F.when(looks_like_object, F.from_json(text, RECORD))


def to_list(value: Column) -> Column:
    """JSON list without null and empty elements; a scalar becomes a singleton."""
    items = F.when(value.startswith("["), F.from_json(value, "array<string>"))
    return (
        F.when(items.isNotNull(), F.filter(items, lambda i: i.isNotNull() & (i != "")))
        .when(strip(value) != "", F.array(value))
        .otherwise(F.array().cast("array<string>"))
    )


def to_map(value: Column) -> Column:
    """JSON object as a map; any other value under the key ``value``; missing is empty."""
    parsed = F.when(F.trim(value).startswith("{"), F.from_json(value, RECORD))
    return (
        F.when(parsed.isNotNull(), parsed)
        .when(value.isNotNull(), F.create_map(F.lit("value"), value))
        .otherwise(F.create_map().cast(RECORD))
    )


def _flat_text(value: Column) -> Column:
    """A list of lines is joined; anything else is taken as it is."""
    lines = F.when(value.startswith("["), F.from_json(value, "array<string>"))
    return F.coalesce(F.array_join(lines, "\n", "None"), value)



def _scalar_text(text: Column) -> Column:
    """Text of a record that is not an object: JSON strings lose their quotes."""
    as_string = F.when(F.trim(text).startswith('"'), F.get(
        F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0)))
    return F.coalesce(as_string, _flat_text(text))


def normalise_tickets(records: DataFrame) -> DataFrame:
    """(position, record_text) to the ticket schema.

    ``record_text`` is one record as JSON text, or plain text for anything that is not a
    JSON object.
    """
    rows = records.withColumn("record", parse_record(F.col("record_text")))
    is_object = F.col("record").isNotNull()
    fields = {name: lb.pick(F.col("record"), aliases) for name, aliases in lx.TICKET_ALIASES.items()}
    rows = rows.withColumns({f"_{name}": value for name, value in fields.items()})
    rows = rows.withColumns(
        {
            "_subject": nfkc(_flat_text(F.col("_subject"))),
            "_body": nfkc(
                F.when(is_object, _flat_text(F.col("_body"))).otherwise(
                    _scalar_text(F.col("record_text"))
                )
            ),
        }
    ).withColumns(
        {
            "subject": clean_text(F.col("_subject"), normalise=False),
            "body": clean_text(F.col("_body"), normalise=False),
            "_channel_of": lb.channel(F.col("_channel")),
        }
    )
    subject, body = F.col("subject"), F.col("body")
    position = F.col("position").cast("string")
    no_id = F.col("_ticket_id").isNull()
    warnings = F.when(
        is_object,
        F.array_compact(F.array(
            F.when(no_id, F.lit(lx.WARN_NO_ID)),
            F.col("_channel_of.warning"),
            F.when((subject == "") & (body == ""), F.lit(lx.WARN_EMPTY)).when(
                body == "", F.lit(lx.WARN_NO_BODY)
            ),
        )),
    ).otherwise(F.array(F.lit(lx.WARN_NOT_OBJECT)))
    known = sql_list(KNOWN_KEYS)
    extra = F.expr(
        f"map_filter(record, (k, v) -> regexp_replace(lower(k), '[^a-z0-9]', '') NOT IN ({known}))"
    )
    empty_map = F.create_map().cast(RECORD)
    return rows.select(
        "position",
        F.when(~is_object, F.concat(F.lit("malformed-"), position))
        .when(no_id, F.concat(F.lit("unlabelled-"), position))
        .otherwise(F.col("_ticket_id")).alias("ticket_id"),
        F.when(is_object, F.col("_channel_of.channel")).otherwise(F.lit("unknown")).alias("channel"),
        subject, body,
        F.array_join(F.filter(F.array(subject, body), lambda p: p != ""), "\n\n").alias("raw_text"),
        *[F.col(f"_{name}").alias(name) for name in PLAIN_FIELDS],
        to_list(F.col("_attachments")).alias("attachments"),
        to_map(F.col("_labels")).alias("labels"),
        to_map(F.col("_history")).alias("history"),
        F.coalesce(extra, empty_map).alias("extra"),
        warnings.alias("ingest_warnings"),
        text_for_model(subject, body).alias("model_text"),
        F.col("record_text").alias("source_json"),
    )
