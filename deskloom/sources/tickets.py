"""Ticket sources: JSON, wrapped JSON, id-keyed JSON and JSON Lines files; batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deskloom import lexicon as lx
from deskloom.functions.text import LINE_BREAK, strip
from deskloom.operators.normalise import normalise_tickets
from deskloom.sources.json_split import split_json, whole_objects

RECORDS = "array<string>"


def tagged(entry: Column, id_field: str) -> Column:
    """An object's text with its key appended as an id, after the record's own fields."""
    value = F.trim(entry["value"])
    inner = F.trim(F.substring(value, F.lit(2), F.length(value) - 2))
    own_id = F.to_json(F.struct(entry["key"].alias(id_field)))
    return F.when(inner == "", own_id).otherwise(
        F.concat(F.lit("{"), inner, F.lit(","), F.substring(own_id, F.lit(2), F.length(own_id)))
    )


def is_object(text: Column) -> Column:
    return F.coalesce(F.trim(text).startswith("{"), F.lit(False))


def keyed_record(entry: Column, id_field: str) -> Column:
    """The record under a key of the outermost object, given the key as id if it has none."""
    fields = F.from_json(entry["value"], "map<string,string>")
    return F.when(F.map_contains_key(fields, id_field), entry["value"]).otherwise(tagged(entry, id_field))


def line_records(text: Column) -> Column:
    """Non-blank lines; a line that is not JSON becomes a record with only a body."""
    lines = F.filter(F.transform(F.split(text, LINE_BREAK, -1), lambda s: strip(s)), lambda s: s != "")
    return F.transform(
        lines,
        lambda line: F.when(is_json(line), line).otherwise(
            F.to_json(F.struct(line.alias("body")))
        ),
    )


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value.

    A parser stops after the first value and does not see what follows. Within a list the text must
    be exactly one element, within an object exactly one value; a closing bracket too many ends the
    one and breaks the other.
    """
    in_list = F.from_json(F.concat(F.lit("["), text, F.lit("]")), RECORDS)
    in_object = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "map<string,string>")
    return F.coalesce((F.size(in_list) == 1) & (F.size(in_object) == 1), F.lit(False))


#: Positions within one file stay below this; those of the next file start here.
FILE_STEP = 1 << 32


def as_entry(text: Column) -> Column:
    """``"key": value`` as a struct of key and value."""
    return F.get(F.map_entries(F.from_json(F.concat(F.lit("{"), text, F.lit("}")), "map<string,string>")), F.lit(0))


def placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(path, position, record_text): positions are unique over all files; in the first they count from 0."""
    position = (F.col("file_no") * FILE_STEP + F.col("at")).alias("position")
    return rows.join(files, "path").select("path", position, F.col("text").alias("record_text"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, record_text) of a JSON file or a folder of such files, of any size.

    A list's elements, those under a wrapper key, the values of an object of objects, else the object
    itself; what is neither a list nor an object is taken by lines.
    """
    split = split_json(spark, path, lx.TICKET_WRAPPERS, line_records)
    entries = split.entries.withColumn("entry", as_entry(F.col("text")))
    keyed = entries.groupBy("path").agg(F.bool_and(F.coalesce(is_object(F.col("entry.value")), F.lit(False))).alias("keyed"))
    entries = entries.join(keyed, "path")
    own = entries.filter("keyed").select("path", "at", keyed_record(F.col("entry"), "ticket_id").alias("text"))
    whole = whole_objects(entries.filter("not keyed")).select("path", F.lit(0).cast("long").alias("at"), "text")
    rows = split.elements.unionByName(split.lines).unionByName(own).unionByName(whole)
    return placed(rows, split.files)


def load_ticket_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines of any size: the text scan splits files, so no record passes one task whole.

    Positional ids follow file splits, as there is no global line number.
    """
    lines = spark.read.text(path).select(F.explode(line_records(F.col("value"))).alias("record_text"))
    return normalise_tickets(lines.withColumn("position", F.monotonically_increasing_id()))


def load_tickets(spark: SparkSession, path: str) -> DataFrame:
    return normalise_tickets(read_records(spark, path))


def stream_tickets(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """JSON Lines tickets arriving as files, normalised by the same operator.

    Positions are only used for ids of unlabelled tickets. A stream has no row numbers; a hash of the
    file, the block it was read from and the record tells equal texts of different files apart.
    """
    lines = (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(folder)
        .select("value", "_metadata.file_path", "_metadata.file_block_start")
    )
    records = lines.select(
        "file_path", "file_block_start", F.posexplode(line_records(F.col("value"))).alias("at", "record_text")
    )
    key = F.xxhash64("file_path", "file_block_start", "at", "record_text")
    return normalise_tickets(records.select(key.alias("position"), "record_text"))
