"""Documentation sources: JSON files of articles, or any table with the article columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deskloom import lexicon as lx
from deskloom.functions.labels import pick
from deskloom.operators.chunking import chunk_documents
from deskloom.settings import SearchSettings
from deskloom.sources.json_split import split_json
from deskloom.sources.tickets import as_entry, is_object, placed, tagged

EMPTY = ("", "[]")


def _keyed(entry: Column) -> Column:
    """The key replaces an id of the article's own; a plain value is an article with only content."""
    return F.when(is_object(entry["value"]), tagged(entry, "doc_id")).otherwise(
        F.to_json(F.struct(entry["key"].alias("doc_id"), entry["value"].alias("content")))
    )


def _sections(value: Column) -> Column:
    """Sections list: objects by heading/title and content/text/body, or plain strings."""
    def first(fields: Column, *names: str) -> Column:
        return F.coalesce(
            *[F.nullif(F.try_element_at(fields, F.lit(n)), F.lit("")) for n in names], F.lit("")
        )

    def section(item: Column) -> Column:
        fields = F.from_json(item, "map<string,string>")
        is_object = F.trim(item).startswith("{")
        return F.struct(
            F.when(is_object, first(fields, "heading", "title")).otherwise(F.lit("")).alias("heading"),
            F.when(is_object, first(fields, "content", "text", "body")).otherwise(item).alias("body"),
        )

    return F.transform(F.from_json(value, "array<string>"), section)


def articles_from_records(records: DataFrame) -> DataFrame:
    """(position, record_text) to the columns ``chunk_documents`` reads."""
    record = F.from_json(F.col("record_text"), "map<string,string>")
    rows = records.filter(F.trim("record_text").startswith("{")).withColumn("r", record)
    fields = {
        name: pick(F.col("r"), aliases, empty=EMPTY) for name, aliases in lx.DOCUMENT_ALIASES.items()
    }
    rows = rows.withColumns({f"_{k}": v for k, v in fields.items()})
    doc_id = F.coalesce(F.col("_doc_id"), F.concat(F.lit("doc-"), F.col("position").cast("string")))
    content_list = F.when(F.col("_content").startswith("["), F.from_json("_content", "array<string>"))
    sections = F.when(F.col("_sections").startswith("["), _sections(F.col("_sections"))).otherwise(
        F.transform(content_list, lambda c: F.struct(F.lit("").alias("heading"), c.alias("body")))
    )
    return rows.select(
        F.col("position").cast("long").alias("doc_ord"),
        doc_id.alias("doc_id"),
        F.coalesce(F.col("_title"), doc_id).alias("title"),
        F.col("_url").alias("url"),
        F.col("_content").alias("content"),
        sections.alias("sections"),
    )


def load_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a JSON documentation file, or of a folder of such files, of any size."""
    split = split_json(spark, path, lx.CORPUS_WRAPPERS, lambda text: F.array(text))
    keyed = split.entries.filter("text <> ''").select("path", "at", _keyed(as_entry(F.col("text"))).alias("text"))
    return articles_from_records(placed(split.elements.unionByName(keyed), split.files))


def load_corpus(spark: SparkSession, path: str, settings: SearchSettings | None = None) -> DataFrame:
    return chunk_documents(load_articles(spark, path), settings)
