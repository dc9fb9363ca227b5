"""Folders of files: the same as one file, with keys of their own."""

import json

from pyspark.sql import functions as F

from conftest import one
from deskloom.operators import decision_log as dl
from deskloom.operators import guardrails as gr
from deskloom.operators import quantiles
from deskloom.operators import search as se
from deskloom.sources.corpus import load_articles, load_corpus
from deskloom.sources.tickets import load_tickets

ARTICLES = [
    {"title": f"Article {i}", "content": f"How to rotate {word} keys in the console, step by step, for every region."}
    for i, word in enumerate(("signing", "deploy", "access", "webhook"))
]


def test_corpus_folder_equals_one_file(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(ARTICLES))
    (tmp_path / "many").mkdir()
    for i in (0, 2):
        (tmp_path / "many" / f"part-{i}.json").write_text(json.dumps(ARTICLES[i : i + 2]))
    asked = spark.createDataFrame([("q", "rotate webhook keys"), ("r", "signing")], "query_id string, text string")

    def ranked(path):
        chunks = load_corpus(spark, str(path))
        found = se.with_passages(se.search_lexical(asked, chunks, floor=0.0), chunks)
        return [tuple(r) for r in found.orderBy("query_id", "rank").select("query_id", "text", "score").collect()]

    assert ranked(tmp_path / "many") == ranked(tmp_path / "one.json")
    keys = load_articles(spark, str(tmp_path / "many")).select("doc_ord", "doc_id").collect()
    assert len({k.doc_ord for k in keys}) == len({k.doc_id for k in keys}) == 4


def test_ticket_folder_has_unique_ids(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"t{i}.json").write_text(json.dumps([{"body": "the same text"}, {"body": "the same text"}]))
    tickets = load_tickets(spark, str(tmp_path)).select("ticket_id").collect()
    assert len(tickets) == len({t.ticket_id for t in tickets}) == 6


def test_octets_in_any_script(spark):
    assert one(spark, gr.octets_valid(F.col("v")), v="١٢.٢.٣.٤") is True
    assert one(spark, gr.octets_valid(F.col("v")), v="١٢.٢.٣.٩٩٩") is False
    assert one(spark, gr.octets_valid(F.col("v")), v="1.2.3.99999999999") is False


def test_quantiles_equal_sorting(spark):
    values = [float((i * 37) % 101) / 3 for i in range(333)] + [0.5] * 200 + [None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    ordered = sorted(v for v in values if v is not None)
    fractions = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 0.99}
    got = quantiles.nearest_rank(rows, "v", fractions).first()
    assert list(got) == [ordered[min(int(len(ordered) * p), len(ordered) - 1)] for p in fractions.values()]
    between = quantiles.interpolated(rows, "v", fractions).first()
    for name, p in fractions.items():
        at = (len(ordered) - 1) * p
        low, high = ordered[int(at)], ordered[min(int(at) + 1, len(ordered) - 1)]
        assert abs(between[name] - (low + (high - low) * (at - int(at)))) < 1e-9
    assert quantiles.nearest_rank(rows.limit(0), "v", {"p": 0.5}).first().p is None


def test_all_decisions_of_a_ticket_are_found(spark):
    log = spark.range(6000).select(
        "id", F.when(F.col("id") % 3000 == 1, F.lit("x")).otherwise(F.lit("y")).alias("ticket_id"), F.lit("r").alias("run_id")
    )
    assert {r.id for r in dl.decisions_for(log, "x").collect()} == {1, 3001}
    assert dl.rows_of_run(log).count() == dl.rows_of_run(log, "r").count() == 6000
    assert [r.id for r in dl.rows_of_run(log, limit=2).collect()] == [5999, 5998]
