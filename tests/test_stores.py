"""Vector grounding, the reply store, the chunk table in buckets and reconciliation on streams."""

import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from deskloom.operators import search as se
from deskloom.operators import vector_grounding as vg
from deskloom.sinks import reply_store as rs
from deskloom.streaming import decisions as st

PASSAGES = "array<struct<chunk_id:string,text:string,title:string>>"
LONG = "This sentence number {} is long enough to make a claim of its own."


def _drafts(spark, rows):
    rows = [(i, t, None if ids is None else [(c, "text", "title") for c in ids]) for i, t, ids in rows]
    return spark.createDataFrame(rows, f"position long, draft_text string, retrieved {PASSAGES}")


def _cosine(a, b):
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0


def test_vector_grounding_equals_plain_products(spark):
    """Long, repeated and missing drafts; vectors that are missing, zero, of another size or given twice."""
    sentences = [LONG.format(i) for i in range(1300)]
    vec = {s: [math.cos(i), math.sin(i), math.cos(3 * i)] for i, s in enumerate(sentences)}
    vec[sentences[3]] = [0.0, 0.0, 0.0]
    vec[sentences[4]] = [1.0, 0.0]
    vec[sentences[5]] = None
    chunk = {"a": [1.0, 0.0, 0.0], "b": [0.0, 2.0, 0.0], "short": [1.0], "hole": [1.0, None, 0.0]}
    drafts = [
        (1, " ".join(sentences[6:]), ["a", "b"]), (2, " ".join(sentences[:4]), ["a"]), (3, " ".join(sentences[:4]), ["a"]),
        (4, sentences[4], ["a"]), (5, sentences[5], ["a"]), (6, sentences[0], ["a", "short"]), (7, sentences[0], ["missing"]),
        (8, sentences[0], []), (9, sentences[0], None), (10, None, ["a"]), (11, "", ["a"]), (12, "Thanks!", ["a"]),
        (13, sentences[0], ["hole"]), (14, sentences[0], ["a", "a"]), (14, sentences[0], ["a", "a"]),
    ]
    stored = spark.createDataFrame([(s, v) for s, v in vec.items()], "text string, vec array<double>")
    vectors = spark.createDataFrame([*chunk.items(), ("a", chunk["a"])], "chunk_id string, vec array<double>")
    got = vg.with_vector_grounding(_drafts(spark, drafts), lambda s: s.join(stored, "text"), vectors).collect()
    assert sorted(r.position for r in got) == sorted(d[0] for d in drafts)
    by_words = {4, 5, 6, 7, 8, 9, 10, 11, 12, 13}
    assert {r.position for r in got if r.vector_grounding is None} == by_words
    texts = {d[0]: d for d in drafts}
    for row in got:
        if row.position in by_words:
            continue
        _, text, ids = texts[row.position]
        own = [s for s in sentences if s in text]
        weak = [s for s in own if max(_cosine(vec[s], chunk[c]) for c in ids) < 0.38]
        assert row.vector_grounding.unsupported == weak
        assert row.vector_grounding.ratio == pytest.approx(round(1 - len(weak) / len(own), 4), abs=1e-4)
        assert row.vector_grounding.method == "embedding"


def test_vector_grounding_of_nothing(spark):
    empty = _drafts(spark, [])
    vectors = spark.createDataFrame([], "chunk_id string, vec array<double>")
    assert vg.with_vector_grounding(empty, lambda s: s.withColumn("vec", F.array(F.lit(1.0))), vectors).count() == 0


def test_reply_store_is_idempotent_and_survives_compaction(spark, tmp_path):
    path = str(tmp_path / "store")
    keys = [f"{i:02x}{i}" for i in range(40)] + ["1e5", "00", "007"]
    replies = spark.createDataFrame([(k, f"reply {k}") for k in keys] + [(None, "x"), ("zz", None)], "key string, content string")
    assert rs.read_replies(spark, path).count() == 0
    rs.append_replies(replies, path)
    rs.append_replies(replies.filter("content IS NOT NULL").withColumn("content", F.lit("changed")), path)
    want = {k: f"reply {k}" for k in keys}
    read = lambda: {r.key: r.content for r in rs.read_replies(spark, path).collect()}
    assert read() == want
    # A racing writer's repeat of a key is not seen, and gone after compaction.
    late = spark.createDataFrame([("00", "later", datetime(2200, 1, 1), "00")], rs.SCHEMA)
    late.write.mode("append").partitionBy("shard").parquet(rs._generation(spark, path))
    assert read() == want
    old = rs._generation(spark, path)
    generation = rs.compact(spark, path)
    assert rs._generation(spark, path).endswith(generation) and rs._generation(spark, path) != old
    assert read() == want
    assert rs._rows(spark, rs._generation(spark, path)).count() == len(keys)
    rs.append_replies(spark.createDataFrame([("00", "changed"), ("new", "b"), ("new", "a")], "key string, content string"), path)
    assert read() == want | {"new": "a"}
    asked = spark.createDataFrame([("00",), ("00",), ("none",), (None,)], "key string")
    found = sorted((r.key or "", r.content or "") for r in rs.with_stored_replies(asked, path).collect())
    assert found == [("", ""), ("00", "reply 00"), ("00", "reply 00"), ("none", "")]


def test_citations_resolve_without_a_shuffle_of_the_corpus(spark, tmp_path):
    chunks = spark.range(500).select(
        F.concat(F.lit("d#"), "id").alias("chunk_id"), F.col("id").alias("doc_ord"), F.repeat(F.lit("x"), 50).alias("text")
    )
    table = se.write_chunk_table(chunks, str(tmp_path / "chunks"), "chunks_of_test", buckets=8)
    cited = spark.createDataFrame([(1, "d#3"), (2, "d#3"), (3, "gone"), (4, None)], "position long, chunk_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = se.resolve_citations(cited, table)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.position for r in found.collect()) == [1, 2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE chunks_of_test")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_tickets_without_a_decision_on_streams(spark, tmp_path):
    start = datetime(2024, 5, 1, 12)
    at = lambda minutes: (start + timedelta(minutes=minutes)).isoformat() if minutes is not None else None
    tickets = [
        [("in-time", 0), ("never", 0), ("too-late", 0), ("twice", 1), ("never", 0), (None, 2), ("no-time", None)],
        [("later", 300)], [("last", 900)],
    ]
    decisions = [
        [("in-time", 5), ("twice", 3), ("twice", 4), ("stranger", 1), (None, 2)], [("too-late", 45), ("later", 310)], [("other", 900)],
    ]
    for name, column, batches in (("t", "received_at", tickets), ("d", "processed_at", decisions)):
        (tmp_path / name).mkdir()
        for i, rows in enumerate(batches):
            lines = [json.dumps({"ticket_id": k, column: at(m)}) for k, m in rows]
            (tmp_path / name / f"{i}.json").write_text("\n".join(lines))
    read = lambda name, column: spark.readStream.schema(f"ticket_id string, {column} timestamp").option(
        "maxFilesPerTrigger", 1).json(str(tmp_path / name))
    missing = st.undecided_tickets(read("t", "received_at"), read("d", "processed_at"))
    q = missing.writeStream.format("memory").queryName("undecided").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(str(r.ticket_id) for r in spark.table("undecided").collect())
    assert got == ["None", "never", "never", "no-time", "too-late"]
