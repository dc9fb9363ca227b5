"""Whole runs: batch with resume, streaming triage, stateful breaker, sinks."""

import json

import pytest
from pyspark.sql import functions as F

from deskloom import prompts
from deskloom.plans import harness
from deskloom.settings import ProviderSettings, env_value
from deskloom.sinks import artefacts as sk
from deskloom.sources.corpus import load_articles
from deskloom.sources.tickets import stream_tickets
from deskloom.streaming import decisions as st

ARTICLES = [
    {"doc_id": "kb-keys", "title": "API keys", "content": "## Rotation\n\nRotate an api key in the console under access settings. The old key stops working after one hour."},
    {"doc_id": "kb-rate", "title": "Rate limits", "content": "## Limits\n\nToo many requests return status 429. Wait for the retry-after header before sending another request."},
]
TICKETS = [
    {"id": f"T-{i}", "channel": ch, "subject": s, "body": body, "tier": tier, "labels": {"intent": intent, "expected_route": route}}
    for i, (ch, s, body, tier, intent, route) in enumerate([
        ("email", "Rotate api key", "How do I rotate an api key in the console?", "growth", "api_key_issue", "auto"),
        ("live_chat", "", "We get 429 too many requests, what about retry-after?", "starter", "rate limit", "auto"),
        ("forum", "Breach", "We saw a breach and leaked data", "growth", "security_incident", "escalate"),
        ("pigeon", "", "", "starter", "unclear_request", "escalate"),
        ("docs", "Off topic", "Singing whales migrate yearly", None, "feature_request", "escalate"),
        ("email", "Rotate api key", "How do I rotate an api key in the console?", "growth", "api_key_issue", "auto"),
    ])
]


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "docs.json").write_text(json.dumps(ARTICLES))
    (tmp_path / "tickets.json").write_text(json.dumps(TICKETS))
    return tmp_path


def test_batch_run_resumes_and_reconciles(spark, files):
    args = (spark, str(files / "tickets.json"), str(files / "docs.json"), str(files / "out"))
    first = harness.run(*args, limit=2, run_id="one")
    assert first["volume"]["tickets_processed"] == 2
    report = harness.run(*args, resume=True, run_id="two")
    v = report["volume"]
    assert v["tickets_processed"] == len(TICKETS) == len({t["id"] for t in TICKETS})
    assert v["answered_automatically"] + v["escalated"] + v["blocked_by_guardrails"] == len(TICKETS)
    assert v["answered_automatically"] == 0  # nothing is sent without a model
    assert report["reconciliation"]["reconciles"] is True
    rules = {r.ticket_id: r.rule_fired for r in spark.read.parquet(str(files / "out" / "decisions")).collect()}
    assert rules["T-2"] == "R1_never_automate_intent" and rules["T-3"] == "R3_empty_ticket"
    outcomes = {r.ticket_id: r for r in spark.read.parquet(str(files / "out" / "outcomes")).collect()}
    assert outcomes["T-0"].retrieved[0].doc_id == "kb-keys" and outcomes["T-5"].retrieved == outcomes["T-0"].retrieved
    assert outcomes["T-4"].retrieved == [] and outcomes["T-3"].escalation_package.note.startswith("WHAT THEY WANT: the message holds no text")
    text = (files / "out" / "metrics.md").read_text()
    assert "## Fairness" in text and "Decision log reconciles: True" in text
    assert json.loads((files / "out" / "metrics.json").read_text())["run"]["completed_fully"] is True
    headers = {r.run_id: r.ticket_count for r in sk.read_run_headers(spark, str(files / "out" / "runs")).collect()}
    assert headers == {"one": 2, "two": 6}


def test_missing_input_is_reported():
    assert harness.main(["--input", "/nonexistent.json", "--docs", "x", "--output", "y"]) == 2


def test_streaming_triage_logs_each_ticket_once(spark, files):
    (files / "in").mkdir()
    (files / "in" / "a.jsonl").write_text("\n".join(json.dumps(t) for t in TICKETS[:3]))
    q = st.triage_stream(
        stream_tickets(spark, str(files / "in")), load_articles(spark, str(files / "docs.json")),
        str(files / "log"), str(files / "ckpt"), run_id="s1",
    )
    assert q.awaitTermination(180)
    log = spark.read.parquet(str(files / "log"))
    assert sorted(r.ticket_id for r in log.collect()) == ["T-0", "T-1", "T-2"]


def test_windowed_counts_and_first_decisions(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "answer", 0), ("a", "answer", 30), ("b", "escalate", 400), ("c", "answer", 5000)],
        "ticket_id string, action string, s int",
    ).select("ticket_id", "action", F.timestamp_seconds(F.col("s") + 1_700_000_100).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "d"))
    for name, frame, mode in (("win", st.windowed_counts(stream), "complete"), ("first", st.first_decisions(stream), "append")):
        q = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("win").collect()) == [1, 1, 2]
    assert sorted(r.ticket_id for r in spark.table("first").collect()) == ["a", "b", "c"]


def test_breaker_opens_cools_down_and_recovers(spark, tmp_path):
    calls = [(i, at, ok) for i, (at, ok) in enumerate([(0, 0), (1, 0), (2, 0), (3, 1), (20, 0), (21, 1), (22, 0)])]
    rows = spark.createDataFrame(calls, "call_id long, s int, ok int").select(
        F.lit("p").alias("provider"), F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "call_id",
        (F.col("ok") == 0).alias("failed"),
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "calls"))
    out = st.circuit_breaker(stream, ProviderSettings(breaker_threshold=3, breaker_cooldown=10.0))
    q = out.writeStream.outputMode("append").format("memory").queryName("breaker").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r.call_id: (r.allowed, r.opened, r.failures) for r in spark.table("breaker").collect()}
    assert got == {
        0: (True, False, 1), 1: (True, False, 2), 2: (True, True, 3), 3: (False, False, 3),
        4: (True, False, 1), 5: (True, False, 0), 6: (True, False, 1),
    }


def test_sinks_round_trip(spark, tmp_path):
    one_row = spark.createDataFrame([(0.58, [1.0])], "threshold double, values array<double>")
    sk.write_artefact(one_row, str(tmp_path / "fit"))
    assert sk.read_artefact(spark, str(tmp_path / "missing"), str(tmp_path / "fit")).first().threshold == 0.58
    assert sk.read_artefact(spark, str(tmp_path / "missing")) is None
    requests = spark.createDataFrame([("m", 0.0, 900, True, "hi"), ("m", 0.0, 901, True, "hi")], "model string, t double, n int, j boolean, x string")
    keyed = requests.withColumn("key", sk.cache_key(F.col("model"), F.col("t"), F.col("n"), F.col("j"), F.array("x")))
    assert keyed.select("key").distinct().count() == 2
    sk.append_cache(keyed.limit(1).select("key", F.lit("reply").alias("content")), str(tmp_path / "cache"))
    stats = sk.cache_stats(sk.with_cached_replies(keyed, spark.read.parquet(str(tmp_path / "cache")))).first()
    assert (stats.hits, stats.misses) == (1, 1)


def test_prompt_register_and_overrides(spark, tmp_path):
    (tmp_path / "p-escalate-001.json").write_text('{"version": "9", "template": "T"}')
    (tmp_path / "p-answer-001.json").write_text("broken")
    register = prompts.load_overrides(tmp_path)
    rows = {r.id: r.version for r in prompts.register_rows(spark, register).collect()}
    assert len(rows) == 5 and rows["P-ESCALATE-001"] == "9" and rows["P-ANSWER-001"] == "1.0.0"
    filled = spark.range(1).select(prompts.fill("a {x} {y} {x}", x=F.lit("1"), y=F.lit("2")).alias("t")).first().t
    assert filled == "a 1 2 1"


def test_env_values_fall_back(monkeypatch):
    monkeypatch.setenv("DL_TEST", "abc")
    assert env_value("DL_TEST", 5) == 5
    monkeypatch.setenv("DL_TEST", "0.5")
    assert env_value("DL_TEST", 1.0) == 0.5
