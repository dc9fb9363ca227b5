"""Guardrails, classification, routing and drafting invariants on small inputs."""

import itertools

import pytest
from pyspark.sql import functions as F

from deskloom import lexicon as lx
from deskloom.functions import labels as lb
from deskloom.operators import classify as cl
from deskloom.operators import drafting as dr
from deskloom.operators import guardrails as gr
from deskloom.operators import routing as rt
from deskloom.settings import RoutingSettings, Settings

from conftest import one

S = Settings()
PASSAGE = "array<struct<chunk_id:string,title:string,section:string,text:string,score:double>>"


def test_private_data_blocks_and_redacts(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    mail = "jane.doe" + "@" + "corp.example.net"
    found = one(spark, gr.check_private_data(F.col("t"), S), t=f"Use {key} or write to {mail}, card 4111 1111 1111 1111.")
    assert found.triggered and found.blocked
    names = [e.split(":")[0] for e in found.evidence]
    assert {"email_address", "credit_card", "aws_access_key"} <= set(names)
    assert not any(key in e or mail in e for e in found.evidence)


def test_placeholders_are_allowed(spark):
    text = f"Set YOUR_API_KEY, write to support@{S.brand}.com, ping 127.0.0.1, order 4111111111111112, host 999.1.1.1"
    assert not one(spark, gr.check_private_data(F.col("t"), S), t=text).triggered


@pytest.mark.parametrize("text,name", [
    ("We will refund you.", "refund"), ("We guarantee it.", "sla_guarantee"),
    ("We will fix it by Monday", "delivery_promise"), ("goodwill credit applied", "compensation"),
    ("You are legally entitled", "contractual"),
])
def test_commitments(spark, text, name):
    assert name in [e.name for e in one(spark, gr.commitment_evidence(F.col("t")), t=text)]


def test_injection_and_clean_text(spark):
    assert one(spark, gr.check_injection(F.col("t")), t="here is my System Prompt").blocked
    assert not one(spark, gr.check_injection(F.col("t")), t="rotate the key").triggered


def test_grounding_cases(spark):
    rows = spark.createDataFrame(
        [
            ("empty", "", [("c", "t", None, "x", 0.5)]),
            ("none", "A claim that is long enough to count here.", []),
            ("polite", "Thanks for reaching out to our team today.", [("c", "t", None, "x", 0.5)]),
            ("half", "Rotate access keys inside console settings. Unicorns bring marvellous free upgrades tomorrow.",
             [("c", "Keys", None, "rotate access keys console settings. inside", 0.5)]),
        ],
        f"k string, draft_text string, retrieved {PASSAGE}",
    )
    got = {r.k: r.g for r in rows.select("k", gr.grounding(F.col("draft_text"), F.col("retrieved")).alias("g")).collect()}
    assert (got["empty"].ratio, got["empty"].method) == (1.0, "empty")
    assert (got["none"].ratio, got["none"].method) == (0.0, "no_sources")
    assert (got["polite"].ratio, got["polite"].method) == (1.0, "no_substantive_sentences")
    assert got["half"].ratio == 0.5 and len(got["half"].unsupported) == 1


def test_rules_never_reach_the_routing_threshold(spark):
    texts = ["sso saml okta entra idp", "please help", "export csv dump", "nothing at all", "urgent: deploy failed, down"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cl.by_rules(F.col("t"), S).alias("c")).collect()
    assert all(r.c.confidence < S.routing.min_confidence for r in rows)
    assert rows[0].c.intent == "sso_configuration" and rows[3].c.intent == lx.TAXONOMY[0]
    assert rows[3].c.confidence == 0.15 and rows[4].c.urgency == "high"


def test_json_is_found_in_prose_and_fences(spark):
    frame = spark.createDataFrame(
        [('Sure: {"a": {"b": 1}} bye',), ('```json\n{"a": 2}\n```',), ("no json",), ("[1]",), ("{bad} {\"a\": 3}",), (None,)],
        "r string",
    )
    assert [x.j for x in frame.select(cl.extract_json("r").alias("j")).collect()] == [
        '{"a": {"b": 1}}', '{"a": 2}', None, None, '{"a": 3}', None,
    ]


def test_reply_penalties_and_string_alternatives(spark):
    reply = '{"intent": "Billing", "urgency": "blocker", "confidence": 90, "alternatives": ["sso", {"category": "rate limit", "confidence": 0.7}]}'
    c = one(spark, cl.by_reply(F.col("r"), F.lit(True)), r=reply)
    assert c.intent == "billing_query" and c.urgency == "critical" and c.raw_confidence == 0.9
    assert [(a.intent, a.confidence) for a in c.alternatives] == [("sso_configuration", 0.0), ("rate_limit", 0.7)]
    assert c.confidence == pytest.approx(round(round(0.72 * 0.85, 4) * 0.8, 4))


def _decide(spark, **v):
    base = dict(intent="billing_query", urgency="medium", confidence=0.9, n=2, best=0.7, p=0.9, g=0.9, degraded=False)
    base.update(v)
    warnings = F.array(F.lit(v.get("warning", ""))) if "warning" in v else F.array().cast("array<string>")
    base.pop("warning", None)
    settings = base.pop("settings", RoutingSettings())
    g = F.lit(base.pop("g")).cast("double")
    col = rt.decide(F.col("intent"), F.col("urgency"), F.col("confidence"), warnings, F.col("n"),
                    F.col("best"), F.col("p"), g, F.col("degraded"), settings)
    return one(spark, col, **base)


@pytest.mark.parametrize("values,rule", [
    ({}, lx.R8),
    ({"intent": "security_incident", "confidence": 0.99}, lx.R1),
    ({"intent": "database_issue", "urgency": "high"}, lx.R2),
    ({"intent": "database_issue", "urgency": "low"}, lx.R8),
    ({"warning": lx.WARN_EMPTY}, lx.R3),
    ({"confidence": 0.54}, lx.R4),
    ({"p": 0.57}, lx.R5), ({"p": 0.58}, lx.R8), ({"n": 0}, lx.R5),
    ({"g": 0.59}, lx.R6), ({"g": None}, lx.R8),
    ({"degraded": True}, lx.R7),
    ({"settings": RoutingSettings(automation_enabled=False)}, lx.R9),
])
def test_rule_order(spark, values, rule):
    assert _decide(spark, **values).rule_fired == rule


def test_overrides(spark):
    answer = F.struct(F.lit("answer").alias("action"), F.lit(lx.R8).alias("rule_fired"), F.lit("ok").alias("reason"))
    none = F.array().cast("array<struct<name:string,triggered:boolean,blocked:boolean>>")
    bad = F.array(F.struct(F.lit("private_data").alias("name"), F.lit(True).alias("triggered"), F.lit(True).alias("blocked")))
    assert one(spark, rt.override(answer, F.lit(True), none)).rule_fired == lx.R10
    assert one(spark, rt.override(answer, F.lit(True), bad)).rule_fired == lx.R0
    assert one(spark, rt.override(answer, F.lit(False), none)).action == "answer"


def test_citation_resolution(spark):
    passages = F.array(F.struct(F.lit("kb-a#0").alias("chunk_id")))
    r = one(spark, dr.resolve_markers(F.col("t"), passages), t="Do X [S1]. Also Y [S7]. Again [S1] and [S99999999999].")
    assert r.cited == ["kb-a#0"] and r.dangling == ["[S7]", "[S99999999999]"]
    assert r.text == "Do X [S1]. Also Y. Again [S1] and."


def test_draft_outcomes(spark):
    rows = spark.createDataFrame(
        [("none", "hi there", []), ("down", None, [("c", "t", None, "x", 0.5)]),
         ("decline", "insufficient_context: no idea", [("c", "t", None, "x", 0.5)]),
         ("ok", "Fine [S1].", [("c", "t", None, "x", 0.5)])],
        f"k string, reply string, retrieved {PASSAGE}",
    )
    got = {r.k: r for r in dr.draft(rows).collect()}
    assert got["none"].draft is None and not got["none"].draft_degraded
    assert got["down"].draft is None and got["down"].draft_degraded
    assert got["decline"].declined and got["decline"].draft_text == ""
    assert got["ok"].draft.citations == ["c"]


def test_expected_escalation_prefers_escalate_words(spark):
    words = {"auto then human": True, "Tier_1": False, "AUTO_RESPOND": False, "unknown": None, " Manual ": True}
    for word, expected in words.items():
        assert one(spark, lb.expected_escalation(F.col("w")), w=word) is expected


def test_label_takes_the_first_key_even_when_empty(spark):
    labels = F.create_map(F.lit("Category"), F.lit(""), F.lit("intent"), F.lit("x"))
    extra = F.create_map(F.lit("intent"), F.lit("y"))
    assert one(spark, lb.label(labels, extra, "intent")) == ""
    assert one(spark, lb.label(F.create_map().cast("map<string,string>"), extra, "intent")) == "y"


def test_every_intent_name_survives_its_own_spellings(spark):
    spelled = list(itertools.chain.from_iterable((n, n.upper(), n.replace("_", ""), n.replace("_", " ")) for n in lx.TAXONOMY))
    frame = spark.createDataFrame([(s, s.lower().replace(" ", "").replace("_", "")) for s in spelled], "s string, k string")
    for r in frame.select("k", lb.canonical_intent(F.col("s")).alias("i")).collect():
        assert r.i.replace("_", "") == r.k


def test_vector_grounding_takes_the_best_passage(spark):
    sentences = spark.createDataFrame([("d", 0, [1.0, 0.0]), ("d", 1, [0.0, 1.0])], "draft_id string, sentence_no int, vec array<float>")
    passages = spark.createDataFrame([("d", 0, [1.0, 0.0]), ("d", 1, [0.8, 0.3])], "draft_id string, passage_no int, vec array<float>")
    got = gr.grounding_by_vectors(sentences, passages).first()
    assert (got.sentences, got.ratio) == (2, 0.5)


def test_failed_rows_are_escalated_not_dropped(spark):
    from deskloom.plans.triage import quarantine

    ok = F.struct(F.lit("answer").alias("action"), F.lit(lx.R8).alias("rule_fired"), F.lit("r").alias("reason"))
    rows = spark.range(2).select(
        "id", ok.alias("routing"), F.lit("answer").alias("action"), F.lit("text").alias("response_text"),
        F.lit(False).alias("degraded"),
    )
    got = quarantine(rows, F.when(F.col("id") == 1, F.lit("ValueError: x"))).orderBy("id").collect()
    assert [(r.action, r.routing.rule_fired, r.response_text, r.error) for r in got] == [
        ("answer", lx.R8, "text", None), ("escalate", lx.R11, None, "ValueError: x"),
    ]


def test_guarded_function_keeps_the_other_rows(spark):
    from deskloom.functions.guarded import with_guarded

    def fussy(number, text):
        if text is None:
            raise ValueError("no text")
        return text * (6 // number)

    rows = spark.createDataFrame([(1, "a"), (0, "b"), (2, None), (3, "")], "n long, t string").coalesce(1)
    got = with_guarded(rows, "x", fussy, "string", F.col("n"), F.col("t"))
    got = with_guarded(got, "y", lambda x: len(x), "long", F.col("x"))
    assert {(r.n, r.x, r.y, r.problem) for r in got.collect()} == {
        (1, "aaaaaa", 6, None), (0, None, None, "ZeroDivisionError: integer division or modulo by zero"),
        (2, None, None, "ValueError: no text"), (3, "", 0, None),
    }
