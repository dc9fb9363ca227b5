"""Ticket and corpus sources accept loose shapes and never raise."""

import json

from pyspark.sql import functions as F

from deskloom.operators.normalise import normalise_tickets
from deskloom.settings import SearchSettings
from deskloom.sources.corpus import load_articles, load_corpus
from deskloom.sources.tickets import load_ticket_lines, load_tickets, stream_tickets

HOSTILE = [
    {}, {"body": None}, {"body": ""}, {"subject": "x" * 50000}, {"body": {"nested": [1, 2]}},
    "just text", 42, [1, "two"], {"text": "héllo 👋 你好\x07​", "id": 7},
]


def _load(spark, tmp_path, payload, name="tickets.json"):
    path = tmp_path / name
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload), encoding="utf-8")
    return load_tickets(spark, str(path)).orderBy("position").collect()


def test_hostile_records(spark, tmp_path):
    rows = _load(spark, tmp_path, HOSTILE)
    assert len(rows) == len(HOSTILE)
    assert all(r.ticket_id and isinstance(r.body, str) for r in rows)
    assert rows[0].ticket_id == "unlabelled-0"
    assert rows[0].ingest_warnings == [
        "ticket id missing; a positional id was assigned", "channel missing; defaulted to unknown",
        "ticket has no subject and no body",
    ]
    assert rows[0].model_text == "(empty ticket)"
    assert rows[5].ticket_id == "malformed-5" and rows[5].body == "just text"
    assert rows[6].body == "42" and rows[6].channel == "unknown"
    assert rows[8].ticket_id == "7" and rows[8].body == "héllo 👋 你好"
    assert len(rows[3].subject) == 50000


def test_wrappers_and_json_lines(spark, tmp_path):
    assert len(_load(spark, tmp_path, {"tickets": [{"body": "a"}]}, "w.json")) == 1
    keyed = _load(spark, tmp_path, {"A-1": {"body": "a"}, "A-2": {"ticket_id": "own", "body": "b"}}, "k.json")
    assert [r.ticket_id for r in keyed] == ["A-1", "own"]
    assert [r.body for r in keyed] == ["a", "b"]
    single = _load(spark, tmp_path, {"id": "only", "body": "one"}, "s.json")
    assert [r.ticket_id for r in single] == ["only"]
    lines = _load(spark, tmp_path, '{"id": 1, "body": "x"}\n\nnot json\n{"id": 2}\n', "l.jsonl")
    assert [(r.ticket_id, r.body) for r in lines] == [("1", "x"), ("unlabelled-1", "not json"), ("2", "")]
    split = load_ticket_lines(spark, str(tmp_path / "l.jsonl")).collect()
    assert sorted(r.body for r in split) == ["", "not json", "x"]


def test_first_key_in_record_order_wins(spark):
    text = '{"text": "second alias first", "body": "later", "Customer Tier": "gold", "odd_key": 3, "channel": "Live Chat"}'
    frame = spark.createDataFrame([(0, text)], "position long, record_text string")
    row = normalise_tickets(frame).first()
    assert row.body == "second alias first"
    assert row.customer_tier == "gold" and row.channel == "chat"
    assert row.extra == {"odd_key": "3"}


def test_lists_maps_and_history(spark):
    text = json.dumps({
        "id": "1", "files": ["a.txt", "", None], "labels": {"intent": "billing_query"},
        "history": "{\"escalated\": true}", "outcome": "ignored",
    })
    row = normalise_tickets(spark.createDataFrame([(0, text)], "position long, record_text string")).first()
    assert row.attachments == ["a.txt"]
    assert row.labels == {"intent": "billing_query"} and row.history == {"escalated": "true"}


def test_corpus_shapes(spark, tmp_path):
    article = "# Keys\n\n" + "Rotate the key in the console. " * 4 + "\n\n## Limits:\n\n" + "Quotas reset hourly. " * 4
    path = tmp_path / "docs.json"
    path.write_text(json.dumps([
        {"slug": "kb-1", "name": "Keys", "markdown": article},
        {"id": "kb-2", "title": "Parts", "sections": [{"title": "One", "text": "y" * 60}, "z" * 60]},
        {"title": "Only a title"}, "skipped",
    ]))
    chunks = load_corpus(spark, str(path)).orderBy("doc_ord", "chunk_no").collect()
    assert [(c.chunk_id, c.section) for c in chunks] == [
        ("kb-1#0", "Keys"), ("kb-1#1", "Limits"), ("kb-2#0", "One"), ("kb-2#1", ""), ("doc-2#0", ""),
    ]
    assert chunks[4].text == "Only a title"
    keyed = tmp_path / "keyed.json"
    keyed.write_text(json.dumps({"d1": {"title": "T", "content": "c"}, "d2": "plain"}))
    assert [(a.doc_id, a.content) for a in load_articles(spark, str(keyed)).orderBy("doc_ord").collect()] == [
        ("d1", "c"), ("d2", "plain"),
    ]


def _plain_pack(text, target, overlap):
    """Straightforward restatement of the packing rule, for comparison."""
    import re

    done, open_ = [], ""

    def put(piece, room, gap):
        nonlocal open_
        if len(open_) + len(piece) + room > target and open_:
            done.append(open_.strip())
            open_ = open_[-overlap:]
        open_ += gap(open_) + piece

    for p in (q.strip() for q in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if len(p) > target * 1.8:
            for piece in re.split(r"(?<=[.!?])\s+", p):
                put(piece, 1, lambda o: " ")
        else:
            put(p, 2, lambda o: "\n\n" if o else "")
    if open_.strip():
        done.append(open_.strip())
    return [c for c in done if len(c) > 40]


def test_packing_matches_the_sequential_rule(spark):
    import random

    from deskloom.operators.chunking import pack

    rng = random.Random(3)
    texts = []
    for _ in range(40):
        paragraphs = []
        for _ in range(rng.randint(1, 6)):
            words = ["w" * rng.randint(1, 12) + rng.choice(["", "", ".", "!"]) for _ in range(rng.randint(1, 80))]
            paragraphs.append(" ".join(words))
        texts.append("\n\n".join(paragraphs))
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in frame.select("i", pack(F.col("t"), 120, 30).alias("p")).collect():
        assert r.p == _plain_pack(texts[r.i], 120, 30)


def test_stream_source_uses_the_same_normaliser(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id": "s1", "body": "hello"}\nbroken\n')
    stream = stream_tickets(spark, str(tmp_path / "in"))
    q = stream.writeStream.format("memory").queryName("tickets_in").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.body for r in spark.sql("SELECT body FROM tickets_in").collect()) == ["broken", "hello"]


def test_chunk_settings_defaults():
    assert (SearchSettings().chunk_chars, SearchSettings().chunk_overlap) == (900, 150)


def test_strip_trims_what_the_pattern_of_spaces_names(spark):
    from deskloom.functions.text import SPACE, strip

    odd = [chr(c) for c in range(0x3100) if c not in range(0xD800, 0xE000)]
    frame = spark.createDataFrame([(f"{c}{c}x {c} y{c}\n{c}",) for c in odd] + [("",), (" \n",)], "t string")
    pattern = F.regexp_replace("t", rf"(?U)^{SPACE}+|{SPACE}+$", "")
    assert frame.filter(strip(F.col("t")) != pattern).count() == 0


def test_text_without_a_heading_skips_its_lines(spark):
    from deskloom.operators.chunking import COLON_LINE, HASH_LINE, _is_heading, split_sections
    from deskloom.functions.text import LINE_BREAK

    breaks = ["\n", "\r\n", "\r", "\x0b", "\x85", " "]
    texts = [f"one: two{b}{line}{b}three" for b in breaks for line in ("# Head", " 　## x", "a # b", "Name here:", "Name here:  ", "x:y", "#none")]
    frame = spark.createDataFrame([(t,) for t in texts + ["Only this:", "# a", "#", ":", ""]], "t string")
    lines = F.split("t", LINE_BREAK, -1)
    has = F.exists(lines, _is_heading)
    seen = F.col("t").rlike(HASH_LINE) | F.col("t").rlike(COLON_LINE)
    assert frame.filter(has & ~seen).count() == 0
    got = {r.t: r.s for r in frame.select("t", split_sections(F.col("t")).alias("s")).collect()}
    assert [tuple(s) for s in got["one: two\r\na # b\r\nthree"]] == [("", "one: two\na # b\nthree")]
    assert [tuple(s) for s in got["one: two Name here: three"]] == [("", "one: two"), ("Name here", "three")]
