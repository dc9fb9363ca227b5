"""Ingest, classification, citations, grounding and the whole triage over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog import text as t
from catalog import tuning as tu
from catalog.text import _q, channel_sql, private_data_sql, sentences_sql, substantive_sql
from deskloom import lexicon as lx
from deskloom.functions.guarded import with_guarded
from deskloom.operators import answerability as an
from deskloom.operators import calibration as ca
from deskloom.operators import classify as cl
from deskloom.operators import drafting as dr
from deskloom.operators import guardrails as gr
from deskloom.operators import metrics as m
from deskloom.operators import search as se
from deskloom.operators.decision_log import decision_rows
from deskloom.operators.normalise import normalise_tickets
from deskloom.plans import triage as tr
from deskloom.session import shared_folder, spread
from deskloom.settings import Settings
from deskloom.sinks import artefacts as sk

S = Settings()


def normalised_tickets(spark, sf_dir):
    tickets = normalise_tickets(b.ticket_records(spark, sf_dir))
    joined = lambda c: F.array_join(F.map_values(c), "|")
    return tickets.select(
        "position", "ticket_id", "channel", "subject", "body", "raw_text", "customer_tier", "region",
        "model_text", joined("labels").alias("labels"), joined("extra").alias("extra"),
        F.array_join("ingest_warnings", "|").alias("warnings"),
    )


def rule_classification(spark, sf_dir):
    """Keyword rules over every conversation turn and document: rows of one corpus of texts."""
    turns = spread(b.table(spark, sf_dir, "conversations")).select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("text_id"), "text"
    )
    docs = spread(b.table(spark, sf_dir, "documents")).select(
        F.concat_ws("-", F.lit("d"), "doc_id").alias("text_id"), "text"
    )
    judged = turns.unionByName(docs).select("text_id", cl.by_rules(F.col("text"), S).alias("c"))
    return judged.select(
        "text_id", "c.intent", "c.urgency", "c.confidence",
        F.array_join(F.transform("c.alternatives", lambda a: a["intent"]), ",").alias("alternatives"),
    )


def reply_classification(spark, sf_dir):
    """Model replies read back from prose and fences, canonicalised, shrunk and penalised."""
    tickets = b.drafted_tickets(spark, sf_dir)
    judged = cl.classify(tickets.filter("classifier_reply IS NOT NULL"), S)
    return judged.select(
        "position", F.col("classification.intent").alias("intent"),
        F.col("classification.urgency").alias("urgency"),
        F.col("classification.confidence").alias("confidence"),
        F.col("classification.raw_confidence").alias("raw_confidence"),
        F.col("classification.method").alias("method"),
    )


def _cited_turns(spark, sf_dir):
    """Assistant turns with a marker after each line, against as many sources as user turns."""
    turns = b.table(spark, sf_dir, "conversations")
    sources = (
        turns.filter("role = 'user'")
        .groupBy("conv_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "turn", F.concat_ws("#", "conv_id", "turn").alias("chunk_id"), "text",
                        F.lit("turn").alias("title"),
                    )
                )
            ).alias("retrieved")
        )
    )
    marked = F.array_join(
        F.transform(
            F.split("text", "\n"),
            lambda line, i: F.concat(line, F.lit(" [S"), (i + 1).cast("string"), F.lit("] .")),
        ),
        "\n",
    )
    return (
        spread(turns).filter("role = 'assistant'")
        .select("conv_id", "turn", marked.alias("text"))
        .join(sources, "conv_id")
    )


def resolved_citations(spark, sf_dir):
    rows = _cited_turns(spark, sf_dir).select(
        "conv_id", "turn", dr.resolve_markers(F.col("text"), F.col("retrieved")).alias("r")
    )
    return rows.select(
        "conv_id", "turn", "r.text", F.array_join("r.cited", ",").alias("cited"),
        F.array_join("r.dangling", ",").alias("dangling"),
    )


def grounding_scores(spark, sf_dir):
    rows = _cited_turns(spark, sf_dir).select(
        "conv_id", "turn", gr.grounding(F.col("text"), F.col("retrieved"), S.guardrails).alias("g")
    )
    return rows.select(
        "conv_id", "turn", F.col("g.ratio").alias("ratio"), F.col("g.method").alias("method"),
        F.size("g.unsupported").cast("long").alias("unsupported"),
    )


def _outcomes(spark, sf_dir):
    return tr.triage(
        b.drafted_tickets(spark, sf_dir), b.articles(spark, sf_dir), S, run_id="run-1",
        chunks=b.chunks(spark, sf_dir),
    )


def outcomes(spark, sf_dir):
    """The whole triage of every user turn over the whole corpus."""
    return _outcomes(spark, sf_dir).select(
        "position", "ticket_id", "channel",
        F.col("classification.intent").alias("intent"),
        F.col("classification.confidence").alias("confidence"),
        F.size("retrieved").cast("long").alias("retrieved_count"),
        F.get("retrieved", F.lit(0))["chunk_id"].alias("top_chunk"),
        F.get("retrieved", F.lit(0))["score"].alias("top_score"),
        F.col("signals.answerability_probability").alias("probability"),
        F.col("signals.grounding_score").alias("grounding"),
        F.array_join(gr.triggered_names(F.col("findings")), ",").alias("triggered"),
        "action", F.col("routing.rule_fired").alias("rule_fired"), "degraded",
        F.array_join("citations", ",").alias("citations"),
    )


def _drafter(reply: str | None, text: str) -> str | None:
    """A drafting function that fails on some texts."""
    if len(text) % 10 == 3:
        raise ValueError(f"no draft for {len(text)} characters")
    return reply


def outcomes_with_failures(spark, sf_dir):
    """The triage of every user turn where drafting raises for some: all rows come out, those escalated."""
    tickets = with_guarded(
        b.drafted_tickets(spark, sf_dir), "reply", _drafter, "string", F.col("reply"), F.col("model_text")
    )
    done = tr.triage(tickets, b.articles(spark, sf_dir), S, run_id="run-1", chunks=b.chunks(spark, sf_dir))
    return done.select(
        "position", "ticket_id", F.col("classification.intent").alias("intent"), F.col("classification.confidence").alias("confidence"),
        F.size("retrieved").cast("long").alias("retrieved_count"), "action", F.col("routing.rule_fired").alias("rule_fired"),
        "degraded", F.array_join("citations", ",").alias("citations"), F.col("escalation_package.why_escalated").alias("why"), "error",
    ).withColumn("why", F.when(F.col("error").isNotNull(), F.col("why")))


def fitted_outcomes(spark, sf_dir):
    """The triage of every user turn by a calibration and a model that were fitted on the labelled
    documents, published, and loaded again behind a folder that has none."""
    labelled, folder = b.scored_rows(spark, sf_dir), shared_folder(spark, "models")
    sk.publish(ca.fit_isotonic(labelled), folder, "calibration")
    sk.publish(an.fit_descent(labelled.select("intent", "score", "answerable")), folder, "answerability")
    paths = (f"{folder}/none", folder)
    done = tr.triage(
        b.drafted_tickets(spark, sf_dir), b.articles(spark, sf_dir), S, run_id="run-1", chunks=b.chunks(spark, sf_dir),
        model=sk.load_answerability(spark, *paths), calibration=sk.load_calibration(spark, *paths),
    )
    return done.select(
        "position", "ticket_id", F.col("classification.intent").alias("intent"),
        F.col("classification.confidence").alias("confidence"),
        F.col("signals.answerability_probability").alias("probability"), "action", F.col("routing.rule_fired").alias("rule_fired"),
    )


def _vector_no(name, vectors):
    """A row of the embeddings by the digest of a name; one in nine names gets none."""
    n = vectors.agg(F.count("*").alias("n")).scalar()
    return F.conv(F.left(F.md5(name), F.lit(8)), 16, 10).cast("long") % (n + F.floor(n / 8))


def vector_grounded_outcomes(spark, sf_dir):
    """The triage of every user turn with drafts judged by vectors, by words where one is missing."""
    vectors = b.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    chunks = b.chunks(spark, sf_dir)

    def with_vectors(names, column):
        return names.withColumn("vec_id", _vector_no(F.col(column), vectors)).join(vectors, "vec_id")

    done = tr.triage(
        b.drafted_tickets(spark, sf_dir), b.articles(spark, sf_dir), S, run_id="run-1", chunks=chunks,
        embed=lambda sentences: with_vectors(sentences, "text"), chunk_vectors=with_vectors(chunks.select("chunk_id"), "chunk_id"),
    )
    return done.select(
        "position", "ticket_id", F.col("signals.grounding_score").alias("grounding"), F.col("grounding.method").alias("method"),
        F.size("grounding.unsupported").cast("long").alias("unsupported"), "action", F.col("routing.rule_fired").alias("rule_fired"),
    )


def cited_passages(spark, sf_dir):
    """Each citation of the triage followed to the title and text of its chunk, in a table in buckets."""
    folder = shared_folder(spark, "chunk-table")
    chunks = se.write_chunk_table(b.chunks(spark, sf_dir), folder, f"chunks_{folder.rsplit('-', 1)[1]}")
    done = tr.triage(b.drafted_tickets(spark, sf_dir), b.articles(spark, sf_dir), S, run_id="run-1", chunks=chunks)
    cited = done.select("position", F.explode("citations").alias("chunk_id"))
    return se.resolve_citations(cited, chunks).select("position", "chunk_id", "title", F.sha2("text", 256).alias("text_sha256"))


def outcome_volume(spark, sf_dir):
    flat = m.flatten(_outcomes(spark, sf_dir))
    return m.volume_by(flat, "rule_fired")


def log_rows(spark, sf_dir):
    """Decision-log rows of the triage, without clock-dependent columns."""
    return decision_rows(_outcomes(spark, sf_dir)).select(
        "run_id", "ticket_id", "channel", "customer_tier", "region", "predicted_intent", "action",
        "rule_fired", "retrieved_count", "guardrails_blocked", "degraded",
        F.length("input_text").cast("long").alias("input_chars"), "guardrails_triggered",
    )


QUERIES = {
    "triage_" + f.__name__: f
    for f in (
        normalised_tickets, rule_classification, reply_classification, resolved_citations,
        grounding_scores, outcomes, outcomes_with_failures, fitted_outcomes, vector_grounded_outcomes, cited_passages,
        outcome_volume, log_rows,
    )
}

_CHANNEL, _WARNING = channel_sql("raw")
_STRIP = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
_CLEAN = r"regexp_replace({t}, '[ \t]{{3,}}', '  ', 'g')"
_SUBJECT = _STRIP.format(t=_CLEAN.format(t="coalesce(CASE WHEN turn = 0 THEN '  About   ' || chr(9) || c_name END, '')"))
_BODY = _STRIP.format(t=_CLEAN.format(t="text"))

_TICKETS = f"""{b.RECORDS_SQL},
norm AS (
  SELECT *, CASE WHEN turn < 4 THEN conv_id || '-' || turn ELSE 'unlabelled-' || position END AS ticket_id,
    {_CHANNEL} AS channel, {_SUBJECT} AS subject, {_BODY} AS body, {_WARNING} AS channel_warning
  FROM turns
),
tickets AS (
  SELECT *, CASE WHEN subject <> '' AND body <> '' THEN subject || chr(10) || chr(10) || body
      WHEN subject <> '' THEN subject WHEN body <> '' THEN body ELSE '' END AS raw_text,
    array_to_string(list_filter([CASE WHEN turn >= 4 THEN '{lx.WARN_NO_ID}' END, channel_warning,
      CASE WHEN subject = '' AND body = '' THEN '{lx.WARN_EMPTY}' WHEN body = '' THEN '{lx.WARN_NO_BODY}' END],
      lambda x: x IS NOT NULL), '|') AS warnings
  FROM norm
)"""


def rules_sql(source: str, key: str, name: str = "judged") -> str:
    """CTE ``name``(key, intent, urgency, confidence, alternatives) from ``source``(key, text)."""
    cues = ", ".join(
        f"({i}, '{intent}', '{_q(w)}', {1.0 + len(w) / 40.0}::DOUBLE)"
        for i, (intent, words) in enumerate(cl.cues_for(S.brand).items()) for w in words
    )
    levels = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(text), '{_q(w)}')" for w in words) + f" THEN '{level}'"
        for level, words in lx.URGENCY_CUES.items()
    )
    ceiling = cl.fallback_ceiling(S)
    return f"""
cues(ord, intent, cue, weight) AS (VALUES {cues}),
hits AS (
  SELECT s.{key}, ord, intent, sum(weight) AS score FROM {source} s JOIN cues ON contains(lower(text), cue)
  GROUP BY ALL
),
placed AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(score, 9) DESC, ord) AS i FROM hits),
tops AS (
  SELECT {key}, max(intent) FILTER (i = 1) AS intent, max(score) FILTER (i = 1) AS s1,
    coalesce(max(score) FILTER (i = 2), 0) AS s2,
    coalesce(string_agg(intent, ',' ORDER BY i) FILTER (i >= 2), '') AS alternatives
  FROM placed GROUP BY {key}
),
{name} AS (
  SELECT s.{key}, coalesce(intent, '{lx.TAXONOMY[0]}') AS intent, CASE {levels} ELSE 'medium' END AS urgency,
    round(CASE WHEN intent IS NULL THEN 0.15::DOUBLE ELSE least({ceiling}::DOUBLE, 0.30::DOUBLE + 0.25::DOUBLE * (s1 - s2) / s1) END, 4) AS confidence,
    coalesce(alternatives, '') AS alternatives
  FROM {source} s LEFT JOIN tops USING ({key})
)"""


_TEXTS = """texts AS (
  SELECT 'c-' || conv_id || '-' || turn AS text_id, text FROM conversations
  UNION ALL SELECT 'd-' || doc_id, text FROM documents
)"""

_REPLIES = """replied AS (
  SELECT position, c_nationkey, c_mktsegment, c_acctbal, warnings FROM tickets WHERE c_acctbal > 0
),
llm0 AS (
  SELECT position, """ + b.taxonomy_at_sql("c_nationkey") + """ AS intent,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'critical' ELSE 'medium' END AS urgency,
    least(1.0, CASE WHEN round(c_acctbal / 100, 2) > 1 THEN round(c_acctbal / 100, 2) / 100 ELSE round(c_acctbal / 100, 2) END)::DOUBLE AS raw,
    round(c_acctbal / 20000, 4) AS alt, warnings <> '' AS damaged FROM replied
),
llm1 AS (SELECT *, round(least(0.85::DOUBLE, raw * 0.8::DOUBLE), 4) AS base FROM llm0),
llm2 AS (SELECT *, CASE WHEN alt >= base - 0.10::DOUBLE THEN round(base * 0.85::DOUBLE, 4) ELSE base END AS contested FROM llm1),
llm AS (SELECT position, intent, urgency, round(raw, 4) AS raw_confidence,
  CASE WHEN damaged THEN round(contested * 0.80::DOUBLE, 4) ELSE contested END AS confidence FROM llm2)"""

_MARKED = """sources AS (
  SELECT conv_id, list({{'id': conv_id || '#' || turn, 'text': text}} ORDER BY turn) AS s, count(*) AS n
  FROM conversations WHERE role = 'user' GROUP BY conv_id
),
marked AS (
  SELECT conv_id, turn, n, s, string_split(text, chr(10)) AS lines FROM conversations JOIN sources USING (conv_id)
  WHERE role = 'assistant'
),
drafts AS (
  SELECT conv_id, turn, n, s, len(lines) AS k, array_to_string(list_transform(lines, lambda l, i: l || ' [S' || i || '] .'), chr(10)) AS text,
    array_to_string(list_transform(lines, lambda l, i: l || CASE WHEN i <= n THEN ' [S' || i || '] .' ELSE '  .' END), chr(10)) AS tidy
  FROM marked
)""".replace("{{", "{").replace("}}", "}")


def grounding_sql(drafts: str, key: str, name: str = "grounded") -> str:
    """CTE ``name``(key, ratio, method, unsupported) from ``drafts``(key, text, src text)."""
    return f"""
{name}_claims AS (
  SELECT {key}, src, list_filter({sentences_sql("text")}, lambda c: {substantive_sql("c")}) AS claims FROM {drafts}
),
{name}_tokens AS (
  SELECT {key}, claims, list_transform(claims, lambda c: list_distinct({b.tokens_sql("c")})) AS ct,
    list_distinct({b.tokens_sql("src")}) AS st FROM {name}_claims
),
{name}_weak AS (
  SELECT {key}, len(claims) AS n, len(list_filter(ct, lambda c: len(c) > 0 AND len(list_intersect(c, st)) / len(c) < 0.30)) AS w
  FROM {name}_tokens
),
{name} AS (
  SELECT {key}, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE round(1 - w / n, 4) END AS ratio,
    CASE WHEN n = 0 THEN 'no_substantive_sentences' ELSE 'lexical' END AS method, CASE WHEN n = 0 THEN 0 ELSE w END::BIGINT AS unsupported
  FROM {name}_weak
)"""


_COMMIT_HIT = " OR ".join(f"regexp_matches(text, '{_q(p)}')" for p in t.COMMITMENTS_RE2.values())

_TRIAGE = f"""WITH RECURSIVE {b.CHUNKS_SQL}, {_TICKETS},
queries AS (SELECT DISTINCT raw_text AS query_id, raw_text AS text FROM tickets WHERE raw_text <> ''),
{b.bm25_sql("queries")},
{b.ranked_sql("scores", "lexical", S.search.min_score)},
hits_of AS (
  SELECT query_id, count(*) AS n, max_by(chunk_id, -rank) AS top_chunk, round(max_by(score, -rank), 4) AS top_score,
    list(chunk_id ORDER BY rank) AS ids, string_agg(c.text || chr(10) || c.title, chr(10) ORDER BY rank) AS src
  FROM ranked r JOIN corpus c USING (doc_ord, chunk_no) GROUP BY query_id
),
{_REPLIES}, rule_texts AS (SELECT position, raw_text AS text FROM tickets WHERE raw_text <> ''),
{rules_sql("rule_texts", "position", "ruled")},
classified AS (
  SELECT t.position, t.ticket_id, t.channel, t.raw_text, t.warnings, t.conv_id, t.turn, t.c_mktsegment, t.r_name,
    CASE WHEN raw_text = '' THEN '{lx.TAXONOMY[0]}' ELSE coalesce(l.intent, r.intent) END AS intent,
    CASE WHEN raw_text = '' THEN 'unknown' ELSE coalesce(l.urgency, r.urgency) END AS urgency,
    CASE WHEN raw_text = '' THEN 0 ELSE coalesce(l.confidence, r.confidence) END AS confidence,
    l.position IS NULL AND raw_text <> '' AS fallback
  FROM tickets t LEFT JOIN llm l USING (position) LEFT JOIN ruled r USING (position)
),
looked AS (
  SELECT c.*, coalesce(h.n, 0) AS n, top_chunk, coalesce(top_score, 0)::DOUBLE AS top_score, ids, src
  FROM classified c LEFT JOIN hits_of h ON h.query_id = c.raw_text
),
drafted AS (
  SELECT l.*, a.text IS NULL AND n > 0 AS no_reply,
    CASE WHEN n > 0 THEN {_STRIP.format(t="array_to_string(list_transform(string_split(a.text, chr(10)), lambda s, i: s || CASE WHEN i <= n THEN ' [S' || i || ']' ELSE '' END), chr(10))")} END AS text,
    CASE WHEN n > 0 THEN list_filter(ids, lambda x, i: i <= len(string_split(a.text, chr(10)))) END AS cited
  FROM looked l LEFT JOIN conversations a ON a.role = 'assistant' AND a.conv_id = l.conv_id AND a.turn = l.turn + 1
),
with_draft AS (SELECT position, text, src FROM drafted WHERE text <> ''),
{grounding_sql("with_draft", "position")},
{private_data_sql("with_draft", "position")},
flags AS (
  SELECT w.position, ratio, EXISTS (SELECT 1 FROM pii p WHERE p.position = w.position AND NOT allowed) AS f1,
    ratio < 0.70 AS f2, {_COMMIT_HIT} AS f3, len(list_filter({t._MARKERS}, lambda m: contains(lower(text), m))) > 0 AS f4
  FROM with_draft w JOIN grounded USING (position)
),
scored AS (
  SELECT d.*, f.*  EXCLUDE (position), {b._PRIORS_SQL} AS prior, fallback OR no_reply AS degraded,
    array_to_string(list_filter([CASE WHEN f1 THEN 'private_data' END, CASE WHEN f2 THEN 'unsupported_claims' END,
      CASE WHEN f3 THEN 'prohibited_commitment' END, CASE WHEN f4 THEN 'injection_leak' END], lambda x: x IS NOT NULL), ',') AS names
  FROM drafted d LEFT JOIN flags f USING (position)
),
probable AS (SELECT *, {b.probability_sql("prior", "top_score")} AS probability FROM scored),
ruled_all AS (
  SELECT *, CASE
    WHEN names <> '' AND names IS NOT NULL THEN '{lx.R0}'
    WHEN intent IN {b._NEVER_SQL} THEN '{lx.R1}'
    WHEN intent IN {b._RISKY_SQL} AND urgency IN ('high', 'critical') THEN '{lx.R2}'
    WHEN contains(warnings, '{lx.EMPTY_TICKET_MARKER}') THEN '{lx.R3}'
    WHEN confidence < 0.55 THEN '{lx.R4}'
    WHEN n = 0 OR probability < 0.58 THEN '{lx.R5}'
    WHEN ratio < 0.60 THEN '{lx.R6}'
    WHEN degraded THEN '{lx.R7}'
    ELSE '{lx.R8}' END AS rule_fired
  FROM probable
),
final AS (
  SELECT *, CASE rule_fired WHEN '{lx.R0}' THEN 'blocked' WHEN '{lx.R8}' THEN 'answer' ELSE 'escalate' END AS action
  FROM ruled_all
)"""

_SHRUNK = "round(least(0.85::DOUBLE, raw * 0.8::DOUBLE), 4)"
_CALIBRATED = """round(coalesce((SELECT max_by(v.value, v.bin) FROM fit v WHERE v.bin / 10 <= raw),
  (SELECT min_by(v.value, v.bin) FROM fit v)), 4)"""
_FITTED_TRIAGE = (
    f"WITH RECURSIVE {b.SCORED_SQL}, {tu.DESCENT_SQL}, {tu.pav_sql('correct')}, "
    + _TRIAGE.removeprefix("WITH RECURSIVE ").replace(_SHRUNK, _CALIBRATED)
    .replace(b.probability_sql("prior", "top_score"), tu.fitted_probability_sql("scored.intent", "scored.top_score"))
)

_VECTOR_NO = "('0x' || left(md5({t}), 8))::BIGINT % m"
_VECTOR_TRIAGE = _TRIAGE.replace("with_draft AS (SELECT position, text, src FROM", "with_draft AS (SELECT position, text, src, ids FROM").replace(
    "FROM with_draft w JOIN grounded USING (position)", "FROM with_draft w JOIN vector_judged USING (position)"
).replace("\nflags AS (", f"""
numbered AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
many AS (SELECT count(*) + count(*) // 8 AS m FROM embeddings),
claim_vectors AS (
  SELECT position, i, v FROM (SELECT position, unnest(claims) AS c, generate_subscripts(claims, 1) AS i FROM grounded_claims) x
  CROSS JOIN many LEFT JOIN numbered ON vec_id = {_VECTOR_NO.format(t="c")}
),
source_vectors AS (
  SELECT position, v FROM (SELECT position, unnest(ids) AS chunk_id FROM with_draft) x
  CROSS JOIN many LEFT JOIN numbered ON vec_id = {_VECTOR_NO.format(t="chunk_id")}
),
incomplete AS (SELECT position FROM claim_vectors WHERE v IS NULL UNION SELECT position FROM source_vectors WHERE v IS NULL),
supports AS (
  SELECT position, i, max(list_dot_product(c.v, s.v)) AS support FROM claim_vectors c JOIN source_vectors s USING (position)
  WHERE position NOT IN (SELECT position FROM incomplete) GROUP BY ALL
),
vector_ratio AS (SELECT position, count(*) AS n, count(*) FILTER (support < {S.guardrails.support_dense}) AS w FROM supports GROUP BY position),
vector_judged AS (
  SELECT g.position, CASE WHEN v.n IS NULL THEN g.ratio ELSE round(1 - v.w / v.n, 4) END AS ratio,
    CASE WHEN v.n IS NULL THEN g.method ELSE 'embedding' END AS method, coalesce(v.w, g.unsupported) AS unsupported
  FROM grounded g LEFT JOIN vector_ratio v USING (position)
),
flags AS (""")

SQL = {
    "triage_normalised_tickets": f"""WITH {_TICKETS}
SELECT position, ticket_id, channel, subject, body, raw_text, c_mktsegment AS customer_tier, r_name AS region,
  CASE WHEN raw_text = '' THEN '{lx.EMPTY_TICKET}' ELSE raw_text END AS model_text,
  array_to_string(list_filter([n_name, 'true'], lambda x: x IS NOT NULL), '|') AS labels,
  CASE WHEN c_acctbal < 0 THEN 'overdue' ELSE '' END AS extra, warnings FROM tickets""",
    "triage_rule_classification": f"WITH {_TEXTS}, {rules_sql('texts', 'text_id')} SELECT * FROM judged",
    "triage_reply_classification": f"""WITH {_TICKETS}, {_REPLIES}
SELECT position, intent, urgency, confidence, raw_confidence, 'llm' AS method FROM llm""",
    "triage_resolved_citations": f"""WITH {_MARKED}
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(tidy, '[ \\t]{{2,}}', ' ', 'g'), '\\s+([.,;:!?])', '\\1', 'g'),
    '^\\s+|\\s+$', '', 'g') AS text,
  array_to_string(list_transform(list_filter(s, lambda x, i: i <= k), lambda x: x.id), ',') AS cited,
  array_to_string(list_transform(range(n + 1, k + 1), lambda i: '[S' || i || ']'), ',') AS dangling
FROM drafts""",
    "triage_grounding_scores": f"""WITH {_MARKED},
keyed AS (SELECT conv_id || '-' || turn AS key, conv_id, turn, text,
  array_to_string(list_transform(s, lambda x: x.text || chr(10) || 'turn'), chr(10)) AS src FROM drafts),
{grounding_sql("keyed", "key")}
SELECT conv_id, turn, ratio, method, unsupported FROM keyed JOIN grounded USING (key)""",
    "triage_outcomes": f"""{_TRIAGE}
SELECT position, ticket_id, channel, intent, confidence::DOUBLE AS confidence, n AS retrieved_count, top_chunk,
  CASE WHEN n > 0 THEN top_score END AS top_score, probability, ratio AS grounding, CASE WHEN text <> '' THEN names END AS triggered,
  action, rule_fired, degraded, coalesce(array_to_string(cited, ','), '') AS citations FROM final""",
    "triage_outcomes_with_failures": f"""{_TRIAGE}, failing AS (
  SELECT *, length(CASE WHEN raw_text = '' THEN '{lx.EMPTY_TICKET}' ELSE raw_text END) AS chars FROM final
), failed AS (SELECT *, chars % 10 = 3 AS bad FROM failing)
SELECT position, ticket_id, CASE WHEN bad THEN 'other' ELSE intent END AS intent, CASE WHEN bad THEN 0 ELSE confidence::DOUBLE END AS confidence,
  CASE WHEN bad THEN 0 ELSE n END AS retrieved_count, CASE WHEN bad THEN 'escalate' ELSE action END AS action,
  CASE WHEN bad THEN '{lx.R11}' ELSE rule_fired END AS rule_fired, bad OR degraded AS degraded,
  CASE WHEN bad THEN '' ELSE coalesce(array_to_string(cited, ','), '') END AS citations, CASE WHEN bad THEN 'processing error' END AS why,
  CASE WHEN bad THEN 'ValueError: no draft for ' || chars || ' characters' END AS error FROM failed""",
    "triage_fitted_outcomes": f"""{_FITTED_TRIAGE}
SELECT position, ticket_id, intent, confidence::DOUBLE AS confidence, probability, action, rule_fired FROM final""",
    "triage_vector_grounded_outcomes": f"""{_VECTOR_TRIAGE}
SELECT position, ticket_id, f.ratio AS grounding, method, unsupported, action, rule_fired
FROM final f LEFT JOIN vector_judged USING (position)""",
    "triage_cited_passages": f"""{_TRIAGE}
SELECT position, chunk_id, c.title, sha256(c.text) AS text_sha256
FROM (SELECT position, unnest(cited) AS chunk_id FROM final) JOIN corpus c USING (chunk_id)""",
    "triage_outcome_volume": f"{_TRIAGE} SELECT rule_fired, count(*) AS n FROM final GROUP BY rule_fired",
    "triage_log_rows": f"""{_TRIAGE}
SELECT 'run-1' AS run_id, ticket_id, channel, c_mktsegment AS customer_tier, r_name AS region, intent AS predicted_intent,
  action, rule_fired, n::INT AS retrieved_count, coalesce(names <> '', false) AND text <> '' AS guardrails_blocked, degraded,
  length(CASE WHEN raw_text = '' THEN '{lx.EMPTY_TICKET}' ELSE raw_text END) AS input_chars,
  CASE WHEN coalesce(names, '') = '' THEN '[]' ELSE '["' || replace(names, ',', '","') || '"]' END AS guardrails_triggered FROM final""",
}
