"""How the given tables play the roles the operators expect.

Corpus: ``documents`` (title = source). Search queries: ``benchmark``. Tickets: user turns
of ``conversations``, with the next assistant turn as the drafted reply. Gold labels:
``labels``. Decision log: ``events``. Customer groups: ``customer``/``nation``/``region``.
Every role covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deskloom import lexicon as lx
from deskloom.functions.scoring import answerability, prior_for
from deskloom.functions.text import sql_array
from deskloom.operators.chunking import chunk_documents
from deskloom.operators.normalise import normalise_tickets
from deskloom.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- corpus and queries --------------------------------------------------------


def articles(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("doc_ord"),
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("source").alias("title"),
        F.lit(None).cast("string").alias("url"),
        F.col("text").alias("content"),
    )


def chunks(spark, sf_dir) -> DataFrame:
    return chunk_documents(articles(spark, sf_dir))


def search_queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), "text"
    )


CHUNKS_SQL = r"""
pieces AS (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) ps
  FROM documents WHERE length(text) > 1620
),
fold(doc_id, i, cur, done) AS (
  SELECT doc_id, 0, '', NULL::VARCHAR FROM pieces
  UNION ALL
  SELECT f.doc_id, f.i + 1,
    CASE WHEN f.i = len(p.ps) THEN ''
         WHEN length(f.cur) + length(p.ps[f.i + 1]) + 1 > 900 AND f.cur <> ''
         THEN right(f.cur, 150) || ' ' || p.ps[f.i + 1]
         ELSE f.cur || ' ' || p.ps[f.i + 1] END,
    CASE WHEN f.i = len(p.ps)
           OR (length(f.cur) + length(p.ps[f.i + 1]) + 1 > 900 AND f.cur <> '')
         THEN regexp_replace(f.cur, '^\s+|\s+$', '', 'g') END
  FROM fold f JOIN pieces p USING (doc_id) WHERE f.i <= len(p.ps)
),
chunks AS (
  SELECT doc_id::BIGINT AS doc_ord, 0 AS chunk_no, text FROM documents WHERE length(text) <= 1620
  UNION ALL
  SELECT doc_id::BIGINT, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT, done
  FROM fold WHERE length(done) > 40
),
corpus AS (
  SELECT c.doc_ord, c.chunk_no, c.text, d.source AS title,
         c.doc_ord::VARCHAR || '#' || c.chunk_no::VARCHAR AS chunk_id
  FROM chunks c JOIN documents d ON d.doc_id = c.doc_ord
)"""

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in lx.STOPWORDS) + "]"


def tokens_sql(expr: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({expr}), '{lx.TOKEN_PATTERN}'), "
        f"lambda x: NOT list_contains({STOP_SQL}, x))"
    )


def bm25_sql(query_table: str) -> str:
    """CTEs from ``corpus`` and ``query_table``(query_id, text) to ``scores``."""
    return f"""
toks AS (SELECT doc_ord, chunk_no, {tokens_sql("title || chr(10) || text")} AS t FROM corpus),
dls AS (SELECT doc_ord, chunk_no, len(t) AS dl FROM toks),
stat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
post AS (
  SELECT doc_ord, chunk_no, term, count(*) AS tf
  FROM (SELECT doc_ord, chunk_no, unnest(t) AS term FROM toks) GROUP BY ALL
),
dfs AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, stat GROUP BY term, n),
qt AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest({tokens_sql("text")}) AS term FROM {query_table}) GROUP BY ALL
),
raw AS (
  SELECT qt.query_id, p.doc_ord, p.chunk_no,
    sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))) AS bm25
  FROM qt JOIN post p USING (term) JOIN dfs USING (term) JOIN dls USING (doc_ord, chunk_no), stat
  GROUP BY ALL
),
scores AS (SELECT query_id, doc_ord, chunk_no, bm25 / (bm25 + 16.0) AS lexical FROM raw)"""


def ranked_sql(scored: str, score: str, floor: float, name: str = "ranked") -> str:
    """CTEs that apply floor, per-document cap and top k to ``scored``."""
    return f"""
{name}_seen AS (SELECT *, {score} AS score FROM {scored}),
{name}_doc AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc_ord ORDER BY round(score, 9) DESC, chunk_no) AS nth
  FROM {name}_seen WHERE score >= {floor}
),
{name}_all AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_ord, chunk_no) AS rank
  FROM {name}_doc WHERE nth <= 2
),
{name} AS (SELECT * FROM {name}_all WHERE rank <= 5)"""


QUERIES_SQL = "queries AS (SELECT item_id::VARCHAR AS query_id, text FROM benchmark)"


# --- value bindings -------------------------------------------------------------


def raw_channel(event_type: Column) -> Column:
    """Raw channel names that reach every branch of channel coercion."""
    return (
        F.when(event_type == "view", F.lit("API_DOCUMENTATION"))
        .when(event_type == "click", F.lit("chat-widget"))
        .when(event_type == "signup", F.lit("email_inbound"))
        .when(event_type == "purchase", F.lit("carrier-pigeon"))
    )


RAW_CHANNEL_SQL = (
    "CASE event_type WHEN 'view' THEN 'API_DOCUMENTATION' WHEN 'click' THEN 'chat-widget' "
    "WHEN 'signup' THEN 'email_inbound' WHEN 'purchase' THEN 'carrier-pigeon' END"
)


def taxonomy_at(index: Column) -> Column:
    return F.get(F.expr(sql_array(lx.TAXONOMY)), F.least(index, F.lit(len(lx.TAXONOMY) - 1)).cast("int"))


TAXONOMY_SQL = "[" + ", ".join(f"'{n}'" for n in lx.TAXONOMY) + "]"


def taxonomy_at_sql(index: str) -> str:
    return f"{TAXONOMY_SQL}[least({index}, {len(lx.TAXONOMY) - 1})::INT + 1]"


def intent_of_source(source: Column) -> Column:
    return taxonomy_at(F.substring(source, F.lit(4), F.length(source)).cast("int"))


INTENT_SQL = taxonomy_at_sql("substr(source, 4)::INT")


# --- outcomes and tickets from the star schema -------------------------------------


def flat_outcomes(spark, sf_dir) -> DataFrame:
    """events as decided tickets: the type is what happened, the value is the latency."""
    kind, value = F.col("event_type"), F.col("value")
    action = (
        F.when(kind.isin("purchase", "click"), F.lit("answer"))
        .when(kind == "error", F.lit("blocked"))
        .otherwise(F.lit("escalate"))
    )
    strings = "array<string>"
    finding = lambda name, hit, blocks: F.struct(
        F.lit(name).alias("name"), hit.alias("triggered"), (hit & F.lit(blocks)).alias("blocked")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("ticket_id"),
        F.col("event_id").alias("ticket_ord"),
        F.coalesce(
            F.when(kind == "view", F.lit("docs_comment")).when(kind == "click", F.lit("chat"))
            .when(kind == "signup", F.lit("email")).when(kind == "purchase", F.lit("forum")),
            F.lit("unknown"),
        ).alias("channel"),
        action.alias("action"),
        F.when((kind == "error") & (value > 100), F.lit("timeout")).alias("error"),
        (kind == "signup").alias("degraded"),
        taxonomy_at(F.dayofmonth("ts") - 1).alias("intent"),
        F.when(value < 5, F.lit("low")).when(value < 20, F.lit("medium"))
        .when(value < 60, F.lit("high")).otherwise(F.lit("critical")).alias("urgency"),
        F.round(F.least(F.lit(1.0), value / 100), 4).alias("confidence"),
        (kind == "view").alias("calibrated"),
        F.when(kind != "error", F.round(F.least(F.lit(1.0), value / 50), 4)).alias("grounding_score"),
        (value / 100).alias("latency_seconds"),
        F.array().cast(strings).alias("retrieved_docs"),
        F.array().cast(strings).alias("retrieved_chunks"),
        F.array().cast(strings).alias("citations"),
        F.array(
            finding("private_data", (kind == "error") | ((kind == "click") & (value > 200)), True),
            finding("unsupported_claims", value > 80, False),
            finding("prohibited_commitment", F.lit(False), True),
            finding("injection_leak", (kind == "error") & (value < 1), True),
        ).alias("findings"),
        F.when(action != "answer", F.concat(F.lit("see "), kind)).alias("escalation_note"),
        F.when(action == "answer", F.lit(lx.R8)).when(kind == "error", F.lit(lx.R0))
        .when(value < 30, F.lit(lx.R5)).otherwise(F.lit(lx.R4)).alias("rule_fired"),
        F.round(F.least(F.lit(1.0), value / 30), 4).alias("top_score"),
    )


OUTCOMES_SQL = f"""outcomes AS (
  SELECT user_id::VARCHAR AS ticket_id, event_id AS ticket_ord, event_type AS kind, value,
    CASE event_type WHEN 'view' THEN 'docs_comment' WHEN 'click' THEN 'chat' WHEN 'signup' THEN 'email'
      WHEN 'purchase' THEN 'forum' ELSE 'unknown' END AS channel,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'answer' WHEN event_type = 'error' THEN 'blocked'
      ELSE 'escalate' END AS action,
    CASE WHEN event_type = 'error' AND value > 100 THEN 'timeout' END AS error,
    event_type = 'signup' AS degraded,
    {taxonomy_at_sql("(day(ts) - 1)")} AS intent,
    CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'medium' WHEN value < 60 THEN 'high' ELSE 'critical' END AS urgency,
    round(least(1.0, value / 100), 4) AS confidence,
    event_type = 'view' AS calibrated,
    CASE WHEN event_type <> 'error' THEN round(least(1.0, value / 50), 4) END AS grounding_score,
    value / 100 AS latency_seconds,
    CASE WHEN event_type NOT IN ('purchase', 'click') THEN 'see ' || event_type END AS escalation_note,
    CASE WHEN event_type IN ('purchase', 'click') THEN '{lx.R8}' WHEN event_type = 'error' THEN '{lx.R0}'
      WHEN value < 30 THEN '{lx.R5}' ELSE '{lx.R4}' END AS rule_fired,
    round(least(1.0, value / 30), 4) AS top_score,
    (event_type = 'error') OR (event_type = 'click' AND value > 200) AS f_private,
    value > 80 AS f_unsupported, (event_type = 'error' AND value < 1) AS f_injection
  FROM events
)"""


def customer_tickets(spark, sf_dir) -> DataFrame:
    """customer as tickets with a gold label block under alternative names, and a history."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    rows = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    )
    bal = F.col("c_acctbal")
    labels = F.map_filter(
        F.create_map(
            F.lit("True_Intent"), F.initcap(F.replace(taxonomy_at(F.col("c_nationkey")), F.lit("_"), F.lit(" "))),
            F.lit("priority"), F.when(F.col("c_mktsegment") == "BUILDING", F.lit("P1"))
            .when(F.col("c_mktsegment") == "MACHINERY", F.lit("blocker")).otherwise(F.lit("Minor")),
            F.lit("expected_routing"), F.when(bal < 0, F.lit("Tier2 human"))
            .when(bal < 8000, F.lit("auto_respond")).otherwise(F.lit("unknown")),
            F.lit("answerable"), F.when(bal > 2000, F.lit("Yes")).when(bal > 500, F.lit("no")),
            F.lit("must_not_automate"), F.when(bal < -500, F.lit("true")).otherwise(F.lit("0")),
        ),
        lambda k, v: v.isNotNull(),
    )
    history = F.map_filter(
        F.create_map(
            F.lit("resolution_minutes"), F.when(bal > 0, F.round(bal / 100, 1).cast("string")),
            F.lit("first_response_hours"), F.when(bal > -500, F.lit("4.5")),
            F.lit("first_contact_resolution"), F.when(bal > 1000, F.lit("true")).otherwise(F.lit("false")),
            F.lit("escalated"), F.when(bal > 4000, F.lit("false")).when(bal > 100, F.lit("true")),
            F.lit("csat_rating"), F.when(bal > 5000, F.lit("4")).when(bal > 0, F.lit("2.5")).otherwise(F.lit("n/a")),
        ),
        lambda k, v: v.isNotNull(),
    )
    return rows.select(
        F.col("c_custkey").cast("string").alias("ticket_id"),
        F.col("c_custkey").alias("position"),
        F.col("c_mktsegment").alias("customer_tier"),
        F.col("r_name").alias("region"),
        F.when(bal < 0, F.lit("limited")).when(bal < 5000, F.lit("fluent_non_native"))
        .when(bal < 9000, F.lit("native")).alias("language_fluency"),
        F.lit("").alias("subject"), F.col("c_name").alias("body"),
        labels.alias("labels"), history.alias("history"),
        F.create_map().cast("map<string,string>").alias("extra"),
    )


CUSTOMER_TICKETS_SQL = f"""tickets AS (
  SELECT c_custkey::VARCHAR AS ticket_id, c_custkey AS position, c_acctbal AS bal, c_name AS body,
    c_mktsegment AS customer_tier, r_name AS region,
    CASE WHEN c_acctbal < 0 THEN 'limited' WHEN c_acctbal < 5000 THEN 'fluent_non_native'
      WHEN c_acctbal < 9000 THEN 'native' END AS language_fluency,
    {taxonomy_at_sql("c_nationkey")} AS gold_intent,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'high' WHEN 'MACHINERY' THEN 'critical' ELSE 'low' END AS gold_urgency,
    CASE WHEN c_acctbal < 0 THEN true WHEN c_acctbal < 8000 THEN false END AS gold_escalate,
    CASE WHEN c_acctbal > 2000 THEN true WHEN c_acctbal > 500 THEN false END AS gold_answerable,
    c_acctbal < -500 AS gold_must_not
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
)"""


# --- labelled, scored tickets from documents and labels ------------------------------


def scored_rows(spark, sf_dir) -> DataFrame:
    """Labelled documents as scored tickets: source is the intent, language the urgency."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    intent, lang = intent_of_source(F.col("source")), F.col("lang")
    rows = rows.select(
        "doc_id", intent.alias("intent"),
        F.when(lang == "en", F.lit("low")).when(lang == "fr", F.lit("high"))
        .when(lang == "de", F.lit("critical")).otherwise(F.lit("medium")).alias("urgency"),
        F.round(F.least(F.lit(1.0), F.col("n_chars") / 5000), 4).alias("score"),
        F.round(F.least(F.lit(1.0), F.col("n_chars") / 2500), 4).alias("confidence"),
        (F.col("quality") == 1).alias("answerable"),
        ((F.col("toxic") == 1) | intent.isin(*lx.NEVER_AUTOMATE)).alias("must_not"),
        (F.col("toxic") == 0).alias("correct"),
        F.when(lang == "en", F.lit("dev")).otherwise(F.lit("val")).alias("split"),
    )
    policy = (
        F.col("intent").isin(*lx.NEVER_AUTOMATE)
        | (F.col("intent").isin(*lx.HIGH_RISK_INTENTS) & F.col("urgency").isin(*lx.HIGH_RISK_URGENCY))
        | ~F.col("answerable")
    )
    prior = prior_for(F.col("intent"))
    return rows.select(
        "*",
        F.when(policy, F.lit("escalate")).otherwise(F.lit("auto_respond")).alias("expected_route"),
        prior.alias("prior"),
        answerability(prior, F.col("score")).alias("p"),
    )


_PRIORS_SQL = "CASE intent " + " ".join(
    f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in lx.INTENT_PRIORS.items()
) + f" ELSE {lx.BASE_RATE}::DOUBLE END"
_NEVER_SQL = "(" + ", ".join(f"'{n}'" for n in lx.NEVER_AUTOMATE) + ")"
_RISKY_SQL = "(" + ", ".join(f"'{n}'" for n in lx.HIGH_RISK_INTENTS) + ")"
RESERVED_SQL = f"(intent IN {_NEVER_SQL} OR (intent IN {_RISKY_SQL} AND urgency IN ('high', 'critical')))"


def probability_sql(prior: str, score: str) -> str:
    logit = f"ln(least(greatest({prior}, 1e-4), 1 - 1e-4) / (1 - least(greatest({prior}, 1e-4), 1 - 1e-4)))"
    z = f"({lx.BIAS}::DOUBLE + {lx.WEIGHT_PRIOR}::DOUBLE * {logit} + {lx.WEIGHT_SCORE}::DOUBLE * {score})"
    return f"round(1 / (1 + exp(-{z})), 4)"


SCORED_SQL = f"""base AS (
  SELECT doc_id, {INTENT_SQL} AS intent,
    CASE lang WHEN 'en' THEN 'low' WHEN 'fr' THEN 'high' WHEN 'de' THEN 'critical' ELSE 'medium' END AS urgency,
    round(least(1.0, n_chars / 5000), 4)::DOUBLE AS score, round(least(1.0, n_chars / 2500), 4)::DOUBLE AS confidence,
    quality = 1 AS answerable, toxic = 1 AS toxic, toxic = 0 AS correct,
    CASE WHEN lang = 'en' THEN 'dev' ELSE 'val' END AS split
  FROM documents JOIN labels USING (doc_id)
),
priced AS (SELECT *, {_PRIORS_SQL} AS prior, toxic OR intent IN {_NEVER_SQL} AS must_not,
  CASE WHEN {RESERVED_SQL} OR NOT answerable THEN 'escalate' ELSE 'auto_respond' END AS expected_route FROM base),
rows AS (SELECT *, {probability_sql("prior", "score")} AS p FROM priced)"""


# --- raw tickets from conversations and customers ---------------------------------------


def ticket_records(spark, sf_dir) -> DataFrame:
    """User turns as raw JSON records under alternative field names, in one file order."""
    turns = spread(table(spark, sf_dir, "conversations")).filter("role = 'user'")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    customers = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    )
    rows = turns.join(customers, F.col("conv_id") == F.col("c_custkey"), "left")
    segment = F.col("c_mktsegment")
    channel = (
        F.when(segment == "BUILDING", F.lit("Live Chat"))
        .when(segment == "MACHINERY", F.lit("chat-widget"))
        .when(segment == "AUTOMOBILE", F.lit("API_DOCUMENTATION"))
        .when(segment == "FURNITURE", F.lit("carrier-pigeon"))
    )
    number = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    record = F.struct(
        F.when(F.col("turn") < 4, number).alias("Ticket Number"),
        channel.alias("source"),
        F.when(F.col("turn") == 0, F.concat(F.lit("  About   \t"), F.col("c_name"))).alias("headline"),
        F.col("text").alias("message"),
        segment.alias("Tier"), F.col("r_name").alias("geo"),
        F.struct(F.col("n_name").alias("Category"), F.lit(True).alias("answerable")).alias("gold"),
        F.when(F.col("c_acctbal") < 0, F.lit("overdue")).alias("account_state"),
    )
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("position"),
        F.to_json(record).alias("record_text"),
        "conv_id", "turn",
    )


RECORDS_SQL = """turns AS (
  SELECT c.conv_id, c.turn, c.text, u.*, n_name, r_name, conv_id * 1000 + turn AS position,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Live Chat' WHEN 'MACHINERY' THEN 'chat-widget'
      WHEN 'AUTOMOBILE' THEN 'API_DOCUMENTATION' WHEN 'FURNITURE' THEN 'carrier-pigeon' END AS raw
  FROM conversations c LEFT JOIN customer u ON conv_id = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  WHERE role = 'user'
)"""


def drafted_tickets(spark, sf_dir) -> DataFrame:
    """Normalised tickets with the two model replies they would have received.

    The drafted reply is the next assistant turn with source markers after its lines (one
    in ten sources does not exist); the classifier's reply is JSON built from the customer.
    """
    tickets = normalise_tickets(ticket_records(spark, sf_dir))
    turns = table(spark, sf_dir, "conversations")
    replies = turns.filter("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("position"),
        F.array_join(
            F.transform(
                F.split("text", "\n"),
                lambda line, i: F.concat(line, F.lit(" [S"), (i + 1).cast("string"), F.lit("]")),
            ),
            "\n",
        ).alias("reply"),
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey"),
        F.when(
            F.col("c_acctbal") > 0,
            F.concat(
                F.lit("Sure! ```json\n"),
                F.to_json(
                    F.struct(
                        F.initcap(F.replace(taxonomy_at(F.col("c_nationkey")), F.lit("_"), F.lit(" "))).alias("intent"),
                        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("urgent")).otherwise(F.lit("P2")).alias("urgency"),
                        F.round(F.col("c_acctbal") / 100, 2).alias("confidence"),
                        F.array(F.struct(F.lit("onboarding").alias("intent"),
                                         F.round(F.col("c_acctbal") / 20000, 4).alias("confidence"))).alias("alternatives"),
                        F.lit("stated").alias("rationale"),
                    )
                ),
                F.lit("\n``` done"),
            ),
        ).alias("classifier_reply"),
    )
    return (
        tickets.join(replies, "position", "left")
        .withColumn("c_custkey", F.floor(F.col("position") / 1000))
        .join(customers, "c_custkey", "left")
        .drop("c_custkey")
    )
