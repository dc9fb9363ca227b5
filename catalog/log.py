"""Decision log reads, reconciliation, operations and rate figures over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from deskloom.operators import decision_log as dl
from deskloom.operators import sequences as sq
from deskloom.session import shared_folder
from deskloom.sinks import artefacts as sk
from deskloom.sinks import reply_store as rs
from deskloom.settings import Settings

S = Settings()
RUN, TICKET, INTENT, SINCE = "2024-01-05", "7", "onboarding", "2024-01-10T00:00:00"


def decisions(spark, sf_dir):
    """events as the log: one run per day, plus the columns the log carries."""
    events = b.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("processed_at"),
        "ts",
    )
    flat = b.flat_outcomes(spark, sf_dir).select(
        F.col("ticket_ord").alias("id"), "ticket_id", "channel", "action",
        F.col("intent").alias("predicted_intent"), "confidence", "latency_seconds", "degraded",
        "error", "rule_fired",
    )
    return events.join(flat, "id")


def newest_rows(spark, sf_dir):
    return dl.rows_of_run(decisions(spark, sf_dir)).select("id", "run_id", "ticket_id", "action")


def rows_of_run(spark, sf_dir):
    return dl.rows_of_run(decisions(spark, sf_dir), RUN).select("id", "run_id", "ticket_id", "action")


def count_of_run(spark, sf_dir):
    return dl.count(decisions(spark, sf_dir), RUN)


def decisions_for_ticket(spark, sf_dir):
    return dl.decisions_for(decisions(spark, sf_dir), TICKET).select("id", "ticket_id", "action", "rule_fired")


def reconciliation(spark, sf_dir):
    """Runs against the number of distinct tickets that were due; repeats do not reconcile."""
    log = decisions(spark, sf_dir)
    due = log.groupBy("run_id").agg(F.countDistinct("ticket_id").alias("tickets_processed"))
    return dl.reconcile(log, due)


def actions_by_run(spark, sf_dir):
    return dl.by_action(decisions(spark, sf_dir))


def decisions_per_run(spark, sf_dir):
    return dl.per_run(decisions(spark, sf_dir))


def operations(spark, sf_dir):
    return dl.operations(decisions(spark, sf_dir))


def exposition(spark, sf_dir):
    return sk.exposition(operations(spark, sf_dir), S.brand)


def blast_radius(spark, sf_dir):
    return dl.blast_radius(decisions(spark, sf_dir), INTENT, SINCE).select(
        "id", "ticket_id", "predicted_intent", "processed_at"
    )


def last_state_of_users(spark, sf_dir):
    """Upsert semantics: the last write per key wins."""
    log = decisions(spark, sf_dir).select(F.col("ticket_id").alias("run_id"), "id", "action")
    return dl.last_runs(log, "id").select(F.col("run_id").alias("ticket_id"), "id", "action")


def tickets_not_done(spark, sf_dir):
    """Customers without a decision yet."""
    return dl.not_yet_done(
        b.customer_tickets(spark, sf_dir).select("ticket_id", "customer_tier"), decisions(spark, sf_dir)
    )


def _request_key(text):
    message = F.struct(text.alias("content"), F.lit("user").alias("role"))
    return sk.cache_key(F.lit("m"), F.lit(0.5), F.lit(512), F.lit(False), F.array(message))


def reply_store(spark, sf_dir):
    """Every user turn looked up in a store that was filled with all answered turns, some of them twice,
    and compacted in between."""
    turns = b.table(spark, sf_dir, "conversations")
    replies = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("content"))
    requests = turns.filter("role = 'user'").select("conv_id", "turn", _request_key(F.col("text")).alias("key"))
    answered = requests.join(replies, ["conv_id", "turn"]).groupBy("key").agg(F.min("content").alias("content"))
    path = shared_folder(spark, "reply-store")
    rs.append_replies(answered.filter("left(key, 1) < '8'"), path)
    rs.compact(spark, path)
    rs.append_replies(answered, path)
    rs.append_replies(answered.withColumn("content", F.lit("changed")), path)  # adds nothing
    return rs.with_stored_replies(requests, path).select("conv_id", "turn", "key", "content")


def reply_cache(spark, sf_dir):
    """Prompts looked up in a cache that holds the replies of answered conversations."""
    turns = b.table(spark, sf_dir, "conversations")
    key = _request_key(F.col("text"))
    answered = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    requests = turns.filter("role = 'user'").select("conv_id", "turn", key.alias("key"))
    cache = requests.join(answered, ["conv_id", "turn"], "left_semi").select(
        "key", F.lit("cached").alias("content")
    ).dropDuplicates(["key"])
    return sk.cache_stats(sk.with_cached_replies(requests, cache))


def request_rate(spark, sf_dir):
    """Requests of each kind in the trailing ten minutes."""
    events = b.table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return sq.trailing_counts(events, ["event_type"], "ts", 600).select("event_id", "in_window")


def paced_requests(spark, sf_dir):
    """Waiting time under a limit of two requests per minute and kind."""
    events = b.table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    paced = sq.paced_admissions(events, ["event_type"], "ts", "event_id", per_minute=2)
    return paced.select("event_id", F.round("wait_seconds", 6).alias("wait_seconds"))


def failure_runs(spark, sf_dir):
    """Consecutive failures per user, and where a breaker with threshold 3 would open."""
    events = b.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    runs = sq.failure_runs(events, ["user_id"], "ts", "event_id", F.col("event_type").isin("error", "view"))
    return runs.select(
        "event_id", "consecutive_failures", (F.col("consecutive_failures") == 3).alias("opens")
    )


QUERIES = {
    "log_" + f.__name__: f
    for f in (
        newest_rows, rows_of_run, count_of_run, decisions_for_ticket, reconciliation, actions_by_run,
        decisions_per_run, operations, exposition, blast_radius, last_state_of_users,
        tickets_not_done, reply_cache, reply_store, request_rate, paced_requests, failure_runs,
    )
}

_L = f"""WITH {b.OUTCOMES_SQL},
log AS (
  SELECT e.event_id AS id, strftime(e.ts, '%Y-%m-%d') AS run_id, strftime(e.ts, '%Y-%m-%dT%H:%M:%S.%f') AS processed_at,
    o.ticket_id, o.channel, o.action, o.intent AS predicted_intent, o.latency_seconds, o.degraded, o.error, o.rule_fired
  FROM events e JOIN outcomes o ON o.ticket_ord = e.event_id
)"""
_OPS = f"""{_L},
ops AS (
  SELECT count(*) AS total, count(*) FILTER (action = 'answer') AS answered, count(*) FILTER (action = 'escalate') AS escalated,
    count(*) FILTER (action = 'blocked') AS blocked, count(*) FILTER (degraded) AS degraded, count(error) AS errors,
    list_sort(list(latency_seconds))[(count(*) * 0.95)::DOUBLE::INT - CASE WHEN (count(*) * 0.95)::DOUBLE::INT > count(*) * 0.95 THEN 1 ELSE 0 END + 1] AS p95_seconds
  FROM log
)"""

SQL = {
    "log_newest_rows": f"{_L} SELECT id, run_id, ticket_id, action FROM log",
    "log_rows_of_run": f"{_L} SELECT id, run_id, ticket_id, action FROM log WHERE run_id = '{RUN}'",
    "log_count_of_run": f"{_L} SELECT count(*) AS n FROM log WHERE run_id = '{RUN}'",
    "log_decisions_for_ticket": f"""{_L}
SELECT id, ticket_id, action, rule_fired FROM log WHERE ticket_id = '{TICKET}'""",
    "log_reconciliation": f"""{_L} SELECT run_id, count(DISTINCT ticket_id) AS tickets_processed, count(*) AS decisions_logged,
  count(DISTINCT ticket_id) AS distinct_tickets_logged, count(*) = count(DISTINCT ticket_id) AS reconciles FROM log GROUP BY run_id""",
    "log_actions_by_run": f"{_L} SELECT run_id, action, count(*) AS n FROM log GROUP BY ALL",
    "log_decisions_per_run": f"{_L} SELECT run_id, count(*) AS decisions, count(DISTINCT ticket_id) AS tickets FROM log GROUP BY run_id",
    "log_operations": f"{_OPS} SELECT * FROM ops",
    "log_exposition": f"""{_OPS} SELECT array_to_string([
  '# HELP {S.brand}_tickets_total Tickets processed.', '# TYPE {S.brand}_tickets_total counter', '{S.brand}_tickets_total ' || total,
  '# HELP {S.brand}_tickets_by_action Tickets by routing action.', '# TYPE {S.brand}_tickets_by_action counter',
  '{S.brand}_tickets_by_action{{action="answer"}} ' || answered, '{S.brand}_tickets_by_action{{action="escalate"}} ' || escalated,
  '{S.brand}_tickets_by_action{{action="blocked"}} ' || blocked,
  '# HELP {S.brand}_degraded_total Tickets processed without the model provider.', '# TYPE {S.brand}_degraded_total counter',
  '{S.brand}_degraded_total ' || degraded, '# HELP {S.brand}_errors_total Tickets that hit a processing error.',
  '# TYPE {S.brand}_errors_total counter', '{S.brand}_errors_total ' || errors,
  '# HELP {S.brand}_latency_p95_seconds 95th percentile processing latency.', '# TYPE {S.brand}_latency_p95_seconds gauge',
  '{S.brand}_latency_p95_seconds ' || printf('%.4f', p95_seconds)], chr(10)) || chr(10) AS exposition FROM ops""",
    "log_blast_radius": f"""{_L} SELECT id, ticket_id, predicted_intent, processed_at FROM log
WHERE action = 'answer' AND predicted_intent = '{INTENT}' AND processed_at > '{SINCE}'""",
    "log_last_state_of_users": f"""{_L} SELECT ticket_id, max(id) AS id, max_by(action, id) AS action FROM log GROUP BY ticket_id""",
    "log_tickets_not_done": """SELECT c_custkey::VARCHAR AS ticket_id, c_mktsegment AS customer_tier FROM customer
WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
    "log_reply_cache": """WITH req AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
cached AS (SELECT DISTINCT r.text FROM req r JOIN conversations a ON a.role = 'assistant' AND a.conv_id = r.conv_id AND a.turn = r.turn + 1)
SELECT count(c.text) AS hits, count(*) - count(c.text) AS misses FROM req r LEFT JOIN cached c ON c.text = r.text""",
    "log_reply_store": """WITH req AS (
  SELECT conv_id, turn, sha256(to_json({'json_mode': false, 'max_tokens': 512, 'messages': [{'content': text, 'role': 'user'}],
    'model': 'm', 'temperature': 0.5::DOUBLE})::VARCHAR) AS key FROM conversations WHERE role = 'user'
),
stored AS (SELECT r.key, min(a.text) AS content FROM req r
  JOIN conversations a ON a.role = 'assistant' AND a.conv_id = r.conv_id AND a.turn = r.turn + 1 GROUP BY r.key)
SELECT conv_id, turn, key, content FROM req LEFT JOIN stored USING (key)""",
    "log_request_rate": """SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts
  RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events""",
    "log_paced_requests": """WITH seq AS (SELECT event_id, event_type, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events),
run AS (SELECT *, max(us - (i // 2) * 60000000) OVER (PARTITION BY event_type, i % 2 ORDER BY i) + (i // 2) * 60000000 AS entry FROM seq)
SELECT event_id, round((entry - us) / 1000000, 6) AS wait_seconds FROM run""",
    "log_failure_runs": """WITH seq AS (SELECT event_id, user_id, event_type NOT IN ('error', 'view') AS ok,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
run AS (SELECT event_id, i - coalesce(max(CASE WHEN ok THEN i END) OVER (PARTITION BY user_id ORDER BY i), 0) AS f FROM seq)
SELECT event_id, f AS consecutive_failures, f = 3 AS opens FROM run""",
}
