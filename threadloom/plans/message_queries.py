"""Queries of chat messages and of the job queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import ledger as L
from threadloom.operators import messages as M
from threadloom.plans.ledger_queries import LIVE_SQL
from threadloom.plans.registration import registered
from threadloom.plans.scalar_queries import _trim
from threadloom.sources.tables import table as t
from threadloom.streaming import outbox as O

QUERIES, SQL, query = registered()

_M = LIVE_SQL + f", m AS (SELECT session_id, event_id, occurred_at, lower({_trim('actor')}) AS role, CASE WHEN source_kind IN ('tool', 'command') THEN 'tool_result' ELSE 'text' END AS kind, source_ref AS tool_id, metadata['lane'] AS lane, metadata['turn_tag'] AS tag, content AS text, semantic_status FROM live WHERE session_id <> '' AND occurred_at IS NOT NULL AND content IS NOT NULL)"
_IN = "(PARTITION BY session_id ORDER BY occurred_at, event_id)"


def _live(spark, d):
    rows = t(spark, d, "ledger_events").withColumn("lane", F.col("metadata")["lane"]).withColumn("tag", F.col("metadata")["turn_tag"])
    return L.live(rows, "session_id", "occurred_at", "actor", "source_kind", "source_ref", "lane", "tag", "content", "semantic_status")


def _messages(spark, d):
    return M.messages(_live(spark, d))


@query(f"WITH {_M} SELECT session_id, event_id FROM m WHERE coalesce(lane, '') <> 'embed'")
def lasting_messages(spark, d):
    return _messages(spark, d).where(~M.transient(F.col("lane"))).select("session_id", "event_id")


@query(f"WITH {_M} SELECT session_id, event_id FROM m WHERE role IN ('user', 'human') AND kind <> 'tool_result'")
def real_requests(spark, d):
    return _messages(spark, d).where(M.real_request(F.col("role"), F.col("kind"))).select("session_id", "event_id")


@query("WITH a AS (SELECT source_ref AS tool_id, count(*) AS uses FROM ledger_events WHERE source_kind = 'command' AND source_ref IS NOT NULL GROUP BY 1), b AS (SELECT source_ref AS tool_id, count(*) AS results FROM ledger_events WHERE source_kind IN ('tool', 'observation') AND source_ref IS NOT NULL GROUP BY 1) SELECT tool_id, coalesce(uses, 0) AS uses, coalesce(results, 0) AS results, CASE WHEN uses IS NULL THEN 'orphan result' WHEN results IS NULL THEN 'unanswered' ELSE 'paired' END AS state FROM a FULL JOIN b USING (tool_id)")
def tool_pairs(spark, d):
    rows = t(spark, d, "ledger_events").withColumnRenamed("source_ref", "tool_id")
    return M.paired(rows.where("source_kind = 'command'"), rows.where("source_kind in ('tool', 'observation')"))


@query(f"WITH {_M}, f AS (SELECT *, coalesce(role <> lag(role) OVER {_IN}, true) OR lag(role) OVER {_IN} IS NULL AS new FROM m), g AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY session_id ORDER BY occurred_at, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS exchange FROM f) SELECT session_id, exchange, count(*) AS n, string_agg(text, chr(10) ORDER BY occurred_at, event_id) AS text FROM g GROUP BY session_id, exchange")
def merged_messages(spark, d):
    return M.merged(_messages(spark, d).select("session_id", "event_id", "occurred_at", "role", "text"))


@query(f"WITH {_M}, p AS (SELECT *, row_number() OVER {_IN} AS place, row_number() OVER {_IN} - row_number() OVER (PARTITION BY session_id, semantic_status = 'indexed' ORDER BY occurred_at, event_id) AS run FROM m WHERE semantic_status IS NOT NULL), r AS (SELECT session_id, run, min(place) AS from_place, count(*) AS n FROM p WHERE semantic_status <> 'indexed' GROUP BY session_id, run HAVING count(*) >= 3) SELECT session_id, from_place, n FROM r QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY from_place) = 1")
def uncollapsed_spans(spark, d):
    rows = _live(spark, d).where("session_id <> '' and occurred_at is not null and content is not null and semantic_status is not null").select("session_id", "event_id", "occurred_at", (F.col("semantic_status") == "indexed").alias("covered"))
    return M.first_open_span(rows, "covered")


@query(f"WITH {_M}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at DESC, event_id DESC) AS back, kind = 'tool_result' AND row_number() OVER (PARTITION BY session_id, kind ORDER BY occurred_at DESC, event_id DESC) > 1 AS old FROM m), c AS (SELECT session_id, sum(length(text) // 4) AS a, sum(CASE WHEN old THEN 2 ELSE length(text) // 4 END) AS b FROM n GROUP BY session_id) SELECT session_id, event_id, CASE WHEN a <= 400 THEN 0 WHEN b <= 400 THEN 2 ELSE 3 END AS level FROM n JOIN c USING (session_id) WHERE a <= 400 OR b <= 400 OR back <= 10")
def compaction_levels(spark, d):
    """Levels of messages within 400 tokens a session (levels 1 and 2 count as one here, as the texts hold no installers' noise)."""
    rows = M.compacted(_messages(spark, d), 400)
    return rows.select("session_id", "event_id", F.when(F.col("level") == 1, 2).otherwise(F.col("level")).alias("level"))


@query(f"WITH {_M}, a AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at DESC, event_id DESC) AS n FROM m WHERE role IN ('user', 'human') AND kind <> 'tool_result'), b AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at DESC, event_id DESC) AS n FROM m) SELECT session_id, event_id FROM a WHERE n <= 12 UNION SELECT session_id, event_id FROM b WHERE n <= 4")
def replacement_history(spark, d):
    return M.handed_over(_messages(spark, d))


@query(f"WITH {_M}, c AS (SELECT session_id, min(occurred_at) AS at FROM m GROUP BY session_id) SELECT session_id, event_id FROM (SELECT m.session_id, m.event_id, row_number() OVER (PARTITION BY m.session_id ORDER BY m.occurred_at, m.event_id) AS n FROM m JOIN c USING (session_id) WHERE m.occurred_at > c.at) WHERE n <= 32")
def cursor_ingest(spark, d):
    """The next 32 messages after each session's first."""
    rows = _messages(spark, d)
    return M.after_cursor(rows, rows.groupBy("session_id").agg(F.min("occurred_at").alias("at")))


@query(f"WITH {_M} SELECT session_id, sum(length(text)) FILTER (WHERE kind = 'tool_result')::BIGINT AS chars, count(*) FILTER (WHERE kind = 'tool_result') AS results FROM m GROUP BY session_id")
def result_char_totals(spark, d):
    tool = F.col("kind") == "tool_result"
    return _messages(spark, d).groupBy("session_id").agg(F.sum(F.when(tool, F.length("text"))).alias("chars"), F.count_if(tool).alias("results"))


@query("SELECT event_id, CASE WHEN semantic_status = 'active' THEN 'pending' ELSE semantic_status END AS state, (token_estimate % 4)::INTEGER AS attempts, CASE WHEN semantic_status = 'active' AND token_estimate % 4 >= 2 THEN 'failed' WHEN semantic_status = 'active' THEN 'pending' ELSE semantic_status END AS next_state FROM ledger_events WHERE token_estimate IS NOT NULL AND semantic_status IS NOT NULL")
def job_retries(spark, d):
    """Jobs that were running when the worker stopped are pending again; one with two attempts has failed."""
    rows = t(spark, d, "ledger_events").where("token_estimate is not null and semantic_status is not null")
    state, tries = F.when(F.col("semantic_status") == "active", "running").otherwise(F.col("semantic_status")), (F.col("token_estimate") % 4).cast("int")
    return rows.select("event_id", O.recovered(state).alias("state"), tries.alias("attempts"), F.when(state == "running", O.after_failure(tries, F.lit(False))).otherwise(state).alias("next_state"))


@query("SELECT context_id, any_value(ledger_seq) AS ledger_seq, max(closed_at) AS closed_at FROM (SELECT context_id, max(ledger_seq) OVER (PARTITION BY context_id) AS ledger_seq, closed_at FROM contexts WHERE context_id <> '') WHERE closed_at IS NOT NULL GROUP BY context_id")
def sealed_contexts(spark, d):
    rows = t(spark, d, "contexts").where("context_id <> ''").groupBy("context_id").agg(F.max("ledger_seq").alias("ledger_seq"), F.max("closed_at").alias("closed_at"))
    return rows.where("closed_at is not null")


@query("SELECT event_id, 'index' AS origin FROM (SELECT DISTINCT event_id FROM event_vectors) UNION ALL SELECT event_id, 'overlay' FROM (SELECT event_id FROM (SELECT event_id, max(created_at) AS seen FROM ledger_events WHERE event_id IS NOT NULL AND event_id NOT IN (SELECT event_id FROM event_vectors) GROUP BY event_id) ORDER BY seen DESC, event_id LIMIT 32)")
def overlaid_index(spark, d):
    """The index and the 32 latest events that it has not yet."""
    return O.overlay(t(spark, d, "event_vectors"), t(spark, d, "ledger_events"))
