"""Queries of the ledger, retrieval, claims, windows and evaluation operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.text import token_estimate
from threadloom.operators import search
from threadloom.sources.tables import table as t

TERMS = ["snapshot", "lease", "heartbeat"]
_TERMS_SQL = ", ".join(f"'{x}'" for x in TERMS)
_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{Nd}}_]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM s), e AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM s),
h AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM e WHERE term IN ({_TERMS_SQL}) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM h JOIN d USING (term), st GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50""")
def bm25_topk(spark, d):
    return search.bm25(t(spark, d, "documents"), TERMS)


@query("SELECT event_id, session_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY created_at DESC, coalesce(session_id, '') DESC) AS n FROM ledger_events WHERE event_id IS NOT NULL) WHERE n = 1 AND NOT coalesce(tombstoned, false)")
def ledger_latest(spark, d):
    rows = t(spark, d, "ledger_events").where("event_id is not null").select("event_id", "session_id", "created_at", "tombstoned")
    return search.latest(rows, "event_id", F.desc("created_at"), F.desc(F.coalesce("session_id", F.lit("")))).where(~F.coalesce("tombstoned", F.lit(False))).drop("tombstoned")


@query("SELECT source_kind, count(*) AS n, count(DISTINCT event_id) AS events, count_if(coalesce(tombstoned, false)) AS tombstones FROM ledger_events GROUP BY source_kind")
def ledger_kinds(spark, d):
    return t(spark, d, "ledger_events").groupBy("source_kind").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"), F.count_if(F.coalesce("tombstoned", F.lit(False))).alias("tombstones"))


@query("SELECT event_id, ceil(length(" + _TRIM.format("content") + ") / 3.0)::INTEGER AS tokens FROM ledger_events WHERE content IS NOT NULL")
def token_estimates(spark, d):
    return t(spark, d, "ledger_events").where("content is not null").select("event_id", token_estimate(F.col("content")).alias("tokens"))


@query("SELECT context_id, sum(token_estimate)::BIGINT AS tokens FROM ledger_events WHERE NOT coalesce(tombstoned, false) GROUP BY context_id HAVING sum(token_estimate) >= 2000")
def context_token_totals(spark, d):
    return t(spark, d, "ledger_events").where(~F.coalesce("tombstoned", F.lit(False))).groupBy("context_id").agg(F.sum("token_estimate").alias("tokens")).where("tokens >= 2000")


@query("SELECT n.node_id, s.event_id FROM memory_nodes n JOIN node_sources s USING (node_id) WHERE NOT EXISTS (SELECT 1 FROM ledger_events e WHERE e.event_id = s.event_id)")
def orphan_sources(spark, d):
    ids = t(spark, d, "ledger_events").select("event_id")
    return t(spark, d, "memory_nodes").select("node_id").join(t(spark, d, "node_sources").select("node_id", "event_id"), "node_id").join(ids, "event_id", "left_anti").select("node_id", "event_id")


@query("SELECT node_id, slot_id FROM memory_nodes WHERE status IN ('active', 'scoped', 'superseded') AND NOT coalesce(tombstoned, false) AND (valid_from IS NULL OR valid_from <= TIMESTAMPTZ '2022-01-08 00:00:00+00') AND (valid_until IS NULL OR valid_until >= TIMESTAMPTZ '2022-01-08 00:00:00+00')")
def current_state(spark, d):
    at = F.to_timestamp(F.lit("2022-01-08 00:00:00"))
    return t(spark, d, "memory_nodes").where(F.col("status").isin("active", "scoped", "superseded") & ~F.coalesce("tombstoned", F.lit(False)) & (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (F.col("valid_until") >= at))).select("node_id", "slot_id")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_summary(spark, d):
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    return t(spark, d, "events").groupBy("event_type").agg(p.alias("p")).select("event_type", *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p90", "p95"))))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))")
def grouping_sets(spark, d):
    t(spark, d, "orders").createOrReplaceTempView("tl_orders")
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM tl_orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))")


@query("SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda x: (x[1] * x[2])::DOUBLE)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 128")
def dense_topk(spark, d):
    e = t(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return e.join(F.broadcast(q)).select("vec_id", F.round(dot, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(128)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS r FROM events) WHERE r <= 2")
def cap_per_key(spark, d):
    w = W.partitionBy("user_id").orderBy(F.desc("value"), "ts", "event_id")
    return t(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("r")).where("r <= 2").drop("r")


@query("SELECT 'id_' || substr(sha256('id' || chr(0) || coalesce(event_type, '') || chr(0) || user_id), 1, 32) AS id, count(*) AS n FROM events GROUP BY 1")
def stable_ids(spark, d):
    z = F.concat(F.lit("id"), F.lit("\0"), F.coalesce("event_type", F.lit("")), F.lit("\0"), F.col("user_id").cast("string"))
    return t(spark, d, "events").groupBy(F.concat(F.lit("id_"), F.substring(F.sha2(z, 256), 1, 32)).alias("id")).agg(F.count("*").alias("n"))


@query("SELECT slot_id, count(*) AS n FROM memory_nodes WHERE status = 'active' AND slot_id IS NOT NULL GROUP BY slot_id HAVING count(*) > 1")
def slot_conflicts(spark, d):
    return t(spark, d, "memory_nodes").where("status = 'active' and slot_id is not null").groupBy("slot_id").agg(F.count("*").alias("n")).where("n > 1")


@query("WITH r AS (SELECT 'v' AS channel, user_id AS id, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 384) UNION ALL SELECT 't', user_id, row_number() OVER (ORDER BY ts DESC, event_id) FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 384)), b AS (SELECT channel, id, min(rank) AS rank FROM r GROUP BY ALL) SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM b GROUP BY id")
def rank_fusion(spark, d):
    e = t(spark, d, "events")
    one = lambda name, key: e.orderBy(F.desc(key), "event_id").limit(384).select(F.lit(name).alias("channel"), F.col("user_id").alias("id"), F.row_number().over(W.orderBy(F.desc(key), "event_id")).alias("rank"))
    return search.rrf(one("v", "value").unionByName(one("t", "ts")))
