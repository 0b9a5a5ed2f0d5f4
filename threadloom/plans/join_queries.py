"""Queries of joins, lookups, parsing and planning over the ledger and its claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import parsing as G
from threadloom.functions import text as T
from threadloom.operators import claims as C
from threadloom.operators import ledger as L
from threadloom.operators import search as S
from threadloom.plans.ledger_queries import LIVE_SQL, _NODES_SQL, _nodes
from threadloom.plans.registration import registered
from threadloom.plans.scalar_queries import _claim, _trim
from threadloom.sources.tables import table as t

QUERIES, SQL, query = registered()

_E = "e AS (SELECT event_id, max(content) AS content, max(occurred_at) AS occurred_at FROM ledger_events WHERE event_id IS NOT NULL GROUP BY event_id)"


def _events(spark, d):
    return t(spark, d, "ledger_events").where("event_id is not null").groupBy("event_id").agg(F.max("content").alias("content"), F.max("occurred_at").alias("occurred_at"))


@query(f"WITH {_E}, {_NODES_SQL} SELECT n.node_id, n.status, s.event_id, s.source_role, e.occurred_at FROM nodes n LEFT JOIN node_sources s ON s.node_id = n.node_id LEFT JOIN e ON e.event_id = s.event_id")
def node_provenance(spark, d):
    sources = t(spark, d, "node_sources").select("node_id", "event_id", "source_role")
    return _nodes(spark, d).select("node_id", "status").join(sources, "node_id", "left").join(_events(spark, d).select("event_id", "occurred_at"), "event_id", "left").select("node_id", "status", "event_id", "source_role", "occurred_at")


@query(f"WITH {_E}, {_NODES_SQL} SELECT n.node_id, s.event_id, s.start_rune, substr(e.content, s.start_rune + 1, s.end_rune - s.start_rune) AS cited FROM nodes n JOIN node_sources s ON s.node_id = n.node_id JOIN e ON e.event_id = s.event_id WHERE s.start_rune >= 0 AND s.end_rune > s.start_rune AND s.end_rune <= length(e.content)")
def cited_texts(spark, d):
    rows = _nodes(spark, d).select("node_id").join(t(spark, d, "node_sources"), "node_id").join(_events(spark, d), "event_id").where("start_rune >= 0 and end_rune > start_rune and end_rune <= length(content)")
    return rows.select("node_id", "event_id", "start_rune", F.substr("content", F.col("start_rune") + 1, F.col("end_rune") - F.col("start_rune")).alias("cited"))


@query(f"WITH {_NODES_SQL} SELECT node_id FROM nodes WHERE {_claim('subject_text')} IN ('user', 'graph builder') OR attribute_key IN ('timeout', 'lease') OR contains(lower(statement), 'heartbeat')")
def slot_search(spark, d):
    """Claims that a query meets by subject, attribute or text: three semi joins."""
    n = _nodes(spark, d)
    names = spark.createDataFrame([("user",), ("graph builder",)], "name string")
    keys = spark.createDataFrame([("timeout",), ("lease",)], "attribute_key string")
    by_name = n.withColumn("name", T.normalize_claim(F.col("subject_text"))).join(names, "name", "left_semi").select("node_id")
    by_key = n.join(keys, "attribute_key", "left_semi").select("node_id")
    return by_name.unionByName(by_key).unionByName(n.where(F.contains(F.lower("statement"), F.lit("heartbeat"))).select("node_id")).distinct()


@query("SELECT event_id, count(*) AS n FROM event_vectors v WHERE NOT EXISTS (SELECT 1 FROM ledger_events e WHERE e.event_id = v.event_id AND NOT coalesce(e.tombstoned, false) AND e.token_estimate > 20) GROUP BY event_id")
def orphan_vectors(spark, d):
    kept = t(spark, d, "ledger_events").where("not coalesce(tombstoned, false) and token_estimate > 20")
    return L.orphans(t(spark, d, "event_vectors").where("event_id is not null").select("event_id"), kept, "event_id").groupBy("event_id").agg(F.count("*").alias("n"))


@query("SELECT context_id, max(label) AS label FROM contexts WHERE contains(lower(label), 'queue') OR contains(lower(label), 'snapshot') GROUP BY context_id")
def context_search(spark, d):
    label = F.lower("label")
    return t(spark, d, "contexts").where(F.contains(label, F.lit("queue")) | F.contains(label, F.lit("snapshot"))).groupBy("context_id").agg(F.max("label").alias("label"))


_FINITE = "len(dense_fp16) = 128 AND NOT list_has_any(dense_fp16, ['nan'::FLOAT, 'inf'::FLOAT, '-inf'::FLOAT])"


def _vectors(spark, d):
    return t(spark, d, "event_vectors").where("event_id is not null and size(dense_fp16) = 128").where(~F.exists("dense_fp16", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))


@query(f"WITH v AS (SELECT DISTINCT event_id, dense_fp16::DOUBLE[] AS v FROM event_vectors WHERE {_FINITE}), p AS (SELECT event_id AS prototype, v AS p FROM v WHERE event_id IN (SELECT event_id FROM v ORDER BY event_id LIMIT 3)) SELECT event_id, round(max(list_inner_product(v, p) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(p, p)))), 4) AS best FROM v, p WHERE list_inner_product(v, v) > 0 AND list_inner_product(p, p) > 0 GROUP BY event_id")
def prototype_similarity(spark, d):
    """Events against three prototype vectors: the best cosine."""
    v = _vectors(spark, d).select("event_id", F.col("dense_fp16").alias("v")).distinct().where(S.dot(F.col("v"), F.col("v")) > 0)
    p = v.orderBy("event_id").limit(3).select(F.col("v").alias("p"))  # three rows
    return v.crossJoin(F.broadcast(p)).groupBy("event_id").agg(F.round(F.max(S.cosine(F.col("v"), F.col("p"))), 4).alias("best"))


@query(f"WITH v AS (SELECT context_id, unnest(dense_fp16::DOUBLE[]) AS x, generate_subscripts(dense_fp16, 1) AS i FROM event_vectors WHERE {_FINITE} AND context_id <> '' AND event_id IS NOT NULL), m AS (SELECT context_id, i, avg(x) AS x FROM v GROUP BY context_id, i), n AS (SELECT context_id, sqrt(sum(x * x)) AS n FROM m GROUP BY context_id) SELECT context_id, round(max(abs(x / n)), 4) AS largest, round(sum(x / n * (x / n)), 4) AS length FROM m JOIN n USING (context_id) WHERE n > 0 GROUP BY context_id")
def context_vectors(spark, d):
    """The mean vector of a context's events, brought to unit length: its length and its largest component."""
    one = _vectors(spark, d).where("context_id <> ''").select("context_id", F.posexplode("dense_fp16").alias("i", "x"))
    mean = one.groupBy("context_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = mean.groupBy("context_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("v"))  # 128 components
    unit = vector.where(S.dot(F.col("v"), F.col("v")) > 0).select("context_id", S.l2_normalized(F.col("v")).alias("u"))
    return unit.select("context_id", F.round(F.array_max(F.transform("u", F.abs)), 4).alias("largest"), F.round(S.dot(F.col("u"), F.col("u")), 4).alias("length"))


@query("SELECT d.doc_id, d.source, r.verdict, r.reviewer FROM (SELECT doc_id, source FROM documents) d JOIN (SELECT doc_id, max({'a': reviewed_at, 'b': coalesce(reviewer, ''), 'v': verdict}) AS m FROM doc_reviews WHERE reviewed_at IS NOT NULL GROUP BY doc_id) x USING (doc_id), LATERAL (SELECT x.m.v AS verdict, x.m.b AS reviewer) r")
def latest_resolutions(spark, d):
    last = t(spark, d, "doc_reviews").where("reviewed_at is not null").groupBy("doc_id").agg(F.max(F.struct("reviewed_at", F.coalesce("reviewer", F.lit("")).alias("reviewer"), "verdict")).alias("m"))
    return t(spark, d, "documents").select("doc_id", "source").join(last, "doc_id").select("doc_id", "source", "m.verdict", "m.reviewer")


@query(f"WITH {_E}, g AS (SELECT node_id, list(event_id ORDER BY start_rune, event_id) AS ids FROM node_sources WHERE event_id IS NOT NULL GROUP BY node_id), p AS (SELECT node_id, unnest(ids) AS event_id, generate_subscripts(ids, 1) - 1 AS place FROM g) SELECT p.node_id, p.place::INTEGER AS place, p.event_id, length(e.content)::INTEGER AS n FROM p JOIN e USING (event_id)")
def ordered_lookup(spark, d):
    """Ids in an array looked up, their order kept."""
    ids = t(spark, d, "node_sources").where("event_id is not null").groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_rune", "event_id"))), lambda r: r["event_id"]).alias("ids"))
    return ids.select("node_id", F.posexplode("ids").alias("place", "event_id")).join(_events(spark, d), "event_id").select("node_id", "place", "event_id", F.length("content").alias("n"))


@query("WITH hit AS (SELECT DISTINCT event_id FROM ledger_events WHERE contains(lower(content), 'cache')), own AS (SELECT node_id, bool_or(event_id IN (SELECT event_id FROM hit WHERE event_id IS NOT NULL)) AS shared FROM node_sources WHERE event_id IS NOT NULL GROUP BY node_id) SELECT event_id AS id, 'event' AS kind FROM hit WHERE event_id IS NOT NULL UNION ALL SELECT node_id, 'state' FROM own WHERE NOT shared")
def state_additions(spark, d):
    """Events found, and the claims of which no source is among them."""
    hit = t(spark, d, "ledger_events").where(F.contains(F.lower("content"), F.lit("cache")) & F.col("event_id").isNotNull()).select("event_id").distinct()
    sources = t(spark, d, "node_sources").where("event_id is not null").select("node_id", "event_id")
    shared = sources.join(hit, "event_id", "left_semi").select("node_id")
    rest = sources.select("node_id").distinct().join(shared, "node_id", "left_anti")
    return hit.select(F.col("event_id").alias("id"), F.lit("event").alias("kind")).unionByName(rest.select(F.col("node_id").alias("id"), F.lit("state").alias("kind")))


@query(f"WITH {LIVE_SQL}, w AS (SELECT event_id, context_id, (contains(lower(content), 'cache')::INTEGER * 2 + contains(lower(content), 'lease')::INTEGER) / 3.0 + contains(lower(content), 'test/compact_test.go')::INTEGER AS affinity FROM live WHERE context_id <> '' AND content IS NOT NULL) SELECT context_id, event_id, round(affinity, 6)::DOUBLE AS affinity FROM w WHERE affinity > 0 QUALIFY row_number() OVER (PARTITION BY context_id ORDER BY affinity DESC, event_id) <= 4")
def affine_events(spark, d):
    """The four events of a context nearest to a query: weighted terms, and one more for each literal."""
    has = lambda w: F.contains(F.lower("content"), F.lit(w)).cast("int")
    rows = L.live(t(spark, d, "ledger_events"), "context_id", "content").where("context_id <> '' and content is not null").select("context_id", "event_id", F.round((has("cache") * 2 + has("lease")) / 3.0 + has("test/compact_test.go"), 6).cast("double").alias("affinity")).where("affinity > 0")
    return S.ranked(rows, "context_id", 4, F.desc("affinity"), F.col("event_id"))


@query(f"WITH {LIVE_SQL}, c AS (SELECT session_id, event_id, token_estimate, occurred_at FROM live WHERE session_id <> '' AND token_estimate IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY token_estimate DESC, event_id) <= 2) SELECT session_id, event_id FROM c ORDER BY token_estimate DESC, event_id LIMIT 32")
def capped_plan(spark, d):
    """Two events of a session at most, 32 in all."""
    rows = L.live(t(spark, d, "ledger_events"), "session_id", "token_estimate").where("session_id <> '' and token_estimate is not null")
    return S.ranked(rows, "session_id", 2, F.desc("token_estimate"), F.col("event_id")).orderBy(F.desc("token_estimate"), "event_id").limit(32).select("session_id", "event_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY created_at DESC NULLS LAST, doc_id) AS n FROM documents WHERE source IS NOT NULL) WHERE n > 20")
def pruned_reports(spark, d):
    """All but the twenty newest of each source."""
    rows = t(spark, d, "documents").where("source is not null").select("source", "doc_id", "created_at")
    kept = S.ranked(rows, "source", 20, F.desc_nulls_last("created_at"), F.col("doc_id")).select("source", "doc_id")
    return rows.select("source", "doc_id").join(kept, ["source", "doc_id"], "left_anti")


@query(f"WITH {LIVE_SQL} SELECT sha256(content) AS key, count(*) AS uses FROM live WHERE content IS NOT NULL AND NOT EXISTS (SELECT 1 FROM event_vectors v WHERE v.content = live.content) GROUP BY content")
def vector_cache_misses(spark, d):
    """Contents that need a vector: each once, whatever their number, and none that has one."""
    need = L.live(t(spark, d, "ledger_events"), "content").where("content is not null").groupBy(F.sha2("content", 256).alias("key")).agg(F.count("*").alias("uses"))
    return need.join(t(spark, d, "event_vectors").where("content is not null").select(F.sha2("content", 256).alias("key")), "key", "left_anti")


@query("SELECT session_id, count(DISTINCT event_id) AS events, max(occurred_at) AS last_seen FROM ledger_events WHERE session_id <> '' AND occurred_at IS NOT NULL GROUP BY session_id")
def session_catalog(spark, d):
    return t(spark, d, "ledger_events").where("session_id <> '' and occurred_at is not null").groupBy("session_id").agg(F.countDistinct("event_id").alias("events"), F.max("occurred_at").alias("last_seen"))


@query("SELECT doc_id, i - 1 AS turn, created_at + to_seconds(i - 1) AS at, s[i] AS line FROM (SELECT doc_id, created_at, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL AND created_at IS NOT NULL), range(1, 3000) r(i) WHERE i <= len(s) AND s[i] <> ''".replace("i - 1 AS turn", "(i - 1)::INTEGER AS turn"))
def nested_turns(spark, d):
    """The lines of a document as turns, each a second after the one before."""
    rows = t(spark, d, "documents").where("text is not null and created_at is not null").select("doc_id", "created_at", F.posexplode(F.split("text", "\n")).alias("turn", "line")).where("line <> ''")
    return rows.select("doc_id", "turn", F.timestamp_micros(F.unix_micros("created_at") + F.col("turn") * 1_000_000).alias("at"), "line")


_HTML = "'<html><head><title> ' || source || ' </title><style>p {}</style></head><body><p>' || replace(replace(left(text, 200), '<', ''), '>', '') || '</p><script>x()</script><div>R&amp;D &lt;ok&gt;</div></body></html>'"


@query(rf"SELECT doc_id, source AS title, trim(regexp_replace(regexp_replace(replace(replace(replace(left(text, 200), '<', ''), '>', ''), '&nbsp;', ' ') || chr(10) || ' R&D <ok>', '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), ' ') AS body FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND trim(source) = source AND NOT contains(left(text, 200), '&') AND NOT starts_with(left(text, 200), chr(10))")
def html_texts(spark, d):
    """Title and readable text of pages made of documents."""
    docs = t(spark, d, "documents").where("text is not null and source is not null and trim(source) = source").where(~F.contains(F.left("text", F.lit(200)), F.lit("&")) & ~F.startswith(F.left("text", F.lit(200)), F.lit("\n")))
    body = F.translate(F.left("text", F.lit(200)), "<>", "")
    page = F.concat(F.lit("<html><head><title> "), "source", F.lit(" </title><style>p {}</style></head><body><p>"), body, F.lit("</p><script>x()</script><div>R&amp;D &lt;ok&gt;</div></body></html>"))
    return docs.select("doc_id", G.html_title(page).alias("title"), F.regexp_replace(G.html_text(page), r"\n$", "").alias("body"))


@query("SELECT doc_id, reviewer, verdict = 1 AS correct FROM doc_reviews WHERE verdict IS NOT NULL")
def judge_answers(spark, d):
    """Verdicts written as a judge does, in a fence with words around, and read again."""
    text = F.concat(F.lit('Sure:\n```json\n{"is_correct": '), F.when(F.col("verdict") == 1, "true").otherwise("false"), F.lit(', "why": "x"}\n``` done'))
    return t(spark, d, "doc_reviews").where("verdict is not null").select("doc_id", "reviewer", G.judged(text).alias("correct"))


@query("SELECT source, round(count_if(lang = 'en') / count(*), 4)::DOUBLE AS accuracy FROM documents WHERE source IS NOT NULL GROUP BY source")
def metric_lines(spark, d):
    """A rate written as a line of a report and read again."""
    rows = t(spark, d, "documents").where("source is not null").groupBy("source").agg(F.round(F.count_if(F.col("lang") == "en") / F.count("*"), 4).alias("r"))
    return rows.select("source", G.metric(F.concat(F.lit("cases 3\n Accuracy: "), F.format_string("%.4f", "r"), F.lit("\nend")), "accuracy").alias("accuracy"))


_CMD = r"SELECT DISTINCT unnest(regexp_extract_all(content, '`([a-z][^`\n]{1,60})`', 1)) AS command FROM ledger_events"


@query(rf"SELECT command, CASE WHEN regexp_matches(command, '(^|[\s|;&])(sudo|doas|mkfs\S*|dd)\b|\brm\s+-\w*[rf]|\$\(|>\s*/dev/|\bIFS=') THEN 'dangerous' WHEN len(list_filter(string_split_regex(command, '\|\|?|&&|;'), lambda p: NOT (string_split(trim(p), ' ')[1] IN {G.READS} OR array_to_string(string_split(trim(p), ' ')[:2], ' ') IN {G.READING}))) = 0 AND NOT contains(command, '>') THEN 'safe' ELSE 'needs permission' END AS risk FROM ({_CMD})")
def command_risks(spark, d):
    found = t(spark, d, "ledger_events").select(F.explode(F.regexp_extract_all("content", F.lit(r"`([a-z][^`\n]{1,60})`"), F.lit(1))).alias("command")).distinct()
    return found.select("command", G.command_risk(F.col("command")).alias("risk"))


@query(f"WITH {_E} SELECT s.node_id, s.event_id, s.start_rune, (position(q IN e.content) - 1)::INTEGER AS found FROM (SELECT x.*, substr(y.content, x.start_rune + 1, x.end_rune - x.start_rune) AS q FROM node_sources x JOIN e y ON y.event_id = x.event_id WHERE x.start_rune >= 0 AND x.end_rune > x.start_rune AND x.end_rune <= length(y.content)) s JOIN e ON e.event_id = s.event_id")
def grounded_quotes(spark, d):
    """Cited ranges found again in their events by their words."""
    rows = t(spark, d, "node_sources").join(_events(spark, d), "event_id").where("start_rune >= 0 and end_rune > start_rune and end_rune <= length(content)")
    quote = F.substr("content", F.col("start_rune") + 1, F.col("end_rune") - F.col("start_rune"))
    return rows.select("node_id", "event_id", "start_rune", G.quote_start(F.col("content"), quote).alias("found"))


@query(f"WITH {_NODES_SQL}, c AS (SELECT coalesce(space, '') || '/' || coalesce(attribute_key, '') AS slot, count(*) AS members, bool_or(contains(lower(statement), 'cache')) AS relevant FROM nodes WHERE status IN ('active', 'scoped', 'pending') AND NOT coalesce(tombstoned, false) GROUP BY 1 HAVING count(*) > 1) SELECT slot, members FROM c WHERE relevant")
def relevant_conflicts(spark, d):
    """Open conflicts of the slots that a result touches."""
    n = _nodes(spark, d).withColumn("slot_id", F.concat(F.coalesce("space", F.lit("")), F.lit("/"), F.coalesce("attribute_key", F.lit(""))))
    live = n.where(F.col("status").isin(*C.LIVE) & ~F.coalesce("tombstoned", F.lit(False)))
    touched = live.where(F.contains(F.lower("statement"), F.lit("cache"))).select("slot_id").distinct()
    return C.conflict_sets(n).join(touched, "slot_id", "left_semi").select(F.col("slot_id").alias("slot"), F.size("members").cast("bigint").alias("members"))


@query(f"WITH {_NODES_SQL} SELECT node_id, CASE WHEN statement IS NULL OR {_trim('statement')} = '' THEN 'no statement' WHEN facet IS NULL OR facet NOT IN ('profile', 'state', 'preference', 'constraint', 'configuration', 'location', 'relationship', 'goal', 'procedure-state') THEN 'bad facet' WHEN valid_until < valid_from THEN 'bad interval' WHEN NOT EXISTS (SELECT 1 FROM node_sources s WHERE s.node_id = nodes.node_id) THEN 'no source' ELSE 'valid' END AS outcome FROM nodes")
def draft_validation(spark, d):
    """Claims that may be committed, and why others are quarantined."""
    facets = ("profile", "state", "preference", "constraint", "configuration", "location", "relationship", "goal", "procedure-state")
    with_source = t(spark, d, "node_sources").select("node_id").distinct().withColumn("sourced", F.lit(True))
    why = F.when(F.coalesce(T.utrim(F.col("statement")), F.lit("")) == "", "no statement").when(~F.coalesce(F.col("facet").isin(*facets), F.lit(False)), "bad facet").when(F.coalesce(F.col("valid_until") < F.col("valid_from"), F.lit(False)), "bad interval").when(F.col("sourced").isNull(), "no source").otherwise("valid")
    return _nodes(spark, d).join(with_source, "node_id", "left").select("node_id", why.alias("outcome"))


@query(f"WITH {LIVE_SQL} SELECT event_id, 'fact' AS claim_type, left({_trim('content')}, 160) AS statement, 'observed' AS evidence_mode FROM live WHERE source_kind IN ('tool', 'command', 'file', 'observation') AND {_trim('content')} <> ''")
def deterministic_drafts(spark, d):
    """Claims that follow from tools' events without a model."""
    text = T.utrim(F.col("content"))
    rows = L.live(t(spark, d, "ledger_events"), "source_kind", "content").where(F.col("source_kind").isin("tool", "command", "file", "observation")).where(text != "")
    return rows.select("event_id", F.lit("fact").alias("claim_type"), F.left(text, F.lit(160)).alias("statement"), F.lit("observed").alias("evidence_mode"))


@query("SELECT event_id, round(sqrt(list_inner_product(v, v)), 4) AS before, CASE WHEN list_inner_product(v, v) = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS after FROM (SELECT DISTINCT event_id, dense_fp16::DOUBLE[] AS v FROM event_vectors WHERE " + _FINITE + " AND event_id IS NOT NULL)")
def normalized_vectors(spark, d):
    u = S.l2_normalized(F.col("v"))
    rows = _vectors(spark, d).select("event_id", F.col("dense_fp16").alias("v")).distinct()
    return rows.select("event_id", F.round(F.sqrt(S.dot(F.col("v"), F.col("v"))), 4).alias("before"), F.round(F.sqrt(S.dot(u, u)), 4).alias("after"))
