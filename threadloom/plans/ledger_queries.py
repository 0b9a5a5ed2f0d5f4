"""Queries of the ledger and of versioned claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.hashing import event_checksum
from threadloom.functions.text import normalize_claim, utrim
from threadloom.operators import claims as C
from threadloom.operators import ledger as L
from threadloom.plans.registration import registered
from threadloom.plans.scalar_queries import _META, _SPACE, _WS, _claim, _instant, _joined, _trim
from threadloom.sources.tables import table as t

QUERIES, SQL, query = registered()

LIVE_SQL = "live AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY created_at DESC, coalesce(session_id, '') DESC, coalesce(content, '') DESC, coalesce(tombstoned, false) DESC, context_id DESC NULLS LAST) AS rn FROM ledger_events WHERE event_id IS NOT NULL) WHERE rn = 1 AND NOT coalesce(tombstoned, false))"
_CHECK = f"sha256({_joined('chr(0)', _SPACE, 'context_id', 'session_id', 'actor', 'source_kind', 'source_ref', _instant('occurred_at'), 'content', _META)})"
_NODES_SQL = "nodes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY created_at DESC, space DESC, context_id DESC, node_kind DESC) AS rn FROM memory_nodes WHERE node_id IS NOT NULL) WHERE rn = 1)"


def _nodes(spark, d):
    return C.latest_nodes(t(spark, d, "memory_nodes"))


@query(f"WITH {LIVE_SQL} SELECT event_id, context_id, occurred_at FROM live WHERE event_id IN (SELECT event_id FROM node_sources)")
def events_by_ids(spark, d):
    ids = t(spark, d, "node_sources").select("event_id").distinct()
    return L.live(t(spark, d, "ledger_events"), "context_id", "occurred_at").join(ids, "event_id", "left_semi").select("event_id", "context_id", "occurred_at")


@query(f"WITH {LIVE_SQL} SELECT context_id, event_id FROM live WHERE semantic_status = 'pending' AND context_id <> ''")
def pending_context_events(spark, d):
    return L.live(t(spark, d, "ledger_events"), "context_id", "semantic_status").where("semantic_status = 'pending' and context_id <> ''").select("context_id", "event_id")


@query(f"WITH {LIVE_SQL}, x AS (SELECT substr(sha256(event_id), 1, 3) AS bucket, event_id || chr(0) || coalesce(content, '') || chr(0) AS x FROM live), p AS (SELECT bucket, count(*) AS n, sha256(array_to_string(list_sort(list(x)), '')) AS h FROM x GROUP BY bucket) SELECT sum(n)::BIGINT AS n, sha256(array_to_string(list(h ORDER BY bucket), '')) AS digest FROM p")
def ledger_digest(spark, d):
    return L.digest(L.live(t(spark, d, "ledger_events"), "content"), "event_id", "content")


@query(f"WITH c AS (SELECT *, {_CHECK} AS checksum FROM ledger_events), old AS (SELECT DISTINCT space, checksum FROM c WHERE created_at < TIMESTAMPTZ '2022-06-01 00:00:00+00') SELECT min(event_id) AS event_id, space, checksum FROM c WHERE created_at >= TIMESTAMPTZ '2022-06-01 00:00:00+00' AND NOT EXISTS (SELECT 1 FROM old WHERE old.checksum = c.checksum AND old.space IS NOT DISTINCT FROM c.space) GROUP BY space, checksum".replace("2022-06-01", "2022-01-05"))
def appended_events(spark, d):
    """Arrivals from a day on against the ledger before it."""
    rows, day = t(spark, d, "ledger_events"), F.expr("timestamp '2022-01-05 00:00:00'")
    return L.appended(rows.where(F.col("created_at") < day), rows.where(F.col("created_at") >= day))


_LAST = "(max({{'s': ledger_seq, 'v': {0}}}) FILTER (WHERE {0} IS NOT NULL AND {0}::VARCHAR <> '')).v AS {0}"


@query(f"SELECT lower({_trim('context_id')}) AS context_id, " + ", ".join(_LAST.format(c) for c in ("space", "parent_id", "context_type", "label", "opened_at", "closed_at")) + f" FROM contexts WHERE {_trim('context_id')} <> '' GROUP BY lower({_trim('context_id')})")
def upserted_contexts(spark, d):
    return L.upserted_contexts(t(spark, d, "contexts"))


@query("WITH c AS (SELECT resource_kind, source, max(created_at) AS created_at FROM documents WHERE created_at IS NOT NULL AND lang = 'en' GROUP BY ALL), b AS (SELECT resource_kind, source, max(created_at) AS created_at FROM documents WHERE created_at IS NOT NULL AND coalesce(lang, '') <> 'en' GROUP BY ALL), k AS (SELECT source, max({'t': created_at, 'r': resource_kind}) AS n FROM c GROUP BY source), o AS (SELECT source, max({'t': created_at, 'r': resource_kind}) AS n FROM b GROUP BY source) SELECT source, coalesce(k.n.t, o.n.t) AS created_at, CASE WHEN k.n IS NOT NULL THEN k.n.r ELSE o.n.r END AS resource_kind FROM k FULL JOIN o USING (source) WHERE source IS NOT NULL")
def upserted_documents(spark, d):
    rows = t(spark, d, "documents").where("created_at is not null and source is not null").select("source", "created_at", "resource_kind", "lang")
    return L.upserted(rows.where("coalesce(lang, '') <> 'en'").drop("lang"), rows.where("lang = 'en'").drop("lang"), "source", "created_at")


@query("SELECT v.event_id, count(*) AS n FROM event_vectors v WHERE v.event_id NOT IN (SELECT event_id FROM ledger_events WHERE coalesce(tombstoned, false) AND event_id IS NOT NULL) GROUP BY v.event_id")
def cascading_deletes(spark, d):
    """The index without what the ledger has tombstoned."""
    gone = t(spark, d, "ledger_events").where("coalesce(tombstoned, false) and event_id is not null").select(F.col("event_id").alias("id"))
    return C.purged(t(spark, d, "event_vectors").where("event_id is not null").select("event_id"), gone, "event_id").groupBy("event_id").agg(F.count("*").alias("n"))


@query(f"WITH {LIVE_SQL}, e AS (SELECT event_id, sha256(coalesce(content, '')) AS checksum FROM live), i AS (SELECT DISTINCT event_id, sha256(coalesce(content, '')) AS checksum FROM event_vectors) SELECT e.event_id, e.checksum FROM e WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.event_id = e.event_id AND i.checksum = e.checksum)")
def changed_events(spark, d):
    hashed = F.sha2(F.coalesce("content", F.lit("")), 256).alias("checksum")
    return L.changed(t(spark, d, "event_vectors").select("event_id", hashed).distinct(), L.live(t(spark, d, "ledger_events"), "content").select("event_id", hashed))


@query("SELECT event_id, count(*) AS copies FROM event_vectors v WHERE event_id NOT IN (SELECT event_id FROM node_sources WHERE event_id IS NOT NULL) GROUP BY event_id")
def stale_index_rows(spark, d):
    return L.stale(t(spark, d, "event_vectors").where("event_id is not null").select("event_id"), t(spark, d, "node_sources"), "event_id").groupBy("event_id").agg(F.count("*").alias("copies"))


@query(f"WITH {LIVE_SQL}, e AS (SELECT event_id, sha256(coalesce(content, '')) AS c FROM live), i AS (SELECT event_id, min(sha256(coalesce(content, ''))) AS i FROM event_vectors GROUP BY event_id) SELECT count(i) AS indexed, count(c) AS expected, count_if(i IS NULL) AS missing, count_if(c IS NULL OR i <> c) AS stale, count_if(i IS NULL) = 0 AND count_if(c IS NULL OR i <> c) = 0 AS ready FROM e FULL JOIN i USING (event_id)")
def index_readiness(spark, d):
    hashed = F.sha2(F.coalesce("content", F.lit("")), 256)
    index = t(spark, d, "event_vectors").groupBy("event_id").agg(F.min(hashed).alias("checksum"))
    return L.readiness(index, L.live(t(spark, d, "ledger_events"), "content").select("event_id", hashed.alias("checksum")))


@query("SELECT event_id, CASE WHEN semantic_status IN ('pending', 'raw_only') THEN 'indexed' ELSE semantic_status END AS semantic_status FROM ledger_events WHERE event_id IS NOT NULL")
def status_transitions(spark, d):
    return L.advanced(t(spark, d, "ledger_events").where("event_id is not null"), ("pending", "raw_only"), "indexed")


@query("""SELECT 'events' AS check_name, count(DISTINCT event_id) AS n FROM ledger_events UNION ALL SELECT 'tombstoned_events', count(DISTINCT coalesce(event_id, chr(1))) FROM ledger_events WHERE tombstoned UNION ALL SELECT 'pending_events', count(DISTINCT coalesce(event_id, chr(1))) FROM ledger_events WHERE semantic_status = 'pending'
UNION ALL SELECT 'pending_nodes', count(DISTINCT node_id) FROM memory_nodes WHERE status = 'pending' UNION ALL SELECT 'quarantined_nodes', count(DISTINCT node_id) FROM memory_nodes WHERE status = 'quarantined' UNION ALL SELECT 'orphan_sources', count(*) FROM node_sources s WHERE NOT EXISTS (SELECT 1 FROM ledger_events e WHERE e.event_id = s.event_id)
UNION ALL SELECT 'orphan_vectors', count(*) FROM event_vectors s WHERE NOT EXISTS (SELECT 1 FROM ledger_events e WHERE e.event_id = s.event_id) UNION ALL SELECT 'events_without_vector', count(DISTINCT event_id) FROM ledger_events s WHERE event_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM event_vectors e WHERE e.event_id = s.event_id)""")
def health_report(spark, d):
    return L.health(t(spark, d, "ledger_events"), t(spark, d, "memory_nodes"), t(spark, d, "node_sources"), t(spark, d, "event_vectors"))


_AUTH_SQL = """seen AS (SELECT event_id, bool_or(coalesce(lower({a}) = 'user', false)) AS u, bool_or(coalesce(lower({a}) = 'tool', false)) AS tool, bool_or(coalesce(lower({k}) IN ('tool', 'observation'), false)) AS o, bool_or(coalesce(lower({k}) = 'document', false)) AS doc FROM ledger_events WHERE event_id IS NOT NULL GROUP BY event_id),
authority AS (SELECT n.node_id, max(CASE WHEN facet IN ('preference', 'constraint') THEN CASE WHEN u THEN 100 ELSE 0 END WHEN facet IN ('state', 'configuration', 'procedure-state') THEN CASE WHEN tool OR o THEN 100 WHEN u THEN 70 ELSE 0 END ELSE CASE WHEN doc OR o THEN 90 WHEN u THEN 80 ELSE 0 END END)
 + CASE max(evidence_mode) WHEN 'observed' THEN 10 WHEN 'user_declared' THEN 5 WHEN 'inferred' THEN -20 ELSE 0 END AS authority FROM nodes n LEFT JOIN node_sources s ON s.node_id = n.node_id LEFT JOIN seen e ON e.event_id = s.event_id GROUP BY n.node_id)""".format(a=_trim("actor"), k=_trim("source_kind"))


def _authority(spark, d):
    return C.authorities(_nodes(spark, d), t(spark, d, "node_sources"), t(spark, d, "ledger_events"))


@query(f"WITH {_NODES_SQL}, {_AUTH_SQL} SELECT node_id, authority FROM authority")
def source_authorities(spark, d):
    return _authority(spark, d)


# claims of one subject and attribute are taken as one slot, as the given slots have few versions
_SLOTS_SQL = "slotted AS (SELECT * REPLACE (coalesce(space, '') || '/' || coalesce(attribute_key, '') AS slot_id) FROM nodes)"


def _slotted(spark, d):
    return _nodes(spark, d).withColumn("slot_id", F.concat(F.coalesce("space", F.lit("")), F.lit("/"), F.coalesce("attribute_key", F.lit(""))))


_DECISIONS_SQL = f"""WITH {_NODES_SQL}, {_AUTH_SQL}, {_SLOTS_SQL}, r AS (SELECT s.*, a.authority, {_claim('statement')} AS v, coalesce(valid_from, created_at) AS b FROM slotted s JOIN authority a USING (node_id) WHERE status IN ('active', 'scoped', 'pending') AND NOT coalesce(tombstoned, false)),
p AS (SELECT n.node_id, n.v = o.v AS same, coalesce(n.valid_until >= o.valid_from, true) AND coalesce(o.valid_until >= n.valid_from, true) AS touch, coalesce(((n.facet IN ('preference', 'constraint') AND n.evidence_mode = 'user_declared') OR (n.facet IN ('state', 'configuration', 'procedure-state') AND n.evidence_mode = 'observed')) AND n.authority >= o.authority AND n.b > o.b, false) AS wins
 FROM r n JOIN r o ON n.slot_id = o.slot_id AND (o.created_at < n.created_at OR (o.created_at = n.created_at AND o.node_id < n.node_id))),
g AS (SELECT node_id, bool_or(coalesce(same, false)) AS same, bool_or(touch) AS touch, bool_and(CASE WHEN touch THEN wins ELSE true END) AS wins FROM p GROUP BY node_id)
SELECT r.node_id, CASE WHEN g.same IS NULL THEN 'coexists' WHEN same THEN 'duplicate' WHEN NOT touch THEN 'scoped' WHEN wins THEN 'supersedes' ELSE 'uncertain' END AS decision FROM r LEFT JOIN g USING (node_id)"""


@query(_DECISIONS_SQL)
def slot_decisions(spark, d):
    return C.slot_decisions(_slotted(spark, d), _authority(spark, d))


@query(f"SELECT node_id, CASE decision WHEN 'duplicate' THEN 'rejected' WHEN 'uncertain' THEN 'pending' ELSE 'active' END AS status FROM ({_DECISIONS_SQL})")
def claim_statuses(spark, d):
    return C.slot_decisions(_slotted(spark, d), _authority(spark, d)).select("node_id", C.resulting_status(F.col("decision")).alias("status"))


_CONFLICTS_SQL = f"""WITH {_NODES_SQL}, {_AUTH_SQL}, {_SLOTS_SQL}, m AS (SELECT space, slot_id, list_sort(list(node_id || chr(31) || coalesce({_claim('statement')}, ''))) AS parts, list_sort(list(node_id)) AS m, bool_or(coalesce(facet IN ('preference', 'constraint', 'state', 'configuration', 'procedure-state'), false)) AS critical FROM slotted WHERE status IN ('active', 'scoped', 'pending') AND NOT coalesce(tombstoned, false) AND slot_id <> '' GROUP BY space, slot_id HAVING count(*) > 1),
conflicts AS (SELECT *, sha256(slot_id || chr(0) || array_to_string(parts, chr(30))) AS generation FROM m), c AS (SELECT *, 'conf_' || substr(sha256('conf' || chr(0) || slot_id || chr(0) || generation), 1, 32) AS conflict_id FROM conflicts)"""


@query(_CONFLICTS_SQL + " SELECT conflict_id, space, slot_id, generation, array_to_string(m, ',') AS members, critical FROM c")
def conflict_sets(spark, d):
    return C.conflict_sets(_slotted(spark, d)).select("conflict_id", "space", "slot_id", "generation", F.array_join("members", ",").alias("members"), "critical")


_RESOLVED_SQL = _CONFLICTS_SQL + ", x AS (SELECT conflict_id, unnest(m) AS node_id FROM c), y AS (SELECT x.conflict_id, x.node_id, row_number() OVER (PARTITION BY x.conflict_id ORDER BY a.authority DESC, coalesce(n.valid_from, n.created_at) DESC NULLS LAST, x.node_id) AS rn FROM x JOIN nodes n USING (node_id) JOIN authority a USING (node_id))"


@query(_RESOLVED_SQL + " SELECT conflict_id, max(node_id) FILTER (WHERE rn = 1) AS winner, array_to_string(list_sort(list(node_id) FILTER (WHERE rn > 1)), ',') AS losers FROM y GROUP BY conflict_id")
def local_resolutions(spark, d):
    own = _slotted(spark, d)
    return C.local_resolutions(own, C.conflict_sets(own), _authority(spark, d)).select("conflict_id", "winner", F.array_join("losers", ",").alias("losers"))


@query(_RESOLVED_SQL + " SELECT n.node_id, CASE WHEN y.rn = 1 THEN 'active' WHEN y.rn > 1 THEN 'superseded' ELSE n.status END AS status FROM nodes n LEFT JOIN y USING (node_id)")
def adjudicated_statuses(spark, d):
    own = _slotted(spark, d)
    return C.adjudicated(own, C.local_resolutions(own, C.conflict_sets(own), _authority(spark, d)))


@query(_CONFLICTS_SQL + " SELECT conflict_id, critical, row_number() OVER (ORDER BY critical DESC, conflict_id)::INTEGER AS place FROM c QUALIFY place <= 8")
def adjudication_batch(spark, d):
    """The next eight conflicts, critical ones first: a batch of fixed size."""
    top = C.conflict_sets(_slotted(spark, d)).select("conflict_id", "critical").orderBy(F.desc("critical"), "conflict_id").limit(8)
    numbered = top.agg(F.array_sort(F.collect_list(F.struct((~F.col("critical")).alias("a"), "conflict_id", "critical"))).alias("x")).select(F.posexplode("x").alias("i", "x"))
    return numbered.select("x.conflict_id", "x.critical", (F.col("i") + 1).alias("place"))


@query(f"WITH {_NODES_SQL}, {_SLOTS_SQL}, r AS (SELECT slot_id, node_id, valid_until, coalesce(valid_from, created_at) AS b FROM slotted WHERE slot_id <> '' AND NOT coalesce(tombstoned, false) AND status IN ('active', 'superseded', 'scoped')), w AS (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY b, node_id)::INTEGER AS version, lead(b) OVER (PARTITION BY slot_id ORDER BY b, node_id) AS nxt FROM r) SELECT slot_id, node_id, version, least(coalesce(valid_until, nxt), coalesce(nxt, valid_until)) AS open_until FROM w")
def slot_versions(spark, d):
    return C.supersession(_slotted(spark, d))


@query(f"SELECT space, {_claim('subject_text')} AS canonical, 'ident_' || substr(sha256('ident' || chr(0) || coalesce(space, '') || chr(0) || {_claim('subject_text')}), 1, 32) AS identity_id, array_to_string(list_sort(list_distinct(list(subject_text))), '|') AS aliases FROM memory_nodes WHERE subject_text IS NOT NULL AND {_claim('subject_text')} <> '' GROUP BY ALL".replace("GROUP BY ALL", f"GROUP BY space, {_claim('subject_text')}"))
def identities(spark, d):
    return C.identities(t(spark, d, "memory_nodes")).select("space", "canonical", "identity_id", F.array_join("aliases", "|").alias("aliases"))


_FORGET = "own AS (SELECT DISTINCT event_id FROM ledger_events WHERE context_id IN (SELECT min(context_id) FROM memory_nodes WHERE context_id <> '' UNION SELECT max(context_id) FROM memory_nodes)), hit AS (SELECT DISTINCT node_id FROM memory_nodes WHERE node_id IN (SELECT node_id FROM node_sources JOIN own USING (event_id)) OR context_id IN (SELECT min(context_id) FROM memory_nodes WHERE context_id <> '' UNION SELECT max(context_id) FROM memory_nodes))"


def _targets(spark, d):
    ends = t(spark, d, "memory_nodes").where("context_id <> ''").agg(F.min("context_id").alias("a"), F.max("context_id").alias("b")).first()
    return C.forget_targets(t(spark, d, "ledger_events"), t(spark, d, "memory_nodes"), t(spark, d, "node_sources"), [ends["a"], ends["b"]])


@query(f"WITH {_FORGET} SELECT 'event' AS kind, event_id AS id FROM own UNION ALL SELECT 'node', node_id FROM hit")
def forget_targets(spark, d):
    return _targets(spark, d)


@query(f"WITH {_FORGET} SELECT node_id, bool_or(coalesce(tombstoned, false) OR node_id IN (SELECT node_id FROM hit)) AS tombstoned FROM memory_nodes GROUP BY node_id")
def tombstoned_nodes(spark, d):
    rows = C.tombstoned(t(spark, d, "memory_nodes").select("node_id", "tombstoned"), _targets(spark, d).where("kind = 'node'"), "node_id")
    return rows.groupBy("node_id").agg(F.bool_or("tombstoned").alias("tombstoned"))


@query(f"WITH {_FORGET} SELECT node_id, count(*) AS sources FROM node_sources WHERE event_id NOT IN (SELECT event_id FROM own WHERE event_id IS NOT NULL) GROUP BY node_id")
def purged_sources(spark, d):
    left = C.purged(t(spark, d, "node_sources"), _targets(spark, d).where("kind = 'event'"), "event_id")
    return left.groupBy("node_id").agg(F.count("*").alias("sources"))


@query("SELECT slot_id FROM memory_nodes WHERE slot_id <> '' GROUP BY slot_id HAVING bool_and(status IN ('rejected', 'quarantined'))")
def garbage_slots(spark, d):
    rows = t(spark, d, "memory_nodes")
    return C.orphan_slots(rows.where("slot_id <> ''").groupBy("slot_id", "node_id").agg(F.bool_and(F.col("status").isin("rejected", "quarantined")).alias("x")), rows.groupBy("node_id").agg(F.bool_and(F.col("status").isin("rejected", "quarantined")).alias("x")).where("x"))


@query("SELECT s.node_id, count(e.event_id) AS bound, count(*) - count(e.event_id) AS unknown FROM node_sources s LEFT JOIN (SELECT DISTINCT event_id FROM ledger_events) e USING (event_id) WHERE s.node_id IN (SELECT node_id FROM memory_nodes) GROUP BY s.node_id")
def bound_sources(spark, d):
    return C.bound_sources(t(spark, d, "memory_nodes"), t(spark, d, "node_sources"), t(spark, d, "ledger_events"))


@query("SELECT n.node_id, n.status, o.node_id AS other FROM (SELECT DISTINCT node_id, status, context_id, valid_from, valid_until FROM memory_nodes) n JOIN (SELECT DISTINCT node_id, context_id, valid_from, valid_until FROM memory_nodes) o ON n.context_id = o.context_id AND n.node_id < o.node_id WHERE n.context_id <> '' AND coalesce(n.valid_until >= o.valid_from, true) AND coalesce(o.valid_until >= n.valid_from, true)")
def interval_overlaps(spark, d):
    rows = t(spark, d, "memory_nodes").where("context_id <> ''").select("node_id", "status", "context_id", "valid_from", "valid_until").distinct()
    o = rows.select("context_id", F.col("node_id").alias("other"), F.col("valid_from").alias("of"), F.col("valid_until").alias("ou")).distinct()
    return rows.join(o, "context_id").where(F.col("node_id") < F.col("other")).where(C.overlaps(F.col("valid_from"), F.col("valid_until"), F.col("of"), F.col("ou"))).select("node_id", "status", "other")


@query("SELECT node_id, facet, CASE WHEN facet IN ('preference', 'constraint') THEN 'later explicit declarations' WHEN facet IN ('state', 'configuration') THEN 'direct observations' WHEN facet = 'procedure-state' THEN 'successful executions' ELSE 'direct documents and tools' END AS policy, coalesce(facet IN ('preference', 'constraint', 'state', 'configuration', 'procedure-state'), false) AS critical FROM memory_nodes")
def authority_policies(spark, d):
    return t(spark, d, "memory_nodes").select("node_id", "facet", C.policy(F.col("facet")).alias("policy"), F.coalesce(F.col("facet").isin(*C.DECLARED, *C.OBSERVED), F.lit(False)).alias("critical"))


@query(f"WITH {LIVE_SQL} SELECT event_id AS doc_id, 'event' AS resource_kind, context_id, {_claim('content')} AS body FROM live WHERE content IS NOT NULL UNION ALL SELECT node_id, 'node', max(context_id), max({_claim('statement')}) FROM memory_nodes WHERE statement IS NOT NULL AND NOT coalesce(tombstoned, false) GROUP BY node_id")
def projected_documents(spark, d):
    """Ledger rows and claims as rows of the document index."""
    a = L.live(t(spark, d, "ledger_events"), "context_id", "content").where("content is not null").select(F.col("event_id").alias("doc_id"), F.lit("event").alias("resource_kind"), "context_id", normalize_claim(F.col("content")).alias("body"))
    nodes = t(spark, d, "memory_nodes").where("statement is not null and not coalesce(tombstoned, false)").groupBy(F.col("node_id").alias("doc_id")).agg(F.max("context_id").alias("context_id"), F.max(normalize_claim(F.col("statement"))).alias("body"))
    return a.unionByName(nodes.select("doc_id", F.lit("node").alias("resource_kind"), "context_id", "body"))


@query(f"WITH {LIVE_SQL}, p AS (SELECT context_id, sum(token_estimate) AS n FROM live WHERE semantic_status = 'pending' AND context_id <> '' GROUP BY context_id) SELECT context_id, n::BIGINT AS pending_tokens, n >= 300 AS fires FROM p")
def compile_triggers(spark, d):
    rows = L.live(t(spark, d, "ledger_events"), "context_id", "semantic_status", "token_estimate").where("semantic_status = 'pending' and context_id <> ''")
    return rows.groupBy("context_id").agg(F.sum("token_estimate").alias("pending_tokens")).withColumn("fires", F.col("pending_tokens") >= 300)
