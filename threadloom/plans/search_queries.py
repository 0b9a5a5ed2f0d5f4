"""Queries of evidence search over the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import ledger as L
from threadloom.operators import search as S
from threadloom.operators import selection as X
from threadloom.operators.lineage import written
from threadloom.operators.walk import event_walk
from threadloom.plans.ledger_queries import LIVE_SQL
from threadloom.plans.registration import registered
from threadloom.plans.scalar_queries import _trim
from threadloom.sources.tables import table as t

QUERIES, SQL, query = registered()

#: The batch of queries that is asked.
ASKED = {"q1": "stale vector cache snapshot after restart", "q2": "release branch preference", "q3": "der bericht nennt verspätete zeilen", "q4": "retention sweep lease heartbeat", "q5": "orphaned checkpoint in the sandbox"}
_TERMS = sorted({(q, w) for q, text in ASKED.items() for w in text.split()})
_ASKED_SQL = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{w}')" for q, w in _TERMS) + ") v(query_id, term))"
_POST = r"postings AS (SELECT term, event_id, count(*) AS tf, max(dl) AS dl FROM (SELECT event_id, len(w) AS dl, unnest(w) AS term FROM (SELECT event_id, list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{Nd}_]+'), lambda x: x <> '') AS w FROM live WHERE content IS NOT NULL)) GROUP BY term, event_id)"
_LEN = r"lengths AS (SELECT event_id, len(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{Nd}_]+'), lambda x: x <> '')) AS dl FROM live WHERE content IS NOT NULL)"
_BM25 = f"WITH {LIVE_SQL}, {_ASKED_SQL}, {_POST}, {_LEN}, hits AS (SELECT * FROM postings WHERE term IN (SELECT term FROM asked)), df AS (SELECT term, count(*) AS df FROM hits GROUP BY term), st AS (SELECT count(*) AS n, avg(dl) AS a FROM lengths), bm AS (SELECT query_id, event_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM hits JOIN df USING (term) JOIN asked USING (term), st GROUP BY query_id, event_id)"
_WEIGHTS = "own AS (SELECT event_id, coalesce(nullif(context_id, ''), event_id) AS c FROM live), f AS (SELECT term, count(DISTINCT c) AS f FROM postings JOIN own USING (event_id) WHERE term IN (SELECT term FROM asked) GROUP BY term), weights AS (SELECT query_id, term, weight FROM (SELECT query_id, term, round(ln(((SELECT count(DISTINCT c) FROM own) + 1) / (f + 1)) + 1, 6) AS weight FROM asked JOIN f USING (term)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) <= 8)"


def _live(spark, d):
    return L.live(t(spark, d, "ledger_events"), "context_id", "content")


def _asked(spark):
    return spark.createDataFrame(_TERMS, "query_id string, term string")


def _lengths(live):
    return live.where("content is not null").select("event_id", F.size(S.tokens(F.col("content"))).alias("dl"))


def _bm25(spark, d, index=None):
    live = _live(spark, d)
    return S.scored(S.postings(live, "event_id", "content") if index is None else index, _asked(spark), _lengths(live), "event_id")


@query(f"WITH {LIVE_SQL}, {_POST} SELECT term, event_id, tf, dl::INTEGER AS dl FROM postings")
def event_postings(spark, d):
    return S.postings(_live(spark, d), "event_id", "content")


@query(f"WITH {LIVE_SQL}, {_POST} SELECT term, count(DISTINCT event_id) AS df FROM postings GROUP BY term HAVING df <= 250")
def document_frequencies(spark, d):
    return S.document_frequencies(S.postings(_live(spark, d), "event_id", "content"), "event_id", F.lit(250))


@query(_BM25 + " SELECT query_id, event_id, score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) <= 128")
def bm25_batch(spark, d):
    return S.ranked(_bm25(spark, d), "query_id", 128, F.desc("score"), F.col("event_id"))


@query(f"WITH {LIVE_SQL}, {_ASKED_SQL}, {_POST}, {_WEIGHTS} SELECT query_id, term, weight FROM weights")
def query_term_weights(spark, d):
    live = _live(spark, d)
    return S.term_weights(S.postings(live, "event_id", "content"), _asked(spark), live, "event_id")


def _weights(spark, d, live, index=None):
    return S.term_weights(S.postings(live, "event_id", "content") if index is None else index, _asked(spark), live, "event_id")


_COVER = f"WITH {LIVE_SQL}, {_ASKED_SQL}, {_POST}, {_WEIGHTS}, cover AS (SELECT query_id, event_id, round(sum(weight) / any_value(total), 6) AS coverage FROM postings JOIN weights USING (term) JOIN (SELECT query_id, sum(weight) AS total FROM weights GROUP BY query_id) USING (query_id) GROUP BY query_id, event_id)"


@query(_COVER + " SELECT query_id, event_id, coverage FROM cover WHERE coverage >= 0.2")
def weighted_coverage(spark, d):
    live = _live(spark, d)
    return S.coverage(live, _weights(spark, d, live), "event_id", "content").where("coverage >= 0.2")


_SPANS = rf"sp AS (SELECT event_id, i - 1 AS span_no, s[i] AS span FROM (SELECT event_id, list_filter(list_transform(string_split(regexp_replace(content, '([.!?。！？；\n]+)', '\1' || chr(1), 'g'), chr(1)), lambda x: {_trim('x')}), lambda x: x <> '') AS s FROM live WHERE content IS NOT NULL), range(1, 5000) r(i) WHERE i <= len(s))"


@query(f"WITH {LIVE_SQL}, {_ASKED_SQL}, {_POST}, {_WEIGHTS}, {_SPANS}, " + r"st AS (SELECT DISTINCT event_id, span_no, unnest(regexp_split_to_array(lower(span), '[^\p{L}\p{Nd}_]+')) AS term FROM sp), c AS (SELECT query_id, event_id, span_no, round(sum(weight) / any_value(total), 6) AS coverage FROM st JOIN weights USING (term) JOIN (SELECT query_id, sum(weight) AS total FROM weights GROUP BY query_id) USING (query_id) GROUP BY ALL) SELECT query_id, event_id, span_no::INTEGER AS span_no, coverage FROM c QUALIFY row_number() OVER (PARTITION BY query_id, event_id ORDER BY coverage DESC, span_no) = 1".replace("GROUP BY ALL", "GROUP BY query_id, event_id, span_no"))
def best_spans(spark, d):
    live = _live(spark, d)
    return S.best_spans(live, _weights(spark, d, live), "event_id", "content")


_SPARSE = "norms AS (SELECT event_id, sqrt(sum(tf * tf)) AS norm FROM postings GROUP BY event_id), sp AS (SELECT query_id, event_id, round(sum(tf / norm * (1 / sqrt(k))), 6) AS score FROM postings JOIN norms USING (event_id) JOIN asked USING (term) JOIN (SELECT query_id, count(*) AS k FROM asked GROUP BY query_id) USING (query_id) GROUP BY query_id, event_id)"


def _sparse(spark, live):
    asked = _asked(spark)
    q = asked.join(asked.groupBy("query_id").agg((1 / F.sqrt(F.count("*"))).alias("q")), "query_id")
    return S.sparse_scores(S.sparse(live, "event_id", "content"), q, "event_id")


@query(f"WITH {LIVE_SQL}, {_ASKED_SQL}, {_POST}, {_SPARSE} SELECT query_id, event_id, score FROM sp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) <= 128")
def sparse_topk(spark, d):
    return S.ranked(_sparse(spark, _live(spark, d)), "query_id", 128, F.desc("score"), F.col("event_id"))


@query(f"WITH {LIVE_SQL}, {_ASKED_SQL}, {_POST}, hits AS (SELECT term, event_id, tf / dl AS s FROM postings WHERE term IN (SELECT term FROM asked) AND length(term) >= 3) SELECT term, event_id, row_number() OVER (PARTITION BY term ORDER BY s DESC, event_id)::INTEGER AS place FROM hits QUALIFY place <= 6")
def facet_topk(spark, d):
    hits = S.postings(_live(spark, d), "event_id", "content").where("length(term) >= 3").join(_asked(spark).select("term").distinct(), "term", "left_semi").withColumn("s", F.col("tf") / F.col("dl"))
    from pyspark.sql import Window as W

    return hits.withColumn("place", F.row_number().over(W.partitionBy("term").orderBy(F.desc("s"), "event_id"))).where("place <= 6").select("term", "event_id", "place")


_POOL = f"{_BM25}, {_SPARSE}, ch AS (SELECT query_id, 'fts' AS channel, event_id AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS rank FROM bm) WHERE rank <= 128 UNION ALL SELECT query_id, 'sparse', event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS rank FROM sp) WHERE rank <= 128)"


def _channels(spark, d, live, index=None):
    from pyspark.sql import Window as W

    out = None
    for name, rows in (("fts", _bm25(spark, d, index)), ("sparse", _sparse(spark, live))):
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "event_id"))
        own = rows.withColumn("rank", rank).where("rank <= 128").select("query_id", F.lit(name).alias("channel"), F.col("event_id").alias("id"), "rank")
        out = own if out is None else out.unionByName(own)
    return out


@query(_POOL + " SELECT query_id, id, count(*) AS channels, min(rank)::INTEGER AS best FROM ch GROUP BY query_id, id")
def channel_union(spark, d):
    return _channels(spark, d, _live(spark, d)).groupBy("query_id", "id").agg(F.count("*").alias("channels"), F.min("rank").alias("best"))


_BLEND = _POOL + f", {_WEIGHTS}, cover AS (SELECT query_id, event_id AS id, round(sum(weight) / any_value(total), 6) AS coverage FROM postings JOIN weights USING (term) JOIN (SELECT query_id, sum(weight) AS total FROM weights GROUP BY query_id) USING (query_id) GROUP BY query_id, event_id), fused AS (SELECT query_id, id, sum(1 / (60 + r)) AS s FROM (SELECT query_id, CASE WHEN channel = 'fts' THEN 'lexical' ELSE channel END AS family, id, min(rank) AS r FROM ch GROUP BY ALL) GROUP BY query_id, id), blend AS (SELECT query_id, id, round(0.7 * s / (max(s) OVER (PARTITION BY query_id)) + 0.3 * coalesce(coverage, 0), 6) AS score FROM fused LEFT JOIN cover USING (query_id, id))".replace("GROUP BY ALL", "GROUP BY 1, 2, 3")


def _blend(spark, d):
    live = written(_live(spark, d))  # read by every channel
    index = written(S.postings(live, "event_id", "content"))
    cover = S.coverage(live, _weights(spark, d, live, index), "event_id", "content").withColumnRenamed("event_id", "id")
    return S.blended(_channels(spark, d, live, index), cover)


@query(_BLEND + " SELECT query_id, id, score FROM blend")
def family_blend(spark, d):
    return _blend(spark, d)


@query(_BLEND + ", b AS (SELECT query_id, id, score, context_id FROM blend JOIN live ON live.event_id = blend.id WHERE context_id <> ''), r AS (SELECT query_id, context_id, id, score FROM b QUALIFY row_number() OVER (PARTITION BY query_id, context_id ORDER BY score DESC, id) = 1) SELECT query_id, context_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS place FROM r QUALIFY place <= 12")
def context_representatives(spark, d):
    """The best event of each context, and the first twelve contexts of a query."""
    from pyspark.sql import Window as W

    rows = _blend(spark, d).join(_live(spark, d).where("context_id <> ''").select(F.col("event_id").alias("id"), "context_id"), "id")
    best = rows.groupBy("query_id", "context_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b")).select("query_id", "context_id", "b.id", "b.s")
    return best.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("s", "id"))).where("place <= 12").select("query_id", "context_id", "id", "place")


@query(_BLEND + ", b AS (SELECT query_id, id, score, context_id, occurred_at FROM blend JOIN live ON live.event_id = blend.id WHERE score >= 0.4) SELECT query_id, id, max(score) OVER (PARTITION BY query_id, context_id) AS context_score FROM b")
def context_scores(spark, d):
    rows = _blend(spark, d).where("score >= 0.4").join(_live(spark, d).select(F.col("event_id").alias("id"), "context_id"), "id")
    most = rows.groupBy("query_id", "context_id").agg(F.max("score").alias("context_score"))
    same = (F.col("r.query_id") == F.col("m.query_id")) & F.col("r.context_id").eqNullSafe(F.col("m.context_id"))
    return rows.alias("r").join(most.alias("m"), same).select("r.query_id", "r.id", "m.context_score")


_GRAPH = f"{_POST}, n AS (SELECT count(*) AS n FROM live), rare AS (SELECT term, count(*) AS df FROM postings GROUP BY term HAVING count(*) <= greatest(2, (SELECT n FROM n) // 20)), one AS (SELECT 'event:' || event_id AS source, 'context:' || context_id AS target, 1.0::DOUBLE AS weight FROM live WHERE context_id <> '' UNION ALL SELECT 'event:' || event_id, 'semantic:' || node_id, 0.8 FROM node_sources UNION ALL SELECT 'event:' || event_id, 'concept:' || term, ln(1 + (SELECT n FROM n)::DOUBLE / df) FROM postings JOIN rare USING (term)), edges AS (SELECT source, target, round(max(weight), 6) AS weight FROM (SELECT * FROM one UNION ALL SELECT target, source, weight FROM one) GROUP BY source, target)"


def _graph(spark, d):
    live = _live(spark, d)
    return S.graph(live, t(spark, d, "node_sources").where("event_id is not null and node_id is not null"), S.postings(live, "event_id", "content"), live.count())


@query(f"WITH {LIVE_SQL}, {_GRAPH} SELECT source, target, weight FROM edges WHERE source IS NOT NULL AND target IS NOT NULL")
def concept_graph(spark, d):
    return _graph(spark, d)


def _claim_edges(spark, d):
    return t(spark, d, "node_sources").where("event_id is not null and node_id is not null").select(F.col("event_id").alias("source"), F.col("node_id").alias("target"))


@query("WITH RECURSIVE e AS (SELECT event_id AS a, node_id AS b FROM node_sources WHERE event_id IS NOT NULL AND node_id IS NOT NULL UNION SELECT node_id, event_id FROM node_sources WHERE event_id IS NOT NULL AND node_id IS NOT NULL), r AS (SELECT DISTINCT a AS origin, a AS node FROM e UNION SELECT r.origin, e.b FROM r JOIN e ON r.node = e.a) SELECT origin AS id, min(node) AS component FROM r GROUP BY origin")
def graph_components(spark, d):
    return S.connected(_claim_edges(spark, d))


@query()
def graph_pagerank(spark, d):
    """The walk from the best events of the queries; no SQL, as it is iterated (tested against ``search.pagerank`` and a dense product)."""
    claims = t(spark, d, "node_sources").where("event_id is not null and node_id is not null").groupBy("event_id").agg(F.collect_set("node_id").alias("claims"))
    events = _live(spark, d).select("event_id", "context_id", S.tokens(F.col("content")).alias("terms"), F.lit(True).alias("live"))
    docs = written(events.join(claims.hint("shuffle_hash"), "event_id", "full"), freed=True)
    texts = docs.where("live and terms is not null").select("event_id", F.size("terms").alias("dl"), F.filter("terms", lambda x: x.isin(*{w for _, w in _TERMS})).alias("hits"))
    index = texts.select("event_id", "dl", "hits", F.explode(F.array_distinct("hits")).alias("term")).select("term", "event_id", F.size(F.filter("hits", lambda x: x == F.col("term"))).alias("tf"), "dl")
    best = S.ranked(S.scored(index, _asked(spark), texts, "event_id"), "query_id", 16, F.desc("score"), F.col("event_id"))
    seeds = written(best.groupBy("event_id").agg(F.max("score").alias("weight")), freed=True)
    return event_walk(docs, docs.where("live").count(), seeds, rounds=10)


@query("SELECT query_id, doc_id, round(avg(s), 6) AS score FROM (SELECT q.query_id, q.q_no, v.context_id AS doc_id, max(list_inner_product(q.q, v.v)) AS s FROM (SELECT 'a' AS query_id, row_number() OVER (ORDER BY event_id) AS q_no, dense_fp16::DOUBLE[] AS q FROM (SELECT DISTINCT event_id, dense_fp16 FROM event_vectors WHERE len(dense_fp16) = 128 AND event_id IN (SELECT min(event_id) FROM event_vectors WHERE len(dense_fp16) = 128 UNION SELECT max(event_id) FROM event_vectors WHERE len(dense_fp16) = 128))) q, (SELECT context_id, dense_fp16::DOUBLE[] AS v FROM event_vectors WHERE len(dense_fp16) = 128 AND context_id <> '' AND NOT list_has_any(dense_fp16, ['nan'::FLOAT, 'inf'::FLOAT, '-inf'::FLOAT])) v GROUP BY ALL) GROUP BY query_id, doc_id".replace("GROUP BY ALL", "GROUP BY q.query_id, q.q_no, v.context_id"))
def maxsim_contexts(spark, d):
    """Contexts as bags of their events' vectors against two token vectors."""
    rows = t(spark, d, "event_vectors").where("size(dense_fp16) = 128").select("event_id", "context_id", "dense_fp16")
    ends = rows.agg(F.array(F.min("event_id"), F.max("event_id")).alias("e")).select(F.explode("e").alias("event_id"))
    q = rows.join(F.broadcast(ends), "event_id").select("event_id", "dense_fp16").distinct().select(F.lit("a").alias("query_id"), F.concat("event_id", F.hash("dense_fp16").cast("string")).alias("q_no"), F.col("dense_fp16").alias("q"))
    finite = ~F.exists("dense_fp16", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return S.maxsim(q, rows.where("context_id <> ''").where(finite).select(F.col("context_id").alias("doc_id"), F.col("dense_fp16").alias("v")))


@query("SELECT event_id, round(sqrt(list_inner_product(v, v)), 4) AS norm, round(CASE WHEN list_inner_product(v, v) = 0 THEN -1 ELSE list_inner_product(v, w) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(w, w))) END, 4) AS cosine FROM (SELECT DISTINCT event_id, dense_fp16::DOUBLE[] AS v FROM event_vectors WHERE len(dense_fp16) = 128 AND NOT list_has_any(dense_fp16, ['nan'::FLOAT, 'inf'::FLOAT, '-inf'::FLOAT])) a, (SELECT min(dense_fp16)::DOUBLE[] AS w FROM event_vectors WHERE len(dense_fp16) = 128 AND event_id = (SELECT min(event_id) FROM event_vectors WHERE len(dense_fp16) = 128)) b")
def vector_cosines(spark, d):
    rows = t(spark, d, "event_vectors").where("size(dense_fp16) = 128").select("event_id", "dense_fp16")
    first = rows.agg(F.min(F.struct("event_id", "dense_fp16"))["dense_fp16"].alias("w"))
    finite = ~F.exists("dense_fp16", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(finite).distinct().crossJoin(F.broadcast(first)).select("event_id", F.round(F.sqrt(S.dot(F.col("dense_fp16"), F.col("dense_fp16"))), 4).alias("norm"), F.round(S.cosine(F.col("dense_fp16"), F.col("w")), 4).alias("cosine"))


@query()
def evidence_selection(spark, d):
    """Greedy evidence for each query under a budget; chosen step by step, so without SQL (golden tests)."""
    live = _live(spark, d)
    top = S.ranked(_blend(spark, d), "query_id", 192, F.desc("score"), F.col("id"))
    rows = top.join(live.select(F.col("event_id").alias("id"), "context_id", "content"), "id").withColumn("component", F.lit("")).withColumn("sources", F.array("id"))
    return X.evidence(rows, _weights(spark, d, live))


@query(_BLEND + ", o AS (SELECT query_id, id, score, ceil(length(" + _trim("content") + ") / 3.0)::BIGINT AS cost, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM blend JOIN live ON live.event_id = blend.id WHERE content IS NOT NULL) SELECT query_id, id FROM o WHERE place <= 3 AND cost <= 10000")
def first_evidence(spark, d):
    """The first three in order under a budget that they fit in."""
    rows = _blend(spark, d).join(_live(spark, d).where("content is not null").select(F.col("event_id").alias("id"), F.ceil(F.length(F.regexp_replace("content", r"(?U)^\s+|(?<!\s)\s+$", "")) / 3).alias("cost")), "id")
    top = S.ranked(rows, "query_id", 192, F.desc("score"), F.col("id")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "cost"))).alias("o"))
    return top.select("query_id", F.explode(X.taken_in_order(F.transform("o", lambda x: x["id"]), F.transform("o", lambda x: x["cost"]), 30000, 3)).alias("id"))
