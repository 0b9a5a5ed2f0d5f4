"""Queries of windows, filters, evaluation and planning over the ledger, claims and reviews."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import ledger as L
from threadloom.operators import search as S
from threadloom.operators import selection as X
from threadloom.operators import windows as V
from threadloom.plans.ledger_queries import LIVE_SQL
from threadloom.plans.registration import registered
from threadloom.plans.scalar_queries import _WS, _trim
from threadloom.sources.tables import table as t

QUERIES, SQL, query = registered()

_SESSIONS = LIVE_SQL + ", s AS (SELECT session_id, event_id, occurred_at, content, lower(" + _trim("actor") + ") AS actor, length(content) AS n FROM live WHERE session_id <> '' AND occurred_at IS NOT NULL AND content IS NOT NULL)"
_IN = "(PARTITION BY session_id ORDER BY occurred_at, event_id ROWS UNBOUNDED PRECEDING)"


def _sessions(spark, d):
    rows = L.live(t(spark, d, "ledger_events"), "session_id", "occurred_at", "content", "actor").where("session_id <> '' and occurred_at is not null and content is not null")
    own = rows.select("session_id", "event_id", "occurred_at", F.lower(T.utrim(F.col("actor"))).alias("actor"), F.length("content").alias("n"))
    return V.parted(own, "session_id", "occurred_at", "event_id")


_ORDER = ("occurred_at", "event_id")


@query(f"WITH {_SESSIONS} SELECT session_id, event_id, sum(n) OVER {_IN}::BIGINT AS end_offset FROM s")
def session_offsets(spark, d):
    return V.running(_sessions(spark, d), "session_id", _ORDER, F.col("n"), "end_offset").select("session_id", "event_id", "end_offset")


@query(f"WITH {_SESSIONS}, p AS (SELECT session_id, event_id, sum(n) OVER {_IN} AS e, n, sum(n) OVER (PARTITION BY session_id) AS total FROM s WHERE n > 0), w AS (SELECT *, r.c AS chunk FROM p, range(0, 20000) r(c) WHERE r.c * 2016 < e AND r.c * 2016 + 2304 > e - n AND (r.c = 0 OR (r.c - 1) * 2016 + 2304 < total)) SELECT session_id, chunk, event_id, (greatest(e - n, chunk * 2016) - (e - n))::BIGINT AS start_rune, (least(e, chunk * 2016 + 2304) - (e - n))::BIGINT AS end_rune FROM w")
def sliding_chunks(spark, d):
    """Windows of 768 tokens, 96 of them shared, over each session's texts."""
    return V.chunks(_sessions(spark, d), "session_id", _ORDER, F.col("n"), 2304, 288).select("session_id", "chunk", "event_id", F.col("start").alias("start_rune"), F.col("end").alias("end_rune"))


@query(f"WITH {_SESSIONS}, f AS (SELECT *, coalesce(actor <> lag(actor) OVER (PARTITION BY session_id ORDER BY occurred_at, event_id), true) OR lag(actor) OVER (PARTITION BY session_id ORDER BY occurred_at, event_id) IS NULL AS new FROM s) SELECT session_id, event_id, sum(new::INTEGER) OVER {_IN}::BIGINT AS exchange FROM f")
def actor_exchanges(spark, d):
    return V.islands(_sessions(spark, d), "session_id", _ORDER, "actor", "exchange").select("session_id", "event_id", "exchange")


@query(f"WITH {_SESSIONS}, c AS (SELECT session_id, event_id, sum(coalesce((actor IN ('user', 'human'))::INTEGER, 0)) OVER {_IN} AS turn FROM s) SELECT session_id, event_id, turn::BIGINT AS turn, ((turn - 1) // 5)::BIGINT AS commit_no FROM c WHERE turn >= 1")
def user_turn_windows(spark, d):
    """User turns counted in order, five of them a window; what is before the first turn is left out."""
    turns = V.running(_sessions(spark, d), "session_id", _ORDER, F.coalesce(F.col("actor").isin("user", "human").cast("int"), F.lit(0)), "turn")
    return turns.where("turn >= 1").select("session_id", "event_id", "turn", F.floor((F.col("turn") - 1) / 5).alias("commit_no"))


@query(f"WITH {_SESSIONS}, r AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at, event_id) AS a, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at DESC, event_id DESC) AS b FROM s) SELECT session_id, event_id FROM r WHERE a <= 5 OR b <= 5")
def session_head_tail(spark, d):
    rows = _sessions(spark, d).drop("_part")
    return V.ends(rows, "session_id", (F.col("occurred_at"), F.col("event_id")), (F.desc("occurred_at"), F.desc("event_id")), 5, 5).select("session_id", "event_id")


@query(f"WITH {_SESSIONS}, r AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at DESC, event_id DESC) AS b FROM s) SELECT session_id, event_id FROM r WHERE b <= 3")
def recent_results(spark, d):
    return S.ranked(_sessions(spark, d).drop("_part"), "session_id", 3, F.desc("occurred_at"), F.desc("event_id")).select("session_id", "event_id")


@query(f"WITH {LIVE_SQL}, a AS (SELECT context_id, max({{'o': occurred_at, 'e': event_id, 't': token_estimate}}) AS m FROM live WHERE context_id <> '' AND occurred_at IS NOT NULL AND semantic_status = 'indexed' AND token_estimate IS NOT NULL GROUP BY context_id) SELECT l.context_id, (any_value(a.m.t) + coalesce(sum(length(l.content) // 4) FILTER (WHERE l.occurred_at > a.m.o OR (l.occurred_at = a.m.o AND l.event_id > a.m.e)), 0))::BIGINT AS tokens FROM live l JOIN a USING (context_id) GROUP BY l.context_id")
def anchored_token_counts(spark, d):
    """The last counted row of a context and estimates of the rows after it."""
    rows = L.live(t(spark, d, "ledger_events"), "context_id", "occurred_at", "semantic_status", "token_estimate", "content").where("context_id <> ''")
    anchor = rows.where("occurred_at is not null and semantic_status = 'indexed' and token_estimate is not null").groupBy("context_id").agg(F.max(F.struct("occurred_at", "event_id", "token_estimate")).alias("m"))
    later = (F.col("occurred_at") > F.col("m.occurred_at")) | ((F.col("occurred_at") == F.col("m.occurred_at")) & (F.col("event_id") > F.col("m.event_id")))
    return rows.join(anchor, "context_id").groupBy("context_id").agg((F.max("m.token_estimate") + F.coalesce(F.sum(F.when(later, T.rough_tokens(F.col("content")))), F.lit(0))).cast("bigint").alias("tokens"))


@query("SELECT space, (max(ledger_seq) - coalesce(max(ledger_seq) FILTER (WHERE closed_at IS NOT NULL), 0))::BIGINT AS lag FROM contexts GROUP BY space")
def index_lag(spark, d):
    return t(spark, d, "contexts").groupBy("space").agg((F.max("ledger_seq") - F.coalesce(F.max(F.when(F.col("closed_at").isNotNull(), F.col("ledger_seq"))), F.lit(0))).alias("lag"))


@query("""WITH RECURSIVE s AS (SELECT coalesce(nullif(trim(resource_kind), ''), 'unknown') AS resource_kind, doc_id FROM documents), c AS (SELECT resource_kind, count(*) AS n FROM s GROUP BY resource_kind), k AS (SELECT count(*) AS k, least(97, sum(n)) AS size FROM c),
x AS (SELECT resource_kind, n, least(97 // k, n)::BIGINT AS q, (size - sum(least(97 // k, n)) OVER ())::BIGINT AS rest, 0 AS r FROM c, k
UNION ALL SELECT resource_kind, n, q + (q < n AND row_number() OVER (ORDER BY (q < n) DESC, n - q DESC, resource_kind) <= rest)::BIGINT, (rest - least(rest, sum((q < n)::INTEGER) OVER ()))::BIGINT, r + 1 FROM x WHERE rest > 0), y AS (SELECT resource_kind, q FROM x WHERE r = (SELECT max(r) FROM x))
SELECT s.resource_kind, s.doc_id FROM s JOIN y USING (resource_kind) QUALIFY row_number() OVER (PARTITION BY s.resource_kind ORDER BY sha256('sample' || chr(0) || s.resource_kind || chr(0) || doc_id), doc_id) <= any_value(q) OVER (PARTITION BY s.resource_kind)""")
def stratified_documents(spark, d):
    return V.stratified(t(spark, d, "documents"), "resource_kind", "doc_id", 97, "sample")


@query("""WITH r AS (SELECT source, doc_id, created_at, coalesce(n_chars, 0) AS b, coalesce(lang = 'fr', false) AS p FROM documents WHERE source IS NOT NULL), n AS (SELECT *, sum((NOT p)::INTEGER) OVER (PARTITION BY source ORDER BY created_at DESC NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS k, (SELECT max(created_at) FROM documents) AS now FROM r),
x AS (SELECT *, CASE WHEN NOT p AND created_at < now - INTERVAL 200 DAY THEN 'age' WHEN NOT p AND k > 60 THEN 'count' END AS why FROM n), y AS (SELECT *, sum(CASE WHEN why IS NULL THEN b ELSE 0 END) OVER (PARTITION BY source) AS remaining, sum(CASE WHEN why IS NULL AND NOT p THEN b ELSE 0 END) OVER (PARTITION BY source ORDER BY created_at NULLS FIRST, doc_id ROWS UNBOUNDED PRECEDING) AS freed FROM x)
SELECT source, doc_id, coalesce(why, 'bytes') AS reason FROM y WHERE why IS NOT NULL OR (NOT p AND remaining - (freed - b) > 60000)""")
def retention_rule(spark, d):
    """Age, count and bytes per source; one language is protected."""
    docs = t(spark, d, "documents").where("source is not null")
    now = docs.sparkSession.read.parquet(f"{d}/documents.parquet").agg(F.max("created_at")).first()[0]  # one value
    return V.retained(docs, "source", "doc_id", "created_at", "n_chars", F.lit(now), F.coalesce(F.col("lang") == "fr", F.lit(False)), 200, 60, 60000)


# ---- filters and classifications

_AT = "TIMESTAMPTZ '2022-01-06 00:00:00+00'"


@query(f"SELECT event_id, occurred_at FROM ledger_events WHERE space = 'project:amber-core' AND (occurred_at IS NULL OR occurred_at <= {_AT})")
def as_of_events(spark, d):
    return t(spark, d, "ledger_events").where("space = 'project:amber-core' and (occurred_at is null or occurred_at <= timestamp '2022-01-06 00:00:00')").select("event_id", "occurred_at")


@query(f"SELECT node_id, status FROM memory_nodes WHERE status NOT IN ('rejected', 'quarantined') AND NOT coalesce(tombstoned, false) AND (created_at IS NULL OR created_at <= {_AT})")
def state_filtered_nodes(spark, d):
    return t(spark, d, "memory_nodes").where("status not in ('rejected', 'quarantined') and not coalesce(tombstoned, false) and (created_at is null or created_at <= timestamp '2022-01-06 00:00:00')").select("node_id", "status")


#: Turns that say nothing, and stock phrases of short turns.
LOW = ("ok", "okay", "sure", "thanks", "thank you", "got it", "great", "cool", "hello", "hi", "bye", "you're welcome", "you are welcome", "no problem", "好的", "好", "谢谢", "明白了", "知道了", "收到", "没问题", "不用谢", "再见")
STOCK = ("let me know if you need", "feel free to ask", "is there anything else", "how can i help", "如果还需要", "如有其他问题", "还有什么可以帮", "随时告诉我")
DETERMINISTIC = ("tool", "command", "file", "observation")
_q = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
_EDGE = r"[ \t\r\n.!?,;:，。！？；：~～]"


@query(rf"SELECT event_id, CASE WHEN coalesce(lower({_trim('source_kind')}) IN ({_q(DETERMINISTIC)}), false) THEN false ELSE v = '' OR v IN ({_q(LOW)}) OR (length(v) <= 160 AND regexp_matches(v, '{'|'.join(STOCK)}')) END AS low FROM (SELECT *, regexp_replace(lower({_trim('content')}), '^{_EDGE}+|{_EDGE}+$', '', 'g') AS v FROM ledger_events WHERE content IS NOT NULL)")
def low_signal_events(spark, d):
    v = F.regexp_replace(F.lower(T.utrim(F.col("content"))), rf"^{_EDGE}+|{_EDGE}+$", "")
    sure = F.coalesce(F.lower(T.utrim(F.col("source_kind"))).isin(*DETERMINISTIC), F.lit(False))
    low = F.when(sure, False).otherwise((v == "") | v.isin(*LOW) | ((F.length(v) <= 160) & v.rlike("|".join(STOCK))))
    return t(spark, d, "ledger_events").where("content is not null").select("event_id", low.alias("low"))


@query(f"SELECT event_id, coalesce(lower({_trim('source_kind')}) IN ({_q(DETERMINISTIC)}), false) AS deterministic FROM ledger_events")
def deterministic_sources(spark, d):
    return t(spark, d, "ledger_events").select("event_id", F.coalesce(F.lower(T.utrim(F.col("source_kind"))).isin(*DETERMINISTIC), F.lit(False)).alias("deterministic"))


@query(f"SELECT event_id FROM (SELECT event_id, lower({_trim('actor')}) AS a, {_trim('content')} AS x FROM ledger_events) WHERE a IN ('user', 'human') AND length(x) BETWEEN 20 AND 1600 AND NOT x LIKE '%?' AND NOT x LIKE '%？'")
def prototype_candidates(spark, d):
    x = T.utrim(F.col("content"))
    return t(spark, d, "ledger_events").where(F.lower(T.utrim(F.col("actor"))).isin("user", "human")).where(F.length(x).between(20, 1600) & ~x.endswith("?") & ~x.endswith("？")).select("event_id")


#: What in a text asks for which kind of memory write, in order of precedence.
MODES = (("correction", 5, ("更正", "纠正", "改成", "不是之前", "actually", "correction", "i meant")), ("constraint", 4, ("必须", "禁止", "永远不要", "不要再", "约束", "must ", "must not", "never ", "always ")), ("preference", 3, ("我的偏好", "我更喜欢", "我喜欢", "我希望", "偏好", "i prefer", "my preference", "i like")), ("explicit", 2, ("记住", "记得", "请保存", "remember", "keep this in mind", "save this")))


@query("SELECT event_id, CASE " + " ".join(f"WHEN regexp_matches(lower(content), '{'|'.join(words)}') THEN '{mode}'" for mode, _, words in MODES) + " ELSE 'normal' END AS mode FROM ledger_events WHERE content IS NOT NULL")
def write_modes(spark, d):
    mode = F.lit("normal")
    for name, _, words in reversed(MODES):
        mode = F.when(F.lower("content").rlike("|".join(words)), name).otherwise(mode)
    return t(spark, d, "ledger_events").where("content is not null").select("event_id", mode.alias("mode"))


@query("SELECT event_id FROM ledger_events WHERE contains(lower(content), 'vector cache') OR contains(lower(content), 'vector') OR contains(lower(content), 'cache')")
def local_text_matches(spark, d):
    x = F.lower("content")
    words = F.array(F.lit("vector"), F.lit("cache"))
    return t(spark, d, "ledger_events").where(F.contains(x, F.lit("vector cache")) | F.exists(words, lambda w: F.contains(x, w))).select("event_id")


@query(r"SELECT event_id, line_no, line FROM (SELECT event_id, generate_subscripts(l, 1)::INTEGER AS line_no, unnest(l) AS line FROM (SELECT DISTINCT event_id, string_split(content, chr(10)) AS l FROM ledger_events WHERE content IS NOT NULL)) WHERE regexp_matches(line, '(ERROR|WARN) \w+')")
def grep_lines(spark, d):
    lines = t(spark, d, "ledger_events").where("content is not null").select("event_id", "content").distinct().where(F.col("content").rlike(r"(ERROR|WARN) \w+")).select("event_id", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    return lines.where(F.col("line").rlike(r"(ERROR|WARN) \w+")).select("event_id", (F.col("i") + 1).alias("line_no"), "line")


@query(r"SELECT source_kind, count(*) AS events, sum(len(regexp_extract_all(content, '\d+')))::BIGINT AS matches FROM ledger_events WHERE content IS NOT NULL AND source_kind IS NOT NULL GROUP BY source_kind")
def grep_counts(spark, d):
    return t(spark, d, "ledger_events").where("content is not null and source_kind is not null").groupBy("source_kind").agg(F.count("*").alias("events"), F.sum(F.regexp_count("content", F.lit(r"\d+"))).alias("matches"))


@query("SELECT event_id, line_no, line FROM (SELECT event_id, generate_subscripts(l, 1)::INTEGER AS line_no, unnest(l) AS line FROM (SELECT DISTINCT event_id, string_split(content, chr(10)) AS l FROM ledger_events WHERE content IS NOT NULL)) WHERE line_no BETWEEN 2 AND 5")
def line_slices(spark, d):
    lines = t(spark, d, "ledger_events").where("content is not null").select("event_id", "content").distinct().select("event_id", F.slice(F.split("content", "\n"), 2, 4).alias("l"))
    return lines.select("event_id", F.posexplode("l").alias("i", "line")).select("event_id", (F.col("i") + 2).alias("line_no"), "line")


@query("SELECT source_ref, max(created_at) AS newest FROM ledger_events WHERE regexp_matches(source_ref, '^[^/]*/[^/]*[.]go') OR regexp_matches(source_ref, '^ses_[0-9a-f]+#L[0-9]+$') GROUP BY source_ref ORDER BY newest DESC, source_ref LIMIT 100")
def newest_references(spark, d):
    rows = t(spark, d, "ledger_events").where(F.col("source_ref").rlike("^[^/]*/[^/]*[.]go|^ses_[0-9a-f]+#L[0-9]+$"))
    return rows.groupBy("source_ref").agg(F.max("created_at").alias("newest")).orderBy(F.desc("newest"), "source_ref").limit(100)


@query("SELECT event_id, key, value FROM (SELECT DISTINCT event_id, unnest(map_entries(metadata)).key AS key, unnest(map_entries(metadata)).value AS value FROM ledger_events WHERE metadata IS NOT NULL)")
def exploded_metadata(spark, d):
    return t(spark, d, "ledger_events").where("metadata is not null").select("event_id", F.explode("metadata").alias("key", "value")).distinct()


# ---- evaluation over reviews: a case is a review, it is resolved where the verdict is 0, and lasts as long as its text is

_CASES = "cases AS (SELECT r.doc_id, r.reviewer, r.verdict, d.source, d.lang, d.n_chars::DOUBLE AS took FROM doc_reviews r JOIN documents d USING (doc_id))"


def _cases(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", "lang", F.col("n_chars").cast("double").alias("took"))
    return t(spark, d, "doc_reviews").select("doc_id", "reviewer", "verdict").join(docs, "doc_id")


@query(f"WITH {_CASES} SELECT reviewer, count(*) AS total, count_if(verdict = 0) AS resolved, round(count_if(verdict = 0) / count(*), 6)::DOUBLE AS pass_rate, round(avg(took), 6) AS mean_took, round(quantile_cont(took, 0.5), 6) AS p50, round(quantile_cont(took, 0.9), 6) AS p90, round(quantile_cont(took, 0.95), 6) AS p95 FROM cases GROUP BY reviewer")
def suite_summary(spark, d):
    p = F.percentile("took", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    rows = _cases(spark, d).groupBy("reviewer").agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == 0).alias("resolved"), F.round(F.avg("took"), 6).alias("mean_took"), p.alias("p"))
    return rows.select("reviewer", "total", "resolved", F.round(F.col("resolved") / F.col("total"), 6).alias("pass_rate"), "mean_took", *(F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("p50", "p90", "p95"))))


@query(f"WITH {_CASES} SELECT doc_id, reviewer, took FROM cases WHERE verdict = 1 ORDER BY took DESC, doc_id, reviewer LIMIT 10")
def top_failures(spark, d):
    return _cases(spark, d).where("verdict = 1").select("doc_id", "reviewer", "took").orderBy(F.desc("took"), "doc_id", "reviewer").limit(10)


_ROW = "count(*) AS total, count(verdict) AS evaluated, count_if(coalesce(verdict = 0, false)) AS correct, round(coalesce(count_if(coalesce(verdict = 0, false)) / nullif(count(verdict), 0), 0), 6)::DOUBLE AS accuracy, round(count(verdict) / count(*), 6)::DOUBLE AS coverage"


def _accuracy(grouped):
    rows = grouped.agg(F.count("*").alias("total"), F.count("verdict").alias("evaluated"), F.count_if(F.col("verdict") == 0).alias("correct"))
    return rows.withColumn("accuracy", F.round(F.coalesce(F.try_divide("correct", "evaluated"), F.lit(0.0)), 6)).withColumn("coverage", F.round(F.col("evaluated") / F.col("total"), 6))


@query(f"WITH {_CASES}, g AS (SELECT lang, source, grouping(lang)::INTEGER AS over_langs, grouping(source)::INTEGER AS over_sources, {_ROW} FROM cases GROUP BY GROUPING SETS ((), (lang), (source))) SELECT *, CASE WHEN over_langs = 1 AND over_sources = 1 THEN (SELECT round(avg(accuracy), 6) FROM g WHERE over_sources = 0) END AS mean_source_accuracy FROM g")
def accuracy_levels(spark, d):
    """Overall, by language, by source; the overall row also has the mean of the sources' accuracies."""
    cases = _cases(spark, d)
    counts = (F.count("*").alias("total"), F.count("verdict").alias("evaluated"), F.count_if(F.col("verdict") == 0).alias("correct"))
    g = cases.groupingSets([[], [F.col("lang")], [F.col("source")]], F.col("lang"), F.col("source")).agg(F.grouping("lang").cast("int").alias("over_langs"), F.grouping("source").cast("int").alias("over_sources"), *counts)
    rows = g.withColumn("accuracy", F.round(F.coalesce(F.try_divide("correct", "evaluated"), F.lit(0.0)), 6)).withColumn("coverage", F.round(F.col("evaluated") / F.col("total"), 6))
    mean = _accuracy(cases.groupBy("source")).agg(F.round(F.avg("accuracy"), 6).alias("m"))
    return rows.crossJoin(F.broadcast(mean)).select("lang", "source", "over_langs", "over_sources", "total", "evaluated", "correct", "accuracy", "coverage", F.when((F.col("over_langs") == 1) & (F.col("over_sources") == 1), F.col("m")).alias("mean_source_accuracy"))  # one row


@query("SELECT metadata['lane'] AS lane, sum(token_estimate)::BIGINT AS tokens, array_to_string(list_sort(list_distinct(list(metadata['model']))), ',') AS models FROM ledger_events WHERE metadata['lane'] IS NOT NULL GROUP BY metadata['lane']")
def stage_token_usage(spark, d):
    rows = t(spark, d, "ledger_events").select(F.col("metadata")["lane"].alias("lane"), F.col("metadata")["model"].alias("model"), "token_estimate").where("lane is not null")
    return rows.groupBy("lane").agg(F.sum("token_estimate").alias("tokens"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


@query(f"WITH {_CASES}, a AS (SELECT source, round(avg((verdict = 0)::INTEGER), 6) AS v FROM cases WHERE lang = 'en' AND verdict IS NOT NULL GROUP BY source), b AS (SELECT source, round(avg((verdict = 0)::INTEGER), 6) AS v FROM cases WHERE coalesce(lang, '') <> 'en' AND verdict IS NOT NULL GROUP BY source) SELECT b.source, a.v AS baseline, b.v AS candidate, round(b.v - a.v, 6) AS delta, CASE WHEN a.v IS NULL THEN true ELSE b.v - a.v >= -0.2 END AS holds FROM b LEFT JOIN a USING (source)")
def run_deltas(spark, d):
    """Sources' rates in one run (English) against another, and whether the loss is within bounds."""
    rate = lambda df, n: df.where("verdict is not null").groupBy("source").agg(F.round(F.avg((F.col("verdict") == 0).cast("int")), 6).alias(n))
    cases = _cases(spark, d)
    both = rate(cases.where("coalesce(lang, '') <> 'en'"), "candidate").alias("b").join(rate(cases.where("lang = 'en'"), "baseline").alias("a"), "source", "left")
    delta = F.col("candidate") - F.col("baseline")
    return both.select("source", "baseline", "candidate", F.round(delta, 6).alias("delta"), F.coalesce(delta >= -0.2, F.lit(True)).alias("holds"))


@query("SELECT d.doc_id, coalesce(r.v::VARCHAR, 'not evaluated') AS verdict FROM (SELECT doc_id FROM documents) d LEFT JOIN (SELECT doc_id, max(verdict) AS v FROM doc_reviews GROUP BY doc_id) r USING (doc_id)")
def judged_documents(spark, d):
    judged = t(spark, d, "doc_reviews").groupBy("doc_id").agg(F.max("verdict").alias("v"))
    return t(spark, d, "documents").select("doc_id").join(judged, "doc_id", "left").select("doc_id", F.coalesce(F.col("v").cast("string"), F.lit("not evaluated")).alias("verdict"))


@query(f"WITH {_CASES}, o AS (SELECT 'overall' AS gate, {_ROW}, 0.75::DOUBLE AS least FROM cases UNION ALL SELECT 'source ' || source, {_ROW}, CASE WHEN source IN ('faq', 'web_fetch') THEN 0.6 ELSE 0.5 END FROM cases WHERE source IS NOT NULL GROUP BY source) SELECT gate, accuracy, least, accuracy >= least AS passed FROM o")
def smoke_gate(spark, d):
    cases = _cases(spark, d)
    overall = _accuracy(cases.groupBy()).select(F.lit("overall").alias("gate"), "accuracy", F.lit(0.75).alias("least"))
    each = _accuracy(cases.where("source is not null").groupBy("source")).select(F.concat(F.lit("source "), "source").alias("gate"), "accuracy", F.when(F.col("source").isin("faq", "web_fetch"), 0.6).otherwise(0.5).alias("least"))
    return overall.unionByName(each).withColumn("passed", F.col("accuracy") >= F.col("least"))


@query("SELECT count(*) AS n, count(*) - count(DISTINCT doc_id) AS duplicates, count_if(verdict IS NULL) AS empty, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doc_reviews)) AS missing, (SELECT count(*) FROM doc_reviews WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS extra FROM doc_reviews")
def prediction_checks(spark, d):
    r, docs = t(spark, d, "doc_reviews"), t(spark, d, "documents").select("doc_id")
    own = r.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("doc_id")).alias("duplicates"), F.count_if(F.col("verdict").isNull()).alias("empty"))
    missing = docs.join(r.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("missing"))
    extra = r.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("extra"))
    return own.crossJoin(missing).crossJoin(extra)  # one row each


@query("SELECT source, round(avg((n_chars > 2000)::INTEGER), 6) AS long_rate, round(avg((lang IS NULL)::INTEGER), 6) AS missing_rate, round(coalesce(avg(n_chars), 0), 6) AS mean_chars FROM documents WHERE n_chars IS NOT NULL GROUP BY source")
def document_rates(spark, d):
    return t(spark, d, "documents").where("n_chars is not null").groupBy("source").agg(F.round(F.avg((F.col("n_chars") > 2000).cast("int")), 6).alias("long_rate"), F.round(F.avg(F.col("lang").isNull().cast("int")), 6).alias("missing_rate"), F.round(F.coalesce(F.avg("n_chars"), F.lit(0.0)), 6).alias("mean_chars"))


@query("SELECT doc_id, max({'a': reviewed_at, 'b': reviewer, 'v': verdict}).v AS verdict FROM doc_reviews WHERE reviewed_at IS NOT NULL GROUP BY doc_id")
def last_checkpoints(spark, d):
    return t(spark, d, "doc_reviews").where("reviewed_at is not null").groupBy("doc_id").agg(F.max(F.struct("reviewed_at", "reviewer", "verdict"))["verdict"].alias("verdict"))


# ---- planning: packing, shares, batches

_BATCHES = f"WITH {LIVE_SQL}, b AS (SELECT context_id, list({{'o': occurred_at, 'e': event_id, 't': token_estimate}} ORDER BY occurred_at, event_id) AS x FROM live WHERE context_id <> '' AND token_estimate IS NOT NULL AND occurred_at IS NOT NULL GROUP BY context_id)"


def _estimated(spark, d):
    return L.live(t(spark, d, "ledger_events"), "context_id", "occurred_at", "token_estimate").where("context_id <> '' and token_estimate is not null and occurred_at is not null")


def _batches(spark, d):
    return _estimated(spark, d).groupBy("context_id").agg(F.array_sort(F.collect_list(F.struct("occurred_at", "event_id", "token_estimate"))).alias("x"))


@query(_BATCHES + " SELECT context_id, e.e AS event_id, bin::INTEGER AS bin FROM (WITH RECURSIVE f AS (SELECT context_id, 1 AS i, x[1].t AS used, 1 AS n, 0 AS bin FROM b UNION ALL SELECT f.context_id, f.i + 1, CASE WHEN f.used + b.x[f.i + 1].t > 400 OR f.n >= 8 THEN b.x[f.i + 1].t ELSE f.used + b.x[f.i + 1].t END, CASE WHEN f.used + b.x[f.i + 1].t > 400 OR f.n >= 8 THEN 1 ELSE f.n + 1 END, f.bin + (f.used + b.x[f.i + 1].t > 400 OR f.n >= 8)::INTEGER FROM f JOIN b USING (context_id) WHERE f.i < len(b.x)) SELECT f.context_id, b.x[f.i] AS e, f.bin FROM f JOIN b USING (context_id))")
def packed_tasks(spark, d):
    """Events of a context in order, next fit into calls of 400 tokens and eight sources. A context's events are bounded by its length (the largest has some hundred)."""
    rows = _batches(spark, d).withColumn("bin", X.next_fit(F.transform("x", lambda r: r["token_estimate"]), 400, 8))
    return rows.select("context_id", F.explode(F.arrays_zip(F.transform("x", lambda r: r["event_id"]).alias("event_id"), F.col("bin"))).alias("r")).select("context_id", "r.event_id", "r.bin")


@query(_BATCHES + ", n AS (SELECT context_id, x, (SELECT max(l) FROM range(0, 201) r(l) WHERE (SELECT sum(least(y.t, l)) FROM (SELECT unnest(x) AS y)) <= 200) AS level FROM b) SELECT context_id, sum(least(y.t, level))::BIGINT AS spent, max(least(y.t, level))::BIGINT AS level FROM (SELECT context_id, unnest(x) AS y, level FROM n) GROUP BY context_id")
def level_budgets(spark, d):
    """200 tokens of a context shared equally among its events; what a short one leaves goes to the rest."""
    return X.level_totals(_estimated(spark, d), "context_id", "token_estimate", 200)


@query("SELECT node_id, event_id, CASE WHEN place = 1 THEN 500 - 36 * (n - 1) ELSE 36 END AS budget FROM (SELECT node_id, event_id, row_number() OVER (PARTITION BY node_id ORDER BY event_id, start_rune, end_rune) AS place, count(*) OVER (PARTITION BY node_id) AS n FROM node_sources WHERE event_id IS NOT NULL)")
def budget_splits(spark, d):
    """The first source of a claim takes what the others' fixed shares leave of 500."""
    rows = t(spark, d, "node_sources").where("event_id is not null")
    w = W.partitionBy("node_id").orderBy("event_id", "start_rune", "end_rune")
    own = rows.withColumn("place", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy("node_id")).cast("int"))
    return own.select("node_id", "event_id", F.when(F.col("place") == 1, 500 - 36 * (F.col("n") - 1)).otherwise(36).alias("budget"))


@query("WITH l AS (SELECT event_id, max(length(content)) AS n FROM ledger_events WHERE content IS NOT NULL AND event_id IS NOT NULL GROUP BY event_id) SELECT event_id, (CASE WHEN n <= 64 THEN 6 ELSE ceil(log2(n)) END)::INTEGER AS bucket FROM l")
def length_buckets(spark, d):
    """Texts of about equal length together: a power of two each, so that padding at most doubles a batch."""
    own = t(spark, d, "ledger_events").where("content is not null and event_id is not null").groupBy("event_id").agg(F.max(F.length("content")).alias("n"))
    return own.select("event_id", F.when(F.col("n") <= 64, 6).otherwise(F.ceil(F.log2(F.col("n")))).cast("int").alias("bucket"))


@query("WITH m AS (SELECT node_id, count(*) AS missing FROM node_sources s WHERE NOT EXISTS (SELECT 1 FROM event_vectors v WHERE v.event_id = s.event_id) GROUP BY node_id) SELECT n.node_id, coalesce(m.missing, 0) AS missing, coalesce(m.missing, 0) = 0 AS ready FROM (SELECT DISTINCT node_id FROM memory_nodes) n LEFT JOIN m USING (node_id)")
def released_cases(spark, d):
    """Claims by how many of their sources still wait for a vector; those without any are released."""
    missing = t(spark, d, "node_sources").join(t(spark, d, "event_vectors").select("event_id"), "event_id", "left_anti").groupBy("node_id").agg(F.count("*").alias("missing"))
    return t(spark, d, "memory_nodes").select("node_id").distinct().join(missing, "node_id", "left").select("node_id", F.coalesce("missing", F.lit(0)).alias("missing"), F.col("missing").isNull().alias("ready"))


@query("SELECT space, context_id FROM (SELECT space, context_id, row_number() OVER (PARTITION BY space ORDER BY seen DESC, context_id) AS n FROM (SELECT space, context_id, max(created_at) AS seen FROM ledger_events WHERE context_id <> '' AND space <> '' AND created_at IS NOT NULL GROUP BY space, context_id)) WHERE n > 3")
def evicted_contexts(spark, d):
    """All but the three latest used contexts of each space."""
    used = t(spark, d, "ledger_events").where("context_id <> '' and space <> '' and created_at is not null").groupBy("space", "context_id").agg(F.max("created_at").alias("seen"))
    kept = S.ranked(used, "space", 3, F.desc("seen"), F.col("context_id"))
    return used.join(kept, ["space", "context_id"], "left_anti").select("space", "context_id")


@query(f"WITH {LIVE_SQL} SELECT l.event_id FROM live l WHERE l.occurred_at < {_AT} AND NOT EXISTS (SELECT 1 FROM node_sources s WHERE s.event_id = l.event_id)")
def uncommitted_events(spark, d):
    return L.live(t(spark, d, "ledger_events"), "occurred_at").where("occurred_at < timestamp '2022-01-06 00:00:00'").join(t(spark, d, "node_sources").select("event_id"), "event_id", "left_anti").select("event_id")


@query("SELECT job_id, lane, place FROM (SELECT event_id AS job_id, metadata['lane'] AS lane, row_number() OVER (ORDER BY (metadata['lane'] <> 'compile')::INTEGER, created_at, event_id)::INTEGER AS place FROM ledger_events WHERE metadata['lane'] IS NOT NULL AND semantic_status = 'pending') WHERE place <= 16")
def claimed_jobs(spark, d):
    """The next sixteen jobs, compile jobs first: a batch of fixed size."""
    rows = t(spark, d, "ledger_events").where("semantic_status = 'pending'").select(F.col("event_id").alias("job_id"), F.col("metadata")["lane"].alias("lane"), "created_at").where("lane is not null")
    top = rows.orderBy((F.col("lane") != "compile").cast("int"), "created_at", "job_id").limit(16)
    order = F.struct((F.col("lane") != "compile").cast("int").alias("a"), "created_at", "job_id", "lane")
    return top.agg(F.array_sort(F.collect_list(order)).alias("x")).select(F.posexplode("x").alias("i", "x")).select("x.job_id", "x.lane", (F.col("i") + 1).alias("place"))


@query(r"SELECT attribute_key, (3 * (contains(attribute_key, 'call'))::INTEGER + 3 * (contains(attribute_key, 'tool'))::INTEGER + (count_if(contains(lower(statement), 'call')) > 0)::INTEGER + (count_if(contains(lower(statement), 'tool')) > 0)::INTEGER)::INTEGER AS score FROM memory_nodes WHERE attribute_key IS NOT NULL GROUP BY attribute_key")
def keyword_ranking(spark, d):
    """Names that hold a keyword count three, texts that do one."""
    name = lambda k: 3 * F.contains("attribute_key", F.lit(k)).cast("int")
    rows = t(spark, d, "memory_nodes").where("attribute_key is not null").groupBy("attribute_key").agg(*(F.max(F.coalesce(F.contains(F.lower("statement"), F.lit(k)), F.lit(False)).cast("int")).alias(k) for k in ("call", "tool")))
    return rows.select("attribute_key", (name("call") + name("tool") + F.col("call") + F.col("tool")).alias("score"))


@query("WITH i AS (SELECT DISTINCT facet || '/' || attribute_key AS name FROM memory_nodes WHERE facet IS NOT NULL AND attribute_key IS NOT NULL), r AS (SELECT name, sum(length(name) + 1) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) AS used FROM i) SELECT name, used <= 600 AS listed FROM r")
def budgeted_listing(spark, d):
    """Names in order as far as a budget of characters goes; the rest only counts. Names are of a closed vocabulary."""
    rows = t(spark, d, "memory_nodes").where("facet is not null and attribute_key is not null").select(F.concat("facet", F.lit("/"), "attribute_key").alias("name"), F.lit(1).alias("one")).distinct()
    return V.running(V.parted(rows, "one", "name"), "one", ("name",), F.length("name") + 1, "used").select("name", (F.col("used") <= 600).alias("listed"))


@query(f"WITH {LIVE_SQL} SELECT event_id, '[' || coalesce(actor, '?') || '] ' || CASE WHEN length(content) > 80 THEN substr(content, 1, 80) || '...' ELSE content END AS recall FROM live WHERE content IS NOT NULL")
def recall_projection(spark, d):
    return L.live(t(spark, d, "ledger_events"), "actor", "content").where("content is not null").select("event_id", F.concat(F.lit("["), F.coalesce("actor", F.lit("?")), F.lit("] "), T.clamp(F.col("content"), 80)).alias("recall"))
