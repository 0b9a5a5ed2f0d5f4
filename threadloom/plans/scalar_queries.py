"""Queries of the scalar functions over the ledger, claims and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import hashing as H
from threadloom.functions import text as T
from threadloom.plans.registration import registered
from threadloom.sources.tables import table as t

QUERIES, SQL, query = registered()

_WS = r"[\s\x0b\x85\p{Z}]"


def _trim(c: str) -> str:
    return rf"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _key(c: str) -> str:
    return "trim(regexp_replace(lower(" + _trim(f"coalesce({c}, '')") + r"), '[^\p{L}\p{Nd}./@:+#]+', '-', 'g'), '-')"


def _claim(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '{_WS}+', ' ', 'g'))"


def _instant(c: str) -> str:
    return rf"coalesce(regexp_replace(regexp_replace(strftime({c}, '%Y-%m-%dT%H:%M:%S.%f'), '0+$', ''), '\.$', '') || 'Z', '')"


def _joined(sep: str, *parts: str) -> str:
    return f"concat_ws({sep}, " + ", ".join(f"coalesce({p}, '')" for p in parts) + ")"


@query(f"SELECT event_id, sha256({_joined('chr(0)', 'space', 'content')}) AS hash FROM ledger_events")
def content_hashes(spark, d):
    return t(spark, d, "ledger_events").select("event_id", H.content_hash(F.col("space"), F.col("content")).alias("hash"))


_META = "coalesce('{' || array_to_string(list_transform(list_sort(map_keys(metadata)), lambda k: '\"' || k || '\":\"' || metadata[k] || '\"'), ',') || '}', 'null')"
_SPACE = f"coalesce(nullif({_key('space')}, ''), 'default')"


@query(f"SELECT event_id, sha256({_joined('chr(0)', _SPACE, 'context_id', 'session_id', 'actor', 'source_kind', 'source_ref', _instant('occurred_at'), 'content', _META)}) AS checksum FROM ledger_events")
def event_checksums(spark, d):
    return t(spark, d, "ledger_events").select("event_id", H.event_checksum().alias("checksum"))


@query(f"SELECT event_id, sha256({_joined('chr(10)', 'token_estimate::VARCHAR', 'actor', 'content')}) AS hash FROM ledger_events")
def message_hashes(spark, d):
    return t(spark, d, "ledger_events").select("event_id", H.message_hash(F.col("token_estimate"), F.col("actor"), F.col("content")).alias("hash"))


@query(f"SELECT event_id, substr(sha256({_joined('chr(31)', 'event_id', 'session_id')}), 1, 32) AS hash FROM ledger_events")
def short_hashes(spark, d):
    return t(spark, d, "ledger_events").select("event_id", H.short_hash(F.col("event_id"), F.col("session_id")).alias("hash"))


@query(rf"SELECT DISTINCT source_ref, 'project:' || coalesce(nullif(regexp_replace(regexp_replace(replace(regexp_replace(lower({_trim('source_ref')}), '[^a-z0-9._/-]+', '-', 'g'), '/', '--'), '-{{3,}}', '-', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'default') AS name FROM ledger_events WHERE source_ref IS NOT NULL")
def project_spaces(spark, d):
    return t(spark, d, "ledger_events").where("source_ref is not null").select("source_ref", T.project_space(F.col("source_ref")).alias("name")).distinct()


@query("SELECT event_id, (length(content) // 4)::INTEGER AS tokens FROM ledger_events WHERE content IS NOT NULL")
def rough_token_estimates(spark, d):
    return t(spark, d, "ledger_events").where("content is not null").select("event_id", T.rough_tokens(F.col("content")).alias("tokens"))


@query(f"SELECT node_id, {_key(_joined(chr(39) + '|' + chr(39), 'space', 'context_id', 'subject_text', 'evidence_mode'))} AS scope FROM memory_nodes")
def scope_keys(spark, d):
    scope = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("space", "context_id", "subject_text", "evidence_mode")))
    return t(spark, d, "memory_nodes").select("node_id", T.normalize_key(scope).alias("scope"))


@query(f"SELECT node_id, CASE WHEN claim_type = 'state' THEN 'time:' || {_instant('valid_from')} WHEN claim_type = 'constraint' THEN 'list:' || array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(statement, ','), lambda x: {_claim('x')}), lambda x: x <> ''))), chr(31)) ELSE 'text:' || {_claim('statement')} END AS value_key FROM memory_nodes WHERE statement IS NOT NULL")
def claim_value_keys(spark, d):
    values = F.array_join(F.array_sort(T.normalized_list(F.split("statement", ","))), "\x1f")
    key = F.when(F.col("claim_type") == "state", F.concat(F.lit("time:"), H.instant(F.col("valid_from")))).when(F.col("claim_type") == "constraint", F.concat(F.lit("list:"), values)).otherwise(F.concat(F.lit("text:"), T.normalize_claim(F.col("statement"))))
    return t(spark, d, "memory_nodes").where("statement is not null").select("node_id", key.alias("value_key"))


def _sql_variants(x: str) -> str:
    """Token, singular and stems as a list with nulls."""
    n = f"length({x})"
    one = lambda s: f"(CASE WHEN right({s}, 1) = substr({s}, -2, 1) THEN left({s}, length({s}) - 1) ELSE {s} END)"
    stem = lambda s: f"(CASE WHEN length({s}) >= 3 AND {s} <> {x} THEN {s} END)"
    a2, a3 = f"left({x}, {n} - 2)", f"left({x}, {n} - 3)"
    singular = f"CASE WHEN {n} <= 4 THEN NULL WHEN {x} LIKE '%ies' AND {n} > 5 THEN {a3} || 'y' WHEN regexp_matches({x}, '(ses|xes|zes|ches|shes)$') THEN {a2} WHEN {x} LIKE '%s' AND {x} NOT LIKE '%ss' THEN left({x}, {n} - 1) END"
    y, e = f"({a3} || 'y')", f"({a3} || 'e')"
    d1 = f"left({x}, {n} - 1)"
    return f"list_concat([{x}, {singular}], CASE WHEN {n} <= 4 THEN [] WHEN {x} LIKE '%ied' AND {n} > 5 THEN [{stem(y)}] WHEN {x} LIKE '%ed' THEN [{stem(a2)}, {stem(one(a2))}, {stem(d1)}] WHEN {x} LIKE '%ing' THEN [{stem(a3)}, {stem(one(a3))}, {stem(e)}] ELSE [] END)"


def sql_query_tokens(c: str) -> str:
    own = rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{Nd}}_]+'), lambda x: x <> '' AND NOT regexp_matches(x, '^[a-z]$'))"
    return f"list_filter(flatten(list_transform({own}, lambda x: {_sql_variants('x')})), lambda x: x IS NOT NULL)"


@query(f"SELECT node_id, array_to_string(list_filter(q, lambda x, i: list_position(q, x) = i)[:32], ' ') AS tokens FROM (SELECT node_id, {sql_query_tokens('statement')} AS q FROM memory_nodes WHERE statement IS NOT NULL)")
def query_tokens(spark, d):
    return t(spark, d, "memory_nodes").where("statement is not null").select("node_id", F.array_join(T.query_tokens(F.col("statement"), 32), " ").alias("tokens"))


_STATEMENT_TOKENS = r"SELECT DISTINCT unnest(regexp_split_to_array(lower(statement), '[^\p{L}\p{Nd}_]+')) AS x FROM memory_nodes"


def _statement_tokens(spark, d):
    return t(spark, d, "memory_nodes").select(F.explode(F.split(F.lower("statement"), r"[^\p{L}\p{Nd}_]+")).alias("x")).distinct()


@query(f"SELECT x, ({_sql_variants('x')})[2] AS singular FROM ({_STATEMENT_TOKENS}) WHERE x <> ''")
def singular_tokens(spark, d):
    return _statement_tokens(spark, d).where("x <> ''").select("x", T.singular(F.col("x")).alias("singular"))


@query(f"SELECT x, array_to_string(list_filter(({_sql_variants('x')})[3:], lambda v: v IS NOT NULL), ' ') AS stems FROM ({_STATEMENT_TOKENS}) WHERE x <> ''")
def inflection_variants(spark, d):
    return _statement_tokens(spark, d).where("x <> ''").select("x", F.array_join(T.inflections(F.col("x")), " ").alias("stems"))


_LIT = rf"""list_filter(list_transform(list_concat(regexp_extract_all(statement, '["“”'']([^"“”'']{{2,}})["“”'']', 1), regexp_extract_all(statement, '(?:[A-Za-z]:)?(?:[/~.][^\s,，;；:：!?！？]+)+'),
 list_filter(regexp_extract_all(statement, '\b[a-zA-Z][a-zA-Z0-9_-]{{5,}}\b'), lambda x: regexp_matches(x, '[_0-9]')), CASE WHEN regexp_matches(trim({_trim('statement')}, '`'), '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') THEN [trim({_trim('statement')}, '`')] ELSE [] END), lambda x: {_claim('x')}), lambda x: x <> '')"""


@query(f"SELECT node_id, array_to_string(list_filter(q, lambda x, i: list_position(q, x) = i)[:8], '|') AS literals FROM (SELECT node_id, {_LIT} AS q FROM memory_nodes WHERE statement IS NOT NULL) WHERE len(q) > 0")
def query_literals(spark, d):
    return t(spark, d, "memory_nodes").where("statement is not null").select("node_id", T.literals(F.col("statement")).alias("q")).where(F.size("q") > 0).select("node_id", F.array_join("q", "|").alias("literals"))


@query(r"""SELECT node_id, array_to_string(list_transform(list_filter(regexp_split_to_array(lower(statement), '[^\p{L}\p{Nd}_]+'), lambda x: x <> '')[:12], lambda x: '"' || x || '"'), ' OR ') AS expression FROM memory_nodes WHERE statement IS NOT NULL""")
def fts_expressions(spark, d):
    return t(spark, d, "memory_nodes").where("statement is not null").select("node_id", T.fts_expression(F.slice(T.tokens(F.col("statement")), 1, 12)).alias("expression"))


@query(f"SELECT event_id, CASE WHEN length(x) <= 108 THEN x ELSE {_trim('substr(x, 1, 108)')} END AS text FROM (SELECT event_id, {_trim('content')} AS x FROM ledger_events WHERE content IS NOT NULL)")
def truncated_texts(spark, d):
    return t(spark, d, "ledger_events").where("content is not null").select("event_id", T.truncated(F.col("content"), 36).alias("text"))


@query(f"SELECT event_id, CASE WHEN length(x) <= 200 THEN x ELSE {_trim('substr(x, 1, 100)')} || chr(10) || '...' || chr(10) || {_trim('right(x, 95)')} END AS text FROM (SELECT event_id, {_trim('content')} AS x FROM ledger_events WHERE content IS NOT NULL)")
def head_tail_excerpts(spark, d):
    return t(spark, d, "ledger_events").where("content is not null").select("event_id", T.excerpt(F.col("content"), 200).alias("text"))


@query(f"SELECT event_id, CASE WHEN length(x) <= 120 THEN x ELSE {_trim('substr(x, 1, 60)')} || '...' || {_trim('right(x, 57)')} END AS text FROM (SELECT event_id, {_trim('content')} AS x FROM ledger_events WHERE content IS NOT NULL)")
def truncated_both_ends(spark, d):
    return t(spark, d, "ledger_events").where("content is not null").select("event_id", T.excerpt(F.col("content"), 120, "...").alias("text"))


@query("SELECT event_id, CASE WHEN length(content) <= 300 THEN content ELSE array_to_string(list_transform(string_split(content, chr(10)), lambda x: substr(x, 1, greatest(16, 300 // len(string_split(content, chr(10))))::INTEGER)), chr(10)) END AS text FROM ledger_events WHERE content IS NOT NULL")
def truncated_lines(spark, d):
    return t(spark, d, "ledger_events").where("content is not null").select("event_id", T.line_clamped(F.col("content"), 300).alias("text"))


@query("SELECT event_id, CASE WHEN length(content) <= 400 THEN content ELSE substr(content, 1, 200) || chr(10) || chr(10) || '... [' || (length(content) - 400) || ' characters truncated] ...' || chr(10) || chr(10) || right(content, 200) END AS text FROM ledger_events WHERE content IS NOT NULL")
def output_budgets(spark, d):
    return t(spark, d, "ledger_events").where("content is not null").select("event_id", T.hard_truncated(F.col("content"), 400).alias("text"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN format('{:d} B', n_chars) WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024.0) ELSE printf('%.1f MB', n_chars / 1048576.0) END AS size FROM documents WHERE n_chars IS NOT NULL")
def human_sizes(spark, d):
    return t(spark, d, "documents").where("n_chars is not null").select("doc_id", T.human_size(F.col("n_chars")).alias("size"))


@query("SELECT event_id, translate(content, '‘’‚‛“”„‟', '''''''''\"\"\"\"') AS text FROM ledger_events WHERE content IS NOT NULL")
def straight_quotes(spark, d):
    return t(spark, d, "ledger_events").where("content is not null").select("event_id", T.straight_quotes(F.col("content")).alias("text"))


def _sql_redacted(c: str) -> str:
    for p in T.SECRETS:
        q = p.replace(r"\t\n\f\r ", r"\s")
        found = f"list_sort(list_distinct(regexp_extract_all({c}, '{q}')))"
        c = f"list_reduce(list_prepend({c}, list_reverse({found})), lambda a, s: replace(a, s, repeat('*', length(s))))"
    return c


@query(f"SELECT node_id, {_sql_redacted('x')} AS text FROM (SELECT node_id, statement || ' password=' || node_id || '; bearer ' || node_id || ' and sk-' || node_id AS x FROM memory_nodes WHERE statement IS NOT NULL)")
def redacted_secrets(spark, d):
    made = F.concat("statement", F.lit(" password="), "node_id", F.lit("; bearer "), "node_id", F.lit(" and sk-"), "node_id")  # the tables have no secrets
    return t(spark, d, "memory_nodes").where("statement is not null").select("node_id", T.redact_secrets(made).alias("text"))


@query(rf"SELECT event_id, len(list_filter(list_transform(string_split(regexp_replace(content, '([.!?。！？；\n]+)', '\1' || chr(1), 'g'), chr(1)), lambda x: {_trim('x')}), lambda x: x <> '')) AS n, (list_filter(list_transform(string_split(regexp_replace(content, '([.!?。！？；\n]+)', '\1' || chr(1), 'g'), chr(1)), lambda x: {_trim('x')}), lambda x: x <> ''))[1] AS first FROM ledger_events WHERE content IS NOT NULL")
def sentence_splits(spark, d):
    return t(spark, d, "ledger_events").where("content is not null").select("event_id", T.sentences(F.col("content")).alias("s")).select("event_id", F.size("s").cast("bigint").alias("n"), F.get("s", F.lit(0)).alias("first"))


@query(f"SELECT event_id, regexp_replace(actor, '^{_WS}+|{_WS}+$', '', 'g') || ': ' || {_trim('content')} || chr(10) AS part FROM ledger_events WHERE actor IS NOT NULL AND {_trim('content')} <> ''")
def chunk_part_texts(spark, d):
    text = T.utrim(F.col("content"))
    return t(spark, d, "ledger_events").where("actor is not null").where(text != "").select("event_id", F.concat(T.utrim(F.col("actor")), F.lit(": "), text, F.lit("\n")).alias("part"))


@query("SELECT node_id, event_id, s AS start_rune, CASE WHEN end_rune > n AND end_rune - n <= 16 THEN n ELSE end_rune END AS end_rune, s < 0 OR (end_rune > n AND end_rune - n > 16) OR least(end_rune, n) <= s AS invalid FROM (SELECT x.node_id, x.event_id, x.start_rune AS s, x.end_rune, e.n FROM node_sources x JOIN (SELECT event_id, max(length(content))::INTEGER AS n FROM ledger_events WHERE content IS NOT NULL GROUP BY event_id) e USING (event_id))")
def clamped_spans(spark, d):
    size = t(spark, d, "ledger_events").where("content is not null").groupBy("event_id").agg(F.max(F.length("content")).alias("n"))
    rows = t(spark, d, "node_sources").join(size, "event_id")
    over = (F.col("end_rune") > F.col("n")) & (F.col("end_rune") - F.col("n") <= 16)
    bad = (F.col("start_rune") < 0) | ((F.col("end_rune") > F.col("n")) & ~over) | (F.least("end_rune", "n") <= F.col("start_rune"))
    return rows.select("node_id", "event_id", "start_rune", F.when(over, F.col("n")).otherwise(F.col("end_rune")).alias("end_rune"), bad.alias("invalid"))


@query(r"WITH e AS (SELECT event_id, max(content) AS content FROM ledger_events GROUP BY event_id) SELECT n.node_id, bool_or(contains(lower(substr(e.content, s.start_rune + 1, s.end_rune - s.start_rune)), k)) AS grounded FROM (SELECT DISTINCT node_id, regexp_extract(statement, '\d+') AS k FROM memory_nodes WHERE regexp_extract(statement, '\d+') <> '') n JOIN node_sources s USING (node_id) JOIN e USING (event_id) WHERE s.start_rune >= 0 AND s.end_rune > s.start_rune AND s.end_rune <= length(e.content) GROUP BY n.node_id")
def number_grounding(spark, d):
    from threadloom.operators.claims import grounded_numbers

    return grounded_numbers(t(spark, d, "memory_nodes"), t(spark, d, "node_sources"), t(spark, d, "ledger_events"))


@query("SELECT DISTINCT day, day || CASE WHEN day % 100 BETWEEN 11 AND 13 THEN 'th' WHEN day % 10 = 1 THEN 'st' WHEN day % 10 = 2 THEN 'nd' WHEN day % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal FROM (SELECT dayofmonth(created_at)::INTEGER AS day FROM ledger_events WHERE created_at IS NOT NULL)")
def ordinals(spark, d):
    return t(spark, d, "ledger_events").where("created_at is not null").select(F.dayofmonth("created_at").alias("day")).distinct().select("day", T.ordinal(F.col("day")).alias("ordinal"))


@query("SELECT node_id, lower(strftime(valid_from, '%B')) || ' ' || dayofmonth(valid_from) || ', ' || year(valid_from) AS first, CASE WHEN coalesce(year(valid_from) = year(created_at) - (make_timestamp(year(created_at), month(valid_from), dayofmonth(valid_from), 0, 0, 0.0) > created_at::TIMESTAMP + INTERVAL 1 DAY)::INTEGER, false) THEN 21 ELSE 12 END AS forms, CASE WHEN coalesce(year(valid_from) = year(created_at) - (make_timestamp(year(created_at), month(valid_from), dayofmonth(valid_from), 0, 0, 0.0) > created_at::TIMESTAMP + INTERVAL 1 DAY)::INTEGER, false) THEN month(valid_from) || '月' || dayofmonth(valid_from) || '日' ELSE year(valid_from) || '年' || month(valid_from) || '月' || dayofmonth(valid_from) || '日' END AS last FROM memory_nodes WHERE valid_from IS NOT NULL AND NOT (month(valid_from) = 2 AND dayofmonth(valid_from) = 29)")
def date_grounding_forms(spark, d):
    forms = T.date_forms(F.col("valid_from"), F.col("created_at"))
    return t(spark, d, "memory_nodes").where("valid_from is not null and not (month(valid_from) = 2 and day(valid_from) = 29)").select("node_id", forms.alias("f")).select("node_id", F.get("f", F.lit(0)).alias("first"), F.size("f").alias("forms"), F.element_at("f", -1).alias("last"))


@query("SELECT node_id, facet, CASE WHEN facet = 'preference' THEN 'preference' WHEN facet = 'constraint' THEN 'constraint' WHEN facet IN ('state', 'configuration', 'location', 'goal', 'procedure-state') THEN 'state' ELSE 'fact' END AS claim_type FROM memory_nodes")
def facet_claim_types(spark, d):
    from threadloom.operators.claims import claim_type

    return t(spark, d, "memory_nodes").select("node_id", "facet", claim_type(F.col("facet")).alias("claim_type"))


_ANSWER = r"trim(regexp_replace(regexp_replace(lower({0}), '\b([0-9]+)(?:st|nd|rd|th)\b', '\1', 'g'), '[^a-z0-9一-龥]+', ' ', 'g'))"


@query(f"SELECT event_id, {_ANSWER.format(_trim('content'))} AS answer FROM ledger_events WHERE content IS NOT NULL")
def normalized_answers(spark, d):
    return t(spark, d, "ledger_events").where("content is not null").select("event_id", T.normalize_answer(F.col("content")).alias("answer"))


@query(f"""WITH p AS (SELECT DISTINCT n.node_id, s.event_id, {_ANSWER.format(_trim('n.statement'))} AS e, {_ANSWER.format(_trim('l.content'))} AS h FROM memory_nodes n JOIN node_sources s USING (node_id) JOIN (SELECT event_id, max(content) AS content FROM ledger_events GROUP BY event_id) l ON l.event_id = s.event_id WHERE n.statement IS NOT NULL AND l.content IS NOT NULL),
w AS (SELECT *, list_filter(string_split(e, ' '), lambda x: x <> '' AND NOT list_contains({list(T.STOPWORDS)}, x)) AS w FROM p), c AS (SELECT *, len(list_filter(w, lambda x: list_contains(string_split(h, ' '), x))) AS hits FROM w)
SELECT node_id, event_id, CASE WHEN e = '' THEN false WHEN contains(' ' || h || ' ', ' ' || e || ' ') THEN true WHEN len(w) = 0 THEN false WHEN len(w) <= 2 THEN hits = len(w) ELSE hits / len(w) >= 0.6 END AS matched FROM c""")
def loose_matches(spark, d):
    texts = t(spark, d, "ledger_events").groupBy("event_id").agg(F.max("content").alias("content")).where("content is not null")
    rows = t(spark, d, "memory_nodes").where("statement is not null").select("node_id", T.normalize_answer(F.col("statement")).alias("e")).join(t(spark, d, "node_sources").select("node_id", "event_id"), "node_id").join(texts, "event_id")
    return rows.select("node_id", "event_id", "e", T.normalize_answer(F.col("content")).alias("h")).distinct().select("node_id", "event_id", T.loose_match(F.col("h"), F.col("e")).alias("matched"))


@query(f"SELECT event_id, regexp_matches({_ANSWER.format(_trim('content'))}, '{'|'.join(T.UNCERTAIN)}|no answer') AS uncertain FROM ledger_events WHERE content IS NOT NULL")
def uncertain_answers(spark, d):
    a = T.normalize_answer(F.col("content"))
    return t(spark, d, "ledger_events").where("content is not null").select("event_id", (T.uncertain(a) | a.contains("no answer")).alias("uncertain"))


@query(r"SELECT context_id, CASE WHEN bool_or(regexp_matches(content, '\p{Han}')) THEN 'han' ELSE 'latin' END || '-' || CASE WHEN sum(length(content)) > 1200 THEN 'long' WHEN sum(length(content)) > 500 THEN 'medium' ELSE 'short' END || '-' || count(*) AS class FROM ledger_events WHERE content IS NOT NULL AND context_id IS NOT NULL GROUP BY context_id")
def task_classes(spark, d):
    rows = t(spark, d, "ledger_events").where("content is not null and context_id is not null").select("context_id", F.length("content").alias("n"), F.col("content").rlike(r"\p{IsHan}").alias("han"))
    size = F.when(F.sum("n") > 1200, "long").when(F.sum("n") > 500, "medium").otherwise("short")
    return rows.groupBy("context_id").agg(F.concat_ws("-", F.when(F.bool_or("han"), "han").otherwise("latin"), size, F.count("*").cast("string")).alias("class"))


@query("SELECT node_id, strptime(strftime(valid_from, '%Y/%m/%d %H:%M'), '%Y/%m/%d %H:%M') AS at, date_trunc('day', valid_from::TIMESTAMP) + INTERVAL 86399 SECOND AS end_of_day FROM memory_nodes WHERE valid_from IS NOT NULL")
def parsed_dates(spark, d):
    text = F.when(F.pmod(F.hash("node_id"), F.lit(2)) == 0, F.date_format("valid_from", "yyyy/MM/dd (EEE) HH:mm")).otherwise(F.date_format("valid_from", "yyyy/MM/dd HH:mm"))  # two of the spellings
    at = F.coalesce(F.try_to_timestamp(F.regexp_replace(text, r" \(\w{3}\)", ""), F.lit("yyyy/MM/dd HH:mm")), F.try_to_timestamp(text))
    return t(spark, d, "memory_nodes").where("valid_from is not null").select("node_id", at.cast("timestamp_ntz").alias("at"), (F.date_trunc("day", at) + F.expr("interval 86399 seconds")).cast("timestamp_ntz").alias("end_of_day"))


_URL = r"'HTTPS://Example.org/' || node_id || '/?utm_source=x&b=' || facet || '&a=1#' || status"


@query("SELECT node_id, 'https://example.org/' || node_id || '?a=1&b=' || facet AS url FROM memory_nodes WHERE facet IS NOT NULL AND status IS NOT NULL")
def canonical_urls(spark, d):
    made = F.concat(F.lit("HTTPS://Example.org/"), "node_id", F.lit("/?utm_source=x&b="), "facet", F.lit("&a=1#"), "status")  # the tables have no addresses
    return t(spark, d, "memory_nodes").where("facet is not null and status is not null").select("node_id", T.canonical_url(made).alias("url"))


@query(rf"SELECT node_id, slot_id, CASE WHEN a = b THEN 1.0 WHEN len(x) = 0 THEN 0.0 ELSE round(len(list_filter(x, lambda w: list_contains(y, w))) / greatest(len(x), len(list_distinct(y))), 6) END::DOUBLE AS similarity FROM (SELECT node_id, slot_id, a, b, list_filter(regexp_split_to_array(a, '{_WS}+'), lambda w: w <> '') AS x, list_filter(regexp_split_to_array(b, '{_WS}+'), lambda w: w <> '') AS y FROM (SELECT DISTINCT node_id, slot_id, statement AS a, subject_text || ' ' || attribute_key || ' the ' || facet AS b FROM memory_nodes) WHERE a IS NOT NULL AND b IS NOT NULL)")
def line_similarities(spark, d):
    rows = t(spark, d, "memory_nodes").select("node_id", "slot_id", F.col("statement").alias("a"), F.concat("subject_text", F.lit(" "), "attribute_key", F.lit(" the "), "facet").alias("b")).distinct().where("a is not null and b is not null")
    return rows.select("node_id", "slot_id", F.round(T.line_similarity(F.col("a"), F.col("b")), 6).cast("double").alias("similarity"))


@query("""WITH p AS (SELECT DISTINCT lower(facet) AS a, lower(attribute_key) AS b FROM memory_nodes WHERE facet IS NOT NULL AND attribute_key IS NOT NULL),
s AS (SELECT a, b, (SELECT coalesce(max(i), 0) FROM range(1, 60) r(i) WHERE i <= least(length(a), length(b)) AND left(a, i) = left(b, i)) AS same, list_distinct(string_split(a, '')) AS x, list_distinct(string_split(b, '')) AS y FROM p)
SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE round(same / greatest(length(a), length(b)) * 0.6 + len(list_intersect(x, y)) / greatest(len(x), len(y), 1) * 0.4, 6) END::DOUBLE AS similarity FROM s""")
def name_similarities(spark, d):
    rows = t(spark, d, "memory_nodes").select(F.lower("facet").alias("a"), F.lower("attribute_key").alias("b")).where("a is not null and b is not null").distinct()
    return rows.select("a", "b", F.round(T.name_similarity(F.col("a"), F.col("b")), 6).cast("double").alias("similarity"))


@query("SELECT context_id, array_to_string(list_sort(list_distinct(list(source_kind))), ',') AS kinds, len(list_distinct(list(source_kind)))::INTEGER AS n FROM ledger_events WHERE source_kind IS NOT NULL GROUP BY context_id")
def sorted_distinct_kinds(spark, d):
    own = t(spark, d, "ledger_events").where("source_kind is not null").groupBy("context_id").agg(F.array_sort(F.collect_set("source_kind")).alias("k"))
    return own.select("context_id", F.array_join("k", ",").alias("kinds"), F.size("k").alias("n"))


@query(f"SELECT node_id, array_to_string(list_filter(q, lambda x, i: list_position(q, x) = i), '|') AS parts, array_to_string(list_filter(q, lambda x, i: list_position(q, x) = i)[:3], '|') AS first FROM (SELECT node_id, list_filter(list_transform(string_split(lower(statement), ' '), lambda x: {_trim('x')}), lambda x: x <> '') AS q FROM memory_nodes WHERE statement IS NOT NULL)")
def ordered_distinct_words(spark, d):
    words = F.split(F.lower("statement"), " ")
    return t(spark, d, "memory_nodes").where("statement is not null").select("node_id", F.array_join(T.ordered_distinct(words), "|").alias("parts"), F.array_join(T.normalized_list(words, 3), "|").alias("first"))


@query(r"""WITH w AS (SELECT DISTINCT node_id, slot_id, list_distinct(list_filter(regexp_split_to_array(lower(statement), '[^\p{L}\p{Nd}_]+'), lambda x: x <> '')) AS w FROM memory_nodes WHERE statement IS NOT NULL AND slot_id IS NOT NULL)
SELECT a.node_id AS a, b.node_id AS b, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) END::DOUBLE AS jaccard, list_has_any(a.w, b.w) AS overlap, array_to_string(list_sort(list_filter(a.w, lambda x: NOT list_contains(b.w, x))), ' ') AS only_a FROM w a JOIN w b ON a.slot_id = b.slot_id AND a.node_id < b.node_id""")
def slot_overlaps(spark, d):
    """Word sets of the claims of a slot against each other: a slot has few versions."""
    rows = t(spark, d, "memory_nodes").where("statement is not null and slot_id is not null").select("node_id", "slot_id", F.array_sort(F.array_distinct(T.tokens(F.col("statement")))).alias("w")).distinct()
    a, b = rows.select(F.col("node_id").alias("a"), "slot_id", F.col("w").alias("x")), rows.select(F.col("node_id").alias("b"), "slot_id", F.col("w").alias("y"))
    return a.join(b, "slot_id").where("a < b").select("a", "b", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.arrays_overlap("x", "y").alias("overlap"), F.array_join(F.array_sort(F.array_except("x", "y")), " ").alias("only_a"))
