"""Further queries: text normalization."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.sources.tables import table as t

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(r"SELECT node_id, trim(regexp_replace(lower(statement), '[\s\p{Z}]+', ' ', 'g')) AS claim FROM memory_nodes WHERE statement IS NOT NULL")
def normalized_claims(spark, d):
    return t(spark, d, "memory_nodes").where("statement is not null").select("node_id", F.trim(F.regexp_replace(F.lower("statement"), r"[\s\p{Z}]+", " ")).alias("claim"))


@query(r"SELECT node_id, coalesce(nullif(trim(regexp_replace(lower(coalesce(subject_text, '')), '[^\p{L}\p{Nd}./@:+#]+', '-', 'g'), '-'), ''), 'default') AS key FROM memory_nodes")
def normalized_keys(spark, d):
    key = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("subject_text", F.lit(""))), r"[^\p{L}\p{Nd}./@:+#]+", "-"), "^-+|-+$", "")
    return t(spark, d, "memory_nodes").select("node_id", F.coalesce(F.nullif(key, F.lit("")), F.lit("default")).alias("key"))


@query("SELECT doc_id, CASE WHEN length(text) > 240 THEN substr(text, 1, 240) || '...' ELSE text END AS preview FROM documents WHERE text IS NOT NULL")
def clamped_texts(spark, d):
    return t(spark, d, "documents").where("text is not null").select("doc_id", F.when(F.length("text") > 240, F.concat(F.substring("text", 1, 240), F.lit("..."))).otherwise(F.col("text")).alias("preview"))
