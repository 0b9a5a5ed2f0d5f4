"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import splitting as S
from threadloom.sources.tables import table


def _split(spark: SparkSession, sf_dir: str, with_texts: bool = True) -> tuple[DataFrame, int]:
    limit = table(spark, sf_dir, "size_limits").where("limit_name = 'semantic_chunk'").first()
    return S.split_ranges(table(spark, sf_dir, "event_vectors"), limit["capacity_tokens"], limit["overlap_tokens"], with_texts=with_texts), limit["capacity_tokens"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole splitting without the pieces' texts: ranges with halos are cut, and their pieces and stretches stitched."""
    split, capacity = _split(spark, sf_dir, False)
    return S.cut_kinds(split, capacity).select(F.col("id").alias("event_id"), "cut_kind")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pieces(_split(spark, sf_dir)[0]).withColumnRenamed("id", "event_id")


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
SQL = {
    "p4_found": r"""
WITH t AS (SELECT event_id, max(regexp_replace(content, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g')) AS text FROM event_vectors WHERE event_id IS NOT NULL GROUP BY event_id),
o AS (SELECT * FROM t WHERE length(text) > 3 * (SELECT capacity_tokens FROM size_limits WHERE limit_name = 'semantic_chunk'))
SELECT event_id, CASE WHEN ceil(list_max(list_transform(regexp_extract_all(text, '[^\s\p{Z}\x{85}。！？；]+[。！？；]?'), lambda x: length(x))) / 3.0) > (SELECT capacity_tokens FROM size_limits WHERE limit_name = 'semantic_chunk') THEN 'forced' ELSE 'natural' END AS cut_kind
FROM o
""",
}
