"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import neighbours as N
from threadloom.sources.tables import table


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "event_vectors")
    return N.nearest(vectors, vectors.count())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.pairs(_near(spark, sf_dir)).select(F.col("id_a").alias("event_id_a"), F.col("id_b").alias("event_id_b"))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select(F.col("id").alias("event_id"), F.posexplode("near").alias("rank", "n")).select("event_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("neighbour_id"), (F.col("n.cos") / F.lit(1e6)).alias("cosine"))


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours}
#: Brute force over all pairs (the forest has one leaf at sf0.01, where it is compared).
_NEAR = """WITH u AS (SELECT event_id, any_value(dense_fp16)::DOUBLE[] AS v FROM event_vectors WHERE event_id IS NOT NULL AND len(dense_fp16) = 128 AND NOT list_has_any(dense_fp16, ['nan'::FLOAT, 'inf'::FLOAT, '-inf'::FLOAT]) AND len(list_filter(dense_fp16, lambda x: x <> 0)) > 0 GROUP BY event_id),
p AS (SELECT a.event_id AS a, b.event_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM u a JOIN u b ON a.event_id <> b.event_id), n AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM p QUALIFY r <= 5) """
SQL = {
    "p3_found": _NEAR + "SELECT DISTINCT least(a, b) AS event_id_a, greatest(a, b) AS event_id_b FROM n",
    "p3_neighbours": _NEAR + "SELECT a AS event_id, r::INTEGER AS rank, b AS neighbour_id, c AS cosine FROM n",
}
