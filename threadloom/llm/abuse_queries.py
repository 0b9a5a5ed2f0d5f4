"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import abuse as A
from threadloom.sources.tables import table


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_reviews"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).where("score > 0.5").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rates(_scores(spark, sf_dir))


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
SQL: dict[str, str] = {}
