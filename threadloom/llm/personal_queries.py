"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import personal as P
from threadloom.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.spans(table(spark, sf_dir, "ledger_events"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.redacted(table(spark, sf_dir, "ledger_events"))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
SQL: dict[str, str] = {}
