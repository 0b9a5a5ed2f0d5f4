"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import mixing as M
from threadloom.sources.tables import table


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
