"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import packing as P
from threadloom.sources.tables import table


def _capacity(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "size_limits").where("limit_name = 'context_window'").first()["capacity_tokens"]


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = _capacity(spark, sf_dir)
    return P.packed(P.items(table(spark, sf_dir, "documents"), capacity), capacity)


def p6_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fills(p6_pack(spark, sf_dir), _capacity(spark, sf_dir))


QUERIES = {"p6_pack": p6_pack, "p6_fills": p6_fills}
SQL: dict[str, str] = {}
