"""Queries of problem 5: hierarchies of ``contexts``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import hierarchy as H
from threadloom.sources.tables import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.cycles(table(spark, sf_dir, "contexts"))


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = H.hierarchy(table(spark, sf_dir, "contexts"))
    return tree.select("context_id", "parent_id", "root_id", "depth", F.array_join("path", "/").alias("path"), "n_descendants", "cycle_id")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.descendants(H.hierarchy(table(spark, sf_dir, "contexts")))


_PARENTS = r"""
WITH RECURSIVE raw AS (
  SELECT nullif(lower(regexp_replace(context_id, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g')), '') AS context_id,
         nullif(lower(regexp_replace(parent_id, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g')), '') AS parent_id,
         ledger_seq
  FROM contexts
), kept AS (
  SELECT context_id, (max({'seq': ledger_seq, 'p': parent_id}) FILTER (WHERE parent_id IS NOT NULL)).p AS parent_id
  FROM raw WHERE context_id IS NOT NULL GROUP BY context_id
), parents AS (
  SELECT k.context_id, o.context_id AS parent_id FROM kept k LEFT JOIN kept o ON k.parent_id = o.context_id
), tree AS (
  SELECT context_id, parent_id, context_id AS root_id, 0 AS depth, context_id AS path FROM parents WHERE parent_id IS NULL
  UNION ALL
  SELECT c.context_id, c.parent_id, t.root_id, t.depth + 1, t.path || '/' || c.context_id FROM parents c JOIN tree t ON c.parent_id = t.context_id
), lost AS (
  SELECT * FROM parents WHERE context_id NOT IN (SELECT context_id FROM tree)
), reach AS (
  SELECT context_id AS origin, parent_id AS node FROM lost
  UNION
  SELECT r.origin, l.parent_id FROM reach r JOIN lost l ON r.node = l.context_id
), cycles AS (
  SELECT r.origin AS context_id, min(r.node) AS cycle_id FROM reach r JOIN (SELECT origin FROM reach WHERE origin = node) o ON r.node = o.origin GROUP BY r.origin
)
"""

SQL = {
    "p5_found": _PARENTS + "SELECT context_id, cycle_id FROM cycles",
    "p5_hierarchy": _PARENTS + ", above AS (SELECT unnest(string_split(path, '/')) AS context_id FROM tree), below AS (SELECT context_id, count(*) - 1 AS n FROM above GROUP BY context_id) SELECT t.context_id, t.parent_id, t.root_id, t.depth, t.path, b.n AS n_descendants, NULL::VARCHAR AS cycle_id FROM tree t JOIN below b USING (context_id) UNION ALL SELECT l.context_id, l.parent_id, NULL, NULL, NULL, NULL, c.cycle_id FROM lost l JOIN cycles c USING (context_id)",
    "p5_descendants": _PARENTS + ", up AS (SELECT context_id AS descendant_id, depth, unnest(string_split(path, '/')) AS context_id, generate_subscripts(string_split(path, '/'), 1) - 1 AS idx FROM tree) SELECT context_id, descendant_id, (depth - idx)::INTEGER AS distance FROM up WHERE idx < depth",
}

QUERIES = {"p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_descendants": p5_descendants}
