"""The ledger: scans, idempotent append, upserts, deletes, digests, upkeep of derived tables.

Every step is a join or an aggregate on the tables' keys; what a stream appends goes through the same functions
(``threadloom.streaming.outbox``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.hashing import event_checksum
from threadloom.functions.text import clean_key

#: Hex digits of the buckets of a digest: each bucket is hashed on its own, then the buckets' digests.
BUCKET = 3


def live(events: DataFrame, *columns: str) -> DataFrame:
    """The counted delivery of each event (latest ``created_at``, then the greatest row) that is not tombstoned, as one aggregate without a sort of whole rows."""
    best = events.where("event_id is not null").groupBy("event_id").agg(F.max(F.struct(F.coalesce("created_at", F.timestamp_seconds(F.lit(-(10**10)))).alias("_at"), F.coalesce("session_id", F.lit("")).alias("_s"), F.coalesce("content", F.lit("")).alias("_c"), F.coalesce("tombstoned", F.lit(False)).alias("_t"), *columns)).alias("b"))
    return best.where("not b._t").select("event_id", *(F.col(f"b.{c}").alias(c) for c in columns))


def digest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``n, digest``: one hash of all (key, value) pairs whatever their order. Buckets of keys are hashed first, so no task sees all rows."""
    own = rows.select(F.substring(F.sha2(F.col(key), 256), 1, BUCKET).alias("bucket"), F.concat(F.col(key), F.lit("\0"), F.coalesce(F.col(value), F.lit("")), F.lit("\0")).alias("x"))
    per = own.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("x")), ""), 256).alias("h"))
    return per.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda b: b["h"]), ""), 256).alias("digest"))


def appended(existing: DataFrame, arriving: DataFrame) -> DataFrame:
    """Of the arriving events those that the ledger has not: one per (space, checksum), the smallest id."""
    known = existing.select("space", event_checksum().alias("checksum")).distinct()
    own = arriving.withColumn("checksum", event_checksum()).groupBy("space", "checksum").agg(F.min("event_id").alias("event_id"))
    same = (own["checksum"] == known["checksum"]) & own["space"].eqNullSafe(known["space"])
    return own.join(known, same, "left_anti").select("event_id", "space", "checksum")


def upserted_contexts(log: DataFrame) -> DataFrame:
    """One row per context: for each field the last value that is not empty, by ``ledger_seq``."""
    fields = [c for c in log.columns if c not in ("context_id", "ledger_seq")]

    def last(c: str) -> Column:
        there = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        return F.max(F.when(there, F.struct("ledger_seq", F.col(c).alias("v"))))["v"].alias(c)

    return log.withColumn("context_id", clean_key(F.col("context_id"))).where("context_id is not null").groupBy("context_id").agg(*(last(c) for c in fields))


def upserted(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of the base replaced by the latest change of their key; changes without a base row are added."""
    columns = [c for c in base.columns if c != key]
    new = changes.groupBy(key).agg(F.max(F.struct(order, *(c for c in columns if c != order))).alias("n"))
    old = base.groupBy(key).agg(F.max(F.struct(order, *(c for c in columns if c != order))).alias("o"))
    return old.join(new, key, "full").select(key, *(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns))


def changed(index: DataFrame, events: DataFrame) -> DataFrame:
    """``event_id, checksum`` of the events that the index (``event_id, checksum``) has not in this form."""
    return events.select("event_id", "checksum").join(index.select("event_id", "checksum"), ["event_id", "checksum"], "left_anti")


def stale(index: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Index rows whose key is no longer active."""
    return index.join(active.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def readiness(index: DataFrame, events: DataFrame) -> DataFrame:
    """``indexed, expected, missing, stale, ready`` of an index by ``event_id, checksum``."""
    both = events.select("event_id", F.col("checksum").alias("c")).join(index.select("event_id", F.col("checksum").alias("i")), "event_id", "full")
    return both.agg(F.count("i").alias("indexed"), F.count("c").alias("expected"), F.count_if(F.col("i").isNull()).alias("missing"), F.count_if(F.col("c").isNull() | (F.col("i") != F.col("c"))).alias("stale")).withColumn("ready", (F.col("missing") == 0) & (F.col("stale") == 0))


def advanced(events: DataFrame, allowed: tuple[str, ...], status: str) -> DataFrame:
    """``event_id, semantic_status`` with a guarded transition: only rows in an allowed state move."""
    return events.select("event_id", F.when(F.col("semantic_status").isin(*allowed), status).otherwise(F.col("semantic_status")).alias("semantic_status"))


def orphans(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows whose owner is not there."""
    return rows.join(owners.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def health(events: DataFrame, nodes: DataFrame, sources: DataFrame, vectors: DataFrame) -> DataFrame:
    """``check_name, n``: counts that show the state of the ledger and what is derived from it."""
    named = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")
    ids = events.select("event_id").where("event_id is not null")
    checks = (
        named(ids.distinct(), "events"),
        named(events.where("coalesce(tombstoned, false)").select("event_id").distinct(), "tombstoned_events"),
        named(events.where("semantic_status = 'pending'").select("event_id").distinct(), "pending_events"),
        named(nodes.where("status = 'pending'").select("node_id").distinct(), "pending_nodes"),
        named(nodes.where("status = 'quarantined'").select("node_id").distinct(), "quarantined_nodes"),
        named(orphans(sources, events, "event_id"), "orphan_sources"),
        named(orphans(vectors, events, "event_id"), "orphan_vectors"),
        named(orphans(ids.distinct(), vectors, "event_id"), "events_without_vector"),
    )
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
