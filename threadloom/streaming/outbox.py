"""Incremental work: a stream of arriving events into the ledger, windows of user turns, and the rules of the job queue.

Delivery is at least once, and what is written is idempotent: an event that the ledger has (by name space and checksum) is not
appended again, so a replayed batch changes nothing. State that a stream keeps is small: per session two numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from threadloom.operators import ledger as L

EVENT = "event_id string, space string, context_id string, session_id string, actor string, source_kind string, content string, occurred_at timestamp, source_ref string, metadata map<string,string>, created_at timestamp, tombstoned boolean"


def recovered(state: Column) -> Column:
    """A job's state after a stop: what was running is pending."""
    return F.when(state == "running", "pending").otherwise(state)


def after_failure(attempts: Column, permanent: Column, most: int = 2) -> Column:
    """A job's state after a failed attempt."""
    return F.when(permanent | (attempts >= most), "failed").otherwise("pending")


def overlay(index: DataFrame, events: DataFrame, most: int = 32) -> DataFrame:
    """``event_id, origin``: what a search sees: the index, and the latest events that are not in it yet."""
    known = index.select("event_id").where("event_id is not null").distinct()
    fresh = events.where("event_id is not null").groupBy("event_id").agg(F.max("created_at").alias("at")).join(known, "event_id", "left_anti").orderBy(F.desc("at"), "event_id").limit(most)
    return known.select("event_id", F.lit("index").alias("origin")).unionByName(fresh.select("event_id", F.lit("overlay").alias("origin")))


def arriving(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """A stream of the JSON lines that are put into a folder; lines that are no JSON become rows without an id and are left out."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).json(folder).where("event_id is not null")


def append_stream(events: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to the Parquet ledger at ``ledger`` until all that has arrived is in (``availableNow``)."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.schema(EVENT).parquet(ledger)
            known.limit(1).count()
        except Exception:  # noqa: BLE001 - the first batch of a new ledger
            known = spark.createDataFrame([], EVENT)
        own = batch.dropDuplicates(["event_id"])
        new = L.appended(known, own).select("event_id")
        own.join(new, "event_id", "left_semi").write.mode("append").parquet(ledger)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def turn_windows(events: DataFrame, size: int = 5) -> DataFrame:
    """``session_id, commit_no, first_turn, last_turn`` of a stream: a row as soon as a session has ``size`` more user turns. The state of a session is its turns and its windows so far."""

    def count(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        turns, done = state.get if state.exists else (0, 0)
        turns += sum(int(b["user"].sum()) for b in batches)
        out = []
        while turns - done * size >= size:
            out.append((key[0], done, done * size + 1, (done + 1) * size))
            done += 1
        state.update((turns, done))
        yield pd.DataFrame(out, columns=["session_id", "commit_no", "first_turn", "last_turn"])

    rows = events.where("session_id <> ''").select("session_id", F.coalesce(F.lower(F.trim("actor")).isin("user", "human"), F.lit(False)).cast("int").alias("user"))
    return rows.groupBy("session_id").applyInPandasWithState(count, "session_id string, commit_no bigint, first_turn bigint, last_turn bigint", "turns bigint, done bigint", "append", "NoTimeout")
