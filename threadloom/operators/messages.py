"""Chat messages as rows: filters, tool pairs, merging, compaction.

A conversation may be of any length, so messages stay rows; what depends on their order uses ``threadloom.operators.windows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import rough_tokens, snipped, utrim
from threadloom.operators import windows as V

ORDER = ("occurred_at", "event_id")


def messages(events: DataFrame) -> DataFrame:
    """``session_id, event_id, occurred_at, role, kind, tool_id, lane, tag, text`` of live events with a session and a time; tools' and commands' output are ``tool_result`` blocks."""
    role = F.lower(utrim(F.col("actor")))
    kind = F.when(F.col("source_kind").isin("tool", "command"), "tool_result").otherwise("text")
    rows = events.where("session_id <> '' and occurred_at is not null and content is not null")
    return rows.select("session_id", "event_id", "occurred_at", role.alias("role"), kind.alias("kind"), F.col("source_ref").alias("tool_id"), "lane", "tag", F.col("content").alias("text"))


def transient(lane: Column, lanes: tuple[str, ...] = ("embed",)) -> Column:
    """Messages that only serve the machine."""
    return F.coalesce(lane.isin(*lanes), F.lit(False))


def real_request(role: Column, kind: Column) -> Column:
    """A user's own message, not the result of a tool."""
    return F.coalesce(role.isin("user", "human"), F.lit(False)) & (kind != "tool_result")


def paired(uses: DataFrame, results: DataFrame) -> DataFrame:
    """``tool_id, uses, results, state``: calls and results by their id, also those that lack the other."""
    a = uses.where("tool_id is not null").groupBy("tool_id").agg(F.count("*").alias("uses"))
    b = results.where("tool_id is not null").groupBy("tool_id").agg(F.count("*").alias("results"))
    both = a.join(b, "tool_id", "full").select("tool_id", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("results", F.lit(0)).alias("results"))
    return both.withColumn("state", F.when(F.col("uses") == 0, "orphan result").when(F.col("results") == 0, "unanswered").otherwise("paired"))


def merged(rows: DataFrame) -> DataFrame:
    """``session_id, exchange, n, text``: unbroken runs of one role as one message. A run is as long as one speaker goes on."""
    runs = V.islands(V.parted(rows, "session_id", *ORDER), "session_id", ORDER, "role", "exchange")
    own = runs.groupBy("session_id", "exchange").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*ORDER, "text"))).alias("x"))
    return own.select("session_id", "exchange", "n", F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("text"))


def first_open_span(rows: DataFrame, covered: str, least: int = 3) -> DataFrame:
    """``session_id, from_place, n``: the first unbroken run of at least ``least`` rows that are not covered, by place (from 1) in the session."""
    placed = V.running(V.parted(rows, "session_id", *ORDER), "session_id", ORDER, F.lit(1), "place")
    runs = V.islands(V.parted(placed.drop("_part"), "session_id", *ORDER), "session_id", ORDER, covered, "run").where(~F.col(covered))
    spans = runs.groupBy("session_id", "run").agg(F.min("place").alias("from_place"), F.count("*").alias("n")).where(F.col("n") >= least)
    return spans.groupBy("session_id").agg(F.min(F.struct("from_place", "n")).alias("s")).select("session_id", "s.from_place", "s.n")


def compacted(rows: DataFrame, limit: int, keep: int = 10, cleared: str = "[cleared]") -> DataFrame:
    """``session_id, event_id, level, text``: messages within ``limit`` tokens a session, by the first level that reaches it.

    0: as they are; 1: tools' noise cut; 2: all tool results but the newest cleared; 3: all but the last ``keep`` messages left out. What each
    level would cost is summed for all at once, so a session is never gathered.
    """
    parts = V.parted(rows, "session_id", *ORDER)
    total = rows.groupBy("session_id").agg(F.count("*").alias("_n"), F.max(F.when(F.col("kind") == "tool_result", F.struct(*ORDER))).alias("_newest"))
    placed = V.running(parts, "session_id", ORDER, F.lit(1), "place").join(total, "session_id")
    tool = F.col("kind") == "tool_result"
    newest = F.coalesce(F.struct(*ORDER) == F.col("_newest"), F.lit(False))
    one = F.when(tool, snipped(F.col("text"))).otherwise(F.col("text"))
    two = F.when(tool & ~newest, F.lit(cleared)).otherwise(one)
    own = placed.select("session_id", "event_id", "text", one.alias("one"), two.alias("two"), (F.col("place") > F.col("_n") - keep).alias("late"))
    cost = own.groupBy("session_id").agg(*(F.sum(rough_tokens(F.col(c))).alias("c_" + c) for c in ("text", "one", "two")))
    level = F.when(F.col("c_text") <= limit, 0).when(F.col("c_one") <= limit, 1).when(F.col("c_two") <= limit, 2).otherwise(3)
    chosen = own.join(cost.select("session_id", level.alias("level")), "session_id").where((F.col("level") < 3) | F.col("late"))
    return chosen.select("session_id", "event_id", "level", F.when(F.col("level") == 0, F.col("text")).when(F.col("level") == 1, F.col("one")).otherwise(F.col("two")).alias("text"))


def handed_over(rows: DataFrame, requests: int = 12, recent: int = 4) -> DataFrame:
    """``session_id, event_id``: what a compacted conversation keeps: the last real requests and the last messages."""
    last = lambda df, n: V.ends(df.select("session_id", "event_id", "occurred_at"), "session_id", (F.col("occurred_at"), F.col("event_id")), (F.desc("occurred_at"), F.desc("event_id")), 0, n)
    return last(rows.where(real_request(F.col("role"), F.col("kind"))), requests).unionByName(last(rows, recent)).select("session_id", "event_id").distinct()


def after_cursor(rows: DataFrame, cursors: DataFrame, most: int = 32) -> DataFrame:
    """``session_id, event_id``: the next messages of each session after its cursor (``session_id, at``; none: from the start)."""
    fresh = rows.join(cursors, "session_id", "left").where("at is null or occurred_at > at").select("session_id", "event_id", "occurred_at")
    return V.ends(fresh, "session_id", (F.col("occurred_at"), F.col("event_id")), (F.desc("occurred_at"),), most, 0).select("session_id", "event_id")
