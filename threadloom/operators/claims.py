"""Versioned claims: intervals, authority, slot decisions, conflict sets, forgetting.

Groups are slots; what is compared are the versions of one slot (joined on it, never crossed), and what is ranked
within a slot is aggregated before any sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.hashing import content_hash, stable_id
from threadloom.functions.text import normalize_claim, utrim

#: Facets whose claims are of users' making, and those that are observed.
DECLARED, OBSERVED = ("preference", "constraint"), ("state", "configuration", "procedure-state")
#: States of a claim that take part in decisions.
LIVE = ("active", "scoped", "pending")


def claim_type(facet: Column) -> Column:
    return F.when(facet == "preference", "preference").when(facet == "constraint", "constraint").when(facet.isin("state", "configuration", "location", "goal", "procedure-state"), "state").otherwise("fact")


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Intervals overlap; a null bound is open and touching ends count."""
    return F.coalesce(end >= other_start, F.lit(True)) & F.coalesce(other_end >= start, F.lit(True))


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """One row per ``node_id``: of repeated rows the greatest, in one pass of partial aggregates."""
    rest = [c for c in nodes.columns if c != "node_id"]
    best = nodes.where("node_id is not null").groupBy("node_id").agg(F.max(F.struct(F.coalesce("created_at", F.timestamp_seconds(F.lit(-(10**10)))).alias("_at"), *rest)).alias("b"))
    return best.select("node_id", *(F.col(f"b.{c}").alias(c) for c in rest))


def authorities(nodes: DataFrame, sources: DataFrame, events: DataFrame) -> DataFrame:
    """``node_id, authority``: the best of a claim's sources for its facet, more if observed or declared, less if inferred. Without a known source 0 counts."""
    actor, kind = F.lower(utrim(F.col("actor"))), F.lower(utrim(F.col("source_kind")))
    seen = events.where("event_id is not null").groupBy("event_id").agg(F.bool_or(actor == "user").alias("user"), F.bool_or(actor == "tool").alias("tool"), F.bool_or(kind.isin("tool", "observation")).alias("observed"), F.bool_or(kind == "document").alias("document"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    facet = F.col("facet")
    score = (
        F.when(facet.isin(*DECLARED), F.when(yes("user"), 100).otherwise(0))
        .when(facet.isin(*OBSERVED), F.when(yes("tool") | yes("observed"), 100).when(yes("user"), 70).otherwise(0))
        .otherwise(F.when(yes("document") | yes("observed"), 90).when(yes("user"), 80).otherwise(0))
    )
    per = nodes.select("node_id", "facet", "evidence_mode").join(sources.select("node_id", "event_id"), "node_id", "left").join(seen, "event_id", "left").groupBy("node_id").agg(F.max(score).alias("score"), F.max("evidence_mode").alias("mode"))
    more = F.when(F.col("mode") == "observed", 10).when(F.col("mode") == "user_declared", 5).when(F.col("mode") == "inferred", -20).otherwise(0)
    return per.select("node_id", (F.col("score") + more).alias("authority"))


def slot_decisions(nodes: DataFrame, authority: DataFrame) -> DataFrame:
    """``node_id, decision`` of each claim against the earlier live claims of its slot (by ``created_at``, ``node_id``).

    coexists: none is earlier; duplicate: one has the same value; scoped: none overlaps in time; supersedes: the claim's facet and
    evidence allow it, its authority is no less than that of each overlapping one and it begins later than each; else uncertain.
    """
    live = nodes.where(F.col("status").isin(*LIVE) & ~F.coalesce("tombstoned", F.lit(False)) & (F.col("slot_id") != ""))
    rows = live.join(authority, "node_id").select("node_id", "slot_id", "facet", "evidence_mode", "authority", "valid_from", "valid_until", "created_at", normalize_claim(F.col("statement")).alias("value"), F.coalesce("valid_from", "created_at").alias("begins"))
    old = rows.select("slot_id", *(F.col(c).alias("o_" + c) for c in ("node_id", "authority", "valid_from", "valid_until", "created_at", "value", "begins")))
    earlier = (F.col("o_created_at") < F.col("created_at")) | ((F.col("o_created_at") == F.col("created_at")) & (F.col("o_node_id") < F.col("node_id")))
    pairs = rows.join(old, "slot_id").where(earlier)
    touching = overlaps(F.col("valid_from"), F.col("valid_until"), F.col("o_valid_from"), F.col("o_valid_until"))
    able = (F.col("facet").isin(*DECLARED) & (F.col("evidence_mode") == "user_declared")) | (F.col("facet").isin(*OBSERVED) & (F.col("evidence_mode") == "observed"))
    wins = F.coalesce(able & (F.col("authority") >= F.col("o_authority")) & (F.col("begins") > F.col("o_begins")), F.lit(False))
    seen = pairs.groupBy("node_id").agg(F.bool_or(F.coalesce(F.col("value") == F.col("o_value"), F.lit(False))).alias("same"), F.bool_or(touching).alias("touch"), F.bool_and(F.when(touching, wins).otherwise(True)).alias("wins"))
    decision = F.when(F.col("same").isNull(), "coexists").when(F.col("same"), "duplicate").when(~F.col("touch"), "scoped").when(F.col("wins"), "supersedes").otherwise("uncertain")
    return rows.select("node_id").join(seen, "node_id", "left").select("node_id", decision.alias("decision"))


def resulting_status(decision: Column) -> Column:
    """What a claim becomes by its decision."""
    return F.when(decision == "duplicate", "rejected").when(decision == "uncertain", "pending").otherwise("active")


def conflict_sets(nodes: DataFrame) -> DataFrame:
    """``slot_id, space, generation, conflict_id, members, critical`` of the slots with two live claims or more; the generation is the hash of the sorted members with their values."""
    live = nodes.where(F.col("status").isin(*LIVE) & ~F.coalesce("tombstoned", F.lit(False)) & (F.col("slot_id") != ""))
    critical = F.col("facet").isin(*DECLARED, *OBSERVED)
    member = F.concat("node_id", F.lit("\x1f"), F.coalesce(normalize_claim(F.col("statement")), F.lit("")))
    sets = live.groupBy("space", "slot_id").agg(F.array_sort(F.collect_list(member)).alias("parts"), F.array_sort(F.collect_list("node_id")).alias("m"), F.bool_or(critical).alias("critical")).where(F.size("m") > 1)
    made = sets.withColumn("generation", content_hash(F.col("slot_id"), F.array_join("parts", "\x1e")))
    return made.select("slot_id", "space", "generation", stable_id("conf", F.col("slot_id"), F.col("generation")).alias("conflict_id"), F.col("m").alias("members"), "critical")


def local_resolutions(nodes: DataFrame, conflicts: DataFrame, authority: DataFrame) -> DataFrame:
    """``conflict_id, winner, losers`` : the member of the greatest authority, then the latest, then the smallest id."""
    member = conflicts.select("conflict_id", F.explode("members").alias("node_id"))
    rows = member.join(nodes.select("node_id", F.coalesce("valid_from", "created_at").alias("begins")), "node_id").join(authority, "node_id")
    order = F.struct((-F.col("authority")).alias("a"), (-F.coalesce(F.unix_micros("begins"), F.lit(-(2**62)))).alias("b"), "node_id")
    best = rows.groupBy("conflict_id").agg(F.array_sort(F.collect_list(order)).alias("m"))
    ids = F.transform("m", lambda x: x["node_id"])
    return best.select("conflict_id", F.get(ids, F.lit(0)).alias("winner"), F.array_sort(F.slice(ids, 2, 10**6)).alias("losers"))


def adjudicated(nodes: DataFrame, resolutions: DataFrame) -> DataFrame:
    """``node_id, status`` after the resolutions: winners are active, losers superseded, others as before."""
    new = resolutions.select(F.col("winner").alias("node_id"), F.lit("active").alias("new")).unionByName(resolutions.select(F.explode("losers").alias("node_id"), F.lit("superseded").alias("new")))
    return nodes.select("node_id", "status").join(new.groupBy("node_id").agg(F.max("new").alias("new")), "node_id", "left").select("node_id", F.coalesce("new", "status").alias("status"))


def policy(facet: Column) -> Column:
    """The rule of precedence for a conflict, by facet."""
    return (
        F.when(facet.isin("preference", "constraint"), "later explicit declarations")
        .when(facet.isin("state", "configuration"), "direct observations")
        .when(facet == "procedure-state", "successful executions")
        .otherwise("direct documents and tools")
    )


def supersession(nodes: DataFrame) -> DataFrame:
    """``slot_id, node_id, version, open_until``: the versions of a slot in order, each valid until the next begins (or its own end, if earlier).

    Slots are small; the window is over their versions only."""
    w = W.partitionBy("slot_id").orderBy(F.coalesce("valid_from", "created_at"), "node_id")
    rows = nodes.where((F.col("slot_id") != "") & ~F.coalesce("tombstoned", F.lit(False)) & F.col("status").isin("active", "superseded", "scoped"))
    nxt = F.lead(F.coalesce("valid_from", "created_at")).over(w)
    return rows.select("slot_id", "node_id", F.row_number().over(w).alias("version"), F.least(F.coalesce("valid_until", nxt), F.coalesce(nxt, "valid_until")).alias("open_until"))


def identities(nodes: DataFrame) -> DataFrame:
    """``space, canonical, identity_id, aliases``: subjects that are one name however spelt, and their spellings."""
    canonical = normalize_claim(F.col("subject_text"))
    rows = nodes.where("subject_text is not null").select("space", "subject_text", canonical.alias("canonical")).where("canonical <> ''")
    own = rows.groupBy("space", "canonical").agg(F.array_sort(F.collect_set("subject_text")).alias("aliases"))
    return own.select("space", "canonical", stable_id("ident", F.col("space"), F.col("canonical")).alias("identity_id"), "aliases")


def forget_targets(events: DataFrame, nodes: DataFrame, sources: DataFrame, contexts: list[str]) -> DataFrame:
    """``kind, id``: the events of the contexts, and the claims of which a source is among them or that lie in the contexts themselves."""
    own = events.where(F.col("context_id").isin(*contexts)).select("event_id").distinct()
    from_events = sources.join(own, "event_id", "left_semi").select("node_id")
    from_contexts = nodes.where(F.col("context_id").isin(*contexts)).select("node_id")
    claims = from_events.join(nodes.select("node_id"), "node_id", "left_semi").unionByName(from_contexts).where("node_id is not null").distinct()
    return own.select(F.lit("event").alias("kind"), F.col("event_id").alias("id")).unionByName(claims.select(F.lit("node").alias("kind"), F.col("node_id").alias("id")))


def tombstoned(rows: DataFrame, targets: DataFrame, id_column: str) -> DataFrame:
    """Rows with the targets' flag set; nothing is removed."""
    hit = targets.select(F.col("id").alias(id_column), F.lit(True).alias("_hit")).distinct()
    return rows.join(hit, id_column, "left").withColumn("tombstoned", F.coalesce("_hit", "tombstoned", F.lit(False))).drop("_hit")


def purged(rows: DataFrame, targets: DataFrame, id_column: str) -> DataFrame:
    """Rows without the targets."""
    return rows.join(targets.select(F.col("id").alias(id_column)), id_column, "left_anti")


def orphan_slots(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """``slot_id`` of slots that lose their last claim when ``removed`` (``node_id``) goes."""
    gone = removed.select("node_id").distinct().withColumn("gone", F.lit(True))
    rows = nodes.where("slot_id <> ''").select("slot_id", "node_id").join(gone, "node_id", "left")
    return rows.groupBy("slot_id").agg(F.bool_and(F.coalesce("gone", F.lit(False))).alias("empty")).where("empty").select("slot_id")


def bound_sources(nodes: DataFrame, sources: DataFrame, events: DataFrame) -> DataFrame:
    """``node_id, bound, unknown``: how many of a claim's sources are known events, and how many are not."""
    known = events.select("event_id").where("event_id is not null").distinct().withColumn("known", F.lit(1))
    per = sources.join(known, "event_id", "left").groupBy("node_id").agg(F.count("known").alias("bound"), (F.count("*") - F.count("known")).alias("unknown"))
    return nodes.select("node_id").distinct().join(per, "node_id").select("node_id", "bound", "unknown")


def grounded_numbers(nodes: DataFrame, sources: DataFrame, events: DataFrame) -> DataFrame:
    """``node_id, grounded``: whether the first number of a claim stands in one of the ranges that it cites."""
    number = F.regexp_extract("statement", r"\d+", 0)
    rows = nodes.select("node_id", number.alias("k")).where("k <> ''").distinct()
    texts = events.groupBy("event_id").agg(F.max("content").alias("content"))
    cited = rows.join(sources, "node_id").join(texts, "event_id").where("start_rune >= 0 and end_rune > start_rune and end_rune <= length(content)")
    own = F.lower(F.substr("content", F.col("start_rune") + 1, F.col("end_rune") - F.col("start_rune")))
    return cited.groupBy("node_id").agg(F.bool_or(F.contains(own, F.col("k"))).alias("grounded"))
