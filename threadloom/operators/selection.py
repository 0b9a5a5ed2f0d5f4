"""Selections that depend on what was taken before: evidence under a budget, packing in order, equal shares.

What is chosen step by step is chosen within one group (a query, a batch) of bounded size; groups are spread over tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tokens(text: str) -> set[str]:
    return {x for x in re.split(r"[^\w]+", text.lower()) if x}


def greedy(rows: list[dict], weights: dict[str, float], max_items: int, max_tokens: int) -> list[dict]:
    """Evidence of the greatest utility, one by one: score, new query terms, a new context, a new component, less the overlap with what was taken.

    Rows: ``id, content, score, context_id, component, sources``. A row that shares a source with a taken one, or over 0.85 of its words, or that
    does not fit in the tokens left, is passed over; of equal utility the smaller id.
    """
    left = [dict(r, words=_tokens(r["content"]), cost=max(1, -(-len(r["content"].strip()) // 3))) for r in rows]
    whole = sum(w if w > 0 else 1.0 for w in weights.values())
    taken: list[dict] = []
    sources, terms, contexts, components, used = set(), set(), set(), set(), 0
    while left and len(taken) < max_items:
        best, most = None, None
        for r in left:
            if sources & set(r["sources"]) or used + r["cost"] > max_tokens:
                continue
            overlap = max((len(r["words"] & t["words"]) / len(r["words"] | t["words"]) if r["words"] and t["words"] else 0.0 for t in taken), default=0.0)
            if overlap > 0.85:
                continue
            fresh = sum((w if w > 0 else 1.0) for t, w in weights.items() if t in r["words"] and t not in terms)
            gain = max(0.0, r["score"]) + 0.005 * (fresh / whole if whole else 0.0) + 0.002 * bool(r["context_id"] and r["context_id"] not in contexts) + 0.001 * bool(r["component"] and r["component"] not in components) - 0.01 * overlap
            key = (gain, [-ord(c) for c in r["id"]])
            if most is None or key > most:
                best, most = r, key
        if best is None:
            break
        taken.append(best)
        left.remove(best)
        used += best["cost"]
        sources |= set(best["sources"])
        terms |= best["words"]
        contexts.add(best["context_id"])
        components.add(best["component"])
    return taken


def evidence(candidates: DataFrame, weights: DataFrame, max_items: int = 24, max_tokens: int = 2500) -> DataFrame:
    """``query_id, place, id, score, tokens`` from ``query_id, id, content, score, context_id, component, sources``: greedy selection per query.

    The channels before it bound a query's candidates (some hundred), whatever the ledger's size.
    """
    rows = candidates.groupBy("query_id").agg(F.collect_list(F.struct("id", "content", "score", "context_id", "component", "sources")).alias("rows")).join(weights.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weights")), "query_id", "left")

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            out = []
            for q, own, w in zip(x["query_id"], x["rows"], x["weights"]):
                picked = greedy([{"id": r["id"], "content": r["content"] or "", "score": r["score"] or 0.0, "context_id": r["context_id"], "component": r["component"], "sources": list(r["sources"]) if r["sources"] is not None else []} for r in own], dict(w) if w is not None else {}, max_items, max_tokens)
                out += [(q, i, p["id"], p["score"], p["cost"]) for i, p in enumerate(picked)]
            yield pd.DataFrame(out, columns=["query_id", "place", "id", "score", "tokens"])

    return rows.mapInPandas(choose, "query_id string, place int, id string, score double, tokens int")


def taken_in_order(items: Column, cost: Column, budget: int, most: int) -> Column:
    """From an ordered array the items that fit a budget one after the other (the first always does), ``most`` at most: a fold in the JVM. ``cost`` is of the same length."""
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("at"))

    def step(a: Column, i: Column) -> Column:
        c = F.get(cost, i).cast("bigint")
        fits = (F.size(a["at"]) < most) & ((F.size(a["at"]) == 0) | (a["used"] + c <= budget))
        return F.struct(F.when(fits, a["used"] + c).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["at"], F.array(i))).otherwise(a["at"]).alias("at"))

    picked = F.aggregate(F.sequence(F.lit(0), F.size(items) - 1), zero, step)["at"]
    return F.when(F.size(items) == 0, F.slice(items, 1, 0)).otherwise(F.transform(picked, lambda i: F.get(items, i)))


def next_fit(costs: Column, capacity: int, most: int) -> Column:
    """The bin number of each cost in order: a new bin where the open one would exceed the capacity or ``most`` items."""
    zero = F.struct(F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        opens = (a["n"] > 0) & ((a["used"] + c > capacity) | (a["n"] >= most))
        b = a["bin"] + opens.cast("int")
        return F.struct(b.alias("bin"), F.when(opens, c.cast("bigint")).otherwise(a["used"] + c).alias("used"), F.when(opens, 1).otherwise(a["n"] + 1).alias("n"), F.concat(a["out"], F.array(b)).alias("out"))

    return F.aggregate(costs, zero, step)["out"]


def level_shares(needs: Column, total: int) -> Column:
    """Equal shares of a total: the level L (in whole units) of which the sum of min(need, L) is the greatest not over it; each gets min(need, L). A null need is none.

    One pass in the JVM over the needs in order: the smallest that fit in full, then the rest in equal parts.
    """
    own = F.transform(needs, lambda n: F.coalesce(n.cast("bigint"), F.lit(0).cast("bigint")))
    ordered = F.transform(F.array_sort(own), lambda n: F.struct(n.alias("need"), F.lit(1).cast("bigint").alias("n"), n.alias("whole")))
    return F.flatten(F.transform(F.array(_level(ordered, total)["level"]), lambda level: F.transform(own, lambda n: F.least(n, level))))  # the level is worked out once, not for each need


def _level(needs: Column, total: int) -> Column:
    """``spent, level``: of needs in ascending order (``need``, how many have it ``n``, their sum ``whole``) the sum of min(need, L) and the greatest min(need, L)."""
    big = lambda x: F.lit(x).cast("bigint")
    zero = F.struct(big(0).alias("full"), F.aggregate(needs, big(0), lambda s, r: s + r["n"]).alias("left"), big(None).alias("top"))

    def step(a: Column, r: Column) -> Column:
        fits = (r["need"] <= 0) | ((r["need"] <= total) & (a["full"] + r["need"] * a["left"] <= total))  # where one does not fit, no greater one does
        return F.struct(F.when(fits, a["full"] + r["whole"]).otherwise(a["full"]).alias("full"), F.when(fits, a["left"] - r["n"]).otherwise(a["left"]).alias("left"), F.when(fits, r["need"]).otherwise(a["top"]).alias("top"))

    def end(a: Column) -> Column:
        rest = F.least(big(total), F.floor((total - a["full"]) / a["left"]).cast("bigint"))
        return F.struct(F.when(a["left"] > 0, a["full"] + rest * a["left"]).otherwise(a["full"]).alias("spent"), F.when(a["left"] > 0, rest).otherwise(a["top"]).alias("level"))

    return F.aggregate(needs, zero, step, end)


def level_totals(rows: DataFrame, key: str, need: str, total: int) -> DataFrame:
    """``key, spent, level``: of the shares of each key's rows as by ``level_shares`` the sum and the greatest. Needs are not null.

    Rows are counted by need before they meet (those over the total are one count, those below zero another), so a key of any size comes to ``total`` + 3 counts.
    """
    n = F.least(F.col(need).cast("bigint"), F.lit(total + 1).cast("bigint"))
    counts = rows.select(key, n.alias("_need")).groupBy(key, F.greatest("_need", F.lit(-1).cast("bigint")).alias("_bucket")).agg(F.max("_need").alias("need"), F.count("*").alias("n"), F.sum("_need").alias("whole"))
    return counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("need", "n", "whole"))).alias("_needs")).select(key, F.inline(F.array(_level(F.col("_needs"), total))))
