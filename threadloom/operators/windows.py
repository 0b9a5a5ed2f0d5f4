"""Order-dependent results over keys of any size.

A key may hold a tenth of all rows, so no window is partitioned by it alone: rows are range-partitioned by key and order, each part is
worked out by itself, and what a part needs of those before it (a row per key and part) is summed or looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.lineage import checkpointed


def parted(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows with their part (``_part``), range-partitioned by key and order and kept, so that parts stay as they are."""
    return checkpointed(rows.repartitionByRange(F.col(key), *(F.col(c) for c in order)).withColumn("_part", F.spark_partition_id()))


def _before(parts: DataFrame, key: str, made: Column) -> DataFrame:
    """``key, _part, _base``: the sum of ``made`` over the parts of a key before each part; a row per key and part."""
    per = parts.groupBy(key, "_part").agg(made.alias("_s"))
    w = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return per.select(key, "_part", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_base"))


def running(parts: DataFrame, key: str, order: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """The running sum of ``value`` in each key's order, from ``parted`` rows. Null keys are a key of their own."""
    w = W.partitionBy(key, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = parts.withColumn("_v", value)
    base = _before(own, key, F.sum("_v"))
    joined = own.withColumn("_r", F.sum("_v").over(w)).alias("r").join(base.alias("b"), F.col(f"r.{key}").eqNullSafe(F.col(f"b.{key}")) & (F.col("r._part") == F.col("b._part")))
    return joined.select(*(F.col(f"r.{c}").alias(c) for c in parts.columns), (F.col("r._r") + F.col("b._base")).cast("bigint").alias(name))


def previous(parts: DataFrame, key: str, order: tuple[str, ...], column: str, name: str) -> DataFrame:
    """The column's value in the row before, also across parts."""
    w = W.partitionBy(key, "_part").orderBy(*order)
    last = parts.groupBy(key, "_part").agg(F.max(F.struct(*order, F.col(column).alias("_c")))["_c"].alias("_last"))
    across = last.select(key, "_part", F.lag("_last").over(W.partitionBy(key).orderBy("_part")).alias("_carry"))  # a row per key and part
    own = parts.withColumn("_lag", F.lag(column).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    joined = own.alias("r").join(across.alias("c"), F.col(f"r.{key}").eqNullSafe(F.col(f"c.{key}")) & (F.col("r._part") == F.col("c._part")))
    return joined.select(*(F.col(f"r.{c}").alias(c) for c in parts.columns), F.when(F.col("r._first"), F.col("c._carry")).otherwise(F.col("r._lag")).alias(name))


def islands(parts: DataFrame, key: str, order: tuple[str, ...], column: str, name: str) -> DataFrame:
    """The number (from 1) of the unbroken run of equal values that a row lies in, in its key's order."""
    seen = previous(parts, key, order, column, "_before")
    return running(seen, key, order, (~F.col("_before").eqNullSafe(F.col(column)) | F.col("_before").isNull()).cast("int"), name).drop("_before")


def ends(rows: DataFrame, key: str, order: tuple[Column, ...], reverse: tuple[Column, ...], head: int, tail: int) -> DataFrame:
    """The first ``head`` and the last ``tail`` rows of each key, once each. Both are group limits, so a task sends at most so many rows of a key."""
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_n") <= head).drop("_n")
    last = rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*reverse))).where(F.col("_n") <= tail).drop("_n")
    return first.unionByName(last).distinct()


def chunks(parts: DataFrame, key: str, order: tuple[str, ...], length: Column, size: int, overlap: int) -> DataFrame:
    """Sliding windows over the texts of a key laid end to end: a row per window and text that it touches, ``key, chunk, start, end`` with the range in the text.

    A text finds its windows from its own offsets, so nothing is joined by range. The last window is the one that reaches the key's end.
    """
    step = size - overlap
    placed = running(parts.withColumn("_len", length), key, order, F.col("_len"), "_end")
    total = parts.withColumn("_len", length).groupBy(key).agg(F.sum("_len").alias("_total"))
    rows = placed.alias("r").join(total.alias("t"), F.col(f"r.{key}").eqNullSafe(F.col(f"t.{key}"))).select("r.*", "t._total").withColumn("_start", F.col("_end") - F.col("_len")).where("_len > 0")
    last = F.greatest(F.lit(0), F.ceil((F.col("_total") - size) / step)).cast("bigint")
    low = F.greatest(F.lit(0), F.floor((F.col("_start") - size) / step) + 1).cast("bigint")
    high = F.least(last, F.floor((F.col("_end") - 1) / step)).cast("bigint")
    many = rows.withColumn("chunk", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    begin = F.greatest(F.col("_start"), F.col("chunk") * step) - F.col("_start")
    end = F.least(F.col("_end"), F.col("chunk") * step + size) - F.col("_start")
    return many.withColumn("start", begin).withColumn("end", end).where("end > start").drop("_len", "_end", "_total", "_start", "_part")


def retained(rows: DataFrame, group: str, key: str, at: str, size: str, now: Column, protected: Column, days: int = 30, most: int = 500, budget: int = 0) -> DataFrame:
    """``group, key, reason`` of what a retention rule removes: older than ``days``; beyond the newest ``most``; the oldest of the rest until the group is within ``budget`` bytes. Protected rows stay, but count to the bytes.

    The order within a group is worked out over parts, so a group of any size is spread.
    """
    own = rows.select(group, key, at, F.coalesce(size, F.lit(0)).cast("bigint").alias(size), protected.alias("_kept")).withColumn("_age", F.coalesce(-F.unix_micros(at), F.lit(2**62)))
    newest = running(parted(own, group, "_age", key), group, ("_age", key), (~F.col("_kept")).cast("int"), "_n")
    aged = newest.withColumn("_old", ~F.col("_kept") & F.coalesce(F.col(at) < now - F.expr(f"interval {days} days"), F.lit(False))).withColumn("_many", ~F.col("_kept") & (F.col("_n") > most))
    out = aged.withColumn("reason", F.when(F.col("_old"), "age").when(F.col("_many"), "count"))
    if budget:
        left = out.groupBy(group).agg(F.sum(F.when(F.col("reason").isNull(), F.col(size)).otherwise(0)).alias("_left"))
        rest = out.join(left, group).withColumn("_rev", -F.col("_age")).drop("_part")
        free = F.when(F.col("reason").isNull() & ~F.col("_kept"), F.col(size)).otherwise(0)
        gone = running(parted(rest, group, "_rev", key), group, ("_rev", key), free, "_freed")
        over = F.col("reason").isNull() & ~F.col("_kept") & (F.col("_left") - (F.col("_freed") - F.col(size)) > budget)
        out = gone.withColumn("reason", F.when(over, "bytes").otherwise(F.col("reason")))
    return out.where("reason is not null").select(group, key, "reason")


def stratified(rows: DataFrame, stratum: str, key: str, size: int, salt: str) -> DataFrame:
    """``stratum, key``: a sample of ``size`` rows, shared equally among strata (what a small one leaves goes to the others, the fullest first), within each by hash."""
    own = rows.select(F.coalesce(F.nullif(F.trim(stratum), F.lit("")), F.lit("unknown")).alias(stratum), key)
    counts = [(r[stratum], r["n"]) for r in own.groupBy(stratum).agg(F.count("*").alias("n")).orderBy(stratum).collect()]  # a row per stratum
    quota = quotas(dict(counts), size)
    plan = rows.sparkSession.createDataFrame(sorted(quota.items()) or [("", 0)], f"{stratum} string, _quota int")
    order = F.sha2(F.concat_ws("\0", F.lit(salt), stratum, F.col(key).cast("string")), 256)
    most = max(quota.values(), default=0)
    top = own.withColumn("_n", F.row_number().over(W.partitionBy(stratum).orderBy(order, key))).where(F.col("_n") <= most)
    return top.join(F.broadcast(plan), stratum).where("_n <= _quota").select(stratum, key)  # a row per stratum


def quotas(counts: dict[str, int], size: int) -> dict[str, int]:
    """An equal share for each, at most its count; what is left over one by one to those with most left."""
    if not counts:
        return {}
    out = {k: min(size // len(counts), n) for k, n in counts.items()}
    left = min(size, sum(counts.values())) - sum(out.values())
    while left > 0:
        for k in sorted(counts, key=lambda k: (out[k] - counts[k], k)):
            if left > 0 and out[k] < counts[k]:
                out[k] += 1
                left -= 1
    return out
