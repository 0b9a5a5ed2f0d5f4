"""Mixing sources to target weights.

Each record of a source gets the same expected number of copies. Its whole part
is certain; the fractional parts are rounded by pivotal dependent rounding: two
records exchange tokens' worth of probability until one of them is decided,
so the tokens of a source hardly change. What is left undecided in a partition
is combined in a reduction tree over the partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.tokens import VOCABULARY, sized, source_name
from threadloom.operators.lineage import written

#: Undecided records of so many partitions meet in a node of the reduction tree.
FAN = 32
#: Records of a part.
PART_ROWS = 100_000
#: Fractions nearer to a whole number than this count as whole.
TINY = 1e-9

ROW = "doc_id bigint, source string, tokens bigint, copies bigint, open double, part int"


def targets(mix_targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats``: one row per source as it is spelt in one way, null repeats as 1; shares that are null, not positive or not finite are none."""
    ok = mix_targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).cast("int").alias("max_repeats"))
    return ok.where("source is not null and target_share > 0 and target_share < double('infinity')").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def plan(totals: list[tuple[str, int, float, int]], size: int | None = None) -> dict[str, float]:
    """Copies of each record by source, from (source, tokens, share, repeats): the largest mixture in which every source has its share exactly, of ``size`` tokens at most where given."""
    own = [(s, n, share, r) for s, n, share, r in totals if n]
    if not own:
        return {}
    whole = sum(share for _, _, share, _ in own)
    most = min(n * r * whole / share for _, n, share, r in own)
    size = most if size is None else min(most, size)
    out = {}
    for s, n, share, r in own:
        c = size * share / whole / n
        out[s] = min(float(round(c)) if abs(c - round(c)) < TINY else c, float(r))
    return out


class Pivot:
    """Dependent rounding of a stream of records of one source; keeps the sum of probability times tokens."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.held: tuple | None = None

    def add(self, key, p: float, tokens: int) -> list[tuple]:
        """(key, 0 or 1) of the records decided by this one."""
        if p <= TINY or p >= 1 - TINY:
            return [(key, int(p > 0.5))]
        if self.held is None:
            self.held = (key, p, tokens)
            return []
        other, q, weight = self.held
        to_other, to_new = min((1 - q) * weight, p * tokens), min(q * weight, (1 - p) * tokens)
        if self.rng.random() * (to_other + to_new) < to_new:
            q, p = q + to_other / weight, p - to_other / tokens
        else:
            q, p = q - to_new / weight, p + to_new / tokens
        out, left = [], []
        for k, x, w in ((other, q, weight), (key, p, tokens)):
            if x <= TINY or x >= 1 - TINY:
                out.append((k, int(x > 0.5)))
            else:
                left.append((k, x, w))
        self.held = left[0] if left else None
        return out


def _seed(*parts) -> int:
    h = 1469598103934665603
    for x in repr(parts).encode():
        h = (h ^ x) * 1099511628211 % 2**64
    return h


def _meeter(last: bool):
    """A node of the reduction tree: rounds what its partitions left undecided; the root decides the rest."""

    def meet(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["tokens", "part", "doc_id"], ascending=[False, True, True]).reset_index(drop=True)
        pivot_of = Pivot(_seed(own["source"].iloc[0], own["doc_id"].tolist()))
        bits: dict[int, int] = {}
        for i, (p, w) in enumerate(zip(own["open"], own["tokens"])):
            bits.update(pivot_of.add(i, p, w))
        left = {}
        if pivot_of.held:
            i, p, _ = pivot_of.held
            if last:
                bits[i] = int(pivot_of.rng.random() < p)
            else:
                left[i] = p
        n = range(len(own))
        return own.assign(copies=own["copies"] + [bits.get(i, 0) for i in n], open=[left.get(i, 0.0) for i in n], part=own["part"] // FAN)

    return meet


def mixture(records: DataFrame, mix: DataFrame, size: int | None = None) -> DataFrame:
    """``doc_id, source, tokens, copies`` of the records in the mixture, from ``doc_id, source, tokens`` and cleaned targets.

    Each source's tokens are within one record of its target; no record has more copies than its source's ``max_repeats``. Records
    without a source, with a source that has no target, or without tokens stay out. The mixture is as large as the scarcest source allows, or of
    ``size`` tokens. Records are dealt by their id to parts of PART_ROWS, so the random choices do not depend on how files lie.
    """
    kept = written(records.where("tokens > 0").join(F.broadcast(mix.select("source")), "source", "left_semi"))
    totals = kept.groupBy("source").agg(F.sum("tokens").alias("n")).join(F.broadcast(mix), "source").select("source", "n", "target_share", "max_repeats").collect()  # a row per target
    copies = plan([tuple(r) for r in totals], size)

    def pivot(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        pivots: dict[str, Pivot] = {}
        for x in parts:
            base = x["source"].map(copies).to_numpy(float)
            whole = np.floor(base + TINY)
            x = x.assign(copies=whole.astype("int64"), open=0.0, part=part)
            extra = np.maximum(base - whole, 0)
            decided = np.zeros(len(x), bool)
            up = np.zeros(len(x), "int64")
            late: list[tuple] = []
            values = list(zip(x["source"], extra, x["tokens"], x["doc_id"], x["copies"]))
            open_rows = np.flatnonzero(extra > TINY)
            # large records first, so that what stays undecided is small
            for i in open_rows[np.lexsort((x["doc_id"].to_numpy()[open_rows], -x["tokens"].to_numpy()[open_rows]))]:
                s, p, w, doc, c = values[i]
                if s not in pivots:
                    pivots[s] = Pivot(_seed(s, part, int(doc)))
                for (row, batch, *rest), bit in pivots[s].add((i, id(x), doc, s, w, c), p, w):
                    if batch == id(x):
                        up[row], decided[row] = bit, True
                    else:
                        late.append((rest[0], rest[1], rest[2], rest[3] + bit, 0.0, part))
            sure = decided | (extra <= TINY)
            yield x.assign(copies=x["copies"] + up)[sure][["doc_id", "source", "tokens", "copies", "open", "part"]]
            if late:
                yield pd.DataFrame(late, columns=["doc_id", "source", "tokens", "copies", "open", "part"])
            self_id = id(x)
            for s, v in pivots.items():  # what is held outlives its batch
                if v.held and v.held[0][1] == self_id:
                    k, p, w = v.held
                    v.held = ((k[0], -1, *k[2:]), p, w)
        held = [(v.held[0][2], s, v.held[0][4], v.held[0][5], v.held[1], part) for s, v in pivots.items() if v.held]
        if held:
            yield pd.DataFrame(held, columns=["doc_id", "source", "tokens", "copies", "open", "part"])

    width = max(1, -(-kept.count() // PART_ROWS))
    dealt = kept.select("doc_id", "source", "tokens").repartition(width, "doc_id").sortWithinPartitions("doc_id", "source", "tokens")
    rows = written(dealt.mapInPandas(pivot, ROW))
    done, rest = rows.where("open = 0"), rows.where("open > 0")
    while True:
        last = width <= FAN

        met = written(rest.groupBy("source", F.floor(F.col("part") / FAN).alias("node")).applyInPandas(_meeter(last), ROW))
        done = done.unionByName(met.where("open = 0"))
        if last:
            return done.where("copies > 0").select("doc_id", "source", "tokens", "copies")
        rest, width = met.where("open > 0"), math.ceil(width / FAN)


def mixed(documents: DataFrame, mix_targets: DataFrame, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(mixture, report) of the documents, sized by the tokenizer at ``path``."""
    mix = targets(mix_targets)
    chosen = mixture(sized(documents, path), mix)
    return chosen, report(chosen, mix)


def report(chosen: DataFrame, mix: DataFrame) -> DataFrame:
    """``source, target_share`` (of the sources in the mixture; null for a source without records), ``actual_share, records, copies, tokens, max_repeats`` of every target."""
    got = chosen.groupBy("source").agg(F.count("*").alias("records"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    rows = mix.join(got, "source", "left")
    there = F.when(F.col("tokens") > 0, F.col("target_share"))
    all_rows = W.partitionBy(F.lit(1))  # a row per target
    return rows.select("source", F.round(there / F.sum(there).over(all_rows), 9).alias("target_share"), F.round(F.col("tokens") / F.sum("tokens").over(all_rows), 9).alias("actual_share"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "max_repeats")
