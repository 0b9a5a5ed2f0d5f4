"""Splitting oversized items at natural boundaries.

A text is cut into ranges, each with a halo of the text before it. A range finds
its boundaries and its anchor (the last boundary near its end) without the
others, so a giant text is worked on by many tasks and never loaded whole in
Python. The tables of the ranges are stitched: piece numbers by prefix sums, the
longest stretch without a boundary by folding the ranges' ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.text import utrim

#: Runes of a token of the project's estimate, and of a range.
RUNES_PER_TOKEN, RANGE = 3, 64 * 2304
#: White space of the Unicode property, and the marks after which a text may be cut.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MARKS = "。！？；"

PIECES = "id string, range_no int, pieces array<struct<start_rune:bigint,end_rune:bigint,cut:string,text:string>>, runes bigint, head bigint, inner bigint, tail bigint, whole boolean"


def _table() -> np.ndarray:
    kind = np.zeros(0x10000, np.uint8)
    kind[[ord(c) for c in WHITE]] = 1
    kind[[ord(c) for c in MARKS]] = 2
    return kind


def kinds(text: str) -> np.ndarray:
    """1 for white space, 2 for a mark, 0 for the rest, per rune."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x10000, _table()[np.minimum(points, 0xFFFF)], 0)


def stretches(kind: np.ndarray) -> tuple[int, int, int, bool]:
    """(head, inner, tail, whole): runes without a boundary at the start, inside, at the end; whole: there is no boundary."""
    at = np.flatnonzero(kind)
    if not len(at):
        return len(kind), 0, len(kind), True
    mark = kind[at] == 2
    head = int(at[0] + mark[0])
    inner = int((at[1:] - at[:-1] - 1 + mark[1:]).max()) if len(at) > 1 else 0
    return head, inner, int(len(kind) - at[-1] - 1), False


def cut(kind: np.ndarray, begin: int, end: int, end_kind: str, capacity: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces (start, end, kind of the cut at the end) of [begin, end) of a text of these kinds, of at most ``capacity`` runes; the first one reaches back ``overlap`` runes, the last one ends as ``end_kind``.

    A piece ends at the last boundary in reach, else at the capacity. The next one starts at the boundary at or before ``overlap`` runes
    back (at most twice as far, else exactly there). Where the overlap would leave no room to reach the next boundary it is left out.
    """
    n = len(kind)
    after = np.zeros(n + 1, bool)
    after[1:] = kind != 0
    after[:n] |= kind == 1
    after[0] = after[n] = True
    spots = np.flatnonzero(after)

    def last(low: int, high: int) -> int:
        """The last boundary in (low, high], or -1."""
        i = np.searchsorted(spots, high, "right") - 1
        return int(spots[i]) if i >= 0 and spots[i] > low else -1

    def back(at: int) -> int:
        if at <= 0 or not overlap:
            return at
        floor = max(0, at - overlap)
        near = last(max(-1, at - 2 * overlap - 1), floor)
        return near if near >= 0 else floor

    def behind_white(at: int) -> int:
        while at < end and kind[at] == 1:
            at += 1
        return at

    out: list[tuple[int, int, str]] = []
    at = begin
    while at < end:
        start = back(at)
        if end - start <= capacity:
            out.append((start, end, end_kind))
            break
        stop = last(at, start + capacity)
        if stop < 0:
            bare = behind_white(at)
            stop = last(bare, bare + capacity)
            if stop >= 0:
                start = bare
        if stop < 0:
            stop = start + capacity
            if stop <= at:
                start, stop = at, at + capacity
            kind_of = "forced"
        else:
            kind_of = "natural"
        stop = min(stop, end)
        out.append((start, stop, kind_of if stop < end else end_kind))
        at = stop
    return out


def ranges(rows: DataFrame, capacity_runes: int, overlap_runes: int, range_runes: int = RANGE) -> DataFrame:
    """``id, range_no, offset, halo, more, text, size``: the ranges of each text with the halo before it and the rune after it; ``more``: another range follows.

    The text is cut in one pass, whatever its length; its ranges are then dealt to the tasks by id and number.
    """
    halo = capacity_runes + 2 * overlap_runes + 1
    size = max(range_runes, 2 * halo)
    many = rows.withColumn("c", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))

    def one(i: Column) -> Column:
        lead = F.when(i == 0, 0).otherwise(halo)
        before = F.when(i == 0, "").otherwise(F.right(F.get("c", i - 1), F.lit(halo)))
        after = F.coalesce(F.left(F.get("c", i + 1), F.lit(1)), F.lit(""))  # tells whether the cut at the range's end is a boundary
        return F.struct(i.alias("range_no"), (i.cast("bigint") * size).alias("offset"), lead.alias("halo"), (i < F.size("c") - 1).alias("more"), F.concat(before, F.get("c", i), after).alias("text"), F.lit(size).alias("size"))

    cut_up = many.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 1), one)).alias("r")).select("id", "r.*")
    return cut_up.repartition("id", "range_no")


def _splitter(capacity: int, overlap: int, with_texts: bool):
    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            rows = []
            for id_, no, offset, halo, more, text, size in zip(x["id"], x["range_no"], x["offset"], x["halo"], x["more"], x["text"], x["size"]):
                kind = kinds(text)
                own_end = min(len(text), halo + size)

                base = int(offset) - int(halo)

                def anchor(at: int, kind=kind) -> int:
                    """The last boundary in the capacity up to ``at``, else ``at``."""
                    for b in range(at, max(at - capacity, 0), -1):
                        if kind[b - 1] or (b < len(kind) and kind[b] == 1):
                            return b
                    return at

                begin = anchor(halo) if halo else 0
                end = anchor(own_end) if more else own_end
                natural = kind[end - 1] != 0 or (end < len(kind) and kind[end] == 1)
                pieces = [{"start_rune": base + a, "end_rune": base + b, "cut": c, "text": text[a:b] if with_texts else None} for a, b, c in cut(kind[:own_end], begin, end, ("natural" if natural else "forced") if more else "end", capacity, overlap)]
                head, inner, tail, whole = stretches(kind[halo:own_end])
                rows.append((id_, no, pieces, own_end - halo, head, inner, tail, whole))
            yield pd.DataFrame(rows, columns=["id", "range_no", "pieces", "runes", "head", "inner", "tail", "whole"])

    return split


def oversized(rows: DataFrame, capacity_tokens: int, id_column: str = "event_id", text_column: str = "content") -> DataFrame:
    """``id, text`` (trimmed) of the items over the capacity, one row per id (of several texts of an id, the greatest)."""
    text = rows.select(F.col(id_column).cast("string").alias("id"), utrim(F.col(text_column)).alias("text"))
    over = text.where(F.col("id").isNotNull() & (F.length("text") > capacity_tokens * RUNES_PER_TOKEN))
    return over.groupBy("id").agg(F.max("text").alias("text"))


def split_ranges(rows: DataFrame, capacity_tokens: int, overlap_tokens: int, id_column: str = "event_id", text_column: str = "content", range_runes: int = RANGE, with_texts: bool = True) -> DataFrame:
    """One row per range of each oversized item: its pieces (their texts null without ``with_texts``) and what stitching needs."""
    if capacity_tokens < 1 or not 0 <= overlap_tokens * 2 < capacity_tokens:
        raise ValueError("the capacity must be positive and more than twice the overlap")
    cap, over = capacity_tokens * RUNES_PER_TOKEN, overlap_tokens * RUNES_PER_TOKEN
    return ranges(oversized(rows, capacity_tokens, id_column, text_column), cap, over, range_runes).mapInPandas(_splitter(cap, over, with_texts), PIECES)


def pieces(split: DataFrame) -> DataFrame:
    """``id, piece_no`` (from 0), ``start_rune, end_rune`` (in the trimmed text), ``tokens, cut, text``.

    ``cut`` says how the piece ends: at a natural boundary, ``forced``, or at the ``end`` of the text. Items within the capacity, null
    texts and null ids have no pieces. Consecutive pieces share the overlap; together they cover the trimmed text.
    """
    before = F.coalesce(F.sum(F.size("pieces")).over(W.partitionBy("id").orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    flat = split.withColumn("before", before).select("id", "before", F.posexplode("pieces").alias("i", "p"))
    return flat.select("id", (F.col("before") + F.col("i")).alias("piece_no"), "p.start_rune", "p.end_rune", F.ceil(F.length(utrim(F.col("p.text"))) / RUNES_PER_TOKEN).cast("int").alias("tokens"), "p.cut", "p.text")


def cut_kinds(split: DataFrame, capacity_tokens: int) -> DataFrame:
    """``id, cut_kind``: ``forced`` if a stretch without a boundary is over the capacity, else ``natural``.

    The ranges of a text are stitched in one fold: their pieces are numbered by prefix sums up to the first forced one, and stretches are
    carried over the ranges' ends. A stretch over the capacity and a forced piece imply each other; either makes the text forced.
    """
    big = lambda x: F.lit(x).cast("bigint")
    zero = F.struct(big(0).alias("run"), big(0).alias("most"), big(0).alias("before"), big(None).alias("first"))

    def step(a: Column, r: Column) -> Column:
        joined = a["run"] + F.when(r["whole"], r["runes"]).otherwise(r["head"])
        run = F.when(r["whole"], joined).otherwise(r["tail"])
        return F.struct(run.alias("run"), F.greatest(a["most"], joined, r["inner"], run).alias("most"), (a["before"] + r["n"]).alias("before"), F.coalesce(a["first"], a["before"] + r["at"]).alias("first"))

    at = F.array_position(F.transform("pieces", lambda p: p["cut"]), "forced")  # from 1, 0 without any
    own = split.select("id", F.struct("range_no", "runes", "head", "inner", "tail", "whole", F.size("pieces").cast("bigint").alias("n"), F.nullif(at, big(0)).alias("at")).alias("r"))
    folded = own.groupBy("id").agg(F.array_sort(F.collect_list("r")).alias("r")).select("id", F.inline(F.array(F.aggregate("r", zero, step))))
    return folded.select("id", F.when(F.col("first").isNotNull() | (F.ceil(F.col("most") / RUNES_PER_TOKEN) > capacity_tokens), "forced").otherwise("natural").alias("cut_kind"))
