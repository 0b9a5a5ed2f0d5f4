"""Filling fixed-capacity containers with items.

Items are dealt to blocks of bounded size by hash. A block starts from
best-fit decreasing and then searches locally: its emptiest bin shares its items with
each other bin in turn so that the other becomes as full as any choice of their items
makes it, until the bin is empty or no other bin can be filled further. The items
of bins that some open item would still fit meet again in new blocks of the same
size, level by level, as long as that pays.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tokens import VOCABULARY, encoder, widths
from threadloom.operators.lineage import written

#: Items of a block (about; they are dealt by hash), the fill from which a bin is closed at once, and the share of open items that a level must place for another to follow.
BLOCK, FULL, PAYS = 8192, 0.97, 0.1
#: Emptiest bins tried in a row without success before a block is done. A try itself goes on until nothing helps.
PATIENCE = 4

ITEM = "doc_id bigint, piece_no int, start_rune bigint, end_rune bigint, tokens bigint"


def split_text(text: str, ids: list[int], capacity: int, enc, width: np.ndarray) -> list[tuple[int, int, int]]:
    """(start_rune, end_rune, tokens) of pieces of at most ``capacity`` tokens, cut before white space where the last half of a piece has some, else between characters.

    Each piece is counted as it stands; a cut that raises its count over the capacity moves back. No match of the tokenizer's pattern goes on from
    another character into white space, nor looks back, so a piece between two such places has the tokens that the text has there; others are encoded again.
    ``width``: the bytes of each token.
    """
    raw = text.encode("utf-8")
    ends = [0, *np.cumsum(width[ids]).tolist()]

    def clean(j: int) -> bool:
        if j in (0, n):
            return True
        at = ends[j]
        low = at - 1
        while raw[low] & 0xC0 == 0x80:
            low -= 1
        return raw[at : at + 1] in (b" ", b"\n", b"\t") and not raw[low:at].decode("utf-8").isspace()

    out, first, rune = [], 0, 0
    n = len(ids)
    while first < n:
        stop = min(n, first + capacity)
        while True:
            if stop < n:
                low = first + max(1, (stop - first) // 2)
                cut = next((j for j in range(stop, low, -1) if raw[ends[j] : ends[j] + 1] in (b" ", b"\n", b"\t")), None)
                if cut is None:
                    cut = next((j for j in range(stop, first, -1) if raw[ends[j]] & 0xC0 != 0x80), None)
                if cut is None:  # one character of more tokens than the capacity stays whole
                    cut = next((j for j in range(stop, n) if raw[ends[j]] & 0xC0 != 0x80), n)
                stop = cut
            piece = raw[ends[first] : ends[stop]].decode("utf-8")
            size = stop - first if clean(first) and clean(stop) else len(enc.encode_ordinary(piece))
            if size <= capacity or len(piece) < 2:
                break
            stop -= max(1, size - capacity)
            if stop <= first:
                stop = first + 1
                while stop < n and raw[ends[stop]] & 0xC0 == 0x80:
                    stop += 1
        out.append((rune, rune + len(piece), size))
        rune += len(piece)
        first = stop
    return out


def items(documents: DataFrame, capacity: int, path: str = VOCABULARY) -> DataFrame:
    """The texts as items: one each, or pieces of at most ``capacity`` tokens for a text above it. Texts without tokens are no items."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, width = encoder(path), widths(path)
        for b in batches:
            cols: list[list[int]] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.encode_ordinary(text)
                found = [(0, len(text), len(ids))] if len(ids) <= capacity else split_text(text, ids, capacity, enc, width)
                for i, (s, e, n) in enumerate(found):
                    for c, v in zip(cols, (doc, i, s, e, n)):
                        c.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece_no", "start_rune", "end_rune", "tokens"])

    own = documents.where("text is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return own.mapInArrow(pieces, ITEM).where("tokens > 0")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: the largest items first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        j = bisect.bisect_left(free, (sizes[i], -1))
        if j < len(free):
            room, b = free.pop(j)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > sizes[i]:
            bisect.insort(free, (room - sizes[i], b))
    return bins


def fullest(sizes: list[int], most: int) -> list[int]:
    """Numbers of items whose sizes have the greatest sum within ``most``; earlier ones where there is a choice.

    Sums that the items so far can have are the bits of an integer, of which one for each square root of the items is kept and the others are made again.
    """
    mask, step, bits = (1 << most + 1) - 1, math.isqrt(len(sizes)) + 1, 1
    marks, n = [], 0
    for n, size in enumerate(sizes):
        if n % step == 0:
            marks.append(bits)
        if size <= most:
            bits |= bits << size & mask
        if bits >> most:
            break
    left, out = bits.bit_length() - 1, []
    for k in range(len(marks) - 1, -1, -1):
        part, states = range(k * step, min(n + 1, (k + 1) * step)), [marks[k]]
        for i in part[:-1]:
            states.append(states[-1] | states[-1] << sizes[i] & mask if sizes[i] <= most else states[-1])
        for i, before in zip(reversed(part), reversed(states)):
            if not before >> left & 1:
                out.append(i)
                left -= sizes[i]
    return out


def emptied(a: list[int], others: list[list[int]], fill: dict[int, int], sizes: list[int], capacity: int) -> bool:
    """Tries to empty bin ``a`` into ``others``, each filled as far as its items and those of ``a`` allow; True if it is empty.

    Every exchange leaves less in ``a``, so a try comes to an end: when no other bin can be filled further.
    """
    order = sorted(range(len(others)), key=lambda b: -fill[b])
    own, same, k = sum(sizes[i] for i in a), 0, 0
    while own and same < len(order):
        b = order[k % len(order)]
        k, same = k + 1, same + 1
        if fill[b] >= capacity:
            continue
        both = sorted(a + others[b], key=lambda i: -sizes[i])
        taken = {both[j] for j in fullest([sizes[i] for i in both], capacity)}
        gain = sum(sizes[i] for i in taken) - fill[b]
        if gain > 0:
            a[:], others[b] = [i for i in both if i not in taken], [i for i in both if i in taken]
            own, fill[b], same = own - gain, fill[b] + gain, 0
    if not own and order:  # items without tokens fit anywhere
        others[order[0]].extend(a)
        a.clear()
    return not a


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers within the capacity; items over it get a bin of their own."""
    bins = best_fit([min(s, capacity) for s in sizes], capacity)
    failed = 0
    while failed < PATIENCE:
        fills = [sum(sizes[i] for i in b) for b in bins]
        order = sorted((b for b in range(len(bins)) if fills[b] < capacity), key=lambda b: (fills[b], b))
        if len(order) < 2 or sum(capacity - fills[b] for b in order) < capacity or failed >= len(order):
            break
        a = order[failed]
        under = [b for b in order if b != a]
        if fills[a] > sum(capacity - fills[b] for b in under):
            break
        own, others = list(bins[a]), [list(bins[b]) for b in under]
        if emptied(own, others, {k: fills[b] for k, b in enumerate(under)}, sizes, capacity):
            for k, b in enumerate(under):
                bins[b] = others[k]
            bins.pop(a)
            failed = 0
        else:
            failed += 1
    return bins


def _filler(capacity: int, base: int, smallest: int | None, full: float):
    """Packs a block. A bin stays open (-1) for the next level if it is under ``full`` and has room for an item of ``smallest`` size; None: none stays open."""

    def fill(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["doc_id", "piece_no", "start_rune"]).reset_index(drop=True)
        sizes = own["tokens"].tolist()
        place = [-1] * len(own)
        for n, b in enumerate(pack(sizes, capacity)):
            used = sum(sizes[i] for i in b)
            if smallest is None or used >= full * capacity or capacity - used < smallest:
                for i in b:
                    place[i] = base + (int(own["block"].iloc[0]) << 20) + n
        return own.assign(bin_id=place)

    return fill


def packed(all_items: DataFrame, capacity: int, block: int = BLOCK, full: float = FULL) -> DataFrame:
    """Each item with its ``bin_id``; a bin's tokens are within the capacity. Equal sizes and repeated rows are told apart by their numbers; no items give no rows.

    Each level deals the open items to as many blocks as keep them at ``block`` items, and closes bins that nothing open fits. The last level is
    the one whose items fit one block, or the one after a level that placed less than PAYS of its items; it closes all bins.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    rest = written(all_items)
    done, level, before = None, 0, 0
    while True:
        count, smallest = rest.agg(F.count("*"), F.min("tokens")).first()  # two numbers
        blocks = max(1, -(-count // block))
        last = blocks == 1 or level > 0 and count > (1 - PAYS) * before
        before = count
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(level)), F.lit(blocks)))
        got = written(dealt.groupBy("block").applyInPandas(_filler(capacity, level << 56, None if last else smallest, full), ITEM + ", block bigint, bin_id bigint"))
        now = got.where("bin_id >= 0").drop("block")
        done = now if done is None else done.unionByName(now)
        if last:
            return done
        rest = got.where("bin_id < 0").drop("bin_id", "block")
        level += 1


def fills(packing: DataFrame, capacity: int) -> DataFrame:
    """``bin_id, n_items, tokens, unused`` of each bin."""
    return packing.groupBy("bin_id").agg(F.count("*").alias("n_items"), F.sum("tokens").alias("tokens")).withColumn("unused", F.lit(capacity) - F.col("tokens"))
