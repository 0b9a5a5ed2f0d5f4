"""The personalized walk over the event graph, without a table of its edges.

All edges of a context, claim or term weigh the same, so the graph is kept as blocks of events with the numbers of their nodes. A block
works its part out in arrays; only nodes that lie in several blocks are summed between them, at a home by the hash of their key. The graph has two sides,
so two rounds take one exchange: events to nodes to events. Ranks of even and odd rounds are two chains, carried side by side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.lineage import dropped, written

#: Events and edges after which a block is closed; a task closes one at its end.
BLOCK, BLOCK_EDGES = 1 << 16, 1 << 22
#: A row of any kind: a block's names, its edges, its state, a message to a home and the sums that come back.
ROW = "block bigint, kind string, home int, events array<string>, keys array<string>, a binary, b binary, c binary, d binary, e binary, f binary"
_COLUMNS = [x.split()[0] for x in ROW.split(", ")]
_TYPES = dict(zip(_COLUMNS, [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.binary()] * 6]))


def _rows(*rows: dict) -> pa.Table:
    return pa.table({c: pa.array([r.get(c) for r in rows], t) for c, t in _TYPES.items()})


def _array(value: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(value, kind)


def _small(numbers: np.ndarray, n: int) -> bytes:
    """Numbers under n in as few bytes as they need."""
    return numbers.astype(np.uint16 if n <= 1 << 16 else np.uint32).tobytes()


def _numbers(value: bytes, n: int) -> np.ndarray:
    return _array(value, np.uint16 if n <= 1 << 16 else np.uint32)


def _homes(keys: list[str], homes: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, cuts): positions of the keys by home, and where each home begins in them."""
    home = (pd.util.hash_array(np.array(keys, object), categorize=False) % homes).astype(np.int64) if keys else np.zeros(0, np.int64)
    return np.argsort(home, kind="stable"), np.searchsorted(np.sort(home), np.arange(homes + 1))


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ``event_id, nodes, p0``: names, edges per event, numbers of the nodes, degrees within the block."""
    first, made, held, edges = TaskContext.get().partitionId() << 32, 0, [], 0

    def closed() -> pa.Table:
        x = pa.Table.from_batches(held)
        lists = x["nodes"].combine_chunks()
        coded = lists.flatten().dictionary_encode()
        at, n = coded.indices.to_numpy(), len(coded.dictionary)
        lens = lists.value_lengths().to_numpy().astype(np.int32)
        return _rows({"block": first + made, "kind": "block", "events": x["event_id"].to_pylist(), "keys": coded.dictionary.to_pylist(), "a": lens.tobytes(), "b": _small(at, n), "c": np.bincount(at, minlength=n).astype(np.int32).tobytes(), "d": x["p0"].to_numpy().astype(float).tobytes()})

    for x in parts:
        held.append(x)
        edges += len(x.column("nodes").flatten())
        if sum(map(len, held)) >= BLOCK or edges >= BLOCK_EDGES:
            yield from closed().to_batches()
            made, held, edges = made + 1, [], 0
    if sum(map(len, held)):
        yield from closed().to_batches()


def _spread(homes: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's nodes with their degrees, to their homes."""
    for x in parts:
        for block, keys, deg in zip(x["block"].to_pylist(), x["keys"], x["c"].to_pylist()):
            own, deg = keys.as_py(), _array(deg, np.int32)
            order, cuts = _homes(own, homes)
            rows = [{"block": block, "kind": "nodes", "home": h, "keys": [own[i] for i in order[cuts[h] : cuts[h + 1]]], "a": deg[order[cuts[h] : cuts[h + 1]]].tobytes()} for h in range(homes) if cuts[h] < cuts[h + 1]]
            if rows:
                yield from _rows(*rows).to_batches()


def weight(kind: str, df: int, total: int) -> float:
    """Of an edge to a context, claim or term that so many of ``total`` events have, as in ``search.graph``; 0 for a term that is not rare."""
    if kind == "concept":
        return float(Decimal(repr(math.log(1 + float(max(1, total)) / df))).quantize(Decimal("1e-6"), ROUND_HALF_UP)) if df <= max(2, total // 20) else 0.0
    return {"context": 1.0, "semantic": 0.8}[kind]


def _counted(total: int, x: pa.Table) -> pa.Table:
    """At a home: for each block its nodes' degrees and weights over all blocks, their numbers here, and which of them this block shares (1) and reports (2)."""
    blocks, keys = x["block"].to_pylist(), x["keys"].combine_chunks()
    coded = keys.flatten().dictionary_encode()
    at, n = coded.indices.to_numpy(), len(coded.dictionary)
    deg = np.bincount(at, np.concatenate([_array(v, np.int32) for v in x["a"].to_pylist()]), n).astype(np.int64)
    kinds = [k.partition(":")[0] for k in coded.dictionary.to_pylist()]
    of = {pair: weight(*pair, total) for pair in set(zip(kinds, deg.tolist()))}
    w = np.array([of[pair] for pair in zip(kinds, deg.tolist())])
    mark = (np.bincount(at, minlength=n) > 1).astype(np.uint8)
    first = np.zeros(len(at), np.uint8)
    first[np.unique(at, return_index=True)[1]] = 2
    ends = np.cumsum([0, *keys.value_lengths().to_pylist()])
    slices = [slice(a, b) for a, b in zip(ends, ends[1:])]
    return _rows(*({"block": b, "kind": "counts", "home": h, "a": deg[at[s]].tobytes(), "b": w[at[s]].tobytes(), "c": at[s].astype(np.int32).tobytes(), "d": (mark[at[s]] | first[s]).tobytes()} for b, h, s in zip(blocks, x["home"].to_pylist(), slices)))


def _kinds(x: pa.Table) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in x.to_pylist():
        out.setdefault(r["kind"], []).append(r)
    return out


def _finished(homes: int, x: pa.Table) -> pa.Table:
    """The edges of a block: those to kept nodes, with the nodes' weights, degrees, marks and (home, node here, number there) of the shared ones."""
    own = _kinds(x)
    block = own["block"][0]
    n = len(block["keys"])
    order, cuts = _homes(block["keys"], homes)
    w, deg, mark, route = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.uint8), []
    for r in sorted(own.get("counts", []), key=lambda r: r["home"]):
        at = order[cuts[r["home"]] : cuts[r["home"] + 1]]
        deg[at], w[at], mark[at] = _array(r["a"], np.int64), _array(r["b"], float), _array(r["d"], np.uint8)
        shared = (mark[at] & 1 > 0) & (w[at] > 0)
        route.append(np.stack([np.full(shared.sum(), r["home"]), at[shared], _array(r["c"], np.int32)[shared]], 1).astype(np.int32))
    lens, at = _array(block["a"], np.int32), _numbers(block["b"], n)
    kept = w[at] > 0
    lens = np.bincount(np.repeat(np.arange(len(lens)), lens)[kept], minlength=len(lens)).astype(np.int32)
    return _rows({"block": block["block"], "kind": "edges", "home": n, "a": lens.tobytes(), "b": _small(at[kept], n), "c": w.tobytes(), "d": deg.astype(np.int32).tobytes() + mark.tobytes(), "e": np.concatenate([np.zeros((0, 3), np.int32), *route]).tobytes(), "f": block["d"]})


class _Block:
    def __init__(self, row: dict, damping: float):
        n, self.damping, self.block = row["home"], damping, row["block"]
        lens, self.at, self.w = _array(row["a"], np.int32), _numbers(row["b"], n), _array(row["c"], float)
        self.deg, self.mark = np.maximum(_array(row["d"][: 4 * n], np.int32), 1), _array(row["d"][4 * n :], np.uint8)
        self.route, self.p0, self.n = _array(row["e"], np.int32).reshape(-1, 3), _array(row["f"], float), n
        self.cuts = np.flatnonzero(np.diff(self.route[:, 0], prepend=-1, append=-1)) if len(self.route) else np.zeros(1, int)
        self.event = np.repeat(np.arange(len(lens)), lens)
        self.out = np.bincount(self.event, self.w[self.at], len(lens))

    def down(self, x: np.ndarray) -> np.ndarray:
        """Events to nodes."""
        share = np.divide(x, self.out, out=np.zeros(len(x)), where=self.out > 0)
        return self.damping * self.w * np.bincount(self.at, share[self.event], self.n)

    def up(self, y: np.ndarray) -> np.ndarray:
        """Nodes to events."""
        return self.damping * np.bincount(self.event, (y / self.deg)[self.at], len(self.p0))

    def sent(self, a: np.ndarray, b: np.ndarray) -> pa.Table:
        """The state and the messages of the next exchange."""
        y = np.stack([self.down(a), self.down(b)], 1)
        rows = [{"block": self.block, "kind": "message", "home": int(r[0, 0]), "a": np.ascontiguousarray(r[:, 2]).tobytes(), "b": y[r[:, 1]].tobytes()} for s, e in zip(self.cuts, self.cuts[1:]) for r in [self.route[s:e]]]
        return _rows({"block": self.block, "kind": "state", "a": a.tobytes(), "b": b.tobytes()}, *rows)

    def summed(self, state: dict, sums: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both chains at the events before the exchange and at the nodes after it."""
        a, b = _array(state["a"], float), _array(state["b"], float)
        y = np.stack([self.down(a), self.down(b)], 1)
        of = {int(self.route[s, 0]): self.route[s:e, 1] for s, e in zip(self.cuts, self.cuts[1:])}
        for r in sums:
            y[of[r["home"]]] = _array(r["b"], float).reshape(-1, 2)
        return a, b, y[:, 0], y[:, 1]


def _home_sums(x: pa.Table) -> pa.Table:
    at = [_array(v, np.int32) for v in x["a"].to_pylist()]
    y = [_array(v, float).reshape(-1, 2) for v in x["b"].to_pylist()]
    total = np.zeros((max(int(v.max()) for v in at) + 1, 2))
    for i in sorted(range(len(at)), key=x["block"].to_pylist().__getitem__):  # in one order, so that equal runs give equal sums
        total[at[i]] += y[i]
    return _rows(*({"block": b, "kind": "sums", "home": h, "b": total[v].tobytes()} for b, h, v in zip(x["block"].to_pylist(), x["home"].to_pylist(), at)))


def _begin(damping: float, back: float, x: pa.Table) -> pa.Table:
    block = _Block(x.to_pylist()[0], damping)
    return block.sent(block.p0, back * block.p0)


def _step(damping: float, back: tuple[float, float], x: pa.Table) -> pa.Table:
    own = _kinds(x)
    block = _Block(own["edges"][0], damping)
    _, _, even, odd = block.summed(own["state"][0], own.get("sums", []))
    return block.sent(back[0] * block.p0 + block.up(even), back[1] * block.p0 + block.up(odd))


def _end(damping: float, back: float, even_rounds: bool, x: pa.Table) -> pa.Table:
    own = _kinds(x)
    block, names = _Block(own["edges"][0], damping), own["block"][0]
    _, b, even, odd = block.summed(own["state"][0], own.get("sums", []))
    events = back * block.p0 + block.up(even) if even_rounds else b
    nodes = np.where(block.mark & 2 > 0, odd if even_rounds else even, 0)
    ids = [f"event:{names['events'][i]}" for i in np.flatnonzero(events > 0)] + [names["keys"][i] for i in np.flatnonzero(nodes > 0)]
    return pa.table({"id": pa.array(ids, pa.string()), "rank": pa.array(np.concatenate([events[events > 0], nodes[nodes > 0]]), pa.float64())})


def _each(rows: DataFrame, key: str, f: Callable[[pa.Table], pa.Table], schema: str = ROW) -> DataFrame:
    def group(x: pa.Table) -> pa.Table:
        return f(x)

    return rows.groupBy(key).applyInArrow(group, schema)


def event_walk(documents: DataFrame, total: int, seeds: DataFrame, rounds: int = 30, damping: float = 0.85) -> DataFrame:
    """``id, rank``: what ``search.pagerank`` gives on ``search.graph`` after so many rounds from seeds (``event_id, weight``; few) that are events.

    ``documents``: ``event_id`` (unique), ``context_id``, ``terms`` (arrays, with or without repeats), ``claims`` (array of node ids); ``total`` counts the live events.
    """
    if rounds < 1:
        raise ValueError("rounds must be positive")
    empty = F.array().cast("array<string>")
    named = lambda kind, c: F.coalesce(F.transform(F.array_distinct(c), lambda x: F.concat(F.lit(kind + ":"), x)), empty)
    whole = seeds.agg(F.sum("weight").alias("s")).first()["s"] or 1.0  # one number
    start = seeds.groupBy("event_id").agg(F.greatest(F.sum("weight") / whole, F.lit(1e-200)).alias("p0"))  # a seed without weight still reaches its nodes
    nodes = F.concat(F.when(F.col("context_id") != "", F.array(F.concat(F.lit("context:"), "context_id"))).otherwise(empty), named("semantic", F.col("claims")), named("concept", F.col("terms")))
    rows = documents.join(F.broadcast(start), "event_id", "left").select("event_id", nodes.alias("nodes"), F.coalesce("p0", F.lit(0.0)).alias("p0"))
    blocks = written(rows.mapInArrow(_blocks, ROW), freed=True)
    homes = max(1, blocks.count())
    counts = _each(blocks.select("block", "keys", "c").mapInArrow(partial(_spread, homes), ROW), "home", partial(_counted, total))
    edges = written(_each(blocks.unionByName(counts), "block", partial(_finished, homes)), freed=True)

    lost = lambda x: pa.table({"lost": [float(b.p0[b.out == 0].sum()) for r in x.to_pylist() for b in [_Block(r, damping)]]})
    dangling = _each(edges, "block", lost, "lost double").agg(F.coalesce(F.sum("lost"), F.lit(0.0)).alias("lost")).first()["lost"]  # one number
    back = [1.0]  # what returns to the seeds before each round
    for _ in range(rounds + 1):
        back.append(1 - damping * (1 - dangling * back[-1]))
    state = written(_each(edges, "block", partial(_begin, damping, back[1])), freed=True)
    exchanges = (rounds + 1) // 2
    for i in range(exchanges):
        sums = _each(state.where("kind = 'message'"), "home", _home_sums)
        rows = edges.unionByName(state.where("kind = 'state'")).unionByName(sums)
        if i == exchanges - 1:
            return _each(rows.unionByName(blocks.select("block", "kind", "home", "events", "keys", *(F.lit(None).cast("binary").alias(c) for c in "abcdef"))), "block", partial(_end, damping, back[2 * i + 2], rounds % 2 == 0), "id string, rank double").select("id", F.round("rank", 6).alias("rank"))
        old, state = state, written(_each(rows, "block", partial(_step, damping, (back[2 * i + 2], back[2 * i + 3]))), freed=True)
        dropped(old)
