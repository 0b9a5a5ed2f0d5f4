"""Most similar vectors for every vector.

A forest of random-projection trees, fitted on a bounded sample, is searched
through one priority queue shared by its trees: each vector gets the leaves
that the queue yields first, more of them the more leaves there are. A vector
is shipped once for each bough (a run of neighbouring leaves) that holds any of
its leaves. The vectors of a leaf are compared exactly (cosine in double
precision after a single-precision screen); the lists of a vector's leaves are
merged. Exact copies are collapsed before the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.lineage import written

#: Vectors that the forest is fitted on, at most. Every vector is indexed and searched.
SAMPLE = 60_000
TREES = 2
#: Leaves probed for a vector: PROBES at least, and GROWTH for each doubling of the leaves of a tree, as recall falls with their number (see README).
PROBES, GROWTH = 8, 1.1
#: Vectors that a leaf should own (with its probes it holds more), sample points that it must have, and vectors of one block of exact comparison.
LEAF, LEAF_SAMPLE, BLOCK = 1000, 12, 32_768
#: Leaves of a bough at most, and vectors that it should own at most.
BOUGH, BOUGH_ROWS = 32, 32_000
#: Rows up to which the list of left-out copies is broadcast.
FEW = 200_000
#: Leaves of a large leaf's own forest that are probed for a vector.
WITHIN = 6
#: Parts over which the smallest ids of a vector with many copies are found.
SALT = 64
#: Copies of one vector that take part in the search; the rest get their lists from the copies' (see ``nearest``).
COPIES = 6


def pack(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: half precision where that loses nothing, else single."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    exact = (half.astype(np.float32) == x).all(1)
    return [half[i].tobytes() if exact[i] else x[i].tobytes() for i in range(len(x))]


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to [0.5, 1): exact, and vectors of one direction and such lengths become equal."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None]).astype(np.float32)


def unpack(rows, dim: int) -> np.ndarray:
    out = np.empty((len(rows), dim), np.float32)
    lengths = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    short = lengths == 2 * dim
    if short.any():
        out[short] = np.frombuffer(b"".join(r for r, s in zip(rows, short) if s), np.float16).reshape(-1, dim)
    if not short.all():
        out[~short] = np.frombuffer(b"".join(r for r, s in zip(rows, short) if not s), np.float32).reshape(-1, dim)
    return out


def usable(vectors: DataFrame, dim: int, id_column: str = "event_id", vector_column: str = "dense_fp16") -> DataFrame:
    """``id, vec`` of the rows with an id and ``dim`` finite components that are not all zero; ``vec`` is scaled (see there), which changes no cosine."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            ok = (lengths == dim) & ~lists.is_null().to_numpy(False) & ~ids.is_null().to_numpy(False)
            take = np.flatnonzero(ok)
            if not len(take):
                continue
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float32)
            x = values[lists.offsets.to_numpy()[:-1][take][:, None] + np.arange(dim)]
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            take, x = take[good], scaled(x[good])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(take)), pa.array(pack(x), pa.binary())], ["id", "vec"])

    return vectors.select(F.col(id_column).cast("string").alias("id"), F.col(vector_column).cast("array<float>").alias("v")).mapInArrow(packed, "id string, vec binary")


def unit(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    y /= np.abs(y).max(1, keepdims=True)
    return (y / np.sqrt((y * y).sum(1, keepdims=True))).astype(np.float32)


class Tree:
    """Inner node i: hyperplane ``normals[i]``, ``offsets[i]``, children ``kids[i]``; a child below zero is leaf -1 - child."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normals, self.offsets, self.kids = [], [], []
        self.leaves = 0
        self.root = self._split(x, np.arange(len(x)), leaf, rng)
        self.normals = np.array(self.normals, np.float32).reshape(len(self.kids), x.shape[1])
        self.offsets, self.kids = np.array(self.offsets, np.float32), np.array(self.kids, np.int64).reshape(-1, 2)

    def _split(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(rows) > leaf:
            for _ in range(4):
                own = x[rows]
                a, b = own[rng.choice(len(rows), 2, replace=False)]
                for _ in range(3):  # two means on the sphere
                    side = own @ (a - b) > 0
                    if side.all() or not side.any():
                        break
                    a, b = own[side].mean(0), own[~side].mean(0)
                normal = a - b
                length = np.linalg.norm(normal)
                if length < 1e-9:
                    continue
                normal = normal / length
                at = own @ normal
                offset = float(np.median(at))
                right = at > offset
                if 0.05 * len(rows) < right.sum() < 0.95 * len(rows):
                    i = len(self.kids)
                    self.normals.append(normal), self.offsets.append(offset), self.kids.append([0, 0])
                    self.kids[i] = [self._split(x, rows[~right], leaf, rng), self._split(x, rows[right], leaf, rng)]
                    return i
        self.leaves += 1
        return -self.leaves


class Forest:
    """Trees in one numbering of nodes and leaves."""

    def __init__(self, trees: list[Tree]):
        node, leaf = np.cumsum([0, *(len(t.kids) for t in trees)]), np.cumsum([0, *(t.leaves for t in trees)])
        self.normals = np.concatenate([t.normals for t in trees])
        self.offsets = np.concatenate([t.offsets for t in trees])
        move = lambda k, i: np.where(k >= 0, k + node[i], k - leaf[i])
        self.kids = np.concatenate([move(t.kids, i) for i, t in enumerate(trees)])
        self.roots = np.array([int(move(np.array(t.root), i)) for i, t in enumerate(trees)])
        self.leaves = int(leaf[-1])

    def probe(self, x: np.ndarray, probes: int) -> np.ndarray:
        """For each row the leaves that a priority queue over all trees yields first, the best side of the first tree's root at its head.

        A queue entry's priority is the smallest signed distance to a hyperplane on its way (positive: the row's own side).
        """
        n = len(x)
        out = np.full((n, probes), -1, np.int64)
        width = len(self.roots)
        node = np.tile(self.roots, (n, 1))
        rank = np.full((n, width), np.inf)
        rank[:, 0] = np.inf
        every = np.arange(n)
        for p in range(probes):
            best = rank.argmax(1)
            at, lead = node[every, best].copy(), rank[every, best].copy()
            rank[every, best] = -np.inf
            spare_node, spare_rank = [], []
            while True:
                inner = np.flatnonzero((at >= 0) & (lead > -np.inf))
                if not len(inner):
                    break
                i = at[inner]
                gap = np.einsum("ij,ij->i", x[inner], self.normals[i]) - self.offsets[i]
                side = (gap > 0).astype(np.int64)
                sn, sr = np.full(n, -1, np.int64), np.full(n, -np.inf)
                sn[inner], sr[inner] = self.kids[i, 1 - side], np.minimum(lead[inner], -np.abs(gap))
                spare_node.append(sn), spare_rank.append(sr)
                at[inner], lead[inner] = self.kids[i, side], np.minimum(lead[inner], np.abs(gap))
            out[:, p] = np.where(lead > -np.inf, -1 - at, -1)
            if spare_node:
                node, rank = np.column_stack([node, *spare_node]), np.column_stack([rank, *spare_rank])
            if node.shape[1] > 64:  # the entries that can still be reached
                keep = np.argsort(-rank, 1, kind="stable")[:, :probes]
                node, rank = np.take_along_axis(node, keep, 1), np.take_along_axis(rank, keep, 1)
        return out


def fit(sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> Forest:
    """Trees whose leaves will hold about ``leaf`` of ``rows`` vectors, and at least LEAF_SAMPLE of the sample."""
    rng = np.random.default_rng(seed)
    share = max(LEAF_SAMPLE, int(leaf * len(sample) / max(1, rows)))
    return Forest([Tree(sample, share, rng) for _ in range(trees)])


def probes_of(forest: Forest) -> int:
    """Leaves to probe for a vector, so that recall holds as the leaves grow in number."""
    return max(PROBES, round(GROWTH * np.log2(max(1, forest.leaves / len(forest.roots)))))


def best_of_block(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, cosine in millionths) of each row's k nearest others in the block, by rounded cosine, then id. ``ids`` are sorted."""
    n = len(ids)
    u = unit(x)
    exact = x.astype(np.float64)
    exact /= np.abs(exact).max(1, keepdims=True)
    exact /= np.sqrt((exact * exact).sum(1, keepdims=True))
    rows_out, near_out, cos_out = [], [], []
    step = max(1, 4_000_000 // max(n, 1))
    fold = 32
    for a in range(0, n, step):
        b = min(n, a + step)
        s = u[a:b] @ u.T
        s[np.arange(b - a), np.arange(a, b)] = -2
        if n - 1 > k:
            if n >= fold * (k + 4):
                # the k-th largest of the maxima of strided groups is no larger than the k-th largest of all
                top = s[:, : n // fold * fold].reshape(b - a, fold, n // fold).max(1)
                floor = np.partition(top, top.shape[1] - k, 1)[:, -k] - 4e-6
            else:
                floor = np.partition(s, n - k, 1)[:, -k] - 4e-6
            r, c = np.nonzero(s >= floor[:, None])
        else:
            r, c = np.nonzero(s > -2)
        cos = np.rint(np.einsum("ij,ij->i", exact[r + a], exact[c]) * 1e6).astype(np.int64)
        order = np.lexsort((c, -cos, r))
        r, c, cos = r[order], c[order], cos[order]
        first = np.searchsorted(r, r)
        keep = np.arange(len(r)) - first < k
        rows_out.append(r[keep] + a), near_out.append(c[keep]), cos_out.append(cos[keep])
    return np.concatenate(rows_out), np.concatenate(near_out), np.concatenate(cos_out)


def _blocks(ids: np.ndarray, x: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of the parts in which a leaf is compared: all of it, or the leaves of a small forest of its own with WITHIN probes if it is large. A part that its trees can't split (all but equal vectors) is compared whole."""
    if len(ids) <= BLOCK:
        yield np.arange(len(ids))
        return
    u = unit(x)
    leaves = Forest([Tree(u, BLOCK // 4, np.random.default_rng(seed)) for seed in (1, 2)]).probe(u, WITHIN)
    for own in np.unique(leaves[leaves >= 0]):
        yield np.flatnonzero((leaves == own).any(1))


def nearest(vectors: DataFrame, rows: int, k: int = 5, dim: int = 128, id_column: str = "event_id", vector_column: str = "dense_fp16", trees: int = TREES, probes: int | None = None, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """``id, near`` with ``near`` the k most similar others as ``array<struct<cos: bigint, id: string>>`` (cosine in millionths), best first; ties by id.

    ``rows`` is about how many rows there are (it sets the sampled fraction). One row counts per id (of several vectors of an id, the
    smallest in bytes). Vectors that are null, of another length, not finite or all zero have no neighbours and are none.
    Of equal vectors, COPIES (the smallest ids, k + 1 at least) are searched; each further copy has the same
    list as the first one but for the first one itself, which is nearest to it. Fewer than k + 1 usable vectors give shorter lists, an empty table none.
    """
    copies = max(COPIES, k + 1)
    every = usable(vectors, dim, id_column, vector_column)
    part = every.sample(fraction=min(1.0, sample * 0.9 / max(1, rows)), seed=11) if rows > sample else every
    fitted = unpack([r[0] for r in part.select("vec").limit(sample).toPandas().itertuples(index=False)], dim)
    forest = fit(unit(fitted), rows, trees, leaf) if len(fitted) else Forest([Tree(np.zeros((0, dim), np.float32), 1, np.random.default_rng(0))])
    probes = probes or probes_of(forest)
    bough = max(1, min(BOUGH, BOUGH_ROWS * forest.leaves // (len(forest.roots) * max(1, rows))))
    # keys stand for the vectors, so that what is left out is found without shuffling any vector
    keyed = every.select("id", F.unhex(F.md5("vec")).alias("key"))
    per = written(keyed.groupBy("id").agg(F.min("key").alias("key"), F.max("key").alias("last")))
    several = per.where("key < last").select("id", F.col("key").alias("first"))
    others = keyed.join(several, "id").where("key <> first").select("id", "key", F.lit(False).alias("copied")).distinct()
    many = per.groupBy("key").count().where(F.col("count") > copies).select("key")
    # of a key with many ids the smallest are found over parts first, so no task gets all of them
    salt = W.partitionBy("key", F.pmod(F.xxhash64("id"), F.lit(SALT))).orderBy("id")
    heavy = per.select("id", "key").join(F.broadcast(many) if many.limit(FEW + 1).count() <= FEW else many, "key", "left_semi")
    least = heavy.withColumn("n", F.row_number().over(salt)).where(F.col("n") <= copies).withColumn("copy", F.row_number().over(W.partitionBy("key").orderBy("id"))).where(F.col("copy") <= copies)
    left_out = written(heavy.join(least.select("id", "key"), ["id", "key"], "left_anti").select("id", "key", F.lit(True).alias("copied")).unionByName(others))
    out = left_out.count()
    searched = every
    if out:
        without = left_out.select("id", "key")
        searched = every.withColumn("key", F.unhex(F.md5("vec"))).join(F.broadcast(without) if out <= FEW else without, ["id", "key"], "left_anti").select("id", "vec")

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            leaves = forest.probe(unit(unpack(b.column(1).to_pylist(), dim)), probes)
            leaves.sort(1)
            r, p = np.nonzero(leaves >= 0)
            own = leaves[r, p].astype(np.int32)
            at = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(own // bough, prepend=-1) != 0))
            take = pa.array(r[at])
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(r)).astype(np.int32)), pa.array(own))
            yield pa.RecordBatch.from_arrays([pa.array(own[at] // bough), lists, b.column(0).take(take), b.column(1).take(take)], ["bough", "leaves", "id", "vec"])

    def compared(own: pd.DataFrame) -> pd.DataFrame:
        own = own.drop_duplicates("id").sort_values("id")
        ids, x = own["id"].to_numpy(object), unpack(own["vec"].tolist(), dim)
        lengths = own["leaves"].map(len).to_numpy()
        leaves, row = np.concatenate(own["leaves"].to_numpy()), np.repeat(np.arange(len(ids)), lengths)
        got = []
        for one in np.unique(leaves):
            rows = row[leaves == one]
            for part in _blocks(ids[rows], x[rows]):
                if len(part) > 1:
                    r, c, cos = best_of_block(ids[rows[part]], x[rows[part]], k)
                    got.append((rows[part][r], rows[part][c], cos))
        if not got:
            return pd.DataFrame({"id": ids, "cos": [[] for _ in ids], "near": [[] for _ in ids]})
        r, c, cos = (np.concatenate(g) for g in zip(*got))
        order = np.lexsort((c, -cos, r))
        r, c, cos = r[order], c[order], cos[order]
        new = (np.diff(r, prepend=-1) != 0) | (np.diff(c, prepend=-1) != 0)  # a pair has the same cosine in every leaf
        r, c, cos = r[new], c[new], cos[new]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c, cos = r[keep], c[keep], cos[keep]
        at = np.searchsorted(r, np.arange(len(ids) + 1))
        near = ids[c]
        return pd.DataFrame({"id": ids, "cos": [cos[i:j].tolist() for i, j in zip(at, at[1:])], "near": [near[i:j].tolist() for i, j in zip(at, at[1:])]})

    lists = searched.mapInArrow(routed, "bough int, leaves array<int>, id string, vec binary").groupBy("bough").applyInPandas(compared, "id string, cos array<bigint>, near array<string>")
    pairs = lists.select("id", F.arrays_zip(F.transform("cos", lambda x: -x).alias("cos"), F.col("near").alias("id")).alias("near"))
    merged = pairs.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    near = merged.select("id", F.transform("near", lambda x: F.struct((-x["cos"]).alias("cos"), x["id"].alias("id"))).alias("near"))
    return _with_copies(near, left_out.where("copied").select(F.col("id").alias("copy_id"), "key"), keyed, k) if out else near


def _with_copies(near: DataFrame, further: DataFrame, keyed: DataFrame, k: int) -> DataFrame:
    """Adds the lists of the copies that were not searched: that of their first copy, with itself at its head."""
    first = keyed.join(further.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("id").alias("id"))
    lists = first.join(near, "id").select("key", F.slice(F.concat(F.array(F.struct(F.lit(1_000_000).cast("bigint").alias("cos"), F.col("id").alias("id"))), "near"), 1, k).alias("near"))
    return near.unionByName(further.join(lists, "key").select(F.col("copy_id").alias("id"), "near"))


def pairs(near: DataFrame) -> DataFrame:
    """``id_a, id_b`` (a < b), once each, of every vector and its neighbours."""
    both = near.select("id", F.explode("near").alias("n"))
    return both.select(F.least("id", "n.id").alias("id_a"), F.greatest("id", "n.id").alias("id_b")).distinct()
