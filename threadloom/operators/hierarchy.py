"""Parent–child links to full hierarchies.

Components are found by pointer doubling over the (single) parent link, each
component of bounded size is co-located and walked depth first with node
colouring; components beyond the bound get their paths by doubling instead, so
that no group of unbounded size ever reaches one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import clean_key
from threadloom.operators.lineage import checkpointed, written
from threadloom.operators.windows import parted, running

OUT = "context_id string, parent_id string, root_id string, depth int, path array<string>, n_descendants bigint, pre_order bigint, last_order bigint, cycle_id string, back_edge boolean"


def last_parents(contexts: DataFrame) -> DataFrame:
    """One row per cleaned ``context_id``: its last non-empty ``parent_id`` by ``ledger_seq`` that is itself a context, else null.

    Ids are compared trimmed and in lower case; rows without an id are no contexts. Of rows with one
    ``ledger_seq`` the greatest parent counts; a null ``ledger_seq`` is before all others.
    """
    rows = contexts.select(clean_key(F.col("context_id")).alias("context_id"), clean_key(F.col("parent_id")).alias("parent_id"), F.coalesce(F.col("ledger_seq"), F.lit(-(2**63))).alias("seq")).where(F.col("context_id").isNotNull())
    last = rows.groupBy("context_id").agg(F.max(F.when(F.col("parent_id").isNotNull(), F.struct("seq", "parent_id"))).alias("last")).select("context_id", F.col("last.parent_id").alias("parent_id"))
    known = last.select(F.col("context_id").alias("known"))
    return last.join(known, last.parent_id == known.known, "left").select("context_id", F.col("known").alias("parent_id"))


def components(parents: DataFrame) -> DataFrame:
    """``context_id, parent_id, component_id, in_tree, depth, on_cycle``: the root's id for trees, the smallest id on the cycle for the rest.

    After k rounds a node points 2**k parents up, and those of a depth under 2**k have met their root. Rounds end when no node is left
    that has not; or when a round changed nothing (a deeper node of a tree would have one of each smaller depth above it) and 2**k is
    at least the number of the rest: then each of them points onto its cycle and has seen all of it.
    """
    start = parents.withColumn("up", F.coalesce("parent_id", "context_id")).select("context_id", "parent_id", "up", F.col("parent_id").isNull().alias("done"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"), F.least("context_id", "up").alias("least"))
    state = checkpointed(start)
    k, before = 0, -1
    while True:
        open_nodes = state.where(~F.col("done")).count()
        if open_nodes == 0 or open_nodes == before and 2**k >= open_nodes:
            break
        before = open_nodes
        up = state.select(F.col("context_id").alias("u"), F.col("up").alias("u_up"), F.col("done").alias("u_done"), F.col("depth").alias("u_depth"), F.col("least").alias("u_least"))
        moved = state.where(~F.col("done")).join(up, F.col("up") == F.col("u")).select("context_id", "parent_id", F.col("u_up").alias("up"), F.col("u_done").alias("done"), (F.col("depth") + F.col("u_depth")).alias("depth"), F.least("least", "u_least").alias("least"))
        state = checkpointed(state.where("done").unionByName(moved))
        k += 1
    if open_nodes == 0:
        return state.select("context_id", "parent_id", F.col("up").alias("component_id"), F.col("done").alias("in_tree"), "depth", F.lit(False).alias("on_cycle"))
    # far enough up every open node is on its cycle, and each node of a cycle is that far above one of them
    on = state.where(~F.col("done")).select(F.col("context_id").alias("u"), F.col("least").alias("cycle"))
    members = state.where(~F.col("done")).select(F.col("up").alias("member")).distinct()
    named = state.join(on, state.up == on.u, "left").join(members, state.context_id == members.member, "left")
    return named.select("context_id", "parent_id", F.when(F.col("done"), F.col("up")).otherwise(F.col("cycle")).alias("component_id"), F.col("done").alias("in_tree"), F.when(F.col("done"), F.col("depth")).alias("depth"), F.col("member").isNotNull().alias("on_cycle"))


def walk(ids: list[str], parents: list[str | None]) -> Iterator[tuple]:
    """Depth-first walk of whole components, iterative, with node colouring; rows come as nodes are finished, so that no more than a node's own path is held.

    White nodes are unseen, grey ones on the present chain, black ones finished; a parent link to a grey node is a back
    edge and closes a cycle. Children are taken in order of their id. Rows: as OUT.
    """
    at = {x: i for i, x in enumerate(ids)}
    up = [at.get(p, -1) if p is not None else -1 for p in parents]
    children: list[list[int]] = [[] for _ in ids]
    for i in sorted(range(len(ids)), key=ids.__getitem__):
        if up[i] >= 0:
            children[up[i]].append(i)
    colour, cycle, back = bytearray(len(ids)), [None] * len(ids), [False] * len(ids)
    for i in range(len(ids)):
        chain, x = [], i
        while x >= 0 and colour[x] == 0:
            colour[x] = 1
            chain.append(x)
            x = up[x]
        name = None
        if x >= 0 and colour[x] == 1:
            ring = chain[chain.index(x) :]
            name = min(ids[j] for j in ring)
            for j in ring:  # the link that closes the cycle in a walk from its smallest member
                back[j] = ids[up[j]] == name
        elif x >= 0:
            name = cycle[x]
        for j in chain:
            colour[j], cycle[j] = 2, name
    clock = 0
    for root in sorted((i for i in range(len(ids)) if up[i] < 0), key=ids.__getitem__):
        path: list[str] = []
        stack = [(root, -1)]
        while stack:
            i, pre = stack.pop()
            if pre >= 0:
                yield (ids[i], parents[i], ids[root], len(path) - 1, list(path), clock - 1 - pre, pre, clock - 1, None, False)
                path.pop()
                continue
            path.append(ids[i])
            stack.append((i, clock))
            clock += 1
            stack.extend((c, -1) for c in reversed(children[i]))
    for i, name in enumerate(cycle):
        if name is not None:
            yield (ids[i], parents[i], None, None, None, None, None, None, name, back[i])


#: Rows, and path entries, of a batch that a walk hands on.
ROWS, ENTRIES = 10_000, 1_000_000


def _walk_groups(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one partition hold whole components, each walked on its own; results are handed on in batches of bounded size."""
    names = [x.split()[0] for x in OUT.split(", ")]
    whole = pd.concat(list(parts) or [pd.DataFrame({"component_id": [], "context_id": [], "parent_id": []})])
    out: list[tuple] = []
    entries = 0
    for _, own in whole.groupby("component_id", sort=True):
        up = [None if p is None or p != p else p for p in own["parent_id"]]
        for row in walk(own["context_id"].tolist(), up):
            out.append(row)
            entries += row[3] or 0
            if len(out) >= ROWS or entries >= ENTRIES:
                yield pd.DataFrame(out, columns=names)
                out, entries = [], 0
    if out:
        yield pd.DataFrame(out, columns=names)


def hierarchy(contexts: DataFrame, max_component: int = 1_000_000) -> DataFrame:
    """Path, depth, root, descendants and cycle of each context.

    ``context_id, parent_id`` (cleaned; null for a root), ``root_id``, ``depth`` (0 at a root), ``path`` (root first),
    ``n_descendants``, ``[pre_order, last_order]`` (a context's descendants are the contexts of its root whose ``pre_order`` lies
    in ``(pre_order, last_order]``), ``cycle_id`` (smallest id of the cycle that the context lies on or runs into; then there is no
    root, path or depth) and ``back_edge`` (the link that closes a cycle: that to its smallest member).

    Components of up to ``max_component`` contexts are walked in one task each; a larger one is worked out by doubling, with
    the same result. Null, blank, repeated and uneven ids: see ``last_parents``. An empty table gives no rows.
    """
    nodes = written(components(last_parents(contexts)))
    sizes = nodes.groupBy("component_id").count().where(F.col("count") > max_component).select("component_id")
    oversized = checkpointed(sizes)
    if not oversized.take(1):
        return _walked(nodes)
    large = nodes.join(oversized, "component_id", "left_semi")
    return _walked(nodes.join(oversized, "component_id", "left_anti")).unionByName(_doubled(written(large)))


def _walked(nodes: DataFrame) -> DataFrame:
    return nodes.select("component_id", "context_id", "parent_id").repartition("component_id").mapInPandas(_walk_groups, OUT)


def _doubled(nodes: DataFrame) -> DataFrame:
    """The same columns without co-location: path pieces are joined as pointers double."""
    tree = nodes.where("in_tree")
    state = tree.select("context_id", F.coalesce("parent_id", F.lit(None)).alias("up"), F.array("context_id").alias("piece"))
    while True:
        state = checkpointed(state)
        if not state.where(F.col("up").isNotNull()).take(1):
            break
        above = state.select(F.col("context_id").alias("u"), F.col("up").alias("u_up"), F.col("piece").alias("u_piece"))
        state = state.join(above, state.up == above.u, "left").select("context_id", F.col("u_up").alias("up"), F.when(F.col("u").isNull(), F.col("piece")).otherwise(F.concat("u_piece", "piece")).alias("piece"))
    state = state.drop("up")
    below = state.select(F.explode("piece").alias("context_id")).groupBy("context_id").agg((F.count("*") - 1).alias("n_descendants"))
    # a node comes after its parent and the smaller siblings' subtrees; a parent's children are summed over parts
    sized = tree.select("context_id", "parent_id").join(below, "context_id")
    placed = running(parted(sized, "parent_id", "context_id"), "parent_id", ("context_id",), F.col("n_descendants") + 1, "upto")
    step = written(placed.select(F.col("context_id").alias("on_path"), F.when(F.col("parent_id").isNull(), 0).otherwise(F.col("upto") - F.col("n_descendants")).alias("step")))
    order = state.select("context_id", F.explode("piece").alias("on_path")).join(step, "on_path").groupBy("context_id").agg(F.sum("step").alias("pre_order"))
    none = lambda kind: F.lit(None).cast(kind)
    paths = tree.join(state, "context_id").join(below, "context_id").join(order, "context_id").select("context_id", "parent_id", F.col("component_id").alias("root_id"), F.col("depth").cast("int").alias("depth"), F.col("piece").alias("path"), "n_descendants", "pre_order", (F.col("pre_order") + F.col("n_descendants")).alias("last_order"), none("string").alias("cycle_id"), F.lit(False).alias("back_edge"))
    rest = nodes.where(~F.col("in_tree")).select("context_id", "parent_id", none("string").alias("root_id"), none("int").alias("depth"), none("array<string>").alias("path"), none("bigint").alias("n_descendants"), none("bigint").alias("pre_order"), none("bigint").alias("last_order"), F.col("component_id").alias("cycle_id"), (F.col("on_cycle") & (F.col("parent_id") == F.col("component_id"))).alias("back_edge"))
    return paths.unionByName(rest)


def descendants(tree: DataFrame) -> DataFrame:
    """``context_id, descendant_id, distance``: one row per context and context below it (as many rows as the paths are long)."""
    up = tree.where(F.col("path").isNotNull()).select(F.col("context_id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "context_id"))
    return up.where(F.col("at") < F.col("depth")).select("context_id", "descendant_id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def cycles(contexts: DataFrame, max_component: int = 1_000_000) -> DataFrame:
    """``context_id, cycle_id`` of the contexts without a root. Components with a root have no cycle and are not walked, so no path is built."""
    nodes = written(components(last_parents(contexts)).where(~F.col("in_tree")))
    large = checkpointed(nodes.groupBy("component_id").count().where(F.col("count") > max_component).select("component_id"))
    walked = cycle_members(_walked(nodes.join(large, "component_id", "left_anti")))
    return walked.unionByName(nodes.join(large, "component_id", "left_semi").select("context_id", F.col("component_id").alias("cycle_id")))


def cycle_members(tree: DataFrame) -> DataFrame:
    """``context_id, cycle_id`` of the contexts without a root."""
    return tree.where(F.col("cycle_id").isNotNull()).select("context_id", "cycle_id")
