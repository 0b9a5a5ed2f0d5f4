import numpy as np

from threadloom.llm import neighbours


def test_recall_holds_as_the_leaves_grow():
    """With a fixed number of probes the share of a true pair's common leaves falls as the rows grow; here 30 times more rows, sampled alike."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3000, 32))
    x = neighbours.unit((np.repeat(centres, 10, 0) + 0.35 * rng.normal(size=(30_000, 32))).astype(np.float32))
    q = rng.choice(len(x), 300, replace=False)
    cos = x[q] @ x.T
    cos[np.arange(300), q] = -2
    near = np.argpartition(cos, len(x) - 5, 1)[:, -5:]
    few, many = neighbours.fit(x[::30], 1000), neighbours.fit(x, 1_000_000)
    assert neighbours.probes_of(many) > neighbours.probes_of(few)
    leaves = many.probe(x, neighbours.probes_of(many))
    shared = (leaves[q][:, None, :, None] == leaves[near][:, :, None, :]).any((2, 3))
    assert shared.mean() > 0.97
    assert (many.probe(x, 3)[q][:, None, :, None] == many.probe(x, 3)[near][:, :, None, :]).any((2, 3)).mean() < 0.97


def test_lists_of_many_boughs(spark, monkeypatch):
    """Vectors of several leaves and boughs get the exact lists, each neighbour once."""
    monkeypatch.setattr(neighbours, "BOUGH", 2)
    rng = np.random.default_rng(6)
    x = (np.repeat(rng.normal(size=(60, 16)), 10, 0) + 0.2 * rng.normal(size=(600, 16))).astype(np.float16).astype(float)
    df = spark.createDataFrame([(f"e{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)], "event_id string, dense_fp16 array<float>")
    got = {r["id"]: [n["id"] for n in r["near"]] for r in neighbours.nearest(df, 600, dim=16, leaf=60).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 6)
    for i in range(600):
        others = sorted((j for j in range(600) if j != i), key=lambda j: (-cos[i, j], j))[:5]
        assert got[f"e{i:03d}"] == [f"e{j:03d}" for j in others]


def test_copies_of_a_direction_and_dirty_rows(spark):
    """Copies, also scaled ones, are one vector to the search; each has the smallest ids of the others. Rows that are no vectors have no neighbours."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 8)).astype(np.float16).astype(float)
    x[10:30] = x[10] * np.tile([1.0, 2.0, 0.5, 4.0], 5)[:, None]
    rows = [(f"e{i:02d}", [float(v) for v in r]) for i, r in enumerate(x)] + [("e00", [float(v) for v in x[0]]), ("zero", [0.0] * 8), ("nan", [float("nan")] + [1.0] * 7), ("none", None), (None, [1.0] * 8)]
    got = {r["id"]: [n["id"] for n in r["near"]] for r in neighbours.nearest(spark.createDataFrame(rows, "event_id string, dense_fp16 array<float>"), len(rows), dim=8, leaf=1000).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 6)
    assert got == {f"e{i:02d}": [f"e{j:02d}" for j in sorted((j for j in range(40) if j != i), key=lambda j: (-cos[i, j], j))[:5]] for i in range(40)}


def test_a_large_leaf_is_compared_by_its_own_forest(monkeypatch):
    """A leaf beyond BLOCK loses few pairs, and equal vectors are never cut apart."""
    monkeypatch.setattr(neighbours, "BLOCK", 400)
    rng = np.random.default_rng(9)
    x = neighbours.unit((np.repeat(rng.normal(size=(200, 16)), 10, 0) + 0.1 * rng.normal(size=(2000, 16))).astype(np.float32))
    parts = list(neighbours._blocks(np.arange(2000), x))
    cos = x @ x.T - 3 * np.eye(2000, dtype=np.float32)
    near = np.argpartition(cos, 1995, 1)[:, -5:]
    together = np.zeros((2000, 2000), bool)
    for p in parts:
        together[np.ix_(p, p)] = True
    assert together[np.arange(2000)[:, None], near].mean() > 0.97
    same = list(neighbours._blocks(np.arange(1000), np.repeat(x[:1], 1000, 0)))
    assert max(len(p) for p in same) == 1000
