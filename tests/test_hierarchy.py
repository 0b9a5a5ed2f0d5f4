import random

from threadloom.operators import hierarchy as H

COLUMNS = [x.split()[0] for x in H.OUT.split(", ")]


def rows_of(df):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in (r[c] for c in COLUMNS)) for r in df.collect())


def test_both_ways_agree_in_all_columns(spark):
    rng = random.Random(5)
    for n in (12, 60):
        rows = [(f"c{i:02d}", f"c{rng.randrange(n):02d}" if rng.random() < 0.85 else None, i) for i in range(n)] + [("x", "y", 1), ("y", "x", 2), ("w", "x", 3), ("s", "s", 4)]
        df = spark.createDataFrame(rows, "context_id string, parent_id string, ledger_seq long")
        walked = rows_of(H.hierarchy(df))
        assert walked == rows_of(H.hierarchy(df, max_component=1))
        cyclic = {(r[0], r[8]) for r in walked if r[8] is not None}
        assert {tuple(r) for r in H.cycles(df).collect()} == cyclic == {tuple(r) for r in H.cycles(df, max_component=1).collect()}
        assert {r[0] for r in walked if r[9]} >= {"y", "s"} and not {r[0] for r in walked if r[9]} & {"w", "x"}


def test_dirty_rows(spark):
    rows = [(" A ", None, 1), ("b", "a ", 2), ("b", "", 3), ("c", "nowhere", 4), (None, "a", 5), ("  ", "a", 6), ("b", "A", 7), ("b", "A", 7)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "context_id string, parent_id string, ledger_seq long, depth int")
    got = {r["context_id"]: (r["root_id"], r["depth"], r["n_descendants"]) for r in H.hierarchy(df).collect()}
    assert got == {"a": ("a", 0, 1), "b": ("a", 1, 0), "c": ("c", 0, 0)}
    assert H.hierarchy(df.where("false")).count() == 0 and H.cycles(df.where("false")).count() == 0
