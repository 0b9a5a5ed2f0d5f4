import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import abuse, conversations, mixing, neighbours, packing, personal

LEDGER = "event_id string, session_id string, actor string, content string, occurred_at timestamp, created_at timestamp, tombstoned boolean, part int, place int, root_event_id string"


def ledger(spark, rows):
    t = datetime(2022, 1, 1)
    return spark.createDataFrame([(e, s, a, c, t + timedelta(seconds=o) if o is not None else None, t, d, 1, 2, "x") for e, s, a, c, o, d in rows], LEDGER)


def test_conversations(spark):
    rows = []
    for i, (case, turns) in enumerate(SESSIONS.items()):
        rows += [(f"{case}{k:02d}", case, a, c, k, False) for k, (a, c) in enumerate(turns)]
    rows += [("n1", None, "user", "hi", 0, False), (None, "q", "user", "hi", 0, False), ("n2", "", "user", "hi", 0, None), ("t1", "gone", "user", "hi", 0, True), ("time0", "time", "user", "hi", None, False), ("time1", "time", "bot", "ho", 1, False)]
    _, got = conversations.rebuild(ledger(spark, rows + rows[:3]))
    assert {r["session_id"]: r["dropped"] for r in got.collect()} == {k: not k.startswith("ok") for k in SESSIONS} | {"gone": True, "time": True}
    out = conversations.conversations(ledger(spark, rows)).where("session_id = 'ok1'").orderBy("position").collect()
    assert [r["role"] for r in out] == ["system", "user", "user", "tool", "assistant"] and [r["position"] for r in out] == list(range(5))
    assert out[4]["parent_event_id"] in {"ok101", "ok102", "ok103"}


SESSIONS = {
    "ok1": [("Developer", "be good"), (" USER ", "a"), ("human", "b"), ("tool:grep", "x"), ("ai", "c")],
    "ok2": [("user", "a"), ("assistant", "(no reply: rate limit)"), ("assistant", "b")],
    "notice": [("user", "a"), ("assistant", "[generation aborted after 0 tokens, request 1f]")],
    "gap": [("user", "a"), ("tool", "x"), ("user", "b"), ("bot", "c")],
    "blank": [("user", "​ "), ("bot", "c")],
    "actor": [("user", "a"), ("?", "b"), ("bot", "c")],
    "first": [("bot", "a"), ("user", "b"), ("bot", "c")],
    "system": [("system", "a")],
}


def test_empty_ledger(spark):
    assert conversations.rebuild(ledger(spark, []))[1].count() == 0
    assert personal.spans(ledger(spark, [])).count() == 0


def test_personal(spark):
    text = "My name is Maren Tolliver and my number is 520-555-0125.\nepoch 1720442759"
    df = ledger(spark, [("a", "s", "user", text, 0, True), ("b", "s", "user", None, 0, False), ("c", "s", "user", "", 0, False), (None, "s", "user", text, 0, False)])
    assert {(r[0], r[1], text[r[2] : r[3]]) for r in personal.spans(df).collect()} == {("a", "person", "Maren Tolliver"), ("a", "phone", "520-555-0125")}
    assert "[PERSON]" in personal.redacted(df).where("event_id = 'a'").first()["content"]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)).astype(np.float16).astype(float)
    x[20:32] = x[20]
    rows = [(f"e{i:03d}", [float(v) for v in r], 1) for i, r in enumerate(x)] + [("e000", [float(v) for v in x[0]], 2), ("bad", [0.0] * 8, 1), ("short", [1.0], 1), ("none", None, 1), ("nan", [float("nan")] * 8, 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "event_id string, dense_fp16 array<float>, near int")
    got = {r["id"]: [n["id"] for n in r["near"]] for r in neighbours.nearest(df, len(rows), dim=8, leaf=100).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 6)
    for i in range(60):
        others = sorted((j for j in range(60) if j != i), key=lambda j: (-cos[i, j], j))[:5]
        assert got[f"e{i:03d}"] == [f"e{j:03d}" for j in others]
    assert len(got) == 60


def test_packing():
    r = random.Random(2)
    for _ in range(20):
        sizes = [r.randint(1, 100) for _ in range(80)]
        bins = packing.pack(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(80)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= -(-sum(sizes) // 100) * 1.15 + 1


def test_mixing(spark):
    rows = [(i, s, 10 + i % 7) for s, n in (("a", 300), ("b", 40), ("c", 5)) for i in range(n)] + [(1, None, 5), (2, "a", 0)]
    mix = spark.createDataFrame([("A ", 0.5, 1), ("b", 0.4, 2), ("none", 0.1, None)], "source string, target_share double, max_repeats int")
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint").repartition(5), mixing.targets(mix))
    share = {r["source"]: r for r in mixing.report(got, mixing.targets(mix)).collect()}
    assert abs(share["a"]["actual_share"] - 5 / 9) < 0.02 and share["none"]["records"] == 0
    assert got.agg({"copies": "max"}).first()[0] <= 2


def test_abuse():
    weights, bias = abuse.train([("You are a horrible idiot. The build ran.", 1), ("The build ran. The lease expired.", 0)] * 3)
    bad, good, none = abuse.text_scores(["The lease expired. y0u a r e a horrible 1diot", "The lease expired.", None], weights, bias)
    assert bad > good and none == -np.inf


def test_large_items_close_their_bins_at_once(spark):
    """Items of over half the capacity fit no bin together: no group grows beyond a block."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("start_rune"), F.lit(1).cast("long").alias("end_rune"), (510 + F.col("id") % 390).alias("tokens"))
    got = packing.packed(df, 1000, block=2000)
    assert got.count() == 20_000 and got.select("bin_id").distinct().count() == 20_000
