import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import splitting as S


def longest(text: str) -> int:
    most = run = 0
    for c in text:
        if c in S.WHITE:
            run = 0
        else:
            run += 1
            most = max(most, run)
            if c in S.MARKS:
                run = 0
    return most


def texts() -> list[str]:
    rng = random.Random(4)
    words = ["alpha", "βήτα", "🙂🙂", "。", "x" * 37, "长文本没有空格；", "　", "\n\n", "y" * 130]
    return ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(20, 900))) for _ in range(30)] + ["z" * 1000, "z" * 120 + " " + "z" * 120, "a。" * 400]


def test_ranges_stitch_like_the_whole(spark):
    cap, over = 40, 10
    rows = [(str(i), t) for i, t in enumerate(texts())] + [("short", "ok"), ("null", None), (None, "q" * 999), ("empty", "")]
    df = spark.createDataFrame(rows, "event_id string, content string")
    split = S.split_ranges(df, cap, over, range_runes=330).cache()
    whole = {i: t.strip(S.WHITE) for i, t in rows if i and t and len(t.strip(S.WHITE)) > cap * 3}
    kinds = {r["id"]: r["cut_kind"] for r in S.cut_kinds(split, cap).collect()}
    assert kinds == {i: "forced" if -(-longest(t) // 3) > cap else "natural" for i, t in whole.items()}
    got: dict[str, list] = {}
    for r in S.pieces(split).orderBy("id", "piece_no").collect():
        got.setdefault(r["id"], []).append(r)
    assert got.keys() == whole.keys()
    for i, own in got.items():
        t = whole[i]
        assert [r["piece_no"] for r in own] == list(range(len(own)))
        assert own[0]["start_rune"] == 0 and own[-1]["end_rune"] == len(t) and own[-1]["cut"] == "end"
        for r in own:
            assert r["text"] == t[r["start_rune"] : r["end_rune"]] and 0 < r["tokens"] <= cap or not r["text"].strip(S.WHITE)
        for a, b in zip(own, own[1:]):
            between = t[a["end_rune"] : b["start_rune"]]
            assert not between.strip(S.WHITE)
            assert a["end_rune"] < b["end_rune"]
            if a["cut"] == "natural":
                e = a["end_rune"]
                assert t[e - 1] in S.WHITE + S.MARKS or t[e] in S.WHITE
        if kinds[i] == "natural":
            assert all(r["cut"] != "forced" for r in own)


def test_overlap_is_at_least_as_given_in_plain_text():
    text = " ".join(["word"] * 2000)
    kind = S.kinds(text)
    out = S.cut(kind, 0, len(text), "end", 300, 60)
    for (_, e, _), (s, _, _) in zip(out, out[1:]):
        assert 60 <= e - s <= 66


def test_bad_limits(spark):
    with pytest.raises(ValueError):
        S.split_ranges(spark.createDataFrame([], "event_id string, content string"), 10, 6)


def test_no_rows_and_extra_columns(spark):
    df = spark.createDataFrame([], "event_id string, content string, id string, text string, n int, size int")
    assert S.pieces(S.split_ranges(df, 40, 10)).count() == 0
    df = spark.createDataFrame([("a", "b " * 200, "q", "t", 1, 2)] * 2, df.schema)
    assert S.cut_kinds(S.split_ranges(df, 40, 10), 40).collect()[0]["cut_kind"] == "natural"
    assert np.array_equal(S.kinds("a 。"), [0, 1, 2])


def test_a_giant_text_is_spread_over_tasks(spark):
    """A text of many ranges is worked on by several tasks, and its pieces cover it."""
    text = "".join(f"word{i % 977} " for i in range(300_000))
    df = spark.createDataFrame([("a", text)], "event_id string, content string")
    split = S.split_ranges(df, 768, 96)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small, it would be merged into one task
    try:
        own = split.withColumn("task", F.spark_partition_id()).select("range_no", "task").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(own) > 10 and len({r["task"] for r in own}) > 1
    got = S.pieces(split).orderBy("piece_no").collect()
    trimmed = text.strip()
    assert got[0]["start_rune"] == 0 and got[-1]["end_rune"] == len(trimmed)
    assert all(b["start_rune"] <= a["end_rune"] and trimmed[b["start_rune"] : b["end_rune"]] == b["text"] and len(b["text"]) <= 2304 for a, b in zip(got, got[1:]))


def test_kinds_come_from_pieces_and_from_stretches(spark):
    """Each alone tells the kinds of all texts, also where the pieces carry no texts."""
    cap, rows = 40, [(str(i), t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "event_id string, content string")
    split = S.split_ranges(df, cap, 10, range_runes=330, with_texts=False).cache()
    whole = {i: t.strip(S.WHITE) for i, t in rows if len(t.strip(S.WHITE)) > cap * 3}
    want = {i: "forced" if -(-longest(t) // 3) > cap else "natural" for i, t in whole.items()}
    assert set(want.values()) == {"forced", "natural"}
    assert split.where("exists(pieces, p -> p.text is not null)").count() == 0 and split.where("size(pieces) > 1").count() > 10
    pieces_only = split.withColumns({c: F.lit(0).cast("bigint") for c in ("head", "inner", "tail")}).withColumn("whole", F.lit(False))
    stretches_only = split.withColumn("pieces", F.transform("pieces", lambda p: p.withField("cut", F.lit("natural"))))
    for given in (split, pieces_only, stretches_only):
        assert {r["id"]: r["cut_kind"] for r in S.cut_kinds(given, cap).collect()} == want


def test_a_piece_is_forced_only_in_a_long_stretch():
    """Of many small texts, cut whole: a forced piece if and only if a stretch is over the capacity."""
    rng = random.Random(11)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "a", "a", "b" * rng.randrange(1, 14), " ", "。", "  \n"]) for _ in range(rng.randrange(4, 40))).strip(S.WHITE)
        capacity = rng.randrange(5, 13)
        out = S.cut(S.kinds(text), 0, len(text), "end", capacity, rng.randrange(0, (capacity - 1) // 2 + 1)) if len(text) > capacity else []
        assert not out or any(c == "forced" for _, _, c in out) == (longest(text) > capacity), text
