import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadloom.operators import search as S
from threadloom.operators.lineage import shared_dir
from threadloom.operators.walk import event_walk
from threadloom.plans.search_queries import graph_pagerank


@pytest.mark.parametrize("rounds", [1, 2, 5, 10])
def test_blocks_walk_like_the_edges(spark, rounds):
    """Several blocks, shared and lone nodes, terms that are too frequent, a claim of an unknown event, seeds without edges and without weight."""
    rng = random.Random(7)
    rows = [(f"e{i}", rng.choice([None, "", "c1", "c2", f"x{i}"]), " ".join(["all"] + [f"w{rng.randrange(40)}" for _ in range(rng.randrange(9))] + [f"own{i}"] * (i % 3))) for i in range(90)] + [("bare", "", None), ("lone", None, "all")]
    live = spark.createDataFrame(rows, "event_id string, context_id string, content string")
    sources = spark.createDataFrame([(f"n{rng.randrange(12)}", f"e{rng.randrange(95)}") for _ in range(40)], "node_id string, event_id string")
    seeds = spark.createDataFrame([("e1", 2.0), ("e2", 0.5), ("bare", 1.0), ("lone", 0.25), ("e3", 0.0)], "event_id string, weight double")
    edges = S.graph(live, sources, S.postings(live, "event_id", "content"), len(rows))
    want = {r["id"]: r["rank"] for r in S.pagerank(edges, seeds.withColumn("id", F.concat(F.lit("event:"), "event_id")), rounds=rounds).collect()}
    docs = live.withColumn("terms", S.tokens(F.col("content"))).join(sources.groupBy("event_id").agg(F.collect_list("node_id").alias("claims")), "event_id", "full").repartition(5, "event_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = event_walk(docs, len(rows), seeds, rounds).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len({r["id"] for r in got}) and {r["id"] for r in got} == want.keys()
    assert all(abs(r["rank"] - want[r["id"]]) <= 2e-6 for r in got)


def test_no_events_and_no_rounds(spark):
    docs = spark.createDataFrame([], "event_id string, context_id string, terms array<string>, claims array<string>")
    seeds = spark.createDataFrame([], "event_id string, weight double")
    assert event_walk(docs, 0, seeds, 10).count() == 0
    with pytest.raises(ValueError):
        event_walk(docs, 0, seeds, 0)


def test_graph_pagerank_leaves_little_on_disk(spark):
    """What the query writes besides its result is under four times its input."""
    size = lambda at: sum(p.stat().st_size for p in at.rglob("*") if p.is_file())
    data, folder = "/root/testdata/sf0.01", Path(shared_dir(spark).removeprefix("file://"))
    before = size(folder)
    assert graph_pagerank(spark, data).count() > 10_000
    assert size(folder) - before < 4 * sum(Path(data, f"{t}.parquet").stat().st_size for t in ("ledger_events", "node_sources"))
