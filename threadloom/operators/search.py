"""Evidence search: postings, statistics, channels, fusion, graph ranking and selection.

A batch of queries is answered at once: what belongs to a query is keyed by ``query_id``. Texts are tokenized in one
pass per question; only what matches a query's terms is carried on. Query terms are few and come from the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.text import sentences, tokens
from threadloom.operators.lineage import checkpointed


def bm25(documents: DataFrame, terms: list[str], k: int = 50, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``doc_id, score``: the k best documents. One pass counts documents, lengths and the terms' document frequencies, another scores; nothing is shuffled but the counts and the best rows."""
    sized = documents.where("text is not null").select("doc_id", tokens(F.col("text")).alias("t"))
    stats = sized.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"), *(F.count_if(F.array_contains("t", term)).alias(f"df{i}") for i, term in enumerate(terms)))
    rows = sized.select("doc_id", F.size("t").alias("dl"), F.filter("t", lambda x: x.isin(*terms)).alias("t")).where(F.size("t") > 0).crossJoin(F.broadcast(stats))  # one row

    def part(i: int, term: str) -> Column:
        tf, df = F.size(F.filter("t", lambda x: x == term)), F.col(f"df{i}")
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - df + 0.5) / (df + 0.5)))
        return F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)

    score = sum((part(i, term) for i, term in enumerate(terms)), F.lit(0.0))
    return rows.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``term, key, tf, dl``: the inverted index; counts are combined before the shuffle."""
    sized = texts.where(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("t"))
    return sized.select(key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def document_frequencies(index: DataFrame, key: str, most: Column | None = None) -> DataFrame:
    """``term, df`` of the index, up to ``most`` where given."""
    df = index.groupBy("term").agg(F.countDistinct(key).alias("df"))
    return df if most is None else df.where(F.col("df") <= most)


def scored(index: DataFrame, queries: DataFrame, lengths: DataFrame, key: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id, key, score`` by BM25 for a batch of queries (``query_id, term``) over an index; ``lengths`` (``key, dl``) has all documents."""
    hits = index.join(queries.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    weight = df.crossJoin(F.broadcast(stats)).select("term", "avgdl", F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))  # one row of statistics
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.join(weight, "term").join(queries, "term").groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"))


def term_weights(index: DataFrame, queries: DataFrame, contexts: DataFrame, key: str, most: int = 8) -> DataFrame:
    """``query_id, term, weight``: the ``most`` rarest terms of each query by contexts: ln((C + 1) / (f + 1)) + 1; terms that no document has are left out.

    ``contexts`` (``key, context_id``) names the context of each document; one without a context is its own.
    """
    own = contexts.select(key, F.coalesce(F.nullif(F.col("context_id"), F.lit("")), F.col(key)).alias("c"))
    total = own.agg(F.countDistinct("c").alias("total"))
    hits = index.join(queries.select("term").distinct(), "term", "left_semi").join(own, key)
    f = hits.groupBy("term").agg(F.countDistinct("c").alias("f")).crossJoin(F.broadcast(total))  # one row
    w = queries.join(f, "term").select("query_id", "term", F.round(F.log((F.col("total") + 1) / (F.col("f") + 1)) + 1, 6).alias("weight"))
    return ranked(w, "query_id", most, F.desc("weight"), F.col("term"))


def coverage(rows: DataFrame, weights: DataFrame, key: str, text: str) -> DataFrame:
    """``query_id, key, coverage``: the weight of a query's terms that a text has, over that of all its terms; texts without any are left out."""
    per = rows.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    total = weights.groupBy("query_id").agg(F.sum("weight").alias("total"))
    return per.join(weights, "term").groupBy("query_id", key).agg(F.sum("weight").alias("w")).join(total, "query_id").select("query_id", key, F.round(F.col("w") / F.col("total"), 6).alias("coverage"))


def spans(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, span_no, span``: the sentences of each text."""
    return rows.where(F.col(text).isNotNull()).select(key, F.posexplode(sentences(F.col(text))).alias("span_no", "span"))


def best_spans(rows: DataFrame, weights: DataFrame, key: str, text: str) -> DataFrame:
    """``query_id, key, span_no, coverage``: of each text the sentence that covers most of a query, of equal ones the first."""
    own = spans(rows, key, text).withColumn("_id", F.struct(key, "span_no"))
    best = coverage(own, weights, "_id", "span").groupBy("query_id", F.col(f"_id.{key}").alias(key)).agg(F.max(F.struct("coverage", (-F.col("_id.span_no")).alias("n"))).alias("b"))
    return best.select("query_id", key, (-F.col("b.n")).alias("span_no"), "b.coverage")


def sparse(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, weight``: counts of the tokens over the length of their vector."""
    index = postings(rows, key, text)
    norm = index.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return index.join(norm, key).select(key, "term", (F.col("tf") / F.col("norm")).alias("weight"))


def sparse_scores(vectors: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """``query_id, key, score``: dot products of sparse vectors with those of the queries (``query_id, term, q``)."""
    return vectors.join(queries, "term").groupBy("query_id", key).agg(F.round(F.sum(F.col("weight") * F.col("q")), 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; -1 where one is empty, zero or of another length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) <= 0) | (F.size(a) != F.size(b)) | (n == 0), -1.0).otherwise(F.coalesce(dot(a, b) / F.nullif(n, F.lit(0.0)), F.lit(-1.0)))


def l2_normalized(a: Column) -> Column:
    """The vector over its length; a zero vector as it is."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def maxsim(query: DataFrame, documents: DataFrame) -> DataFrame:
    """``query_id, doc_id, score``: the mean over a query's token vectors (``query_id, q_no, q``) of the best dot product with a document's (``doc_id, v``). A query's tokens are few."""
    pairs = documents.crossJoin(F.broadcast(query)).select("query_id", "q_no", "doc_id", dot(F.col("q"), F.col("v")).alias("s"))
    best = pairs.groupBy("query_id", "q_no", "doc_id").agg(F.max("s").alias("s"))
    return best.groupBy("query_id", "doc_id").agg(F.round(F.avg("s"), 6).alias("score"))


def rrf(channels: DataFrame, k: int = 60) -> DataFrame:
    """``id, score`` from ``channel, id, rank``: the sum of 1 / (k + best rank) over the channels."""
    best = channels.groupBy("channel", "id").agg(F.min("rank").alias("rank"))
    return best.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))


def blended(channels: DataFrame, coverage: DataFrame, k: int = 60) -> DataFrame:
    """``query_id, id, score``: fusion by families (keys, full text and overlay are one), 0.7 of it over the best plus 0.3 of the coverage."""
    family = F.when(F.col("channel").isin("keys", "fts", "overlay"), "lexical").otherwise(F.col("channel"))
    best = channels.groupBy("query_id", family.alias("family"), "id").agg(F.min("rank").alias("rank")).groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("s"))
    most = best.groupBy("query_id").agg(F.max("s").alias("most"))
    return best.join(most, "query_id").join(coverage, ["query_id", "id"], "left").select("query_id", "id", F.round(0.7 * F.col("s") / F.col("most") + 0.3 * F.coalesce("coverage", F.lit(0.0)), 6).alias("score"))


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def ranked(rows: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each key (a group limit before the shuffle keeps k rows of a key a task)."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def graph(events: DataFrame, sources: DataFrame, index: DataFrame, total: int) -> DataFrame:
    """``source, target, weight``, both ways: event and context 1.0, event and claim 0.8, event and rare term ln(1 + N / df) with df up to the greater of 2 and N / 20."""
    a = events.where("context_id <> ''").select(F.concat(F.lit("event:"), "event_id").alias("source"), F.concat(F.lit("context:"), "context_id").alias("target"), F.lit(1.0).alias("weight"))
    b = sources.select(F.concat(F.lit("event:"), "event_id").alias("source"), F.concat(F.lit("semantic:"), "node_id").alias("target"), F.lit(0.8).alias("weight"))
    rare = document_frequencies(index, "event_id", F.lit(max(2, total // 20)))
    c = index.select("term", "event_id").join(rare, "term").select(F.concat(F.lit("event:"), "event_id").alias("source"), F.concat(F.lit("concept:"), "term").alias("target"), F.log(1 + F.lit(float(max(1, total))) / F.col("df")).alias("weight"))
    one = a.unionByName(b).unionByName(c)
    both = one.unionByName(one.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    return both.groupBy("source", "target").agg(F.round(F.max("weight"), 6).alias("weight"))


def connected(edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id of each node's component, by alternating large and small stars.

    Each round is two aggregates and joins on node ids; stars halve distances, so rounds grow with the logarithm of the nodes, and a hub's
    neighbours are never gathered in one task.
    """
    pairs = checkpointed(edges.select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).where("u <> v").distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = checkpointed(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        moved = new.join(pairs, ["u", "v"], "left_anti").limit(1).count() + pairs.join(new, ["u", "v"], "left_anti").limit(1).count()
        pairs = new
        if not moved:
            break
    nodes = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    return nodes.join(pairs.groupBy("u").agg(F.min("v").alias("m")), F.col("id") == F.col("u"), "left").select("id", F.coalesce("m", "id").alias("component"))


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = 30, damping: float = 0.85, every: int = 5) -> DataFrame:
    """``id, rank`` of a personalized walk from the seeds (``id, weight``); what reaches nodes without edges returns to the seeds.

    Edges are partitioned by their source once. Mass on nodes that are not reached stays zero and is not carried.
    """
    out = edges.groupBy("source").agg(F.sum("weight").alias("out"))
    step = checkpointed(edges.join(out, "source").select(F.col("source").alias("id"), "target", (F.col("weight") / F.col("out")).alias("p")).repartition("id"))
    total = seeds.agg(F.sum("weight").alias("s")).first()["s"] or 1.0  # one number
    start = checkpointed(seeds.groupBy("id").agg((F.sum("weight") / total).alias("p0")))
    rank = start.select("id", F.col("p0").alias("rank"))
    for i in range(rounds):
        flow = rank.join(step, "id").select(F.col("target").alias("id"), (F.col("rank") * F.col("p")).alias("r")).groupBy("id").agg((damping * F.sum("r")).alias("r"))
        if (i + 1) % every == 0:
            flow = checkpointed(flow)
        kept = flow.agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("kept"))  # one row: the rest comes back to the seeds
        back = start.crossJoin(F.broadcast(kept)).select("id", (F.col("p0") * (1 - F.col("kept"))).alias("r"))
        rank = flow.select("id", "r").unionByName(back).groupBy("id").agg(F.sum("r").alias("rank"))
    return rank.select("id", F.round("rank", 6).alias("rank"))
