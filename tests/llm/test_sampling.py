import collections

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import hnsw, labelled


def test_rare_labels_are_sampled(spark):
    rows = [(i, f"text {i}", "common") for i in range(3000)] + [(5000 + i, f"rare {i}", "rare") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    take = lambda df: labelled.bounded_sample(df, df, F.col("lang"), F.lit(True), 50, 100, per_label=True)
    got = take(docs)
    assert collections.Counter(y for _, y in got) == {"common": 47, "rare": 3}
    assert take(docs.repartition(3)) == got


def test_repeated_ids_give_the_same_sample(spark):
    rows = [(i % 7, f"text {i % 3} {i}", i % 2) for i in range(60)] + [(None, "x", 1), (8, None, 1), (9, "no label", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    one = labelled.bounded_sample(docs, docs, F.col("quality"), F.lit(True), 100, 100)
    assert len(one) == 7 and all(y == 0 for _, y in one)
    assert labelled.bounded_sample(docs.orderBy(F.col("text").desc()), docs.repartition(5), F.col("quality"), F.lit(True), 100, 100) == one
    assert labelled.bounded_sample(docs.limit(0), docs.limit(0), F.col("quality"), F.lit(True), 100, 100) == []


def test_long_texts_are_seen_over_their_whole_length(spark):
    text = "".join(chr(97 + i // 1000) for i in range(20_000))
    docs = spark.createDataFrame([(1, text, 1)], "doc_id long, text string, quality int")
    ((got, _),) = labelled.bounded_sample(docs, docs, F.col("quality"), F.lit(True), 10, 400, pieces=4)
    assert [p[0] for p in got.split("\n")] == ["a", "g", "n", "t"] and got.endswith(text[-100:])


def recall(x, found, k):
    hit = 0
    for q, own in found.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:k].tolist()) & set(own))
    return hit / (k * len(found))


def test_recall_on_the_embeddings_over_many_cells(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    x = np.zeros((table.count(), 64))
    for r in table.collect():
        x[r.vec_id] = r.embedding
    found = collections.defaultdict(list)
    for r in hnsw.nearest(table, 20, 20, shard_rows=64).collect():
        found[r.query_id].append(r.vec_id)
    assert len(found) == len(x) // 20 and all(len(v) == 20 for v in found.values())
    assert recall(x, found, 20) > 0.9


def test_vectors_meet_their_own_length(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(4 if i % 3 else 6).tolist()) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = collections.defaultdict(list)
    for r in hnsw.nearest(table, 20, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in range(0, 120, 20):
        own = [(i, v) for i, v in rows if len(v) == len(rows[q][1]) and i != q]
        best = sorted(own, key=lambda r: -np.dot(r[1], rows[q][1]))[:5]
        assert got[q] == [i for i, _ in best]


def test_few_cells_are_visited_where_vectors_are_clustered():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16)) * 5
    x = centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16)) * 0.3
    longest = float((x * x).sum(1).max())
    assert hnsw.Router(x[:2000], longest, 40, []).probes <= 8
    even = rng.standard_normal((4000, 64))
    assert hnsw.Router(even[:2000], float((even * even).sum(1).max()), 40, []).probes > 20
