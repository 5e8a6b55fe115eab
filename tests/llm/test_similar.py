import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import similar


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    links = [(i, j) for i, j in itertools.combinations(texts, 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in range(len(links)):
        old = dict(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if label == old:
            break
    return label


@pytest.mark.parametrize(("hub_rows", "seed"), [(1000, 3), (2, 4)])
def test_near_stage_against_brute_force(spark, monkeypatch, hub_rows, seed):
    monkeypatch.setattr(similar, "HUB_ROWS", hub_rows)
    monkeypatch.setattr(similar, "GROUP_ROWS", 5 * hub_rows)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    line = rng.choices(vocabulary, k=30)
    rows = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(3, 200)) + line
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sid", F.lit("clash"))
    got = corpus_pipeline.near_once(spark, docs, "")
    assert got.columns == docs.columns
    label = groups(dict(rows))
    assert len(set(label.values())) not in (12, len(rows))
    assert {r.doc_id for r in got.collect()} == {i for i, c in label.items() if i == c}


def test_near_stage_keeps_one_of_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text), (1, text), (1, text + " tail"), (None, text), (None, "alone"), (None, "alone"), (None, None), (4, " "), (5, "other")]
    got = corpus_pipeline.near_once(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted([1, None, 4, 5], key=repr)
    assert corpus_pipeline.near_once(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0
