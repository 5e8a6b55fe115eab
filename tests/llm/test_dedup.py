import hashlib
import itertools

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import components, exact_dedup, similar, simhash
from lodestone.llm.common import fresh_key

SCHEMA = "doc_id long, text string, keep_id string, _k long, _row string"
ROWS = [
    (1, "same text", "x", 1, "a"), (5, "same text", None, None, None), (3, "same text", "y", 2, "b"), (3, "same text", "y", 2, "b"),
    (7, None, None, None, None), (8, "", None, None, None), (None, "same text", None, None, None), (9, "alone", None, None, None),
    (10, "same texu", None, None, None), (11, "x " * 200_000, None, None, None), (12, "x " * 200_000, None, None, None), (None, "null id alone", None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_against_brute_force(docs):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()), key=repr)
    once = {(i, t or "") for i, t, *_ in ROWS}
    expected = []
    for i, t in once:
        group = [j for j, u in once if u == t]
        keep = max((j for j in group if j is not None), default=None)
        expected.append((i, keep, len(group), i == keep, sha(t)))
    assert got == sorted(expected, key=repr)


def test_drop_exact_duplicates_keeps_columns_and_the_largest_id(docs):
    got = exact_dedup.drop_exact_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted([5, 8, 9, 10, 12, None], key=repr)


def test_drop_exact_duplicates_by_the_other_way(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", -1)
    assert sorted((r.doc_id for r in exact_dedup.drop_exact_duplicates(docs).collect()), key=repr) == sorted([5, 8, 9, 10, 12, None], key=repr)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0
    assert simhash.near_duplicate_components(empty).count() == 0
    assert similar.drop_near_duplicates(empty).count() == 0


def test_fresh_key_splits_from_grouping(spark):
    rows = spark.range(100).withColumn("g", F.col("id") % 3)
    groups = rows.groupBy("g").count().select(fresh_key(F.col("g")).alias("k"))
    plan = rows.withColumn("k", fresh_key(F.col("g"))).hint("merge").join(groups, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") == 2


def plain_fingerprint(text, words):
    tokens = [w for w in text.encode().lower().split() if w]
    if not tokens:
        return 0
    grams = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aB \t\x0b\x1cé x", max_size=60), st.integers(1, 5))
def test_fingerprints(text, words):
    assert simhash.fingerprint(text.encode(), words) == plain_fingerprint(text, words)


def test_xxhash_is_that_of_the_engine(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("the quick brown fox")).alias("h")).first()["h"]
    assert h & (1 << 64) - 1 == xxhash.xxh64(b"the quick brown fox", seed=42).intdigest()


def closure(values, budget):
    label = list(range(len(values)))
    for _ in values:
        for i, j in itertools.combinations(range(len(values)), 2):
            if (values[i] ^ values[j]).bit_count() <= budget:
                label[i] = label[j] = min(label[i], label[j])
    return label


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 2**64 - 1), st.lists(st.sets(st.integers(0, 63), max_size=7), min_size=1, max_size=40), st.integers(0, 5))
def test_trie_join_finds_all_links(base, flips, budget):
    values = sorted({base ^ sum(1 << b for b in f) for f in flips})
    root = simhash.trie_components(np.array(values, np.uint64), np.array([0]), np.array([len(values)]), budget)
    assert root.tolist() == closure(values, budget)


@pytest.mark.parametrize("distinct", [10, 10**6, 10**9, 10**12])
def test_blocks_cover_every_pair(distinct):
    masks = simhash.block_scheme(distinct, 4)
    rng = np.random.default_rng(0)
    for _ in range(300):
        diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(diff & m == 0 for m in masks)


@pytest.mark.parametrize("bucket_rows", [2, 2000])
def test_components_against_brute_force_with_split_buckets(spark, bucket_rows):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    values = sorted({b ^ sum(1 << int(k) for k in rng.choice(64, int(n), replace=False)) for b in base for n in rng.integers(0, 6, 30)})
    reps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)], "fp long, rep long")
    links = simhash.fingerprint_links(reps, 4, bucket_rows)
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert [got.get(i, i) for i in range(len(values))] == closure(values, 4)
    assert links.count() < 20 * len(values)


def test_near_duplicates_with_nulls_ties_and_empties(spark):
    long_text = " ".join(f"word{i}" for i in range(3000))
    rows = [(1, long_text), (2, long_text + " tail"), (3, "other words entirely here now"), (4, None), (5, " \n "), (None, long_text), (6, "one"), (6, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("fp", F.lit(1))
    got = sorted(((r.doc_id, r.component_id, r.fingerprint) for r in simhash.near_duplicate_components(docs).collect()), key=repr)
    byid = {g[0]: g[1] for g in got}
    assert len(got) == len(rows)
    assert byid == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, None: 1, 6: 6}
    assert {g[2] for g in got if g[0] in (4, 5)} == {"0" * 16}
    kept = similar.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6]


def test_no_text_is_lost_with_a_repeated_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (5, a), (5, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[0]) for r in similar.drop_near_duplicates(docs).collect()) == [(1, "a"), (5, "b")]


@settings(deadline=None, max_examples=5)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_connected_components(spark, pairs):
    label = {i: i for p in pairs for i in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert {n: c for n, c in label.items() if n != c} == {n: c for n, c in got.items() if n != c}


def test_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in components.connected_components(edges).collect()} == {0}
