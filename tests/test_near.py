import itertools
import math
import random
import time

import numpy as np
import pytest

from lodestone.operators import clustering, near
from lodestone.operators.components import components


def far(a, b):
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))


def groups(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(near, "LEAST_ROWS", 16)
    monkeypatch.setattr(near, "MOST_ROWS", 16)
    monkeypatch.setattr(near, "BLOCK", 64)


def test_thousands_of_even_vectors_are_compared_in_time(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(10_000, 64))
    x[3000:3600] = x[:600] + rng.normal(size=(600, 64)) * 0.05
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype("float32")
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<float>").repartition(4).cache()
    df.count()
    began = time.time()
    got = {r.id for r in clustering.orthogonal_members(df, "id", "v", 0.12).collect()}
    took = time.time() - began
    y = x.astype("float64")
    links = []
    for at in range(0, len(y), 500):
        i, j = np.nonzero(2 - 2 * y[at : at + 500] @ y.T < 0.96**2)
        links += [(u, v) for u, v in zip((i + at).tolist(), j.tolist()) if u < v]
    assert len(links) >= 600 and got == set(range(10_000)) - {u for u, c in groups(links).items() if u != c}
    assert took < 60


def test_forest_and_pairs_over_several_tiles(spark, small_tiles):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(5)]) for i in range(150)] + [(i, [3.0] * 5) for i in range(150, 190)]
    df = spark.createDataFrame(rows + rows[:30], "id long, v array<double>")
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if far(a, b) < 0.1 * 5**0.5}
    assert {(r.u, r.v) for r in clustering.close_vectors(df, "id", "v", 0.1).collect()} == want
    forest = near.close_forest(df, "id", "v", 0.1)
    assert {(r.u, r.v) for r in forest.collect()} <= want and forest.count() < len(want) / 2
    assert {r.node: r.component for r in components(forest).collect()} == groups(want)


def test_a_group_of_copies_gives_a_forest_not_its_pairs(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "id long, v array<double>")
    assert near.close_forest(df, "id", "v", 0.2).count() == 299
    assert [r.id for r in clustering.orthogonal_members(df, "id", "v").collect()] == [0]


def test_odd_vectors(spark, small_tiles):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [0.0, 0.0]), ("b", [0.1, 0.0]), ("c", [0.1]), ("d", [0.15]), ("e", None), ("f", []), ("g", [nan, 0.0]), ("h", [nan, 0.0]), ("i", [inf, 0.0]), ("j", [inf, 0.0]), ("k", [None, 0.0]), ("l", [None, 0.0]), (None, [0.0, 0.0]), ("m", [1e200, 0.0]), ("n", [1e200, 0.0]), ("o", [-1e300, 1.0]), ("ä", [0.1, 0.1]), ("a", [5.0, 5.0]), ("p", [5.0, 5.1])]
    df = spark.createDataFrame(rows * 9, "id string, v array<double>")
    assert {(r.u, r.v) for r in clustering.close_vectors(df, "id", "v", 0.1).collect()} == {("a", "b"), ("c", "d"), ("m", "n"), ("b", "ä"), ("a", "p")}
    kept = clustering.orthogonal_members(df, "id", "v", 0.1).collect()
    assert {r.id for r in kept} == {"a", "c", "e", "f", "g", "h", "i", "j", "k", "l", None, "m", "o"} and len(kept) == 9 * 14
    assert clustering.close_vectors(df.filter("false"), "id", "v", 0.1).count() == 0
    assert clustering.close_vectors(df.filter("id = 'g'"), "id", "v", 0.1).count() == 0
    assert clustering.close_vectors(df, "id", "v", 0.0).count() == 0


@pytest.mark.parametrize("shift", [0.0, 1e4, 1e9])
def test_distances_at_the_limit(spark, small_tiles, shift):
    """On a grid many distances equal the limit, which is not below it; far from the origin a product alone would lose them."""
    rows = [(12 * i + j, [shift + i * 0.25, shift + j * 0.25]) for i in range(12) for j in range(12)]
    for most in (0.25 / math.sqrt(2), math.nextafter(0.25 / math.sqrt(2), 1), 0.25):
        want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if far(a, b) < math.sqrt(2) * most}
        assert {(r.u, r.v) for r in clustering.close_vectors(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", most).collect()} == want


def test_similar_components_of_a_table_with_a_large_group(spark, tmp_path):
    from lodestone.plans import QUERIES

    rng = np.random.default_rng(7)
    x = rng.normal(size=(9000, 64))
    x[::6] = x[0] + rng.normal(size=(1500, 64)) * 0.1
    x[1:1500:6] = x[3001:4500:6] + rng.normal(size=(250, 64)) * 0.1
    x = x / np.linalg.norm(x, axis=1)[:, None]
    spark.createDataFrame([(i, r.tolist(), i % 10) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    began = time.time()
    got = {r.node: r.component for r in QUERIES["similar_components"].run(spark, str(tmp_path)).collect()}
    took = time.time() - began
    y = x.astype("float32").astype("float64")
    links = []
    for at in range(0, len(y), 500):
        i, j = np.nonzero(2 - 2 * y[at : at + 500] @ y.T < 0.96**2)
        links += [(u, v) for u, v in zip((i + at).tolist(), j.tolist()) if u < v]
    assert len(links) > 1_000_000 and got == groups(links) and list(got.values()).count(0) >= 1500
    assert took < 60
