import collections
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import hnsw, langid, lm, quality, toxicity

WORDS = "the of and to in a is that for it was on are as with his they be at one have this from".split()


def prose(rng, n=60):
    return " ".join(rng.choice(WORDS, n)) + "."


def odd_rows():
    return [(1, None), (2, ""), (3, "a b " * 60_000), (None, "no id"), (4, "same"), (4, "same"), (5, "12 !!")]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(400):
        good, bad = i % 5 != 0, i % 7 == 0
        text = prose(rng) if good else " ".join(w.upper() + "%%$" for w in rng.choice(WORDS, 40))
        if bad:
            text += " You worthless idiot, you moron. idiot"
        lang = "en" if i % 2 else "xx"
        rows.append((i, text if i % 2 else text.replace("t", "ž").replace("a", "ö").replace("T", "Ž").replace("A", "Ö"), lang))
        labels.append((i, int(good), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_quality_held_out(labelled):
    docs, labels = labelled
    net = quality.fit_quality(docs, labels)
    got = {r.doc_id: r for r in quality.score_quality(docs, net).collect()}
    assert len(got) == 400 and all(r.held_out == (crc(i, 4) == 2) for i, r in got.items())
    held = [r for r in got.values() if r.held_out]
    assert np.mean([r.predicted == int(i % 5 != 0) for i, r in got.items() if r.held_out]) > 0.95 and held
    kept = quality.keep_good(docs, net)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.predicted)


def test_quality_of_odd_texts_and_without_labels(spark, labelled):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string").withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net = quality.fit_quality(docs, none)
    got = quality.score_quality(docs, net).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(docs.limit(0), net).count() == 0 and quality.keep_good(docs.limit(0), net).count() == 0


def test_quality_reads_the_whole_text_in_blocks(monkeypatch):
    net = quality.ByteConvNet()
    texts = [b"abc def " * 5000, b"", b"x", b"end"]
    whole = net.score(texts)
    monkeypatch.setattr(quality, "BLOCK", 128)
    assert np.allclose(whole, net.score(texts), atol=1e-5)
    assert np.allclose(whole, [net.score([t])[0] for t in texts], atol=1e-5)
    changed = net.score([texts[0][:-100] + b"#%&!" * 25])
    assert changed[0] != whole[0]


def test_quality_gradients():
    net = quality.ByteConvNet()
    texts, y = [b"some Text 12 here again and again", b"AA!! BB!! %%"], np.array([1, 0], np.float32)
    grads = net._gradients(texts, y)
    loss = lambda: -np.mean(y * np.log(net.score(texts)) + (1 - y) * np.log(1 - net.score(texts)))
    for name in ("u", "v", "b", "w"):
        flat = net.p[name].reshape(-1)
        i = int(np.abs(grads[name]).argmax())
        old, step = flat[i], 1e-2
        flat[i] = old + step
        up = loss()
        flat[i] = old - step
        down = loss()
        flat[i] = old
        assert (up - down) / (2 * step) == pytest.approx(grads[name].reshape(-1)[i], rel=0.15, abs=2e-4), name


def test_gru_gradients():
    rng = np.random.default_rng(1)
    layer = langid.Direction(rng)
    layer.p = {k: v.astype(np.float64) for k, v in layer.p.items()}
    x = rng.integers(0, 256, (6, 3))
    x[4:, 1] = 256
    target = rng.standard_normal((6, 3, langid.HIDDEN))
    grads = layer.backward(x, layer.states(x), target)
    for name in ("table", "u"):
        i = int(np.abs(grads[name]).argmax())
        flat, step = layer.p[name].reshape(-1), 1e-3
        old = flat[i]
        values = []
        for s in (step, -step):
            flat[i] = old + s
            values.append(float((layer.states(x) * target).sum()))
        flat[i] = old
        assert (values[0] - values[1]) / (2 * step) == pytest.approx(grads[name].reshape(-1)[i], rel=1e-2), name


def test_languages_held_out(labelled):
    docs, _ = labelled
    got = {r.doc_id: r for r in langid.predict_languages(docs, langid.fit_languages(docs)).collect()}
    right = [r.lang_pred == ("en" if i % 2 else "xx") for i, r in got.items() if r.held_out]
    assert np.mean(right) > 0.95 and len(got) == 400


def test_languages_of_odd_texts(spark, labelled):
    net = langid.ByteLanguageNet(["en", "xx"]).fit([b"the of and " * 5, "žöž ".encode() * 9], ["en", "xx"], steps=5)
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict_languages(docs, net).collect()]
    assert len(got) == len(odd_rows())
    assert {i: p for i, p, _ in got if i in (1, 2, 5)} == {1: "und", 2: "und", 5: "und"}
    assert all(p in ("en", "xx") and 0 < s <= 1 for i, p, s in got if i in (3, 4))
    nothing = langid.fit_languages(docs)
    assert {r.lang_pred for r in langid.predict_languages(docs, nothing).collect()} == {"und"}
    assert langid.predict_languages(docs.limit(0), net).count() == 0


def test_segments_do_not_change_the_pooling():
    net = langid.ByteLanguageNet(["a", "b"])
    texts = [b"hello there " * 100, b"x", b"", b"zzz" * 50]
    together = net.probabilities(texts)
    assert np.allclose(together, [net.probabilities([t])[0] for t in texts], atol=1e-5)
    assert np.allclose(together[2], 0.5)


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    model = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(r.held_out == (crc(i, 5) == 0) for i, r in got.items())
    assert all(r.predicted == int(i % 7 == 0) for i, r in got.items() if i % 2)


def test_grammar_settings():
    model = toxicity.ToxicityGrammar({"idiot": 5.0})
    at = lambda text: {e for e, v in zip(toxicity.EVENTS, model.events(text)) if v}
    assert at("what an idiot") == {"insult"}
    assert at("you are an idiot") == {"insult+aimed"}
    assert at("this is not an idiot") == {"insult+negated"}
    assert at("one two. He said that was an idiot") == {"insult+reported"} or at("one two. He said that was an idiot") == {"insult+reported+aimed"}
    assert at("nothing not here. idiot") == {"insult"}
    assert at("they said idiot. idiots all") >= {"insult"}
    assert at("i will kill you") == {"threat"} and at("you kill") == {"threat+aimed"}
    assert at("") == set() and at("fine words") == set()
    once, twice = model.events("an idiot"), model.events("an idiot idiot")
    assert twice.max() > once.max()


def test_composition_is_one_after_the_other():
    a, b = toxicity._marker("negation", "negated", 2, 0.5), toxicity._marker("target", "aimed", 3, 2.0)
    symbols = ["target", "negation", "-", "insult", "-", "insult", "|", "insult", "target", "threat"]
    first = a.run(symbols)
    second = b.run([s for s, _ in first])
    expected = [(s, w * v) for (_, w), (s, v) in zip(first, second)]
    assert a.compose(b).run(symbols) == expected


def test_toxicity_of_odd_texts(spark):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


# Nearest neighbours ------------------------------------------------------------------------------------------------


def test_recall_of_clustered_vectors():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((20, 32))[rng.integers(0, 20, 3000)] * 2 + rng.standard_normal((3000, 32))) * rng.uniform(0.5, 2, (3000, 1))
    graph = hnsw.Graph.from_bytes(hnsw.build(x).to_bytes())
    q = x[::50]
    found = hnsw.search(graph, q, 20)
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found.tolist(), best.tolist())]) > 0.93


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_tiny_graphs(n):
    x = np.eye(4)[:n].reshape(n, 4)
    if n:
        assert set(hnsw.search(hnsw.build(x), np.ones((1, 4)), 5)[0].tolist()) - {-1} == set(range(n))


def test_nearest_with_copies_nulls_and_ties(spark):
    nan = float("nan")
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(60, [0.5, 0.5]), (80, None), (100, [0.0, 0.0]), (120, [nan, 1.0]), (140, [None, 1.0]), (None, [1.0, 0.0]), (160, [2.0, 0.1]), (160, [2.0, 0.1]), (180, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in hnsw.nearest(table, 20, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 60, 160}
    assert [v for _, v, _ in got[20]] == [160, 0, 1, 2, 3] and [k for k, _, _ in got[20]] == [1, 2, 3, 4, 5]
    assert got[0][0][2] == 2.0 and [v for _, v, _ in got[0]] == [160, 1, 2, 3, 4]
    assert [v for _, v, _ in got[160]] == [0, 1, 2, 3, 4]
    assert hnsw.nearest(table.limit(0)).count() == 0


def test_nearest_over_several_shards(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    hit = 0
    rows = hnsw.nearest(table, 20, 20, shard_rows=64).collect()
    d = x.astype(np.float64)
    for q in range(0, 400, 20):
        s = d @ d[q]
        s[q] = -np.inf
        best = set(np.lexsort((np.arange(400), -s))[:20].tolist())
        own = [r for r in rows if r.query_id == q]
        assert [r.rank for r in sorted(own, key=lambda r: (-r.score, r.vec_id))] == list(range(1, 21))
        assert all(r.score == pytest.approx(s[r.vec_id], rel=1e-12) for r in own)
        hit += len(best & {r.vec_id for r in own})
    assert hit / 400 > 0.95


# Language model ----------------------------------------------------------------------------------------------------


@settings(deadline=None, max_examples=150)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=80), st.sets(st.integers(0, 5000), max_size=200), st.integers(0, 2**63))
def test_elias_fano_finds_what_is_there(wide, dense, base):
    keys = np.unique(np.array([*wide, *(base + d for d in dense)], np.uint64))
    ef = lm.EliasFano.of(keys)
    queries = np.concatenate((keys, keys + np.uint64(1), keys - np.uint64(1), np.array([0, 2**64 - 1], np.uint64)))
    at = {int(k): i for i, k in enumerate(keys)}
    assert ef.find(queries).tolist() == [at.get(int(q), -1) for q in queries]


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(1, 2**32 - 1)), unique_by=lambda t: t[0]))
def test_runs_round_trip(pairs):
    pairs.sort()
    keys, counts = np.array([k for k, _ in pairs], np.uint64), np.array([c for _, c in pairs], np.int64)
    got = lm._run_arrays(lm._run_bytes(keys, counts))
    assert np.array_equal(got[0], keys) and np.array_equal(got[1], counts)


@pytest.mark.parametrize("shard_bytes", [1 << 30, 500])
def test_scores_against_brute_force(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(lm, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(lm, "BATCH_BYTES", 4000)
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, int(rng.integers(1, 80)))) for i in range(120)] + [(500, None), (501, ""), (502, "The\x0bOF never-seen"), (None, "a b"), (7, "dup id"), (503, "zz " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    model = lm.fit(docs, F.coalesce(~out, F.lit(True)))
    got = lm.score_texts(docs, model, out).collect()
    tok = lambda t: (t or "").encode().lower().split() + [b" "]
    count, pair, context = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in rows:
        if i is None or crc(i, 7) != 2:
            w = tok(t)
            count.update(w)
            pair.update(zip([None, *w], w))
            context.update([None, *w[:-1]])
    n, v = sum(count.values()), len(count)
    n1, n2 = (sum(c == k for c in count.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 else 0.5
    p1 = lambda w: (count[w] - d) / n if count[w] else max(d * v / n, 1e-12)

    def plain(t):
        w = tok(t)
        s = sum(math.log10((pair[a, b] + lm.PRIOR * p1(b)) / ((context[a] if a is None or count[a] else 0) + lm.PRIOR)) for a, b in zip([None, *w], w))
        return len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), s

    assert len(got) == len(rows)
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(plain(t))
    for r in got:
        best = min(texts[r.doc_id], key=lambda e: abs(e[2] - r.base_score))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*best[:2], n)
        assert r.base_score == pytest.approx(best[2], rel=1e-9)
        assert r.score == pytest.approx(best[3], abs=0.02 * best[0] + 1e-6)
        assert r.held_out == (r.doc_id is not None and crc(r.doc_id, 7) == 2)


def test_model_sums_to_one(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b a"), (3, "c c c d")], "doc_id long, text string")
    model = lm.fit(docs, F.lit(True))
    words = [b"a", b"b", b"c", b"d"]
    after_a = [10 ** (model.score([b"a " + w])["score"][0]) for w in words]
    assert after_a[1] > after_a[3]  # "a b" was seen, "a d" wasn't
    hashes = lm._numbered([*words, lm.END])[0]
    ids, counts = model.word_ids(hashes)
    assert (10 ** model.word_log(counts)).sum() + 10 ** model.word_log(np.array([0]))[0] == pytest.approx(1)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = lm.fit(docs, F.lit(False))
    got = lm.score_texts(docs, model, F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens) for r in got] == [(0, 0), (0, 0)] and all(math.isfinite(r.score) for r in got)
    assert lm.score_texts(docs.limit(0), model, F.lit(True)).count() == 0
