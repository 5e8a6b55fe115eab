import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_pfair_slots_stay_within_a_block(shares):
    slots = mixing.pfair_slots(shares)
    size = sum(shares)
    assert sorted(s for own in slots for s in own) == list(range(size))
    for own, c in zip(slots, shares):
        done = np.searchsorted(own, np.arange(size), "right")
        assert np.abs(done - np.arange(1, size + 1) * c / size).max() < 1


@settings(max_examples=100)
@given(st.dictionaries(st.text(max_size=3), st.integers(0, 500), max_size=6), st.data())
def test_plan_places_every_block_once(blocks, data):
    weights = {s: data.draw(st.floats(0.01, 10)) for s in blocks}
    rows = mixing.plan(blocks, weights, 50)
    placed = {s: set() for s in blocks}
    slots = []
    for r in rows:
        for k in range(r["blocks"]):
            placed[r["source"]].add(r["first"] + k)
            slots.append(r["base"] + k // r["share"] * r["size"] + r["slots"][k % r["share"]])
    assert all(placed[s] == set(range(n)) for s, n in blocks.items())
    assert sorted(slots) == list(range(sum(blocks.values())))


@pytest.mark.parametrize("rows_per_bucket", [7, 1000])
def test_mix_is_whole_and_to_weight(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows_per_bucket)
    rows = [(i, "hot" if i % 3 else "rare" if i % 2 else None) for i in range(900)] + [(None, "hot"), (5, "hot"), (5, "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("slot", F.lit("clash")).withColumn("_rank", F.lit(0))
    got = mixing.mix_order(docs, {"hot": 2, "rare": 1, None: 1}, block_docs=3, resolution=40).collect()
    assert len(got) == len(rows) and len({r.position for r in got}) == len(rows)
    by_slot = dict(sorted({r.slot: r.source for r in got}.items()))
    assert list(by_slot) == list(range(len(by_slot)))
    first = list(by_slot.values())[:100]  # no source has ended by then
    for s, share in (("hot", 0.5), ("rare", 0.25), (None, 0.25)):
        for n in range(1, 101):
            assert abs(first[:n].count(s) - n * share) < 1
    whole = mixing.mixed(docs, {"hot": 2, "rare": 1, None: 1}, block_docs=3)
    assert whole.columns == docs.columns and whole.count() == len(rows)


def test_mix_of_nothing_and_bad_weights(spark):
    empty = spark.createDataFrame([], "doc_id long, source string")
    assert mixing.mix_order(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_order(empty, {"a": 0})


def test_mix_stays_native(spark):
    plan = mixing.mix_order(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a").alias("source")))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD"))


@pytest.fixture(scope="module")
def tokenizer():
    return packing.WordTokenizer(PATH)


def plain_ids(tokenizer, text):
    return tokenizer.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None, suppress_health_check=list(__import__("hypothesis").HealthCheck))
@given(st.lists(st.lists(st.sampled_from([*"aAbT.,!'sS1 \n\t\r\x0b\x1c\xa0\u3000éÉ\u0301\u0308İßΣ½😀<|>\u212a", "<|endoftext|>", "<|ENDOFTEXT|>", "The", "'LL"]), max_size=30).map("".join), max_size=5))
def test_word_tokenizer_is_the_tokenizer(tokenizer, texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in tokenizer.encode(texts)]
    assert got == [plain_ids(tokenizer, t) for t in texts]


def test_word_tokenizer_forgets_and_is_still_right(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    t = packing.WordTokenizer(PATH)
    for text in ("one two three four five", "five one six", "one two", "", "seven one"):
        assert np.frombuffer(t.encode([text])[0], "<u4").tolist() == plain_ids(t, text)


@settings(deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=300))
def test_sum_of_squares_is_a_packing(lengths):
    lengths = np.array(lengths)
    bins, offsets = packing.sum_of_squares(lengths, 100)
    taken = {}
    for b, o, n in sorted(zip(bins.tolist(), offsets.tolist(), lengths.tolist())):
        assert o == taken.get(b, 0)
        taken[b] = o + n
    assert max(taken.values()) <= 100 and len(taken) == bins.max() + 1
    # Never two bins that could be one: no more than twice the least number.
    assert len(taken) <= 2 * -(-lengths.sum() // 100)


def test_documents_packed(spark, tokenizer):
    texts = [None, "", "short one", "word " * 5000, "a b c", "a b c", "Ünï " * 3]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(2, "short one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash"))
    got = packing.pack_documents(docs, PATH).collect()
    expected = []
    for i, t in rows:
        ids = [*plain_ids(tokenizer, t or ""), 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            expected.append((i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(expected, key=repr)
    taken = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == taken.get(r.sequence_id, 0)
        taken[r.sequence_id] = r.offset + r.length
    assert max(taken.values()) <= 2048
    assert len(taken) == -(-sum(r.length for r in got) // 2048)


def test_sequences_hold_the_ids(spark, tokenizer):
    docs = spark.createDataFrame([(1, "first text"), (2, "word " * 3000), (3, "another")], "doc_id long, text string")
    placed = packing.pack_documents(docs, PATH)
    got = packing.sequences(docs, placed, PATH).collect()
    every = sorted(x for r in got for x in r.ids)
    assert every == sorted(x for t in ("first text", "word " * 3000, "another") for x in [*plain_ids(tokenizer, t), 0])


def test_nothing_to_pack(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("blocks, weights", [({"a": 450, "b": 50}, {"a": 1, "b": 1}), ({"a": 625, "b": 225}, {"a": 5000**0.5, "b": 1800**0.5}), ({"a": 300_000, "b": 20_000, "c": 90, "d": 1}, {"a": 2400e3**0.5, "b": 160e3**0.5, "c": 715**0.5, "d": 3**0.5}), ({"a": 900_000, "b": 800_000, "c": 7}, {"a": 1, "b": 0.7, "c": 1e-6})])
def test_plan_keeps_to_weights_until_a_source_ends(blocks, weights):
    at = {s: [] for s in blocks}
    for r in mixing.plan(blocks, weights):
        k = np.arange(r["blocks"])
        at[r["source"]].append(r["base"] + k // r["share"] * r["size"] + np.array(r["slots"])[k % r["share"]])
    at = {s: np.concatenate(x) for s, x in at.items()}
    assert sorted(np.concatenate(list(at.values())).tolist()) == list(range(sum(blocks.values())))
    start, left = 0, dict(weights)
    while left:
        end = min(at[s][-1] for s in left) + 1
        n = np.arange(1, end - start + 1)
        for s, w in left.items():
            there = np.searchsorted(at[s], start + n - 1, "right") - np.searchsorted(at[s], start, "left")
            slack = 1 if len(n) <= mixing.RESOLUTION else 1 + len(n) / mixing.RESOLUTION
            assert np.abs(there - n * w / sum(left.values())).max() < slack
        left = {s: w for s, w in left.items() if at[s][-1] >= end}
        start = end


def test_mix_of_a_small_table_is_to_weight(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3600, "big").otherwise("small").alias("source"))
    got = sorted((r.slot, r.source) for r in mixing.mix_order(docs, {"big": 1, "small": 1}).collect())
    first = [s for _, s in got[:800]]
    assert first.count("small") == 400 and first[:80].count("small") == 40


def test_mix_spreads_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HOT_ROWS", 40)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    rows = [(None, "a", f"t{i}") for i in range(300)] + [(7, "b", f"u{i}") for i in range(100)] + [(i, "b", "v") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs, {"a": 1, "b": 1}, block_docs=2)
    assert "_number" in got._jdf.queryExecution().analyzed().toString()
    found = got.select("_row.*", "position").collect()
    assert len({r.position for r in found}) == 500 and sorted((r.doc_id, r.source, r.text) for r in found if r.doc_id is not None) == sorted(r for r in rows if r[0] is not None)
    assert {r.text for r in found if r.doc_id is None} == {f"t{i}" for i in range(300)}


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60))
def test_every_placement_makes_the_squares_least(lengths):
    lengths = np.array(lengths)
    bins, offsets = packing.sum_of_squares(lengths, 30)
    used: dict[int, int] = {}

    def squares(fill):
        gaps = [30 - f for f in fill.values() if f < 30]
        return sum(gaps.count(g) ** 2 for g in set(gaps))

    for i in np.argsort(-lengths, kind="stable").tolist():
        n, b = int(lengths[i]), int(bins[i])
        choices = {c: squares(used | {c: f + n}) for c, f in used.items() if f + n <= 30}
        assert offsets[i] == used.get(b, 0)
        if choices:
            best = min(choices.values())
            assert choices[b] == best and 30 - used[b] == min(30 - used[c] for c, v in choices.items() if v == best)
        else:
            assert b == len(used)
        used[b] = used.get(b, 0) + n


def test_windows_follow_the_files_and_not_the_splits(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r.window for r in packing.in_runs(docs, run_docs=150).collect()}
    assert got == {i: i // 150 for i in range(1000)}
    placed = packing.pack_documents(packing.in_runs(docs, run_docs=150), PATH, capacity=40, window=F.col("window")).collect()
    order = sorted(placed, key=lambda r: (r.sequence_id, r.offset))
    assert [got[r.doc_id] for r in order] == sorted(got.values()) and len(placed) == 1000
    assert {r.window for r in packing.in_runs(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()} == {0}
