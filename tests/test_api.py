import pytest
from pyspark.sql import functions as F

from lodestone import api
from lodestone.operators import loads


@pytest.mark.parametrize("bad", [api.Search(), api.Search(terms="x"), api.Search(terms=["ok"], query_type="XOR"), api.Search(terms=" ; ")])
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        bad.checked()


def test_terms_split_at_semicolons():
    assert api.Search(terms="a b; c d ;").words() == ["a b", "c d"]


def test_keys_of_equal_values_are_equal():
    assert api.canonical_key({"b": [1, {2, 3}], "a": None}) == api.canonical_key({"a": None, "b": [1, {3, 2}]})
    assert api.canonical_key([1, 2]) != api.canonical_key([2, 1])


def test_chat_looks_up_by_both_keys(spark):
    messages = spark.createDataFrame([("c", 1, "hi"), ("c", 2, "yo"), ("d", 1, "no")], "conversation_id string, message_id long, content string")
    assert [r.content for r in api.Engine(docs=None, mentions=None, messages=messages).chat("c", 1).collect()] == ["hi"]


@pytest.mark.parametrize("name, expected", [("2-(4-chlorophenyl)-N-methylacetamide", True), ("aspirin", False), ("IL-2", False), ("N-benzylpiperazine", True), (None, False)])
def test_chemical_names(spark, name, expected):
    assert spark.range(1).select(loads.is_chemical_name(F.lit(name).cast("string")).alias("v")).first()["v"] == expected


def test_spans_of_every_occurrence(spark):
    docs = spark.createDataFrame([(1, "Ab cab (ab)"), (2, None)], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "ab"), (1, "(ab)"), (2, "x"), (1, "absent")], "doc_id long, term string")
    got = {r.doc_id: [(s.start, s.end, s.term) for s in r.spans] for r in loads.span_offsets(docs, terms).collect()}
    assert got == {1: [(0, 2, "ab"), (4, 6, "ab"), (7, 11, "(ab)"), (8, 10, "ab")]}


def test_hashed_vectors_of_empty_texts_are_zero(spark):
    df = spark.createDataFrame([("some words here",), ("",), (None,)], "t string")
    v = [r.vector for r in loads.hashed_vectors(df, "t", 8).collect()]
    assert sum(x * x for x in v[0]) == pytest.approx(1) and v[1] == v[2] == [0.0] * 8


def test_composites_prefer_longer_then_better(spark):
    df = spark.createDataFrame([("t", 1, 2, "x", 0.3), ("t", 2, 2, "y", 0.9), ("t", 1, 1, "z", 1.0), ("t", 3, 1, "w", 0.5)], "term string, start int, length int, candidate_id string, score double")
    assert loads.composite_selection(df).first()["members"] == ["z", "y"]
