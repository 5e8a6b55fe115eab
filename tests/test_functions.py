import pytest
from pyspark.sql import functions as F

from lodestone.functions import dates, text, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("  Foo   bar , baz", "foo bar, baz"),
        ("Anti-TNF & more\nsecond line", "anti tnf and more"),
        ("(whole)", "whole"),
        ("drug (the first kind) x", "drug x"),
        ("iso(x)yl", "iso(x)yl"),
        ("Name® — IL-2", "name - il-2"),
        ("", ""),
    ],
)
def test_clean(spark, raw, expected):
    assert value(spark, text.clean(F.lit(raw))) == expected


def test_clean_keeps_null(spark):
    assert value(spark, text.clean(F.lit(None).cast("string"))) is None


def test_lexemes_of_null_rollup_stay_searchable(spark):
    lex = text.lexemes(F.lit("Red Widgets"), F.lit(None).cast("string"))
    assert value(spark, lex) == ["red", "widget"]
    assert value(spark, text.matches_all(lex, "widget"))
    assert not value(spark, text.matches_all(lex, "the"))


def test_terms_and_or(spark):
    lex = text.lexemes(F.lit("red widget"))
    assert value(spark, text.matches_terms(lex, ["red widget", "blue"], "OR"))
    assert not value(spark, text.matches_terms(lex, ["red", "blue"], "AND"))
    assert not value(spark, text.matches_terms(lex, ["blue widget"], "OR"))


@pytest.mark.parametrize("n, expected", [(1, ["a", "b", "c"]), (2, ["a b", "b c"]), (3, ["a b c"]), (4, [])])
def test_word_ngrams(spark, n, expected):
    assert value(spark, text.word_ngrams(F.array(*map(F.lit, "abc")), n)) == expected


def test_trigrams(spark):
    assert sorted(value(spark, text.trigrams(F.lit("cat")))) == ["  c", " ca", "at ", "cat"]
    assert value(spark, text.trigram_similarity(text.trigrams(F.lit("")), text.trigrams(F.lit("")))) == 0.0


def test_fenced_json_and_chunks(spark):
    assert value(spark, text.fenced_json(F.lit('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}'
    assert value(spark, text.chunks(F.lit("abcde"), 2)) == ["ab", "cd", "e"]
    assert value(spark, text.chunks(F.lit(""), 2)) == [""]


@pytest.mark.parametrize("pattern, expected", [("cent(?:er|re)s?", ["center", "centers", "centre", "centres"]), ("[ab]c", ["ac", "bc"]), ("plain", ["plain"]), ("a|b", ["a", "b"])])
def test_expand_pattern(pattern, expected):
    assert sorted(text.expand_pattern(pattern)) == expected


def test_retry_forms_and_swap(spark):
    assert value(spark, text.retry_forms(F.lit("il-2, human"))) == ["il2, human", "il 2, human", "il-2"]
    assert value(spark, text.swap_of(F.lit("inhibitor of kinase"))) == "kinase inhibitor"


def test_words_removed_by_place(spark):
    assert value(spark, text.without_words(F.lit("the new drug therapy"), ["the", "new"], ["therapy"])) == "drug"


def test_dates(spark):
    day = F.lit("2020-06-01").cast("timestamp_ntz")
    assert value(spark, dates.duration_days(F.lit(None).cast("timestamp_ntz"), day, "2020-01-01")) == -1
    assert value(spark, dates.duration_days(day, F.lit(None).cast("timestamp_ntz"), "2020-06-11")) == 10
    assert value(spark, dates.patent_years(day, 2060)) == 0
    assert value(spark, dates.year_spine(F.lit(2).cast("long"), F.lit(1).cast("long"))) == []
    assert not value(spark, dates.between_years(day, 2018, 2020))


def test_vectors(spark):
    a, zero = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, vectors.cosine(a, a)) == pytest.approx(1)
    assert value(spark, vectors.cosine(a, zero)) is None
    assert value(spark, vectors.l1_normalised(F.array(F.lit(0.05), F.lit(-3.0), F.lit(1.0)))) == [0.0, -0.75, 0.25]
    assert value(spark, vectors.l1_normalised(zero)) == [0.0, 0.0]
    assert value(spark, vectors.padded(a, 3)) == [3.0, 4.0, 0.0]
    assert value(spark, vectors.combined(a, zero, 0.5)) == [1.5, 2.0]


def test_too_many_strings_are_an_error():
    with pytest.raises(ValueError):
        text.expand_pattern("[abcdefghij][abcdefghij][abcdefghij][abcdefghij]")
