"""Linking mentions to entities: candidates, scores, canonical forms, dictionary recognition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Shares of meaning and spelling in a candidate's score; the bonus of much-named concepts.
SEMANTIC, SYNTACTIC, MANY_ALIASES, ALIAS_BONUS = 0.75, 0.25, 8, 1.05


def candidate_score(semantic: Column, syntactic: Column, type_weight: Column, aliases: Column) -> Column:
    return (semantic * SEMANTIC + syntactic * SYNTACTIC) * F.coalesce(type_weight, F.lit(0.7)) * F.when(aliases >= MANY_ALIASES, ALIAS_BONUS).otherwise(1.0)


def best_candidates(candidates: DataFrame, key: str, score: str, id_col: str) -> DataFrame:
    """The best-scored candidate of each key, ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(score).desc(), id_col))
    return candidates.withColumn("_r", rank).filter("_r = 1").drop("_r")


def linked(mentions: DataFrame, canonical: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``mentions`` with canonical_id and canonical_name by lower-cased term; a term that isn't found stands for itself.

    Of several concepts for a term that with the least id counts.  ``overrides`` (term, canonical_id, canonical_name) go first.
    """
    table = canonical if overrides is None else canonical.join(overrides.select("term"), "term", "left_anti").unionByName(overrides)
    one = table.groupBy(F.lower("term").alias("_t")).agg(F.min(F.struct("canonical_id", "canonical_name")).alias("_c"))
    joined = mentions.join(one, F.lower("term") == F.col("_t"), "left")
    return joined.select(*mentions.columns, F.coalesce(F.col("_c.canonical_id").cast("string"), F.lower("term")).alias("canonical_id"), F.coalesce("_c.canonical_name", F.lower("term")).alias("canonical_name"))


def dictionary_entities(docs: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, term): dictionary terms among the words of each text, the longest at every place.

    Each word meets the terms that begin with it, whose other words are then compared with those that follow; terms may be of
    any length.  A span inside a longer one that was found goes.
    """
    terms = dictionary.select(text.tokens(F.col("term")).alias("_w")).filter(F.size("_w") > 0).distinct()
    terms = terms.select(F.get("_w", F.lit(0)).alias("_first"), "_w", F.size("_w").alias("length"), F.array_join("_w", " ").alias("term"))
    longest = terms.agg(F.max("length")).first()[0] or 1
    runs = text.let(text.tokens(F.col(text_col)), lambda w: F.transform(w, lambda x, i: F.struct((i + 1).alias("start"), x.alias("_first"), F.slice(w, i + 1, longest).alias("_run"))))
    placed = docs.select(F.col(id_col).alias("doc_id"), F.explode(runs).alias("_s")).select("doc_id", "_s.*")
    found = placed.join(terms, "_first").filter(F.slice("_run", F.lit(1), F.col("length")) == F.col("_w")).select("doc_id", "start", "length", "term")
    return without_overlaps(found)


def without_overlaps(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans that no longer one, or earlier one of the same length, covers in part; compared with all longer ones, kept or not.

    Spans are looked at within their own document, by places: each place knows the best span over it, and a span stays
    if it is the best at all its places.
    """
    best = F.struct(F.col("length").alias("l"), (-F.col("start")).alias("s"))
    places = spans.withColumn("_p", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)))
    top = places.groupBy(key, "_p").agg(F.max(best).alias("_b"))
    held = places.join(top, [key, "_p"]).filter((F.col("_b.l") == F.col("length")) & (F.col("_b.s") == -F.col("start")))
    return held.groupBy(key, "start", "length", "term").agg(F.count(F.lit(1)).alias("_n")).filter("_n = length").drop("_n")


def composite_id(ids: Column) -> Column:
    """Sorted distinct ids joined by a bar."""
    return F.array_join(F.array_sort(F.array_distinct(ids)), "|")


def entity_to_concepts(entities: DataFrame, concepts: DataFrame) -> DataFrame:
    """(entity_id, concept_id): the parts of composite ids that are concepts."""
    parts = entities.select("entity_id", F.explode(F.split("canonical_id", r"\|")).alias("concept_id"))
    return parts.join(concepts.select("concept_id").distinct(), "concept_id", "left_semi").distinct()


def best_alias(aliases: DataFrame, key: str, alias: str, position: str) -> DataFrame:
    """Each key's display name: no digits or brackets first, then the shorter in words, then the earlier."""
    odd = F.col(alias).rlike(r"[\d\[\](),]").cast("int")
    rank = F.struct(odd.alias("a"), F.size(F.split(alias, " ")).alias("b"), F.col(position).alias("c"), F.col(alias).alias("n"))
    return aliases.groupBy(key).agg(F.min(rank)["n"].alias("display_name"))
