"""Term, id and vector search over documents and the search view."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text, vectors

#: Id patterns of the document types.
ID_PATTERNS = {"patent": r"^(?:WO|US|EP)-?\d+", "trial": r"^NCT\d{8}$", "regulatory_approval": r"^[0-9a-f-]{36}$|^NDA\d+$"}


def search_view(mentions: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row per mention of any kind: document, names, lexemes, type and entity.

    ``mentions``: (kind, frame) with doc_id, doc_type, entity_id, name, instance_rollup, category_rollup and domain.  A null
    rollup leaves the row searchable by its other names.  Owners of type OTHER are left out.
    """

    def one(kind: str, df: DataFrame) -> DataFrame:
        kept = df.filter(~F.col("domain").eqNullSafe("OTHER")) if kind == "owner" else df
        return kept.select(
            F.lit(kind).alias("kind"),
            "doc_type",
            *[F.when(F.col("doc_type") == t, F.col("doc_id")).alias(f"{t}_id") for t in ID_PATTERNS],
            "entity_id",
            "name",
            "instance_rollup",
            "category_rollup",
            F.col("domain").alias("type"),
            text.lexemes(F.col("name"), F.col("instance_rollup"), F.col("category_rollup")).alias("search"),
        )

    return reduce(DataFrame.unionByName, [one(k, df) for k, df in mentions])


def doc_ids_for_terms(view: DataFrame, terms: list[str], query_type: str = "AND", scope: str = "row", doc_col: str = "doc_id", lexeme_col: str = "search") -> DataFrame:
    """Distinct documents that match the terms.

    scope row: one mention must satisfy the whole query; doc: the document's mentions may do so together, each
    term by one of them.
    """
    if not terms or any(len(t) < 2 for t in terms):
        raise ValueError("terms must be given and longer than one character")
    lex = F.col(lexeme_col)
    if scope == "row":
        return view.filter(text.matches_terms(lex, terms, query_type)).select(doc_col).distinct()
    flags = [F.max(text.matches_all(lex, t)).alias(f"_t{i}") for i, t in enumerate(terms)]
    hits = [F.col(f"_t{i}") for i in range(len(terms))]
    wanted = reduce(Column.__and__ if query_type == "AND" else Column.__or__, hits)
    some = view.filter(text.matches_terms(lex, terms, "OR"))
    return some.groupBy(doc_col).agg(*flags).filter(wanted).select(doc_col)


def matching_docs(docs: DataFrame, *, term_ids: DataFrame | None = None, vector_ids: DataFrame | None = None, query_type: str = "AND", start_year: int | None = None, end_year: int | None = None, id_col: str = "doc_id", date_col: str = "doc_date") -> DataFrame:
    """Documents in the years that are in the term matches and (AND) or (OR) in the vector matches; a side that isn't given takes no part."""
    if start_year is not None and end_year is not None:
        docs = docs.filter(dates.between_years(F.col(date_col), start_year, end_year))
    given = [ids.select(F.col(id_col).alias("_id")).distinct() for ids in (term_ids, vector_ids) if ids is not None]
    if not given:
        return docs
    if query_type == "OR":
        given = [reduce(DataFrame.union, given).distinct()]
    return reduce(lambda df, ids: df.join(ids, df[id_col] == ids["_id"], "left_semi"), given, docs)


def id_search_kind(ids: list[str]) -> str:
    """The document type whose ids these are; all must be of one type."""
    kinds = {next((k for k, p in ID_PATTERNS.items() if re.search(p, i)), None) for i in ids}
    if len(kinds) != 1 or None in kinds:
        raise ValueError("ids must be of one known type")
    return kinds.pop()


def by_ids(docs: DataFrame, ids: list, id_col: str = "doc_id", few: int = 1000) -> DataFrame:
    """Few ids as a list that reaches the scan, more by a semi join."""
    if len(ids) <= few:
        return docs.filter(F.col(id_col).isin(ids))
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], ["_id"])
    return docs.join(wanted, docs[id_col] == wanted["_id"], "left_semi")


def newest_first(docs: DataFrame, limit: int, date_col: str = "doc_date", id_col: str = "doc_id") -> DataFrame:
    """By date, latest first, rows without a date before all others, ties by id."""
    return docs.orderBy(F.col(date_col).desc_nulls_first(), id_col).limit(limit)


def keyset_page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next ``limit`` rows after key ``after`` (None: the first page)."""
    rest = df if after is None else df.filter(F.col(key) > after)
    return rest.orderBy(key).limit(limit)


def autocomplete(sources: list[tuple[DataFrame, str, str]], string: str, limit: int = 25) -> DataFrame:
    """(id, label, count) of names whose lexemes hold all words, largest count first.

    sources: (frame with id, name and count, type, prefix of ids).
    """
    if len(string) < 3:
        raise ValueError("string must have three characters or more")
    found = [
        df.filter(text.matches_all(text.lexemes(F.col("name")), string)).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("id"), F.lit(kind).alias("type"), F.col("count").cast("long").alias("count"), F.concat(F.col("name"), F.lit(" ("), F.col("count").cast("string"), F.lit(")")).alias("label"))
        for df, kind, prefix in sources
    ]
    return reduce(DataFrame.union, found).distinct().orderBy(F.col("count").desc(), "label", "id").limit(limit)


def trigram_matches(names: DataFrame, terms: DataFrame, threshold: float = 0.3, id_col: str = "id", name_col: str = "name", term_col: str = "term") -> DataFrame:
    """(term, id, name, similarity) at ``threshold`` or more, by an equi-join on trigrams.

    Shared trigrams are counted per pair, so no pair without a common trigram is ever made.  Give distinct names
    and terms: equal ones cost a pair each.
    """
    left = terms.select(F.col(term_col).alias("term"), text.trigrams(F.col(term_col)).alias("_t"))
    right = names.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), text.trigrams(F.col(name_col)).alias("_n"))
    a = left.select("term", F.size("_t").alias("_nt"), F.explode("_t").alias("_g"))
    b = right.select("id", "name", F.size("_n").alias("_nn"), F.explode("_n").alias("_g"))
    shared = a.join(b, "_g").groupBy("term", "id", "name").agg(F.count(F.lit(1)).alias("_s"), F.first("_nt").alias("_nt"), F.first("_nn").alias("_nn"))
    similarity = F.col("_s") / (F.col("_nt") + F.col("_nn") - F.col("_s"))
    return shared.select("term", "id", "name", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)


def description_matches(docs: DataFrame, vector_col: str, query: list[float], k: int, threshold: float, id_col: str = "doc_id") -> DataFrame:
    """Ids of the k nearest documents that reach the threshold: the limit comes first."""
    return vectors.nearest(docs, vector_col, query, k, id_col, threshold).select(id_col, "similarity")
