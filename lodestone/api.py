"""The request surface: parameters are checked here, and each request is one plan of operators.

A request that can't be met raises ``ValueError``; results are DataFrames, which a gateway turns into JSON.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import dates, vectors
from .operators import companies, entities, reports, scoring, search


@dataclass(frozen=True)
class Search:
    """Terms as a list, or as one string split at semicolons."""

    terms: list[str] | str = field(default_factory=list)
    vector: list[float] | None = None
    query_type: str = "AND"
    start_year: int = 2004
    end_year: int = 2025
    limit: int = 2000
    k: int = 1000
    threshold: float = 0.6
    scope: str = "row"

    def words(self) -> list[str]:
        given = self.terms.split(";") if isinstance(self.terms, str) else self.terms
        return [t.strip() for t in given if t.strip()]

    def checked(self) -> Search:
        if not self.words() and self.vector is None:
            raise ValueError("terms or a vector must be given")
        if any(len(t) < 2 for t in self.words()):
            raise ValueError("terms must be longer than one character")
        if self.query_type not in ("AND", "OR"):
            raise ValueError("query_type is AND or OR")
        return self


@dataclass
class Engine:
    """Requests over logical tables.

    docs: doc_id, doc_type, doc_date, family_id, investment; mentions: doc_id, entity_id, name, rollups, domain, search (lexemes);
    ownables: doc_id, owner_id and names; owners; acquisitions: owner_id, count; doc_vectors: doc_id, vector.
    """

    docs: DataFrame
    mentions: DataFrame
    ownables: DataFrame | None = None
    owners: DataFrame | None = None
    acquisitions: DataFrame | None = None
    doc_vectors: DataFrame | None = None
    messages: DataFrame | None = None

    def _matching(self, p: Search, doc_type: str | None = None) -> DataFrame:
        p = p.checked()
        ids = search.doc_ids_for_terms(self.mentions, p.words(), p.query_type, p.scope) if p.words() else None
        near = None if p.vector is None else vectors.nearest(self.doc_vectors, "vector", p.vector, p.k, "doc_id", p.threshold).select("doc_id")
        docs = self.docs if doc_type is None else self.docs.filter(F.col("doc_type") == doc_type)
        return search.matching_docs(docs, term_ids=ids, vector_ids=near, query_type=p.query_type, start_year=p.start_year, end_year=p.end_year)

    def documents(self, p: Search, doc_type: str, ids: list | None = None) -> DataFrame:
        """Patents, trials or approvals: by ids of that type, or by terms and vector, newest first."""
        if ids:
            return search.by_ids(self.docs.filter(F.col("doc_type") == doc_type), ids)
        return search.newest_first(self._matching(p, doc_type), p.limit)

    def patents(self, p: Search, attributes: DataFrame, as_of_year: int) -> DataFrame:
        """Patents with scores, best first; ``attributes``: doc_id, attributes, availability."""
        found = self.documents(p, "patent").join(attributes, "doc_id", "left").withColumn("attributes", F.coalesce("attributes", F.array().cast("array<string>")))
        return scoring.scored(found, as_of_year).orderBy(F.col("score").desc(), "doc_id")

    def entities(self, p: Search, domains: list[str] | None = None) -> DataFrame:
        rows = self.mentions.join(self._matching(p).select("doc_id"), "doc_id", "left_semi")
        return entities.two_level(rows if domains is None else rows.filter(F.col("domain").isin(domains)), limit=p.limit)

    def autocomplete(self, string: str, limit: int = 25) -> DataFrame:
        named = self.mentions.groupBy(F.col("entity_id").alias("id"), "name").agg(F.count(F.lit(1)).alias("count"))
        sources = [(named, "entity", "e")]
        if self.ownables is not None:
            sources.append((self.ownables.groupBy(F.col("owner_id").alias("id"), "name").agg(F.count(F.lit(1)).alias("count")), "owner", "o"))
        return search.autocomplete(sources, string, limit)

    def _rows(self, p: Search) -> DataFrame:
        return self.mentions.join(self._matching(p), "doc_id")

    def summarize(self, p: Search) -> DataFrame:
        return reports.by_filters(self._rows(p), {d: F.col("domain") == d for d in ("MECHANISM", "COMPOUND", "BIOLOGIC", "DISEASE")}, lambda df: reports.counts(df, "category_rollup", distinct="doc_id"))

    def over_time(self, p: Search, top: int = 10) -> DataFrame:
        return reports.gap_filled(reports.top_of(reports.counts(self._rows(p), "canonical_name", "year", distinct="doc_id"), "x", top))

    def x_by_y(self, p: Search, x: str, y: str | None = None) -> DataFrame:
        return reports.counts(self._rows(p), x, y, distinct="doc_id")

    def characteristics(self, p: Search, head: str = "category_rollup", tail: str = "instance_rollup", doc_type: str = "patent") -> DataFrame:
        return reports.characteristics(self._matching(p, doc_type), self.mentions, self.ownables, head, tail)

    def decompose(self, concepts: dict[str, list[float]], k: int = 1000) -> DataFrame:
        """(concept, year, count) of each sub-concept's nearest documents."""
        near = [vectors.nearest(self.doc_vectors, "vector", v, k, "doc_id").select(F.lit(c).alias("concept"), "doc_id") for c, v in concepts.items()]
        return reduce(DataFrame.union, near).join(self.docs, "doc_id").groupBy("concept", dates.year_of(F.col("doc_date")).alias("year")).agg(F.count(F.lit(1)).alias("count"))

    def companies(self, vector: list[float], k: int = 1000, start_year: int = 2000) -> DataFrame:
        near = vectors.nearest(self.doc_vectors, "vector", vector, k, "doc_id").select("doc_id", "similarity").join(self.docs.select("doc_id", "doc_date"), "doc_id")
        relevant = near.join(self.ownables.select("doc_id", "owner_id").distinct(), "doc_id")
        return companies.company_metrics(relevant, self.owners, self.acquisitions, start_year).orderBy(F.col("score").desc(), "owner_id")

    def chat(self, conversation_id, message_id) -> DataFrame:
        return self.messages.filter((F.col("conversation_id") == conversation_id) & (F.col("message_id") == message_id))


def canonical_key(value) -> str:
    """A cache key of any nested value: equal values, whatever the order of their keys, have equal keys."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{canonical_key(v)}" for k, v in sorted(value.items(), key=lambda kv: str(kv[0]))) + "}"
    if isinstance(value, (list, tuple, set, frozenset)):
        items = [canonical_key(v) for v in value]
        return "[" + ",".join(sorted(items) if isinstance(value, (set, frozenset)) else items) + "]"
    return str(value)
