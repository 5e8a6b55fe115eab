"""Building blocks of the batch load: merges, updates, counts, owner names, annotation votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``table`` with the rows of ``changes`` put over those of the same keys and the rest added; null values don't overwrite.

    Keys must be unique in ``changes``.
    """
    t = table.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in columns])
    n = changes.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns])
    return t.join(n, keys, "full").select(*keys, *[F.coalesce(f"_n_{c}", f"_t_{c}").alias(c) for c in columns])


def updated(table: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``table`` with ``column`` from ``changes`` where the key has a value there, the least of several."""
    one = changes.groupBy(F.col(key).alias("_k")).agg(F.min(column).alias("_v"))
    return table.join(one, table[key] == F.col("_k"), "left").withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")


def inserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and those ``rows`` whose keys it doesn't have."""
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti"))


def first_per(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the first in an order that must be total for a stable result."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")


def majority(votes: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, votes): each key's commonest value, ties to the first by name."""
    n = votes.groupBy(F.lower(F.col(key).cast("string")).alias(key), value).agg(F.count(F.lit(1)).alias("votes"))
    return first_per(n, [key], [F.col("votes").desc(), value])


def numbered(values: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): each distinct value and its number, from 0, in ascending order; null isn't numbered.

    Values are sorted by ranges, and the ranges' counts are added up, so that no task sees them all.
    """
    ranges = values.select(column).filter(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column)
    placed = cut(ranges.withColumn("_i", F.monotonically_increasing_id()).select(column, F.shiftright("_i", 33).alias("_p"), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_b"))
    return placed.join(before, "_p").select(column, (F.col("_b") + F.col("_i")).alias(name))


def mention_offsets(annotations: DataFrame, sources: list[str]) -> DataFrame:
    """(doc_id, term, offset): the first place of each lower-cased term per document, over several sources."""
    one = [annotations.filter(F.col("source") == s).groupBy("doc_id", F.lower("term").alias("term")).agg(F.min("offset").alias("offset")) for s in sources]
    return reduce(DataFrame.union, one).groupBy("doc_id", "term").agg(F.min("offset").alias("offset"))


def counts_over_maps(maps: list[DataFrame], key: str) -> DataFrame:
    """(key, count) over all maps together; equal counts in two maps both count."""
    return reduce(DataFrame.unionByName, [m.select(key) for m in maps]).groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def harvested_names(frequent: DataFrame, rare: DataFrame, threshold: int, factor: int) -> DataFrame:
    """(name, count): names above the threshold from one source, scaled, with those of another that are below it."""
    a = frequent.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > threshold).select("name", (F.col("n") * factor).alias("count"))
    b = rare.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= threshold).select("name", F.col("n").alias("count"))
    return a.union(b).distinct()


def merged_owners(records: DataFrame) -> DataFrame:
    """One owner per name: the type of best rank, all synonyms sorted, counts added."""
    return records.groupBy("name").agg(F.min(F.struct("rank", "owner_type"))["owner_type"].alias("owner_type"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("synonyms")))).alias("synonyms"), F.sum("count").alias("count"))


def canonical_owner_name(name: Column, suffixes: list[str], overrides: dict[str, str]) -> Column:
    """Lower case, legal endings and punctuation off, single spaces; a name that begins like an override becomes it."""
    out = F.lower(name)
    out = F.regexp_replace(out, r"\b(?:" + "|".join(suffixes) + r")\b\.?", " ")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N} ]", " "), r"\s+", " "))
    found = F
    for start, canonical in overrides.items():
        found = found.when(out.startswith(start), canonical)
    return found.otherwise(out) if overrides else out


def checksum(table: DataFrame, name: str, distinct: list[str]) -> DataFrame:
    """(table, rows, one count of distinct values per column)."""
    return table.agg(F.count(F.lit(1)).alias("rows"), *[F.countDistinct(c).alias(f"distinct_{c}") for c in distinct]).select(F.lit(name).alias("table"), "*")


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, columns: list[str]) -> DataFrame:
    """``parents`` with their children as a sorted array of structs; an empty array where there is none."""
    kids = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return parents.join(kids, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kids.schema[name].dataType)))


def reassigned(df: DataFrame, term: str, domain: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Domains by rules (pattern, from, to), in order, each on what those before made; to "" deletes the row."""
    out = F.col(domain)
    for pattern, before, after in rules:
        out = F.when((out == before) & F.col(term).rlike(pattern), after).otherwise(out)
    return df.withColumn(domain, out).filter(F.col(domain) != "")


def owner_vectors(typed: DataFrame, owner: str, vector: str) -> DataFrame:
    """(owner, vector): the mean over document types of each type's mean vector."""
    from ..functions import vectors

    per_type = vectors.mean_by(typed, [owner, "doc_type"], vector)
    return vectors.mean_by(per_type, [owner], "vector")


def document_text(parts: list[Column], most: int = 2000) -> Column:
    """Non-empty parts joined by ". ", cut at ``most`` characters."""
    return F.substring(F.array_join(F.filter(F.array(*parts), lambda p: p != ""), ". "), 1, most)


def listed(values: Column, most: int = 10) -> Column:
    """The first distinct values, joined by ", "."""
    return F.array_join(F.slice(F.array_distinct(values), 1, most), ", ")
