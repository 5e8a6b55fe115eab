"""The batch load: source selections of each document type, their records and child rows, ontology nodes, annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Weight of a publication of a patent's family, and of approvals that had priority or not.
PUBLICATION_WEIGHT, PRIORITY_WEIGHT, APPROVAL_WEIGHT = 10, 200, 30


def patent_records(patents: DataFrame, attributes: DataFrame, family: str = "family_id") -> DataFrame:
    """Patents with their distinct attributes as an array and investment = traction = 10 per publication of the family.

    ``attributes``: doc_id, attribute.  Both sides are aggregated before they are joined.
    """
    own = attributes.groupBy("doc_id").agg(F.array_sort(F.collect_set("attribute")).alias("attributes"))
    size = patents.filter(F.col(family).isNotNull()).groupBy(family).agg(F.countDistinct("doc_id").alias("_n"))
    out = patents.join(own, "doc_id", "left").join(size, family, "left")
    weight = (F.coalesce("_n", F.lit(1)) * PUBLICATION_WEIGHT).cast("long")
    return out.select("doc_id", family, F.coalesce("attributes", F.array().cast("array<string>")).alias("attributes"), weight.alias("investment"), weight.alias("traction"))


def owner_rows(patents: DataFrame, assignees: str, inventors: str) -> DataFrame:
    """(doc_id, name, role): one row per distinct assignee and inventor."""
    one = lambda c, role: patents.select("doc_id", F.explode(F.array_distinct(c)).alias("name")).withColumn("role", F.lit(role))
    return one(assignees, "assignee").unionByName(one(inventors, "inventor")).filter("name IS NOT NULL AND name <> ''")


def approval_records(approvals: DataFrame, labels: DataFrame) -> DataFrame:
    """(approval_id, indications, traction): labels are aggregated first, so that no join repeats an approval's weight."""
    found = labels.groupBy("approval_id").agg(F.array_sort(F.collect_set("indication")).alias("indications"))
    weight = F.when(F.col("is_priority"), PRIORITY_WEIGHT).otherwise(APPROVAL_WEIGHT).cast("long")
    once = approvals.groupBy("approval_id").agg(F.max(weight).alias("traction"))
    return once.join(found, "approval_id").select("approval_id", "indications", "traction")


def intervention_sources(sets: list[DataFrame]) -> DataFrame:
    """(name, source): of several sources of a name the last in the list counts."""
    rows = [df.select(F.lower("name").alias("name"), F.struct(F.lit(i).alias("i"), F.col("source").alias("s")).alias("_s")) for i, df in enumerate(sets)]
    return reduce(DataFrame.union, rows).groupBy("name").agg(F.max("_s")["s"].alias("source"))


def trial_source(trials: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Trials with an array per child table (name: (frame with doc_id, column)), each aggregated on doc_id before the join."""
    out = trials
    for name, (rows, column) in children.items():
        own = rows.groupBy("doc_id").agg(F.array_sort(F.collect_set(column)).alias(name))
        out = out.join(own, "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def child_rows(trials: DataFrame, column: str, name: str) -> DataFrame:
    return trials.select("doc_id", F.explode(column).alias(name))


def ontology_nodes(concepts: DataFrame, types: DataFrame, synonyms: DataFrame, wanted: list[str]) -> DataFrame:
    """(id, name, type_ids, synonyms) of concepts with a wanted type; all their types and distinct synonyms, sorted."""
    t = types.groupBy("id").agg(F.array_sort(F.collect_set("type_id")).alias("type_ids")).filter(F.arrays_overlap("type_ids", F.array(*map(F.lit, wanted))))
    s = synonyms.groupBy("id").agg(F.array_sort(F.collect_set(F.lower("term"))).alias("synonyms"))
    return concepts.join(t, "id").join(s, "id", "left").select("id", "name", "type_ids", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"))


def search_index(entities: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(entity_id, search): lexemes of the name and all synonyms, for entities that have any; others keep null."""
    terms = synonyms.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("_terms"))
    return entities.join(terms, "entity_id", "left").select("entity_id", F.when(F.col("_terms").isNotNull(), text.lexemes(F.col("name"), F.col("_terms"))).alias("search"))


def warehouse_subset(publications: DataFrame, codes: str, pattern: str, key: str, order: str, family: str) -> DataFrame:
    """One publication per key among those with a code that matches, with all ids of its family."""
    some = publications.filter(F.exists(codes, lambda c: c.rlike(pattern)))
    first = some.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_r = 1").drop("_r")
    members = publications.groupBy(family).agg(F.array_sort(F.collect_set(key)).alias("family_members"))
    return first.join(members, family)


def cleaned_annotations(annotations: DataFrame, removals: list[str], shortest: int = 3) -> DataFrame:
    """Terms cleaned by one pass of removals in order; what becomes too short goes."""
    out = F.col("term")
    for pattern in removals:
        out = F.regexp_replace(out, pattern, "")
    return annotations.withColumn("term", text.squeeze(out)).filter(F.length("term") >= shortest)


def span_offsets(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): character offsets (start, end, term) of each document's terms, and the offsets of its words, sorted.

    Every occurrence counts; ``terms``: doc_id, term.
    """
    pairs = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("_t")).join(terms.select("doc_id", F.lower("term").alias("term")).filter("term <> ''"), "doc_id")
    pieces = F.split(F.col("_t"), F.concat(F.lit("\\Q"), F.col("term"), F.lit("\\E")), -1)
    starts = text.let(pieces, lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), lambda piece, i: F.aggregate(F.slice(p, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + i * F.length("term")))
    spans = pairs.select("doc_id", "term", F.explode(starts).alias("start")).select("doc_id", F.struct("start", (F.col("start") + F.length("term")).alias("end"), "term").alias("span"))
    return spans.groupBy("doc_id").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def composite_selection(candidates: DataFrame, key: str = "term", cutoff: float = 0.0) -> DataFrame:
    """(term, members): candidates over word positions chosen greedily, longest first, then best score; no word is used twice.

    ``candidates``: key, start, length, candidate_id, score.  A fold over each term's sorted candidates, which are few.
    """
    best = F.struct((-F.col("length")).alias("l"), (-F.col("score")).alias("s"), F.col("start"), F.col("length"), F.col("candidate_id"))
    own = candidates.filter(F.col("score") >= cutoff).groupBy(key).agg(F.array_sort(F.collect_list(best)).alias("_c"))
    none = F.filter("_c", lambda c: F.lit(False))

    def step(taken, c):
        clash = F.exists(taken, lambda t: (t["start"] < c["start"] + c["length"]) & (c["start"] < t["start"] + t["length"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(c)))

    return own.select(key, F.transform(F.array_sort(F.transform(F.aggregate("_c", none, step), lambda c: F.struct(c["start"].alias("start"), c["candidate_id"].alias("id")))), lambda c: c["id"]).alias("members"))


def hashed_vectors(docs: DataFrame, text_col: str, size: int = 64, name: str = "vector") -> DataFrame:
    """Adds a deterministic text vector: counts of words by hash, signed, of unit length; zero for an empty text."""
    words = text.tokens(F.coalesce(F.col(text_col), F.lit("")))

    def build(w):
        slots = F.transform(w, lambda x: F.struct(F.pmod(F.xxhash64(x), F.lit(size)).cast("int").alias("i"), F.when(F.pmod(F.xxhash64(x, F.lit("sign")), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("v")))
        return text.let(slots, lambda s: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(s, lambda e: e["i"] == i), F.lit(0.0), lambda a, e: a + e["v"])))

    raw = text.let(words, build)

    def scaled(v):
        return text.let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    return docs.withColumn(name, text.let(raw, scaled))


#: Pieces of systematic chemical names; a name has two of them, or one with a locant.
CHEMICAL_PARTS = "meth|eth|prop|but|pent|hex|hept|oct|phen|benz|chlor|fluor|brom|iod|hydrox|amin|nitr|oxo|thi|pyrid|pyrrol|imidaz|indol|carb|acet|sulf|phosph|piper|morphol|ylidene|azole|idine|amide|oate|olate|anoic"


def is_chemical_name(name):
    """Two chemical pieces or more, and a locant such as 2- or N- or a bracket, in one token."""
    parts = F.size(F.regexp_extract_all(F.lower(name), F.lit(f"({CHEMICAL_PARTS})"), 1))
    return F.coalesce((parts >= 2) & name.rlike(r"(?:^|[-(\[,])(?:\d+[a-z]?(?:,\d+)*|[NOSRE])-|[\])]-"), F.lit(False))
