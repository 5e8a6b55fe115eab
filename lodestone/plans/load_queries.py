"""Queries of the batch load and of whole requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import api
from ..functions import text
from ..operators import loads
from .fixtures import Tables
from .registry import query


@query(
    "ETL-02 ETL-03 MISC-04 ETL-10",
    """WITH p AS (SELECT * FROM docs WHERE doc_type = 'patent'), a AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT domain)), ',') AS attributes FROM mentions GROUP BY 1), f AS (SELECT family_id, count(DISTINCT doc_id) AS n FROM p GROUP BY 1)
    SELECT p.doc_id, coalesce(attributes, '') AS attributes, 10 * n AS investment FROM p LEFT JOIN a USING (doc_id) JOIN f USING (family_id)""",
)
def patent_records(t: Tables) -> DataFrame:
    out = loads.patent_records(t.docs.filter("doc_type = 'patent'"), t.mentions.select("doc_id", F.col("domain").alias("attribute")))
    return out.select("doc_id", F.array_join("attributes", ",").alias("attributes"), "investment")


@query("ETL-03 ETL-09", "SELECT DISTINCT o_orderkey AS doc_id, unnest([c_name, c_mktsegment]) AS name, unnest(['assignee', 'inventor']) AS role FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'", views=False)
def patent_owner_rows(t: Tables) -> DataFrame:
    rows = t.orders.filter("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return loads.owner_rows(rows.select(F.col("o_orderkey").alias("doc_id"), F.array("c_name", "c_name").alias("a"), F.array("c_mktsegment", F.lit("")).alias("i")), "a", "i")


@query(
    "ETL-05 JOIN-06 AGG-07",
    """SELECT o_orderkey AS approval_id, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS indications, CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 200 ELSE 30 END AS BIGINT) AS traction
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey, o_orderpriority""",
    views=False,
)
def approval_records(t: Tables) -> DataFrame:
    approvals = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("approval_id"), (F.col("o_orderpriority") == "1-URGENT").alias("is_priority"))
    labels = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("approval_id"), F.col("p_type").alias("indication"))
    return loads.approval_records(approvals, labels).withColumn("indications", F.array_join("indications", ","))


@query("ETL-06", "SELECT lower(p_name) AS name, CASE WHEN bool_or(p_size > 40) THEN 'class' WHEN bool_or(p_size > 20) THEN 'combo' ELSE 'single' END AS source FROM part GROUP BY 1", views=False)
def intervention_sources(t: Tables) -> DataFrame:
    named = lambda condition, source: t.part.filter(condition).select(F.col("p_name").alias("name"), F.lit(source).alias("source"))
    return loads.intervention_sources([named("p_size > 0", "single"), named("p_size > 20", "combo"), named("p_size > 40", "class")])


@query(
    "ETL-07 JOIN-07",
    """WITH n AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT name)), ',') AS interventions FROM mentions GROUP BY 1), o AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT name)), ',') AS sponsors FROM ownables GROUP BY 1)
    SELECT doc_id, CAST(enrollment AS BIGINT) AS enrollment, coalesce(interventions, '') AS interventions, coalesce(sponsors, '') AS sponsors FROM trials LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)""",
)
def trial_source(t: Tables) -> DataFrame:
    out = loads.trial_source(t.trials.select("doc_id", "enrollment"), {"interventions": (t.mentions, "name"), "sponsors": (t.ownables, "name")})
    return out.select("doc_id", "enrollment", F.array_join("interventions", ",").alias("interventions"), F.array_join("sponsors", ",").alias("sponsors"))


@query(
    "ETL-15 ETL-16 MISC-35",
    """SELECT p_name AS id, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS type_ids, array_to_string(list_sort(list(DISTINCT lower(p_brand))), ',') AS synonyms FROM part GROUP BY 1 HAVING bool_or(p_type = 'PROMO')""",
    views=False,
)
def ontology_nodes(t: Tables) -> DataFrame:
    concepts = t.part.select(F.col("p_name").alias("id"), F.col("p_name").alias("name")).distinct()
    out = loads.ontology_nodes(concepts, t.part.select(F.col("p_name").alias("id"), F.col("p_type").alias("type_id")), t.part.select(F.col("p_name").alias("id"), F.col("p_brand").alias("term")), ["PROMO"])
    return out.select("id", F.array_join("type_ids", ",").alias("type_ids"), F.array_join("synonyms", ",").alias("synonyms"))


@query(
    "TXT-04",
    """SELECT p_partkey AS entity_id, CASE WHEN p_size > 25 THEN array_to_string(list_sort(list_distinct(list_concat(string_split(lower(p_name), ' '), ['extra']))), ',') END AS search FROM part""",
    views=False,
)
def entity_search_index(t: Tables) -> DataFrame:
    e = t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    out = loads.search_index(e, t.part.filter("p_size > 25").select(F.col("p_partkey").alias("entity_id"), F.lit("extra").alias("term")))
    return out.select("entity_id", F.when(F.col("search").isNotNull(), F.array_join(F.array_sort("search"), ",")).alias("search"))


@query(
    "ETL-21 MISC-03 FLT-17",
    """WITH s AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderstatus LIKE 'F%' GROUP BY 1), f AS (SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS family FROM orders GROUP BY 1) SELECT o_orderkey, o_custkey, family FROM s JOIN f USING (o_custkey)""",
    views=False,
)
def warehouse_subset(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", F.array("o_orderpriority", "o_orderstatus").alias("codes"))
    some = rows.filter(F.exists("codes", lambda c: c.rlike("^[1F]")))
    first = some.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    out = loads.warehouse_subset(rows, "codes", "^[1F]", "o_orderkey", "o_custkey", "o_custkey").join(first, ["o_orderkey", "o_custkey"], "left_semi")
    return out.select("o_orderkey", "o_custkey", F.array_join(F.col("family_members").cast("array<string>"), ",").alias("family"))


@query("ETL-22", r"SELECT p_partkey, trim(regexp_replace(p_name, '\b(?:red|blue)\b', '', 'g')) AS term FROM part WHERE length(trim(regexp_replace(p_name, '\b(?:red|blue)\b', '', 'g'))) >= 3", views=False)
def cleaned_annotations(t: Tables) -> DataFrame:
    return loads.cleaned_annotations(t.part.select("p_partkey", F.col("p_name").alias("term")), [r"\b(?:red|blue)\b"])


@query(
    "ETL-25 MISC-16",
    """SELECT p_partkey AS doc_id, CAST(strpos(s, w) - 1 AS INTEGER) AS start, CAST(strpos(s, w) - 1 + length(w) AS INTEGER) AS "end", w AS term FROM (SELECT p_partkey, lower(p_brand || ' ' || p_name) AS s, lower(string_split(p_name, ' ')[2]) AS w FROM part)""",
    views=False,
)
def span_offsets(t: Tables) -> DataFrame:
    docs = t.part.select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_brand", "p_name").alias("text"))
    terms = t.part.select(F.col("p_partkey").alias("doc_id"), F.element_at(F.split("p_name", " "), 2).alias("term"))
    return loads.span_offsets(docs, terms).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.term")


@query("NLP-19", "SELECT p_partkey AS term, CASE WHEN p_size > 25 THEN 'long' ELSE 'a,b' END AS members FROM part", views=False)
def composite_selection(t: Tables) -> DataFrame:
    long_score = F.when(F.col("p_size") > 25, 0.5).otherwise(0.0)
    c = F.array(*[F.struct(F.lit(i).alias("start"), F.lit(n).alias("length"), F.lit(k).alias("candidate_id"), s.alias("score")) for i, n, k, s in ((1, 1, "a", F.lit(0.9)), (2, 1, "b", F.lit(0.8)), (1, 2, "long", long_score), (2, 1, "c", F.lit(0.7)))])
    rows = t.part.select(F.col("p_partkey").alias("term"), F.explode(c).alias("x")).select("term", "x.*")
    return loads.composite_selection(rows, cutoff=0.1).withColumn("members", F.array_join("members", ","))


@query("VEC-12 VEC-14")
def hashed_text_vectors(t: Tables) -> DataFrame:
    return loads.hashed_vectors(t.benchmark, "text", 16).select("item_id", F.posexplode("vector").alias("i", "x"))


@query("CLS-16", "SELECT p_partkey, p_size % 2 = 0 AS chemical FROM part", views=False)
def chemical_names(t: Tables) -> DataFrame:
    name = F.when(F.col("p_size") % 2 == 0, "2-(4-chlorophenyl)-N-methylacetamide").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", loads.is_chemical_name(name).alias("chemical"))


def _engine(t: Tables) -> api.Engine:
    return api.Engine(
        docs=t.docs, mentions=t.mentions.withColumn("search", text.lexemes(F.col("name"))), ownables=t.ownables, owners=t.owners,
        acquisitions=t.owners.filter("balance > 4285").select("owner_id", F.lit(1).alias("count")), doc_vectors=t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")),
    )


_HIT = "hit AS (SELECT doc_id, doc_type, doc_date FROM docs WHERE doc_date >= TIMESTAMP '1996-01-01' AND doc_date <= TIMESTAMP '2001-01-01' AND doc_id IN (SELECT doc_id FROM mentions WHERE list_contains(string_split(lower(name), ' '), 'widget')))"
_SEARCH = api.Search(terms="widget;", start_year=1996, end_year=2001)


@query("API-01", f"WITH {_HIT} SELECT category_rollup, count(DISTINCT doc_id) AS record_count FROM mentions JOIN hit USING (doc_id) GROUP BY 1")
def request_entities(t: Tables) -> DataFrame:
    return _engine(t).entities(_SEARCH).select("category_rollup", "record_count")


@query("API-04 RPT-06", f"WITH {_HIT} SELECT doc_id, doc_date FROM hit WHERE doc_type = 'trial' ORDER BY doc_date DESC, doc_id LIMIT 2000")
def request_trials(t: Tables) -> DataFrame:
    return _engine(t).documents(_SEARCH, "trial").select("doc_id", "doc_date")


@query("API-06", f"WITH {_HIT} SELECT domain AS report, category_rollup AS x, count(DISTINCT doc_id) AS count FROM mentions JOIN hit USING (doc_id) GROUP BY 1, 2")
def request_summary(t: Tables) -> DataFrame:
    return _engine(t).summarize(_SEARCH)


@query("API-08", f"WITH {_HIT} SELECT category_rollup AS x, doc_type AS y, count(DISTINCT doc_id) AS count FROM mentions JOIN hit USING (doc_id) GROUP BY 1, 2")
def request_x_by_y(t: Tables) -> DataFrame:
    return _engine(t).x_by_y(_SEARCH, "category_rollup", "doc_type")


@query("API-02 RPT-05", f"WITH {_HIT} SELECT doc_id, doc_date FROM hit WHERE doc_type = 'patent' ORDER BY doc_date DESC, doc_id LIMIT 2000")
def request_patents(t: Tables) -> DataFrame:
    return _engine(t).documents(_SEARCH, "patent").select("doc_id", "doc_date")


@query("API-03 RPT-07", f"WITH {_HIT} SELECT doc_id, doc_date FROM hit WHERE doc_type = 'regulatory_approval' ORDER BY doc_date DESC, doc_id LIMIT 2000")
def request_approvals(t: Tables) -> DataFrame:
    return _engine(t).documents(_SEARCH, "regulatory_approval").select("doc_id", "doc_date")


@query("API-12")
def request_companies(t: Tables) -> DataFrame:
    q = t.embeddings.filter("vec_id = 0").first()["embedding"]
    return _engine(t).companies(q, 200, 1990)
