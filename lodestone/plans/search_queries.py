"""Search, reports and entity queries over the logical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import companies, entities, reports, scoring, search
from .fixtures import Tables
from .registry import query

TERM = "widget"
_HAS = "list_contains(string_split(lower(name), ' '), '{}')"


def _dated(t: Tables) -> DataFrame:
    return t.mentions.join(t.docs, "doc_id")


def _lexed(t: Tables) -> DataFrame:
    return t.mentions.withColumn("search", text.lexemes(F.col("name")))


@query(
    "RPT-18 RPT-14 AGG-24 TXT-03 AGG-01 FN-08",
    """WITH hit AS (SELECT DISTINCT doc_id FROM mentions WHERE list_contains(string_split(lower(name), ' '), 'widget')),
    n AS (SELECT category_rollup AS x, CAST(year(doc_date) AS BIGINT) AS y, count(DISTINCT doc_id) AS c
          FROM mentions JOIN hit USING (doc_id) JOIN docs USING (doc_id) GROUP BY 1, 2)
    SELECT a.x, b.y, CAST(coalesce(n.c, 0) AS BIGINT) AS count FROM (SELECT DISTINCT x FROM n) a CROSS JOIN (SELECT DISTINCT y FROM n) b LEFT JOIN n ON n.x = a.x AND n.y = b.y""",
)
def time_report_gapfill(t: Tables) -> DataFrame:
    hits = search.doc_ids_for_terms(_lexed(t), [TERM])
    return reports.gap_filled(reports.counts(_dated(t).join(hits, "doc_id", "left_semi"), "category_rollup", "year", distinct="doc_id"))


@query(
    "RPT-13 RPT-19 AGG-01 JOIN-05",
    """SELECT m.category_rollup AS x, CAST(year(doc_date) AS BIGINT) AS y, count(*) AS count FROM mentions m JOIN mentions h ON h.doc_id = m.doc_id
    JOIN docs d ON d.doc_id = m.doc_id WHERE list_contains(string_split(lower(h.name), ' '), 'widget') GROUP BY 1, 2""",
)
def xy_report_mentions(t: Tables) -> DataFrame:
    matching = _lexed(t).filter(text.matches_all(F.col("search"), TERM)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_hits"))
    rows = _dated(t).join(matching, "doc_id")
    x, y = reports.DIMENSIONS["category_rollup"](), reports.DIMENSIONS["year"]()
    return rows.groupBy(x.alias("x"), y.alias("y")).agg(F.sum("_hits").alias("count"))


@query(
    "RPT-13 RPT-16 AGG-02",
    """WITH hit AS (SELECT DISTINCT doc_id FROM mentions WHERE list_contains(string_split(lower(name), ' '), 'widget'))
    SELECT instance_rollup AS x, doc_type AS y, count(DISTINCT doc_id) AS count FROM mentions JOIN hit USING (doc_id) JOIN docs USING (doc_id) GROUP BY 1, 2""",
)
def xy_report_docs(t: Tables) -> DataFrame:
    hits = search.doc_ids_for_terms(_lexed(t), [TERM])
    return reports.counts(_dated(t).join(hits, "doc_id", "left_semi"), "instance_rollup", "doc_type", distinct="doc_id")


@query(
    "RPT-14 RPT-13",
    """WITH n AS (SELECT category_rollup AS x, doc_type AS y FROM mentions JOIN docs USING (doc_id))
    SELECT x, count(*) FILTER (WHERE y = 'patent') AS patent, count(*) FILTER (WHERE y = 'regulatory_approval') AS regulatory_approval, count(*) FILTER (WHERE y = 'trial') AS trial FROM n GROUP BY x""",
)
def xy_report_pivot(t: Tables) -> DataFrame:
    return reports.pivoted(reports.counts(_dated(t), "category_rollup", "doc_type"), ["patent", "regulatory_approval", "trial"])


@query(
    "RPT-15 RPT-17 FLT-11",
    """SELECT domain AS report, category_rollup AS x, count(DISTINCT doc_id) AS count FROM mentions WHERE domain IN ('MECHANISM', 'COMPOUND', 'BIOLOGIC', 'DISEASE') GROUP BY 1, 2
    UNION ALL SELECT 'OWNER', category_rollup, count(DISTINCT doc_id) FROM ownables GROUP BY 2""",
)
def summary_by_domain(t: Tables) -> DataFrame:
    rows = t.mentions.select("doc_id", "category_rollup", "domain").unionByName(t.ownables.select("doc_id", "category_rollup", F.lit("OWNER").alias("domain")))
    names = ["MECHANISM", "COMPOUND", "BIOLOGIC", "DISEASE", "OWNER"]
    return rows.filter(F.col("domain").isin(names)).groupBy(F.col("domain").alias("report"), F.col("category_rollup").alias("x")).agg(F.countDistinct("doc_id").alias("count"))


@query(
    "TOP-03 RPT-18",
    """WITH n AS (SELECT name AS x, CAST(year(doc_date) AS BIGINT) AS y, count(*) AS count FROM mentions JOIN docs USING (doc_id) GROUP BY 1, 2),
    best AS (SELECT x FROM n GROUP BY x ORDER BY sum(count) DESC, x LIMIT 10) SELECT n.* FROM n JOIN best USING (x)""",
)
def time_report_top_names(t: Tables) -> DataFrame:
    return reports.top_of(reports.counts(_dated(t), "canonical_name", "year"), "x", 10)


@query("RPT-02 TXT-02 FLT-18", f"SELECT DISTINCT doc_id FROM mentions WHERE {_HAS.format('widget')} AND {_HAS.format('red')}")
def term_search_and(t: Tables) -> DataFrame:
    return search.doc_ids_for_terms(_lexed(t), ["widget", "red"], "AND")


@query("RPT-02 TXT-02", f"SELECT DISTINCT doc_id FROM mentions WHERE ({_HAS.format('widget')} AND {_HAS.format('red')}) OR {_HAS.format('blue')}")
def term_search_or(t: Tables) -> DataFrame:
    return search.doc_ids_for_terms(_lexed(t), ["red widget", "blue"], "OR")


@query(
    "RPT-02 TXT-02",
    f"SELECT doc_id FROM mentions GROUP BY doc_id HAVING bool_or({_HAS.format('widget')}) AND bool_or({_HAS.format('blue')})",
)
def term_search_doc_scope(t: Tables) -> DataFrame:
    return search.doc_ids_for_terms(_lexed(t), ["widget", "blue"], "AND", scope="doc")


@query(
    "RPT-04 FLT-04 FLT-05 RPT-05 RPT-06 RPT-07",
    f"""SELECT doc_id, doc_type FROM docs WHERE doc_date >= TIMESTAMP '1996-01-01' AND doc_date <= TIMESTAMP '1999-01-01' AND doc_id IN (SELECT doc_id FROM mentions WHERE {_HAS.format("widget")})""",
)
def matching_in_years(t: Tables) -> DataFrame:
    hits = search.doc_ids_for_terms(_lexed(t), [TERM])
    return search.matching_docs(t.docs, term_ids=hits, start_year=1996, end_year=1999).select("doc_id", "doc_type")


@query("FLT-06 FLT-02", "SELECT doc_id, doc_type, title FROM docs WHERE doc_id IN (1, 2, 3, 100, 500)")
def id_search(t: Tables) -> DataFrame:
    return search.by_ids(t.docs, [1, 2, 3, 100, 500]).select("doc_id", "doc_type", "title")


@query("TOP-02 RPT-05", "SELECT doc_id, doc_date FROM docs WHERE doc_type = 'patent' ORDER BY doc_date DESC NULLS FIRST, doc_id LIMIT 100")
def newest_patents(t: Tables) -> DataFrame:
    return search.newest_first(t.docs.filter("doc_type = 'patent'"), 100).select("doc_id", "doc_date")


@query(
    "RPT-01 SET-02 SRC-21 TXT-01",
    """SELECT 'intervention' AS kind, doc_type, CASE WHEN doc_type = 'patent' THEN doc_id END AS patent_id, entity_id, name, array_to_string(list_sort(list_distinct(string_split(lower(name), ' '))), ',') AS words
    FROM mentions JOIN docs USING (doc_id)
    UNION ALL SELECT 'owner', doc_type, CASE WHEN doc_type = 'patent' THEN doc_id END, owner_id, name, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> ''))), ',')
    FROM ownables JOIN docs USING (doc_id) WHERE owner_type <> 'OTHER'""",
)
def search_view(t: Tables) -> DataFrame:
    docs = t.docs.select("doc_id", "doc_type")
    drugs = t.mentions.join(docs, "doc_id")
    owned = t.ownables.withColumnRenamed("owner_id", "entity_id").withColumnRenamed("owner_type", "domain").join(docs, "doc_id")
    view = search.search_view([("intervention", drugs), ("owner", owned)])
    return view.select("kind", "doc_type", "patent_id", "entity_id", "name", F.array_join(F.array_sort(F.array_distinct(text.tokens(F.col("name")))), ",").alias("words"))


@query(
    "RPT-11 AGG-03 AGG-04 TOP-06 AGG-16",
    """WITH k AS (SELECT category_rollup, instance_rollup, count(DISTINCT doc_id) AS n FROM mentions GROUP BY 1, 2),
    w AS (SELECT category_rollup, count(DISTINCT doc_id) AS record_count FROM mentions GROUP BY 1)
    SELECT w.category_rollup, record_count, string_agg(instance_rollup || ':' || n, ',' ORDER BY n DESC, instance_rollup) AS children FROM w JOIN k USING (category_rollup) GROUP BY 1, 2""",
)
def entity_two_level(t: Tables) -> DataFrame:
    out = entities.two_level(t.mentions)
    return out.select("category_rollup", "record_count", F.array_join(F.transform("children", lambda c: F.concat(c["name"], F.lit(":"), c["count"].cast("string"))), ",").alias("children"))


@query(
    "RPT-12 AGG-05 AGG-20 AGG-22 AGG-07",
    """WITH m AS (SELECT DISTINCT instance_rollup, doc_id, doc_type, doc_date, investment FROM mentions JOIN docs USING (doc_id)),
    s AS (SELECT instance_rollup, count(*) FILTER (WHERE doc_type = 'patent') AS patent_count, count(*) FILTER (WHERE doc_type = 'trial') AS trial_count,
      count(*) FILTER (WHERE doc_type = 'regulatory_approval') AS regulatory_approval_count, count(*) AS record_count, max(doc_date) FILTER (WHERE doc_type = 'patent') AS last_patent_date,
      CAST(sum(CAST(investment AS DECIMAL(20, 4))) AS DOUBLE) AS investment FROM m GROUP BY 1),
    r AS (SELECT instance_rollup, doc_id AS most_recent_trial, row_number() OVER (PARTITION BY instance_rollup ORDER BY doc_date DESC, doc_id DESC) AS k FROM m WHERE doc_type = 'trial')
    SELECT s.*, most_recent_trial, regulatory_approval_count > 0 AS is_approved,
      CASE WHEN investment > 5000 THEN 'VERY HIGH' WHEN investment > 1000 THEN 'HIGH' WHEN investment > 500 THEN 'MEDIUM' ELSE 'LOW' END AS investment_level
    FROM s LEFT JOIN r ON r.instance_rollup = s.instance_rollup AND k = 1""",
)
def entity_summary(t: Tables) -> DataFrame:
    return entities.summary(_dated(t), ["instance_rollup"])


@query(
    "AGG-17 TOP-06",
    """WITH n AS (SELECT category_rollup, name, count(*) AS count FROM mentions GROUP BY 1, 2)
    SELECT category_rollup, name, count FROM n QUALIFY row_number() OVER (PARTITION BY category_rollup ORDER BY count DESC, name) <= 10""",
)
def top_names_per_category(t: Tables) -> DataFrame:
    return entities.top_values(t.mentions, ["category_rollup"], "name")


@query(
    "AGG-18 AGG-19 AGG-21 FN-15",
    """SELECT title, coalesce(CAST(sum(dropout_count) FILTER (WHERE enrollment > 0 AND dropout_count < enrollment) AS DOUBLE) / CAST(sum(enrollment) FILTER (WHERE enrollment > 0 AND dropout_count < enrollment) AS DOUBLE), 0.0) AS dropout_ratio,
      coalesce(CAST(round_even(avg(enrollment), 0) AS BIGINT), 0) AS mean_enrollment, coalesce(CAST(round_even(avg(CAST(CAST(end_date AS DATE) - CAST(start_date AS DATE) AS BIGINT)), 0) AS BIGINT), 0) AS mean_duration,
      avg(CASE WHEN dropout_count > 50 THEN 1 ELSE 0 END) AS high_dropout_share FROM trials GROUP BY title""",
)
def trial_metrics(t: Tables) -> DataFrame:
    days = dates.duration_days(F.col("start_date"), F.col("end_date"), "2002-01-01")
    return t.trials.groupBy("title").agg(
        entities.dropout_ratio(F.col("dropout_count"), F.col("enrollment")).alias("dropout_ratio"),
        entities.rounded_mean(F.col("enrollment")).alias("mean_enrollment"),
        entities.rounded_mean(days).alias("mean_duration"),
        entities.share_of(F.col("dropout_count") > 50).alias("high_dropout_share"),
    )


@query(
    "AGG-23 FN-30 CLS-06",
    """WITH p AS (SELECT category_rollup, CASE title WHEN '1-URGENT' THEN 'PHASE_1' WHEN '2-HIGH' THEN 'PHASE_2' WHEN '3-MEDIUM' THEN 'PHASE_3' ELSE 'PHASE_4' END AS phase,
      CASE WHEN doc_type = 'regulatory_approval' AND investment > 480000 THEN 1 ELSE 0 END AS approved, CASE WHEN doc_type = 'trial' THEN 1 ELSE 0 END AS tried FROM mentions JOIN docs USING (doc_id))
    SELECT category_rollup, CASE WHEN max(approved) > 0 THEN 'APPROVED' WHEN max(tried) = 0 THEN 'PRECLINICAL'
      WHEN max(CASE phase WHEN 'PHASE_1' THEN 1 WHEN 'PHASE_2' THEN 2 WHEN 'PHASE_3' THEN 3 ELSE -1 END) = 3 THEN 'PHASE_3' ELSE 'OTHER' END AS max_phase FROM p GROUP BY 1""",
)
def max_phase(t: Tables) -> DataFrame:
    phase = F.when(F.col("title") == "1-URGENT", "PHASE_1").when(F.col("title") == "2-HIGH", "PHASE_2").when(F.col("title") == "3-MEDIUM", "PHASE_3").otherwise("PHASE_4")
    rows = _dated(t).select("category_rollup", phase.alias("phase"), ((F.col("doc_type") == "regulatory_approval") & (F.col("investment") > 480000)).cast("int").alias("approved"), (F.col("doc_type") == "trial").cast("int").alias("tried"))
    return rows.groupBy("category_rollup").agg(entities.max_phase(F.col("phase"), F.col("approved"), F.col("tried")).alias("max_phase"))


@query(
    "AGG-24 AGG-26",
    """WITH n AS (SELECT category_rollup, CAST(year(doc_date) AS BIGINT) AS year, count(*) AS count, count(*) FILTER (WHERE doc_type = 'patent') AS patent, count(*) FILTER (WHERE doc_type = 'trial') AS trial,
      count(*) FILTER (WHERE doc_type = 'regulatory_approval') AS regulatory_approval FROM mentions JOIN docs USING (doc_id) GROUP BY 1, 2),
    s AS (SELECT category_rollup, CAST(unnest(range(1993, 2004)) AS BIGINT) AS year FROM (SELECT DISTINCT category_rollup FROM mentions))
    SELECT s.category_rollup, s.year, coalesce(count, 0) AS count, coalesce(patent, 0) AS patent, coalesce(trial, 0) AS trial, coalesce(regulatory_approval, 0) AS regulatory_approval FROM s LEFT JOIN n USING (category_rollup, year)""",
)
def activity_histogram(t: Tables) -> DataFrame:
    return entities.activity(_dated(t), ["category_rollup"], 1993, 2003, by_type=True)


@query(
    "AGG-25",
    """SELECT CAST(y AS BIGINT) AS year, count(*) AS count FROM (SELECT unnest(range(year(start_date), year(end_date))) AS y FROM trials WHERE year(start_date) < year(end_date)) GROUP BY 1""",
)
def trial_active_years(t: Tables) -> DataFrame:
    return entities.active_years(t.trials)


@query(
    "RPT-20 JOIN-04 TOP-04 AGG-02 JOIN-19",
    """WITH hit AS (SELECT DISTINCT doc_id FROM mentions WHERE list_contains(string_split(lower(name), ' '), 'widget')),
    p AS (SELECT h.category_rollup AS head, o.instance_rollup AS tail, count(DISTINCT h.doc_id) AS count FROM hit JOIN mentions h USING (doc_id) JOIN ownables o ON o.doc_id = hit.doc_id GROUP BY 1, 2),
    bh AS (SELECT head FROM p GROUP BY 1 ORDER BY count(*) DESC, head LIMIT 4), bt AS (SELECT tail FROM p GROUP BY 1 ORDER BY count(*) DESC, tail LIMIT 12)
    SELECT p.* FROM p JOIN bh USING (head) JOIN bt USING (tail)""",
)
def characteristics_graph(t: Tables) -> DataFrame:
    hits = search.doc_ids_for_terms(_lexed(t), [TERM])
    return reports.characteristics(hits, t.mentions, t.ownables, "category_rollup", "instance_rollup", 4, 12)


@query(
    "RPT-21 JOIN-01",
    """WITH edge AS (SELECT p_brand AS head_id, p_type AS tail_id FROM part GROUP BY 1, 2), x AS (
      SELECT instance_rollup AS head, name AS tail, doc_id FROM mentions UNION SELECT m.instance_rollup, e.tail_id, m.doc_id FROM mentions m JOIN edge e ON e.head_id = m.instance_rollup),
    p AS (SELECT head, tail, count(DISTINCT doc_id) AS count FROM x GROUP BY 1, 2), bh AS (SELECT head FROM p GROUP BY 1 ORDER BY count(*) DESC, head LIMIT 15),
    bt AS (SELECT tail FROM p GROUP BY 1 ORDER BY count(*) DESC, tail LIMIT 30) SELECT p.* FROM p JOIN bh USING (head) JOIN bt USING (tail)""",
)
def concept_relations(t: Tables) -> DataFrame:
    edges = t.part.select(F.col("p_brand").alias("instance_rollup"), F.col("p_type").alias("graph_tail")).distinct()
    tails = t.mentions.select("doc_id", F.col("name").alias("tail"), F.col("instance_rollup").alias("own"))
    linked = t.mentions.join(edges, "instance_rollup").select("doc_id", F.col("graph_tail").alias("tail"), F.col("instance_rollup").alias("own"))
    pairs = tails.union(linked).distinct().groupBy(F.col("own").alias("head"), "tail").agg(F.countDistinct("doc_id").alias("count"))
    best = lambda axis, n: pairs.groupBy(axis).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), axis).limit(n).select(axis)
    return pairs.join(best("head", 15), "head", "left_semi").join(best("tail", 30), "tail", "left_semi")


@query(
    "TXT-06 SET-03 TOP-05 TXT-07 API-05",
    """WITH e AS (SELECT p_name AS id, p_name AS name, count(*) AS count FROM part GROUP BY 1, 2), o AS (SELECT s_name AS id, s_name AS name, count(*) AS count FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2)
    SELECT 'e' || id AS id, 'entity' AS type, CAST(count AS BIGINT) AS count, name || ' (' || count || ')' AS label FROM e WHERE list_contains(string_split(lower(name), ' '), 'red')
    UNION SELECT 'o' || id, 'owner', count, name || ' (' || count || ')' FROM o WHERE list_contains(regexp_split_to_array(lower(name), '[^a-z0-9]+'), 'red') ORDER BY count DESC, label, id LIMIT 25""",
)
def autocomplete(t: Tables) -> DataFrame:
    e = t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("count")).select(F.col("p_name").alias("id"), F.col("p_name").alias("name"), "count")
    o = t.supplier.join(t.lineitem, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_name").agg(F.count(F.lit(1)).alias("count")).select(F.col("s_name").alias("id"), F.col("s_name").alias("name"), "count")
    return search.autocomplete([(e, "entity", "e"), (o, "owner", "o")], "red")


@query(
    "TXT-05 FN-27 NLP-16",
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT unnest(['red widgett', 'blu gadget', 'small']) AS term),
    g(s, t) AS (SELECT DISTINCT s, substr('  ' || w || ' ', i, 3) FROM (SELECT s, w, unnest(range(1, length(w) + 2)) AS i FROM (SELECT s, unnest(list_filter(regexp_split_to_array(lower(s), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM (SELECT name AS s FROM n UNION SELECT term FROM q)))),
    c AS (SELECT s, count(*) AS k FROM g GROUP BY 1),
    p AS (SELECT q.term, n.name, count(*) AS k FROM q JOIN g a ON a.s = q.term JOIN g b ON b.t = a.t JOIN n ON n.name = b.s GROUP BY 1, 2)
    SELECT term, name AS id, name, round(CAST(p.k AS DOUBLE) / (x.k + y.k - p.k), 6) AS similarity FROM p JOIN c x ON x.s = p.term JOIN c y ON y.s = p.name WHERE CAST(p.k AS DOUBLE) / (x.k + y.k - p.k) >= 0.3""",
)
def trigram_similarity(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("id"), F.col("p_name").alias("name")).distinct()
    terms = t.spark.createDataFrame([("red widgett",), ("blu gadget",), ("small",)], "term string")
    return search.trigram_matches(names, terms).withColumn("similarity", F.round("similarity", 6))


@query("FLT-16", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 200")
def keyset_page(t: Tables) -> DataFrame:
    return search.keyset_page(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 200)


@query("TOP-10 SRC-17", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100", views=False)
def offset_page(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").orderBy("o_orderkey").offset(100).limit(50)


_SUITABLE = """CASE WHEN s < 0 THEN 0.0 ELSE (s + 26.0) / 33.0 END"""


@query(
    "RPT-08 FN-16 JOIN-20 JOIN-21 RPT-09",
    f"""WITH a AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 3.0 WHEN 1 THEN -3.0 WHEN 2 THEN 1.5 ELSE 1.0 END + CASE p_size % 3 WHEN 0 THEN -1.0 WHEN 1 THEN 1.0 ELSE 0.0 END AS s,
      greatest(least(20 - (2015 - (1995 + p_size % 30)), 20), 0) AS y, CASE WHEN p_brand = 'Brand#11' THEN 0.15 ELSE 0.0 END AS v FROM part)
    SELECT p_partkey, CAST(y AS BIGINT) AS patent_years, round({_SUITABLE}, 6) AS suitability_score, round(({_SUITABLE}) * y / 20 + v, 6) AS score FROM a""",
)
def suitability_score(t: Tables) -> DataFrame:
    size = F.col("p_size")
    first = F.when(size % 4 == 0, "COMPOUND_OR_MECHANISM").when(size % 4 == 1, "DEVICE").when(size % 4 == 2, "novel").otherwise("TREATMENT")
    second = F.when(size % 3 == 0, "METHOD").when(size % 3 == 1, "TREATMENT").otherwise("unheard of")
    date = F.make_timestamp_ntz(1995 + size % 30, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    rows = t.part.select("p_partkey", F.array(first, second).alias("attributes"), date.alias("doc_date"), scoring.availability(F.array("p_brand"), F.array(F.lit("Brand#11"))).alias("availability"))
    out = scoring.scored(rows, 2015)
    return out.select("p_partkey", "patent_years", F.round("suitability_score", 6).alias("suitability_score"), F.round("score", 6).alias("score"))


def _query_vector(t: Tables) -> list[float]:
    return t.embeddings.filter("vec_id = 0").first()["embedding"]


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


@query("VEC-01 TOP-01", f"SELECT vec_id, round({_COS}, 6) AS similarity FROM embeddings e ORDER BY {_COS} DESC, vec_id LIMIT 20", views=False)
def vector_topk(t: Tables) -> DataFrame:
    from ..functions import vectors

    return vectors.nearest(t.embeddings, "embedding", _query_vector(t), 20, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("VEC-02 RPT-03", f"SELECT vec_id, round(s, 6) AS similarity FROM (SELECT vec_id, {_COS} AS s FROM embeddings e ORDER BY s DESC, vec_id LIMIT 100) WHERE s >= 0.25", views=False)
def vector_threshold(t: Tables) -> DataFrame:
    return search.description_matches(t.embeddings, "embedding", _query_vector(t), 100, 0.25, "vec_id").withColumn("similarity", F.round("similarity", 6))


_TOP = f"""v AS (SELECT vec_id AS doc_id, {_COS} AS s FROM embeddings e ORDER BY s DESC, vec_id LIMIT 200), r AS (SELECT v.doc_id, s, family_id, doc_type, doc_date FROM v JOIN docs d ON d.doc_id = v.doc_id)"""


def _relevant(t: Tables) -> DataFrame:
    vecs = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    from ..functions import vectors

    return vectors.nearest(vecs, "embedding", _query_vector(t), 200, "doc_id").select("doc_id", "similarity").join(t.docs, "doc_id")


@query("RPT-22 AGG-15", f"WITH {_TOP} SELECT max(doc_id) AS doc_id, round(avg(s), 6) AS similarity, count(*) AS family_size FROM r GROUP BY family_id")
def top_docs_family_dedup(t: Tables) -> DataFrame:
    docs = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    near = companies.top_docs(docs, "embedding", _query_vector(t), 200).select("doc_id", "similarity").join(t.docs, "doc_id")
    key = F.coalesce(F.col("family_id").cast("string"), F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return near.groupBy(key.alias("family")).agg(F.max("doc_id").alias("doc_id"), F.round(F.avg("similarity"), 6).alias("similarity"), F.count(F.lit(1)).alias("family_size")).drop("family")


@query("RPT-23 SET-01", f"WITH {_TOP} SELECT CAST(year(doc_date) AS BIGINT) AS year, doc_type, count(*) AS count, round(avg(s), 6) AS similarity FROM r GROUP BY 1, 2")
def top_docs_by_year(t: Tables) -> DataFrame:
    return _relevant(t).groupBy(dates.year_of(F.col("doc_date")).alias("year"), "doc_type").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("similarity"), 6).alias("similarity"))


@query(
    "RPT-28 RPT-23",
    """WITH c AS (SELECT vec_id AS concept, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id IN (1, 2, 3)),
    s AS (SELECT concept, vec_id AS doc_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS s FROM embeddings, c),
    k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY concept ORDER BY s DESC, doc_id) <= 50)
    SELECT concept, CAST(year(doc_date) AS BIGINT) AS year, count(*) AS count FROM k JOIN docs USING (doc_id) GROUP BY 1, 2""",
)
def concept_years(t: Tables) -> DataFrame:
    from functools import reduce

    from ..functions import vectors

    concepts = t.embeddings.filter(F.col("vec_id").isin(1, 2, 3)).collect()
    vecs = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    near = [vectors.nearest(vecs, "embedding", c["embedding"], 50, "doc_id").select(F.lit(c["vec_id"]).cast("long").alias("concept"), "doc_id") for c in concepts]
    return reduce(DataFrame.union, near).join(t.docs, "doc_id").groupBy("concept", dates.year_of(F.col("doc_date")).alias("year")).agg(F.count(F.lit(1)).alias("count"))


_COMPANY = f"""{_TOP}, q AS (SELECT owner_id, r.doc_id, s, CAST(year(doc_date) AS BIGINT) AS y FROM r JOIN ownables o ON o.doc_id = r.doc_id),
    c AS (SELECT owner_id, count(*) AS count, min(2024 - y) AS min_age, round(avg(2024 - y), 2) AS avg_age, round(CAST(sum(CAST(s AS DECIMAL(38, 12))) AS DOUBLE) / count(*), 4) AS relevance,
      round(CAST(sum(CAST(s * pow(greatest(0.0, (y - 1990) / 34.0), 2) AS DECIMAL(38, 12))) AS DOUBLE), 4) AS score FROM q GROUP BY 1),
    f AS (SELECT c.owner_id, name, count, min_age, avg_age, relevance, score, CASE WHEN balance > 4285 THEN 1 ELSE 0 END AS acquisition_count, balance > 4285 AS is_acquirer,
      owner_type IN ('INDUSTRY', 'INDUSTRY_LARGE') AS is_competition FROM c JOIN owners USING (owner_id))"""


def _companies(t: Tables) -> DataFrame:
    relevant = _relevant(t).join(t.ownables.select("doc_id", "owner_id"), "doc_id").select("owner_id", "doc_id", "similarity", "doc_date")
    bought = t.owners.filter("balance > 4285").select("owner_id", F.lit(1).alias("count"))
    return companies.company_metrics(relevant, t.owners, bought, 1990)


@query("RPT-24 RPT-25 JOIN-02 JOIN-03 FN-09 RPT-30", f"WITH {_COMPANY} SELECT owner_id, name, count, CAST(min_age AS BIGINT) AS min_age, avg_age, relevance, score, CAST(acquisition_count AS BIGINT) AS acquisition_count, is_acquirer, is_competition FROM f")
def company_finder(t: Tables) -> DataFrame:
    return _companies(t)


@query("RPT-27 AGG-30", f"WITH {_COMPANY} SELECT round(sum(CASE WHEN is_acquirer THEN CAST(score AS DECIMAL(38, 4)) END)::DOUBLE / sum(CAST(score AS DECIMAL(38, 4)))::DOUBLE, 4) AS exit_score, round(sum(CASE WHEN is_competition THEN CAST(score AS DECIMAL(38, 4)) END)::DOUBLE / sum(CAST(score AS DECIMAL(38, 4)))::DOUBLE, 4) AS competition_score FROM f")
def company_exit_scores(t: Tables) -> DataFrame:
    return companies.exit_scores(_companies(t))


@query(
    "RPT-26 JOIN-05",
    """WITH r AS (SELECT owner_id, doc_type, CAST(year(doc_date) AS BIGINT) AS year FROM ownables JOIN docs USING (doc_id)),
    a AS (SELECT * FROM r UNION ALL SELECT owner_id, 'all', year FROM r), k AS (SELECT DISTINCT owner_id, doc_type FROM a),
    s AS (SELECT *, CAST(unnest(range(1994, 2003)) AS BIGINT) AS year FROM k), n AS (SELECT owner_id, doc_type, year, count(*) AS c FROM a GROUP BY 1, 2, 3)
    SELECT s.owner_id, s.doc_type, s.year, coalesce(c, 0) AS count FROM s LEFT JOIN n USING (owner_id, doc_type, year)""",
)
def company_yearly(t: Tables) -> DataFrame:
    rows = t.ownables.join(t.docs, "doc_id").select("owner_id", "doc_type", dates.year_of(F.col("doc_date")).alias("year"))
    both = rows.union(rows.withColumn("doc_type", F.lit("all")))
    return reports.yearly(both, ["owner_id", "doc_type"], 1994, 2002)


@query(
    "JOIN-03 SET-01",
    """SELECT owner_id, doc_type, count(*) AS count FROM ownables JOIN docs USING (doc_id) GROUP BY 1, 2""",
)
def unpivoted_owner_join(t: Tables) -> DataFrame:
    kinds = list(search.ID_PATTERNS)
    typed = t.ownables.select("doc_id", "owner_id").join(t.docs.select("doc_id", "doc_type"), "doc_id")
    wide = typed.select("owner_id", *[F.when(F.col("doc_type") == k, F.col("doc_id")).alias(f"{k}_id") for k in kinds])
    return companies.unpivoted(wide, kinds, ["owner_id"]).join(t.docs.select("doc_id", "doc_type"), ["doc_type", "doc_id"]).groupBy("owner_id", "doc_type").agg(F.count(F.lit(1)).alias("count"))


@query(
    "EXT-02",
    """WITH f AS (SELECT s_suppkey, s_acctbal AS market_cap, round(sum(CAST(l_tax * l_extendedprice AS DECIMAL(20, 4)))::DOUBLE, 2) AS total_debt FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2)
    SELECT s_suppkey, market_cap < -(total_debt - 100000) OR (market_cap <> 0 AND total_debt / market_cap > 1.5) AS is_troubled FROM f""",
)
def troubled_owners(t: Tables) -> DataFrame:
    debt = t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum((F.col("l_tax") * F.col("l_extendedprice")).cast("decimal(20,4)")).cast("double"), 2).alias("total_debt"))
    rows = t.supplier.join(debt, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", F.col("s_acctbal").alias("market_cap"), F.col("s_acctbal").alias("equity"), "total_debt", F.lit(100000.0).alias("cash"), F.lit(None).cast("double").alias("net_income"), F.lit(None).cast("double").alias("current_assets"), F.lit(None).cast("double").alias("current_liabilities"))
    return companies.ratios(rows).select("s_suppkey", companies.is_troubled(rows).alias("is_troubled"))
