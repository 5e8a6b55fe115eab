"""Hierarchies, rules, linking, clusters, models, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import classify, clustering, etl, graph, linking, models, scoring
from ..sources import files, tables
from ..streaming import events as stream
from .fixtures import Tables
from .registry import query

# Hierarchies: supplier -> nation -> region as s:, n:, r: nodes ------------------------------------------------------

_EDGES = """(SELECT 's' || s_suppkey AS tail_id, 'n' || s_nationkey AS head_id FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def _edges(t: Tables) -> DataFrame:
    a = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("tail_id"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("head_id"))
    return a.union(t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("r"), F.col("n_regionkey"))))


@query(
    "GRA-01 JOIN-16 GRA-02",
    f"""WITH RECURSIVE e AS {_EDGES}, c(node, ancestor, depth) AS (SELECT tail_id, head_id, 1 FROM e JOIN supplier ON tail_id = 's' || s_suppkey WHERE s_acctbal > 0 UNION SELECT c.node, e.head_id, c.depth + 1 FROM c JOIN e ON e.tail_id = c.ancestor WHERE c.depth < 5)
    SELECT node, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY 1, 2""",
    views=False,
)
def ancestor_closure(t: Tables) -> DataFrame:
    """From suppliers with a balance, along two relationships; edges of a third aren't followed."""
    kind = F.when(F.col("tail_id").startswith("s"), "isa").otherwise("mapped_to")
    edges = _edges(t).withColumn("relationship", kind)
    noise = edges.select("tail_id", F.concat(F.lit("x"), "head_id").alias("head_id"), F.lit("process_involves_gene").alias("relationship"))
    seeds = t.supplier.filter("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"))
    return graph.ancestors(edges.union(noise), seeds, 5, graph.RELATIONSHIPS)


_COUNTS = "(SELECT 's' || l_suppkey AS node, count(*) AS n FROM lineitem GROUP BY 1)"


def _supplier_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.concat(F.lit("s"), F.col("l_suppkey")).alias("node")).agg(F.count(F.lit(1)).alias("count"))


@query(
    "GRA-04 MISC-10",
    f"""WITH RECURSIVE e AS {_EDGES}, k AS {_COUNTS}, c(node, below) AS (SELECT head_id, tail_id FROM e UNION SELECT e.head_id, c.below FROM c JOIN e ON e.tail_id = c.node),
    a AS (SELECT node, below FROM c UNION SELECT x, x FROM (SELECT head_id AS x FROM e UNION SELECT tail_id FROM e))
    SELECT a.node, CAST(coalesce(sum(k.n), 0) AS BIGINT) AS count FROM a LEFT JOIN k ON k.node = a.below GROUP BY 1""",
    views=False,
)
def descendant_counts(t: Tables) -> DataFrame:
    return graph.descendant_counts(_edges(t), _supplier_counts(t))


@query("GRA-03", "SELECT * FROM (VALUES ('e', 'd'), ('a', 'x')) v(head_id, tail_id)", views=False)
def cycle_free_edges(t: Tables) -> DataFrame:
    """A cycle a, b, c with an edge into it and out of it: only edges that touch no cycle on both sides stay."""
    rows = t.spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("e", "d"), ("a", "x")], "head_id string, tail_id string")
    return graph.without_cycles(rows)


@query("GRA-05 GRA-07 GRA-08 MISC-11")
def assigned_levels(t: Tables) -> DataFrame:
    """Path-dependent, so that only rows are compared; a test holds a small hierarchy against a walk of all paths."""
    return graph.assigned_levels(_edges(t), graph.descendant_counts(_edges(t), _supplier_counts(t)), [0.02, 0.1, 0.5, 0.9, 0.95])


@query(
    "GRA-06",
    """WITH e AS (SELECT DISTINCT p_name AS tail_id, p_type AS head_id FROM part UNION SELECT DISTINCT p_name, p_brand FROM part)
    SELECT tail_id AS node, min(head_id) AS rollup FROM e WHERE head_id LIKE 'Brand%' GROUP BY 1 UNION ALL SELECT DISTINCT p_type, p_type FROM part UNION ALL SELECT DISTINCT p_brand, p_brand FROM part""",
    views=False,
)
def chosen_rollups(t: Tables) -> DataFrame:
    p = t.part
    edges = p.select(F.col("p_name").alias("tail_id"), F.col("p_type").alias("head_id")).union(p.select("p_name", "p_brand")).distinct()
    node = lambda c, level, kind: p.select(F.col(c).alias("node"), F.lit(level).alias("level"), F.lit(kind).alias("type")).distinct()
    nodes = node("p_name", "INSTANCE", "name").union(node("p_type", "L2_CATEGORY", "type")).union(node("p_brand", "L1_CATEGORY", "brand"))
    scores = t.spark.createDataFrame([("name", "brand", 3), ("name", "type", 1)], "child_type string, ancestor_type string, score int")
    return graph.chosen_rollup(edges, nodes, scores)


@query(
    "GRA-09",
    """SELECT s_suppkey AS entity_id, s_name AS name, n_name AS instance_rollup, r_name AS category_rollup FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    views=False,
)
def rollup_two_hop(t: Tables) -> DataFrame:
    # Nations and regions get numbers beyond the suppliers'.
    a = t.supplier.select(F.col("s_suppkey").alias("child"), (F.col("s_nationkey") + 10_000_000).cast("long").alias("parent")).join(t.nation.select((F.col("n_nationkey") + 10_000_000).cast("long").alias("parent"), F.col("n_name").alias("parent_name")), "parent")
    b = t.nation.select((F.col("n_nationkey") + 10_000_000).cast("long").alias("child"), (F.col("n_regionkey") + 20_000_000).cast("long").alias("parent")).join(t.region.select((F.col("r_regionkey") + 20_000_000).cast("long").alias("parent"), F.col("r_name").alias("parent_name")), "parent")
    entities = t.supplier.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"))
    return graph.two_hop_rollup(entities, a.unionByName(b))


@query("GRA-12", "SELECT DISTINCT r_name AS head_id, n_name AS tail_id FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", views=False)
def lineage_edges(t: Tables) -> DataFrame:
    return graph.lineage_edges(t.owners.select(F.array("category_rollup", "instance_rollup", "name").alias("path")))


@query(
    "GRA-13 FN-12",
    """WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS g FROM part WHERE p_partkey > 100), n AS (SELECT p_partkey, lower(p_name) AS g FROM part WHERE p_partkey > 100)
    SELECT DISTINCT h AS head_id, CAST(p_partkey AS VARCHAR) AS tail_id FROM (SELECT * FROM w UNION SELECT * FROM n) JOIN (SELECT unnest(['red', 'widget', 'blue gadget']) AS g, unnest(['c1', 'c2', 'c3']) AS h) USING (g)""",
    views=False,
)
def ngram_overlap(t: Tables) -> DataFrame:
    children = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    parents = t.spark.createDataFrame([("c1", "red"), ("c2", "Widget"), ("c3", "blue gadget")], "id string, term string")
    known = t.part.filter("p_partkey <= 100").select(F.lit("c0").alias("head_id"), F.col("p_partkey").cast("string").alias("tail_id"))
    return graph.missing_edges(children, parents, known)


@query("GRA-14 AGG-08", "WITH l AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1) SELECT p_partkey AS id, min(k) AS keep FROM part JOIN l USING (p_name) WHERE p_partkey <> k GROUP BY 1", views=False)
def shared_synonyms(t: Tables) -> DataFrame:
    return graph.shared_synonyms(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("term")))


# Rules -------------------------------------------------------------------------------------------------------------


@query(
    "CLS-01 CLS-02 CLS-03 CLS-04",
    """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN p_name LIKE '%widget%' OR p_name LIKE '%gadget%' THEN 'DEVICE' END, CASE WHEN p_name LIKE 'red %' THEN 'COLOUR' END, CASE WHEN p_name = 'blue widget' THEN 'NOVEL' END,
      CASE WHEN NOT (p_name LIKE '%widget%' OR p_name LIKE '%gadget%' OR p_name LIKE 'red %') THEN 'IRRELEVANT' END], lambda x: x IS NOT NULL))), ',') AS classes FROM part""",
    views=False,
)
def ngram_classify(t: Tables) -> DataFrame:
    words = {"DEVICE": ["(widget|gadget)"], "COLOUR": ["red"], "NOVEL": ["blue widget"]}
    return classify.keyword_classes(t.part, "p_partkey", "p_name", words, "IRRELEVANT").withColumn("classes", F.array_join("classes", ","))


@query(
    "CLS-05 CLS-07 CLS-09",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'ENROLLMENT' ELSE 'UNKNOWN' END AS status, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'ONGOING' ELSE 'UNKNOWN' END AS status_group,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'DOSING' WHEN o_orderpriority = '2-HIGH' THEN 'SINGLE_GROUP' WHEN o_orderpriority = '3-MEDIUM' THEN 'PARALLEL' ELSE 'CROSSOVER' END AS design,
      CASE WHEN o_orderstatus = 'F' THEN 'PHARMACOLOGICAL' ELSE 'DEVICE' END AS intervention, CASE WHEN o_orderstatus = 'F' THEN 'MULTIPLE' ELSE 'SUPERIORITY' END AS hypothesis FROM orders""",
    views=False,
)
def trial_attributes(t: Tables) -> DataFrame:
    status = classify.mapped(F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Recruiting").otherwise("?"), classify.STATUSES)
    p, closed = F.col("o_orderpriority"), F.col("o_orderstatus") == "F"
    design = F.when(p.isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "Single Group Assignment").otherwise("Crossover Assignment")
    dosing = p == "1-URGENT"
    made = classify.trial_design(design, F.when(dosing, "A dose study").otherwise("A study"), F.when(dosing, "PHASE_1").otherwise("PHASE_2"), F.when(p == "3-MEDIUM", "RANDOMIZED").otherwise("NA"), F.lit("NONE"), F.lit("UNKNOWN"), F.lit(1))
    kinds = F.when(closed, F.array(F.lit("Device"), F.lit("Drug"))).otherwise(F.array(F.lit("Device")))
    claims = F.when(closed, F.array(F.lit("Superiority"), F.lit("Other"))).otherwise(F.array(F.lit("Superiority")))
    return t.orders.select("o_orderkey", status.alias("status"), classify.mapped(status, classify.STATUS_GROUPS).alias("status_group"), made.alias("design"), classify.intervention_type(kinds).alias("intervention"), classify.hypothesis_type(claims).alias("hypothesis"))


@query("CLS-10", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'PLACEBO' WHEN p_size % 4 = 1 THEN 'ACTIVE' WHEN p_size % 4 = 2 THEN 'STANDARD' ELSE 'NO_CONTROL' END AS comparison FROM part", views=False)
def comparison_types(t: Tables) -> DataFrame:
    kind = F.col("p_size") % 4
    arms = F.array(F.when(kind == 0, "Placebo Comparator").when(kind == 1, "Active Comparator").otherwise("Experimental"))
    names = F.array(F.when(kind == 2, "usual care").otherwise("a drug"))
    return t.part.select("p_partkey", classify.comparison_type(arms, names, names).alias("comparison"))


@query("CLS-11", "SELECT p_partkey, CAST(greatest(p_size * 7, 30) AS BIGINT) AS days FROM part", views=False)
def timeframes(t: Tables) -> DataFrame:
    words = F.concat(F.lit("Day 1 of Part A up to Week "), F.col("p_size").cast("string"), F.lit(" and one month after"))
    return t.part.select("p_partkey", classify.timeframe_days(words).alias("days"))


@query(
    "ETL-17",
    """SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9 ]', ' ', 'g')) AS canonical, CASE WHEN s_suppkey % 3 = 0 THEN 'UNIVERSITY' WHEN s_suppkey % 3 = 1 THEN 'INDUSTRY' ELSE 'OTHER' END AS owner_type FROM supplier""",
    views=False,
)
def owner_names_and_types(t: Tables) -> DataFrame:
    ending = F.when(F.col("s_suppkey") % 3 == 0, " University").when(F.col("s_suppkey") % 3 == 1, " Pharma Inc").otherwise("")
    rows = t.supplier.select("s_suppkey", "s_name", F.concat(F.col("s_name"), ending).alias("full_name"))
    types = classify.owner_type(rows, "s_suppkey", "full_name")
    name = etl.canonical_owner_name(F.concat(F.col("s_name"), F.lit(" Inc.")), ["inc", "ltd", "gmbh"], {})
    return rows.select("s_suppkey", name.alias("canonical")).join(types, "s_suppkey")


@query("CLS-13", "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'DISEASE' WHEN p_brand = 'Brand#11' THEN 'COMPOUND' ELSE 'UNKNOWN' END AS entity_type FROM part", views=False)
def semantic_types(t: Tables) -> DataFrame:
    known = {"Brand#11": "COMPOUND", "PROMO": "DISEASE"}
    return t.part.select("p_partkey", classify.first_known_type(F.array("p_brand", "p_type"), known, ["PROMO"]).alias("entity_type"))


@query("RPT-10", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'WO1' ELSE '' END AS similar FROM part", views=False)
def similar_world_patents(t: Tables) -> DataFrame:
    similar = F.array(F.lit("US7"), F.when(F.col("p_size") > 25, "WO1").otherwise("EP3"))
    return t.part.select("p_partkey", F.array_join(scoring.world_patents(similar), ",").alias("similar"))


# Linking -----------------------------------------------------------------------------------------------------------


@query(
    "NLP-22 NLP-18 ETL-14 ETL-11 MISC-06",
    "SELECT l_orderkey AS doc_id, p_name AS term, coalesce(CAST(k AS VARCHAR), lower(p_name)) AS canonical_id, coalesce(b, lower(p_name)) AS canonical_name FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT lower(p_name) AS t, min(p_partkey) AS k, arg_min(p_brand, p_partkey) AS b FROM part WHERE p_name LIKE '%widget%' GROUP BY 1) ON t = lower(p_name)",
    views=False,
)
def linked_mentions(t: Tables) -> DataFrame:
    mentions = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc_id"), F.col("p_name").alias("term"))
    canonical = t.part.filter("p_name LIKE '%widget%'").select(F.col("p_name").alias("term"), F.col("p_partkey").alias("canonical_id"), F.col("p_brand").alias("canonical_name"))
    return linking.linked(mentions, canonical)


@query("NLP-17 TOP-09 MISC-13 MISC-14", "WITH c AS (SELECT p_brand, p_partkey, round((p_size / 50.0 * 0.75 + p_retailprice / 2000.0 * 0.25) * CASE p_type WHEN 'PROMO' THEN 1.05 ELSE 0.7 END * CASE WHEN p_size >= 8 THEN 1.05 ELSE 1.0 END, 6) AS score FROM part) SELECT p_brand, p_partkey, score FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) = 1", views=False)
def best_candidates(t: Tables) -> DataFrame:
    weight = F.when(F.col("p_type") == "PROMO", 1.05)
    score = linking.candidate_score(F.col("p_size") / 50.0, F.col("p_retailprice") / 2000.0, weight, F.col("p_size"))
    return linking.best_candidates(t.part.select("p_brand", "p_partkey", F.round(score, 6).alias("score")), "p_brand", "score", "p_partkey")


@query("NLP-20 ETL-13 MISC-05", "SELECT l_orderkey AS entity_id, CAST(l_partkey AS VARCHAR) AS concept_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY 1, 2", views=False)
def composite_concepts(t: Tables) -> DataFrame:
    ids = t.lineitem.groupBy(F.col("l_orderkey").alias("entity_id")).agg(linking.composite_id(F.collect_list(F.col("l_partkey").cast("string"))).alias("canonical_id"))
    return linking.entity_to_concepts(ids, t.part.filter("p_size > 25").select(F.col("p_partkey").cast("string").alias("concept_id")))


@query(
    "NLP-13 NLP-15",
    r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
    t AS (SELECT DISTINCT w[1:n] AS tw FROM w, (SELECT unnest([3, 6]) AS n) WHERE len(w) > 0), d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT doc_id, w, CAST(unnest(range(1, len(w) + 1)) AS INTEGER) AS start FROM d), s AS (SELECT doc_id, start, CAST(len(tw) AS INTEGER) AS length, array_to_string(tw, ' ') AS term FROM p JOIN t ON w[start] = tw[1] WHERE w[start:start + len(tw) - 1] = tw)
    SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s AS o WHERE o.doc_id = s.doc_id AND o.start < s.start + s.length AND s.start < o.start + o.length AND (o.length > s.length OR (o.length = s.length AND o.start < s.start)))""",
    views=False,
)
def dictionary_entities(t: Tables) -> DataFrame:
    """Terms of three and of six words in whole texts, the longest at each place."""
    words = lambda n: t.benchmark.select(F.array_join(F.slice(text.tokens(F.col("text")), 1, n), " ").alias("term"))
    return linking.dictionary_entities(tables.spread(t.documents), words(3).union(words(6)).filter("term <> ''"))


@query("NLP-21 NLP-10 NLP-11", r"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([regexp_replace(p_brand || '-x', '-', '', 'g'), regexp_replace(p_brand || '-x', '-', ' ', 'g')], lambda f: f <> ''))), ',') AS forms, regexp_replace('tests of ' || p_name, '^([\w-]+) of ([\w -]+)$', '\2 \1') AS swapped FROM part", views=False)
def retry_forms(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(F.array_sort(text.retry_forms(F.concat("p_brand", F.lit("-x")))), ",").alias("forms"), text.swap_of(F.concat(F.lit("tests of "), "p_name")).alias("swapped"))


# Clusters and models -----------------------------------------------------------------------------------------------


@query(
    "CLU-01 CLU-06",
    """WITH w AS (SELECT p_name AS id, unnest(string_split(p_name, ' ')) AS token FROM (SELECT DISTINCT p_name FROM part)), tf AS (SELECT id, token, count(*) AS tf FROM w GROUP BY 1, 2), d AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT id) AS n FROM tf),
    r AS (SELECT id, token, tf * (ln((1.0 + n) / (1 + df)) + 1) * CASE WHEN token = 'red' THEN 0.1 ELSE 1.0 END AS w FROM tf JOIN d USING (token), n) SELECT id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM r""",
    views=False,
)
def tf_idf_weights(t: Tables) -> DataFrame:
    return clustering.tf_idf(t.part.select(F.col("p_name").alias("term")).distinct(), common=["red"]).withColumn("weight", F.round("weight", 6))


@query("CLU-03 AGG-16", "WITH n AS (SELECT p_name, p_brand, count(*) AS c FROM part GROUP BY 1, 2) SELECT p_name || p_brand AS term, first_value(p_name || p_brand) OVER (PARTITION BY p_brand ORDER BY c DESC, p_name || p_brand) AS canonical FROM n", views=False)
def canonical_names(t: Tables) -> DataFrame:
    rows = t.part.groupBy("p_name", "p_brand").agg(F.count(F.lit(1)).alias("count")).select(F.concat("p_name", "p_brand").alias("term"), "count", F.col("p_brand").alias("cluster"))
    return clustering.canonical_map(rows)


@query("CLU-02 ETL-18")
def term_clusters(t: Tables) -> DataFrame:
    """Density clusters of names by shared words; a test holds small cases against expected names."""
    return clustering.term_clusters(t.part.groupBy(F.col("p_name").alias("term")).agg(F.count(F.lit(1)).alias("count")), eps=0.4)


@query("CLU-05 RPT-29")
def vector_topics(t: Tables) -> DataFrame:
    return clustering.topics(t.embeddings, "vec_id", "embedding", 10)


@query("ML-01", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code, p_type AS back FROM part", views=False)
def label_encoder(t: Tables) -> DataFrame:
    return models.label_encoded(t.part.select("p_partkey", "p_type"), "p_type", "code", "back").select("p_partkey", "code", "back")


@query("ML-02")
def binned_values(t: Tables) -> DataFrame:
    return models.binned(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", "bin", 5).select("p_partkey", "bin")


@query("ML-03 ML-04 ML-05 ML-06 ML-07 ML-08 MISC-21 MISC-23")
def outcome_metrics(t: Tables) -> DataFrame:
    """Two-stage model of trials: outcome class, then duration; metrics on the held-out part."""
    rows = t.trials.filter("end_date > start_date").select("doc_id", "title", "enrollment", F.coalesce("dropout_count", F.lit(0)).alias("dropout_count"), F.datediff(F.to_date("end_date"), F.to_date("start_date")).cast("double").alias("duration"))
    return models.outcome_metrics(rows.withColumn("outcome", F.when(F.col("dropout_count") > 30, "high").otherwise("low")), ["title"], ["enrollment"], "outcome", "duration", "doc_id")


@query("ML-09", "SELECT o_orderkey, CAST(2024 + greatest(1, round_even(d / 365.0, 0)) AS BIGINT) AS phase_2, CAST(2024 + greatest(1, round_even(2 * d / 365.0, 0)) AS BIGINT) AS phase_3 FROM (SELECT o_orderkey, 100 + o_orderkey % 900 AS d FROM orders)", views=False)
def phase_starts(t: Tables) -> DataFrame:
    days = (100 + F.col("o_orderkey") % 900).alias("days")
    return models.phase_starts(t.orders.select("o_orderkey", days, (100 + F.col("o_orderkey") % 900).alias("days_2")), ["days", "days_2"], 2024).select("o_orderkey", "phase_2", "phase_3")


# Sources and sinks -------------------------------------------------------------------------------------------------


@query("SRC-03 SRC-04 SRC-05 SRC-06", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM orders", views=False)
def created_and_appended(t: Tables) -> DataFrame:
    store = tables.TableStore(t.spark)
    store.create_from_select("status_counts", t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")))
    store.append("status_counts", t.orders.agg(F.lit("total").alias("o_orderstatus"), F.count(F.lit(1)).alias("n")))
    return store.read("status_counts")


@query("SRC-12 SRC-13", "SELECT o_orderkey, o_totalprice, CAST(floor(o_totalprice / 100000) AS INTEGER) AS shard FROM orders", views=False)
def sharded_json_round_trip(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice")
    path = files.export_sharded(rows, tables.scratch(t.spark, "export"), "o_totalprice", 100_000)
    return files.read_json_lines(t.spark, path, "o_orderkey long, o_totalprice double, shard int")


@query("SRC-16", "SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer", views=False)
def delimited_round_trip(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_name", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment"))
    path = files.write_delimited(rows, tables.scratch(t.spark, "rrf"))
    return files.read_delimited(t.spark, path, "c_custkey long, c_name string, c_mktsegment string")


# Streams -----------------------------------------------------------------------------------------------------------


@query("STREAM", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS count, round(sum(CAST(value AS DECIMAL(20, 4)))::DOUBLE, 4) AS total FROM events GROUP BY 1, 2", views=False)
def daily_event_stream(t: Tables) -> DataFrame:
    return stream.daily_counts(t.spark, t.sf_dir)


@query("FLT-15 ETL-24", "SELECT event_id, event_type FROM events", views=False)
def incremental_batches(t: Tables) -> DataFrame:
    return stream.incremental_copy(t.spark, t.sf_dir)
