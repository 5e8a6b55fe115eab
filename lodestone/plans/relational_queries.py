"""Filters, joins, aggregates, windows, sets and scalar functions, one query for each group of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import entities, etl
from .fixtures import Tables
from .registry import query

# Filters -----------------------------------------------------------------------------------------------------------


@query("FLT-01 FN-07 FN-01", "SELECT o_orderkey AS id, upper(substr(o_orderpriority, 3)) AS level, coalesce(nullif(o_orderstatus, 'P'), 'none') AS state, greatest(o_totalprice, 1000.0) AS value FROM orders", views=False)
def computed_projection(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), F.upper(F.expr("substr(o_orderpriority, 3)")).alias("level"), F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("none")).alias("state"), F.greatest("o_totalprice", F.lit(1000.0)).alias("value"))


@query("FLT-05 FLT-13", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderdate <= TIMESTAMP '1998-01-01') AS early FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'", views=False)
def year_range(t: Tables) -> DataFrame:
    recent = t.orders.filter(dates.from_year(F.col("o_orderdate"), 1996))
    return recent.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(dates.between_years(F.col("o_orderdate"), 1996, 1998), 1)).alias("early"))


@query("FLT-07 FN-22", r"SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '\b(?:widgets?|gadgets?)\b', 'i') AND NOT regexp_matches(p_name, '\bred\b', 'i')", views=False)
def regex_filters(t: Tables) -> DataFrame:
    wanted = F.col("p_name").rlike(text.or_pattern(["widget", "gadget"], plural=True))
    return t.part.filter(wanted & ~F.col("p_name").rlike(text.or_pattern(["red"]))).select("p_partkey", "p_name")


@query(
    "FLT-08 FLT-09 FLT-10 FLT-17 SET-08",
    """WITH o AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags, list(DISTINCT l_suppkey) AS supps, list(l_quantity) AS q FROM lineitem GROUP BY 1)
    SELECT l_orderkey, list_has_any(flags, ['R', 'N']) AS overlaps, list_contains(flags, 'A') AS has_a, len(supps) > 3 AS wide, len(list_filter(q, lambda x: x > 45)) > 0 AS any_large, list_has_all(flags, ['A', 'N']) AS has_both FROM o""",
    views=False,
)
def array_predicates(t: Tables) -> DataFrame:
    o = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"), F.collect_set("l_suppkey").alias("supps"), F.collect_list("l_quantity").alias("q"))
    lits = lambda *v: F.array(*map(F.lit, v))
    return o.select("l_orderkey", F.arrays_overlap("flags", lits("R", "N")).alias("overlaps"), F.array_contains("flags", "A").alias("has_a"), (F.size("supps") > 3).alias("wide"), F.exists("q", lambda x: x > 45).alias("any_large"), (F.size(F.array_except(lits("A", "N"), "flags")) == 0).alias("has_both"))


@query("FLT-03 FLT-15 JOIN-10 JOIN-09", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", views=False)
def not_in_anti(t: Tables) -> DataFrame:
    left = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return left.join(t.customer.filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("JOIN-11 FLT-14", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 1000)", views=False)
def not_exists_anti(t: Tables) -> DataFrame:
    closed, large = t.orders.filter("o_orderstatus = 'F'"), t.orders.filter("o_totalprice > 1000")
    on = F.col("c_custkey") == F.col("o_custkey")
    return t.customer.join(closed, on, "left_anti").join(large, on, "left_semi").select("c_custkey")


@query("FLT-12 SRC-30", "SELECT 'orders' AS \"table\", count(*) AS rows, count(DISTINCT o_custkey) AS distinct_o_custkey, count(DISTINCT o_orderstatus) AS distinct_o_orderstatus FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderpriority <> ''", views=False)
def load_checksum(t: Tables) -> DataFrame:
    return etl.checksum(t.orders.filter(F.col("o_orderpriority").isNotNull() & (F.col("o_orderpriority") != "")), "orders", ["o_custkey", "o_orderstatus"])


# Joins -------------------------------------------------------------------------------------------------------------


@query(
    "JOIN-01 JOIN-17 AGG-01",
    """SELECT r_name, n_name, count(*) AS count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON p_partkey = l_partkey WHERE p_size > 25 GROUP BY 1, 2""",
    views=False,
)
def chained_joins(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_suppkey", "l_partkey").join(t.part.filter("p_size > 25").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    places = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return lines.join(places, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("count"))


@query(
    "JOIN-02 JOIN-06 JOIN-07 JOIN-22 AGG-10 AGG-12",
    """WITH s AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(*) AS lines FROM lineitem GROUP BY 1), p AS (SELECT l_orderkey, count(DISTINCT p_type) AS types FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT o_orderkey, coalesce(flags, '') AS flags, coalesce(lines, 0) AS lines, coalesce(types, 0) AS types FROM orders LEFT JOIN s ON s.l_orderkey = o_orderkey LEFT JOIN p ON p.l_orderkey = o_orderkey""",
    views=False,
)
def aggregate_then_left_join(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count(F.lit(1)).alias("lines"))
    p = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.countDistinct("p_type").alias("types"))
    joined = t.orders.select(F.col("o_orderkey").alias("l_orderkey")).join(s, "l_orderkey", "left").join(p, "l_orderkey", "left")
    return joined.select(F.col("l_orderkey").alias("o_orderkey"), F.coalesce("flags", F.lit("")).alias("flags"), F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("types", F.lit(0)).alias("types"))


@query(
    "JOIN-08 FN-05",
    "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, p_type FROM part",
    views=False,
)
def lateral_unnest(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"), "p_type")


@query(
    "JOIN-13 AGG-11",
    """SELECT c_custkey, coalesce(string_agg(o_orderkey || '@' || o_orderstatus, ',' ORDER BY o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL), '') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""",
    views=False,
)
def nested_include(t: Tables) -> DataFrame:
    kids = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    out = etl.nested(t.customer.select("c_custkey"), kids, "c_custkey", "orders", ["o_orderkey", "o_orderstatus"])
    return out.select("c_custkey", F.array_join(F.transform("orders", lambda o: F.concat(o["o_orderkey"].cast("string"), F.lit("@"), o["o_orderstatus"])), ",").alias("orders"))


@query(
    "JOIN-14",
    """WITH w AS (SELECT DISTINCT p_brand, p_type AS a, p_name AS b FROM part) SELECT x.p_brand, x.b AS longer, y.t AS shorter, count(*) AS n FROM w x JOIN (SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS t FROM part) y
    ON x.p_brand = y.p_brand AND contains(x.b, y.t) AND length(x.b) > length(y.t) GROUP BY 1, 2, 3""",
    views=False,
)
def contained_terms(t: Tables) -> DataFrame:
    x = t.part.select("p_brand", "p_type", F.col("p_name").alias("longer")).distinct()
    y = t.part.select("p_brand", F.explode(F.split("p_name", " ")).alias("shorter")).distinct()
    on = (x["p_brand"] == y["p_brand"]) & F.col("longer").contains(F.col("shorter")) & (F.length("longer") > F.length("shorter"))
    return x.join(y, on).groupBy(x["p_brand"], "longer", "shorter").agg(F.count(F.lit(1)).alias("n"))


@query("JOIN-15 WIN-01", "SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2", views=False)
def dedupe_row_number(t: Tables) -> DataFrame:
    return etl.first_per(t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber"), ["l_orderkey", "l_suppkey"], ["l_linenumber"])


@query("JOIN-18", "SELECT u.i AS place, o.o_orderkey, o.o_totalprice FROM (SELECT unnest([7, 3, 999999999, 5]) AS id, unnest([0, 1, 2, 3]) AS i) u JOIN orders o ON o.o_orderkey = u.id", views=False)
def ordered_id_lookup(t: Tables) -> DataFrame:
    wanted = t.spark.range(1).select(F.posexplode(F.array(*[F.lit(i) for i in (7, 3, 999999999, 5)])).alias("place", "id"))
    return wanted.join(t.orders, F.col("id") == F.col("o_orderkey")).select("place", "o_orderkey", "o_totalprice")


@query("JOIN-24", "SELECT o_custkey, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs FROM (SELECT o_custkey, lower(o_orderpriority) AS p, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1 HAVING sum(n * (n - 1) // 2) > 0", views=False)
def family_self_join(t: Tables) -> DataFrame:
    """Pairs of a family's members with one priority, from their numbers: no pair is made."""
    n = t.orders.groupBy("o_custkey", F.lower("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("o_custkey").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs")).filter("pairs > 0")


@query("JOIN-24", "SELECT o_orderkey, (SELECT 1) * n - 1 AS related FROM orders JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) USING (o_custkey)", views=False)
def family_members(t: Tables) -> DataFrame:
    sizes = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t.orders.select("o_orderkey", "o_custkey").join(sizes, "o_custkey").select("o_orderkey", (F.col("n") - 1).alias("related"))


@query("JOIN-23", "SELECT p_partkey, id AS concept FROM part JOIN (SELECT min(p_partkey) AS id, upper(p_name) AS term FROM part GROUP BY 2) ON lower(p_name) = lower(term) WHERE id <> p_partkey", views=False)
def synonym_join(t: Tables) -> DataFrame:
    synonyms = t.part.groupBy(F.upper("p_name").alias("term")).agg(F.min("p_partkey").alias("concept"))
    return t.part.join(synonyms, F.lower("p_name") == F.lower("term")).filter("concept <> p_partkey").select("p_partkey", "concept")


@query(
    "JOIN-12 SRC-18 SRC-19 MISC-01",
    "SELECT c_custkey, coalesce(v, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey",
    views=False,
)
def update_from(t: Tables) -> DataFrame:
    changes = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"))
    return etl.updated(t.customer.select("c_custkey", "c_mktsegment"), changes, "c_custkey", "c_mktsegment")


@query(
    "SRC-11 SRC-07",
    "SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c FULL JOIN (SELECT c_custkey + 50 AS c_custkey, c_acctbal * 2 AS c_acctbal FROM customer) n ON c.c_custkey = n.c_custkey",
    views=False,
)
def upsert_merge(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", "c_acctbal")
    return etl.upsert(base, base.select((F.col("c_custkey") + 50).alias("c_custkey"), (F.col("c_acctbal") * 2).alias("c_acctbal")), ["c_custkey"], ["c_acctbal"])


@query("SRC-07 SRC-04", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'new' END AS c_name FROM customer", views=False)
def insert_on_conflict(t: Tables) -> DataFrame:
    have = t.customer.filter("c_custkey % 2 = 0").select("c_custkey", "c_name")
    return etl.inserted(have, t.customer.select("c_custkey", F.lit("new").alias("c_name")), ["c_custkey"])


@query("SRC-20 MISC-08", "SELECT doc_id, doc_type FROM docs WHERE NOT (doc_type = 'trial' AND doc_date < TIMESTAMP '1999-01-01')")
def delete_by_predicate(t: Tables) -> DataFrame:
    return t.docs.filter(~((F.col("doc_type") == "trial") & (F.col("doc_date") < F.lit("1999-01-01").cast("timestamp_ntz")))).select("doc_id", "doc_type")


# Aggregates --------------------------------------------------------------------------------------------------------


@query(
    "AGG-03 AGG-04 AGG-05 AGG-07 AGG-13 AGG-14",
    """SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS states, min(o_totalprice) AS low, max(o_totalprice) AS high, sum(CAST(o_totalprice AS DECIMAL(20, 2)))::DOUBLE / count(*) AS mean, sum(CASE WHEN o_orderstatus = 'F' THEN 200 ELSE 30 END)::BIGINT AS traction,
      arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderpriority, o_orderkey)) AS best_order FROM orders GROUP BY 1""",
    views=False,
)
def mixed_aggregates(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("states"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), (F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double") / F.count(F.lit(1))).alias("mean"),
        F.sum(F.when(F.col("o_orderstatus") == "F", 200).otherwise(30)).alias("traction"),
        F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"), F.max_by("o_orderkey", F.struct("o_orderpriority", "o_orderkey")).alias("best_order"),
    )


@query(
    "AGG-08 AGG-09 SET-03 ETL-17",
    """WITH a AS (SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 50), b AS (SELECT n_name AS name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(*) <= 50)
    SELECT name, n * 2 AS count FROM a UNION SELECT name, n FROM b""",
    views=False,
)
def owner_name_union_having(t: Tables) -> DataFrame:
    a = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"))
    b = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"))
    return etl.harvested_names(a, b, 50, 2)


@query("AGG-28 SET-04", "SELECT k AS nation, count(*) AS count FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1", views=False)
def counts_over_maps(t: Tables) -> DataFrame:
    return etl.counts_over_maps([t.customer.select(F.col("c_nationkey").alias("nation")), t.supplier.select(F.col("s_nationkey").alias("nation"))], "nation")


@query(
    "AGG-29 MISC-07",
    """WITH r AS (SELECT p_brand AS name, p_type AS owner_type, CASE p_type WHEN 'PROMO' THEN 1 WHEN 'ECONOMY' THEN 2 ELSE 9 END AS rank, p_name FROM part)
    SELECT name, arg_min(owner_type, (rank, owner_type)) AS owner_type, array_to_string(list_sort(list(DISTINCT p_name)), ',') AS synonyms, count(*) AS count FROM r GROUP BY 1""",
    views=False,
)
def merged_owner_records(t: Tables) -> DataFrame:
    rank = F.when(F.col("p_type") == "PROMO", 1).when(F.col("p_type") == "ECONOMY", 2).otherwise(9)
    rows = t.part.select(F.col("p_brand").alias("name"), F.col("p_type").alias("owner_type"), rank.alias("rank"), F.array("p_name").alias("synonyms"), F.lit(1).cast("long").alias("count"))
    return etl.merged_owners(rows).withColumn("synonyms", F.array_join("synonyms", ","))


@query(
    "AGG-31",
    "SELECT o_orderkey FROM orders WHERE o_totalprice < (SELECT avg(o_totalprice) - 1.5 * stddev_samp(o_totalprice) FROM orders)",
    views=False,
)
def deviation_cutoff(t: Tables) -> DataFrame:
    limit = t.orders.agg((F.avg("o_totalprice") - 1.5 * F.stddev_samp("o_totalprice")).alias("_limit"))
    return t.orders.join(F.broadcast(limit), F.col("o_totalprice") < F.col("_limit")).select("o_orderkey")


@query("AGG-12", "SELECT user_id, arg_max(event_type, (n, event_type)) AS main_type, sum(n)::BIGINT AS events FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1", views=False)
def two_level_events(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("main_type"), F.sum("n").alias("events"))


# Windows -----------------------------------------------------------------------------------------------------------


@query("WIN-03 ETL-23", "SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, n AS votes FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2) WHERE k = 1", views=False)
def majority_vote(t: Tables) -> DataFrame:
    return etl.majority(t.events, "user_id", "event_type")


@query("WIN-02", "SELECT o_orderkey, array_to_string(list_sort(list(o_orderkey) OVER (PARTITION BY o_custkey)), ',') AS family FROM orders", views=False)
def family_array_window(t: Tables) -> DataFrame:
    family = F.array_sort(F.collect_list("o_orderkey").over(Window.partitionBy("o_custkey")))
    return t.orders.select("o_orderkey", F.array_join(family.cast("array<string>"), ",").alias("family"))


@query("WIN-04", "SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", views=False)
def previous_and_next(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"))


@query("WIN-05 VEC-10", "SELECT o_orderkey, round(sum(CAST(o_totalprice AS DECIMAL(20, 2))) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE, 2) AS running FROM orders", views=False)
def cumulative_energy(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t.orders.select("o_orderkey", F.round(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).over(w).cast("double"), 2).alias("running"))


# Sets --------------------------------------------------------------------------------------------------------------


@query("SET-01 SET-05 SET-06", "SELECT DISTINCT k, kind FROM (SELECT c_nationkey AS k, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier)", views=False)
def union_and_distinct(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("kind"))
    return a.unionByName(t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("kind"))).distinct()


@query(
    "SET-07 SET-08 SET-09 FN-11",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, len(list_distinct(w)) AS distinct_words, list_has_any(w, ['the', 'of']) AS common, (len(w) + 9) // 10 AS batches FROM w WHERE len(w) > 0""",
    views=False,
)
def list_operations(t: Tables) -> DataFrame:
    w = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    rows = t.documents.select("doc_id", w.alias("w")).filter(F.size("w") > 0)
    batches = F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(10)), lambda i: F.slice("w", i, 10))
    return rows.select("doc_id", F.size(F.array_distinct("w")).cast("long").alias("distinct_words"), F.arrays_overlap("w", F.array(F.lit("the"), F.lit("of"))).alias("common"), F.size(batches).cast("long").alias("batches"))


# Scalar functions --------------------------------------------------------------------------------------------------


@query("FN-02 FN-23", r"SELECT doc_id, length(trim(regexp_replace(regexp_replace(text, '\s{2,}', ' ', 'g'), '\s+,', ',', 'g'))) AS squeezed FROM documents", views=False)
def squeezed_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length(text.squeeze(F.regexp_replace("text", r"' s\b", "'s"))).cast("long").alias("squeezed"))


@query(
    "FN-12 FN-13 CLS-02",
    """WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark)
    SELECT item_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w WHERE len(w) >= 2""",
    views=False,
)
def word_bigrams(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.explode(text.word_ngrams(text.tokens(F.col("text")), 2)).alias("gram"))


@query("FN-20", "SELECT conv_id, turn, CAST(ceil(length(text) / 100.0) AS BIGINT) AS pieces FROM conversations WHERE length(text) > 0", views=False)
def text_chunks(t: Tables) -> DataFrame:
    return t.conversations.filter(F.length("text") > 0).select("conv_id", "turn", F.size(text.chunks(F.col("text"), 100)).cast("long").alias("pieces"))


@query("FN-21 FN-17", r"SELECT page_id, trim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[^A-Za-z0-9.\-]+', '_', 'g'), '_') AS file_name, sha1(url) AS key FROM pages", views=False)
def url_file_names(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.url_to_file_name(F.col("url")).alias("file_name"), F.sha1("url").alias("key"))


@query("FN-08 FN-14", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS age FROM orders", views=False)
def date_functions(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", dates.year_of(d).alias("y"), F.date_format(d, "yyyy-MM-dd").alias("day"), dates.duration_days(d, F.lit(None).cast("timestamp_ntz"), "2002-01-01").alias("age"))


@query("FN-19", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", views=False)
def json_fields(t: Tables) -> DataFrame:
    fields = F.from_json(text.fenced_json(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))), "k bigint")
    return t.events.select("event_id", fields["k"].alias("k"))


@query("FN-09", "SELECT p_partkey, round(CAST(pow(p_size, 2) / 7 AS DECIMAL(20, 6)), 2)::DOUBLE AS scaled FROM part", views=False)
def decimal_rounding(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round((F.pow("p_size", F.lit(2)) / 7).cast("decimal(20,6)"), 2).cast("double").alias("scaled"))


@query(
    "TOP-08 TOP-09 TOP-11 CLS-15",
    r"""SELECT p_brand, arg_min(p_name, (CASE WHEN regexp_matches(p_name, '[\d\[\](),]') THEN 1 ELSE 0 END, len(string_split(p_name, ' ')), p_partkey, p_name)) AS display_name FROM part GROUP BY 1""",
    views=False,
)
def display_names(t: Tables) -> DataFrame:
    from ..operators import linking

    return linking.best_alias(t.part, "p_brand", "p_name", "p_partkey")


@query("ETL-04 SET-03", "SELECT l_orderkey AS doc_id, lower(p_name) AS term, min(l_linenumber) AS \"offset\" FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2", views=False)
def mention_offsets(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc_id"), F.upper("p_name").alias("term"), F.col("l_linenumber").alias("offset"), F.col("l_returnflag").alias("source"))
    return etl.mention_offsets(rows, ["A", "N"])


@query(
    "ETL-23 MISC-37",
    "SELECT p_partkey, CASE WHEN p_type = 'PROMO' AND p_name LIKE '%widget%' THEN 'DEVICE' WHEN p_type = 'ECONOMY' THEN 'BUDGET' ELSE p_type END AS domain FROM part WHERE NOT (p_type = 'STANDARD' AND p_name LIKE '%red%')",
    views=False,
)
def reassigned_domains(t: Tables) -> DataFrame:
    rules = [("widget", "PROMO", "DEVICE"), (".", "ECONOMY", "BUDGET"), ("red", "STANDARD", "")]
    return etl.reassigned(t.part.select("p_partkey", "p_name", F.col("p_type").alias("domain")), "p_name", "domain", rules).select("p_partkey", "domain")


@query("VEC-13", "SELECT conv_id, left(string_agg(text, '. ' ORDER BY turn), 2000) AS text FROM conversations WHERE text <> '' GROUP BY 1", views=False)
def doc_text_assembly(t: Tables) -> DataFrame:
    turns = t.conversations.filter("text <> ''").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("t"))
    return turns.select("conv_id", etl.document_text([F.array_join("t", ". ")]).alias("text"))


@query("SRC-27", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 AND turn = 1", views=False)
def conversation_lookup(t: Tables) -> DataFrame:
    return t.conversations.filter((F.col("conv_id") == 3) & (F.col("turn") == 1)).select("conv_id", "turn", "role", "text")


@query(
    "NLP-04",
    r"""SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(p_name || ' & ' || p_brand, '&', ' and ', 'g'), '\s{2,}', ' ', 'g'))) AS cleaned FROM part""",
    views=False,
)
def clean_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.clean(F.concat_ws(" & ", "p_name", "p_brand")).alias("cleaned"))


@query("AGG-06 VEC-04 VEC-08", "SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1, 2", views=False)
def vector_mean_by_label(t: Tables) -> DataFrame:
    from ..functions import vectors

    return vectors.mean_by(t.embeddings, ["label"], "embedding").select("label", F.posexplode("vector").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@query(
    "VEC-05 RPT-25",
    """WITH m AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
    SELECT label, round(list_cosine_similarity(v, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 2) AS wheelhouse FROM m""",
    views=False,
)
def wheelhouse(t: Tables) -> DataFrame:
    from ..functions import vectors

    q = t.embeddings.filter("vec_id = 0").first()["embedding"]
    return vectors.mean_by(t.embeddings, ["label"], "embedding").select("label", F.round(vectors.cosine(F.col("vector"), vectors.literal(q)), 2).alias("wheelhouse"))


@query(
    "VEC-06 VEC-07 VEC-15",
    """WITH k AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN abs(x) < 0.1 THEN 0.0 ELSE x END) AS v FROM embeddings), s AS (SELECT vec_id, v, list_sum(list_transform(v, lambda x: abs(x))) AS n FROM k)
    SELECT vec_id, round(CASE WHEN n > 0 THEN v[1] / n ELSE v[1] END, 6) AS first, round(CASE WHEN n > 0 THEN list_sum(v) / n ELSE 0.0 END, 6) AS total FROM s""",
    views=False,
)
def l1_normalise(t: Tables) -> DataFrame:
    from ..functions import vectors

    v = vectors.l1_normalised(F.col("embedding"))
    return t.embeddings.select("vec_id", v.alias("v")).select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(vectors.total(F.col("v")), 6).alias("total"))


@query(
    "VEC-09",
    """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, q FROM embeddings, q)
    SELECT vec_id, round(0.45 * (2 - list_cosine_similarity(v, q)) + 0.55 * (1 - list_distance(v, q) / sqrt(list_dot_product(v, v))), 5) AS similarity FROM e""",
    views=False,
)
def residual_similarity(t: Tables) -> DataFrame:
    from ..functions import vectors

    q = t.embeddings.filter("vec_id = 0").first()["embedding"]
    return t.embeddings.select("vec_id", F.round(vectors.residual_similarity(F.col("embedding"), vectors.literal(q)), 5).alias("similarity"))


@query("VEC-11", "SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings", views=False)
def parsed_vectors(t: Tables) -> DataFrame:
    from ..functions import vectors

    written = F.to_json(vectors.doubles(F.col("embedding")))
    return t.embeddings.select("vec_id", F.round(vectors.total(vectors.parsed(written)), 4).alias("total"))


@query("AGG-19 MISC-09", "SELECT domain, CAST(round_even(avg(size), 0) AS BIGINT) AS mean_size, count(*) AS count FROM (SELECT domain, p_size AS size FROM entities JOIN part ON entity_id = p_partkey) GROUP BY 1")
def level_distribution(t: Tables) -> DataFrame:
    rows = t.entities.join(t.part, F.col("entity_id") == F.col("p_partkey"))
    return rows.groupBy("domain").agg(entities.rounded_mean(F.col("p_size")).alias("mean_size"), F.count(F.lit(1)).alias("count"))
