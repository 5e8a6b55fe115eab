"""Queries of rules with all their entries, owner names, cleaned terms, nested values, SQL text and file formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nested, text
from ..operators import classify, clustering, etl, graph, owners, rules
from ..sources import files, sql, tables
from .fixtures import Tables
from .registry import query


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in_turn(values: list[str], number: Column) -> Column:
    """The value whose place is the number modulo how many there are, so that every entry of a table occurs."""
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _in_turn_sql(values: list[str], number: str) -> str:
    return f"[{', '.join(map(_quoted, values))}][{number} % {len(values)} + 1]"


def _nested_replace(value: str, steps: list[tuple[str, str]], wrap: str = "{}") -> str:
    """SQL that replaces patterns one after the other, in any case."""
    return reduce(lambda out, s: wrap.format(f"regexp_replace({out}, {_quoted(s[0])}, {_quoted(s[1])}, 'gi')"), steps, value)


def _spellings(words: dict[str, list[str]]) -> list[tuple[str, str]]:
    return sorted({(form, kind) for kind, own in words.items() for word in own for form in text.expand_pattern(word.lower())})


def _classes_sql(words: dict[str, list[str]], said: str, otherwise: str, plural: bool = False) -> str:
    """(id, said) rows to (id, classes): keywords of three words at most that stand in the text as words."""
    plain = {(" ".join("".join(c if c.isalnum() else " " for c in form).split()), kind) for form, kind in _spellings(words)}
    if plural:
        plain |= {(f + "s", kind) for f, kind in plain}
    values = ", ".join(f"({_quoted(f)}, {_quoted(kind)})" for f, kind in sorted(plain) if len(f.split()) <= 3)
    return f"""k(form, class) AS (VALUES {values}), s AS (SELECT p_partkey, ' ' || trim(regexp_replace(lower({said}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS t FROM part),
    c AS (SELECT p_partkey, coalesce(list_sort(list(DISTINCT class) FILTER (WHERE class IS NOT NULL)), [{_quoted(otherwise)}]) AS classes FROM s LEFT JOIN k ON contains(t, ' ' || form || ' ') GROUP BY 1)"""


# Reasons and suppression ---------------------------------------------------------------------------------------------

_TERMINATION = [f for f, _ in _spellings(rules.TERMINATION)]
_DROPOUT = [f for f, _ in _spellings(rules.DROPOUT)]


@query("CLS-08 CLS-01 CLS-02", f"WITH {_classes_sql(rules.TERMINATION, _in_turn_sql(_TERMINATION, 'p_partkey') + " || ' for ' || p_name", 'OTHER')} SELECT p_partkey, array_to_string(classes, ',') AS reasons FROM c", views=False)
def termination_reasons(t: Tables) -> DataFrame:
    said = F.concat(_in_turn(_TERMINATION, F.col("p_partkey")), F.lit(" for "), F.col("p_name"))
    out = classify.keyword_classes(t.part.select("p_partkey", said.alias("said")), "p_partkey", "said", rules.TERMINATION, "OTHER")
    return out.select("p_partkey", F.array_join("classes", ",").alias("reasons"))


@query("CLS-08 FN-24", f"WITH {_classes_sql(rules.DROPOUT, _in_turn_sql(_DROPOUT, 'p_partkey') + " || ': ' || p_name", 'OTHER')} SELECT p_partkey, array_to_string(classes, ',') AS reasons FROM c", views=False)
def dropout_reasons(t: Tables) -> DataFrame:
    said = F.concat(_in_turn(_DROPOUT, F.col("p_partkey")), F.lit(": "), F.col("p_name"))
    out = classify.keyword_classes(t.part.select("p_partkey", said.alias("said")), "p_partkey", "said", rules.DROPOUT, "OTHER")
    return out.select("p_partkey", F.array_join("classes", ",").alias("reasons"))


_NAMES = [*rules.SUPPRESSED_WORDS, "plain", "orange", "mousetrap"]


@query(
    "CLS-14",
    f"""SELECT p_partkey AS id, p_partkey % 17 = 0 OR list_contains([{', '.join(map(_quoted, rules.SUPPRESSED_WORDS))}], {_in_turn_sql(_NAMES, 'p_partkey')}) OR (p_partkey % 5 = 0 AND p_brand = 'Brand#11') OR (p_partkey % 7 = 0 AND p_size % 2 = 1) AS is_suppressed FROM part""",
    views=False,
)
def suppressed_concepts(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    concepts = t.part.select(key.alias("id"), F.concat(_in_turn(_NAMES, key), F.lit(" "), F.col("p_name")).alias("name"), F.array(F.upper("p_brand")).alias("matching_aliases"), (F.col("p_size") % 2 == 0).alias("is_composite"))
    some = lambda n: t.part.filter(key % n == 0).select(key.alias("id"))
    return rules.suppressed(concepts, some(17), some(5).withColumn("alias", F.lit("brand#11")), some(7)).select("id", "is_suppressed")


_RECORDS = {"design": classify.DESIGNS, "randomization": classify.RANDOMIZATIONS, "masking": classify.MASKINGS, "purpose": classify.PURPOSES, "status": classify.STATUSES, "group": classify.STATUS_GROUPS, "phase": classify.PHASES, "intervention": classify.INTERVENTIONS, "hypothesis": classify.HYPOTHESES}
_RAW = [(field, raw) for field, values in _RECORDS.items() for raw in [*values, "something else"]]


@query(
    "CLS-06 CLS-07 CLS-09",
    "WITH v(field, raw, value) AS (VALUES " + ", ".join(f"({_quoted(f)}, {_quoted(r)}, {_quoted(v)})" for f, values in _RECORDS.items() for r, v in values.items()) + f"""),
    r AS (SELECT p_partkey, {_in_turn_sql([f for f, _ in _RAW], 'p_partkey')} AS field, {_in_turn_sql([r for _, r in _RAW], 'p_partkey')} AS raw FROM part) SELECT p_partkey, field, coalesce(value, 'UNKNOWN') AS value FROM r LEFT JOIN v USING (field, raw)""",
    views=False,
)
def record_values(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", _in_turn([f for f, _ in _RAW], F.col("p_partkey")).alias("field"), _in_turn([r for _, r in _RAW], F.col("p_partkey")).alias("raw"))
    value = F.coalesce(*[F.when(F.col("field") == f, classify.mapped(F.col("raw"), values)) for f, values in _RECORDS.items()])
    return rows.select("p_partkey", "field", value.alias("value"))


# Owners --------------------------------------------------------------------------------------------------------------

_OWNERS = [f"{form} {end}" for key in owners.OVERRIDES if "{" not in key for form in text.expand_pattern(key) for end in ("Inc", "Pharma Co., Ltd. (China)")] + ["The MO R&D Labs internat GmbH", "Univ of the Hosp", "us govt agency for res and dev", "acme a/s common stock class a"]
_SUPPRESS = f"(?:{'|'.join(rf'\b(?:{w})s?\b' for w in owners.SUPPRESSED)})*(?:^the\\b|\\(.+\\))?"


@query(
    "ETL-18 MISC-34 CLS-12",
    f"""WITH n AS (SELECT p_partkey, {_in_turn_sql(_OWNERS, 'p_partkey')} AS name FROM part),
    a AS (SELECT p_partkey, name, regexp_replace(regexp_replace(name, {_quoted(_SUPPRESS)}, '', 'gi'), '^[&., )(]+|[&., )(]+$', '', 'g') AS x FROM n),
    b AS (SELECT p_partkey, name, {_nested_replace('x', [(rf'\b(?:{p})\b', f' {s} ') for p, s in owners.SPELLINGS.items()], 'trim({})')} AS x FROM a),
    c AS (SELECT p_partkey, name, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[.,]+', '', 'g'), '\\s{{2,}}', ' ', 'g'), '\\s+,', ',', 'g'), ''' s\\b', '''s', 'g'))) AS cleaned FROM b),
    o(i, k, v) AS (VALUES {', '.join(f"({i}, {_quoted(rf'\b(?:{k})\b')}, {_quoted(v)})" for i, (k, v) in enumerate(owners.OVERRIDES.items()))}),
    d AS (SELECT DISTINCT name, cleaned FROM c), m AS (SELECT name, arg_min(v, i) FILTER (WHERE regexp_matches(name, k, 'i')) AS by_name, arg_min(v, i) FILTER (WHERE regexp_matches(cleaned, k, 'i')) AS by_clean FROM d, o GROUP BY 1)
    SELECT p_partkey, cleaned, coalesce(by_name, by_clean, nullif(cleaned, ''), 'other') AS canonical FROM c JOIN m USING (name)""",
    views=False,
)
def owner_canonical(t: Tables) -> DataFrame:
    named = t.part.select("p_partkey", _in_turn(_OWNERS, F.col("p_partkey")).alias("name"))
    known = owners.canonical_owners(named.groupBy("name").agg(F.count(F.lit(1)).alias("count")), cluster=False)
    return named.join(known, "name").select("p_partkey", "cleaned", "canonical")


_TYPED = [f for f, _ in _spellings(owners.TYPE_WORDS)] + ["mayo clinic", "albert einstein college medicine", "random co, inc", "us government", "bristol university research foundation"]


@query(
    "CLS-12 MISC-34 NLP-25",
    f"WITH {_classes_sql(owners.TYPE_WORDS, _in_turn_sql(_TYPED, 'p_partkey') + " || ' of ' || p_name", 'OTHER', plural=True)}, r(c, r) AS (VALUES {', '.join(f'({_quoted(c)}, {r})' for c, r in classify.OWNER_PRIORITY.items())}) SELECT p_partkey, arg_min(r.c, r.r) AS owner_type FROM c JOIN r ON list_contains(classes, r.c) GROUP BY 1",
    views=False,
)
def owner_types(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.concat(_in_turn(_TYPED, F.col("p_partkey")), F.lit(" of "), F.col("p_name")).alias("name"))
    return owners.owner_types(rows, "p_partkey", "name")


# Terms ---------------------------------------------------------------------------------------------------------------

_PHRASES = [f for key in rules.PHRASES if "{" not in key for f in text.expand_pattern(key)] + ["ccr 5", "useful compounds", "binding receptor", "drug candidates", "soluble salt", "target group", "poly(isoprene)", "stabilized matrix chains", "formulations/formulae", "'quoted'", "non-competitive"]


@query(
    "NLP-01 NLP-02 NLP-03 NLP-04 NLP-05 NLP-07 MISC-18",
    "WITH a AS (SELECT p_partkey, replace(replace('The (big) ' || " + _in_turn_sql(_PHRASES, "p_partkey") + " || ' &amp; ' || p_name || '&#44; &lt;x&gt;.', '&amp;', '&'), '&#44;', ',') AS x FROM part), b AS (SELECT p_partkey, regexp_replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '\\(([a-z0-9-]+)\\)', '\\1', 'gi') AS x FROM a), "
    + f"c AS (SELECT p_partkey, {_nested_replace('x', list(rules.SUBSTITUTIONS.items()))} AS x FROM b), d AS (SELECT p_partkey, replace(trim(regexp_replace(regexp_replace(x, '\\s{{2,}}', ' ', 'g'), '\\s+,', ',', 'g')), '-', ' ') AS x FROM c), "
    + f"e AS (SELECT p_partkey, {_nested_replace('x', [(rf'\b{p}s?\b', w.replace('$', chr(92))) for p, w in rules.PHRASES.items()])} AS x FROM d) SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(x, '\\s{{2,}}', ' ', 'g'), '\\s+,', ',', 'g'))) AS cleaned FROM e",
    views=False,
)
def cleaned_terms(t: Tables) -> DataFrame:
    term = F.concat(F.lit("The (big) "), _in_turn(_PHRASES, F.col("p_partkey")), F.lit(" &amp; "), F.col("p_name"), F.lit("&#44; &lt;x&gt;."))
    return t.part.select("p_partkey", rules.cleaned_term(term).alias("cleaned"))


@query(
    "NLP-08 NLP-10 NLP-24",
    r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('new new ' || p_name || ' item of the thing kits', '^(?:(?:new|old)\b\s*)+', '', 'gi'), '(?:\s*\b(?:kits|thing))+$', '', 'gi'), '\b(?:item)\b', '', 'gi'), '\s{2,}', ' ', 'g')) AS trimmed,
      array_to_string(list_filter(string_split('the ' || p_name || ' of an ' || p_brand, ' '), lambda w: NOT list_contains(['the', 'of', 'an'], lower(w))), ' ') AS told, regexp_replace(p_name || 'ies', 'ies$', 'y') AS one FROM part""",
    views=False,
)
def trimmed_terms(t: Tables) -> DataFrame:
    long = F.concat(F.lit("new new "), F.col("p_name"), F.lit(" item of the thing kits"))
    told = text.without_stop_words(F.concat(F.lit("the "), F.col("p_name"), F.lit(" of an "), F.col("p_brand")))
    return t.part.select("p_partkey", text.without_words(long, ["new", "old"], ["kits", "thing"], ["item"]).alias("trimmed"), told.alias("told"), text.depluralise_last(F.concat("p_name", F.lit("ies"))).alias("one"))


@query("FN-24 FN-03", "SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '(red|blue|large) (widget|gadget)s?')", views=False)
def pattern_strings(t: Tables) -> DataFrame:
    forms = t.spark.createDataFrame([(f,) for f in text.expand_pattern("(red|blue|large) (widget|gadget)s?")], "p_name string")
    return t.part.join(F.broadcast(forms), "p_name", "left_semi").select("p_partkey")


# Values --------------------------------------------------------------------------------------------------------------


@query("SET-10", """SELECT p_partkey, '{"' || p_brand || '":{"' || p_type || '":[' || p_size || ',' || p_partkey || ']},"z":{"x":[' || p_size || ']}}' AS merged FROM part""", views=False)
def deep_merge(t: Tables) -> DataFrame:
    inner = lambda key, value: F.create_map(key, F.array(value.cast("long")))
    a = F.create_map(F.col("p_brand"), inner(F.col("p_type"), F.col("p_size")))
    b = F.create_map(F.col("p_brand"), inner(F.col("p_type"), F.col("p_partkey")), F.lit("z"), inner(F.lit("x"), F.col("p_size")))
    rows = t.part.select("p_partkey", a.alias("a"), b.alias("b"))
    return rows.select("p_partkey", F.to_json(nested.merged(F.col("a"), F.col("b"), rows.schema["a"].dataType)).alias("merged"))


@query("FN-26", """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || CAST(o_totalprice AS DOUBLE) || ',"none":null}' AS record FROM orders""", views=False)
def json_records(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), F.lit(None).cast("string").alias("none"))
    return rows.select("o_orderkey", nested.json_record([F.col(c) for c in rows.columns], rows.schema).alias("record"))


@query("FN-25 FN-31", "SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) WHEN p_type <> 'PROMO' THEN p_type ELSE p_brand END AS first, p_partkey % 6 IN (0, 2, 4, 5) AS flag FROM part", views=False)
def first_values_and_flags(t: Tables) -> DataFrame:
    size = F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(F.lit(0)).cast("string")
    kind = F.when(F.col("p_type") != "PROMO", F.col("p_type")).otherwise(F.lit(""))
    values = F.create_map(F.lit("a"), size, F.lit("b"), kind, F.lit("c"), F.col("p_brand"))
    return t.part.select("p_partkey", nested.first_value(values).alias("first"), nested.parsed_bool(_in_turn(["Yes", "no", " TRUE", "0", "1", "t"], F.col("p_partkey"))).alias("flag"))


@query("FN-04 FN-06", "SELECT p_partkey, p_brand || '=' || string_split(p_name, ' ')[1] || ';' || p_type || '=' || string_split(p_name, ' ')[2] AS pairs FROM part", views=False)
def zipped_arrays(t: Tables) -> DataFrame:
    zipped = F.arrays_zip(F.array("p_brand", "p_type").alias("k"), F.slice(F.split("p_name", " "), 1, 2).alias("v"))
    return t.part.select("p_partkey", F.array_join(F.transform(zipped, lambda z: F.concat(z["k"], F.lit("="), z["v"])), ";").alias("pairs"))


@query("FN-10 FN-29", "SELECT doc_id, CAST(CAST('0x' || left(md5(CAST(doc_id AS VARCHAR)), 8) AS BIGINT) % 10 AS INTEGER) AS part FROM docs")
def hash_split(t: Tables) -> DataFrame:
    return t.docs.select("doc_id", text.hash_part(F.col("doc_id"), 10).alias("part"))


@query("TOP-07", "SELECT o_custkey, array_to_string(list_reverse(list_sort(list(o_orderkey))), ',') AS newest_first FROM orders GROUP BY 1", views=False)
def sorted_then_reversed(t: Tables) -> DataFrame:
    keys = t.orders.groupBy("o_custkey").agg(F.reverse(F.array_sort(F.collect_list("o_orderkey"))).alias("k"))
    return keys.select("o_custkey", F.array_join(F.col("k").cast("array<string>"), ",").alias("newest_first"))


# SQL text, tables and files ------------------------------------------------------------------------------------------


@query("SRC-01 SRC-02", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1", views=False)
def sql_batches(t: Tables) -> DataFrame:
    """A query's rows, few, come to a function batch by batch, which appends them to a table."""
    store = tables.TableStore(t.spark)
    store.create("counts", "o_orderstatus string, n long")
    append = lambda rows: store.append("counts", t.spark.createDataFrame(rows, "o_orderstatus string, n long"))
    sql.select(t.spark, "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY 1", append, 2, {"orders": t.orders})
    return store.read("counts")


@query("SRC-28 ETL-26", "SELECT doc_id, entity_id FROM mentions JOIN docs USING (doc_id) WHERE doc_type = 'patent'")
def training_pairs(t: Tables) -> DataFrame:
    store = tables.TableStore(t.spark)
    store.create_from_select("pairs", t.mentions.select("doc_id", "entity_id").join(t.docs.filter("doc_type = 'patent'").select("doc_id"), "doc_id"))
    return store.read("pairs")


@query("SRC-14 SRC-22", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS filed_date, o_orderpriority AS title FROM orders", views=False)
def imported_json(t: Tables) -> DataFrame:
    """Maps become their first value, a date of 0 is null, vectors aren't read."""
    filed = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("0"))
    rows = t.orders.select("o_orderkey", filed.alias("filed_date"), F.create_map(F.lit("en"), F.col("o_orderpriority")).alias("title"), F.array(F.lit(0.5)).alias("embeddings"))
    path = tables.scratch(t.spark, "json")
    rows.write.json(path)
    return files.read_json_lines(t.spark, path, "o_orderkey long, filed_date string, title map<string,string>, embeddings array<double>")


@query("SRC-15", "SELECT c_name AS symbol, lower(c_name) AS name FROM customer WHERE c_mktsegment = 'BUILDING'", views=False)
def listed_companies(t: Tables) -> DataFrame:
    """Listings in three files, one under the other; only three of the columns are read, and one sector stays."""
    rows = t.customer.select(F.col("c_name").alias("Symbol"), F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Sector"), F.col("c_acctbal").alias("Price"), F.col("c_custkey") % 3)
    paths = []
    for i in range(3):
        paths.append(tables.scratch(t.spark, "listing"))
        rows.filter(F.col(rows.columns[-1]) == i).drop(rows.columns[-1]).write.csv(paths[-1], header=True)
    return files.listed_companies(t.spark, paths, "BUILDING")


# Graphs and vectors --------------------------------------------------------------------------------------------------

_CLOSE = "p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / 8 < 0.12), e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p), c(n, l) AS (SELECT u, v FROM e UNION SELECT c.n, e.v FROM c JOIN e ON c.l = e.u)"


@query("GRA-11", f"WITH RECURSIVE {_CLOSE} SELECT n AS node, min(l) AS component FROM c GROUP BY 1", views=False)
def similar_components(t: Tables) -> DataFrame:
    from ..operators.components import components

    return components(clustering.close_forest(t.embeddings, "vec_id", "embedding", 0.12))


@query("VEC-16", f"WITH RECURSIVE {_CLOSE} SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT n FROM c WHERE l < n)", views=False)
def orthogonal_members(t: Tables) -> DataFrame:
    return clustering.orthogonal_members(t.embeddings, "vec_id", "embedding", 0.12).select("vec_id", "label")


@query("GRA-03", "SELECT 's' || s_suppkey AS tail_id, 'n' || s_nationkey AS head_id FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation", views=False)
def checked_hierarchy(t: Tables) -> DataFrame:
    """All ids known, and edges of a cycle between two regions dropped."""
    name = lambda letter, column: F.concat(F.lit(letter), F.col(column))
    a = t.supplier.select(name("s", "s_suppkey").alias("tail_id"), name("n", "s_nationkey").alias("head_id"))
    b = t.nation.select(name("n", "n_nationkey").alias("tail_id"), name("r", "n_regionkey").alias("head_id"))
    cycle = t.spark.createDataFrame([("r0", "r1"), ("r1", "r0")], "tail_id string, head_id string")
    nodes = a.select(F.col("tail_id").alias("id")).union(b.select("tail_id")).union(t.region.select(name("r", "r_regionkey")))
    return graph.without_cycles(graph.checked(a.union(b).union(cycle), nodes)).select("tail_id", "head_id")


@query("AGG-27 VEC-04 ETL-19", "SELECT owner_id, i, round(avg(x), 6) AS x FROM (SELECT owner_id, kind, i, avg(x) AS x FROM (SELECT label AS owner_id, vec_id % 2 AS kind, CAST(unnest(range(0, 64)) AS INTEGER) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1, 2, 3) GROUP BY 1, 2", views=False)
def owner_mean_vectors(t: Tables) -> DataFrame:
    typed = t.embeddings.select(F.col("label").alias("owner_id"), F.when(F.col("vec_id") % 2 == 0, "patent").otherwise("trial").alias("doc_type"), "embedding")
    return etl.owner_vectors(typed, "owner_id", "embedding").select("owner_id", F.posexplode("vector").alias("i", "x")).select("owner_id", "i", F.round("x", 6).alias("x"))
