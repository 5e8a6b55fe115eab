import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import nested
from lodestone.operators import classify, clustering, companies, entities, etl, graph, linking, owners, reports, scoring, search
from lodestone.sources import sql


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "description, days",
    [
        ("From Day 0 up to Year 2", 730),
        ("Change between baseline and follow-up at 26-weeks", 182),
        ("Day 1 of Part A up to Week 24 of Part B", 168),
        ("Date of enrollment to study completion (Date of 5 year follow-up, withdrawal or death).", 1825),
        ("at 12-month visit", 360),
        ("Week 0, Week 26 and Week 52", 364),
        ("Weeks 0-26 and Weeks 0-52", 364),
        ("Efficacy Expansion: Baseline up to Day 1072", 1072),
        ("Duration of hospital stay (average 3.4 days)", 4),
        ("At Day 15, 29, 43, 57, 71, 85, 99, 127 and 169", 169),
        ("At Day 10000, 15, 29, 43, 57, 71, 85, 99, 127 and 169", 10000),
        ("At Day 1, 999, 15, 29, 43, 57, 71, 85, 99, 127 and 169", 999),
        ("415days", 415),
        ("3 Years", 1095),
        ("One year after the last patient is randomized", 365),
        ("Cycle 1 Day -3: Predose, 1, 2, 4, 6, 8, 10, 24, 48 and 72 hours (hr) postdose; Cycle 1 Day 28: Predose, 1, 2, 4, 6, 8, 10 and 24 hr postdose (Cycle 1 = 32 days)", 32),
        ("no time here", None),
        (None, None),
    ],
)
def test_timeframes(spark, description, days):
    assert value(spark, classify.timeframe_days(F.lit(description).cast("string"))) == days


def test_trial_design(spark):
    def of(design, title="t", phase="PHASE_2", rand="NA", mask="NONE", comparison="UNKNOWN", arms=1):
        return value(spark, classify.trial_design(*[F.lit(v) for v in (design, title, phase, rand, mask, comparison, arms)]))

    assert of("Single Group Assignment") == "SINGLE_GROUP"
    assert of("Single Group Assignment", rand="RANDOMIZED") == "PARALLEL"
    assert of("Single Group Assignment", mask="DOUBLE") == "PARALLEL"
    assert of("Single Group Assignment", arms=3) == "PARALLEL"
    assert of("Single Group Assignment", comparison="PLACEBO") == "PARALLEL"
    assert of("Crossover Assignment", title="A Dose-ranging study", phase="PHASE_1") == "DOSING"
    assert of("nonsense") == "UNKNOWN"


def test_keyword_classes_strict_and_not(spark):
    df = spark.createDataFrame([(1, "lack of efficacy"), (2, "nothing"), (3, None)], "id long, s string")
    words = {"FUTILITY": ["lack of efficacy"], "SAFETY": ["toxicity"]}
    loose = {r["id"]: r["classes"] for r in classify.keyword_classes(df, "id", "s", words, "OTHER").collect()}
    assert loose == {1: ["FUTILITY"], 2: ["OTHER"], 3: ["OTHER"]}
    strict = {r["id"]: r["classes"] for r in classify.keyword_classes(df, "id", "s", words, "OTHER", strict=True).collect()}
    assert strict[1] == ["FUTILITY", "OTHER"]


def test_owner_type_by_rank(spark):
    df = spark.createDataFrame([(1, "Big University Hospital"), (2, "Acme Pharma Inc"), (3, "Xyz")], "id long, n string")
    assert {r["id"]: r["owner_type"] for r in classify.owner_type(df, "id", "n", large=["acme"]).collect()} == {1: "HEALTH_SYSTEM", 2: "INDUSTRY_LARGE", 3: "OTHER"}


@pytest.mark.parametrize("types, expected", [(["Device", "Drug"], "PHARMACOLOGICAL"), (["Other"], "OTHER"), ([], "UNKNOWN"), (["Radiation", "Dietary Supplement"], "PROCEDURE")])
def test_intervention_type(spark, types, expected):
    assert value(spark, classify.intervention_type(F.array(*map(F.lit, types)).cast("array<string>"))) == expected


def test_suitability(spark):
    df = spark.createDataFrame([(["COMPOUND_OR_MECHANISM", "novel"],), (["DEVICE"],), ([],)], "a array<string>")
    got = [r["v"] for r in df.select(scoring.suitability(F.col("a")).alias("v")).collect()]
    assert got == pytest.approx([30.5 / 33, 0.0, 26 / 33])
    assert df.select(scoring.explanation(F.col("a")).alias("v")).first()["v"] == "COMPOUND_OR_MECHANISM: 3, NOVEL: 1.5"


def test_row_and_document_scope(spark):
    view = spark.createDataFrame([(1, ["red"]), (1, ["widget"]), (2, ["red", "widget"])], "doc_id long, search array<string>")
    ids = lambda **k: sorted(r["doc_id"] for r in search.doc_ids_for_terms(view, ["red", "widget"], "AND", **k).collect())
    assert ids() == [2]
    assert ids(scope="doc") == [1, 2]
    with pytest.raises(ValueError):
        search.doc_ids_for_terms(view, ["x"])


def test_absent_branches_do_not_match_everything(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    one = spark.createDataFrame([(1,)], "doc_id long")
    assert search.matching_docs(docs, term_ids=one, query_type="OR").count() == 1
    assert search.matching_docs(docs).count() == 2


def test_ids_must_be_of_one_type():
    assert search.id_search_kind(["NCT01234567"]) == "trial"
    with pytest.raises(ValueError):
        search.id_search_kind(["NCT01234567", "WO-123"])


def test_newest_first_puts_missing_dates_first(spark):
    df = spark.createDataFrame([(1, "2020-01-01"), (2, None), (3, "2021-01-01")], "doc_id long, d string").select("doc_id", F.col("d").cast("timestamp_ntz").alias("doc_date"))
    assert [r["doc_id"] for r in search.newest_first(df, 3).collect()] == [2, 3, 1]


def test_top_k_ties_and_zero_vectors(spark):
    from lodestone.functions import vectors

    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    assert [r["id"] for r in vectors.nearest(df, "v", [1.0, 0.0], 1, "id").collect()] == [1]


def test_gap_filled(spark):
    report = spark.createDataFrame([("a", 1, 5), ("b", 2, 7)], "x string, y long, count long")
    assert {(r.x, r.y): r["count"] for r in reports.gap_filled(report).collect()} == {("a", 1): 5, ("a", 2): 0, ("b", 1): 0, ("b", 2): 7}
    with pytest.raises(ValueError):
        reports.counts(report, "no such")


def test_families_without_id_stay_apart(spark):
    df = spark.createDataFrame([(1, None, [1.0]), (2, None, [1.0]), (3, 7, [1.0]), (4, 7, [1.0])], "doc_id long, family long, v array<double>").withColumn("doc_date", F.lit("2020-01-01").cast("timestamp_ntz"))
    assert sorted(r["doc_id"] for r in companies.top_docs(df, "v", [1.0], 10, family="family").collect()) == [1, 2, 4]


def test_is_troubled_says_no_on_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None, None), (5.0, -10.0, 2.0, 1.0, 0.2), (50.0, 0.0, 0.5, 1.0, 0.2)], "market_cap double, net_debt double, current_ratio double, debt_equity_ratio double, return_on_equity double")
    assert [r["v"] for r in df.select(companies.is_troubled(df).alias("v")).collect()] == [False, True, True]


def test_dropout_and_means(spark):
    df = spark.createDataFrame([(10, 2), (0, 1), (5, 9), (None, 3)], "e long, d long")
    got = df.agg(entities.dropout_ratio(F.col("d"), F.col("e")).alias("r"), entities.rounded_mean(F.col("e")).alias("m")).first()
    assert got["r"] == 0.2 and got["m"] == 5
    assert spark.createDataFrame([(2,), (3,)], "e long").agg(entities.rounded_mean(F.col("e")).alias("m")).first()["m"] == 2


def test_descendant_counts_of_a_diamond(spark):
    edges = spark.createDataFrame([("top", "a"), ("top", "b"), ("a", "leaf"), ("b", "leaf")], "head_id string, tail_id string")
    counts = spark.createDataFrame([("leaf", 1000), ("a", 5), ("b", 7)], "node string, count long")
    got = {r["node"]: r["count"] for r in graph.descendant_counts(edges, counts).collect()}
    assert got == {"leaf": 1000, "a": 1005, "b": 1007, "top": 1012}


def test_levels_take_the_higher_where_paths_disagree(spark):
    edges = spark.createDataFrame([("top", "a"), ("top", "leaf"), ("a", "leaf")], "head_id string, tail_id string")
    counts = spark.createDataFrame([("leaf", 10), ("a", 60), ("top", 100)], "node string, count long")
    got = {r["node"]: r["level"] for r in graph.assigned_levels(edges, counts, [0.1, 0.5, 0.9]).collect()}
    assert got == {"leaf": "INSTANCE", "a": "L1_CATEGORY", "top": "L2_CATEGORY"}


def test_ancestors_end_in_a_cycle(spark):
    edges = spark.createDataFrame([("b", "a"), ("a", "b")], "head_id string, tail_id string")
    got = {(r.node, r.ancestor): r.depth for r in graph.ancestors(edges, max_depth=4).collect()}
    assert got == {("a", "b"): 1, ("b", "a"): 1, ("a", "a"): 2, ("b", "b"): 2}
    assert graph.without_cycles(edges).count() == 0


def test_rollup_choice_and_missing_grandparent(spark):
    nodes = spark.createDataFrame([("x", "INSTANCE", "d"), ("p", "L1_CATEGORY", "d"), ("q", "SUBINSTANCE", "d"), ("z", "L1_CATEGORY", "other")], "node string, level string, type string")
    edges = spark.createDataFrame([("p", "x"), ("q", "x"), ("z", "x")], "head_id string, tail_id string")
    scores = spark.createDataFrame([("d", "d", 2)], "child_type string, ancestor_type string, score int")
    got = {r["node"]: r["rollup"] for r in graph.chosen_rollup(edges, nodes, scores).collect()}
    assert got["x"] == "p" and got["p"] == "p"
    parents = spark.createDataFrame([(1, 2, "two")], "child long, parent long, parent_name string")
    one = graph.two_hop_rollup(spark.createDataFrame([(1, "one"), (9, "nine")], "entity_id long, name string"), parents)
    assert {r.name: (r.instance_rollup, r.category_rollup) for r in one.collect()} == {"one": ("two", "two"), "nine": ("nine", "nine")}


def test_term_clusters_name_the_most_frequent(spark):
    df = spark.createDataFrame([("pfizer inc", 10), ("pfizer", 30), ("pfizer labs", 2), ("unrelated words", 1)], "term string, count long")
    got = {r["term"]: r["canonical"] for r in clustering.term_clusters(df, eps=0.7).collect()}
    assert got["pfizer inc"] == got["pfizer labs"] == "pfizer"
    assert got["unrelated words"] == "other"


def test_dictionary_entities_longest_wins(spark):
    docs = spark.createDataFrame([(1, "Chronic kidney disease and kidney."), (2, None), (3, "")], "doc_id long, text string")
    terms = spark.createDataFrame([("kidney",), ("kidney disease",), ("chronic kidney disease",)], "term string")
    got = sorted((r.doc_id, r.start, r.term) for r in linking.dictionary_entities(docs, terms).collect())
    assert got == [(1, 1, "chronic kidney disease"), (1, 5, "kidney")]


def test_linking_prefers_overrides_and_falls_back(spark):
    mentions = spark.createDataFrame([("Aspirin",), ("None such",), ("X",)], "term string")
    canonical = spark.createDataFrame([("aspirin", 5, "A5"), ("aspirin", 2, "A2"), ("x", 1, "one")], "term string, canonical_id long, canonical_name string")
    overrides = spark.createDataFrame([("x", 9, "nine")], "term string, canonical_id long, canonical_name string")
    got = {r.term: (r.canonical_id, r.canonical_name) for r in linking.linked(mentions, canonical, overrides).collect()}
    assert got == {"Aspirin": ("2", "A2"), "None such": ("none such", "none such"), "X": ("9", "nine")}


def test_upsert_keeps_values_that_nulls_would_overwrite(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    n = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    assert {r.k: r.v for r in etl.upsert(t, n, ["k"], ["v"]).collect()} == {1: "a", 2: "b", 3: "c"}


def test_nested_gives_empty_arrays(spark):
    p, c = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, 5)], "k long, v long")
    assert {r.k: [x.v for x in r.kids] for r in etl.nested(p, c, "k", "kids", ["v"]).collect()} == {1: [5], 2: []}


def test_reassigned_in_order(spark):
    df = spark.createDataFrame([("a", "X"), ("b", "X")], "term string, domain string")
    got = {r.term: r.domain for r in etl.reassigned(df, "term", "domain", [("a", "X", "Y"), ("a", "Y", "Z"), ("b", "X", "")]).collect()}
    assert got == {"a": "Z"}


def test_recency_score(spark):
    assert value(spark, companies.recency_score(F.lit(0.5), F.lit(2024), 2000)) == pytest.approx(0.5)
    assert value(spark, companies.recency_score(F.lit(0.5), F.lit(1990), 2000)) == 0.0
    assert math.isclose(value(spark, linking.candidate_score(F.lit(0.8), F.lit(0.4), F.lit(None).cast("double"), F.lit(9))), (0.6 + 0.1) * 0.7 * 1.05)


def test_long_chains_are_not_cut(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(60)], "head_id string, tail_id string")
    assert graph.without_cycles(edges).count() == 60
    counts = spark.createDataFrame([(f"n{i}", 1) for i in range(61)], "node string, count long")
    assert {r["node"]: r["count"] for r in graph.descendant_counts(edges, counts).collect()}["n0"] == 61


def test_a_hierarchy_needs_edges_of_known_ids(spark):
    edges = spark.createDataFrame([("a", "b")], "head_id string, tail_id string")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert graph.checked(edges, nodes).count() == 1
    with pytest.raises(ValueError):
        graph.checked(edges.limit(0), nodes)
    with pytest.raises(ValueError, match="b"):
        graph.checked(edges, nodes.limit(1))


def test_only_wanted_relationships_are_followed(spark):
    edges = spark.createDataFrame([("p", "c", "isa"), ("q", "c", "process_involves_gene"), ("r", "p", "mapped_to")], "head_id string, tail_id string, relationship string")
    seeds = spark.createDataFrame([("c",)], "node string")
    got = {(r["node"], r["ancestor"], r["depth"]) for r in graph.ancestors(edges, seeds, 5, graph.RELATIONSHIPS).collect()}
    assert got == {("c", "p", 1), ("c", "r", 2)}


def test_terms_of_five_words_are_found(spark):
    docs = spark.createDataFrame([(1, "One of the very long names here, one of the others"), (2, None), (3, "")], "doc_id long, text string")
    terms = spark.createDataFrame([("of the very long names",), ("one of",), ("the",), ("",), (None,)], "term string")
    got = sorted((r.doc_id, r.start, r.length, r.term) for r in linking.dictionary_entities(docs, terms).collect())
    assert got == [(1, 2, 5, "of the very long names"), (1, 8, 2, "one of"), (1, 10, 1, "the")]


# Names and what they stand for.
OWNER_TYPES = {
    "mayo clinic": "HEALTH_SYSTEM", "albert einstein college medicine": "UNIVERSITY", "wisconsin university": "UNIVERSITY", "pfizer": "INDUSTRY_LARGE",
    "random co, inc": "INDUSTRY", "us government": "GOVERNMENTAL", "random llc": "INDUSTRY", "bristol university research foundation": "UNIVERSITY",
}


def test_owner_types(spark):
    rows = spark.createDataFrame([(n, n) for n in OWNER_TYPES], "id string, name string")
    assert {r["id"]: r["owner_type"] for r in owners.owner_types(rows, "id", "name").collect()} == OWNER_TYPES


def test_owner_names(spark):
    # Names and the owners they are known by.
    known = {
        "Pfizer Inc": "pfizer", "PFIZER R&D UK LTD": "pfizer", "BioGen Ma": "biogen", "Astrazeneca China": "astrazeneca", "ASTRAZENECA (CHINA) CO LTD": "astrazeneca", "US GOV NAT INST HEALTH": "us government", "siemens ag gmbh": "siemens", "NOVO NORDISK HEALTHCARE AG": "novo nordisk",
        "Genentech, Inc.": "roche", "JANSSEN PHARMACEUTICA N V": "johnson & johnson", "THE PROCTER & GAMBLE COMPANY": "procter and gamble", "Matsushita Electric Ind Co Ltd": "matsushita", "MERCK & CO INC": "merck",
    }
    names = spark.createDataFrame([(n, 1) for n in known], "name string, count long")
    assert {r["name"]: r["canonical"] for r in owners.canonical_owners(names, cluster=False).collect()} == known
    cleaned = {r["name"]: r["cleaned"] for r in owners.canonical_owners(spark.createDataFrame([("Charles River Lab", 1), ("BBOB Labs", 1), ("MO R & D INC", 1), ("THE UNIV OF TORONTO", 1)], "name string, count long"), cluster=False).collect()}
    assert cleaned == {"Charles River Lab": "charles river laboratory", "BBOB Labs": "bbob laboratory", "MO R & D INC": "mo research and development inc", "THE UNIV OF TORONTO": "university of toronto"}


def test_owner_clusters(spark):
    rows = [("Charles River Laboratories Inc", 1), ("Charles River Lab", 2), ("Charles River Laboratories", 1), ("university of colorado", 2), ("university of colorado, denver", 1), ("one of a kind gizmos", 1)]
    got = {r["name"]: r["canonical"] for r in owners.canonical_owners(spark.createDataFrame(rows, "name string, count long")).collect()}
    assert {got["Charles River Lab"], got["Charles River Laboratories"]} == {"charles river laboratory"}
    assert got["one of a kind gizmos"] == "other"


def test_deep_merge(spark):
    kind = "map<string,map<string,array<int>>>"
    df = spark.createDataFrame([({"a": {"a1": [1]}, "b": {"a1": [2]}}, {"a": {"a1": [3]}, "b": {"a1": [4]}, "c": {"x": [5]}}), (None, {"a": {"a1": [1]}})], f"x {kind}, y {kind}")
    got = [r["m"] for r in df.select(nested.merged(F.col("x"), F.col("y"), df.schema["x"].dataType).alias("m")).collect()]
    assert got == [{"a": {"a1": [1, 3]}, "b": {"a1": [2, 4]}, "c": {"x": [5]}}, {"a": {"a1": [1]}}]


def test_rows_of_sql_text(spark):
    seen = []
    t = spark.range(25)
    assert sql.select(spark, "SELECT id FROM {t} WHERE id < 3 ORDER BY id", tables={"t": t}) == [{"id": 0}, {"id": 1}, {"id": 2}]
    assert sql.select(spark, "SELECT id FROM {t}", seen.append, 10, {"t": t}) == [] and sorted(map(len, seen)) == [5, 10, 10]
    tries = []

    def third_time():
        tries.append(1)
        return 1 / (len(tries) // 3)

    assert sql.retried(third_time, wait=0) == 1 and len(tries) == 3
    with pytest.raises(ZeroDivisionError):
        sql.retried(lambda: 1 / 0, tries=2, wait=0)


def test_close_vectors_against_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(80)]
    got = {(r.u, r.v) for r in clustering.close_vectors(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.15).collect()}
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5 / 6**0.5
    assert got == {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if far(a, b) < 0.15} and got
