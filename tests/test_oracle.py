"""Every query with SQL against DuckDB on the same files: columns, types and rows."""

import datetime
import decimal

import duckdb
import pytest

from lodestone.plans import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_same_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name].run(spark, sf_dir)
    found = duck.execute(QUERIES[name].sql)
    kinds = {d[0]: str(d[1]) for d in found.description}
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    assert rows(df.columns, df.collect()) == rows([d[0] for d in found.description], found.fetchall())


def test_assigned_levels(spark, sf_dir):
    rows = QUERIES["assigned_levels"].run(spark, sf_dir).collect()
    levels = {r["node"]: r["level"] for r in rows}
    order = ["SUBINSTANCE", "INSTANCE", "L1_CATEGORY", "L2_CATEGORY", "L3_CATEGORY", "L4_CATEGORY", "L5_CATEGORY"]
    assert len(levels) == len(rows) and {levels[n] for n in levels if n[0] == "s"} == {"INSTANCE"}
    assert all(order.index(levels[n]) >= 1 for n in levels) and any(n[0] == "r" for n in levels)


def test_clusters_topics_bins_and_vectors(spark, sf_dir):
    names = {r["term"]: r["canonical"] for r in QUERIES["term_clusters"].run(spark, sf_dir).collect()}
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    assert set(names) == {r["p_name"] for r in part.select("p_name").distinct().collect()} and set(names.values()) <= {*names, "other"}
    topics = QUERIES["vector_topics"].run(spark, sf_dir).collect()
    assert len({r["vec_id"] for r in topics}) == len(topics) and 1 < len({r["topic"] for r in topics}) <= 10
    bins = {r["p_partkey"]: r["bin"] for r in QUERIES["binned_values"].run(spark, sf_dir).collect()}
    price = {r["p_partkey"]: r["p_retailprice"] for r in part.collect()}
    assert set(bins) == set(price) and set(bins.values()) == set(range(5))
    ordered = sorted(price, key=price.get)
    assert [bins[k] for k in ordered] == sorted(bins.values())
    squares = {}
    for r in QUERIES["hashed_text_vectors"].run(spark, sf_dir).collect():
        squares[r["item_id"]] = squares.get(r["item_id"], 0) + r["x"] ** 2
    assert all(abs(v - 1) < 1e-9 or v == 0 for v in squares.values())


def test_outcomes_and_companies(spark, sf_dir):
    metrics = {r["metric"]: r["value"] for r in QUERIES["outcome_metrics"].run(spark, sf_dir).collect()}
    assert set(metrics) == {"accuracy", "weightedPrecision", "weightedRecall", "mae"} and all(0 <= metrics[m] <= 1 for m in metrics if m != "mae") and metrics["mae"] >= 0
    found = QUERIES["request_companies"].run(spark, sf_dir).collect()
    assert found and [(-r["score"], r["owner_id"]) for r in found] == sorted((-r["score"], r["owner_id"]) for r in found)


def test_every_query_without_sql_is_held_to_results():
    assert {n for n, q in QUERIES.items() if not q.sql} == {"assigned_levels", "term_clusters", "vector_topics", "binned_values", "hashed_text_vectors", "outcome_metrics", "request_companies"}


def test_plans_have_no_nested_loops_over_data(spark, sf_dir):
    for name in ("company_finder", "characteristics_graph", "trigram_similarity", "time_report_gapfill", "unpivoted_owner_join"):
        plan = QUERIES[name].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "Cartesian" not in plan and "PythonUDF" not in plan, name


def test_year_range_reaches_the_scan(spark, sf_dir):
    plan = QUERIES["matching_in_years"].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
