import json

import pytest

from lodestone.sources import files, tables
from lodestone.streaming import events


def test_table_store(spark):
    store = tables.TableStore(spark)
    store.create("t", "a long")
    with pytest.raises(ValueError):
        store.create("t", "a long", exists_ok=False)
    store.append("t", spark.range(3).withColumnRenamed("id", "a"))
    store.insert("t", spark.range(2).withColumnRenamed("id", "a"), lambda df: df.filter("a > 0"))
    assert store.read("t").count() == 4
    store.create("t", "a long", truncate=True)
    assert store.read("t").count() == 0
    store.drop("t")
    assert not store.exists("t")


def test_result_cache_serves_smaller_limits(spark):
    asked = []

    def operation(limit):
        asked.append(limit)
        return spark.range(limit or 10)

    cache = tables.ResultCache(tables.TableStore(spark))
    assert cache.get("k", operation, 5).count() == 5
    assert cache.get("k", operation, 3).count() == 3
    assert cache.get("k", operation).count() == 10
    assert cache.get("k", operation, 7).count() == 7
    assert asked == [5, None]


def test_delimited_and_listings(spark, tmp_path):
    (tmp_path / "a.rrf").write_text("C1|one|\nC2||x\n")
    got = files.read_delimited(spark, str(tmp_path / "a.rrf"), "id string, name string, note string").collect()
    assert [tuple(r) for r in got] == [("C1", "one", None), ("C2", None, "x")]
    (tmp_path / "l.csv").write_text("Symbol,Name,Country,Sector\nAB,Acme Bio,US,Health Care\nCD,Cars,US,Autos\n")
    assert [tuple(r) for r in files.listed_companies(spark, [str(tmp_path / "l.csv")] * 2).collect()] == [("AB", "acme bio")] * 2


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"id": "1", "title": {"en": None, "de": "T"}, "grant_date": "0", "embeddings": [1]}))
    got = files.read_json_lines(spark, str(tmp_path / "x.json"), "id string, title map<string,string>, grant_date string, embeddings array<long>")
    assert [r.asDict() for r in got.collect()] == [{"id": "1", "title": "T", "grant_date": None}]


def test_conversations(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": [{"id": 4, "type": "standard", "content": "hi"}, {"type": "standard", "content": "yo"}]}))
    got = [tuple(r) for r in files.conversations(spark, str(tmp_path / "c.json")).orderBy("message_id").collect()]
    assert got == [("a", 1, "standard", "yo"), ("a", 4, "standard", "hi")]


def test_streams_count_every_event_once(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert events.daily_counts(spark, sf_dir).agg({"count": "sum"}).first()[0] == n
    assert events.incremental_copy(spark, sf_dir).count() == n


def test_sessions(spark):
    rows = spark.sql("SELECT 1L AS user_id, timestamp_ntz'2024-01-01 00:00:00' AS ts UNION ALL SELECT 1L, timestamp_ntz'2024-01-01 00:10:00' UNION ALL SELECT 1L, timestamp_ntz'2024-01-01 02:00:00'")
    assert sorted(r["count"] for r in events.sessions(rows).collect()) == [1, 2]


def test_daily_counts_are_the_same_in_batch_and_stream(spark, sf_dir):
    batch = events.daily(spark.read.parquet(f"{sf_dir}/events.parquet")).collect()
    assert sorted(map(tuple, batch)) == sorted(map(tuple, events.daily_counts(spark, sf_dir).select("day", "event_type", "count", "total").collect()))
