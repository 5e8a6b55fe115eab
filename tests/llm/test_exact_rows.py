import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from lodestone.llm import exact_dedup, queries

ROWS = [(1, "copy", "a"), (3, "copy", "b"), (3, "copy", "b"), (3, "copy", "c"), (None, "copy", "d"), (None, "nulls", "e"), (None, "nulls", "f"), (None, "nulls", "f"), (7, "same row", "g"), (7, "same row", "g"), (8, None, "h"), (9, "", "i"), (10, "alone", "j"), (None, "one null", "k")]


def test_op2_has_every_row_as_its_sql_says(spark, tmp_path):
    table = pa.table({"doc_id": pa.array([r[0] for r in ROWS], pa.int64()), "text": pa.array([r[1] for r in ROWS], pa.string())})
    pq.write_table(table, tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    found = con.execute(queries.ORACLE["op2_exact_dedup"])
    columns = [d[0] for d in found.description]
    got = sorted((tuple(r[c] for c in columns) for r in queries.op2_exact_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert len(got) == len(ROWS) and got == sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize("broadcast_groups", [500_000, -1])
def test_exact_stage_leaves_one_row_of_each_text(spark, monkeypatch, broadcast_groups):
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", broadcast_groups)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, _sha string")
    got = sorted(((r.doc_id, r.text or "") for r in corpus_pipeline.exact_once(spark, docs, "").collect()), key=repr)
    assert got == sorted([(3, "copy"), (None, "nulls"), (7, "same row"), (9, ""), (10, "alone"), (None, "one null")], key=repr)
