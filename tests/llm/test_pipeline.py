import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from lodestone.llm import queries, similar

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    columns, before = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir).cache()
        seen[name] = (before, after)
        before = after
    for name, (old, new) in list(seen.items())[:-1]:
        assert new.columns == columns and new.exceptAll(old).count() == 0, name
    texts = {r.doc_id: r.text for r in seen["exact dedup"][0].collect()}
    kept = {r.doc_id for r in seen["exact dedup"][1].collect()}
    assert kept == {max(i for i, u in texts.items() if u == t) for t in texts.values()}
    left = {r.doc_id: set(similar.shingle_set(r.text.encode()).tolist()) for r in seen["SimHash near-dedup"][0].collect()}
    label = {i: i for i in left}
    for _ in range(5):
        for i in left:
            label[i] = min(label[j] for j in left if 5 * len(left[i] & left[j]) >= 4 * len(left[i] | left[j]))
    assert {r.doc_id for r in seen["SimHash near-dedup"][1].collect()} == {i for i, c in label.items() if i == c}
    old, new = seen["mixing sources"]
    assert sorted(r.doc_id for r in old.collect()) == sorted(r.doc_id for r in new.collect())
    packed = seen["best-fit packing"][1]
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in new.collect()}


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and "sequence_id" in out.columns


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    found = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in found.description]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted(found.fetchall(), key=repr)


def test_entry_works_without_the_subpackage(tmp_path):
    for name in ("lodestone", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "lodestone" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)


def test_stages_take_odd_rows(spark, tmp_path):
    good = [f"The {a} house stood by the {b} river and nobody had been there for a long time number {i}." for i, (a, b) in enumerate((x, y) for x in ("old", "white", "far", "tall") for y in ("wide", "cold", "green"))]
    rows = [(i, t, "en", f"s{i % 2}", "x") for i, t in enumerate(good)] + [(0, good[0], "en", "s0", "x"), (None, good[1], None, None, None), (50, None, None, None, "y"), (51, "", "en", "s1", "y"), (52, good[2], "en", "s1", "z"), (53, good[3] + " indeed", None, "s0", "z"), (54, "word " * 30_000, "en", "s0", "z")]
    schema = "doc_id long, text string, lang string, source string, _row string"
    spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(50, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(str(tmp_path / name))
        docs = stage(spark, spark.read.parquet(str(tmp_path / name)), str(tmp_path))
    packed = docs.collect()
    # With one value of the label all stays: of equal texts the largest id, of near ones the least, texts without words once.
    assert {r.doc_id for r in packed} == {0, 1, 3, 52, *range(4, 12), 51, 54} and {r.length for r in packed if r.doc_id == 51} == {1}
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0, name
