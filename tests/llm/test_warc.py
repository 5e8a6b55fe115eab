import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from lodestone.llm import warc
from lodestone.llm.common import work_dir

LONG = "<html>" + "x" * 200 + "</html>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(3, "http://a/\r\nx", LONG), (1, None, LONG), (2, "http://b/", "tiny"), (4, "http://c/", "tiny"), (5, "http://d/", None), (6, "http://é/", "\r\n\r\nhöhe\r\n\r\n" * 20), (None, "http://n/", LONG), (7, "http://big/", "ab" * 3_000_000), (1, None, LONG)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("refers_to", F.lit(1))


def test_round_trip(pages):
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=repr)
    expected = []
    for p in pages.collect():
        body = (p.html or "").encode()
        again = p.html == LONG and p.page_id not in (1, None)
        expected.append((p.page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(expected, key=repr)


def test_payloads_and_pushed_predicates(spark, pages):
    manifest = warc.write_warc(pages, work_dir(spark, "t"))
    df = warc.read_warc(spark, manifest)
    rows = {r.record_id: r for r in df.filter("record_type = 'response'").collect()}
    assert rows["<urn:page:6>"].payload.decode() == "\r\n\r\nhöhe\r\n\r\n" * 20
    assert rows["<urn:page:5>"].payload == b""
    wanted = df.filter("record_type = 'response' AND target_uri LIKE 'http://c%'").select("record_id")
    assert "Filter (" not in wanted._jdf.queryExecution().executedPlan().toString()
    assert [r.record_id for r in wanted.collect()] == ["<urn:page:4>"]
    assert df.filter("record_type = 'warcinfo'").count() >= 1
    assert df.filter(F.length("target_uri") > 0).count() == 7


def test_unwanted_payloads_are_not_inflated():
    data = warc.gzip_member(warc.page_record(1, "http://a/", b"x" * 5_000_000, "d", 5_000_000, None)) + warc.gzip_member(warc.page_record(2, "http://b/", b"y", "e", 1, None))

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.taken += len(out)
            return out

    f = Counted(data)
    got = list(warc.read_records(f, True, lambda h: h["warc-target-uri"] == "http://b/", "payload"))
    assert [(g[1]["warc-record-id"], g[2]) for g in got] == [("<urn:page:2>", b"y")]
    assert Counted.taken < 3 * warc._HEAD_BYTES


def test_archives_of_others(tmp_path, spark):
    record = warc.record_bytes({"WARC-Type": "resource", "WARC-Record-ID": "<urn:x:1>", "Content-Type": "text/plain"}, b"hello")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record.replace(b"x:1", b"x:2")))
    (tmp_path / "b.warc").write_bytes(record.replace(b"x:1", b"x:3") * 2)
    got = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert sorted(r.record_id for r in got) == ["<urn:x:1>", "<urn:x:2>", "<urn:x:3>", "<urn:x:3>"]
    assert {r.payload for r in got} == {b"hello"}
    assert gzip.decompress(warc.gzip_member(record)) == record


def test_damage_is_an_error():
    member = warc.gzip_member(warc.page_record(1, "u", b"abc" * 100_000, "d", 300_000, None))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(member[: len(member) // 2]), True, lambda h: True, "payload"))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"garbage\r\n\r\nmore"), False, lambda h: True, "payload"))


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("few", [300_000, -1])
def test_spans_of_one_file_are_read_apart(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", few)
    rows = [(i, f"http://h/{i}", f"{i} " + "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(400)) if i % 5 else LONG) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_warc(pages, work_dir(spark, "t"), split_bytes=2000)
    df = warc.read_warc(spark, manifest, "digest", split_bytes=2000)
    assert df.rdd.getNumPartitions() > 10
    got = sorted((r.record_id, r.record_type) for r in df.filter("record_type != 'warcinfo'").collect())
    assert got == sorted((f"<urn:page:{i}>", "revisit" if i % 5 == 0 and i else "response") for i in range(200))
