import base64
import gzip
import hashlib
import io

from pyspark.sql import functions as F

from gridlogic.llm import common
from gridlogic.llm import warc as W

PAGES = "page_id long, url string, html string, payload string"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows, min_bytes=0):
    first = {}
    for i, _, html, *_ in rows:
        if i is not None and len((html or "").encode()) >= min_bytes:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        f = first.get(html or "")
        again = f is not None and f != i and len(data) >= min_bytes
        out.append((i, len(data), digest(data), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def read_back(spark, path):
    back = W.read_warc(spark, path)
    return sorted((tuple(r) for r in back.select(W.page_of(F.col("record_id")), "payload_length", F.substr("payload_digest", F.lit(6)), "record_type", W.page_of(F.col("refers_to"))).collect()), key=str)


ROWS = [
    (5, "http://a/é", "<p>same</p>", "p"), (3, None, "<p>same</p>", "p"), (9, "http://b\r\nX: y", "", "p"), (8, "u", None, "p"), (None, "u", "<p>same</p>", "p"),
    (7, "u", "x" * 3_000_000, "p"), (None, "v", "alone", "p"), (None, "v", "alone", "p"), (3, "u", "<p>same</p>", "p"), (11, "u", "WARC/1.1\r\n\r\n\r\n", "p"), (12, "u", "日本\n" * 5000, "p"),
    (20, "http://c", "long enough", "p"), (21, "http://d", "abc", "p"), (22, "http://c", "long enough", "p"),
]


def test_pages_come_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, PAGES)
    for n in (0, 5):
        path = f"file://{tmp_path}/a{n}"
        W.write_warc(W.page_records(df, n), path)
        assert read_back(spark, path) == expected(ROWS, n)
    W.write_warc(W.page_records(df.limit(0)), f"file://{tmp_path}/none")
    assert W.read_warc(spark, f"file://{tmp_path}/none").collect() == []


def test_appends_stay_and_overwriting_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/two"
    halves = [spark.createDataFrame(part, PAGES) for part in (ROWS[:4], ROWS[4:])]
    for half in halves:
        W.write_warc(W.page_records(half), path)
    assert read_back(spark, path) == sorted([*expected(ROWS[:4]), *expected(ROWS[4:])], key=str)
    W.write_warc(W.page_records(halves[0]), path, mode="overwrite")
    assert read_back(spark, path) == expected(ROWS[:4])
    assert len(list((tmp_path / "two").glob("*.warc.gz"))) == len(W.manifest(W.fs.LocalFileSystem(), str(tmp_path / "two")))


def test_a_payload_of_half_the_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = [(i, f"u{i % 3}", "same" if i % 2 else f"own {i}", "p") for i in range(600)]
    W.write_warc(W.page_records(spark.createDataFrame(rows, PAGES)), f"file://{tmp_path}/hot")
    assert read_back(spark, f"file://{tmp_path}/hot") == expected(rows)


def test_filters_reach_the_reader_and_payloads_stay_packed(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    W.write_warc(W.page_records(spark.createDataFrame(ROWS, PAGES)), path)
    back = W.read_warc(spark, path)
    plan = back.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # nothing is left for Spark to test
    revisits = back.where("record_type = 'revisit'").collect()
    assert len(revisits) == sum(x[3] == "revisit" for x in expected(ROWS)) and all(r.payload is None for r in revisits)
    some = back.where("record_type in ('response') and target_uri like 'http%' and payload_length > 3")
    assert {r.record_id for r in some.collect()} == {"<urn:page:20>"}
    either = back.where("record_type = 'revisit' or payload_length = 3")  # cannot be pushed
    assert {r.record_id for r in either.where("target_uri like 'http://%'").collect()} == {"<urn:page:5>", "<urn:page:9>", "<urn:page:21>", "<urn:page:22>"}
    assert back.where("target_uri is null").count() == 1
    lengths = {r.record_id: r.payload_length for r in W.read_warc(spark, path, payload="false").collect()}
    assert lengths["<urn:page:7>"] == 3_000_000
    files = [f for f in (tmp_path / "b").iterdir() if f.name.endswith(".warc.gz")]
    for f in files:
        raw = f.read_bytes()
        source = W.Source(io.BytesIO(raw), len(raw))
        wanted = list(W.records(source, [W.EqualTo(("record_type",), "nothing")]))
        assert wanted == [] and source.inflated == 0


def test_plain_and_foreign_gzip_files(spark, tmp_path):
    rows = [{"record_type": "response", "record_id": f"<urn:page:{i}>", "target_uri": "u", "date": W.DATE, "payload_digest": "sha1:" + digest(p), "refers_to": None, "payload_length": len(p), "payload": p} for i, p in enumerate([b"one", b"", b"z" * 200_000])]
    records = [W.record(r) for r in rows]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(W.member(r) for r in records))
    assert b"".join(records) == gzip.decompress((tmp_path / "c.warc.gz").read_bytes())
    got = W.read_warc(spark, f"file://{tmp_path}").collect()
    assert sorted((r.record_id, bytes(r.payload)) for r in got) == sorted((r["record_id"], r["payload"]) for r in rows for _ in range(3))
    assert sorted(r.payload_length for r in W.read_warc(spark, f"file://{tmp_path}", payload="false", splitBytes="1").collect()) == sorted(len(r["payload"]) for r in rows for _ in range(3))


def test_query_over_the_small_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    assert sorted(map(str, (tuple(r) for r in W.query(spark, d).collect()))) == sorted(map(str, expected(rows)))


def record(i, payload):
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:r:{i}>\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return head + payload + b"\r\n\r\n"


def test_several_records_in_a_gzip_member():
    payloads = [b"a", b"", b"WARC/1.1\r\n\r\n" * 3, b"x" * 300_000, b"\r\n\r\n", b"end"]
    whole = [record(i, p) for i, p in enumerate(payloads)]
    for data in (gzip.compress(b"".join(whole)), gzip.compress(whole[0] + whole[1]) + gzip.compress(b"") + gzip.compress(b"".join(whole[2:])), b"".join(map(gzip.compress, whole)), b"".join(whole)):
        read = list(W.records(W.Source(io.BytesIO(data), len(data))))
        assert [r[-1] for r in read] == payloads
        source = W.Source(io.BytesIO(data), len(data))
        lengths = []
        while (head := source.head()) is not None:
            lengths.append(int(head["content-length"]))
            source.skip()
        assert lengths == [len(p) for p in payloads] and source.inflated == 0
