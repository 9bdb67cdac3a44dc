import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from sparkrinse.llm import warc

ODD = [
    (1, "http://a.example/x", "<p>one</p>"), (2, "http://a.example/y?q#f", "<p>one</p>"), (3, None, "größe 𝒳"), (4, "", ""), (5, "no scheme", None),
    (9, "http://b/", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (8, "http://b/\r\nWARC-Type: y", "y" * 300_000), (7, "http://c", "\r\n"),
    (7, "http://c", "\r\n"), (None, "http://d", "<p>one</p>"), (None, "http://d", "alone"), (None, "http://d", "alone"), (6, "http://c", "\r\n\r\n"),
]


def expected(rows, least=0):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        first = min((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        response = len(payload) < least or first is None or first == page
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "response" if response else "revisit", None if response else first))
    return sorted(out, key=str)


def kind(row, least):
    size = len((row[2] or "").encode())
    return next(e[3] for e in expected(ODD, least) if e[:2] == (row[0], size))


@pytest.mark.parametrize("least, per_file", [(0, 20_000), (8, 2)])
def test_round_trip(spark, tmp_path, least, per_file):
    df = spark.createDataFrame([(*r, 1, "z") for r in ODD], "page_id long, url string, html string, id int, block string").repartition(3)
    path = str(tmp_path / "w")
    warc.write_warc(df, path, least_bytes=least, captures_per_file=per_file)
    records = warc.read_warc(spark, path)
    found = warc.captures(records)
    assert sorted((tuple(r) for r in warc.payload_report(found).collect()), key=str) == expected(ODD, least)
    whole = found.collect()
    assert len(whole) == len(ODD)
    assert all(len(r.requests) == len(r.metadata) == 1 for r in whole)
    bodies = sorted(bytes(r.response.block).partition(b"\r\n\r\n")[2].decode() for r in whole if r.response.record_type == "response")
    assert bodies == sorted(row[2] or "" for row in ODD if kind(row, least) == "response")
    assert all(r.named_digest == "sha1:" + r.payload_digest for r in records.filter("record_type = 'response'").collect())
    # Anyone else's reader sees the same records: frames of exactly the stated length.
    for name in glob.glob(path + "/part-*"):
        data = gzip.open(name).read()
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            size = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.startswith(b"Content-Length")))
            assert data[size:size + 4] == b"\r\n\r\n"
            data = data[size + 4:]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"))
    assert warc.payload_report(warc.captures(warc.read_warc(spark, str(tmp_path / "w")))).count() == 0


def test_foreign_archive(spark, tmp_path):
    def record(kind, name, to=(), block=b"b", kept="\r\n"):
        lines = [f"warc-type: {kind}", f"WARC-Record-ID:  <{name}>", *[f"WARC-Concurrent-To: <{t}>" for t in to], f"content-length: {len(block)}"]
        return (kept.join(["WARC/1.0", *lines, "", ""])).encode() + block + b"\r\n\r\n"

    plain = record("warcinfo", "i") + record("response", "r", kept="\n") + record("metadata", "m1", ["q"]) + record("metadata", "m2", ["r"], b"")
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("request", "q", ["r"])) + gzip.compress(record("metadata", "m3", ["lost"])) + gzip.compress(record("request", "alone")))
    rows = {r.capture_id: r for r in warc.captures(warc.read_warc(spark, str(tmp_path))).collect()}
    assert set(rows) == {"<r>", "<lost>", "<alone>"}
    assert [x.record_id for x in rows["<r>"].requests] == ["<q>"]
    assert sorted(x.record_id for x in rows["<r>"].metadata) == ["<m1>", "<m2>"]
    assert rows["<lost>"].response is None
    for cut, says in ((plain[:-12], "without content length"), (record("response", "r")[:-5], "ends after"), (b"<html>", "no record")):
        (tmp_path / "c.warc").write_bytes(cut)
        with pytest.raises(Exception, match=says):
            warc.read_warc(spark, str(tmp_path / "c.warc")).collect()


def test_digest(spark):
    got = spark.createDataFrame([(x,) for x in ["", "a", "größe"]], "p string").select(warc.base32_sha1(F.col("p"))).collect()
    assert [r[0] for r in got] == [base64.b32encode(hashlib.sha1(x.encode()).digest()).decode() for x in ["", "a", "größe"]]


def test_archives_read_once_more(spark, tmp_path):
    df = spark.createDataFrame(ODD, "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"))
    found = warc.captures(warc.read_warc(spark, str(tmp_path / "w")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # requests and metadata are stored by then
