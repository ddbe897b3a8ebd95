from __future__ import annotations

import gzip
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import warc

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


@pytest.fixture
def folder(tmp_path):
    def page(k, body, **extra):
        return warc.record("response", f"https://a.b/{k}", HTTP + body, "application/http; msgtype=response", str(k), **extra)

    other = [warc.record("metadata", None, b"WARC/1.0\r\n\r\ntricky\r\n\r\n" * 40, "application/warc-fields", f"m{k}") for k in range(5)]
    plain = [page(k, f"plain {k} é".encode()) for k in range(5)]
    (tmp_path / "a.warc").write_bytes(b"".join(x for pair in zip(other, plain, strict=True) for x in pair))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, [other[0], page(10, b"x" * 300_000), other[1], page(11, b"")])))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(warc.member, [other[2], page(12, b"sl"), other[3], page(13, b"\xff bad", X_Note="n")])))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.warc.gz").write_bytes(warc.member(page(14, b"whole")) + warc.member(page(15, b"cut off" * 999))[:-40])
    (tmp_path / "note.txt").write_text("no WARC")
    return tmp_path


def test_reads_all_kinds_of_files(spark, folder):
    got = warc.read_warc(spark, str(folder)).where("warc_type = 'response'").collect()
    by = {r.target_uri.rpartition("/")[2]: r for r in got}
    assert set(by) == {"0", "1", "2", "3", "4", "10", "11", "12", "13", "14"}
    assert by["3"].payload == "plain 3 é" and by["10"].payload == "x" * 300_000 and by["11"].payload == "" and by["13"].payload == "� bad"
    assert by["13"].headers["x-note"] == "n" and by["1"].http_status == 200 and by["1"].http_content_type == "text/html"
    assert warc.read_warc(spark, str(folder)).count() == 10 + 5 + 4 + 1
    assert [r.malformed.rpartition(": ")[2] for r in warc.read_warc(spark, str(folder)).where("malformed IS NOT NULL").collect()] == ["a gzip member ends early"]
    assert warc.read_warc(spark, str(folder), mode="DROPMALFORMED").count() == 10 + 5 + 4
    assert [r.payload for r in warc.read_warc(spark, str(folder), **{"header.X-Note": "n"}).collect()] == ["\ufffd bad"]
    with pytest.raises(Exception, match="EOFError|ends early|incorrect"):
        warc.read_warc(spark, str(folder), mode="FAILFAST").collect()


def test_filters_are_pushed_and_payloads_skipped(spark, folder):
    df = warc.read_warc(spark, f"file://{folder}").where((F.col("warc_type") == "metadata") & F.col("content_length").between(1, 10**6) & (F.length("payload") > 0))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(warc_type,metadata)" in plan or "warc_type" in plan
    assert df.count() == 9
    taken = []

    class Counting(warc._Gzip):
        def take(self, n):
            taken.append(n)
            return super().take(n)

    old, warc._Gzip = warc._Gzip, Counting
    try:
        data = (folder / "c.warc.gz").read_bytes()
        rows = list(warc.records(pa.BufferReader(data), {"target_uri": [lambda u: u == "https://a.b/12"]}, True, "FAILFAST"))
    finally:
        warc._Gzip = old
    assert [r[-2] for r in rows] == ["sl"] and len(taken) == 1


def test_each_filter_agrees_with_spark(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    whole = warc.read_warc(spark, str(folder), mode="DROPMALFORMED").toPandas()
    for text, check in (
        ("target_uri IN ('https://a.b/1', 'https://a.b/12')", lambda d: d.target_uri.isin(["https://a.b/1", "https://a.b/12"])),
        ("target_uri IS NULL", lambda d: d.target_uri.isna()),
        ("http_status >= 200 AND target_uri LIKE '%/1%'", lambda d: d.http_status.ge(200) & d.target_uri.fillna("").str.contains("/1")),
        ("content_length > 100 AND content_type LIKE 'application/http%'", lambda d: d.content_length.gt(100) & d.content_type.str.startswith("application/http")),
        ("http_content_type <=> NULL", lambda d: d.http_content_type.isna()),
    ):
        assert warc.read_warc(spark, str(folder), mode="DROPMALFORMED").where(text).count() == int(check(whole).sum()), text


def test_without_payload(spark, folder):
    rows = warc.read_warc(spark, str(folder), payload="false").where("warc_type = 'response'").collect()
    assert all(r.payload is None and r.http_status is None for r in rows)
    rows = warc.read_warc(spark, str(folder), payload="false").where("http_status = 200").collect()
    assert rows and all(r.payload is None and r.http_status == 200 for r in rows)


def test_partitions_are_balanced(folder):
    reader = warc._Reader({"path": str(folder), "maxpartitionbytes": "2000"})
    parts = reader.partitions()
    assert len(parts) >= 2 and sum(len(p.paths) for p in parts) == 4
    assert len(warc._Reader({"path": str(folder)}).partitions()) == 1


def test_round_trip_of_pages(spark, tmp_path):
    rows = [(1, "https://a.b/ü", "<p>é</p>"), (2, None, None), (None, "u", ""), (3, "two\r\nlines", "WARC/1.1\r\n\r\n"), (3, "two\r\nlines", "WARC/1.1\r\n\r\n"), (4, "v", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit(1)).withColumn("Payload", F.lit("p"))
    assert warc.write_warc(pages, str(tmp_path / "w")) == len(rows)
    got = warc.read_warc(spark, str(tmp_path / "w")).where("warc_type = 'response'")
    found = sorted(((r.headers.get("x-page-id"), r.target_uri, r.payload) for r in got.collect()), key=str)
    assert found == sorted([(i and str(i), u and u.replace("\r", "%0D").replace("\n", "%0A"), h or "") for i, u, h in rows], key=str)
    assert warc.write_warc(pages.limit(0), str(tmp_path / "e")) == 0
    assert warc.read_warc(spark, str(tmp_path / "e")).where("warc_type = 'response'").count() == 0


def test_one_bad_record_costs_no_other(spark, tmp_path):
    def page(k, body=b"fine"):
        return warc.record("response", f"https://a.b/{k}", HTTP + body, "application/http; msgtype=response", str(k))

    bad_length = page(1).replace(b"Content-Length: ", b"Content-Length: x")
    long_length = page(1).replace(b"Content-Length: 4", b"Content-Length: 6")
    no_http = warc.record("response", "https://a.b/1", b"no end of headers", "application/http", "1")
    broken = bytearray(warc.member(page(1, b"z" * 5000)))
    broken[60:70] = b"\0" * 10
    wild = gzip.compress(page(1))[:-30]
    for k, (first, pack) in enumerate([(bad_length, bytes), (long_length, bytes), (no_http, bytes), (bad_length, warc.member), (no_http, gzip.compress), (bytes(broken), None), (wild, None), (b"junk" * 40_000, None)]):
        pack_ = pack or warc.member
        data = pack_(page(0)) + (pack(first) if pack else first) + b"".join(map(pack_, map(page, range(2, 6))))
        (tmp_path / f"{k}.warc{'.gz' if pack is not bytes else ''}").write_bytes(data)
        rows = list(warc.records(pa.BufferReader(data), {}, True))
        assert [r[2] for r in rows if r[-1] is None][-4:] == [f"https://a.b/{i}" for i in range(2, 6)], k
        assert rows[0][2] == "https://a.b/0" and any(r[-1] for r in rows), k
    assert warc.read_warc(spark, str(tmp_path)).where("payload = 'fine'").count() >= 8 * 5


def test_bodies_are_undone_and_decoded(spark, tmp_path):
    def page(k, head, body):
        http = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
        return warc.member(warc.record("response", f"u{k}", http, "application/http; msgtype=response", str(k)))

    plain = "é text".encode("latin-1")
    chunked = b"3\r\n" + plain[:3] + b"\r\n3;x=y\r\n" + plain[3:] + b"\r\n0\r\n\r\n"
    kind = b"Content-Type: text/html; charset=ISO-8859-1"
    cases = [(kind, plain), (kind + b"\r\nTransfer-Encoding: chunked", chunked), (kind + b"\r\nContent-Encoding: gzip", gzip.compress(plain)), (kind + b"\r\nContent-Encoding: deflate", zlib.compress(plain))]
    cases += [(kind + b"\r\nContent-Encoding: gzip", plain), (b"Content-Type: text/html; charset=nonesuch", "é text".encode())]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(page(k, *c) for k, c in enumerate(cases)))
    assert {r.payload for r in warc.read_warc(spark, str(tmp_path)).collect()} == {"é text"}


def test_query_returns_pages_as_they_are(spark, tmp_path):
    urls = ["https://a.b/", None, "", " outer blanks ", "a\r\nb", "tab\tand%0A", "\u00a0x\u2028"]
    rows = [(None if k == 2 else k, u, f"<p>{k}</p>") for k, u in enumerate(urls)] + [(None, None, None), (1, None, "<p>1</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r.page_id, r.url, r.html) for r in warc.op7_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(i, u, h or "") for i, u, h in rows], key=str)
