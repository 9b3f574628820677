import base64
import gzip
import hashlib
import uuid
from html.parser import HTMLParser

from pyspark.sql import functions as F

from pathloom.llm import queries, warc


class Reference(HTMLParser):
    """Text by a full parser: hidden elements left out, a line for each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in warc._HIDDEN.split("|"):
            self.hidden += 1
        elif tag in warc._LINES.split("|"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in warc._HIDDEN.split("|"):
            self.hidden -= 1
        elif tag in warc._LINES.split("|"):
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def reference_text(page):
    p = Reference()
    p.feed(page)
    p.close()
    lines = [" ".join(x.split()) for x in "".join(p.out).split("\n")]
    return [x.split() for x in lines if x]


def test_query_against_parser(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = queries.op1_warc_derivatives(spark, sf_dir).collect()
    assert len(found) == 2 * len(pages)
    ids = set()
    for r in found:
        page = pages[r["page_id"]]
        body = page["html"].encode()
        sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert r["source_payload_digest"] == sha(body)
        assert r["block_digest"] == sha(r["content"].encode())
        assert r["content_length"] == len(r["content"].encode())
        assert r["target_uri"] == page["url"]
        uuid.UUID(r["refers_to"][10:-1])
        assert r["record_id"] == warc.derived_urn(r["refers_to"], r["record_type"])
        ids.add(r["record_id"])
        if r["record_type"] == "conversion":
            assert [x.split() for x in r["content"].split("\n") if x] == reference_text(page["html"])
        else:
            assert f"source-payload-digest: {sha(body)}" in r["content"] and "http-status: 200" in r["content"]
    assert len(ids) == len(found)


def test_markup_that_misleads():
    page = '<script>var t="</p>";</script><!-- <p>no --><p title="a > b">one &amp; two<br>three<style>x</style><b>four</b> 5 < 6</p><textarea>t</textarea><script>open'
    assert warc.page_text(page) == "one & two\nthreefour 5 < 6\nt"


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>é</p>"), (2, None, None), (None, "http://c/", "\r\n\r\nWARC/1.1\r\n")], "page_id long, url string, html string")
    records = warc.responses(pages)
    both = records.drop("page_id").unionByName(warc.derive(records))
    warc.write_warc(both, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w/part-*"))
    key = lambda r: (r["record_id"], r["record_type"], r["target_uri"], bytes(r["block"]), dict(r["headers"]))
    assert sorted(map(key, back.collect()), key=str) == sorted(map(key, both.collect()), key=str)
    assert warc.derive(back).count() == 6


def test_compressed_members():
    record = {"record_type": "resource", "record_id": "<x>", "refers_to": None, "target_uri": "u", "date": None, "content_type": "a/b", "headers": {"X": "1"}, "block": b"\r\n\r\n"}
    data = gzip.compress(warc.serialised(record)) + gzip.compress(warc.serialised(record))
    assert [r["block"] for r in warc.parse_warc(data)] == [b"\r\n\r\n"] * 2


def test_odd_records(spark):
    rows = [("response", "<a>", None, "u", "d", "t", None, None), ("response", None, None, None, None, None, {}, b"no head \xff"), ("request", "<b>", None, "u", "d", "t", {}, b"x")]
    df = spark.createDataFrame(rows, warc.RECORD).withColumn("page_id", F.lit(1)).withColumn("status", F.lit("clash"))
    found = warc.derive(df).collect()
    assert [r["record_type"] for r in found] == ["metadata", "conversion"] * 2
    assert bytes(found[1]["block"]) == b"" and "�" in bytes(found[3]["block"]).decode()
    assert warc.derive(df.limit(0)).count() == 0


def response(headers, body):
    head = "HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers)
    return warc.derivatives("<r>", "u", "d", {}, head.encode() + b"\r\n" + body)


def test_codings_and_content_types():
    import zlib

    page = b"<title>T</title><p>Hello</p>"
    chunks = b"".join(b"%x;x=1\r\n%s\r\n" % (len(p), p) for p in (page[:7], page[7:])) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    bodies = [
        ([("Transfer-Encoding", "chunked")], chunks), ([("Transfer-Encoding", "chunked")], page), ([("Transfer-Encoding", "chunked")], chunks[:-12]),
        ([("Content-Encoding", "gzip")], gzip.compress(page)), ([("Content-Encoding", "deflate")], zlib.compress(page)), ([("Content-Encoding", "deflate")], raw.compress(page) + raw.flush()),
        ([("Transfer-Encoding", "chunked"), ("Content-Encoding", "GZIP")], b"%x\r\n" % len(gzip.compress(page)) + gzip.compress(page) + b"\r\n0\r\n\r\n"),
    ]
    texts = [response(h, b)[1][-1] for h, b in bodies]
    assert texts[0] == texts[1] == b"T\nHello" and texts[2].startswith(b"T\nHel") and texts[3:] == [b"T\nHello"] * 4
    for headers, body in (([("Content-Type", "image/png")], b"\x89PNG"), ([("Content-Encoding", "br")], b"xx"), ([("Content-Encoding", "gzip")], b"no gzip")):
        assert [r[0] for r in response(headers, body)] == ["metadata"]
    plain = response([("Content-Type", "text/plain; charset=latin-1")], "<b>é".encode("latin-1"))
    assert plain[1][-1].decode() == "<b>é"
    several = response([("Set-Cookie", "a"), ("Set-Cookie", "b"), ("Link", "x")], b"")
    assert several[0][-1].decode().count("http-set-cookie: ") == 2


def test_hostile_markup_takes_linear_time():
    import time

    for unit in ("<p ", "<title>", "<a ", '<x "><y"', "<script", "<!-", "<a href=", "<title ", "<script>", "<", "&#1", "</p", "<p '", "<a href='"):
        page = unit * (1_000_000 // len(unit))
        for tail in ("", ">", '">'):
            start = time.process_time()
            warc.derivatives("<r>", "u", "d", {}, b"HTTP/1.1 200 OK\r\n\r\n" + (page + tail).encode())
            assert time.process_time() - start < 2, (unit, tail)


def test_malformed_records_are_told(spark, tmp_path):
    good = warc.serialised(dict.fromkeys(warc._ARROW.names) | {"record_type": "resource", "record_id": "<x>", "headers": {"X": "1"}, "block": b"abc"})
    bad = good.replace(b"Content-Length: 3", b"Content-Length: x")
    twice = good.replace(b"X: 1", b"X: 1\r\nX: 2")
    kinds = lambda data: [r["record_type"] for r in warc.parse_warc(data)]
    assert kinds(good + bad + good) == ["resource", "malformed", "resource"]
    assert kinds(good + good[:-6]) == ["resource", "malformed"]
    assert kinds(gzip.compress(good) + gzip.compress(good * 50)[:-20])[-1] == "malformed"
    assert [r["headers"] for r in warc.parse_warc(twice)] == [{"X": "1, 2"}]
    (tmp_path / "a.warc").write_bytes(good + bad)
    back = warc.read_warc(spark, str(tmp_path / "a.warc"))
    assert back.filter("record_type = 'malformed'").count() == 1 and warc.derive(back).count() == 0


def test_carried_columns_of_any_type(spark):
    import datetime

    pages = spark.createDataFrame([("k", "u", "<p>x")], "key string, url string, html string")
    records = warc.responses(pages, "key").withColumn("at", F.lit(datetime.date(2024, 1, 2))).withColumn("list", F.array(F.lit(1.5)))
    rows = warc.derive(records, "page_id", "at", "list").collect()
    assert {(r["page_id"], r["at"], tuple(r["list"])) for r in rows} == {("k", datetime.date(2024, 1, 2), (1.5,))} and len(rows) == 2
