import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.storage import new_path

PAGE = '<!DOCTYPE html><html lang="en"><head><title> A &amp; B </title><style>p{}</style></head><body><!-- no --><p>One &lt;two&gt;</p><br>three<b>four</b><a href="/x?a=1&amp;b=2">l</a><script>var t="</p>";</script></body></html>'


def pages(spark):
    rows = [(0, "http://a.example/1", PAGE), (1, None, "plain text, no tags"), (2, "http://b.example/2", None), (3, "http://c.example/3", ""), (3, "http://c.example/3", ""), (None, "http://d.example", "é ü<p>x"), (4, "http://e.example", "<p>" + "long text " * 20_000)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, block string, key string")


def test_derivatives_refer_to_their_responses(spark):
    responses = warc.response_records(pages(spark))
    by_id = {r.record_id: r for r in responses.collect()}
    rows = warc.derivatives(responses).collect()
    assert len(rows) == 2 * responses.count()
    for r in rows:
        source = by_id[r.refers_to]
        head, _, payload = bytes(source.block).partition(b"\r\n\r\n")
        assert (r.page_id, r.target_uri, r.warc_date) == (source.page_id, source.target_uri, source.warc_date)
        assert r.source_payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.block.encode()).digest()).decode()
        assert r.content_length == len(r.block.encode())
        if r.record_type == "metadata":
            assert all(f"source-header: {h}\r\n" in r.block for h in head.decode().split("\r\n")[1:])
    assert len({(r.record_id) for r in rows}) == 2 * len(by_id)


def test_text_title_and_links(spark):
    rows = {r.record_type: r.block for r in warc.derivatives(warc.response_records(pages(spark).where("page_id = 0"))).collect()}
    assert rows["conversion"] == "One <two>\nthreefourl"
    assert "title: A & B\r\n" in rows["metadata"] and "outlink: /x?a=1&b=2\r\n" in rows["metadata"] and "language: en\r\n" in rows["metadata"]


def test_blocks_of_other_shapes(spark):
    rows = [(0, "<a>", "u", "d", b"HTTP/1.0 404 Gone\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n<p>caf\xe9"), (1, "<b>", "u", "d", b"no headers"), (2, "<c>", "u", "d", None), (3, "<d>", "u", "d", b"HTTP/1.1 200 OK\r\n\r\n\xff\xfe bad bytes")]
    got = {(r.page_id, r.record_type): r for r in warc.derivatives(spark.createDataFrame(rows, "page_id long, record_id string, target_uri string, warc_date string, block binary")).collect()}
    assert got[0, "conversion"].block == "café" and "fetch-status: 404" in got[0, "metadata"].block
    assert got[1, "conversion"].block == "" and got[2, "conversion"].block == "" and "fetch-status: 0" in got[2, "metadata"].block
    assert got[3, "conversion"].block.endswith("bad bytes")
    assert warc.derivatives(warc.response_records(pages(spark).limit(0))).count() == 0


def test_records_are_written_as_gzip_members(spark):
    path = new_path(spark, "test-warc")
    records = warc.derivatives(warc.response_records(pages(spark)))
    files = warc.write_warc(records, path).collect()
    assert sum(f.records for f in files) == records.count()
    data = b"".join(gzip.open(f.file).read() for f in files)
    assert data.count(b"WARC/1.1\r\n") == records.count()
    one = records.where("page_id = 1 and record_type = 'conversion'").select(warc.record_bytes().alias("b"), F.col("block")).first()
    assert bytes(one.b) in data and b"WARC-Target-URI" not in bytes(one.b)


def test_references_are_resolved_once(spark):
    texts = ["&amp;lt; &lt;b&gt; &#65;&#x42;&#X1F600; &eacute;&nbsp;x &unknown; &#0; &#xD800; &#9999999; & &amp &copy;&", "no reference", "", "&", "&&amp;&"]
    want = ["&lt; <b> AB😀 é\xa0x &unknown; &#0; &#xD800; &#9999999; & &amp ©&", "no reference", "", "&", "&&&"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", warc.unescaped(F.col("t")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == want


def test_many_header_lines_are_all_kept(spark):
    head = "HTTP/1.1 200 OK\r\n" + "".join(f"X-{k}: {k}\r\n" for k in range(5000))
    rows = [(0, "<a>", "u", "d", head.encode() + b"\r\nbody")]
    got = warc.derivatives(spark.createDataFrame(rows, "page_id long, record_id string, target_uri string, warc_date string, block binary")).where("record_type = 'metadata'").first()
    assert got.block.count("source-header: X-") == 5000
