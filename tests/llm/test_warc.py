"""WARC derivatives: links, digests, text, and a round trip through files."""

import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from newsprism.llm import queries, warc_derivatives

SF = "/root/testdata/sf0.001"


def sha1(block):
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def test_text_of_a_page():
    page = ("<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style></head><body>"
            "<script>var t='</p>';</script><!-- <p>no</p> --><h1>Head</h1><p>one <b>two</b>&nbsp;three<br>four < 5"
            "<p>five &lt;six&gt;<a class=x HREF='/a?b=1&amp;c'>link</a><a href=/d>l2</a></p><SCRIPT>x</SCRIPT >\n\n end")
    text, title, links = warc_derivatives.read_page(page)
    assert text == "Head\none two three\nfour < 5\nfive <six>linkl2\nend"
    assert title == "A & B" and links == ["/a?b=1&c", "/d"]


def test_broken_pages_do_not_crash_or_crawl():
    for page in ("", "<", "a <", "<p", "<!--", "<script>", "<title>x", "</", "<>", "a&b&#x110000;", "<a href=>"):
        warc_derivatives.read_page(page)
    for part in ("<", "<!--", "<script ", "<p>", "<title>", "&", "<a href='"):
        warc_derivatives.read_page(part * 50_000)


def test_records_of_the_table(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op6_warc_derivatives(spark, SF).collect()
    assert len(rows) == 2 * len(pages) and len({r["record_id"] for r in rows}) == len(rows)
    for r in rows:
        page = pages[r["page_id"]]
        body = page["html"].encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
        own = r["block"].encode()
        assert (r["source_payload_digest"], r["source_block_digest"]) == (sha1(body), sha1(block))
        assert (r["block_digest"], r["content_length"], r["target_uri"]) == (sha1(own), len(own), page["url"])
        if r["record_type"] == "conversion":
            assert r["block"] == warc_derivatives.read_page(page["html"])[0] and "<p>" not in r["block"]
        else:
            fields = dict(line.split(": ", 1) for line in r["block"].split("\r\n") if line and not line.startswith("outlink"))
            assert fields["sourceStatus"] == "HTTP/1.1 200 OK" and fields["sourcePayloadDigest"] == sha1(body)
            assert fields["sourceHeader-Content-Type"] == "text/html; charset=utf-8"
            conversion = next(x for x in rows if x["page_id"] == r["page_id"] and x["record_type"] == "conversion")
            assert fields["conversion"] == conversion["record_id"] and r["refers_to"] == conversion["refers_to"]


SCHEMA = "record string, k long, id string, uri string, date string, block binary, `Block` string, record_id int"


def responses(spark, rows):
    return spark.createDataFrame([("r", *row, "B", 1) for row in rows], SCHEMA)


def test_awkward_responses(spark):
    latin = "HTTP/1.1 404 Not Found\r\nX-A: 1\r\nX-A: 2\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n<p>é".encode("latin-1")
    rows = [(1, "<urn:a>", "http://a/", "2024-01-01T00:00:00Z", latin), (1, "<urn:a>", "http://a/", "2024-01-01T00:00:00Z", latin),
            (None, None, None, None, None), (2, "<urn:b>", "http://b/\r\nX: y", "d", b""), (3, "<urn:c>", "u", "d", b"no head <p>x"),
            (4, "<urn:d>", "u", "d", b"HTTP/1.1 200 OK\r\nContent-Type: a; charset=nonsense\r\n\r\n\xff\xfe")]
    found = warc_derivatives.derivatives(responses(spark, rows), "k", "id", "uri", "date", "block").collect()
    assert len(found) == 2 * len(rows)
    one = [r for r in found if r["key"] == 1]
    assert len({r["record"] for r in one}) == 2
    meta = next(r["block"] for r in one if r["record_type"] == "metadata")
    assert "sourceHeader-X-A: 1\r\nsourceHeader-X-A: 2\r\n" in meta and "sourceStatus: HTTP/1.1 404 Not Found" in meta
    assert next(r["block"] for r in one if r["record_type"] == "conversion") == "é"
    assert all("\r\nX: y" not in r["record"] for r in found)
    assert next(r["block"] for r in found if r["key"] == 3 and r["record_type"] == "conversion") == "no head\nx"
    assert warc_derivatives.derivatives(responses(spark, []), "k", "id", "uri", "date", "block").count() == 0


def test_source_headers_stay(spark):
    folded = b"HTTP/1.1 200 OK\r\nX-Empty:\r\nX-Fold: a\r\n  b\r\n\tc\r\nX-Last: \xe9\r\n\r\nbody"
    assert warc_derivatives.split_http(folded) == (
        "HTTP/1.1 200 OK", [("X-Empty", ""), ("X-Fold", "a b c"), ("X-Last", "\xe9")], b"body")
    assert warc_derivatives.split_http(folded.replace(b"\r\n", b"\n"))[1:] == warc_derivatives.split_http(folded)[1:]
    assert warc_derivatives.split_http(b"HTTP/1.1 204 No Content\r\nX-A: 1\r\n") == ("HTTP/1.1 204 No Content", [("X-A", "1")], b"")
    assert warc_derivatives.split_http(b"<p>HTTP/1.1 200 OK\r\n\r\n") == ("", [], b"<p>HTTP/1.1 200 OK\r\n\r\n")
    rows = [(1, None, "http://a/", "d", folded), (2, None, "http://a/", "d", folded + b"!"), (3, "", "http://b/", "d", folded),
            (4, None, None, None, None)]
    found = warc_derivatives.derivatives(responses(spark, rows), "k", "id", "uri", "date", "block").collect()
    assert len({r["record_id"] for r in found}) == 8
    meta = next(r["block"] for r in found if r["key"] == 1 and r["record_type"] == "metadata")
    assert "sourceHeader-X-Empty: \r\nsourceHeader-X-Fold: a b c\r\nsourceHeader-X-Last: \xe9\r\n" in meta


def read_warc(data):
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        assert rest[size:size + 4] == b"\r\n\r\n" and fields["WARC-Block-Digest"] == sha1(rest[:size])
        out.append((fields, rest[:size]))
        data = rest[size + 4:]
    return out


def test_files_hold_every_record(spark, tmp_path):
    rows = [(i, f"<urn:{i}>", f"http://x/{i}", "2024-01-01T00:00:00Z",
             f"HTTP/1.1 200 OK\r\n\r\n<title>t{i}</title><p>ä{i}<p>\r\n\r\nb".encode()) for i in range(20)]
    made = warc_derivatives.derivatives(responses(spark, rows).repartition(3), "k", "id", "uri", "date", "block")
    warc_derivatives.write_records(made, str(tmp_path / "out"))
    read = [x for f in (tmp_path / "out").glob("part-*.gz") for x in read_warc(gzip.decompress(f.read_bytes()))]
    assert {(f["WARC-Record-ID"], f["WARC-Refers-To"], b.decode()) for f, b in read} == {
        (r["record_id"], r["refers_to"], r["block"]) for r in made.select(F.col("*")).collect()}
    assert len(read) == 40
