import gzip

from corpus import none

from trainlake.llm import warc as W


def http(body, *headers):
    return b"HTTP/1.1 200 OK\r\n" + b"".join(h.encode() + b"\r\n" for h in headers) + b"\r\n" + body


def response(spark, *blocks):
    rows = [("response", f"<urn:uuid:{i}>", "2024-05-01T00:00:00Z", f"http://x/{i}", None, None, [], b, "mine") for i, b in enumerate(blocks)]
    return spark.createDataFrame(rows, W.RECORD + ", page_id string")


def derived(spark, *blocks):
    return {(r.refers_to, r.type): r for r in W.derivatives(response(spark, *blocks)).collect()}


def test_links_headers_and_digests(spark):
    page = b"<html lang=en><head><title>A &amp; B</title></head><body><p>One<p>Two <a href='/x'>link</a></body></html>"
    block = http(page, "Content-Type: text/html", "X-Own: a", "Set-Cookie: b", "X-Folded: c\r\n d")
    found = derived(spark, block)
    meta, text = found["<urn:uuid:0>", "metadata"], found["<urn:uuid:0>", "conversion"]
    lines = bytes(meta.block).decode().split("\r\n")
    for line in (
        "source-status: HTTP/1.1 200 OK", "source-header-X-Own: a", "source-header-Set-Cookie: b", "source-header-X-Folded: c d",
        f"source-block-digest: {W.digest(block)}", f"source-payload-digest: {W.digest(page)}", "title: A & B", "language: en", "outlink: /x",
        f"conversion-id: {text.id}",
    ):
        assert line in lines
    assert bytes(text.block).decode() == "One\nTwo link" and text.uri == "http://x/0" and text.date == "2024-05-01T00:00:00Z"
    headers = dict(map(tuple, text.headers))
    assert headers == {"WARC-Concurrent-To": meta.id, "WARC-Block-Digest": W.digest(bytes(text.block)), "X-Source-Payload-Digest": W.digest(page)}


def test_codings_and_charsets(spark):
    text = "<p>Äpfel</p>"
    zipped = gzip.compress(text.encode())
    chunked = b"5\r\n<p>ab\r\n3;x=1\r\ncd<\r\n3\r\n/p>\r\n0\r\n\r\n"
    found = derived(
        spark, http(text.encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1"), http(zipped, "Content-Encoding: gzip"),
        http(chunked, "Transfer-Encoding: chunked"), b"no message at all", None, b"", http(b"\xff\xfe<b>x", "Content-Type: text/html; charset=nonsense"),
        http(b"cut" + zipped[:9], "Content-Encoding: gzip"),
    )
    texts = [bytes(found[f"<urn:uuid:{i}>", "conversion"].block).decode() for i in range(8)]
    assert texts[:6] == ["Äpfel", "Äpfel", "abcd", "no message at all", "", ""] and texts[6].endswith("x")


def test_plain_text():
    page = "<style>p{}</style><!-- no --><div>a<br>b&nbsp;&lt;c&gt;</div><script>var t='</p>';</script>1 < 2<ul><li>x<li>y</ul><p>open"
    assert W.plain_text(page) == "a\nb <c>\n1 < 2\nx\ny\nopen"
    assert W.plain_text("") == "" and W.plain_text("<!-- never closed") == ""


def test_files_round_trip(spark, tmp_path, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    records = W.responses(pages).drop("page_id")
    records = records.unionByName(W.derivatives(records)).unionByName(
        response(spark, http(bytes(range(256)) * 3), b"WARC/1.1 \r\n\r\nlooks like a record\r\n\r\n", b"").drop("page_id")
    )
    W.write_warc(records, str(tmp_path / "warc"), 40)
    back = W.read_warc(spark, str(tmp_path / "warc"))
    columns = ["type", "id", "date", "uri", "refers_to", "headers", "block"]
    assert records.select(columns).exceptAll(back.select(columns)).count() == 0 and back.count() == records.count()


def test_parse_records_zipped_one_by_one():
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nX: y\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for data in (one * 3, gzip.compress(one) * 3, gzip.compress(one * 3)):
        assert [(r["type"], r["headers"], r["block"]) for r in W.parse_warc(data)] == [("resource", [("X", "y")], b"abc")] * 3


def test_pages_with_nulls_and_repeats(spark):
    pages = spark.createDataFrame([(1, None, None, "a"), (None, "u", "", "b"), (2, "v", "<p>x", "c"), (2, "v", "<p>x", "c")], "page_id long, url string, html string, block string")
    found = W.derivatives(W.responses(pages), "page_id").collect()
    assert len(found) == 8 and len({r.id for r in found}) == 6
    assert W.derivatives(W.responses(none(spark).selectExpr("doc_id page_id", "text url", "text html")), "page_id").count() == 0


def test_long_page(spark):
    pages = spark.createDataFrame([(1, "u", "<p>word</p>" * 200_000)], "page_id long, url string, html string")
    text = W.derivatives(W.responses(pages)).where("type = 'conversion'").first()
    assert len(text.block) == 5 * 200_000 - 1
