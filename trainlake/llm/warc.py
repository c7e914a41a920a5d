"""WARC records: reading, writing, and the derivative records of responses.

Every response gives two linked records. A metadata record (application/warc-fields) keeps what was received: the status,
every HTTP header, the digests, the title, language and links. A conversion record holds the plain text. Both refer to the
response by its id, repeat its target and date, and name each other; all digests are base32 SHA-1, as is customary. Ids are
derived from the id of the response, so a repeated run gives the same records. Rows never meet: one pass, no shuffle.

A record is a row (type, id, date, uri, content_type, refers_to, headers, block): ``headers`` are all further WARC header
lines in order, ``block`` is binary.

Defined cases: a page without url, html or id still has a response, with an empty target or payload; a response whose block
is null or no HTTP message is taken as payload without headers; undecodable bytes become U+FFFD; repeated rows give
repeated records of the same ids; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake.llm.common import read, small_batches, text_of

RECORD = (
    "type string, id string, date string, uri string, content_type string, refers_to string,"
    " headers array<struct<name:string,value:string>>, block binary"
)
NO_DATE = "1970-01-01T00:00:00Z"
FILE_RECORDS = 1000

_END = b"\r\n\r\n"
_NAMES = {
    "type": "WARC-Type", "id": "WARC-Record-ID", "date": "WARC-Date", "uri": "WARC-Target-URI", "content_type": "Content-Type",
    "refers_to": "WARC-Refers-To",
}
_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs

_UNSEEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|head)\b.*?(?:</\1\s*>|$)|<!\[CDATA\[.*?\]\]>", re.S | re.I)
_BLOCK_TAG = re.compile(
    r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|"
    r"section|table|td|th|tr|ul)\b[^>]*>", re.I,
)
_TAG = re.compile(r"</?[a-zA-Z!?][^>]*>")
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_LANGUAGE = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_ID, '|'.join(map(str, parts)))}>"


# ---- HTTP and HTML ------------------------------------------------------------------------------
def parse_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, body as it was sent)."""
    head, found, body = block.partition(_END)
    lines = head.decode("latin-1").split("\r\n")
    if not found or not lines[0].startswith("HTTP/"):
        return "", [], block
    headers: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and headers:  # a folded line
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    return lines[0], headers, body


def _header(headers: list[tuple[str, str]], name: str) -> str:
    return next((v for n, v in headers if n.lower() == name), "")


def _unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return b"".join(parts) if parts else body
        length = int(size, 16)
        if not length:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + length])
        at = end + 4 + length


def decoded(headers: list[tuple[str, str]], body: bytes) -> tuple[str, str]:
    """(text, charset) of a body after its transfer and content codings."""
    if "chunked" in _header(headers, "transfer-encoding").lower():
        body = _unchunked(body)
    coding = _header(headers, "content-encoding").lower()
    if coding in ("gzip", "x-gzip", "deflate"):
        try:
            body = zlib.decompressobj(47 if coding != "deflate" else 15).decompress(body)
        except zlib.error:
            pass
    named = _CHARSET.search(_header(headers, "content-type")) or _CHARSET.search(body[:2048].decode("latin-1"))
    charset = named.group(1).lower() if named else "utf-8"
    try:
        return body.decode(charset, "replace"), charset
    except LookupError:
        return body.decode("utf-8", "replace"), "utf-8"


def plain_text(page: str) -> str:
    """What a reader sees: no scripts, styles or comments; blocks on lines of their own; single blanks."""
    text = _UNSEEN.sub(" ", page)
    text = html.unescape(_TAG.sub("", _BLOCK_TAG.sub("\n", text.replace("\n", " "))))
    lines = (_BLANKS.sub(" ", line).strip() for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


# ---- Derivatives --------------------------------------------------------------------------------
def _derived(response: dict, markers: dict) -> list[dict]:
    block = response["block"] or b""
    status, headers, body = parse_http(block)
    page, charset = decoded(headers, body)
    text = plain_text(page).encode("utf-8", "replace")
    source = response["id"] or record_id("response", response["uri"], digest(block))
    ids = {kind: record_id(kind, source) for kind in ("metadata", "conversion")}
    title, language = _TITLE.search(page), _LANGUAGE.search(page)
    payload = digest(body)
    fields = [("source-status", status)] if status else []
    fields += [(f"source-header-{n}", v) for n, v in headers]
    fields += [("source-block-digest", digest(block)), ("source-payload-digest", payload), ("charset", charset)]
    fields += [("title", " ".join(html.unescape(title.group(1)).split()))] if title else []
    fields += [("language", language.group(1))] if language else []
    fields += [("outlink", html.unescape(next(filter(None, m.groups()), ""))) for m in _LINK.finditer(page)]
    fields += [("conversion-id", ids["conversion"])]
    lines = "".join(f"{n}: {' '.join(v.splitlines())}\r\n" for n, v in fields).encode("utf-8", "replace")
    shared = {"date": response["date"], "uri": response["uri"], "refers_to": source}
    made = []
    for kind, content, data in (
        ("metadata", "application/warc-fields", lines), ("conversion", "text/plain; charset=utf-8", text),
    ):
        other = ids["conversion" if kind == "metadata" else "metadata"]
        extra = [("WARC-Concurrent-To", other), ("WARC-Block-Digest", digest(data)), ("X-Source-Payload-Digest", payload)]
        made.append({**markers, **shared, "type": kind, "id": ids[kind], "content_type": content, "headers": extra, "block": data})
    return made


def derivatives(records: DataFrame, *markers: str) -> DataFrame:
    """Two records for each response among ``records``; columns named in ``markers`` are carried along."""
    small_batches(records.sparkSession, 256)
    columns = [*markers, "type", "id", "date", "uri", "content_type", "refers_to", "headers", "block"]
    schema = ", ".join([*(f"{m} {records.schema[m].dataType.simpleString()}" for m in markers), RECORD])

    def derive(batches):
        for batch in batches:
            made = []
            for row in batch.to_dict("records"):
                made += _derived(row, {m: row[m] for m in markers})
            yield pd.DataFrame(made, columns=columns)

    return records.where("type = 'response'").select(*markers, "id", "date", "uri", "block").mapInPandas(derive, schema)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = NO_DATE) -> DataFrame:
    """Response records (with ``page_id``) of fetched pages that were kept without their HTTP headers."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
    payload = F.encode(text_of(html_col), "UTF-8")
    block = F.concat(F.encode(F.concat(F.lit(head), F.length(payload).cast("string"), F.lit("\r\n\r\n")), "UTF-8"), payload)

    @F.pandas_udf("string")
    def id_of(ids: pd.Series, urls: pd.Series, blocks: pd.Series) -> pd.Series:
        return pd.Series([record_id("response", i, u, digest(b)) for i, u, b in zip(ids, urls, blocks)])

    rows = pages.select(F.col(id_col).alias("page_id"), text_of(url_col).alias("uri"), block.alias("block"))
    return rows.select(
        "page_id", F.lit("response").alias("type"), id_of(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "uri", "block").alias("id"),
        F.lit(date).alias("date"), "uri", F.lit("application/http; msgtype=response").alias("content_type"),
        F.lit(None).cast("string").alias("refers_to"), F.expr("cast(array() AS array<struct<name:string,value:string>>)").alias("headers"), "block",
    )


# ---- Files --------------------------------------------------------------------------------------
def _serialised(record: dict) -> bytes:
    lines = ["WARC/1.1"]
    lines += [f"{name}: {record[field]}" for field, name in _NAMES.items() if record[field]]
    lines += [f"{h['name']}: {h['value']}" for h in (record["headers"] if record["headers"] is not None else [])]
    block = record["block"] or b""
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "replace") + _END + block


def write_warc(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """WARC files of at most ``file_records`` records each, gzipped, written by Spark's own committer: a record is a line
    whose separator is the end of a WARC record."""
    small_batches(records.sparkSession, 256)

    @F.pandas_udf("binary")
    def line(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([_serialised(r) for r in rows.to_dict("records")])

    columns = ["type", "id", "date", "uri", "content_type", "refers_to", "headers", "block"]
    lines = records.select(line(F.struct(*columns)).cast("string").alias("value"))
    lines.write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parse_warc(data: bytes) -> list[dict]:
    """The records of a WARC file, gzipped (as a whole or record by record) or not."""
    parts = []
    while data[:2] == b"\x1f\x8b":
        opener = zlib.decompressobj(31)
        parts.append(opener.decompress(data) + opener.flush())
        data = opener.unused_data
    data = b"".join(parts) or data
    found, at = [], 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(_END, at)
        if end < 0:
            break
        _, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = [(n.strip(), v.strip()) for n, _, v in (line.partition(":") for line in lines)]
        length = int(next((v for n, v in headers if n.lower() == "content-length"), "0"))
        names = {name.lower(): field for field, name in _NAMES.items()}
        record = dict.fromkeys(_NAMES, None) | {names[n.lower()]: v for n, v in headers if n.lower() in names}
        record["headers"] = [(n, v) for n, v in headers if n.lower() not in names and n.lower() != "content-length"]
        record["block"] = data[end + 4 : end + 4 + length]
        found.append(record)
        at = end + 4 + length
    return found


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files of a folder; a file is read as a whole, so files are kept small."""
    small_batches(spark, 1)
    columns = [*_NAMES, "headers", "block"]

    def parse(batches):
        for batch in batches:
            for content in batch["content"]:
                found = parse_warc(content)
                for first in range(0, len(found), 256):
                    yield pd.DataFrame(found[first : first + 256], columns=columns)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInPandas(parse, RECORD)


def op2_warc_derivatives(spark, sf_dir):
    made = derivatives(responses(read(spark, sf_dir, "pages")), "page_id")
    header = F.element_at(F.filter("headers", lambda h: h["name"] == "X-Source-Payload-Digest"), 1)["value"]
    own = F.element_at(F.filter("headers", lambda h: h["name"] == "WARC-Block-Digest"), 1)["value"]
    return made.select(
        "page_id", F.col("type").alias("warc_type"), F.col("id").alias("record_id"), "refers_to", F.col("uri").alias("target_uri"), "date",
        "content_type", F.length("block").cast("long").alias("content_length"), own.alias("block_digest"), header.alias("source_payload_digest"),
    )
