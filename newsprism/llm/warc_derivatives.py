"""WARC derivatives: a metadata and a plain-text conversion record for every response record.

Both refer to the response by its record id and carry its target URI and date. The
metadata block (application/warc-fields) holds the HTTP status, all source headers, the
digests of the source block and payload, the title and the outgoing links; the
conversion block is the text of the page. Record ids follow from the response's id, so
a task that runs again makes the same records.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.llm.common import pick

# Elements whose content is no text, and elements that begin a new line.
HIDDEN = frozenset("script style template noscript iframe svg title".split())
BREAKING = frozenset(("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                      "head header hr li main nav ol option p pre section table tbody td tfoot th thead tr ul").split())
VERSION = "WARC/1.1"
RECORD_END = "\r\n\r\n"
_HEADER = "sourceHeader-"
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_HREF = re.compile(r"""\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_BLANK = re.compile(r"[ \t\r\f\v ]+")
_UNPRINTABLE = re.compile(r"[\x00-\x1f\x7f]+")
_STATUS = re.compile(rb"HTTP/\d+(\.\d+)? +\d{3}\b")
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(source_id: str, kind: str) -> str:
    """The urn of a derived record: a name-based uuid of the source's id and the kind."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source_id} {kind}')}>"


def _one_line(text: str) -> str:
    return _UNPRINTABLE.sub(" ", text).strip()


def read_page(page: str) -> tuple[str, str, list[str]]:
    """(text, title, links) of an HTML page in one pass, whatever its errors."""
    out, links, title, at = [], [], "", 0
    closing: dict[str, re.Pattern] = {}
    while True:
        lt = page.find("<", at)
        if lt < 0:
            out.append(page[at:])
            break
        out.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            if end < 0:
                break  # an open comment hides the rest
            at = end + 3
            continue
        named = _NAME.match(page, lt)
        if not named and page[lt + 1:lt + 2] not in ("!", "?"):
            out.append("<")
            at = lt + 1
            continue
        gt = page.find(">", lt)
        if gt < 0:
            break  # an open tag hides the rest
        at = gt + 1
        if not named:
            continue
        name, opens = named[1].lower(), page[lt + 1] != "/"
        if name in BREAKING:
            out.append("\n")
        elif name in HIDDEN and opens and page[gt - 1] != "/":
            end = closing.setdefault(name, re.compile(f"</{name}[^>]*>?", re.IGNORECASE)).search(page, at)
            if name == "title" and not title:
                title = page[at:end.start() if end else len(page)]
            if not end:
                break
            at = end.end()
        elif name == "a" and opens:
            href = _HREF.search(page, named.end(), gt + 1)
            if href:
                links.append(html.unescape(href[1] or href[2] or href[3] or ""))
    text = "".join(out)
    if "&" in text:
        text = html.unescape(text)
    lines = (_BLANK.sub(" ", line).strip() for line in text.split("\n"))
    return "\n".join(filter(None, lines)), _one_line(html.unescape(title)), links


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers in order, payload) of an HTTP response block.

    A head begins with an HTTP status line and ends at the first empty line, or with the
    block; its lines end in CRLF or LF. Without a status line all is payload. Headers keep
    empty values, folded lines are joined to their header by a space, and bytes that are
    not UTF-8 are read as Latin-1.
    """
    if not _STATUS.match(block):
        return "", [], block
    blank = _HEAD_END.search(block)
    head, payload = (block[:blank.start()], block[blank.end():]) if blank else (block, b"")
    try:
        text = head.decode("utf-8")
    except UnicodeDecodeError:
        text = head.decode("latin-1")
    status, *lines = re.split("\r?\n", text)
    headers: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and headers:
            name, value = headers[-1]
            headers[-1] = (name, f"{value} {line.strip()}".strip())
        elif line.strip():
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    return status, headers, payload


def _charset(headers: list[tuple[str, str]]) -> str:
    for name, value in headers:
        found = re.search(r"charset=[\"']?([\w.-]+)", value, re.IGNORECASE) if name.lower() == "content-type" else None
        if found:
            try:
                return codecs.lookup(found[1]).name
            except LookupError:
                return "utf-8"
    return "utf-8"


def _record(kind: str, own: str, source_id: str, uri: str, date: str, content_type: str, block: str) -> dict:
    """One derived record, with its WARC header and block as text."""
    raw = block.encode("utf-8", "replace")
    block_digest = digest(raw)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source_id), ("WARC-Target-URI", uri),
              ("WARC-Date", date), ("WARC-Block-Digest", block_digest), ("Content-Type", content_type),
              ("Content-Length", str(len(raw)))]
    head = "\r\n".join([VERSION, *(f"{name}: {value}" for name, value in fields if value)])
    return {"record_type": kind, "record_id": own, "refers_to": source_id, "target_uri": uri, "date": date,
            "block_digest": block_digest, "content_length": len(raw), "block": block,
            "record": f"{head}\r\n\r\n{block}"}


def derive(source_id: str, uri: str, date: str, block: bytes) -> list[dict]:
    """The metadata and the conversion record of one response, linked to it.

    A response without a record id is named by its URI, date and block digest instead.
    """
    status, headers, payload = split_http(block)
    text, title, links = read_page(payload.decode(_charset(headers), "replace"))
    source = {"source_block_digest": digest(block), "source_payload_digest": digest(payload)}
    named = source_id or f"{uri} {date} {source['source_block_digest']}"
    own = {kind: record_id(named, kind) for kind in ("metadata", "conversion")}
    fields = [("sourceStatus", status), *((f"{_HEADER}{name}", value) for name, value in headers),
              ("sourceBlockDigest", source["source_block_digest"]),
              ("sourcePayloadDigest", source["source_payload_digest"]), ("title", title),
              ("conversion", own["conversion"]), *(("outlink", link) for link in links)]
    meta = "".join(f"{_one_line(name)}: {_one_line(value)}\r\n" for name, value in fields
                   if value or name.startswith(_HEADER))
    return [r | source for r in (
        _record("metadata", own["metadata"], source_id, uri, date, "application/warc-fields", meta),
        _record("conversion", own["conversion"], source_id, uri, date, "text/plain; charset=utf-8", text))]


RECORDS = ("array<struct<record_type: string, record_id: string, refers_to: string, target_uri: string, date: string, "
           "block_digest: string, content_length: long, block: string, record: string, source_block_digest: string, "
           "source_payload_digest: string>>")


def derivatives(df: DataFrame, key_col: str, id_col: str, uri_col: str, date_col: str, block_col: str) -> DataFrame:
    """Two rows per response row: ``key`` and the fields of the metadata and of the conversion record.

    ``block_col`` is the response's HTTP block (binary). A null block counts as
    empty, a null record id, URI or date as empty text (its header is left out; the
    derived ids then follow from URI, date and block); responses that repeat give the
    same records again. Source headers stay, those with empty values too. An empty table gives an empty
    result. Scan and projection only, no shuffle.
    """
    @F.pandas_udf(RECORDS)
    def make(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for ids, uris, dates, blocks in batches:
            yield pd.Series([derive(i or "", _one_line(u or ""), _one_line(d or ""), bytes(b or b""))
                             for i, u, d, b in zip(ids, uris, dates, blocks)], dtype=object)
    rows = pick(df, key=key_col, id=id_col, uri=uri_col, date=date_col, block=block_col)
    text = lambda name: F.col(name).cast("string")
    made = rows.select("key", F.explode(make(text("id"), text("uri"), text("date"), F.col("block").cast("binary"))).alias("r"))
    return made.select("key", "r.*")


def write_records(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Serialised records as WARC files, one per partition, by Spark's own writer: each record ends with two line ends."""
    records.select("record").write.option("lineSep", RECORD_END).option("compression", compression).text(path)


def response_block(content: Column) -> Column:
    """The HTTP block of a page fetched with status 200; null content is an empty body."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    return F.concat(F.lit(head), F.coalesce(content.cast("string"), F.lit(""))).cast("binary")


def response_id(key: Column, uri: Column) -> Column:
    """A record id for pages kept outside WARC files: a urn over the md5 of key and URI."""
    hashed = F.md5(F.concat_ws(" ", key.cast("string"), uri.cast("string")).cast("binary"))
    part = lambda at, size: F.substring(hashed, at, size)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)),
                    F.lit(">"))
