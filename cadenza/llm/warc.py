"""WARC derivatives: metadata and plain-text conversion records linked to the responses they come from."""

from __future__ import annotations

import html
import re
import uuid
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import arrow_schema, plain, slices

DATE = "2024-01-01T00:00:00Z"

# Each pattern also matches to the end of an unclosed element, so none is tried twice from the same place.
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*(?:>|\Z).*?(?:</\1\s*>|\Z)", re.I | re.S)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.I | re.S)
_HEAD = re.compile(r"<head\b[^>]*>.*?(?:</head\s*>|(?=<body\b)|\Z)", re.I | re.S)
_BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^<>]*>",
    re.I,
)
_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>")
_LINK = re.compile(r"<a\s[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s<>\"']+))", re.I)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + b32encode(sha1(block).digest()).decode()


def record_id(kind: str, source: str) -> str:
    """A name that is the same whenever the same record is made again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{source}')}>"


def plain_text(page: str) -> str:
    """Visible text: a line for each block, spaces joined, entities resolved."""
    body = _HEAD.sub(" ", _DROPPED.sub(" ", page), count=1)
    body = html.unescape(_TAG.sub("", _BLOCK.sub("\n", body)))
    return "\n".join(filter(None, (" ".join(line.split()) for line in body.split("\n"))))


def describe(page: str, target: str | None) -> list[tuple[str, str]]:
    """Fields of a page's metadata: title, language, links as absolute addresses, in the page's order."""
    body = _DROPPED.sub(" ", page)
    fields = []
    if found := _TITLE.search(body):
        fields.append(("title", " ".join(html.unescape(_TAG.sub("", found[1])).split())))
    if found := _LANG.search(body):
        fields.append(("language", found[1]))
    for found in _LINK.finditer(body):
        link = html.unescape(found[1] or found[2] or found[3] or "").strip()
        try:
            link = urljoin(target or "", link)
        except ValueError:
            pass
        fields.append(("outlink", " ".join(link.split())))
    return fields


def serialise(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record of version 1.1; headers without a value are left out."""
    lines = ["WARC/1.1", *(f"{k}: {' '.join(v.split())}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of one serialised record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = [tuple(line.split(": ", 1)) for line in head.decode().split("\r\n")[1:]]
    size = int(dict(headers)["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the block does not have the length that its header gives")
    return headers, rest[:size]


_RESPONSE = "id {id}, response_id string, target_uri string, date string, http string, payload binary, payload_digest string"


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """(id, response_id, target_uri, date, http, payload, payload_digest): a response record's parts for each page.

    A null page is an empty payload, a null address stays null. The identifier comes from id, address and payload,
    so a repeated row is the same record again.
    """
    rows = plain(pages, id_col, html_col, url=url_col)
    ddl = _RESPONSE.format(id=rows.schema["id"].dataType.simpleString())
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for i, url, page in zip(*(part.column(c).to_pylist() for c in ("id", "url", "text"))):
                payload = (page or "").encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
                mark = digest(payload)
                out.append((i, record_id("response", f"{i} {url} {mark}"), url, date, http, payload, mark))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(run, ddl)


_DERIVED = "id {id}, warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, source_date string, source_digest string, block_digest string, content_type string, content string, record binary"


def derive(found: DataFrame) -> DataFrame:
    """Two rows for each response: its metadata record and its conversion record.

    Each refers to the response by identifier, address and date, and names the other one as made with it. The
    response's own HTTP headers and payload digest go into the metadata, so a conversion can be checked against its
    source. Payloads that are not UTF-8 are read with replacement characters.
    """
    ddl = _DERIVED.format(id=found.schema["id"].dataType.simpleString())
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "payload"):
            out = []
            for i, source, target, date, http, payload, mark in zip(*(part.column(c).to_pylist() for c in part.schema.names)):
                page = (payload or b"").decode(errors="replace")
                fields = [(k.lower(), v) for k, v in (line.split(": ", 1) for line in (http or "").split("\r\n")[1:] if ": " in line)]
                fields = [("source-payload-digest", mark or ""), *((f"source-{k}", v) for k, v in fields), *describe(page, target)]
                made = {
                    "metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)),
                    "conversion": ("text/plain; charset=utf-8", plain_text(page)),
                }
                names = {kind: record_id(kind, source or "") for kind in made}
                for (kind, (mime, content)), other in zip(made.items(), ("conversion", "metadata")):
                    block = content.encode()
                    own = digest(block)
                    headers = [
                        ("WARC-Type", kind), ("WARC-Record-ID", names[kind]), ("WARC-Date", date), ("WARC-Target-URI", target),
                        ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date),
                        ("WARC-Concurrent-To", names[other]), ("WARC-Block-Digest", own), ("Content-Type", mime),
                    ]
                    out.append((i, kind, names[kind], source, names[other], target, date, mark, own, mime, content, serialise(headers, block)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return found.mapInArrow(run, ddl)


def build_derivatives(pages: DataFrame, **columns: str) -> DataFrame:
    """Derivatives of the responses made from a table of pages; an empty table gives no rows."""
    return derive(responses(pages, **columns))


def summary(derived: DataFrame) -> DataFrame:
    """The derivatives with the digest and length of each serialised record in the place of its bytes."""
    return derived.withColumns({"record_bytes": F.length("record").cast("bigint"), "record_sha256": F.sha2("record", 256)}).drop("record")
