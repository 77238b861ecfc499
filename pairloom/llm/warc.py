"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Each response gives two records. The metadata record (application/warc-fields) keeps the HTTP status, the
title, the outlinks and the source's headers; the conversion record holds the text of the page. Both name
the response in WARC-Refers-To, keep its target and date, and carry SHA-1 digests of what they hold beside
the source's payload digest. Record identifiers are derived from the response's, so a rerun, or a retry
after a lost executor, gives the same records.

Pages are read in one walk, linear in their length whatever their markup. Null and empty pages have an empty
payload, null addresses no target. Repeated rows repeat their records, so ties need no rule. A record that cannot
be parsed raises a ValueError that names it or its place. An empty table gives an empty table. Extra columns are
ignored. One pass, without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.frames import map_arrow

DATE = "1970-01-01T00:00:00Z"
#: Elements whose content is no text, and those that end a line.
HIDDEN = frozenset("script style noscript template".split())
LINES = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9-]*)")
HREF = re.compile(r"\bhref\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw, usedforsecurity=False).digest()).decode()


def record(kind: str, name: str, content_type: str, block: bytes, headers: list[tuple[str, str]]) -> bytes:
    """One WARC/1.1 record; headers with no value are left out."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", name), *headers, ("Content-Type", content_type), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    one_line = lambda v: " ".join(v.split())
    return b"WARC/1.1\r\n" + "".join(f"{k}: {one_line(v)}\r\n" for k, v in lines if v).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def response(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> bytes:
    """The response record of a page."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    name = f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}').urn}>"
    return record("response", name, "application/http; msgtype=response", block, [("WARC-Date", date), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", digest(payload))])


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case, continuation lines joined) and block of one record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {raw[:60]!r}")
    headers = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
    size = int(headers.get("content-length", -1))
    if not 0 <= size <= len(rest):
        raise ValueError(f"a WARC record was cut off: {headers.get('warc-record-id')}")
    return headers, rest[:size]


def records(raw: bytes) -> Iterator[bytes]:
    """The records of a WARC file, plain or compressed member by member."""
    if raw[:2] == b"\x1f\x8b":
        rest, parts = raw, []
        while rest:
            z = zlib.decompressobj(31)
            try:
                parts.append(z.decompress(rest) + z.flush())
            except zlib.error as e:
                raise ValueError(f"a member of a WARC file is damaged after {sum(map(len, parts))} bytes: {e}") from e
            rest = z.unused_data
        raw = b"".join(parts)
    at = 0
    while at < len(raw):
        head = raw.find(b"\r\n\r\n", at)
        if head < 0:
            raise ValueError(f"the headers of a WARC record at byte {at} are cut off: {raw[at : at + 60]!r}")
        size = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", raw[at : head + 2])
        if not size:
            raise ValueError(f"a WARC record at byte {at} has no Content-Length: {raw[at : at + 60]!r}")
        end = head + 4 + int(size[1])
        yield raw[at:end]
        at = end
        while raw[at : at + 2] == b"\r\n":
            at += 2


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, name, tag): the text before each tag, the tag's name in lower case (/ before it if it closes), and the tag.

    One walk: comments and hidden elements are stepped over, and where no tag closes any more the rest is text.
    """
    at, start, text = 0, 0, []
    while (start := page.find("<", start)) >= 0:
        if page.startswith("<!--", start):
            text.append(page[at:start])
            end = page.find("-->", start + 4)
            at = start = len(page) if end < 0 else end + 3
            continue
        if not (start + 1 < len(page) and (page[start + 1].isascii() and page[start + 1].isalpha() or page[start + 1] in "/!?")):
            start += 1
            continue
        end = page.find(">", start)
        if end < 0:
            break
        found = NAME.match(page, start + 1)
        name = found[0].lower() if found else ""
        text.append(page[at:start])
        at = end + 1
        if name in HIDDEN:
            close = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            name = ""
        if name:
            yield "".join(text), name, page[start : end + 1]
            text = []
        start = at
    yield "".join([*text, page[at:]]), "", ""


def told(page: str) -> tuple[str, str | None, list[str]]:
    """The text of a page (a line for each block element, blanks collapsed, entities resolved), its title, its links."""
    parts, links, title, inside = [], [], None, False
    for text, name, tag in markup(page):
        parts.append(text)
        if inside:
            title += text
        if name in ("title", "/title"):
            inside = name == "title" and title is None
            title = "" if inside else title
        if name.removeprefix("/") in LINES:
            parts.append("\n")
        if name == "a" and (found := HREF.search(tag)):
            links.append(html.unescape(found[1] or found[2] or found[3] or ""))
    lines = html.unescape("".join(parts)).split("\n")
    title = None if title is None else " ".join(html.unescape(title).split())
    return "\n".join(line for x in lines if (line := " ".join(x.split()))), title, links


def plain_text(page: str) -> str:
    return told(page)[0]


def derive(raw: bytes) -> list[dict]:
    """The metadata and the conversion record of one response record; nothing for records of other kinds."""
    headers, block = parse(raw)
    if headers.get("warc-type") != "response":
        return []
    http, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = http.decode("utf-8", "replace").split("\r\n")
    kind = next((v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip().lower() == "content-type"), "")
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    name, source = headers["warc-record-id"], headers.get("warc-payload-digest") or digest(payload)
    text, title, links = told(page)
    fields = [("status", status), ("source-payload-digest", source), *(("source-header", x) for x in lines if x)]
    fields += [("title", title)] if title is not None else []
    fields += [("outlink", x) for x in links]
    out = []
    for warc_type, content_type, body in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)), ("conversion", "text/plain; charset=utf-8", text)):
        held = body.encode("utf-8", "surrogatepass")
        own = f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {warc_type}').urn}>"
        refers = [("WARC-Refers-To", name), ("WARC-Date", headers.get("warc-date", "")), ("WARC-Target-URI", headers.get("warc-target-uri", "")), ("WARC-Payload-Digest", digest(held) if warc_type == "conversion" else "")]
        out.append({"warc_type": warc_type, "record_id": own, "refers_to": name, "target_uri": headers.get("warc-target-uri"), "source_headers": "\n".join([status, *lines]), "source_digest": source, "block_digest": digest(held), "n_bytes": len(held), "content": body, "record": record(warc_type, own, content_type, held, refers)})
    return out


COLUMNS = {"warc_type": "string", "record_id": "string", "refers_to": "string", "target_uri": "string", "source_headers": "string", "source_digest": "string", "block_digest": "string", "n_bytes": "long", "content": "string", "record": "binary"}
ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _rows(found: list[tuple], key: str, key_type: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array([k for k, _ in found], key_type), *(pa.array([r[c] for _, r in found], ARROW[t]) for c, t in COLUMNS.items())]
    return pa.RecordBatch.from_arrays(columns, [key, *COLUMNS])


def derivatives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, warc_type, record_id, refers_to, ...) of (page_id, url, html): two rows for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows([(i, r) for i, u, h in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))) for r in derive(response(i, u, h, date))], "page_id", pa.int64())

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, warc_type, record_id, ...) of the responses in WARC files, plain or gzip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content")):
                found = [(p, r) for x in records(raw.as_py()) for r in derive(x)]
                yield _rows(found, "path", pa.string())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select(F.col("path"), "content")
    return map_arrow(files, run, "path string, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))
