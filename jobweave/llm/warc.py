"""WARC derivatives: response records become linked metadata and plain-text conversion records.

`responses` writes pages as WARC response records; `derivatives` parses any such records and returns, for each, a
metadata record (title, language and outlinks as warc-fields) and a conversion record (text/plain). Both name the
source in WARC-Refers-To, with its target, date, and digests. All WARC and HTTP headers of the source, in order and with
repeats, its HTTP status and its digests are kept in columns and in the metadata record.

Transfer codings, then content codings are undone before the text is read (chunked, gzip, deflate). A body that doesn't
begin as its coding does (no chunk size, no gzip mark) was undone by the record's writer and is read as it is. Of a cut
body, what came is read; of a broken one or of another coding, nothing; `body_error` says so in both cases.

Defined cases: null html or a null url is empty text. A record that is no response, or that can't be parsed, gives one
row of type "invalid" with the reason, so nothing is lost. So does a record whose block digest is another than its bytes';
digests of algorithms or codings that aren't known are kept and not judged. Repeated rows give repeated records with equal ids. Extra
columns are ignored; an empty table gives an empty one.
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
from pyspark.sql import DataFrame

END = "\r\n"
#: The date of records made from pages, which have none of their own.
DATE = "2024-01-01T00:00:00Z"
SKIP = re.compile(r"<(script|style|noscript|template|svg|iframe)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<head\b.*?(?:</head\s*>|(?=<body)|\Z)", re.S | re.I)
BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*(?:>|\Z)", re.I)
TAG = re.compile(r"<[a-zA-Z/!?][^>]*(?:>|\Z)")
LINK = re.compile(r"<(a|area|link)(?=[\s/])((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))")
TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
FIELDS = "record_type string, record_id string, refers_to string, target_uri string, date string, http_status int, source_content_type string, source_payload_digest string, payload_digest string, block_digest string, content_length long, record binary, text string"
#: Columns with the source's headers, after those of FIELDS.
SOURCE = "source_block_digest string, warc_headers array<struct<name: string, value: string>>, http_headers array<struct<name: string, value: string>>, body_error string, payload_verified boolean"


def digest(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def agrees(claim: str | None, body: bytes) -> bool | None:
    """Whether a labelled digest, in base32 or hexadecimal of either case, is that of the bytes; null if it can't be told."""
    name, _, value = (claim or "").partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None
    made = hashlib.new(name, body).digest()
    codings = {base64.b32encode(made).decode().rstrip("="): value.upper().rstrip("="), made.hex(): value.lower()}
    same_length = [k for k, v in codings.items() if len(k) == len(v)]
    return any(k == codings[k] for k in same_length) if same_length else None


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1" + END + "".join(f"{k}: {v}{END}" for k, v in [*fields, ("Content-Length", str(len(block)))]) + END
    return head.encode() + block + (END * 2).encode()


def named(*parts: str) -> str:
    """A record id that depends on what it names alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def one_line(value: str) -> str:
    return " ".join(value.split())


def response(page_id: int, url: str | None, page: str | None) -> bytes:
    body = (page or "").encode()
    block = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {len(body)}{END * 2}".encode() + body
    uri = one_line(url or "")
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", named(str(page_id), uri, digest(body))), ("WARC-Target-URI", uri), ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)),
    ], block)


def readable(raw: bytes) -> str:
    try:
        return raw.decode().strip()
    except UnicodeDecodeError:
        return raw.decode("latin-1").strip()


class Fields(dict):
    """Values by lower-case name, the last of repeated ones; `rows` has each field as (name, value), in order."""

    def __init__(self, head: bytes) -> None:
        lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
        self.rows = [(readable(k), readable(v)) for k, c, v in (x.partition(b":") for x in lines) if c]
        super().__init__((k.lower(), v) for k, v in self.rows)

    def codings(self, name: str) -> list[str]:
        """All codings that fields of this name list, the last applied first."""
        listed = [c.strip().lower() for k, v in self.rows if k.lower() == name for c in v.split(",")]
        return [c for c in reversed(listed) if c and c != "identity"]


def unchunked(body: bytes) -> tuple[bytes, str | None]:
    out, at = [], 0
    while size := re.compile(rb"([0-9a-fA-F]+)[ \t]*(?:;[^\r\n]*)?\r\n").match(body, at):
        n, at = int(size[1], 16), size.end()
        if not n:
            return b"".join(out), None
        out.append(body[at : at + n])
        if at + n > len(body):
            return b"".join(out), "chunked: cut"
        at += n
        if body[at : at + 2] != b"\r\n":
            return (b"".join(out), "chunked: cut") if at + 2 > len(body) else (b"", "chunked: broken")
        at += 2
    if not at:
        return body, None  # undone already
    return (b"".join(out), "chunked: cut") if re.fullmatch(rb"[0-9a-fA-F]*[^\r\n]*\r?", body[at:]) else (b"", "chunked: broken")


def inflated(body: bytes, coding: str) -> tuple[bytes, str | None]:
    if coding == "gzip" and not body.startswith(b"\x1f\x8b"):
        return body, None  # undone already
    for bits in (31,) if coding == "gzip" else (15, -15):
        out, rest = [], body
        try:
            while rest and (not out or rest.startswith(b"\x1f\x8b")):  # members; other bytes behind them are padding
                one = zlib.decompressobj(bits)
                out.append(one.decompress(rest))
                if not one.eof:
                    return b"".join(out), f"{coding}: cut"
                rest = one.unused_data
            return b"".join(out), None
        except zlib.error:
            pass
    return b"", f"{coding}: broken"


def undone(http: Fields, body: bytes) -> tuple[bytes, str | None]:
    """The body without its codings, and what was wrong with it."""
    errors = []
    for coding in [*http.codings("transfer-encoding"), *http.codings("content-encoding")]:
        coding = coding.split(";")[0].strip().removeprefix("x-")
        body, error = unchunked(body) if coding == "chunked" else inflated(body, coding) if coding in ("gzip", "deflate") else (b"", f"{coding}: not known")
        if error:
            errors.append(error)
        if not body:
            break
    return body, "; ".join(errors) or None


def parsed(raw: bytes) -> tuple[Fields, int, Fields, bytes]:
    """WARC fields, HTTP status, HTTP fields and payload of a response record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not gap:
        raise ValueError("no WARC header")
    warc = Fields(head)
    if warc.get("warc-type") != "response":
        raise ValueError(f"type {warc.get('warc-type')}")
    block = rest[: int(warc.get("content-length", len(rest)))]
    if agrees(warc.get("warc-block-digest"), block) is False:
        raise ValueError("block digest differs")
    http, _, body = block.partition(b"\r\n\r\n")
    status = re.match(rb"HTTP/\S+ (\d{3})", http)
    if not status:
        raise ValueError("no HTTP status")
    return warc, int(status[1]), Fields(http), body


def outlinks(page: str) -> Iterator[tuple[str, str]]:
    """(element, target) of each link, by its first attribute named href."""
    for tag in LINK.finditer(page):
        for name, *values in ATTRIBUTE.findall(tag[2]):
            if name.lower() == "href":
                yield tag[1].lower(), html.unescape("".join(values)).strip()
                break


def plain_text(page: str) -> str:
    rough = TAG.sub("", BREAK.sub("\n", SKIP.sub(" ", page)))
    return "\n".join(x for x in (" ".join(line.split()) for line in html.unescape(rough).split("\n")) if x)


def derived(raw: bytes | None) -> list[tuple]:
    try:
        warc, status, http, body = parsed(raw or b"")
    except ValueError as reason:
        return [("invalid", None, None, None, None, None, None, None, None, None, 0, raw, str(reason), None, None, None, None, None)]
    source, uri, date = (warc.get(k, "") for k in ("warc-record-id", "warc-target-uri", "warc-date"))
    given = warc.get("warc-payload-digest")
    kind, payload = http.get("content-type", ""), given or digest(body)
    chunked = "chunked" in (c.split(";")[0].strip() for c in http.codings("transfer-encoding"))
    verified = agrees(given, body) or (chunked and agrees(given, unchunked(body)[0]) or agrees(given, body))
    block_digest = warc.get("warc-block-digest")
    body, body_error = undone(http, body)
    charset = re.search(r"charset=[\"']?([\w-]+)", kind)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    title, lang = TITLE.search(page), LANG.search(page)
    links = [f"outlink: {target} {'L' if element == 'a' else 'E'} {element}/@href" for element, target in outlinks(page)]
    facts = [("title", one_line(html.unescape(title[1])) if title else ""), ("lang", lang[1] if lang else ""), ("http-status", str(status)), ("source-content-type", kind), ("source-payload-digest", payload), ("source-block-digest", block_digest), ("body-error", body_error)]
    facts += [(kind_of, f"{k}: {one_line(v)}") for kind_of, head in (("source-warc-header", warc), ("source-http-header", http)) for k, v in head.rows]
    meta = "".join(f"{k}: {v}{END}" for k, v in facts if v) + "".join(f"{one_line(x)}{END}" for x in links)
    out = []
    for name, content, text in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", plain_text(page))):
        block = text.encode()
        own = digest(block)
        made = named(name, source)
        whole = record([
            ("WARC-Type", name), ("WARC-Record-ID", made), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date),
            ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Source-Payload-Digest", payload), ("WARC-Payload-Digest", own), ("WARC-Block-Digest", own), ("Content-Type", content),
        ], block)
        out.append((name, made, source, uri, date, status, kind, payload, own, own, len(block), whole, text, block_digest, warc.rows, http.rows, body_error, verified))
    return out


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record): a WARC response record of each page."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b["page_id"].to_pylist(), b["url"].to_pylist(), b["html"].to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([b["page_id"], pa.array([response(*r) for r in rows], pa.binary())], names=["page_id", "record"])

    return pages.select("page_id", "url", "html").mapInArrow(write, f"page_id {pages.schema['page_id'].dataType.simpleString()}, record binary")


def derivatives(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Metadata and conversion records of each row of records(key, record)."""
    pairs = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    kinds = [pa.string()] * 5 + [pa.int32()] + [pa.string()] * 4 + [pa.int64(), pa.binary(), pa.string(), pa.string(), pairs, pairs, pa.string(), pa.bool_()]
    names = [f.split()[0] for f in FIELDS.split(", ")] + ["source_block_digest", "warc_headers", "http_headers", "body_error", "payload_verified"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                made = [derived(r) for r in b["record"].to_pylist()]
                ids = b[key].take(pa.array([k for k, m in enumerate(made) for _ in m], pa.int64()))
                columns = zip(*(x for m in made for x in m), strict=True)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[key, *names])

    return records.select(key, "record").mapInArrow(read, f"{key} {records.schema[key].dataType.simpleString()}, {FIELDS}, {SOURCE}")
