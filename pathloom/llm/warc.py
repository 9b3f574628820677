"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

A record is a row: record_type, record_id, target_uri, date, content_type, headers (map: its further WARC
headers by name) and block (bytes). ``derive`` turns each response into two records: a metadata
record (application/warc-fields) with the source's headers, digests, HTTP status and headers, title and out-links, and
a conversion record (text/plain) with the page's text. Transfer and content codings (chunked, gzip, deflate, zstd) are undone first. A
payload that is no text by its content type, or has a coding that is not known or does not hold, gives
the metadata record alone. Both name the response in WARC-Refers-To, keep its
target URI and date, and carry the digests of the source beside those of their own block. Ids are made
from the source's id and the record type, so that a rerun or a retried task gives the same records. One narrow
pass: no shuffle, one record in memory at a time.

``read_warc`` parses WARC files, plain or compressed by member, each a Spark value of up to 2 GB; what is no record (a length that is no
number, a file that ends early) comes as a record of type ``malformed``, so that it can be counted. ``write_warc`` writes plain ones with
Spark's own text writer, so that its committer and any store it knows apply.

Edge cases: records of other types are passed over by derive(); a null or empty block, a block without an
HTTP head, null URIs and null header maps give records with empty text and without the missing fields;
repeated rows give repeated records; repeated HTTP headers give a line each, repeated WARC headers one value joined by commas;
markup is read in time linear in the page; bytes that the charset cannot decode become U+FFFD; an empty table
gives an empty result; further columns with other names are kept out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

RECORD = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, headers map<string,string>, block binary"
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_type", "record_id", "refers_to", "target_uri", "date", "content_type")]
    + [("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())]
)
#: Headers that are columns of a record.
_COLUMNS = {
    "warc-type": "record_type", "warc-record-id": "record_id", "warc-refers-to": "refers_to",
    "warc-target-uri": "target_uri", "warc-date": "date", "content-type": "content_type",
}

# Elements whose content is no text, and those that end a line.
_HIDDEN = "script|style|noscript|template|iframe|svg"
_LINES = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|title|ul"

# Quoted values hold no "<", so that no attempt reads beyond the next one; a tag with others ends at its first ">".
_INSIDE = r"""(?:[^<>"']|"[^"<]*"|'[^'<]*')*+"""
_UNSEEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_HIDDEN})\b(?:{_INSIDE}|[^<>]*)>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAKS = re.compile(rf"</?(?:{_LINES})\b(?:{_INSIDE}>|[^>]*>)", re.I)
_TAGS = re.compile(rf"<[a-zA-Z/!?](?:{_INSIDE}>|[^>]*>)")
_BLANKS = re.compile(r"[^\S\n]+")
_EMPTY_LINES = re.compile(r" ?\n[ \n]*")
_TITLE, _TITLE_END = re.compile(r"<title\b[^<>]*>", re.I), re.compile(r"</title\s*>", re.I)
_LINKS = re.compile(r"""<a\b[^<>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_CHARSET = re.compile(r"""charset\s*=\s*["']?([\w.:-]+)""", re.I)


# Content types, besides text/*, whose payload is text, and those that hold markup.
_TEXT_TYPES = ("application/xhtml+xml", "application/xml", "application/json", "application/javascript", "application/rss+xml", "application/atom+xml")
_MARKUP_TYPES = ("", "text/html", "application/xhtml+xml", "application/xml", "text/xml", "application/rss+xml", "application/atom+xml")


def page_text(page: str) -> str:
    """The text of a page: no markup, hidden elements or comments; a line for each block; entities decoded."""
    page = _UNSEEN.sub("", page)
    end = page.rfind(">") + 1  # behind it no tag ends
    text = _TAGS.sub("", _BREAKS.sub("\n", page[:end])) + page[end:]
    if "&" in text:
        text = html.unescape(text)
    return _EMPTY_LINES.sub("\n", _BLANKS.sub(" ", text)).strip()


def page_title(page: str) -> str | None:
    start = _TITLE.search(page)
    end = _TITLE_END.search(page, start.end()) if start else None
    return page[start.end() : end.start()] if end else None


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def base32_sha1(block: Column) -> Column:
    """digest() as a column."""
    hexed = F.sha1(block)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def record_urn(name: Column) -> Column:
    """A urn:uuid made from name (version 5 layout, over SHA-1)."""
    h = F.sha1(name)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-5"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4], F.lit(">"))


def derived_urn(source_id: str | None, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source_id or ""}#{kind}')}>"


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages as a crawler would store them, with the page's id as a further column."""
    body = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length("body").cast("string"), F.lit("\r\n\r\n"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), body.alias("body"))
    rows = rows.withColumn("block", F.concat(head.cast("binary"), F.col("body")))
    return rows.select(
        "page_id",
        F.lit("response").alias("record_type"),
        record_urn(F.concat_ws("#", F.col("page_id").cast("string"), "target_uri")).alias("record_id"),
        F.lit(None).cast("string").alias("refers_to"),
        "target_uri",
        F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.create_map(F.lit("WARC-Block-Digest"), base32_sha1(F.col("block")), F.lit("WARC-Payload-Digest"), base32_sha1(F.col("body"))).alias("headers"),
        "block",
    )


def _http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status, headers in order (names in lower case) and payload of a stored response."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *rest = head.decode("latin-1").split("\r\n")
    headers = []
    for line in rest:
        name, colon, value = line.partition(":")
        if colon:
            headers.append((name.strip().lower(), value.strip()))
    return (first.split(" ", 2) + ["", ""])[1], headers, payload


def unchunked(payload: bytes) -> bytes:
    """payload without the chunks' sizes. One that is not made of chunks (crawlers often undo them and leave the header)
    comes as it is; of one that ends early what is there."""
    parts, at = [], 0
    while at < len(payload):
        end = payload.find(b"\r\n", at, at + 1024)
        size = payload[at:end].split(b";", 1)[0].strip() if end >= 0 else b""
        if not size or not all(c in b"0123456789abcdefABCDEF" for c in size):
            return b"".join(parts) if parts else payload
        n = int(size, 16)
        if not n:
            break
        parts.append(payload[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(parts)


def uncoded(payload: bytes, coding: str) -> bytes | None:
    """payload without its content codings; None if one of them is not known or does not hold. What a payload that ends early
    still gives is taken."""
    for name in reversed([c.strip().lower() for c in coding.split(",") if c.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                parts = []
                while payload[:2] == b"\x1f\x8b":
                    member = zlib.decompressobj(31)
                    parts.append(member.decompress(payload))
                    payload = member.unused_data
                if not parts:
                    return None
                payload = b"".join(parts)
            elif name == "deflate":
                wrapped = len(payload) > 1 and payload[0] & 15 == 8 and (payload[0] << 8 | payload[1]) % 31 == 0
                payload = zlib.decompressobj(15 if wrapped else -15).decompress(payload)
            elif name == "zstd":
                import zstandard

                payload = zstandard.ZstdDecompressor().decompressobj().decompress(payload)
            elif name != "identity":
                return None
        except Exception as e:
            if type(e).__name__ not in ("error", "ZstdError"):
                raise
            return None
    return payload


def _decoded(payload: bytes, content_type: str) -> str:
    charset = _CHARSET.search(content_type) or _CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _one_line(value: str) -> str:
    return " ".join(html.unescape(value).split())


def derivatives(record_id: str | None, uri: str | None, date: str | None, headers: dict[str, str], block: bytes) -> list[tuple]:
    """The metadata and, if the payload is text, the conversion record of one response, as rows of RECORD."""
    status, http, payload = _http(block)
    first = dict(reversed(http))
    stored = unchunked(payload) if "chunked" in first.get("transfer-encoding", "").lower() else payload
    body = uncoded(stored, first.get("content-encoding", ""))
    kind = first.get("content-type", "")
    media = kind.split(";", 1)[0].strip().lower()
    readable = body is not None and (media == "" or media.startswith("text/") or media in _TEXT_TYPES)
    page = _decoded(body, kind) if readable else ""
    markup = media in _MARKUP_TYPES
    block_digest = headers.get("WARC-Block-Digest") or digest(block)
    payload_digest = headers.get("WARC-Payload-Digest") or digest(stored)
    fields = [("source-block-digest", block_digest), ("source-payload-digest", payload_digest)]
    fields += [(f"source-{name.lower()}", value) for name, value in sorted(headers.items()) if name not in ("WARC-Block-Digest", "WARC-Payload-Digest")]
    fields += [("http-status", status)] if status else []
    fields += [(f"http-{name}", value) for name, value in sorted(http, key=lambda h: h[0])]
    title = page_title(page) if markup else None
    fields += [("title", _one_line(title))] if title is not None else []
    fields += [("outlink", _one_line(a or b or c)) for a, b, c in _LINKS.findall(page)] if markup else []
    about = "".join(f"{name}: {value}\r\n" for name, value in fields).encode("utf-8", "replace")
    source = {"WARC-Source-Block-Digest": block_digest, "WARC-Source-Payload-Digest": payload_digest}
    made = [("metadata", derived_urn(record_id, "metadata"), record_id, uri, date, "application/warc-fields", source | {"WARC-Block-Digest": digest(about)}, about)]
    if readable:
        text = (page_text(page) if markup else page).encode("utf-8", "replace")
        made.append(("conversion", derived_urn(record_id, "conversion"), record_id, uri, date, "text/plain; charset=utf-8", source | {"WARC-Block-Digest": digest(text)}, text))
    return made


def derive(records: DataFrame, *carry: str) -> DataFrame:
    """Metadata and conversion records of the responses among records. carry: columns of any type that each
    derived record keeps from its response."""
    bounded_batches(records.sparkSession)
    source = records.filter(F.col("record_type") == "response").select("record_id", "target_uri", "date", "headers", "block", *carry)
    kept = source.select(*carry).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for i, (record_id, uri, date, headers, block) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:5]], strict=True)):
                found = derivatives(record_id, uri, date, dict(headers or ()), block or b"")
                rows += [(*r[:6], list(r[6].items()), r[7]) for r in found]
                of += [i] * len(found)
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
            more = [c.take(pa.array(of, pa.int64())) for c in batch.columns[5:]]
            yield pa.record_batch([*more, *[pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)]], names=[*carry, *_ARROW.names])

    return source.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], RECORD]))


def serialised(record: dict) -> bytes:
    """A record as it stands in a file."""
    block = record["block"] or b""
    head = [("WARC-Type", record["record_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Refers-To", record["refers_to"])]
    head += [("WARC-Target-URI", record["target_uri"]), ("WARC-Date", record["date"]), *sorted(dict(record["headers"] or ()).items())]
    head += [("Content-Type", record["content_type"]), ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head if value is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a file, by their Content-Length. What is no record comes as one of type malformed, with the reason among its
    headers, and reading goes on at the next line that begins a record, where there is one."""
    stream = gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)

    def malformed(why: str, record_id: str | None = None) -> dict:
        return dict.fromkeys(_ARROW.names) | {"record_type": "malformed", "record_id": record_id, "headers": {"reason": why}, "block": b""}

    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            record: dict = dict.fromkeys(_ARROW.names)
            headers: dict[str, str] = {}
            length = None
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                name, value = name.strip(), value.strip()
                if name.lower() == "content-length":
                    length = int(value) if value.isascii() and value.isdigit() else None
                elif name.lower() in _COLUMNS:
                    record[_COLUMNS[name.lower()]] = value
                else:
                    headers[name] = f"{headers[name]}, {value}" if name in headers else value
            block = stream.read(length) if length is not None else b""
            if length is None:
                yield malformed("no valid Content-Length", record["record_id"])
            elif len(block) < length:
                yield malformed("the file ends within the record", record["record_id"])
            else:
                yield record | {"headers": headers, "block": block}
    except (EOFError, OSError, zlib.error) as e:
        yield malformed(f"the file cannot be read on: {type(e).__name__}")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under path, a file a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for r in parse_warc(data):
                    columns = [[list(r[n].items()) if n == "headers" else r[n]] for n in _ARROW.names]
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def write_warc(records: DataFrame, path: str) -> None:
    """Plain WARC files, one for each partition. The text writer puts a line end behind each value, which is
    the last byte of a record; a string column carries any bytes."""
    schema = pa.schema([("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [serialised(r)[:-1] for r in batch.to_pylist()]
            yield pa.record_batch([pa.array(values, pa.binary())], schema=schema)

    made = records.select(*_ARROW.names).mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)
