"""WARC records and a derivative builder: responses become linked metadata and plain-text conversion records.

``read`` streams the records of WARC files, ``responses`` makes records of a table of pages, and ``derive``
turns either's response records into derivatives. Pages are scanned once from left to right, as a
browser's tokeniser does, so a malformed one takes no more time than another of its length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_rows

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-records")

# Elements that show no text, and elements that begin a line.
HIDDEN = frozenset("script style noscript template".split())
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th title tr ul".split())
# Text up to a tag, then its slash, name and attributes, where nothing in it looks like another tag: no step of this backtracks
# and a failure looks no further than the next <, so pages of any kind take linear time.
_PLAIN_TAG = re.compile(r"([^<]*+)<(/?)([a-zA-Z][^\s/<>=]*+)(?=[\s/>])([^<>=]*+(?:=(?:\s*+\"[^\"<]*+\"|\s*+'[^'<]*+'|(?!\s*+[\"']))[^<>=]*+)*+)>")
SPECIAL = HIDDEN | {"head", "body", "title", "a", "html"}  # elements of which more than their tags matter
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_TAG_PART = re.compile(r"=\s*([\"'])|>")
_VALUE = re.compile(r"(?<![\w-])(href|lang)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_ENDS = {n: re.compile(rf"</{n}(?=[\s/>])", re.IGNORECASE) for n in (*HIDDEN, "title")}
CHUNK = 1 << 20


class Record(NamedTuple):
    """A WARC record: its named fields in order, and its block."""

    fields: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.fields if k.lower() == name.lower()), None)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*key: object) -> str:
    """A URN that equal keys share, so reruns make the same records."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, repr(key))}>"


def to_bytes(record: Record) -> bytes:
    """The record as it stands in a file; its Content-Length is that of its block."""
    fields = [(k, v) for k, v in record.fields if k.lower() != "content-length"] + [("Content-Length", str(len(record.block)))]
    clean = (f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in fields)
    return f"{VERSION}\r\n{''.join(clean)}\r\n".encode() + record.block + b"\r\n\r\n"


def _inflated(raw) -> Iterator[bytes]:
    """A stream's bytes, a bounded number at a time; gzip members, of which there may be any number, come inflated."""
    data = raw.read(CHUNK)
    packed = data[:2] == b"\x1f\x8b"
    inflater = zlib.decompressobj(31)
    while data:
        if not packed:
            yield data
            data = raw.read(CHUNK)
            continue
        yield inflater.decompress(data, CHUNK)
        data = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
        if inflater.eof:
            inflater = zlib.decompressobj(31)
        data = data or raw.read(CHUNK)


def records(raw) -> Iterator[Record]:
    """Records of a WARC stream, plain or gzipped, one at a time in memory."""
    chunks, held, at = _inflated(raw), bytearray(), 0

    def more() -> bool:
        nonlocal at
        del held[:at]
        at = 0
        for chunk in chunks:
            held.extend(chunk)
            if chunk:
                return True
        return False

    place = 0
    while True:
        while held[at : at + 1] in (b"\r", b"\n") or at >= len(held):
            if at < len(held):
                at, place = at + 1, place + 1
            elif not more():
                return
        searched = at
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            back = len(held) - at
            if not held.startswith(b"WARC/"[:back], at) or not more():
                raise ValueError(f"no WARC record at byte {place}")
            searched = max(at, back - 3)
        if not held.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {place}")
        lines = held[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines)]
        length = int(next((v for k, v in fields if k.lower() == "content-length"), "-1"))
        if length < 0:
            raise ValueError(f"record at byte {place} has no length")
        place, at = place + end + 4 - at, end + 4
        while len(held) - at < length:
            if not more():
                raise ValueError(f"record before byte {place + length} is cut short")
        yield Record(fields, bytes(held[at : at + length]))
        place, at = place + length, at + length


def from_bytes(data: bytes) -> Iterator[Record]:
    """Records of a WARC file's content, plain or gzipped by record."""
    return records(io.BytesIO(data))


def response(key: object, url: str | None, body: str | None, date: str = DATE) -> Record:
    """A response record with a page as its HTTP payload; a null page has an empty one."""
    payload = (body or "").encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload
    fields = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", key, url)),
        ("WARC-Date", date),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return Record(fields, block)


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response; line ends may lack the carriage return."""
    parts = re.split(rb"\r?\n\r?\n", block, maxsplit=1)
    status, *lines = parts[0].decode("latin-1").replace("\r\n", "\n").split("\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines)], parts[1] if len(parts) > 1 else b""


def _unchunked(data: bytes) -> bytes:
    """A chunked payload's content, as far as its chunks are whole; data that is not chunked stays."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at, at + 64)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if size <= 0:
            break
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out) if out else data


def body(payload: bytes, headers: list[tuple[str, str]]) -> bytes | None:
    """A payload without its transfer and content codings; None where a coding is not known or the data is broken."""
    found: dict[str, str] = {}
    for k, v in headers:
        found.setdefault(k.lower(), v.lower())
    if "chunked" in found.get("transfer-encoding", ""):
        payload = _unchunked(payload)
    for coding in reversed([c.strip() for c in found.get("content-encoding", "").split(",") if c.strip()]):
        try:
            if coding in ("gzip", "x-gzip"):
                payload = zlib.decompressobj(47).decompress(payload)
            elif coding == "deflate":
                payload = zlib.decompressobj(15 if payload[:1] == b"x" else -15).decompress(payload)
            elif coding != "identity":
                return None
        except zlib.error:
            return None
    return payload


def _decoded(payload: bytes, headers: list[tuple[str, str]]) -> str:
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    charset = re.search(r"charset\s*=\s*\"?([\w-]+)", kind, re.IGNORECASE)
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _tag_end(page: str, at: int) -> int:
    """Where a tag ends whose name ends at ``at``: past its >, or the page's end if it is never closed."""
    while m := _TAG_PART.search(page, at):
        if not m[1]:
            return m.end()
        at = page.find(m[1], m.end()) + 1
        if not at:
            break
    return len(page)


class Page(NamedTuple):
    """What a scan finds: visible text, the title, the language and the links."""

    text: str
    title: str | None
    language: str | None
    links: list[str]


def _line(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def scan(page: str) -> Page:
    """One pass over a page: text outside hidden elements and the head, a line for each block, blanks within it squeezed, entities resolved.

    A tag, comment or hidden element that is never closed takes the rest of the page with it.
    """
    parts, links, title, language, in_head, at = [], [], None, None, False, 0
    while True:
        if m := _PLAIN_TAG.match(page, at):
            before, slash, name, _ = m.groups()
            inner, at = m.start(4), m.end()
            if before and not in_head:
                parts.append(before.replace("\n", " "))
        else:
            lt = page.find("<", at)
            if lt < 0:
                break
            if not in_head:
                parts.append(page[at:lt].replace("\n", " "))
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else len(page)
                parts.append(" ")
                continue
            m = _NAME.match(page, lt)
            if not m:
                if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                    end = page.find(">", lt)
                    at = end + 1 if end >= 0 else len(page)
                else:
                    parts.append("" if in_head else "<")
                    at = lt + 1
                continue
            slash, name, inner = page[lt + 1] == "/", m[1], m.end()
            at = _tag_end(page, inner)
        name = name.lower()
        if name in BLOCKS and parts and parts[-1] != "\n":
            parts.append("\n")
        if name not in SPECIAL:
            continue
        if name == "head":
            in_head = not slash
        elif name == "body":
            in_head = False
        if slash:
            continue
        if name in ("a", "html"):
            for key, *values in _VALUE.findall(page, inner, at):
                value = next((v for v in values if v), "")
                if name == "a" and key.lower() == "href":
                    links.append(_line(value))
                    break
                if name == "html" and key.lower() == "lang":
                    language = language or value
        if name in _ENDS:
            end = _ENDS[name].search(page, at)
            inside = page[at : end.start() if end else len(page)]
            if name == "title" and title is None:
                title = _line(inside)
            if name == "title" and not in_head:
                parts.append(inside.replace("\n", " "))
            if name in HIDDEN:
                parts.append(" ")
            at = _tag_end(page, end.end()) if end else len(page)
    if not in_head:
        parts.append(page[at:].replace("\n", " "))
    text = "".join(parts)
    lines = [" ".join(raw.split()) for raw in (entities.unescape(text) if "&" in text else text).split("\n")]
    return Page("\n".join(filter(None, lines)), title, language, links)


def plain_text(page: str) -> str:
    """Visible text of a page."""
    return scan(page).text


TEXTUAL = ("text/html", "application/xhtml+xml", "text/plain")


def derivatives(source: Record) -> list[Record]:
    """Metadata and conversion records of a response record, to which both refer; of other records, none.

    Both keep the source's URI and date. The metadata record lists the source's digests, the HTTP status
    and every HTTP header, then the title, language and links of a page, and names the conversion record.
    A response of another type than text or a page, or in an unknown coding, has no conversion record. A record
    without digests gets its own, one without an id refers to nothing.
    """
    if source.get("WARC-Type") != "response":
        return []
    status, headers, payload = http(source.block)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "text/html").split(";")[0].strip().lower()
    plain = body(payload, headers)
    origin = source.get("WARC-Record-ID") or ""
    shared = [("WARC-Refers-To", origin), ("WARC-Date", source.get("WARC-Date") or DATE), ("WARC-Target-URI", source.get("WARC-Target-URI") or "")]
    found = [("source-payload-digest", source.get("WARC-Payload-Digest") or digest(payload)), ("source-block-digest", source.get("WARC-Block-Digest") or digest(source.block)), ("http-status", status)]
    found += [(f"http-header-{k.lower()}", v) for k, v in headers]
    key = origin or digest(source.block)
    meta_id, text_id = record_id("metadata", key), record_id("conversion", key)
    text = None
    if plain is not None and kind in TEXTUAL:
        content = _decoded(plain, headers)
        if kind == "text/plain":
            text = content
        else:
            page = scan(content)
            text = page.text
            found += [(n, v) for n, v in (("title", page.title), ("language", page.language)) if v is not None]
            found += [("outlink", f"{link} L a/@href") for link in page.links]
        found.append(("conversion", text_id))
    notes = "".join(f"{k}: {v}\r\n" for k, v in found).encode("utf-8", "replace")
    out = [Record([("WARC-Type", "metadata"), ("WARC-Record-ID", meta_id), *shared, ("WARC-Block-Digest", digest(notes)), ("Content-Type", "application/warc-fields")], notes)]
    if text is not None:
        data = text.encode("utf-8", "replace")
        out.append(Record([("WARC-Type", "conversion"), ("WARC-Record-ID", text_id), *shared, ("WARC-Block-Digest", digest(data)), ("Content-Type", "text/plain; charset=utf-8")], data))
    return out


FIELDS = "array<struct<name:string,value:string>>"
RECORDS = f"record_type string, record_id string, target_uri string, fields {FIELDS}, block binary"


def _columns(found: Iterable[Record]) -> list[tuple]:
    rows = [(r.get("WARC-Type"), r.get("WARC-Record-ID"), r.get("WARC-Target-URI"), [{"name": k, "value": v} for k, v in r.fields], r.block) for r in found]
    return list(zip(*rows, strict=True)) or [()] * 5


def responses(pages: DataFrame) -> DataFrame:
    """A response record, in columns ``RECORDS``, of every row of ``pages``, which has page_id, url and html; its other columns pass through.

    A null url is an empty URI and a null page an empty payload; equal rows give equal records.
    """

    def make(ids, urls, bodies):
        return _columns(response(*row) for row in zip(ids, urls, bodies, strict=True))

    return map_rows(pages, ["page_id", "url", "html"], RECORDS, make, drop=["url", "html"])


DERIVED = f"record_type string, record_id string, refers_to string, target_uri string, record_date string, source_digest string, block_digest string, content_type string, content_length long, fields {FIELDS}, content string"


def _derived(sources: Iterable[Record]) -> list:
    """Columns ``DERIVED`` of the derivatives of each source, after the number of the source that each row is from."""
    rows = []
    for n, source in enumerate(sources):
        for r in derivatives(source):
            of = dict(r.fields)
            listed = [{"name": k, "value": v} for k, v in r.fields]
            rows.append((n, of["WARC-Type"], of["WARC-Record-ID"], of["WARC-Refers-To"], of["WARC-Target-URI"], of["WARC-Date"], source.get("WARC-Payload-Digest"), of["WARC-Block-Digest"], of["Content-Type"], len(r.block), listed, r.block.decode("utf-8", "replace")))
    return list(zip(*rows, strict=True)) or [()] * 12


def derive(found: DataFrame) -> DataFrame:
    """The derivatives of every response record in ``found``, which has columns fields and block; its others pass through, but for names of ``DERIVED``.

    One pass, no shuffle. Null fields or blocks count as empty; records of other types give no row, and so does an
    empty table. Blocks of any length are scanned once.
    """

    def make(fields, blocks):
        return _derived(Record([(f["name"], f["value"]) for f in named or ()], block or b"") for named, block in zip(fields, blocks, strict=True))

    return map_rows(found, ["fields", "block"], f"_from long, {DERIVED}", make, drop=["block"])


def derive_pages(pages: DataFrame) -> DataFrame:
    """page_id and the fields of both records derived from every page's response record, which is made in the same pass."""

    def make(ids, urls, bodies):
        return _derived(response(*row) for row in zip(ids, urls, bodies, strict=True))

    return map_rows(pages.select("page_id", "url", "html"), ["page_id", "url", "html"], f"_from long, {DERIVED}", make, drop=["url", "html"])


def _opened(path: str):
    """A stream of a file that workers can reach: a mounted path, or any address that Arrow's file systems know."""
    from pyarrow import fs

    if re.match(r"file:/(?!//)", path):
        path = "file://" + path[5:]
    system, inside = fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)
    return system.open_input_stream(inside, compression=None)


def read(spark: SparkSession, path: str, opened=_opened) -> DataFrame:
    """Records of WARC files: path and columns ``RECORDS``. Files are streamed where ``opened`` opens them, a batch of records at a time in memory."""

    struct = T.StructType.fromDDL(f"path string, {RECORDS}")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(struct)

        def batch_of(file, held):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[file] * len(held), *_columns(held)], schema.types, strict=True)], names=schema.names)

        for batch in batches:
            for file in batch.column("path").to_pylist():
                held, size = [], 0
                with opened(file) as raw:
                    for r in records(raw):
                        held.append(r)
                        size += len(r.block)
                        if size > 8 * CHUNK:
                            yield batch_of(file, held)
                            held, size = [], 0
                if held:
                    yield batch_of(file, held)

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(run, struct)


def file_contents(records: Iterable[Record], compress: bool = True) -> bytes:
    """A WARC file of the records, each a gzip member of its own."""
    return b"".join(gzip.compress(to_bytes(r), mtime=0) if compress else to_bytes(r) for r in records)


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return derive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("fields")
