"""WARC derivatives: linked metadata and plain-text conversion records of responses.

A record's bytes follow WARC/1.1. Each HTTP response gives a metadata record (application/warc-fields: the source's
record id, digests, status line and HTTP headers, title and links) and a conversion record (text/plain). Both refer
to the response by WARC-Refers-To and carry its target and date; record ids are name-based, so reruns agree. What
gives no derivative is answered by a row that says why.

HTML is read in one pass of tokens. A token never runs on past the next ``<``, so the time is linear in the page, whatever is left
open in it.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._shared import tidy

VERSION, CRLF = b"WARC/1.1", b"\r\n"
#: Date of responses that are built from pages, which have none.
DATE = "2000-01-01T00:00:00Z"
#: Between two records of a file.
BETWEEN = CRLF + CRLF + b"WARC/1."

# --------------------------------------------------------------------------- HTML
#: Elements that begin and end lines, and those whose content is not shown. Fixed values of HTML.
BLOCKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer nav aside main blockquote pre hr dl dt dd form body html".split())
RAW, UNSEEN = ("script", "style"), frozenset(("noscript", "noframes", "template"))
LINKS = {"a": "L", "img": "E", "link": "E", "script": "E", "iframe": "E"}
#: A comment (open to the end), a tag whose quotes close, any other tag, a declaration. Repeats are possessive: nothing is tried twice.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<[!?][^<>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^<>]*+>", re.I) for name in RAW}
_NUMBER = re.compile(r"&#(?:0*+([0-9]{8,})|[xX]0*+([0-9a-fA-F]{7,}));?")
_SPACE = re.compile(r"[ \t\r\f\v ]+")


def unescape(text: str) -> str:
    """Entities as characters; a number beyond all characters is U+FFFD, however many digits it has."""
    return html.unescape(_NUMBER.sub("�", text)) if "&" in text else text


@dataclass
class Page:
    """What a page shows, says and links to."""

    text: str = ""
    title: str | None = None
    links: list[tuple[str, str, str]] = field(default_factory=list)  # (target, element, attribute)


def read_html(body: str) -> Page:
    """The visible text: hidden elements and tags go, block elements end lines, entities are resolved, spaces collapse.

    Scripts, styles, comments, templates, fallbacks for scripts and frames, and the title are not shown. A title without its end tag ends
    where the head does: at </head> or the first block element. Links are those of all tags, but not in comments, scripts or styles.
    """
    page, shown, titled = Page(), [], []
    hidden, in_title, at = "", False, 0
    end = len(body)
    while at < end:
        m = _TOKEN.search(body, at)
        start = m.start() if m else end
        if start > at and not hidden:
            (titled if in_title else shown).append(body[at:start])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if not hidden and not in_title:
                shown.append(" " if m[0].startswith("<!--") else "")
            continue
        closing = bool(m[1] or m[4])
        if name in LINKS and not closing:
            for a in _ATTRIBUTE.finditer(m[3] if m[2] else m[6]):
                if (what := a[1].lower()) in ("href", "src") and a.lastindex > 1:
                    page.links.append((unescape(a[2] or a[3] or a[4] or ""), name, what))
                    break
        if hidden:
            if closing and name == hidden:
                hidden = ""
                shown.append(" ")
            continue
        if in_title and (name in ("title", "head") and closing or name in BLOCKS):
            in_title = False
            if page.title is None:
                page.title = " ".join(unescape("".join(titled)).split())
            titled = []
        if name in RAW and not closing:
            found = _RAW_END[name].search(body, at)
            at = found.end() if found else end
            shown.append(" ")
        elif name in UNSEEN and not closing:
            hidden = name
        elif name == "title":
            in_title = not closing
            shown.append(" ")
        elif name in BLOCKS and not in_title:
            shown.append("\n")
    if titled and in_title and page.title is None:
        page.title = " ".join(unescape("".join(titled)).split())
    page.text = lines_of(unescape("".join(shown)))
    return page


def lines_of(text: str) -> str:
    return "\n".join(x for line in text.split("\n") if (x := _SPACE.sub(" ", line).strip()))


def plain_text(body: str) -> str:
    return read_html(body).text


# --------------------------------------------------------------------------- records
def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value: control characters (also line ends) become percent escapes."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_id(kind: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {name}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [VERSION, *(f"{k}: {_line(v)}".encode("utf-8", "replace") for k, v in [*headers, ("Content-Length", str(len(block)))]), b"", b""]
    return CRLF.join(head) + block + CRLF + CRLF


def _fields(head: bytes) -> tuple[str, list[tuple[str, str]]]:
    """The first line, and the (name, value) of the others that are fields; a line end may be a bare LF."""
    first, *lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    return first, [(name.strip(), value.strip()) for name, colon, value in (x.partition(":") for x in lines) if colon]


def parse(data: bytes | None) -> tuple[dict[str, str], bytes, str | None]:
    """Headers (lower-case names, the first of each) and block of one record, and what is wrong with it, if anything."""
    head, gap, rest = (data or b"").partition(CRLF + CRLF)
    first, fields = _fields(head)
    found: dict[str, str] = {}
    for name, value in fields:
        found.setdefault(name.lower(), value)
    length = found.get("content-length", "")
    if not first.startswith("WARC/"):
        return {}, b"", "not a WARC record"
    if not re.fullmatch(r"[0-9]{1,18}", length):
        return found, b"", "no Content-Length"
    if not gap or len(rest) < int(length):
        return found, rest, "block is cut off"
    return found, rest[: int(length)], None if found.get("warc-record-id") else "no WARC-Record-ID"


def response(page_id: int | None, url: str | None, body: str | None) -> bytes:
    """A response record for a page; no url: about:blank; no html: an empty payload."""
    payload = (body or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", f"{page_id} {url}")), ("WARC-Date", DATE), ("WARC-Target-URI", url or "about:blank"),
        ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"),
    ], block)


# --------------------------------------------------------------------------- HTTP
def unchunked(data: bytes) -> bytes:
    """The payload of a chunked body; from a broken chunk on, what is there."""
    out, at = [], 0
    while m := re.compile(rb"([0-9a-fA-F]{1,15})[^\n]*\n").match(data, at):
        size = int(m[1], 16)
        out.append(data[m.end() : m.end() + size])
        if not size or m.end() + size >= len(data):
            return b"".join(out)
        at = m.end() + size
        at += 2 if data[at : at + 2] == CRLF else data[at : at + 1] == b"\n"
    return b"".join(out) + data[at:]


def unpacked(data: bytes, coding: str) -> bytes | None:
    """Without a content coding (gzip, deflate; a cut-off stream as far as it goes); None: another coding, or not data of this one."""
    if coding in ("", "identity"):
        return data
    for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
        stream = zlib.decompressobj(bits)
        try:
            return stream.decompress(data)
        except zlib.error:
            continue
    return None


_CHARSET = re.compile(rb"""charset\s*+=\s*+["']?+([A-Za-z0-9_.:-]{1,40})""", re.I)
_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


def decoded(payload: bytes, content_type: str) -> str:
    """The characters: by byte order mark, header, or the first 1024 bytes of the page; else, and for unknown names, UTF-8."""
    name = next((n for mark, n in _MARKS if payload.startswith(mark)), None)
    if not name and (m := _CHARSET.search(content_type.encode()) or _CHARSET.search(payload[:1024])):
        name = m[1].decode()
    try:
        return payload.decode(name or "utf-8", "replace")
    except (LookupError, UnicodeError, ValueError):
        return payload.decode("utf-8", "replace")


# --------------------------------------------------------------------------- derivatives
#: (headers, bytes) of a derived record.
Made = tuple[dict[str, str], bytes]


def derive(data: bytes | None) -> tuple[list[Made], str | None]:
    """The metadata and the conversion record of a response record, and why there are fewer, if so."""
    head, block, wrong = parse(data)
    kind = head.get("warc-type", "")
    if wrong or kind.lower() != "response":
        return [], wrong or f"record is no response but {kind or 'without a type'}"
    http, gap, body = block.partition(CRLF + CRLF)
    if not gap:
        http, gap, body = block.partition(b"\n\n")
    status, fields = _fields(http)
    if not status.startswith("HTTP/"):
        return [], "not an HTTP response"
    source, target, date = head["warc-record-id"], head.get("warc-target-uri", "about:blank"), head.get("warc-date", DATE)
    said: dict[str, str] = {}
    for name, value in fields:
        said.setdefault(name.lower(), value)
    about = [("warc-refers-to", source), ("source-payload-digest", head.get("warc-payload-digest") or digest(body)), ("source-block-digest", head.get("warc-block-digest") or digest(block)), ("source-status", status)]
    about += [(f"source-header-{name.lower()}", value) for name, value in fields]
    page, why = _page(body, said)
    if page:
        if page.title is not None:
            about.append(("title", page.title))
        about += [("outlink", f"{link} {LINKS[name]} {name}/@{what}") for link, name, what in page.links]

    def made(kind: str, content: str, out: bytes) -> Made:
        headers = [
            ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", source),
            ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date), ("WARC-Block-Digest", digest(out)), ("Content-Type", content),
        ]
        return {k.lower(): _line(v) for k, v in headers} | {"content-length": str(len(out))}, record(headers, out)

    lines = CRLF.join(f"{k}: {_line(v)}".encode("utf-8", "replace") for k, v in about) + CRLF
    out = [made("metadata", "application/warc-fields", lines)]
    if page:
        out.append(made("conversion", "text/plain; charset=utf-8", page.text.encode("utf-8", "replace")))
    return out, why


def _page(body: bytes, said: dict[str, str]) -> tuple[Page | None, str | None]:
    kind = said.get("content-type", "text/html")
    media = kind.partition(";")[0].strip().lower()
    if not (media.startswith("text/") or media in ("", "application/xhtml+xml", "application/xml")):
        return None, f"no text in {media}"
    if "chunked" in said.get("transfer-encoding", "").lower():
        body = unchunked(body)
    coding = said.get("content-encoding", "").strip().lower()
    plain = unpacked(body, coding)
    if plain is None:
        return None, f"cannot decode content encoding {coding}"
    text = decoded(plain, kind)
    return (Page(lines_of(text)) if media == "text/plain" else read_html(text)), None


FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type", "block_digest": "warc-block-digest"}
_KINDS = [pa.int64(), *[pa.string()] * len(FIELDS), pa.int64(), pa.string(), pa.string()]
_NAMES = [*FIELDS, "content_length", "source_payload_digest", "skipped"]
#: Rows that a task hands on at once.
_ROWS = 512


def _rows(sources: Iterator[tuple[object, bytes | None]], last: str, key: pa.DataType, name: str, form) -> Iterator[pa.RecordBatch]:
    """Batches of derivatives of (key, record); the column ``last`` is ``form`` of a derivative's bytes."""
    kinds = [key, *_KINDS[1:], pa.string() if last == "record_sha256" else pa.binary()]
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [name, *_NAMES, last])

    for k, data in sources:
        made, why = derive(data)
        stated = (parse(data)[0]).get("warc-payload-digest")
        for head, out in made:
            rows.append((k, *(head.get(c) for c in FIELDS.values()), int(head["content-length"]), stated, None, form(out)))
        if why:
            rows.append((k, *[None] * (len(FIELDS) + 1), stated, why, None))
        if len(rows) >= _ROWS:
            yield batch()
            rows.clear()
    yield batch()


def _schema(key: str, last: str) -> str:
    return f"{key}, " + ", ".join(f"{c} string" for c in FIELDS) + f", content_length long, source_payload_digest string, skipped string, {last}"


def _pages(b: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    for at in range(0, b.num_rows, _ROWS):
        for page, url, body in zip(*(c.to_pylist() for c in b.slice(at, _ROWS).columns), strict=True):
            yield page, response(page, url, body)


def _plain(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record): a response record for each page. A null url is about:blank, a null html an empty payload, a null page_id stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for b in batches:
            ids, made = zip(*_pages(b), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.binary())], ["page_id", "record"])

    return _plain(pages).mapInArrow(run, "page_id long, record binary")


def derivatives(found: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record in ``found`` (a key column of any name, long or string, and record).

    Columns: the key, the header fields in ``FIELDS``, content_length, source_payload_digest (as the source states it), skipped, record
    (the bytes). What gives no conversion, or no derivative at all, has a row in which only key, source_payload_digest and ``skipped``, the reason,
    are set: null, cut-off or malformed records, records that are no HTTP responses, payloads that are no text or in
    an unknown encoding. Records that tie, or repeat, give derivatives each; those of equal sources are equal. An empty table gives an empty
    result. A record is held whole, with its text, by the task that reads it.
    """
    key, kind = found.columns[0], "long" if found.dtypes[0][1] in ("bigint", "int") else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        sources = ((k.as_py(), r.as_py()) for b in batches for k, r in zip(b.column(0), b.column(1), strict=True))
        return _rows(sources, "record", pa.int64() if kind == "long" else pa.string(), key, lambda out: out)

    return found.select(F.col(f"`{key}`").cast(kind), "record").mapInArrow(run, _schema(f"`{key}` {kind}", "record binary"))


def digests(pages: DataFrame) -> DataFrame:
    """The derivatives of pages, with record_sha256 in place of the bytes; responses are built, derived and hashed by one task.

    A null url is about:blank, a null html an empty payload, a null page_id stays null; only those three columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        return _rows((x for b in batches for x in _pages(b)), "record_sha256", pa.int64(), "page_id", lambda out: hashlib.sha256(out).hexdigest())

    return _plain(pages).mapInArrow(run, _schema("page_id long", "record_sha256 string"))


# --------------------------------------------------------------------------- files
def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, record) of the records of .warc and .warc.gz files.

    Spark's text reader cuts files where a record begins and streams through compressed ones, with a gzip member for each record or
    one for all. A payload that holds such a beginning is put together again by its Content-Length. Only large uncompressed
    files are split; if a split falls into such a payload, its record is cut off, and ``derivatives`` says so.
    """
    raw = spark.read.option("lineSep", BETWEEN.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held: tuple[str, bytes] | None = None
        for b in batches:
            for file, piece in zip(b.column(0), b.column(1), strict=True):
                file, piece = file.as_py(), piece.as_py()
                if held and held[0] == file and parse(held[1])[2] == "block is cut off":
                    held = (file, held[1] + BETWEEN + piece)
                    continue
                if held:
                    yield _file_row(*held)
                held = (file, piece if piece.startswith(b"WARC/") else b"WARC/1." + piece) if piece else None
        if held:
            yield _file_row(*held)

    return raw.mapInArrow(run, "file string, record binary")


def _file_row(file: str, data: bytes) -> pa.RecordBatch:
    data = data if data.endswith(CRLF + CRLF) and parse(data[:-4])[2] != "block is cut off" else data + CRLF + CRLF
    return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([data], pa.binary())], ["file", "record"])


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write the records (column ``record``; rows without one are left out) as WARC files, one for each partition; gzip: one stream a file."""
    body = F.expr("substring(record, 1, octet_length(record) - 4)").cast("string")
    records.filter("record is not null").select(body.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)
