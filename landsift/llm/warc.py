"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Both derived records name the response in WARC-Refers-To and keep its target URI, date and payload digest; the
metadata record carries the source's HTTP headers, status, title, links and sizes; the conversion record carries the
page's text. Record ids are derived from content, so a lost task writes the same records again. The work is narrow:
records are parsed and written one by one, in slices.

Defined cases: a null html is an empty body, a null url leaves WARC-Target-URI out; a record that can't be parsed or
isn't a response yields no derivative in `derive`, and reading goes on after it; chunked and gzipped or deflated bodies
are unpacked for the text, while digests and lengths are of the body as it was sent; repeated rows yield records each, with equal ids; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import by_size, ship

CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|br|div|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|title|blockquote|pre|hr|dt|dd|body|html|head)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>?")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_HREF = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('\n'.join(parts).encode()).digest()[:16], version=4)}>"


def plain_text(page: str) -> str:
    """The text of a page: scripts, styles and comments go, block tags break lines, entities are resolved, blanks are
    folded and empty lines dropped."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page)))
    lines = (" ".join(line.split()) for line in html_.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def record(kind: str, id_: str, headers: list[tuple[str, str]], content_type: str, block: bytes) -> bytes:
    """One WARC/1.1 record."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", id_), *headers, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1" + CRLF + b"".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}".encode() + CRLF for k, v in head) + CRLF + block + CRLF + CRLF


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in data, which may be gzipped record by record (a damaged member ends what can be
    unpacked). A record that is cut off or malformed is passed over: reading goes on at the next line that begins one."""
    if data[:2] == b"\x1f\x8b":
        data = _unpacked(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(CRLF + CRLF, at)
        if (at and data[at - 1 : at] != b"\n") or end < 0:
            at += 5
            continue
        headers = {}
        for line in data[at:end].split(CRLF)[1:]:
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        size = headers.get("content-length", "")
        if not size.isdigit() or end + 4 + int(size) > len(data):
            at += 5
            continue
        yield headers, data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)


def _unpacked(data: bytes) -> bytes:
    """All members of a gzip file, up to the first that is damaged."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data) + member.flush())
        except zlib.error:
            break
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def plain_body(body: bytes, http: dict[str, str]) -> bytes:
    """A response's body without chunks and content coding (gzip, deflate); one that doesn't follow its header stays as
    it is."""
    if "chunked" in http.get("transfer-encoding", "").lower():
        rest, parts = body, []
        while (m := re.match(rb"([0-9a-fA-F]+)[^\r\n]*\r\n", rest)) and int(m[1], 16):
            parts.append(rest[m.end() : m.end() + int(m[1], 16)])
            rest = rest[m.end() + int(m[1], 16) + 2 :]
        body = b"".join(parts) if parts else body
    coding = http.get("content-encoding", "").lower().strip()
    for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
        try:
            return zlib.decompress(body, bits)
        except zlib.error:
            continue
    return body


def response(url: str | None, page: str | None, date: str = DATE) -> bytes:
    body = (page or "").encode("utf-8", "replace")
    block = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}".encode(), b"", b""]) + body
    target = [("WARC-Target-URI", url)] if url is not None else []
    return record("response", record_id("response", url or "", date, digest(block)), [*target, ("WARC-Date", date), ("WARC-Payload-Digest", digest(body))], "application/http; msgtype=response", block)


def derivatives(headers: dict[str, str], block: bytes) -> list[tuple[str, str, str, bytes]]:
    """(kind, id, refers_to, record) of a response's two derivatives."""
    head, _, body = block.partition(CRLF + CRLF)
    status, *lines = head.decode("latin-1").split("\r\n")
    http = [tuple(map(str.strip, line.partition(":")[::2])) for line in lines if ":" in line]
    named = {k.lower(): v for k, v in http}
    kind, plain = named.get("content-type", ""), plain_body(body, named)
    charset = m[1] if (m := re.search(r"charset=[\"']?([\w-]+)", kind, re.I)) else "utf-8"
    try:
        page = plain.decode(charset, "replace")
    except LookupError:
        page = plain.decode("utf-8", "replace")
    origin, payload = headers.get("warc-record-id", ""), headers.get("warc-payload-digest") or digest(body)
    linked = [(n, headers[n.lower()]) for n in ("WARC-Target-URI", "WARC-Date") if n.lower() in headers] + [("WARC-Refers-To", origin)]
    title = " ".join(html_.unescape(_TAG.sub("", t[1])).split()) if (t := _TITLE.search(page)) else ""
    text = plain_text(page).encode()
    links = [html_.unescape(next(x for x in m if x is not None)) if any(m) else "" for m in (tuple(y or None for y in m) for m in _HREF.findall(page))]
    fields = [("http-status", status), *[(f"http-header-{k.lower()}", v) for k, v in http], ("source-payload-digest", payload), ("source-length", str(len(body))), ("text-length", str(len(text))), ("title", title), *[("outlink", x) for x in links]]
    meta = b"".join(f"{k}: {' '.join(v.split())}".encode("utf-8", "replace") + CRLF for k, v in fields)
    out = []
    for name, content, data, extra in (("metadata", "application/warc-fields", meta, [("X-Source-Payload-Digest", payload)]), ("conversion", "text/plain; charset=utf-8", text, [("WARC-Payload-Digest", digest(text)), ("X-Source-Payload-Digest", payload)])):
        id_ = record_id(name, origin, payload)
        out.append((name, id_, origin, record(name, id_, [*linked, *extra], content, data)))
    return out


RESPONSES, DERIVED = "record binary", "kind string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, content_length long, block string, record binary"


def responses(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(id, record): a response record of each page."""
    ship(pages.sparkSession)

    def run(batches):
        for s in by_size(batches, 2, rows=256):
            yield pa.RecordBatch.from_arrays([s.column(0), pa.array([response(u, h) for u, h in zip(s.column(1).to_pylist(), s.column(2).to_pylist(), strict=True)], pa.binary())], names=["id", "record"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), F.col(page).alias("page")).mapInArrow(run, f"id long, {RESPONSES}")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(id, record) of WARC files, plain or gzipped; id is null. A file is split into records in its task, which holds it
    whole: files are to be of the usual size, about 1 GB at most."""
    ship(spark)

    def run(batches):
        for b in batches:
            for data in b.column(0):
                for headers, block in parse(data.as_py()):
                    names = [(k, v) for k, v in headers.items() if k not in ("warc-type", "warc-record-id", "warc-block-digest", "content-type", "content-length")]
                    one = record(headers.get("warc-type", ""), headers.get("warc-record-id", ""), names, headers.get("content-type", ""), block)
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([one], pa.binary())], names=["id", "record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"id long, {RESPONSES}")


def derive(records: DataFrame) -> DataFrame:
    """Of rows (id, record) the derivatives of each response record: id and DERIVED."""
    ship(records.sparkSession)
    names = ["id", *[f.split()[0] for f in DERIVED.split(", ")]]

    def run(batches):
        for s in by_size(batches, 1):
            out = [[] for _ in names]
            for id_, data in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True):
                for headers, block in parse(data or b""):
                    if headers.get("warc-type") != "response":
                        continue
                    for kind, rid, origin, made in derivatives(headers, block):
                        own, text = next(parse(made))
                        for c, x in zip(out, (id_, kind, rid, origin, headers.get("warc-target-uri"), own["x-source-payload-digest"], own["warc-block-digest"], len(text), text.decode(), made), strict=True):
                            c.append(x)
            kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return records.select("id", "record").mapInArrow(run, f"id long, {DERIVED}")
