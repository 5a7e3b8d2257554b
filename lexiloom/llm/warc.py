"""WARC derivatives: every response record gives a metadata record and a plain-text conversion record.

Both refer to the response by its record id, keep its target URI, date, digests and HTTP headers, and name each other.  Ids of derived
records are made from the response's id and the record type, so a run that is repeated gives the same records and a lost task loses
nothing.  Text is all that a reader of the page sees, title first, one block a line, decoded by the charset of the HTTP header, else of
the page, else UTF-8.

Edge cases: a null page is an empty payload, whose conversion is an empty block; a null URL is an empty target; broken HTTP heads and
unknown charsets are read as far as they go; repeated rows give repeated records with equal ids; extra columns are ignored; an empty
table gives no records.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import leaves, markup
from .common import query, table, whole_text

VERSION = "WARC/1.1"
DATE = "2000-01-01T00:00:00Z"  # of responses whose capture time is not known
SOURCE = "source_id string, record_id string, target_uri string, warc_date string, payload_digest string, block_digest string, block binary"
DERIVED = "source_id string, warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_block_digest string, source_payload_digest string, source_headers string, block string"
# Attributes that hold links, by element
LINKS = {
    **dict.fromkeys("a area base link".split(), ("href",)),
    **dict.fromkeys("audio embed iframe img input script source track".split(), ("src",)),
    "video": ("src", "poster"),
    "form": ("action",),
    "object": ("data",),
    "blockquote": ("cite",),
    "q": ("cite",),
}
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
CHARSET = re.compile(rb"""charset\s*=\s*["']?([\w.:-]+)""", re.IGNORECASE)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of a table of pages (page_id, url, html), in the columns of SOURCE."""
    payload = whole_text("html").cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(head.cast("binary"), payload)
    name = F.sha2(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.sha2(payload, 256)), 256)
    parts = [F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    named = F.concat(F.lit("<urn:uuid:"), parts[0], F.lit("-"), parts[1], F.lit("-8"), parts[2], F.lit("-8"), parts[3], F.lit("-"), parts[4], F.lit(">"))
    return pages.select(
        F.col("page_id").cast("string").alias("source_id"),
        named.alias("record_id"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.concat(F.lit("sha256:"), F.sha2(payload, 256)).alias("payload_digest"),
        F.concat(F.lit("sha256:"), F.sha2(block, 256)).alias("block_digest"),
        block.alias("block"),
    )


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields, and the body with its chunks joined."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/") or not gap:
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    fields = [(name.strip(), value.strip()) for name, colon, value in (x.partition(":") for x in lines) if colon]
    if any(n.lower() == "transfer-encoding" and "chunked" in v.lower() for n, v in fields):
        body = _joined(body)
    return status, fields, body


def _joined(body: bytes) -> bytes:
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body if not parts else b"".join(parts)
        if not size:
            break
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(parts)


def decoded(fields: list[tuple[str, str]], body: bytes) -> tuple[str, str]:
    """The body as text, and the charset it was read by."""
    kind = next((v for n, v in fields if n.lower() == "content-type"), "")
    found = CHARSET.search(kind.encode()) or CHARSET.search(body[:4096])
    charset = found[1].decode().lower() if found else "utf-8"
    try:
        return body.decode(charset, "replace"), charset
    except LookupError:
        return body.decode("utf-8", "replace"), "utf-8"


def _derived_id(record_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, record_id + kind)}>"


def _facts(page: str, base: str) -> tuple[str | None, str | None, list[dict]]:
    """Title, language and links of a page; what stands in comments and scripts is no markup."""
    title = language = opened = None
    links = []
    for m in markup(page):
        if m.tag == "title" and title is None:
            if opened is None and not m.closes:
                opened = m.end
            elif opened is not None and m.closes:
                title = page[opened : m.start]
        if m.tag is None or m.closes or "=" not in m.attributes or (m.tag not in LINKS and m.tag != "html"):
            continue
        for name, *values in ATTRIBUTE.findall(m.attributes):
            value = html.unescape(next((v for v in values if v), "")).strip()
            if name.lower() in LINKS.get(m.tag, ()):
                links.append({"tag": m.tag, "url": _absolute(base, value)})
            elif m.tag == "html" and name.lower() == "lang" and language is None:
                language = value
    if opened is not None and title is None:
        title = page[opened:]
    return " ".join(html.unescape(title).split()) if title is not None else None, language, links


def derivatives(source: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    status, fields, body = split_http(source["block"] or b"")
    page, charset = decoded(fields, body)
    text = "\n".join(leaf.text for leaf in leaves(page))
    title, language, links = _facts(page, source["target_uri"])
    ids = {k: _derived_id(source["record_id"], k) for k in ("metadata", "conversion")}
    facts = {
        "status": status,
        "headers": [list(f) for f in fields],
        "payload_length": len(body),
        "charset": charset,
        "title": title,
        "language": language,
        "links": links,
        "conversion": ids["conversion"],
    }
    blocks = {"metadata": (json.dumps(facts, ensure_ascii=False, sort_keys=True), "application/json"), "conversion": (text, "text/plain; charset=UTF-8")}
    out = []
    for kind, (block, content_type) in blocks.items():
        raw = block.encode("utf-8", "surrogatepass")
        out.append(
            {
                "source_id": source["source_id"],
                "warc_type": kind,
                "record_id": ids[kind],
                "refers_to": source["record_id"],
                "concurrent_to": ids["conversion" if kind == "metadata" else "metadata"],
                "target_uri": source["target_uri"],
                "warc_date": source["warc_date"],
                "content_type": content_type,
                "content_length": len(raw),
                "block_digest": "sha256:" + hashlib.sha256(raw).hexdigest(),
                "source_block_digest": source["block_digest"],
                "source_payload_digest": source["payload_digest"],
                "source_headers": "\r\n".join([status, *(f"{n}: {v}" for n, v in fields)]),
                "block": block,
            }
        )
    return out


def _absolute(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def serialized(record: dict) -> bytes:
    """A derived record as it stands in a WARC file."""
    raw = record["block"].encode("utf-8", "surrogatepass")
    fields = {
        "WARC-Type": record["warc_type"],
        "WARC-Record-ID": record["record_id"],
        "WARC-Refers-To": record["refers_to"],
        "WARC-Concurrent-To": record["concurrent_to"],
        "WARC-Target-URI": record["target_uri"],
        "WARC-Date": record["warc_date"],
        "WARC-Block-Digest": record["block_digest"],
        "WARC-Source-Block-Digest": record["source_block_digest"],
        "WARC-Source-Payload-Digest": record["source_payload_digest"],
        "WARC-Source-Headers": json.dumps(record["source_headers"]),  # one line, whatever it holds
        "Content-Type": record["content_type"],
        "Content-Length": str(len(raw)),
    }
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + raw + b"\r\n\r\n"


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        _, *lines = data[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        stop = end + 4 + int(fields["Content-Length"])
        yield fields, data[end + 4 : stop]
        at = stop + 4


def derive(sources: DataFrame) -> DataFrame:
    """The derived records of response records, in the columns of DERIVED."""
    names = [x.split()[0] for x in DERIVED.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in DERIVED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                made = [r for row in batch.slice(low, 512).to_pylist() for r in derivatives(row)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in made], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return sources.mapInArrow(run, DERIVED)


@query("op10_warc_derivatives")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages"))).withColumn("page_id", F.col("source_id").cast("long")).drop("source_id")
