"""Legacy web archives: ARC files written, parsed by version and declared length, and converted to WARC.

An ARC file starts with a version block whose header line is ``filedesc://name ip date text/plain length`` (version
1) or that with result code, checksum, location, offset and file name before the length (version 2); the next two
lines state the version and the field names. Each record is such a header line, exactly the declared number of
bytes, and a line feed. The converter reads the version first, then parses each header line by it; spaces in the URL or
the content type, which some writers left in, are told by the number of fields.

A converted record keeps the URL, turns the 14-digit date into a ``WARC-Date``, and gets a ``WARC-Record-ID`` derived
from its file's name, offset and URL, block and payload digests (SHA-256), and a type: ``response`` for HTTP, else ``resource``
with the content type that the header line states; or ``revisit`` with the id, URL and date of the record whose equal payload
has the smallest page id. A revisit's block is the HTTP header alone. File names must differ, as those of ``write_arc`` do:
each has the numbers of its task and of its place in it.

Archives are rows of bytes (``name, content``), at most ``SEGMENT`` bytes unless one record is longer; they are
written with Spark's own writer into the shared folder, so any executor can read them again.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, salted_join, saved, table

SEGMENT = 2 << 20
LEAST = 100  # bytes of payload from which equal payloads are revisits
DATE = "20010203040506"
IP = "192.0.2.1"  # an address for documentation; pages carry none
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def _line(version: int, url: str, kind: str, length: int, name: str = "-", offset: int = 0, code: str = "-") -> bytes:
    more = f" {code} - - {offset} {name}" if version == 2 else ""
    return f"{url} {IP} {DATE} {kind}{more} {length}\n".encode()


def clean_url(url: str | None) -> str:
    """A URL without spaces or controls, which header lines can't hold; of null or nothing ``about:blank``."""
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]-._") if url else "about:blank"


def arc_start(version: int, name: str) -> bytes:
    body = f"{version} 0 tesserae\n{FIELDS[version]}\n".encode()
    return _line(version, f"filedesc://{name}", "text/plain", len(body), name) + body + b"\n"


def arc_record(version: int, url: str, block: bytes, name: str, offset: int) -> bytes:
    return _line(version, url, "text/html", len(block), name, offset, "200") + block + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records behind the version block: url, ip, date, content_type, offset and block."""
    at, version, names = 0, 0, []
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # more line feeds than one behind a record
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        length = int(values[-1])
        block = data[end + 1 : end + 1 + length]
        closed = data[end + 1 + length : end + 2 + length] in (b"\n", b"\r", b"") or not names and block.endswith(b"\n")
        if len(block) != length or not closed:
            raise ValueError(f"a record at {at} doesn't have its declared length")
        if not names:
            if not values[0].startswith("filedesc://"):
                raise ValueError("no version block")
            first, second = block.decode().replace("\r", "").split("\n")[:2]
            version, names = int(first.split(" ")[0]), second.split(" ")
            if FIELDS.get(version, "").split(" ") != names:
                raise ValueError(f"version {version} with fields {names}")
        else:
            yield {**_fields(version, values, at), "offset": at, "block": block}
        at = end + 1 + length


def _fields(version: int, values: list[str], at: int) -> dict[str, str]:
    """URL, address, date and content type of a header line: the date is the last field of 14 digits that leaves enough behind it."""
    behind = len(FIELDS[version].split(" ")) - 3  # fields after the date
    for i in range(len(values) - behind - 1, 1, -1):
        if len(values[i]) == 14 and values[i].isdigit():
            kind = values[i + 1 : len(values) - behind + 1]
            return {"url": " ".join(values[: i - 1]), "ip": values[i - 1], "date": values[i], "content_type": " ".join(kind)}
    raise ValueError(f"a header line of version {version} at {at} with {len(values)} fields and no date")


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header and payload of an HTTP response; what isn't one is all payload. Lines may end in a line feed alone."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    m = re.search(rb"\r?\n\r?\n", block)
    return (block[: m.end()], block[m.end() :]) if m else (block, b"")


def header(block: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*(.*?)\r?$", block)
    return m[1].decode() if m else None


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        start = end + 4
        length = int(fields["Content-Length"])
        if data[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"a record at {at} doesn't have its declared length")
        yield fields, data[start : start + length]
        at = start + length + 4


def record_id(name: str, offset: int, url: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset} {url}')}"


def warc_date(date: str) -> str:
    """A date of 14 digits as WARC states it; one that is none (a writer's fault) becomes the start of Unix time."""
    try:
        return datetime.strptime(date, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def _write_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Versions 1 and 2 by turns, each segment named by its task and its place there."""
    task, places = TaskContext.get().partitionId(), itertools.count()

    def segment(version: int, rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        name = f"pages-{task:06d}-{next(places):06d}-v{version}.arc"
        out = [arc_start(version, name)]
        size = len(out[0])
        for url, block in rows:
            out.append(arc_record(version, url, block, name, size))
            size += len(out[-1])
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary())], ["name", "content"])

    version, rows, size = 1, [], 0
    for batch in batches:
        for page, url, html in zip(*batch.columns, strict=True):
            payload = (html.as_py() or "").encode()
            number = page.as_py()
            block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page: {'' if number is None else number}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
            rows.append((clean_url(url.as_py()), block))
            size += len(block)
            if size >= SEGMENT:
                yield segment(version, rows)
                version, rows, size = 3 - version, [], 0
    if rows:
        yield segment(version, rows)


def write_arc(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as ARC files, ``name, content``. A null html is an empty payload; repeated rows are repeated records."""
    rows = df.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(_write_arc, "name string, content binary")


_INDEX = "page_id long, name string, offset long, url string, date string, payload_bytes long, digest string"


def index_arc(arcs: DataFrame) -> DataFrame:
    """Where the records of ARC files stand, and the digests of their payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                rows = []
                for r in parse_arc(content.as_py()):
                    head, payload = split_http(r["block"])
                    page = header(head, "X-Page")
                    rows.append((int(page) if page else None, name.as_py(), r["offset"], r["url"], r["date"], len(payload), hashlib.sha256(payload).hexdigest()))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _INDEX.split(", ")])

    return arcs.select("name", "content").mapInArrow(run, _INDEX)


def _write_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each ARC file, and what its revisits refer to, as one WARC file."""
    for batch in batches:
        for name, content, revisits in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            out, firsts = [], {r["offset"]: r for r in revisits or ()}
            for r in parse_arc(content):
                head, payload = split_http(r["block"])
                first, when = firsts.get(r["offset"]), warc_date(r["date"])
                http = bool(head)
                block = head if first else r["block"]
                fields = {
                    "WARC-Record-ID": f"<{record_id(name, r['offset'], r['url'])}>",
                    "WARC-Date": when,
                    "WARC-Target-URI": r["url"],
                    "WARC-IP-Address": r["ip"],
                    "Content-Type": "application/http; msgtype=response" if http else r["content_type"],
                    "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
                    "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}",
                }
                if first:
                    fields |= {
                        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                        "WARC-Refers-To": f"<{record_id(first['first_name'], first['first_offset'], first['first_url'])}>",
                        "WARC-Refers-To-Target-URI": first["first_url"],
                        "WARC-Refers-To-Date": warc_date(first["first_date"]),
                        "X-Refers-To-Page": str(first["first_page"]),
                        "X-Payload-Length": str(len(payload)),
                    }
                out.append(warc_record("revisit" if first else "response" if http else "resource", fields, block))
            yield pa.RecordBatch.from_arrays([pa.array([name.removesuffix(".arc") + ".warc"]), pa.array([b"".join(out)], pa.binary())], ["name", "content"])


def convert(arcs: DataFrame, least: int = LEAST) -> DataFrame:
    """ARC files to WARC files, ``name, content``.

    Of payloads that are equal (by SHA-256) and at least ``least`` bytes long, the record with the smallest page id is the
    response and the others revisit it; records with that same id (repeated rows) are responses too, each with a record id of
    its own, and records without a page id are always responses. Only index rows (digest, file, offset) are joined, those
    of a digest that very many pages share dealt out by salts; payloads stay in their files, which are joined by name with
    what their revisits refer to, at most as many as the file has records.
    """
    index = saved(index_arc(arcs).filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()), "arc-index")
    first = F.min(F.struct("page_id", "name", "offset", "url", "date")).alias("first")
    firsts = index.groupBy("digest").agg(first, F.count("*").alias("copies")).filter("copies > 1")
    firsts = saved(firsts.select("digest", "copies", *(F.col(f"first.{c}").alias(f"first_{'page' if c == 'page_id' else c}") for c in ("page_id", "name", "offset", "url", "date"))), "arc-firsts")
    hot = hot_keys(firsts, ["digest"], firsts.agg(F.sum("copies")).first()[0])
    again = salted_join(index.select("digest", "page_id", "name", "offset"), firsts.drop("copies"), ["digest"], hot, "offset").filter("page_id <> first_page")
    named = again.groupBy("name").agg(F.collect_list(F.struct("offset", "first_page", "first_name", "first_offset", "first_url", "first_date")).alias("revisits"))
    return arcs.select("name", "content").join(named, "name", "left").select("name", "content", "revisits").mapInArrow(_write_warc, "name string, content binary")


_RECORDS = "page_id long, url string, warc_type string, payload_bytes long, payload_digest string, refers_to long, record_id string"


def read_warc(archives: DataFrame) -> DataFrame:
    """The records of WARC files. A response's payload is measured and its digests checked; a revisit states them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_warc(content.as_py()):
                    head, payload = split_http(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
                        raise ValueError("a block differs from its digest")
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and digest != hashlib.sha256(payload).hexdigest():
                        raise ValueError("a payload differs from its digest")
                    length = int(fields["X-Payload-Length"]) if revisit else len(payload)
                    page, first = header(head, "X-Page"), fields.get("X-Refers-To-Page")
                    rows.append((int(page) if page else None, fields["WARC-Target-URI"], fields["WARC-Type"], length, digest, int(first) if first else None, fields["WARC-Record-ID"]))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                cols = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _RECORDS.split(", ")])

    return archives.select("content").mapInArrow(run, _RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as ARC, converted to WARC archives in the shared folder, and read back."""
    arcs = saved(write_arc(table(spark, sf_dir, "pages")), "arc")
    records = read_warc(saved(convert(arcs), "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first_page FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_page IS NOT NULL AND first_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_page <> page_id THEN first_page END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
