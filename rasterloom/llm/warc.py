"""Derived WARC records: plain-text conversions and linked metadata of response records.

Every response gives a conversion record (the readable text) and a metadata record (facts about the
response and its source headers). Both refer to the response by its record id, target and date; the
metadata also names the conversion. Blocks carry SHA-1 digests, and the response's payload digest is
kept. Records are written as one gzip member each, so a reader may start at any record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.files import open_folder, output_folder, put, read_files
from rasterloom.llm.text import small_batches
from rasterloom.runtime import freeze

#: Bytes of record blocks after which a file is closed.
FILE_BYTES = 32 << 20
#: Capture time of responses whose table has none.
CAPTURED = "2024-01-01T00:00:00Z"

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|head|noscript|template)\b.*?</\1\s*>", re.S | re.I)
_BREAKS = re.compile(r"<(?:/?(?:p|div|br|hr|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|blockquote|pre|td|th|main|aside))\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
_SPACE = re.compile(r"[ \t\r\f\v]+")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_LINK = re.compile(r"<a\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(kind: str, *parts: str) -> str:
    """A name-based id: the same input gives the same id on every attempt."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join((kind, *parts)))}>"


def plain_text(page: str) -> str:
    """Readable lines: hidden elements and tags dropped, block ends as line ends, entities resolved."""
    text = _TAG.sub("", _BREAKS.sub("\n", _HIDDEN.sub(" ", page)))
    lines = (_SPACE.sub(" ", line).strip() for line in entities.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def header_value(text: str) -> str:
    """One header line's value: line ends become spaces."""
    return " ".join(text.split())


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {header_value(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
    return headers, rest[:int(headers["content-length"])]


def members(raw: bytes, step: int = 1 << 16):
    """The gzip members of a file, one after another, each bounded by its record."""
    view, at = memoryview(raw), 0
    while at < len(view):
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("the file ends inside a record")
            parts.append(one.decompress(view[at:at + step]))
            at += min(step, len(view) - at) - len(one.unused_data)
        yield b"".join(parts)


def derive(key: str, url: str | None, page: str | None, captured: str | None = None) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The conversion and metadata records of one response, as (headers, block)."""
    page = page or ""
    target = header_value(url) if url and url.strip() else f"urn:page:{key}"
    when = captured or CAPTURED
    payload = page.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    source_digest = digest(payload)
    source = record_id("response", key, target, when, source_digest)
    linked = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", when)]
    text = plain_text(page).encode()
    conversion, metadata = record_id("conversion", source), record_id("metadata", source)
    title = _TITLE.search(page)
    links = _LINK.findall(page)
    facts = [
        ("source-status", http.split("\r\n")[0]),
        *(("source-header", line) for line in http.split("\r\n")[1:] if line),
        ("source-payload-digest", source_digest), ("source-block-digest", digest(http.encode() + payload)),
        ("conversion", conversion), ("title", entities.unescape(title[1]) if title else ""),
        ("outlinks", str(len(links))), *(("outlink", x) for x in links),
    ]
    block = "".join(f"{k}: {header_value(v)}\r\n" for k, v in facts).encode()
    return [
        ([("WARC-Type", "conversion"), ("WARC-Record-ID", conversion), ("WARC-Date", when), ("WARC-Target-URI", target),
          *linked, ("WARC-Payload-Digest", digest(text)), ("WARC-Block-Digest", digest(text)), ("X-Source-Payload-Digest", source_digest),
          ("X-Source-Key", key), ("Content-Type", "text/plain; charset=utf-8")], text),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", metadata), ("WARC-Date", when), ("WARC-Target-URI", target),
          *linked, ("WARC-Concurrent-To", conversion), ("WARC-Block-Digest", digest(block)), ("X-Source-Payload-Digest", source_digest),
          ("X-Source-Key", key), ("Content-Type", "application/warc-fields")], block),
    ]


def write_derivatives(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      folder: str | None = None) -> tuple[str, DataFrame]:
    """Write the derived records of all rows; (folder, manifest (file, n_records)).

    Rows are handled where they are read, no exchange; a file is closed at ``FILE_BYTES``. Its name is a
    digest of its content, so a retried task writes the same files again; only files in the manifest,
    which Spark commits, count. A null key is the key '', a null or blank address ``urn:page:<key>``, a
    null page an empty payload. Repeated rows give repeated records with the same ids.
    """
    spark = pages.sparkSession
    folder = folder or output_folder(spark, "warc")
    open_folder(folder)  # also there when no task has a row
    rows = pages.select(F.coalesce(F.col(key_col).cast("string"), F.lit("")), F.col(url_col).cast("string"), F.col(html_col).cast("string"))

    def run(batches):
        found, path = open_folder(folder)
        held, size = [], 0

        def close():
            info = gzip.compress(record([
                ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", digest(b"".join(held)))), ("WARC-Date", CAPTURED),
                ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\nconformsTo: derived records\r\n"), 6, mtime=0)
            content = info + b"".join(held)
            name = f"derived-{hashlib.sha1(content).hexdigest()}.warc.gz"
            put(found, path, name, content)
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": [len(held)]})

        for b in batches:
            for key, url, page in zip(*(b.column(k).to_pylist() for k in range(3))):
                for headers, block in derive(key, url, page):
                    held.append(gzip.compress(record(headers, block), 6, mtime=0))
                    size += len(block)
                if size >= FILE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return folder, freeze(small_batches(rows).mapInArrow(run, "file string, n_records bigint"))


def read_records(spark: SparkSession, folder: str, manifest: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per record of the manifest's files (``warcinfo`` records aside), digests checked against
    the blocks. Two files with the same content are one file, read as often as the manifest names it."""
    schema = ("file string, page_key string, record_type string, record_id string, refers_to string, target_uri string, "
              "concurrent_to string, block_digest string, source_digest string, content_length bigint, digest_ok boolean"
              + (", block string" if with_text else ""))
    fields = ("x-source-key", "warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-concurrent-to",
              "warc-block-digest", "x-source-payload-digest")

    def run(batches):
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for one in members(raw):
                    headers, block = parse(one)
                    if headers["warc-type"] == "warcinfo":
                        continue
                    rows.append([path.rsplit("/", 1)[-1], *(headers.get(f) for f in fields), len(block),
                                 digest(block) == headers["warc-block-digest"], *([block.decode()] if with_text else [])])
                    if len(rows) >= 4096:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    columns = [f.split() for f in schema.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows), columns)],
                                          names=[name for name, _ in columns])

    found = read_files(spark, folder, "derived-*.warc.gz").mapInArrow(run, schema)
    listed = manifest.select("file")
    return found.join(listed, "file").drop("file")
