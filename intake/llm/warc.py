"""Operator 7: WARC derivatives. Responses become linked metadata and plain-text conversion records.

``responses`` makes response records of a page table; ``read_warc`` reads them from files. ``derive`` gives for each
response, as rows of one table, the response itself, a ``metadata`` record (title, language, links, text statistics) and a
``conversion`` record (plain text), whose ``refers_to`` is the response's record id and whose target URI, date, source
headers and payload digest are the response's. Digests are SHA-1 in base 32, as WARC has them. Record ids are
hashes of what the record holds, so that a repeated run or task gives the same ids. ``write_warc`` writes
gzipped files, one per partition.

All of it is a map over rows without a shuffle.

Defined results: null or empty html gives a response with an empty payload, metadata with zero
counts and an empty conversion; a null url gives an empty target URI; repeated rows give records of equal ids; an empty table
gives an empty table; other columns of the input go. Fields that a read response lacks are null in its derivatives too. A very long page is
one record, held by itself. Of a file that is cut off the whole records before the cut are read. A block that isn't UTF-8 is read with
replacement characters; its digests stay those of the source.
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
from collections.abc import Iterator
from itertools import chain, islice
from types import SimpleNamespace
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intake.llm.common import map_slices, new_file

RECORD = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()), T.StructField("content_type", T.StringType()),
    T.StructField("source_headers", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("block_digest", T.StringType()),
    T.StructField("length", T.LongType()), T.StructField("block", T.StringType()),
])
#: Date of responses made of tables, which have none.
EPOCH = "1970-01-01T00:00:00Z"
_HIDDEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|$)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|aside|main|blockquote|pre|title|body|head)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*(?:>|$)")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
_LANG = re.compile(r"<html[^>]*\blang=[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(p or '' for p in parts))}>"


def plain_text(page: str) -> str:
    """All text of a page, a line per block."""
    text = _TAG.sub(" ", _BREAK.sub("\n", _HIDDEN.sub(" ", page)))
    lines = (" ".join(line.split()) for line in entities.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def _record(kind: str, uri: str | None, date: str | None, refers_to: str | None, headers: str | None, payload: str | None, content_type: str, block: str) -> tuple:
    data = block.encode("utf-8", "surrogatepass")
    return kind, record_id(kind, uri, date, payload, digest(data)), refers_to, uri, date, content_type, headers, payload, digest(data), len(data), block


def response(uri: str | None, page: str | None, date: str = EPOCH) -> tuple:
    """A response record of a page: HTTP headers and the page as its block."""
    body = page or ""
    data = body.encode("utf-8", "surrogatepass")
    headers = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}"
    return _record("response", uri or "", date, None, headers, digest(data), "application/http; msgtype=response", f"{headers}\r\n\r\n{body}")


def derived(made: tuple) -> list[tuple]:
    """The response with its metadata and conversion records."""
    _, ident, _, uri, date, _, headers, payload, _, _, block = made
    page = (block or "").partition("\r\n\r\n")[2]
    text = plain_text(page)
    title, lang = _TITLE.search(page), _LANG.search(page)
    links = [entities.unescape("".join(x)) for x in _LINK.findall(page)]
    fields = [("title", " ".join(entities.unescape(title[1]).split()) if title else ""), ("language", lang[1] if lang else ""), ("text-chars", str(len(text))), ("text-words", str(len(text.split()))), ("links", str(len(links))), *(("outlink", x) for x in links)]
    meta = "\r\n".join(f"{k}: {' '.join(v.split())}" for k, v in fields)
    return [
        made,
        _record("metadata", uri, date, ident, headers, payload, "application/warc-fields", meta),
        _record("conversion", uri, date, ident, headers, payload, "text/plain", text),
    ]


def _rows(records: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in RECORD.fields]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in records], k) for j, k in enumerate(kinds)], [f.name for f in RECORD.fields])


def responses(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    return map_slices(pages.select(F.col(url_col).cast("string").alias("u"), F.col(html_col).alias("h")), RECORD, lambda: lambda b: _rows([response(u, h) for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]))


def derive(records: DataFrame) -> DataFrame:
    """Responses of a record table with their derivatives; records of other kinds are passed over."""
    names = [f.name for f in RECORD.fields]
    return map_slices(records.where("type = 'response'").select(*names), RECORD, lambda: lambda b: _rows([d for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for d in derived(row)]))


def to_bytes(record) -> bytes:
    """A record as it stands in a file."""
    data = (record.block or "").encode("utf-8", "surrogatepass")
    head = [("WARC-Type", record.type), ("WARC-Record-ID", record.record_id), ("WARC-Date", record.date), ("WARC-Target-URI", record.target_uri), ("WARC-Refers-To", record.refers_to), ("WARC-Payload-Digest", record.payload_digest), ("WARC-Block-Digest", record.block_digest), ("Content-Type", record.content_type), ("Content-Length", str(len(data)))]
    if record.type != "response" and record.source_headers:
        head.insert(5, ("X-Source-Headers", base64.b64encode(record.source_headers.encode()).decode()))
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + data + b"\r\n\r\n"


def read_records(file: BinaryIO) -> Iterator[tuple]:
    """Records of a file in order, plain or gzipped, one held at a time; a record that is cut off ends the file, one without a length is passed over."""
    zipped = file.read(2) == b"\x1f\x8b"
    file.seek(0)
    lines = gzip.GzipFile(fileobj=file) if zipped else file
    try:
        while line := lines.readline():
            if not line.startswith(b"WARC/1."):
                continue
            head = {}
            while (line := lines.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            length = head.get("content-length", "")
            if not line or not (length.isascii() and length.isdigit()):
                continue
            data = lines.read(int(length))
            if len(data) < int(length):
                return
            yield _read(head, data)
    except (EOFError, zlib.error, gzip.BadGzipFile):
        return


def _read(head: dict[str, str], data: bytes) -> tuple:
    block, source, headers = data.decode("utf-8", "replace"), head.get("x-source-headers"), ""
    if source:
        headers = base64.b64decode(source + "==").decode("utf-8", "replace")
    elif head.get("warc-type") == "response":
        headers = block.partition("\r\n\r\n")[0]
    return head.get("warc-type"), head.get("warc-record-id"), head.get("warc-refers-to"), head.get("warc-target-uri", ""), head.get("warc-date"), head.get("content-type"), headers, head.get("warc-payload-digest"), head.get("warc-block-digest"), len(data), block


def from_bytes(data: bytes) -> Iterator[tuple]:
    return read_records(io.BytesIO(data))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the files at ``path``. A file is read by one task, as gzipped members need it; its records are unpacked and sent on in turn."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                records = read_records(io.BytesIO(batch.column(0)[k].as_py()))
                while some := list(islice(records, 64)):
                    yield _rows(some)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """(file, records) of the gzipped files written to ``folder``, one for each partition of ``records``, a member for each record."""
    names = [f.name for f in RECORD.fields]

    def run(batches):
        rows = (dict(zip(names, row, strict=True)) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        first = next(rows, None)
        if first is None:
            return
        n, path = 0, f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        with new_file(path) as out:
            for row in chain([first], rows):
                out.write(gzip.compress(to_bytes(SimpleNamespace(**row)), 6, mtime=0))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], ["file", "records"])

    return records.select(*names).mapInArrow(run, "file string, records long")
