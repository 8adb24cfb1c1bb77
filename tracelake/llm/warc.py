"""Converter of legacy ARC archives to WARC, with revisit records for repeated payloads.

An ARC file begins with a version block, whose second line names the version and whose third line names the fields
of the header lines.  A header line ends in the declared length of the document behind it, an HTTP response with
head and payload.  The converter reads documents by these lengths and synthesises what WARC asks for: record ids,
dates, types, and digests of payload and block.  Of records with equal payloads of at least ``MIN_REVISIT`` bytes that
with the smallest page id is the response, and the others become revisits of it without the payload.

Archives are DataFrames (path, content), as Spark's ``binaryFile`` source gives them, plain or gzip.  WARC files are
written by Spark's text sink, whose separator is the end of a WARC record; a block that is not UTF-8 is written as
base64 and says so in its head.  Files hold a bounded number of records.

A null html is an empty payload, a null url reads ``-``; blanks and control characters of a url are escaped.  A null
page id is never the smallest, and where a group has no other, all of it are responses; rows that are equal in page id
and payload are of the same type.  Empty tables give no records.  A file that breaks off or is no ARC file raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelake.llm.common import col, new_folder, stash

MIN_REVISIT, FILE_RECORDS = 100, 2000
END = "\r\n\r\n"
#: Fixed values of the two ARC versions: the header fields in their order.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Fixed value: the profile of a revisit record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _escaped(url: str | None) -> str:
    return "".join(c if " " < c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "-")


def arc_file(name: str, version: str, pages: list[tuple[str | None, str | None, bytes]], date: str) -> bytes:
    """An ARC file of (page id, url, payload) rows."""
    fields = ARC_FIELDS[version]
    about = f"{version} 0 tracelake\n{' '.join(fields)}\n".encode()
    known = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Archive-length": str(len(about)), "Result-code": "200", "Filename": name}
    out = [" ".join(known.get(f, "-") for f in fields).encode() + b"\n" + about + b"\n"]
    offset = len(out[0])
    for page, url, payload in pages:
        head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", f"Content-Length: {len(payload)}"]
        head += [] if page is None else [f"X-Page-ID: {page}"]
        doc = "\r\n".join(head).encode() + b"\r\n\r\n" + payload
        known = {"URL": _escaped(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Archive-length": str(len(doc)), "Result-code": "200", "Offset": str(offset), "Filename": name}
        out.append(" ".join(known.get(f, "-") for f in fields).encode() + b"\n" + doc + b"\n")
        offset += len(out[-1])
    return b"".join(out)


def _plain(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:  # one member after the other
        d = zlib.decompressobj(31)
        out.append(d.decompress(content) + d.flush())
        content = d.unused_data.lstrip(b"\0")
    return b"".join(out)


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, document) of the records behind the version block."""
    data, at, fields = _plain(content), 0, None
    while at < len(data):
        if data[at : at + 1] in b"\n\r":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        parts = line.split(" ")
        length = parts[-1]
        if end < 0 or not length.isdigit() or end + 1 + int(length) > len(data):
            raise ValueError(f"no ARC header or a record that breaks off at byte {at}: {line[:80]!r}")
        doc = data[end + 1 : end + 1 + int(length)]
        at = end + 1 + int(length)
        if fields is None:
            about = doc.decode("utf-8", "replace").splitlines()
            if not line.startswith("filedesc://") or len(about) < 2 or about[0].split(" ")[0] not in ARC_FIELDS:
                raise ValueError(f"not a version block: {line[:80]!r}")
            fields = about[1].split(" ")
            continue
        # a url of an old crawler may hold blanks: the fields behind it are counted from the right
        spare = len(parts) - len(fields)
        if spare < 0:
            raise ValueError(f"{len(fields)} fields are declared: {line[:80]!r}")
        yield dict(zip(fields, ["%20".join(parts[: spare + 1]), *parts[spare + 1 :]], strict=True)), doc


def _http(doc: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(head with its end, its fields in lower case, payload); a document that is no HTTP response is all payload."""
    end = doc.find(b"\r\n\r\n")
    if not doc.startswith(b"HTTP/") or end < 0:
        return b"", {}, doc
    lines = doc[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return doc[: end + 4], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, doc[end + 4 :]


def _date(arc: str) -> str:
    """14 (or, in old files, 12 or 8) digits as a WARC date; the epoch where there is no date."""
    for size, form in ((14, "%Y%m%d%H%M%S"), (12, "%Y%m%d%H%M"), (8, "%Y%m%d")):
        if len(arc) == size and arc.isdigit():
            try:
                return datetime.strptime(arc, form).replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
            except ValueError:
                break
    return "1970-01-01T00:00:00Z"


RECORD = "record_id string, page_id long, url string, ip string, date string, head binary, payload binary, payload_bytes long, payload_digest string"


def convert(arcs: DataFrame, payload: bool = True) -> DataFrame:
    """ARC files (path, content) to the records of a WARC: identity, date, HTTP head, payload and digest."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                out, size = [], 0
                for k, (fields, doc) in enumerate(arc_records(content)):
                    head, http, body = _http(doc)
                    digest = hashlib.sha256(body).hexdigest()
                    page = http.get("x-page-id", "")
                    ident = uuid.UUID(hashlib.md5(f"{name}\0{k}\0{fields['URL']}\0{digest}".encode()).hexdigest(), version=4)
                    out.append((f"<urn:uuid:{ident}>", int(page) if page.lstrip("-").isdigit() else None, fields["URL"], fields.get("IP-address", "-"), _date(fields.get("Archive-date", "")), head, body if payload else None, len(body), digest))
                    size += len(doc) if payload else 200
                    if size > 8_000_000:
                        yield frame(out)
                        out, size = [], 0
                if out:
                    yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        names = [f.split()[0] for f in RECORD.split(", ")]
        return pd.DataFrame(out, columns=names).astype({"page_id": "Int64"})

    return arcs.select("path", "content").mapInPandas(rows, RECORD)


def with_revisits(records: DataFrame, minimum: int = MIN_REVISIT) -> DataFrame:
    """``records`` with record_type, refers_to (page id) and the id, url and date of the response referred to."""
    small = records.select("payload_digest", "payload_bytes", "page_id", "record_id", "url", "date").where(f"page_id IS NOT NULL AND payload_bytes >= {minimum}")
    first = small.groupBy("payload_digest").agg(F.min(F.struct("page_id", "record_id", "url", "date")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stash(first.select(F.col("payload_digest").alias("digest"), "first"), "responses")
    rows = records.join(first, (records["payload_digest"] == first["digest"]) & records["page_id"].isNotNull(), "left")
    again = F.col("first").isNotNull() & (F.col("page_id") > F.col("first.page_id"))
    kept = F.when(again, F.col("first"))
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("of", kept).drop("first", "digest")


def _record(r: dict) -> str:
    revisit = r["record_type"] == "revisit"
    block = bytes(r["head"] or b"") + (b"" if revisit else bytes(r["payload"] or b""))
    head = {
        "WARC-Type": r["record_type"], "WARC-Record-ID": r["record_id"], "WARC-Date": r["date"], "WARC-Target-URI": r["url"], "WARC-IP-Address": r["ip"],
        "WARC-Payload-Digest": f"sha256:{r['payload_digest']}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
    }
    if r["page_id"] is not None:
        head["X-Page-ID"] = str(r["page_id"])
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": r["of"]["record_id"], "WARC-Refers-To-Target-URI": r["of"]["url"], "WARC-Refers-To-Date": r["of"]["date"], "X-Refers-To-Page-ID": str(r["of"]["page_id"])}
    try:
        text = block.decode()
    except UnicodeDecodeError:
        head["X-Block-Encoding"] = "base64"
        block = base64.b64encode(block)
        text = block.decode()
    head["Content-Length"] = str(len(block))
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n" + text


def write_warc(records: DataFrame, path: str, compression: str = "none", file_records: int = FILE_RECORDS) -> None:
    """Write records (with their revisits) as WARC files below ``path``."""

    def lines(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield pa.RecordBatch.from_pydict({"value": pa.array([_record(r) for r in batch.slice(at, 500).to_pylist()], pa.string())})

    rows = records.mapInArrow(lines, "value string")
    rows.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", file_records).text(path)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record, by the declared lengths."""
    data, at = _plain(content), 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at = end + 4 + int(fields["content-length"])
        block = data[end + 4 : at]
        if at > len(data):
            raise ValueError("a record breaks off")
        yield fields, base64.b64decode(block) if fields.get("x-block-encoding") == "base64" else block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, date and whether the digests hold."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string, sound boolean"

    def number(s: str | None) -> int | None:
        return None if s is None else int(s)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                out = []
                for f, block in warc_records(content):
                    _, http, body = _http(block)
                    digest = f["warc-payload-digest"].removeprefix("sha256:")
                    sound = hashlib.sha256(block).hexdigest() == f["warc-block-digest"].removeprefix("sha256:")
                    size = int(http.get("content-length", len(body)))
                    if f["warc-type"] == "response":
                        size, sound = len(body), sound and hashlib.sha256(body).hexdigest() == digest
                    out.append((number(f.get("x-page-id")), size, digest, f["warc-type"], number(f.get("x-refers-to-page-id")), f["warc-target-uri"], f["warc-date"], sound))
                yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return files.mapInPandas(rows, schema)


def arcs_of(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", date: str = "20260101000000", file_records: int = FILE_RECORDS) -> DataFrame:
    """Pages as ARC files (path, content), of both versions in turn."""
    rows = pages.select(col(id).cast("string").alias("i"), col(url).cast("string").alias("u"), col(html).cast("string").alias("h"))

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            held, size = [], 0
            for i, u, h in zip(batch["i"], batch["u"], batch["h"], strict=True):
                held.append((i, u, (h or "").encode("utf-8", "replace")))
                size += len(held[-1][2])
                if len(held) >= file_records or size >= 4_000_000:
                    yield one(part, k, held)
                    held, size, k = [], 0, k + 1
            if held:
                yield one(part, k, held)
                k += 1

    def one(part: int, k: int, held: list[tuple]) -> pd.DataFrame:
        name = f"pages-{part:05}-{k:05}.arc"
        return pd.DataFrame({"path": [name], "content": [arc_file(name, "12"[(part + k) % 2], held, date)]})

    return rows.mapInPandas(files, "path string, content binary")


def archive(arcs: DataFrame, path: str | None = None, minimum: int = MIN_REVISIT) -> DataFrame:
    """Convert ARC files, write the WARC files (below the shared folder unless ``path`` is given), and read them back."""
    spark = arcs.sparkSession
    path = path or new_folder(spark, "warc")
    write_warc(with_revisits(convert(arcs), minimum), path)
    return read_warc(spark, path)


