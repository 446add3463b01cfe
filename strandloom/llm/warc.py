"""Legacy archive converter: ARC files of version 1 and 2 to WARC, and readers for both.

Archives hold one gzip member a record and a bounded number of records a file; contents are bytes from end to end. They
are read by Spark's binaryFile source and written by its text source, which passes the bytes of a string on as they
are, so they may lie in any store that Spark reaches. An ARC record is parsed by the header line of its file's version
and by its declared length; its WARC twin gets an identifier derived from its contents (so a repeated task writes the
same one), a date from the 14-digit timestamp, a type, and SHA-1 digests: HTTP answers become response records, name
lookups and other schemes resource records, the file's description its warcinfo. Responses whose payload equals that of
an earlier page are written as revisit records without their payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

CAPTURED = "20000101000000"
#: Rows of a few hundred bytes, so a few dozen MB at most.
BROADCAST_ROWS = 100_000
#: Fixed formats: the fields of an ARC record's header line by version.
FIELDS = {
    "1": ["url", "ip", "date", "type", "length"],
    "2": ["url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"],
}
_TITLES = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLANK = re.compile(rb"\r?\n\r?\n")
#: A task reads a compressed file whole, so files stay small.
RECORDS_PER_FILE = 10_000


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _word(x: str | None) -> str:
    """A header field of an ARC line holds no white space."""
    return re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", x or "") or "-"


def arc_line(version: str, url: str, kind: str, length: int, captured: str, result: str = "200") -> str:
    known = {"url": url, "ip": "0.0.0.0", "date": captured, "type": kind, "result": result, "checksum": "-", "location": "-", "offset": "0", "filename": "pages", "length": str(length)}
    return " ".join(known[f] for f in FIELDS[version])


def arc_head(version: str, captured: str) -> str:
    body = f"{version} 0 strandloom\n{_TITLES[version]}\n"
    return arc_line(version, "filedesc://pages.arc", "text/plain", len(body), captured) + "\n" + body


def _http(page_id, n: int) -> str:
    page = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n{page}\r\n"


def _member(record: bytes) -> bytes:
    """The record as a gzip member, less the zero byte it ends with, which the text source adds as its line end.

    A member ends with the record's length, so its last byte is zero below 16 MB; longer ones are followed by an empty member."""
    out = gzip.compress(record, 6, mtime=0)
    if out[-1]:
        out += gzip.compress(b"", 6, mtime=0)
    return out[:-1]


def _write_members(records: DataFrame, path: str, records_per_file: int) -> None:
    """``records``: one binary column of ``_member`` rows."""
    spark = records.sparkSession
    check = "spark.sql.castBinaryToString.validateUtf8"
    before = spark.conf.get(check, None)
    spark.conf.set(check, "false")  # bytes pass as they are
    try:
        lines = records.select(F.col(records.columns[0]).cast("string"))
        lines.write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)
    finally:
        if before is None:
            spark.conf.unset(check)
        else:
            spark.conf.set(check, before)


def write_arc(pages: DataFrame, path: str, captured: str = CAPTURED, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write pages (page_id, url, html) as legacy ARC files of version 1 and 2 in turn by task. Null html is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            out = []
            for part, page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                version = str(1 + part % 2)
                if written % records_per_file == 0:  # the next file begins
                    out.append(_member(arc_head(version, captured).encode()))
                    written += 1
                payload = (html or "").encode()
                head = _http(page_id, len(payload)).encode()
                line = arc_line(version, _word(url), "text/html", len(head) + len(payload), captured)
                out.append(_member(line.encode() + b"\n" + head + payload + b"\n"))
                written += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = pages.select(F.spark_partition_id().alias("part"), F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    _write_members(rows.mapInArrow(run, "value binary"), path, records_per_file)


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of one ARC file: the fields of its version's header line, and content. The file may be gzipped.

    A URL may hold blanks, so the other fields are counted from the end of the line."""
    source = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    fields = None
    while line := source.readline():
        if not line.strip():
            continue
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        length = text.rsplit(" ", 1)[-1]
        if not length.isdigit():
            raise ValueError(f"not a header line of an ARC file: {line[:200]!r}")
        content = source.read(int(length))
        if len(content) < int(length):
            raise ValueError(f"the ARC file ends inside a record: {line[:200]!r}")
        if text.startswith("filedesc://"):
            fields = FIELDS[content.split(b" ", 1)[0].decode()]
            continue
        parts = text.rsplit(" ", len(fields) - 1) if fields else []
        if not fields or len(parts) != len(fields):
            raise ValueError(f"not a header line of this ARC file: {line[:200]!r}")
        parts[0] = parts[0].encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        yield dict(zip(fields, parts, strict=True)) | {"content": content}


def warc_date(stamp: str) -> str:
    """ISO time of a 14-digit timestamp; shorter legacy ones count from the start of what they name."""
    full = stamp + "00000101000000"[len(stamp) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def _split_http(content: bytes) -> tuple[bytes, bytes]:
    """Head with the blank line that ends it, and payload; lines may end in LF alone."""
    end = _BLANK.search(content)
    return (content[: end.end()], content[end.end() :]) if end else (content, b"")


def warc_kind(content: bytes) -> str:
    """response for an HTTP answer, else resource (name lookups, files of other schemes)."""
    return "response" if content.startswith(b"HTTP/") else "resource"


def _parts(kind: str, content: bytes) -> tuple[bytes, bytes]:
    return _split_http(content) if kind == "response" else (b"", content)


def _header(head: bytes, name: str) -> str | None:
    found = re.search(rf"(?im)^{re.escape(name)}:[ \t]*(.*?)\r?$", head.decode("utf-8", "replace"))
    return found[1] if found else None


def page_number(text: str | None) -> int | None:
    """The page_id that a header names: any long; None for what is no whole number or lies beyond the longs."""
    if text is None or not re.fullmatch(r"-?[0-9]{1,19}", text):
        return None
    return n if -(1 << 63) <= (n := int(text)) < 1 << 63 else None


def record_id(url: str, date: str, digest: str, page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {page_id}')}>"


_INDEX = [("file", pa.string()), ("n", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("type", pa.string()), ("date", pa.string()), ("size", pa.int64()), ("digest", pa.string())]


def arc_records(spark: SparkSession, path: str, with_content: bool) -> DataFrame:
    """file, n (ordinal in the file), kind (of the WARC twin), page_id, url, ip, type, date, size, digest and, if asked,
    content (bytes) of all ARC records. Records of pages that were not written here have a null page_id."""
    kinds = _INDEX + [("content", pa.binary())] * with_content
    schema = "file string, n long, kind string, page_id long, url string, ip string, type string, date string, size long, digest string" + ", content binary" * with_content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [k for k, _ in kinds])

        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for n, r in enumerate(read_arc(data.as_py())):
                    kind = warc_kind(r["content"])
                    head, payload = _parts(kind, r["content"])
                    page = _header(head, "X-Page-Id")
                    rows.append((file, n, kind, page_number(page), r["url"], r["ip"], r["type"], warc_date(r["date"]), len(payload), sha1_base32(payload), *([r["content"]] if with_content else [])))
                    held += len(payload)
                    if held > 4 << 20:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def convert(spark: SparkSession, arc_path: str, warc_path: str, revisit_from: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a WARC record for each ARC record under ``arc_path``.

    Of responses with equal payloads of at least ``revisit_from`` bytes, the one with the smallest page_id (nulls last,
    then by file and place) is a response and the others revisit it."""
    index = stored(arc_records(spark, arc_path, False), "arc-index")
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "n", "url", "date")
    responses = index.filter((F.col("kind") == "response") & (F.col("size") >= revisit_from))
    first = responses.groupBy("digest", "size").agg(F.min(place).alias("f"), F.count("*").alias("copies")).filter("copies > 1")
    again = responses.join(first, ["digest", "size"]).filter(~((F.col("file") == F.col("f.file")) & (F.col("n") == F.col("f.n"))))
    again = again.select("file", "n", F.col("f.page_id").alias("to_page"), F.col("f.url").alias("to_url"), F.col("f.date").alias("to_date"), F.lit(True).alias("revisit"))
    again = stored(again, "revisits")
    # a short list of revisits goes to every task; a longer one is met by a shuffle of the records
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again.hint("shuffle_hash")
    records = arc_records(spark, arc_path, True).join(again, ["file", "n"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if written % records_per_file == 0:  # the next file begins
                    info = b"software: strandloom\r\nformat: WARC File Format 1.1\r\n"
                    out.append(_record("warcinfo", [("WARC-Record-ID", record_id("warcinfo", r["file"], str(r["n"]), "")), ("WARC-Date", r["date"]), ("Content-Type", "application/warc-fields")], info))
                    written += 1
                head, payload = _parts(r["kind"], r["content"])
                content_type = "application/http; msgtype=response" if r["kind"] == "response" else r["type"]
                fields = [("WARC-Record-ID", record_id(r["url"], r["date"], r["digest"], r["page_id"])), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["url"]), ("WARC-Payload-Digest", f"sha1:{r['digest']}"), ("Content-Type", content_type)]
                if r["ip"] not in ("-", "", "0.0.0.0"):
                    fields.append(("WARC-IP-Address", r["ip"]))
                if r["revisit"]:
                    fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(r["to_url"], r["to_date"], r["digest"], r["to_page"])), ("WARC-Refers-To-Target-URI", r["to_url"]), ("WARC-Refers-To-Date", r["to_date"])]
                    if r["to_page"] is not None:
                        fields.append(("X-Refers-To-Page-Id", str(r["to_page"])))
                    # the answer's own head may declare another length than it had, or none
                    fields.append(("X-Payload-Length", str(r["size"])))
                out.append(_record("revisit" if r["revisit"] else r["kind"], fields, head if r["revisit"] else head + payload))
                written += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    _write_members(records.mapInArrow(run, "value binary"), warc_path, records_per_file)


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]
    return _member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of one WARC file, which may be gzipped."""
    source = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:200]!r}")
        headers = {}
        while (line := source.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = source.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError(f"the WARC file ends inside a record: {headers}")
        yield headers, block


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Response, revisit and resource records under ``path``: record_type, record_id, page_id, url, date, payload_bytes,
    payload_digest, refers_to_id, refers_to, payload if asked. A record whose digests or lengths do not agree with its
    block is an error."""
    kinds = [("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload
    schema = "record_type string, record_id string, page_id long, url string, date string, payload_bytes long, payload_digest string, refers_to_id string, refers_to long" + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [k for k, _ in kinds])

        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for h, block in parse_warc(data.as_py()):
                    kind = h["warc-type"]
                    if kind not in ("response", "revisit", "resource"):
                        continue
                    head, payload = _parts("resource" if kind == "resource" else "response", block)
                    page, to = _header(head, "X-Page-Id"), h.get("x-refers-to-page-id")
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    size = int(h["x-payload-length"]) if kind == "revisit" else len(payload)
                    if h["warc-block-digest"] != f"sha1:{sha1_base32(block)}" or kind != "revisit" and sha1_base32(payload) != digest or kind == "revisit" and payload:
                        raise ValueError(f"the record does not agree with its digests: {h}")
                    rows.append((kind, h["warc-record-id"], page_number(page), h["warc-target-uri"], h["warc-date"], size, digest, h.get("warc-refers-to"), page_number(to), *([payload] if with_payload else [])))
                    held += len(payload) if with_payload else 200
                    if held > 4 << 20:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, revisit_from: int = 0) -> DataFrame:
    """Pages through legacy ARC files and the converter to WARC files under ``folder``, read back by ``read_warc``.

    Null html and null urls are empty ("-" in the archives); page_ids are any longs, and a null one stays null and comes last. Of repeated
    rows one is the response. An empty table gives no rows. Columns besides page_id, url and html are ignored."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/strandloom/archives-{uuid.uuid4().hex}"
    write_arc(pages.select("page_id", "url", "html"), f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc", revisit_from)
    return read_warc(spark, f"{folder}/warc")
