"""Legacy archives: ARC version 1 and 2 records, and their conversion to WARC records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuemill.llm._shared import durable, shared_dir, spread_join

#: Fields of a record's header line, by the version that the file's first record declares.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "type", "length"),
    "2": ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
WARC_END = "\r\n\r\n"
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f%]")


@dataclass(frozen=True)
class ArcRecord:
    """One record of an ARC file: header fields by name, and the content that follows."""

    fields: dict[str, str]
    content: bytes


def sha1_base32(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_bytes(records: list[ArcRecord], version: str = "1", name: str = "segment", date: str = "19700101000000") -> bytes:
    """An ARC file: the version block, then each record's header line, content and a line end."""
    names = " ".join({"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "status": "Result-code", "checksum": "Checksum",
                      "location": "Location", "offset": "Offset", "filename": "Filename", "length": "Archive-length"}[f] for f in ARC_FIELDS[version])
    block = f"{version} 0 tissuemill\n{names}\n\n".encode()
    first = {"url": f"filedesc://{name}.arc", "ip": "0.0.0.0", "date": date, "type": "text/plain", "status": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name}
    out = io.BytesIO()
    for r in [ArcRecord(first, block), *records]:
        fields = r.fields | {"length": str(len(r.content)), "offset": str(out.tell())}
        out.write(" ".join(fields.get(f) or "-" for f in ARC_FIELDS[version]).encode() + b"\n" + r.content + b"\n")
    return out.getvalue()


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, the version block first.

    Header lines are split by the fields of the version that the block declares; contents
    are taken by the declared length, so they may hold anything. Extra blank lines
    between records are passed over. A line with the wrong number of fields, a length
    that is no number or runs past the end, or a first record that is no version block
    raises ``ValueError``.
    """
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        line = data[at : stop if stop >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r").split(" ")
        if fields is None and (not line[0].startswith("filedesc://") or not line[-1].isdigit()):
            raise ValueError("an ARC file starts with a version block")
        if fields is not None and len(line) != len(fields):
            raise ValueError(f"{len(line)} fields in an ARC header line at byte {at}, not {len(fields)}")
        if stop < 0 or not line[-1].isdigit() or stop + 1 + int(line[-1]) > len(data):
            raise ValueError(f"bad length in the ARC header line at byte {at}")
        content = data[stop + 1 : stop + 1 + int(line[-1])]
        if fields is None:
            fields = ARC_FIELDS.get(content[:1].decode("ascii", "replace"))
            if fields is None or len(line) != len(fields):
                raise ValueError("an ARC file of an unknown version")
        yield ArcRecord(dict(zip(fields, line)), content)
        at = stop + 1 + len(content)


def _split_http(content: bytes) -> tuple[dict[str, str], bytes]:
    """Lower-cased header fields and the payload of an HTTP response; no fields if it is none."""
    if not content.startswith(b"HTTP/"):
        return {}, content
    head, _, body = content.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, body


def warc_headers(r: ArcRecord) -> tuple[dict[str, str], bytes]:
    """WARC fields of an ARC record without its length, and its payload.

    The identifier is a UUID of the URL, the date and the content; the 14-digit date
    becomes ISO 8601 (parts that are missing or impossible as in 19700101000000); a version block
    becomes ``warcinfo``, an HTTP response ``response``, anything else ``resource``.
    """
    http, payload = _split_http(r.content)
    url, date = r.fields["url"], re.sub("[^0-9]", "", r.fields["date"])[:14]
    date += "19700101000000"[len(date) :]
    kind = "warcinfo" if url.startswith("filedesc://") else "response" if r.content.startswith(b"HTTP/") else "resource"
    name = hashlib.sha1(b"\0".join((url.encode(), date.encode(), hashlib.sha1(r.content).digest()))).digest()[:16]
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.UUID(bytes=name, version=5)}>",
        "WARC-Date": f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
        "Content-Type": {"warcinfo": "text/plain", "response": "application/http; msgtype=response"}.get(kind, r.fields["type"]),
        "WARC-Block-Digest": f"sha1:{sha1_base32(r.content)}", "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}",
    }
    if kind == "warcinfo":
        fields["WARC-Filename"] = url.removeprefix("filedesc://")
    else:
        fields |= {"WARC-Target-URI": url, "WARC-IP-Address": r.fields["ip"]}
    fields |= {"X-Page-Id": http["x-page-id"]} if "x-page-id" in http else {}
    return fields, payload


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    """A WARC record without the two line ends that close it."""
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block


def convert(r: ArcRecord, response: ArcRecord | None = None, page: str | None = None) -> bytes:
    """The WARC record of an ARC record; with a ``response`` of equal payload (that of ``page``) a revisit of it, headers only."""
    fields, payload = warc_headers(r)
    if response is None:
        return warc_record(fields, r.content)
    head, of = r.content[: len(r.content) - len(payload)], warc_headers(response)[0]
    fields |= {"WARC-Type": "revisit", "WARC-Profile": _IDENTICAL, "WARC-Refers-To": of["WARC-Record-ID"], "WARC-Refers-To-Target-URI": of["WARC-Target-URI"], "WARC-Refers-To-Date": of["WARC-Date"]}
    return warc_record(fields | {"X-Refers-To-Page": page or "", "X-Payload-Length": str(len(payload)), "WARC-Block-Digest": f"sha1:{sha1_base32(head)}"}, head)


def member(record: bytes) -> bytes:
    """A closed WARC record as one gzip member, so that readers can seek to it."""
    return gzip.compress(record + WARC_END.encode(), 1, mtime=0)


def members(raw: bytes) -> Iterator[bytes]:
    """The contents of a gzip file's members in turn, or of a plain file at once."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw:
        one = zlib.decompressobj(31)
        yield one.decompress(raw) + one.flush()
        raw = one.unused_data


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of an uncompressed WARC file, by the declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["Content-Length"])
        yield fields, data[stop + 4 : stop + 4 + n]
        at = stop + 4 + n


def _page_record(page: int | None, url: str | None, payload: bytes) -> ArcRecord:
    """A page as an ARC record; what a header line cannot hold in a URL is percent-encoded."""
    head = "HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page}\r\n" if page is not None else "") + "\r\n"
    safe = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"
    return ArcRecord({"url": safe, "ip": "0.0.0.0", "date": "20200101000000", "type": "text/html", "status": "200"}, head.encode() + payload)


def with_revisits(pages: DataFrame, *, id_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """``pages`` as ``(page_id, url, html, last, last_url)``: the largest id among equal payloads and its URL, for all rows but its own.

    Digests with one row are left out of the join, so what is joined is small unless
    payloads repeat much; a payload on many pages is dealt over tasks; one under
    ``least_bytes`` refers to none. Of several rows with that id the smallest URL counts.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), "url", F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.sha1(F.encode("html", "UTF-8"))))
    many = rows.where("digest is not null and page_id is not null").groupBy("digest").agg(F.max("page_id").alias("last"), F.max_by(F.coalesce("url", F.lit("")), F.struct("page_id", F.coalesce("url", F.lit("")))).alias("last_url"), F.count(F.lit(1)).alias("n"))
    lone = rows.where("digest is not null and page_id is null").select("digest").distinct().withColumn("alone", F.lit(True))
    many = durable(many.join(lone, "digest", "left").where("n > 1 or alone").drop("alone"), "warc-revisits")
    joined = spread_join(rows, many, "digest", F.xxhash64("page_id", "url"), pages.count(), "left")
    own = F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "html", F.when(~own, F.col("last")).alias("last"), F.when(~own, F.col("last_url")).alias("last_url"))


def _files(members_: Iterable[bytes], records_per_file: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Gzip members as whole files, one a row: each ends with the member that reaches ``records_per_file`` or ``file_bytes``."""
    held: list[bytes] = []
    size = 0
    for m in members_:
        held.append(m)
        size += len(m)
        if len(held) >= records_per_file or size >= file_bytes:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])


def _write_files(files: DataFrame, path: str) -> None:
    """Write each row of ``files(value binary)`` as a file.

    The text sink writes the bytes as they are; what it puts behind them is an empty gzip member.
    """
    text = files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1)
    text.option("encoding", "ISO-8859-1").option("lineSep", gzip.compress(b"", mtime=0).decode("latin-1")).text(path)


def _parts(batch: pa.RecordBatch, column: str, most_rows: int = 256, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in turn, ``most_rows`` at once, or as many as hold ``most_bytes`` in a column, one at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and (i - first >= most_rows or held + n > most_bytes):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield batch.slice(first)


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: str = "1", records_per_file: int = 1000, file_bytes: int = 32 << 20, least_bytes: int = 0) -> None:
    """Write ``pages`` as WARC files of gzip members under ``path``, by way of ARC segments.

    Pages go into ARC segments of a few hundred records, or 8 MB, which are parsed by their
    header lines and lengths and converted record by record. A file ends with the record that makes it
    ``records_per_file`` records or ``file_bytes`` bytes, so a task holds one file and one page more, however long pages are.
    Null html is an empty payload, null URLs are
    ``about:blank``, a null id writes no id; of equal payloads of at least
    ``least_bytes`` bytes the rows with the largest id are responses, the others revisits.
    Other columns, whatever their names, are left out.
    """
    linked = with_revisits(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), id_col="page_id", html_col="html", least_bytes=least_bytes)

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            for piece in _parts(b, "html"):
                part = piece.to_pydict()
                payloads = [h.encode() for h in part["html"]]
                records = parse_arc(arc_bytes([_page_record(*r) for r in zip(part["page_id"], part["url"], payloads)], version))
                next(records)
                for r, to, url, h in zip(records, part["last"], part["last_url"], payloads):
                    yield member(convert(r) if to is None else convert(r, _page_record(to, url, h), str(to)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _files(converted(batches), records_per_file, file_bytes)

    _write_files(linked.mapInArrow(run, "value binary"), path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records under ``path``: ``(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload_sha1_ok)``.

    For a revisit the size is the one its record states, and its digest that of the
    record it revisits; for a response both are taken from the payload read. A file is read
    whole and opened member by member.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = []
                for f, block in (x for part in members(content.as_buffer().to_pybytes()) for x in parse_warc(part)):
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    _, payload = _split_http(block)
                    revisit, stated = f["WARC-Type"] == "revisit", f["WARC-Payload-Digest"].removeprefix("sha1:")
                    digest = stated if revisit else sha1_base32(payload)
                    to = int(f["X-Refers-To-Page"]) if revisit and f.get("X-Refers-To-Page") else None
                    size = int(f["X-Payload-Length"]) if revisit and "X-Payload-Length" in f else len(payload)
                    rows.append((int(f["X-Page-Id"]) if "X-Page-Id" in f else None, size, digest, f["WARC-Type"], to, f.get("WARC-Target-URI"), digest == stated))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload_sha1_ok"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload_sha1_ok boolean")


def convert_arc_files(spark: SparkSession, source: str, path: str, *, records_per_file: int = 1000, file_bytes: int = 32 << 20) -> None:
    """Convert the ARC files under ``source``, plain or gzipped, to WARC files of gzip members under ``path``; records may hold any bytes. A source file is one task's, opened whole; what it is converted to is not."""
    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            for content in b.column("content"):
                for r in parse_arc(b"".join(members(content.as_buffer().to_pybytes()))):
                    yield member(convert(r))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _files(converted(batches), records_per_file, file_bytes)

    _write_files(spark.read.format("binaryFile").load(source).select("content").mapInArrow(run, "value binary"), path)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as WARC in the shared folder and read the archives back (:func:`read_warc`). A long page costs its length a few times in one task."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path)
