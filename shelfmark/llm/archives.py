"""WARC files from legacy ARC archives: parse version-specific headers, synthesise WARC records, write and read them."""

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import saved
from shelfmark.sources import storage

#: Bytes of records after which an ARC archive is closed and the next begun.
ARC_BYTES = 1 << 21
#: Field lines of the two ARC versions, as the archives declare them (fixed values).
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = "\r\n\r\n"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_CAPTURED = "20200101000000"

RECORDS = (
    "record_id string, uri string, ip string, date string, status string, content_type string,"
    " payload_digest string, payload_bytes long, page_id long, http binary, payload binary"
)
READ = "record_id string, record_type string, uri string, date string, page_id long, payload_digest string, payload_bytes long, refers_to_id string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


# -- ARC ------------------------------------------------------------------------


def arc_header(version: int, name: str) -> bytes:
    body = f"{version} 0 shelfmark\n{FIELDS[version]}\n".encode("ascii")
    middle = "200 - - 0 " + name + " " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {_CAPTURED} text/plain {middle}{len(body)}\n".encode("ascii") + body


def arc_record(version: int, name: str, offset: int, uri: str, content: bytes, checksum: str) -> bytes:
    middle = f"200 {checksum} - {offset} {name} " if version == 2 else ""
    return f"\n{uri} 0.0.0.0 {_CAPTURED} text/html {middle}{len(content)}\n".encode("ascii") + content


def safe_uri(url: str | None, page_id: int | None) -> str:
    """The address without characters that would end a header field; pages without one get a name."""
    return quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else f"urn:page:{'' if page_id is None else page_id}"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, held, size, name, version = 0, [], 0, "", 1

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([b"".join(held)], pa.binary())], ["name", "content"])

    for batch in batches:
        for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not held:
                version, count = 1 + count % 2, count + 1
                name = f"pages-{'none' if page_id is None else page_id}-{count}.arc"
                held.append(arc_header(version, name))
                size = len(held[0])
            payload = (html or "").encode("utf-8")
            own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{own}Content-Length: {len(payload)}{END}".encode("ascii")
            held.append(arc_record(version, name, size, safe_uri(url, page_id), http + payload, digest(payload)))
            size += len(held[-1])
            if size >= ARC_BYTES:
                yield flush()
                held = []
    if held:
        yield flush()


def arcs_of_pages(pages: DataFrame) -> DataFrame:
    """Archives (name, content) in ARC form, versions 1 and 2 in turn, of rows (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_pack, "name string, content binary")


def parse_arc(name: str, data: bytes) -> Iterator[dict]:
    """The records of an archive after its version block. Fields are named by the block's own field line.

    Raises ValueError for another version, a header with another number of fields, or a
    declared length beyond the end.
    """
    at, fields = 0, FIELDS[1].split(" ")
    first = True
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"{name}: header without end at {at}")
        line = data[at:end].decode("utf-8", "replace").split(" ")
        length = int(line[-1]) if line[-1].isdigit() else -1
        content = data[end + 1 : end + 1 + length]
        if length < 0 or len(content) != length:
            raise ValueError(f"{name}: record at {at} declares {line[-1]} bytes, {len(data) - end - 1} are left")
        if first:
            lines = content.decode("utf-8", "replace").split("\n")
            version = lines[0].split(" ")[0]
            if version not in ("1", "2"):
                raise ValueError(f"{name}: ARC version {version}")
            fields = (lines[1] if len(lines) > 1 and lines[1] else FIELDS[int(version)]).split(" ")
            first = False
        else:
            if len(line) != len(fields):
                raise ValueError(f"{name}: {len(line)} fields at {at}, {len(fields)} declared")
            yield dict(zip(fields, line, strict=True)) | {"content": content}
        at = end + 1 + length


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with its empty line) and payload; no header if the content does not begin with one."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[: end + 4], content[end + 4 :])


def _http_value(http: bytes, name: str) -> str | None:
    for line in http.decode("latin-1").split("\r\n")[1:]:
        key, found, value = line.partition(":")
        if found and key.strip().lower() == name:
            return value.strip()
    return None


def _number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.strip().split(" ")[0] for part in RECORDS.split(",")]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            for r in parse_arc(name or "", content or b""):
                http, payload = split_http(r["content"])
                sha, page = digest(payload), _number(_http_value(http, "x-page-id"))
                d = (r["Archive-date"] + "00000000000000")[:14]
                date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                own = uuid.uuid5(_NAMES, f"{r['URL']} {d} {'' if page is None else page} {sha}")
                status = http.split(b" ", 2)[1].decode("latin-1") if http.count(b" ") else None
                rows.append((f"urn:uuid:{own}", r["URL"], r["IP-address"], date, status, r["Content-type"], sha, len(payload), page, http, payload))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, names)


def convert(arcs: DataFrame) -> DataFrame:
    """The synthesised records of archives (name, content): identifier, address, time, digest, HTTP header and payload.

    The identifier is derived from address, time, number and digest, so a repeated task gives it again.
    """
    return arcs.select("name", "content").mapInArrow(_convert, RECORDS)


# -- WARC -----------------------------------------------------------------------


def _warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            revisit = r["response_id"] is not None
            block = r["http"] if revisit else r["http"] + r["payload"]
            kind = "revisit" if revisit else "response"
            head = [
                "WARC/1.1",
                f"WARC-Type: {kind}",
                f"WARC-Record-ID: <{r['record_id']}>",
                f"WARC-Date: {r['date']}",
                f"WARC-Target-URI: {r['uri']}",
                f"WARC-IP-Address: {r['ip']}",
                f"WARC-Payload-Digest: sha1:{r['payload_digest']}",
                f"WARC-Block-Digest: sha1:{digest(block)}",
                "Content-Type: application/http; msgtype=response",
            ]
            if revisit:
                head += [
                    "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                    f"WARC-Refers-To: <{r['response_id']}>",
                ]
            head.append(f"Content-Length: {len(block)}")
            out.append("\r\n".join(head).encode("utf-8") + END.encode() + block)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write_warcs(records: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Gzipped WARC files in the folder; of records with equal payloads the one with the largest page_id is kept in full.

    The roles are found on digests alone, which are saved, so the archives are parsed twice: for them and for the
    payloads. These move once, by record_id, so copies of one page do not meet in one task. Spark's text writer puts the two line ends after each record.
    """
    keys = saved(records.select("record_id", "payload_digest", "payload_bytes", "page_id"), "keys").distinct()
    kept = (
        keys.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.max(F.struct("page_id", "record_id")).alias("kept"))
    )
    roles = keys.join(kept, "payload_digest", "left").select(
        "record_id", F.when(F.col("kept.record_id") != F.col("record_id"), F.col("kept.record_id")).alias("response_id")
    )
    lines = records.join(roles, "record_id").mapInArrow(_warc, "record binary")
    lines.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(folder)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of one file, gzipped or not, one record in memory at a time."""
    source = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while True:
        line = source.readline()
        while line in (b"\r\n", b"\n"):
            line = source.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := source.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = source.read(length)
        if len(block) != length:
            raise ValueError(f"record {headers.get('warc-record-id')} declares {length} bytes, {len(block)} are left")
        yield headers, block


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.strip().split(" ")[0] for part in READ.split(",")]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for data in batch.column(0):
            rows = []
            for h, block in parse_warc(data.as_py()):
                if h.get("warc-type") not in ("response", "revisit"):
                    continue
                http, payload = split_http(block)
                sha = h.get("warc-payload-digest", "").removeprefix("sha1:")
                size = _number(_http_value(http, "content-length"))
                if h["warc-type"] == "response":
                    if sha != digest(payload):
                        raise ValueError(f"record {h.get('warc-record-id')}: payload differs from its digest")
                    size = len(payload)
                refers = h.get("warc-refers-to")
                rows.append((h["warc-record-id"].strip("<>"), h["warc-type"], h.get("warc-target-uri"), h.get("warc-date"), _number(_http_value(http, "x-page-id")), sha, size, refers and refers.strip("<>")))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, names)


def read_warcs(spark: SparkSession, folder: str) -> DataFrame:
    """The response and revisit records of all WARC files in a folder; payload digests are checked."""
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(_read, READ)


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page: to ARC, to WARC files, and read back.

    A null html is an empty payload; empty payloads equal each other. Pages without a
    page_id are archived too and revisit like others (null counts as smallest). Repeated
    rows are repeated records of equal identifier and role.
    """
    spark = pages.sparkSession
    target = folder or f"{storage.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warcs(convert(arcs_of_pages(pages)), target, least_bytes)
    if folder is None:
        path = storage._path(spark, target)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    rows = saved(read_warcs(spark, target), "read")  # narrow; the archives are read and checked once
    responses = rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"))
    return rows.join(responses, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
