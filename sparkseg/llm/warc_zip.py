"""WARC records in ZIP-packaged archives: files that tasks write to the shared folder and read back by ranges.

An archive holds its data (gzip members, one a record) and its index as stored members.  A reader finds
them through the central directory, in its ZIP64 form too, and turns the index into ranges of neighbouring
records; ranges are dealt over the cluster, and each is one read of the file.  No member is ever extracted,
so an archive may be of any size.  Files are reached through pyarrow's file systems.  Where these do not know
the shared folder's scheme, archives are cells of a table that Spark writes instead.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut, partitions, shared_folder

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Record bytes before compression that fill an archive, and bytes that one read fetches (or one record, if that is larger).
ARCHIVE_BYTES, RANGE_BYTES = 32 << 20, 1 << 20
#: So many repeated payloads' digests are broadcast at most (some 30 MB); beyond, rows are joined to them by shuffling.
MOST_BROADCAST = 200_000
_DATE = "2024-01-01T00:00:00Z"
Read = Callable[[int, int], bytes]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _name(value: object) -> str:
    return "null" if value is None else "id:" + quote(str(value), safe="")


def _value(name: str | None) -> str | None:
    return None if name in (None, "null") else unquote(name[3:])


def warc_record(kind: str, ident: object, url: str | None, payload: bytes, digest: str, refers_to: object = None) -> bytes:
    """One record; a revisit carries the HTTP head, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{_name(ident)}>"), ("WARC-Date", _DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)))
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{_name(refers_to)}>")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_record(raw: bytes) -> dict:
    """Headers, HTTP head length and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]):
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    return {"headers": headers, "payload": payload, "payload_bytes": stated}


def pack(records: list[tuple[object, bytes]]) -> bytes:
    """An archive of (id, record) pairs with its index."""
    data, index = io.BytesIO(), []
    for ident, record in records:
        start = data.tell()
        data.write(gzip.compress(record, compresslevel=1, mtime=0))
        index.append(f"{_name(ident)} {re.sub('[^0-9]', '', _DATE)} " + json.dumps({"offset": start, "length": data.tell() - start, "filename": DATA.split("/")[-1]}))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in ((DATA, data.getvalue()), (INDEX, "\n".join(index).encode())):
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


def members(read: Read, size: int) -> dict[str, tuple[int, int]]:
    """Where each stored member's bytes are: name to (offset, length), from the central directory or its ZIP64 form."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or len(tail) - at < 22:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = read(tail_at + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", end[32:56])
    directory, out, at = read(start, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a central directory entry is damaged")
        method, packed, full, n_name, n_extra, n_note, local = struct.unpack("<H8xIIHHH8xI", directory[at + 10 : at + 46])
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, e = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[e : e + 4])
            if kind == 1:
                wide = list(struct.unpack(f"<{n // 8}Q", extra[e + 4 : e + 4 + n // 8 * 8]))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            e += 4 + n
        if method == 0:
            header = read(local, 30)
            n_local, x_local = struct.unpack("<HH", header[26:30])
            out[name] = (local + 30 + n_local + x_local, packed)
        at += 46 + n_name + n_extra + n_note
    return out


def index_of(read: Read, size: int) -> list[tuple[int, int]]:
    """(offset, length) in the file of every record that the indexes name; records of data without an index are looked for."""
    found, out, indexed = members(read, size), set(), set()
    for name, (offset, length) in found.items():
        if name.startswith("indexes/") and ".cdx" in name:
            raw = read(offset, length)
            for line in (gzip.decompress(raw) if name.endswith(".gz") else raw).decode().splitlines():
                entry = json.loads(line[line.index("{") :]) if "{" in line else {}
                if "offset" in entry:
                    member = next((m for m in (entry["filename"], "archive/" + entry["filename"]) if m in found), None)
                    if member is None:
                        raise ValueError(f"an index names {entry['filename']}, which isn't there")
                    start, n = int(entry["offset"]), int(entry["length"])
                    if start + n > found[member][1]:
                        raise ValueError("an index entry points beyond its member")
                    out.add((found[member][0] + start, n))
                    indexed.add(member)
    for name, (offset, length) in found.items():
        if name.endswith(".warc.gz") and name not in indexed:
            out |= set(_gzip_members(read, offset, length))
    return sorted(out)


def _gzip_members(read: Read, offset: int, length: int) -> Iterator[tuple[int, int]]:
    """Where the gzip members of a range begin and how long they are, read piece by piece."""
    unzip, start, at = zlib.decompressobj(31), 0, 0
    while at < length:
        piece = read(offset + at, min(RANGE_BYTES, length - at))
        at += len(piece)
        while piece:
            unzip.decompress(piece)
            if not unzip.eof:
                break
            piece = unzip.unused_data
            yield offset + start, at - len(piece) - start
            start, unzip = at - len(piece), zlib.decompressobj(31)
    if start < length:
        raise ValueError("the last record is cut short")


def ranges(entries: list[tuple[int, int]], most: int = RANGE_BYTES) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring records of at most `most` bytes, or one record."""
    held: list[tuple[int, int]] = []
    for offset, length in entries:
        if held and (offset != held[-1][0] + held[-1][1] or offset + length - held[0][0] > most):
            yield held
            held = []
        held.append((offset, length))
    if held:
        yield held


def _open(place: str) -> tuple[Read, int]:
    system, path = FileSystem.from_uri(place)
    file = system.open_input_file(path)
    return (lambda at, n: file.read_at(n, at)), file.size()


def _known(folder: str) -> bool:
    try:
        FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def _write(folder: str | None, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, bytes]] = []
        size, number = 0, 0
        task = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            """An archive under a name of its own, so that an attempt that fails leaves nothing that is ever read."""
            nonlocal held, size, number
            content, records = pack(held), len(held)
            name = f"pages-{task:05d}-{number:05d}-{uuid.uuid4().hex}.wacz"
            held, size, number = [], 0, number + 1
            if folder:
                system, path = FileSystem.from_uri(folder)
                with system.open_output_stream(f"{path.rstrip('/')}/{name}") as file:
                    file.write(content)
                name = f"{folder.rstrip('/')}/{name}"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([len(content)], pa.int64()), pa.array([None if folder else content], pa.binary())], names=["archive", "records", "bytes", "content"])

        for batch in batches:
            for ident, url, html, hexed, refers, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = warc_record("revisit" if revisit else "response", ident, url, html, base64.b32encode(bytes.fromhex(hexed)).decode(), refers)
                held.append((ident, record))
                size += len(record)
                if size >= most:
                    yield out()
        if held:
            yield out()

    return run


_ENTRY = "archive string, at long, offsets array<long>, lengths array<long>, content binary"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges of each archive."""
    for batch in batches:
        for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
            read, size = _open(archive) if not content.is_valid else _buffer(content.as_buffer())
            runs = list(ranges(index_of(read, size)))
            columns = [pa.array([archive] * len(runs), pa.string()), pa.array([r[0][0] for r in runs], pa.int64()), pa.array([[o for o, _ in r] for r in runs], pa.list_(pa.int64())), pa.array([[n for _, n in r] for r in runs], pa.list_(pa.int64()))]
            columns.append(pa.array([read(r[0][0], r[-1][0] + r[-1][1] - r[0][0]) if content.is_valid else None for r in runs], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["archive", "at", "offsets", "lengths", "content"])


def _buffer(data: pa.Buffer) -> tuple[Read, int]:
    return (lambda at, n: data.slice(at, n).to_pybytes()), data.size


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One read for each range, and its records, checked against their digests."""
    last, read = None, None
    for batch in batches:
        for archive, at, offsets, lengths, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if content is None:
                if archive != last:
                    last, (read, _) = archive, _open(archive)
                content = read(at, offsets[-1] + lengths[-1] - at)
            rows = []
            for offset, length in zip(offsets, lengths, strict=True):
                record = read_record(gzip.decompress(content[offset - at : offset - at + length]))
                h = record["headers"]
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                if h["WARC-Type"] == "response" and (payload_digest(record["payload"]) != digest or len(record["payload"]) != record["payload_bytes"]):
                    raise ValueError(f"the record at {offset} of {archive} has another payload than its head says")
                ident = h["WARC-Record-ID"].removeprefix("<urn:page:").rstrip(">")
                refers = h.get("WARC-Refers-To", "null").removeprefix("<urn:page:").rstrip(">")
                rows.append((_value(ident), h.get("WARC-Target-URI"), record["payload_bytes"], digest, h["WARC-Type"], _value(refers), record["payload"] if h["WARC-Type"] == "response" else None))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)], names=["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Writes a record for each row into archives in a folder (the shared one) and returns (archive, records, bytes, content); content is null for files.

    Of records with equal payloads of at least least_bytes bytes, those with the largest id are responses and
    the others revisit it; smaller payloads are all responses.  A null html is an empty payload, a null id
    is below all others, and rows that repeat the largest id are all responses.  Other columns are not read.
    The largest ids of repeated payloads are aggregated before the shuffle; up to most_broadcast of them are
    broadcast, so that pages stay where they are, and more are joined, where a hot payload's rows may be split.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"))
    keyed = base.select("*", F.sha1("html").alias("hex"), F.octet_length("html").alias("size"))
    last = keyed.where(F.col("size") >= least_bytes).groupBy("hex", "size").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").select("hex", "size", "last")
    last = cut(last)
    joined = keyed.join(F.broadcast(last) if last.count() <= most_broadcast else last, ["hex", "size"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("id"))
    rows = joined.select("id", "url", "html", "hex", "last", revisit.alias("revisit"))
    folder = folder or f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    if _known(folder):
        system, path = FileSystem.from_uri(folder)
        system.create_dir(path)
    else:
        folder = None
    return cut(rows.mapInArrow(_write(folder, archive_bytes), "archive string, records long, bytes long, content binary"))


def archive_files(spark: SparkSession, places: list[str]) -> DataFrame:
    """Archives that are already there, for read_archives: paths or URIs that all executors reach."""
    return spark.createDataFrame([(x, None) for x in places], "archive string, content binary")


def read_archives(archives: DataFrame, id_type: str = "long") -> DataFrame:
    """The records of (archive, content): id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit)."""
    ranged = archives.select("archive", "content").mapInArrow(_listed, _ENTRY).repartition(partitions(archives.sparkSession), "archive", "at").sortWithinPartitions("archive", "at")
    out = ranged.mapInArrow(_fetch, "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return out.withColumn("id", F.col("id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = read_archives(write_archives(pages), pages.schema["page_id"].dataType.simpleString())
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n >> {0} & 31) + 1, 1)"
_BASE32 = "array_to_string(list_transform(list_transform(range(8), lambda i: ('0x' || substr(sha1(coalesce(html, '')), i * 5 + 1, 5))::BIGINT), lambda n: " + " || ".join(_DIGIT.format(x) for x in (15, 10, 5, 0)) + "), '')"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, {_BASE32} AS payload_digest FROM pages),
l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to FROM l
"""
