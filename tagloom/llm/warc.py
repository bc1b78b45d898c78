"""WARC records in ZIP-packaged archives: writing with revisits, and reading by ranges.

An archive is a ZIP file with two stored members: the WARC file (each record compressed by itself, or
none) and an index of where its records lie. Reading never extracts an archive: the end record, the
ZIP64 records if there are any, and the central directory give the members; a member's data begin after
its local header; the index gives the records; and these are read by range, neighbours in one go.

Tasks write archives under names of their own into a shared folder. The rows they return are the
manifest; only archives it names are read, so what a lost or repeated task left behind never counts.
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

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import _parts, scratch, stored

DATA, INDEX = "archive/data.warc", "indexes/index.jsonl"
#: Bytes of records in an archive before the next one begins, and of a range read in one go.
ARCHIVE_BYTES, RANGE_BYTES, TASK_BYTES = 64 << 20, 4 << 20, 32 << 20
DATE = "2000-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response record, or a revisit record (HTTP headers only) if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + digest32(payload)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)))
    if refers_to is not None:
        head += [
            ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields after the first line (names lower-cased), and what follows the blank line."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("headers do not end")
    fields = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in fields}, rest


def parse_record(data: bytes) -> dict:
    """A record's fields; payload digests of responses are checked. ``ValueError`` for broken records."""
    if not data.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    head, rest = _headers(data)
    size = int(head["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    http, payload = _headers(rest[:size])
    page = lambda name: (m := re.fullmatch(r"<urn:page:(-?\d+)>", head.get(name, ""))) and int(m.group(1))
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    kind = head["warc-type"]
    if kind == "response" and (digest32(payload) != digest or len(payload) != int(http["content-length"])):
        raise ValueError("payload differs from its digest")
    return {
        "page_id": page("warc-record-id"), "record_type": kind, "refers_to": page("warc-refers-to"), "url": head.get("warc-target-uri"),
        "payload_bytes": int(http["content-length"]), "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


# --- ZIP -------------------------------------------------------------------------------------------

Ranged = Callable[[int, int], bytes]


def central_directory(read: Ranged, size: int) -> dict[str, tuple[int, int, int, int]]:
    """name -> (method, stored size, size, offset of the local header). ``ValueError`` if the file is no ZIP."""
    tail_at = max(0, size - 65_557)  # end record and the longest comment
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))  # the record itself takes 22 bytes
    while end >= 0 and end + 22 + struct.unpack("<H", tail[end + 20 : end + 22])[0] != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator = read(tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record64 = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, offset = struct.unpack("<QQQ", record64[32:56])
    data, at, out = read(offset, length), 0, {}
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("central directory is broken")
        flags, method = struct.unpack("<HH", data[at + 8 : at + 12])
        packed, full, n, extra, comment = struct.unpack("<IIHHH", data[at + 20 : at + 34])
        (header,) = struct.unpack("<I", data[at + 42 : at + 46])
        name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        fields = data[at + 46 + n : at + 46 + n + extra]
        while len(fields) >= 4:
            kind, width = struct.unpack("<HH", fields[:4])
            if kind == 1:  # ZIP64: only what did not fit, in this order
                values = iter(struct.unpack(f"<{width // 8}Q", fields[4 : 4 + width // 8 * 8]))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            fields = fields[4 + width :]
        if flags & 1:
            raise ValueError(f"{name} is encrypted")
        out[name] = method, packed, full, header
        at += 46 + n + extra + comment
    return out


def member_start(read: Ranged, header: int) -> int:
    """Where a member's data begin; the local header has name and extra lengths of its own."""
    local = read(header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    n, extra = struct.unpack("<HH", local[26:30])
    return header + 30 + n + extra


def small_member(read: Ranged, entry: tuple[int, int, int, int]) -> bytes:
    """A whole member, stored or deflated."""
    method, packed, _, header = entry
    data = read(member_start(read, header), packed)
    if method not in (0, 8):
        raise ValueError(f"compression method {method}")
    return data if method == 0 else zlib.decompress(data, -15)


def _opened(path: str) -> tuple[Ranged, int, pa.NativeFile]:
    system, name = fs.FileSystem.from_uri(path)
    file = system.open_input_file(name)

    def read(at: int, n: int) -> bytes:
        data = file.read_at(n, at)
        if len(data) != n:
            raise ValueError("file ends early")
        return data

    return read, file.size(), file


# --- Spark -----------------------------------------------------------------------------------------


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): equal payloads of ``least`` bytes or more refer to the largest id
    among them; that one, and all smaller payloads, refer to none."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
        F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("k", F.sha2("payload", 256))  # payloads of equal SHA-1 can be made
    groups = (
        rows.where(F.length("payload") >= least).groupBy("k").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
        .where("n > 1").select("k", "response")
    )
    return rows.join(groups, "k", "left").select(
        "page_id", "url", "payload", F.when(~F.col("response").eqNullSafe(F.col("page_id")), F.col("response")).alias("refers_to")
    )


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, compress: bool = True) -> DataFrame:
    """Writes (page_id, url, payload, refers_to) and returns the stored manifest (path, bytes, records).

    ``folder`` is a URI that all executors reach. Empty tables give an empty manifest.
    """
    folder = folder if "://" in folder else "file://" + folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        data, index = io.BytesIO(), []

        def close() -> pa.RecordBatch:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                z.writestr(DATA + ".gz" * compress, data.getbuffer())
                z.writestr(INDEX, "".join(json.dumps(x) + "\n" for x in index))
            name = f"{uuid.uuid4().hex}.zip"
            with system.open_output_stream(f"{base}/{name}") as f:
                f.write(out.getbuffer())
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([out.tell()], pa.int64()), pa.array([len(index)], pa.int64())],
                names=["path", "bytes", "records"],
            )

        for batch in _parts(batches):
            for page, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                at = data.tell()
                made = record(page, url, payload, refers_to)
                data.write(gzip.compress(made, 6, mtime=0) if compress else made)
                index.append({"page": page, "offset": at, "length": data.tell() - at})
                if data.tell() >= archive_bytes:
                    yield close()
                    data, index = io.BytesIO(), []
        if index:
            yield close()

    return stored(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


def archive_index(manifest: DataFrame) -> DataFrame:
    """(path, offset, length): where each record lies in its archive, from the archive's own index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                read, size, file = _opened(path)
                with file:
                    members = central_directory(read, size)
                    name = next(n for n in (DATA, DATA + ".gz") if n in members)
                    if members[name][0] != 0:
                        raise ValueError(f"{name} is not stored")
                    start = member_start(read, members[name][3])
                    lines = [json.loads(x) for x in small_member(read, members[INDEX]).splitlines()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(lines)), pa.array([start + x["offset"] for x in lines], pa.int64()), pa.array([x["length"] for x in lines], pa.int64())],
                    names=["path", "offset", "length"],
                )

    spread = manifest.select("path").repartition("path")
    return spread.mapInArrow(run, "path string, offset long, length long")


def read_records(index: DataFrame, range_bytes: int = RANGE_BYTES, tasks: int | None = None) -> DataFrame:
    """The records at (path, offset, length): page_id, record_type, refers_to, url, payload_bytes,
    payload_digest, payload (null for revisits). Records of a stretch of ``range_bytes`` are one read.

    ``tasks`` is the number of reading tasks: the index is small beside what it points at, so its own size says nothing of it.
    """
    kinds = {
        "page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(),
        "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, read, file = None, None, None
        for batch in batches:
            todo = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            at = 0
            while at < len(todo):
                if todo[at][0] != path:
                    if file is not None:
                        file.close()
                    path = todo[at][0]
                    read, _, file = _opened(path)
                first, end = todo[at][1], todo[at][1] + todo[at][2]
                upto = at + 1
                while upto < len(todo) and todo[upto][0] == path and todo[upto][1] == end and end - first < range_bytes:
                    end += todo[upto][2]
                    upto += 1
                data = read(first, end - first)
                parsed = []
                for _, offset, length in todo[at:upto]:
                    part = data[offset - first : offset - first + length]
                    parsed.append(parse_record(gzip.decompress(part) if part[:2] == b"\x1f\x8b" else part))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in parsed], t) for k, t in kinds.items()], names=list(kinds))
                at = upto
        if file is not None:
            file.close()

    stretch = F.expr(f"offset DIV {range_bytes}")
    dealt = ["path", "stretch"] if tasks is None else [tasks, "path", "stretch"]
    ordered = index.withColumn("stretch", stretch).repartition(*dealt).sortWithinPartitions("path", "offset").select("path", "offset", "length")
    return ordered.mapInArrow(
        run, "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"
    )


def round_trip(spark: SparkSession, pages: DataFrame, **columns: str) -> DataFrame:
    """The records of ``pages``, written to archives in the shared folder and read back from there.

    Null payloads are empty; null urls have no target; rows with a null id refer to an equal payload
    with an id if there is one. Repeated rows of the largest id are responses both. Other columns are not read.
    """
    manifest = write_archives(mark_revisits(pages, **columns), scratch(spark, "warc"))
    return read_records(archive_index(manifest), tasks=read_tasks(manifest))


def read_tasks(manifest: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """A task for every ``task_bytes`` of the archives, one at least."""
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    return max(1, -(-total // task_bytes))
