"""WARC archives whose records are compressed one by one with a dictionary built from the archive itself.

Each task collects the records of an archive up to a fixed size, trains a Zstandard dictionary on evenly spaced
records, and writes a file: a skippable frame with the dictionary, then each record as a frame of its own that names
it. A reader needs the leading frame and the record's own bytes only. Files go to a folder that all executors reach,
under a name made of partition and number, by writing aside and renaming, so that a task that runs again replaces its
own files; the returned manifest lists what the finished tasks wrote.

Records with equal payloads of ``least`` bytes or more: the one with the largest page id is the response and the rest
are revisits without payload. The largest id for each digest is aggregated before it is joined, so a payload that a
third of all pages share is no hot group.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed values of the format: magic number of the dictionary's skippable frame.
DICT_MAGIC = 0x184D2A5D
#: Record bytes in an archive, bytes of the whole records its dictionary is trained on (about), and the dictionary's size.
ARCHIVE_BYTES, SAMPLE_BYTES, DICT_BYTES = 24 << 20, 1 << 20, 32 << 10
BROADCAST_DIGESTS = 100_000
DATE = "2026-01-01T00:00:00Z"
MANIFEST = "path string, records long, raw_bytes long, file_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"


def plan_records(pages: DataFrame, scratch: Scratch, least: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to)."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8")
    df = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    df = df.withColumn("digest", F.sha1("payload"))
    large = df.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("times"), F.max("page_id").alias("last"))
    again = scratch.save(large.where("times > 1 and last is not null").select(F.col("digest").alias("again"), "last"))
    few = again.count() <= BROADCAST_DIGESTS
    out = df.join(F.broadcast(again) if few else again, F.col("digest") == F.col("again"), "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return out.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; ids are derived from the page, so a task that runs again writes the same bytes."""
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "urn:none")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}')}>"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Page-Url: {'' if url is None else 'u' + base64.b64encode(url.encode()).decode()}", f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _trained(records: list[bytes], total: int) -> zstandard.ZstdCompressionDict | None:
    step = max(1, total // SAMPLE_BYTES)
    samples = records[::step]
    if len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=512, d=8)
    except zstandard.ZstdError:  # too little or too uniform to train on
        return None


def archive_bytes(records: list[bytes], level: int) -> bytes:
    """File content for the records; without a dictionary where too few records exist to build one."""
    known = _trained(records, sum(map(len, records)))
    press = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
    raw = known.as_bytes() if known else b""
    return b"".join([struct.pack("<II", DICT_MAGIC, len(raw)), raw, *map(press.compress, records)])


def _write(batches: Iterator[pa.RecordBatch], folder: str, level: int) -> Iterator[pa.RecordBatch]:
    fs, root = pa.fs.FileSystem.from_uri(folder)
    task = TaskContext.get()
    held: list[bytes] = []
    size, k = 0, 0

    def close() -> pa.RecordBatch:
        content = archive_bytes(held, level)
        name = f"{task.partitionId():06d}-{k:05d}.warc.zst"
        aside = f"{root}/.{name}.{task.taskAttemptId()}"
        with fs.open_output_stream(aside, compression=None) as out:
            out.write(content)
        fs.move(aside, f"{root}/{name}")
        return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": len(held), "raw_bytes": size, "file_bytes": len(content)}])

    fs.create_dir(root, recursive=True)
    for b in batches:
        for page, url, payload, digest, kind, refers in zip(*(b.column(i) for i in range(6))):
            r = _record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), kind.as_py(), refers.as_py())
            held.append(r)
            size += len(r)
            if size >= ARCHIVE_BYTES:
                yield close()
                held, size, k = [], 0, k + 1
    if held:
        yield close()


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 1000, level: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes every row of ``pages`` as a record and returns the manifest (path, records, raw_bytes, file_bytes).

    Null html is an empty payload, null ids and urls stay null. Rows repeated with the largest id are all responses.
    Other columns are ignored; an empty table writes nothing. Without ``folder``, one in the shared folder is made.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    to = folder or f"{scratch.root}/archives"
    records = plan_records(pages, scratch, least, id_col, url_col, html_col)
    return scratch.save(records.mapInArrow(lambda b: _write(b, to, level), MANIFEST))


def read_records(content: pa.NativeFile) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive, read as a stream."""
    magic, n = struct.unpack("<II", content.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    raw = content.read(n)
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    rest = b""
    while True:
        frame, parts = unpress.decompressobj(read_across_frames=False), []
        while not frame.eof:
            if not rest and not (rest := content.read(1 << 20)):
                break
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        record = b"".join(parts)
        if not record:
            return
        head, _, body = record.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, body[: int(headers["Content-Length"])]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():
            fs, at = pa.fs.FileSystem.from_uri(path)
            rows = []
            with fs.open_input_stream(at, compression=None) as content:
                for h, block in read_records(content):
                    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind, size = h["WARC-Type"], int(h["X-Payload-Length"])
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload does not match its record")
                    url = h["X-Page-Url"]
                    rows.append((int(h["X-Page-Id"]) if h["X-Page-Id"] else None, base64.b64decode(url[1:]).decode() if url else None, size, digest, kind, int(h["X-Refers-To-Page"]) if kind == "revisit" else None, path))
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives in a manifest; response payloads are checked against their digests."""
    paths = manifest.select("path").repartition(max(16, 2 * manifest.sparkSession.sparkContext.defaultParallelism), "path")
    return paths.mapInArrow(_read, RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` and reads the archives back."""
    return read_archives(write_archives(pages))


def payload(archives: DataFrame) -> DataFrame:
    """(page_id, payload) of the response records in a manifest's archives."""

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(at, compression=None) as content:
                    for h, block in read_records(content):
                        if h["WARC-Type"] == "response":
                            yield pa.RecordBatch.from_arrays([pa.array([int(h["X-Page-Id"]) if h["X-Page-Id"] else None], pa.int64()), pa.array([block.partition(b"\r\n\r\n")[2]], pa.binary())], names=["page_id", "payload"])

    return archives.select("path").mapInArrow(bodies, "page_id long, payload binary")
