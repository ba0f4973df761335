import hashlib
import io
import os
from collections import defaultdict

import zstandard
from pyspark.sql import functions as F

from pairlens.llm.warc import archive_bytes, archive_round_trip, payload, read_archives, read_records, write_archives


def brute(rows):
    by = defaultdict(list)
    for i, _, h in rows:
        by[(h or "").encode()].append(i)
    out = []
    for i, u, h in rows:
        p = (h or "").encode()
        ids = [x for x in by[p] if x is not None]
        revisit = len(p) >= 1000 and len(by[p]) > 1 and ids and i != max(ids)
        out.append((str(i), str(u), len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None))
    return sorted(out, key=str)


def run(df):
    return sorted(((str(r.page_id), str(r.url), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive_round_trip(df).collect()), key=str)


def test_small_cases(spark):
    big, other = "<p>é🙂\r\n\r\n" * 200, "x" * 1000
    rows = [(1, "http://a", big), (2, "http://b c\r\n", big), (3, None, None), (4, "u", ""), (5, "v", "small"), (6, "w", "small"), (None, "n", big), (7, "o", other), (None, "p", "y" * 2000), (None, "q", "y" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("again", F.lit(1))
    assert run(df) == brute(rows)
    assert archive_round_trip(df.limit(0)).count() == 0


def test_table_and_files(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert run(pages) == brute([(r.page_id, r.url, r.html) for r in pages.collect()])
    manifest = write_archives(pages, folder=f"file://{tmp_path}/w")
    files = sorted(f"file://{tmp_path}/w/{x}" for x in os.listdir(tmp_path / "w"))
    assert sorted(r.path for r in manifest.collect()) == files
    assert read_archives(manifest).count() == pages.count()
    want = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    got = {r.page_id: bytes(r.payload) for r in payload(manifest).collect()}
    assert all(want[i] == p for i, p in got.items()) and got


def test_shuffled_digests(spark, monkeypatch):
    monkeypatch.setattr("pairlens.llm.warc.BROADCAST_DIGESTS", -1)
    rows = [(i, "u", "z" * 1500 if i % 3 == 0 else f"{i} " * 600) for i in range(60)]
    assert run(spark.createDataFrame(rows, "page_id long, url string, html string")) == brute(rows)


def test_dictionary_frame_leads_and_records_stand_alone():
    records = [f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(b)}\r\n\r\n{b}\r\n\r\n".encode() for b in (f"<html>page {i} of many pages, same words {i * i}</html>" for i in range(3000))]
    content = archive_bytes(records, 3)
    n = int.from_bytes(content[4:8], "little")
    assert content[:4] == b"\x5d\x2a\x4d\x18" and n > 1000
    known = zstandard.ZstdCompressionDict(content[8 : 8 + n])
    frame = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
    assert frame.decompress(content[8 + n : 8 + n + 4000]) == records[0]
    assert len(list(read_records(io.BytesIO(content)))) == 3000
    assert len(content) < len(archive_bytes(records[:1], 3)) * 3000
