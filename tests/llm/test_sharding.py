import binascii

import pytest
from pyspark.sql import functions as F

from pairlens.llm.sharding import half_bits, locate, permute, round_keys, shard_rows


def brute(x, n, seed):
    w = half_bits(n)
    mask = (1 << w) - 1
    while True:
        left, right = x >> w, x & mask
        for a, b in round_keys(seed):
            left, right = right, left ^ ((((right * a + b) >> 15) ^ (right * a)) & mask)
        x = left << w | right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000, 4097])
def test_permutation(spark, n):
    got = {r.x: r.y for r in spark.range(n).select(F.col("id").alias("x"), permute(F.col("id"), n, 9).alias("y")).collect()}
    assert sorted(got.values()) == list(range(n))
    assert got == {x: brute(x, n, 9) for x in range(n)}


def test_large_numbers(spark):
    n = 10**13
    rows = [0, 1, 12345678901, n - 1]
    got = [r.y for r in spark.createDataFrame([(x,) for x in rows], "x long").select(permute(F.col("x"), n, 3).alias("y")).collect()]
    assert got == [brute(x, n, 3) for x in rows]


def check(df, shards=8):
    rows = shard_rows(df, shards).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, binascii.crc32((r.text or "").encode())) for r in df.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    by = [[r.slot for r in rows if r.shard == s] for s in range(shards)]
    assert max(map(len, by)) - min(map(len, by)) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by)
    assert {r.law for r in rows} <= {"rows"} and all(r.grown_shard is None for r in rows)
    return sorted((str(r.doc_id), r.size, r.shard, r.slot) for r in rows)


def test_small_cases_and_partitions(spark):
    rows = [(i, f"text {i}") for i in range(50)] + [(None, None), (None, ""), (3, "é🙂"), (-7, "x")] + [(9, "same")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash"))
    assert check(df) == check(df.repartition(7, "text"))
    assert shard_rows(df.limit(0)).count() == 0
    check(df.limit(3))


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs)
    out = shard_rows(docs)
    n = docs.count()
    again = out.select("shard", "slot", locate(F.col("row_number"), n, 8, 20260914).alias("x"))
    assert again.where("shard <> x.shard or slot <> x.slot").count() == 0


def test_quotients_beyond_double_precision(spark):
    n = 18014398509481984
    x = n - 1
    at = spark.createDataFrame([(x,)], "x long").select(locate(F.col("x"), n, 8, 5).alias("at")).first().at
    assert (at.shard, at.slot) == (brute(x, n, 5) % 8, brute(x, n, 5) // 8)


def test_very_many_equal_rows_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("pairlens.llm.sharding.BLOCK", 7)
    rows = [(i, f"text {i}") for i in range(20)] + [(9, "same")] * 40 + [(None, "no id")] * 30 + [(None, f"none {i}") for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))
