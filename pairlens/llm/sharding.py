"""Sharding by a keyed permutation of global row numbers.

Rows are numbered 0 to N-1 in a fixed order that no partitioning changes; a balanced Feistel network over the next
power of four, walked until it lands below N, permutes the numbers; the permuted number's remainder is the shard and
its quotient the slot. So shard sizes differ by one row at most, slots have no gaps, and ``locate`` computes both from
a row number alone.

Numbers come from buckets of ids: buckets have an offset each, and rows are ranked within theirs. Equal rows are counted
before they are numbered, so that very many repeats stay one row until the end, when they are dealt out in blocks.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Buckets: rows in one on average, and fewest and most (the most bounds what is broadcast: 16 bytes each).
BUCKET_ROWS, LEAST, MOST = 50_000, 256, 65_536
#: Equal rows that one task unfolds at most.
BLOCK = 100_000
ROUNDS = 6
#: Steps of the walk; a step fails with a chance of 3 in 4 at most, so few rows need the second part.
STEPS, MORE_STEPS = 16, 512


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Odd multiplier and addend of each round."""
    x, out = seed & 0x7FFFFFFF, []
    for _ in range(2 * ROUNDS):
        x = (x * 1103515245 + 12345) & 0x7FFFFFFF
        out.append(x | 1)
    return list(zip(out[::2], out[1::2]))


def half_bits(n: int) -> int:
    """Bits of each half of the smallest square domain that holds n numbers."""
    w = 1
    while 1 << (2 * w) < n:
        w += 1
    return w


def _once(x: Column, w: int, seed: int) -> Column:
    keys = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in round_keys(seed)])
    mask = F.lit((1 << w) - 1).cast("long")
    start = F.struct(F.shiftright(x, w).alias("l"), x.bitwiseAND(mask).alias("r"))
    mix = lambda r, k: F.shiftright(r * k["a"] + k["b"], 15).bitwiseXOR(r * k["a"]).bitwiseAND(mask)
    return F.aggregate(keys, start, lambda s, k: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(mix(s["r"], k)).alias("r")), lambda s: F.shiftleft(s["l"], w).bitwiseOR(s["r"]))


def permute(x: Column, n: int, seed: int) -> Column:
    """Image of a row number below n (n at most 2**58) under the permutation of 0 to n-1 that the seed names."""
    w = half_bits(n)
    walk = lambda start, steps: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda p, _: F.when(p < n, p).otherwise(_once(p, w, seed)))
    first = walk(_once(x.cast("long"), w, seed), STEPS)
    rest = lambda p: F.when(p < n, p).otherwise(walk(p, MORE_STEPS))
    return F.transform(F.array(first), rest)[0]


def locate(row: Column, n: int, shards: int, seed: int) -> Column:
    """Struct of shard and slot for a row number."""
    p = lambda v: F.struct((v % shards).cast("int").alias("shard"), F.call_function("div", v, F.lit(shards)).cast("long").alias("slot"))
    return F.transform(F.array(permute(row, n, seed)), p)[0]


def _bucket(number: Column, buckets: int) -> Column:
    return (F.pmod(F.pmod(number, F.lit(2147483629)) * 48271, F.lit(2147483647)) % buckets).cast("int")


def _unfolded(groups: DataFrame, largest: int) -> DataFrame:
    """A row for each of a group's ``times`` rows, numbered from ``start``; large groups are dealt out in blocks."""
    if largest <= BLOCK:
        return groups.withColumn("row_number", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("times") - 1)))
    end = F.col("start") + F.col("times") - 1
    blocks = groups.withColumn("block", F.explode(F.sequence(F.col("start"), end, F.lit(BLOCK).cast("long")))).repartition("block")
    return blocks.withColumn("row_number", F.explode(F.sequence(F.col("block"), F.least(F.col("block") + (BLOCK - 1), end))))


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 20260914, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number) for every row.

    ``size`` is the UTF-8 length plus 1, ``text_crc32`` the unsigned checksum; null text counts as empty. Rows are
    numbered by bucket (of the id, or of size and checksum where it is null), id (null first), size and checksum; rows
    equal in all of these are interchangeable. Other columns are ignored; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("crc"))
    groups = scratch.save(rows.groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("times")))
    n, largest = groups.agg(F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.max("times"), F.lit(0))).first()
    buckets = min(MOST, max(LEAST, n // BUCKET_ROWS))
    groups = groups.withColumn("bucket", _bucket(F.coalesce(F.col("id"), F.col("crc") + F.col("size")), buckets))
    totals = groups.groupBy("bucket").agg(F.sum("times").alias("rows"))
    offsets = totals.select("bucket", (F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")).alias("offset"))
    order = Window.partitionBy("bucket").orderBy("id", "size", "crc").rowsBetween(Window.unboundedPreceding, 0)
    ranked = groups.withColumn("first", F.sum("times").over(order) - F.col("times")).join(F.broadcast(offsets), "bucket")
    each = _unfolded(ranked.select("id", "size", "crc", "times", (F.col("offset") + F.col("first")).alias("start")), largest)
    out = each.withColumn("at", locate(F.col("row_number"), max(n, 1), shards, seed))
    return out.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("at.shard").alias("shard"),
        F.col("at.slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
