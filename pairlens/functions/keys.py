"""Columns for identities and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_key(a: Column, b: Column) -> Column:
    """Key of an unordered pair; null for a pair of equals."""
    return F.when(a != b, F.concat_ws("|", F.least(a, b), F.greatest(a, b)))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 12 hexadecimal digits of a digest of the parts; null if a part holds the separator."""
    bad = F.greatest(*[F.coalesce(F.contains(p, F.lit("\n")), F.lit(False)) for p in parts], F.lit(False))
    return F.when(~bad, F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 12)))


def contract_id(*parts: Column) -> Column:
    """12 digits of a digest over parts with their lengths, so bytes cannot move between parts."""
    sized = [x for p in parts for x in (F.octet_length(p).cast("string"), F.lit("\n"), p)]
    return F.substring(F.sha2(F.concat(*sized), 256), 1, 12)


def json_hash(**fields: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def fingerprint(df: DataFrame, volatile: list[str]) -> DataFrame:
    """One digest of a table that neither order, partitions nor volatile columns change.

    Rows are digested, counted by the first two digits, and digests of sorted groups are digested again; the sum of
    48-bit parts keeps groups bounded.
    """
    kept = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(set(df.columns) - set(volatile))]
    row = df.select(F.sha2(F.concat_ws("\x1f", *kept), 256).alias("h"))
    part = lambda at: F.conv(F.substring("h", at, 12), 16, 10).cast("decimal(38,0)")
    sums = row.agg(F.count(F.lit(1)).alias("n"), *[F.sum(part(1 + 12 * i)).alias(f"s{i}") for i in range(5)])
    return sums.select("n", F.sha2(F.concat_ws("|", "n", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("")) for i in range(5)]), 256).alias("digest"))
