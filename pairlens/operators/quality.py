"""Data quality: rows that break a rule leave with the first rule they break, and every drop is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_reason(df: DataFrame, rules: list[tuple[str, Column | str]]) -> DataFrame:
    """Adds ``reason``: the first rule whose condition (of failure) holds, or null. An unknown condition does not hold."""
    reason = F.lit(None).cast("string")
    for name, bad in reversed(rules):
        reason = F.when(F.coalesce(F.expr(bad) if isinstance(bad, str) else bad, F.lit(False)), name).otherwise(reason)
    return df.withColumn("reason", reason)


def taxonomy(df: DataFrame, *by: str) -> DataFrame:
    """Rows by reason; null (kept) counts as 'kept'."""
    return df.groupBy(*by, F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("reason is null").drop("reason"), df.where("reason is not null")


def first_object(text: Column) -> Column:
    """The widest {...} of a text as a variant; null if there is none or it is no JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def kind(variant: Column, path: str) -> Column:
    """Type name of a field of a variant; null where it is missing. A boolean is no number here."""
    return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))


def number(variant: Column, path: str) -> Column:
    """A numeric field as double; null for other types."""
    k = kind(variant, path)
    return F.when(k.startswith("BIGINT") | k.startswith("DECIMAL") | k.startswith("DOUBLE") | k.startswith("FLOAT"), F.try_variant_get(variant, path, "double"))


def text(variant: Column, path: str) -> Column:
    return F.when(kind(variant, path) == "STRING", F.try_variant_get(variant, path, "string"))
