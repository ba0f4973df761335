"""Dated records: period shares, nearest periods, islands of intervals and mirrored duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def year_days(df: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each calendar year of an inclusive interval with its days and the interval's total."""
    out = df.withColumn("period", F.explode(F.sequence(F.year(start), F.year(end))))
    low = F.greatest(F.col(start), F.make_date("period", F.lit(1), F.lit(1)))
    high = F.least(F.col(end), F.make_date("period", F.lit(12), F.lit(31)))
    return out.withColumn("days", F.datediff(high, low) + 1).withColumn("total_days", F.datediff(end, start) + 1)


def nearest_period(wanted: DataFrame, source: DataFrame, bound: int, keep: list[str]) -> DataFrame:
    """Nearest source row within ``bound`` periods of each (entity, period); an exact one first, then the earlier.

    The bound becomes an equi-join: each wanted period looks for the 2 * bound + 1 periods around it.
    """
    key = [c for c in wanted.columns]
    near = wanted.withColumn("src", F.explode(F.sequence(F.col("period") - bound, F.col("period") + bound)))
    right = source.select("entity", F.col("period").alias("src"), *keep)
    hit = F.when(F.col("_hit"), F.struct(F.abs(F.col("src") - F.col("period")).alias("d"), "src", *keep))
    best = near.join(right.withColumn("_hit", F.lit(True)), ["entity", "src"], "left").groupBy(*key).agg(F.min(hit).alias("m"))
    return best.select(*key, F.col("m.src").alias("src"), *[F.col(f"m.{c}").alias(c) for c in keep])


def within(wanted: DataFrame, source: DataFrame, bound: int) -> DataFrame:
    """All source rows of the same entity within ``bound`` periods."""
    near = wanted.withColumn("src", F.explode(F.sequence(F.col("period") - bound, F.col("period") + bound)))
    return near.join(source.withColumnRenamed("period", "src"), ["entity", "src"])


def nearest_distance(wanted: DataFrame, source: DataFrame) -> DataFrame:
    """Distance to the nearest source period of each (entity, period), without bound, by two ordered looks."""
    rows = wanted.select("entity", "period").distinct().withColumn("w", F.lit(1)).unionByName(source.select("entity", "period").distinct().withColumn("w", F.lit(0)))
    at = F.when(F.col("w") == 0, F.col("period"))
    w = Window.partitionBy("entity").orderBy("period", "w")
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = rows.withColumn("lo", before).withColumn("hi", after).where("w = 1")
    return out.select("entity", "period", F.least(F.col("period") - F.col("lo"), F.col("hi") - F.col("period")).alias("distance"))


def islands(df: DataFrame, key: str, order: list[str], slack: int) -> DataFrame:
    """Numbers the runs of intervals in which each starts within ``slack`` days of the end before it."""
    w = Window.partitionBy(key).orderBy(*order)
    gap = F.abs(F.datediff("start_d", F.lag("end_d").over(w)))
    df = df.withColumn("brk", F.when(gap <= slack, 0).otherwise(1))
    return df.withColumn("island", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def collapsed_mirrors(df: DataFrame, identity: list[str], reference: str) -> DataFrame:
    """One row for each exact duplicate, with the reference if any carried one and the number collapsed."""
    return df.groupBy(*identity).agg(F.max(F.col(reference).cast("int")).cast("boolean").alias("has_reference"), (F.count(F.lit(1)) - 1).alias("collapsed"))


def rowspan_carry(df: DataFrame, key: str, order: str, value: str, span: str) -> DataFrame:
    """A value with span n holds for the n - 1 rows after it, unless a new value comes first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(span).alias("n"), F.col(order).alias("o")))
    last = F.last(at, ignorenulls=True).over(w)
    return df.withColumn("_l", last).withColumn("carried", F.when(F.col(order) - F.col("_l.o") < F.col("_l.n"), F.col("_l.v"))).drop("_l")
