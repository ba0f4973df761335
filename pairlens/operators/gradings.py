"""From single gradings to scores: canonical means, population scales and within-side normalisation.

Scores are integers (tenths) until the last division, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded


def signature(col: str) -> Column:
    """Sorted distinct values, joined by a plus sign."""
    return F.array_join(F.array_sort(F.collect_set(col)), "+")


def canonical_scores(gradings: DataFrame, keys: list[str], exclude: list[str] | None = None) -> DataFrame:
    """Sum, number and spread of the judged gradings of each key; unjudged or missing scores are ignored."""
    df = gradings.where("judged and score_t is not null")
    if exclude:
        df = df.where(~F.col("grader").isin(exclude))
    return df.groupBy(*keys).agg(
        F.sum("score_t").alias("sum_t"),
        F.count(F.lit(1)).alias("n"),
        (F.max("score_t") - F.min("score_t")).alias("spread_t"),
        F.array_join(F.array_sort(F.collect_set("grader")), ",").alias("graders"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.bool_or("evidence_used").alias("any_evidence"),
        F.array_join(F.array_sort(F.collect_set("contract_id")), ",").alias("contracts"),
    )


def coverage(canon: DataFrame) -> DataFrame:
    """Entity-periods by number of gradings, with spreads where there is more than one."""
    return canon.groupBy("n").agg(F.count(F.lit(1)).alias("keys"), F.max(F.expr("if(n > 1, spread_t, null)")).alias("max_spread"), rounded(F.avg(F.expr("if(n > 1, spread_t, null)"))).alias("mean_spread"))


def population(gradings: DataFrame) -> DataFrame:
    """One observation (thousandths of a tenth) for each family, side, entity and period."""
    df = gradings.where("judged and score_t is not null").groupBy("family", "side", "entity", "period")
    return df.agg(F.round(1000 * F.sum("score_t") / F.count(F.lit(1))).cast("long").alias("x"))


def scales(population: DataFrame) -> DataFrame:
    """Number, mean and sample deviation for each (family, side) and each whole family ('*'); flat or single cells go."""
    df = population.groupingSets([["family", "side"], ["family"]], "family", "side")
    df = df.agg(F.grouping("side").alias("g"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")).where("n >= 2 and sd > 0")
    return df.select("family", F.when(F.col("g") == 1, "*").otherwise(F.col("side")).alias("side"), "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("sd")).alias("sd"))


def normalized(population: DataFrame, how: str = "inner") -> DataFrame:
    """Observations moved to their family's common scale from their side's own; with ``how`` left those without stay, z null."""
    s = scales(population)
    cell = s.where("side <> '*'").select("family", "side", F.col("mean").alias("c_mean"), F.col("sd").alias("c_sd"))
    grand = s.where("side = '*'").select("family", F.col("mean").alias("g_mean"), F.col("sd").alias("g_sd"))
    out = population.join(cell, ["family", "side"], how).join(grand, "family", how)  # a row for each family and side
    return out.select("family", "side", "entity", "period", "x", F.expr("cast(round(g_mean + g_sd * (x - c_mean) / c_sd) as bigint)").alias("z"))


def mixed_contracts(gradings: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose gradings follow more than one contract; a missing contract is a version of its own."""
    return gradings.groupBy(*keys).agg(F.count_distinct(F.coalesce("contract_id", F.lit("<none>"))).alias("contracts")).where("contracts > 1")


def band(x: Column) -> Column:
    """One of five closed bands of 0 to 100; null between and outside them."""
    out = F.lit(None).cast("string")
    for low, high, name in ((0, 19, "very low"), (20, 39, "low"), (40, 59, "middle"), (60, 79, "high"), (80, 100, "very high")):
        out = F.when(x.between(low, high), name).otherwise(out)
    return out


def band_disagreement(scores: DataFrame, keys: list[str], score: str, stated: str) -> DataFrame:
    """Mean of the graders and whether someone must look: derived bands differ, a stated one contradicts, or none fits."""
    df = scores.withColumn("_b", band(F.col(score)))
    differ = (F.count_distinct("_b") > 1) | F.bool_or(F.col("_b").isNull()) | F.bool_or(F.coalesce(F.col(stated) != F.col("_b"), F.lit(False)))
    return df.groupBy(*keys).agg(rounded(F.avg(score)).alias("mean"), F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) < 2, False).otherwise(differ).alias("needs_adjudication"))
