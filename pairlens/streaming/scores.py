"""Scores that follow a growing cache of gradings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_scores(gradings: DataFrame, keys: list[str]) -> DataFrame:
    """Sum, number, least and greatest score of each key: parts that merge, whatever order gradings arrive in."""
    df = gradings.where("judged and score_t is not null")
    return df.groupBy(*keys).agg(F.sum("score_t").alias("sum_t"), F.count(F.lit(1)).alias("n"), F.min("score_t").alias("low"), F.max("score_t").alias("high"))


def follow(stream: DataFrame, id_col: str, time_col: str, keys: list[str], late: str, path: str, checkpoint: str):
    """Starts the query: repeated gradings within ``late`` count once; every batch's changed keys are written to path.

    A batch that runs again replaces its own folder, so readers see each change once. Gradings without time are left
    out of the stream; unknown is not now.
    """
    fresh = stream.where(F.col(time_col).isNotNull()).withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])

    def publish(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}")

    out = running_scores(fresh, keys).writeStream.outputMode("update").foreachBatch(publish)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(published: DataFrame, keys: list[str]) -> DataFrame:
    """The last published state of each key."""
    return published.groupBy(*keys).agg(F.max(F.struct("batch", "sum_t", "n", "low", "high")).alias("m")).select(*keys, "m.sum_t", "m.n", "m.low", "m.high")
