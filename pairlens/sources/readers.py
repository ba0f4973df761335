"""Readers with explicit schemas and named failures."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def json_artifact(spark: SparkSession, path: str, schema: str, producer: str) -> DataFrame:
    """A JSON table; where it is missing, the error names what makes it."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"{path} is missing; {producer} writes it") from e


def tab_separated(spark: SparkSession, path: str, schema: str, partitions: int) -> DataFrame:
    """Header and tabs, no quoting; compressed files cannot be split, so rows are dealt out after reading."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", escape="").repartition(partitions)


def verdict_files(raw: DataFrame, records: DataFrame) -> DataFrame:
    """(id, family, text, matched) of verdict texts (name, text) named id__family, with whether a record has the id.

    A name of another form gives a null id and matches nothing.
    """
    part = lambda g: F.nullif(F.regexp_extract("name", r"^(.+)__([^_.]+)(?:\.\w+)?$", g), F.lit(""))
    raw = raw.select(part(1).alias("id"), part(2).alias("family"), F.trim(F.regexp_replace("text", "\n", "")).alias("text"))
    return raw.join(records.select(F.col("id").cast("string").alias("id"), F.lit(True).alias("known")).distinct(), "id", "left").select("id", "family", "text", F.coalesce("known", F.lit(False)).alias("matched"))


def ranked_union(sources: list[DataFrame]) -> DataFrame:
    """Union with the source's position; columns that a source lacks are null."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_rank", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def later_wins(sources: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, from the last source that has it."""
    w = Window.partitionBy(*keys).orderBy(F.desc("source_rank"), *order)
    return ranked_union(sources).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def truncated_batches(rows: DataFrame, batch: str, limit: int) -> DataFrame:
    """Batches that reached their limit and so may be cut off."""
    return rows.groupBy(batch).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= limit)


#: What the summaries of a run count.
COUNTED = ("attempted", "succeeded", "failed", "cached", "excluded")
_MANIFEST = f"stage_name string, summaries array<struct<{', '.join(f'{c}:bigint' for c in COUNTED)},error_taxonomy:map<string,bigint>>>"


def manifests(files: DataFrame) -> DataFrame:
    """What each stage cost over all its runs: (stage, runs, the sums of COUNTED, errors).

    ``files``: name and text of each manifest, a JSON object with stage_name and summaries. One that is no whole object
    is not counted; without stage_name the stage is the file's name. Runs of a stage add up, and so do its error maps.
    """
    df = files.select("name", F.from_json("text", _MANIFEST, {"mode": "PERMISSIVE"}).alias("m"), F.try_parse_json("text").alias("v")).where("v is not null")
    df = df.select(F.coalesce("m.stage_name", "name").alias("stage"), F.col("m.summaries").alias("s"))
    one = lambda c: F.aggregate(F.coalesce("s", F.expr("array()")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[c], F.lit(0)))
    sums = df.select("stage", *[one(c).alias(c) for c in COUNTED]).groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), *[F.sum(c).alias(c) for c in COUNTED])
    kinds = df.select("stage", F.explode("s").alias("x")).select("stage", F.explode("x.error_taxonomy").alias("kind", "n")).groupBy("stage", "kind").agg(F.sum("n").alias("n"))
    errors = kinds.groupBy("stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("errors"))
    return sums.join(errors, "stage", "left").withColumn("errors", F.coalesce("errors", F.expr("cast(map() as map<string,bigint>)")))
