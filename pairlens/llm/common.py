"""What the operators share: the word rule, tables in the shared folder, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a folder of this machine only where a local session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pairlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediate tables of one operator, written once in the shared folder, so that a lost executor costs no replay.

    Tables that the returned DataFrame still reads stay until the application ends; the others go with ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/pairlens/{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session may have gone first
            pass

    def save(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._scratch)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE, -1)
    return F.filter(parts, lambda w: w != "")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Columns (a, b) long in, (node, component) out, where component is the smallest node reachable.

    Alternating large-star and small-star rounds over edge tables. Minima are aggregated before they are joined, and
    both sides of each join come from tables, so that a hub with very many edges is dealt out by the skew-join rule.
    Nodes without edges are not listed. Null ends and loops are ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.save(e)
    last = None
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large)
        low2 = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = scratch.save(small)
        now = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e, low, large, low2)
        e = nxt
        if now == last:
            break
        last = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


SPANS = "array<struct<s:int,e:int,m:string>>"


def match_spans(text: Column, regex: str, group: int = 0) -> Column:
    """All matches of a pattern that never matches the empty string: start, end (code points, exclusive) and text.

    Matches and the parts between them come from the same left-to-right search, so a start is the length of all parts
    and matches before it. Prefix sums go by blocks of the square root of their number, for texts with very many
    matches. With ``group``, the text is that of the group while start and end are those of the match.
    """

    def of(x: Column) -> Column:
        own = F.size(x["m"])
        size = lambda a: F.transform(a, lambda t: F.length(t))
        return let(
            F.struct(size(x["p"]).alias("p"), size(x["m"]).alias("m"), F.ceil(F.sqrt(own.cast("double"))).cast("int").alias("b")),
            lambda n: let(
                F.zip_with(F.slice(n["p"], 1, F.greatest(own, F.lit(0))), n["m"], lambda a, b: a + b),
                lambda w: let(
                    F.transform(F.sequence(F.lit(0), F.floor((own - 1) / n["b"]).cast("int")), lambda k: _sum(F.slice(w, k * n["b"] + 1, n["b"]))),
                    lambda sums: let(
                        F.transform(sums, lambda _, k: _sum(F.slice(sums, 1, k))),
                        lambda before: F.transform(
                            x["g"],
                            lambda t, i: let(
                                F.get(before, F.floor(i / n["b"]).cast("int")) + _sum(F.slice(w, F.floor(i / n["b"]).cast("int") * n["b"] + 1, F.pmod(i, n["b"]))) + F.get(n["p"], i),
                                lambda s: F.struct(s.alias("s"), (s + F.get(n["m"], i)).alias("e"), t.alias("m")),
                            ),
                        ),
                    ),
                ),
            ),
        )

    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    found = F.struct(F.split(text, regex, -1).alias("p"), whole.alias("m"), (whole if not group else F.regexp_extract_all(text, F.lit(regex), F.lit(group))).alias("g"))
    return F.when(text.rlike(regex), let(found, of)).otherwise(F.array().cast(SPANS))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def span_text(spans: Column) -> Column:
    """Spans (struct of k, s, e in order) as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")
