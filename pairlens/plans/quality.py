"""Validators as data-quality jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import quality as Q
from ..sources import readers as R
from ..sources import writers as W
from . import demo
from .registry import query


def _verdicts(spark, sf):
    """Grader answers as free text with a JSON object inside, some of them wrong in one way."""
    e = demo.table(spark, sf, "events").withColumn("v", F.round("value").cast("int")).withColumn("m", (F.col("event_id") % 11).cast("int"))
    gap = F.expr("case when m = 1 then 'true' when m = 2 then '\"high\"' else cast(v as string) end")
    body = F.concat(
        F.lit('Sure. {"version": "'), F.when(F.col("m") == 3, "v0").otherwise("v1"), F.lit('", "id": '), F.when(F.col("m") == 4, F.col("event_id") + 1).otherwise(F.col("event_id")).cast("string"),
        F.lit(', "judged": '), F.when(F.col("m") == 5, '"yes"').when(F.col("m") == 6, "false").otherwise("true"), F.lit(', "gap": '), gap, F.lit(', "reasoning": "'), F.when(F.col("m") == 7, "").otherwise(F.col("event_type")), F.lit('"} Done.'),
    )
    return e.select("event_id", "user_id", "m", "v", F.when(F.col("m") == 8, "no object").when(F.col("m") == 9, "{broken").otherwise(body).alias("text"))


def _parsed(spark, sf):
    df = _verdicts(spark, sf).withColumn("o", Q.first_object(F.col("text")))
    return df.select("event_id", "user_id", "m", F.col("o").isNotNull().alias("found"), Q.text(F.col("o"), "$.version").alias("version"), Q.number(F.col("o"), "$.id").alias("id"), Q.kind(F.col("o"), "$.judged").alias("judged_type"),
                     F.try_variant_get("o", "$.judged", "boolean").alias("judged"), Q.kind(F.col("o"), "$.gap").alias("gap_type"), Q.number(F.col("o"), "$.gap").alias("gap"), Q.text(F.col("o"), "$.reasoning").alias("reasoning"))


_RULES = [
    ("no object", "not found"), ("wrong version", "coalesce(version, '') <> 'v1'"), ("wrong id", "id is null or id <> event_id"), ("judged is no boolean", "judged_type is null or judged_type <> 'BOOLEAN'"),
    ("gap is no number", "judged and gap is null"), ("gap out of range", "judged and (gap < 0 or gap > 100)"), ("no reasoning", "coalesce(reasoning, '') = ''"),
]
_CASE = """CASE m WHEN 8 THEN 'no object' WHEN 9 THEN 'no object' WHEN 3 THEN 'wrong version' WHEN 4 THEN 'wrong id' WHEN 5 THEN 'judged is no boolean' WHEN 1 THEN 'gap is no number' WHEN 2 THEN 'gap is no number'
    WHEN 7 THEN CASE WHEN v > 100 OR v < 0 THEN 'gap out of range' ELSE 'no reasoning' END WHEN 6 THEN NULL ELSE CASE WHEN v > 100 OR v < 0 THEN 'gap out of range' END END"""
_SRC = "(SELECT event_id, user_id, round(value)::INT AS v, (event_id % 11)::INT AS m FROM events)"


@query(f"SELECT user_id, coalesce({_CASE}, 'kept') AS reason, count(*) AS n FROM {_SRC} GROUP BY ALL")
def dq_person_verdict(spark, sf):
    return Q.taxonomy(Q.with_reason(_parsed(spark, sf), _RULES), "user_id")


@query(f"SELECT coalesce({_CASE}, 'kept') AS reason, count(*) AS n FROM {_SRC} GROUP BY ALL")
def agg_taxonomy(spark, sf):
    return Q.taxonomy(Q.with_reason(_parsed(spark, sf), _RULES))


_NORM = r"trim(lower(regexp_replace({}, '[\t\n\x0b\f\r ]+', ' ', 'g')))"


@query(f"""SELECT item_id, CASE WHEN said NOT IN ('yes', 'no', 'unclear') THEN NULL WHEN said = 'yes' AND n = 0 THEN 'unclear' ELSE said END AS verdict, CASE WHEN said NOT IN ('yes', 'no', 'unclear') THEN 'refused' WHEN said = 'yes' AND n = 0 THEN 'downgraded' ELSE 'kept' END AS status
    FROM (SELECT item_id, ['yes', 'yes', 'no', 'unclear', 'perhaps'][(item_id % 5 + 1)::INT] AS said, count(CASE WHEN contains({_NORM.format("d.text")}, {_NORM.format("b.text")}) THEN 1 END) AS n FROM benchmark b, documents d GROUP BY item_id)""")
def dq_romance_verdict(spark, sf):
    """Verdicts of a fixed set of words with a quote each; others are refused, a yes whose quote stands nowhere is downgraded."""
    from .texts import grounded_counts

    said = F.get(F.array(*map(F.lit, ("yes", "yes", "no", "unclear", "perhaps"))), (F.col("item_id") % 5).cast("int"))
    df = grounded_counts(spark, sf).withColumn("said", said)
    status = F.expr("case when said not in ('yes', 'no', 'unclear') then 'refused' when said = 'yes' and grounded_in = 0 then 'downgraded' else 'kept' end")
    verdict = F.expr("case status when 'kept' then said when 'downgraded' then 'unclear' end")
    return df.withColumn("status", status).select("item_id", verdict.alias("verdict"), "status")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 END AS place FROM (SELECT doc_id, text, trim(string_split(text, chr(10))[-1]) || CASE WHEN doc_id % 3 = 0 THEN ' indeed' ELSE '' END AS quote FROM documents)
    WHERE quote <> '' AND contains({_NORM.format("text")}, {_NORM.format("quote")})""")
def dq_mention(spark, sf):
    """Mentions whose quote stands in their text; only ordered ones keep a place. Every third quote is altered."""
    quote = F.concat(F.trim(F.element_at(F.split("text", "\n", -1), -1)), F.when(F.col("doc_id") % 3 == 0, " indeed").otherwise(""))
    df = demo.table(spark, sf, "documents").withColumn("quote", quote)
    df = df.where((F.col("quote") != "") & F.contains(X.normal_space(F.col("text")), X.normal_space(F.col("quote"))))
    return df.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 7).alias("place"))


@query("SELECT s_suppkey, CASE WHEN s_name IS NULL OR s_name = '' THEN 'no description' WHEN s_acctbal < 0 THEN 'no route' END AS reason FROM supplier")
def dq_edition(spark, sf):
    return Q.with_reason(demo.table(spark, sf, "supplier"), [("no description", "coalesce(s_name, '') = ''"), ("no route", "s_acctbal < 0")]).select("s_suppkey", "reason")


@query("SELECT entity || '@' || period AS id, count(*) AS pairings FROM (SELECT a AS entity, period FROM pairings_screen UNION ALL SELECT b, period FROM pairings_screen) WHERE (entity, period) NOT IN (SELECT (entity, period) FROM gradings WHERE judged AND evidence_used) GROUP BY ALL")
def dq_spec_complete(spark, sf):
    """Estimates that pairings read but no grading with evidence says how far to move, with the pairings that read them."""
    p = demo.pairings_screen(spark, sf)
    need = p.select(F.explode(F.array("a", "b")).alias("entity"), "period").groupBy("entity", "period").agg(F.count(F.lit(1)).alias("pairings"))
    have = demo.gradings(spark, sf).where("judged and evidence_used").select("entity", "period").distinct()
    return need.join(have, ["entity", "period"], "left_anti").select(F.concat_ws("@", "entity", "period").alias("id"), "pairings")


@query("SELECT DISTINCT a AS entity FROM episodes_e WHERE a NOT IN (SELECT entity FROM sparse) AND (SELECT count(*) FROM sparse) > 0")
def dq_support_complete(spark, sf):
    support = demo.sparse(spark, sf)
    some = support.agg((F.count(F.lit(1)) > 0).alias("some"))
    return demo.episodes_e(spark, sf).selectExpr("a as entity").distinct().join(support, "entity", "left_anti").crossJoin(F.broadcast(some)).where("some").select("entity")  # one row


_STAGE = "(SELECT event_type AS stage, count(*) AS attempted, count(CASE WHEN value <= 50 THEN 1 END) AS succeeded, count(CASE WHEN value > 50 AND value <= 90 THEN 1 END) AS cached, count(CASE WHEN value > 90 AND event_id % 7 <> 0 THEN 1 END) AS failed FROM events GROUP BY event_type)"


def _stages(spark, sf):
    n = lambda e: F.count_if(F.expr(e))
    return demo.table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("attempted"), n("value <= 50").alias("succeeded"), n("value > 50 and value <= 90").alias("cached"), n("value > 90 and event_id % 7 <> 0").alias("failed"))


@query(f"SELECT stage, attempted - succeeded - cached - failed AS unaccounted FROM {_STAGE} WHERE attempted <> succeeded + cached + failed")
def dq_reconcile(spark, sf):
    return _stages(spark, sf).where("attempted <> succeeded + cached + failed").selectExpr("stage", "attempted - succeeded - cached - failed as unaccounted")


_RUNS = """(SELECT event_type AS type, day, count(*) AS attempted, count(*) FILTER (WHERE value <= 50) AS succeeded, count(*) FILTER (WHERE value > 50 AND value <= 90) AS cached, count(*) FILTER (WHERE value > 90) AS failed
    FROM (SELECT *, date_diff('day', DATE '2024-01-01', ts::DATE) AS day FROM events) GROUP BY ALL)"""


@query(f"""SELECT r.stage, runs, attempted, succeeded, failed, cached, excluded, coalesce(errors, '') AS errors FROM (
    SELECT CASE WHEN day % 10 = 8 THEN type || '-' || day ELSE type END AS stage, count(*) AS runs, sum(attempted)::BIGINT AS attempted, sum(succeeded)::BIGINT AS succeeded, sum(failed)::BIGINT AS failed, sum(cached)::BIGINT AS cached, 0::BIGINT AS excluded FROM {_RUNS} WHERE day % 10 <> 9 GROUP BY 1) r
    LEFT JOIN (SELECT stage, string_agg(kind || ':' || n, ',' ORDER BY kind) AS errors FROM (SELECT CASE WHEN day % 10 = 8 THEN event_type || '-' || day ELSE event_type END AS stage, 'kind ' || event_id % 3 AS kind, count(*) AS n
        FROM (SELECT *, date_diff('day', DATE '2024-01-01', ts::DATE) AS day FROM events) WHERE value > 90 AND day % 10 <> 9 GROUP BY ALL) GROUP BY stage) e ON e.stage = r.stage""")
def src_manifests(spark, sf):
    """One manifest for each type and day of events; some lack the stage, and those of every tenth day are cut off."""
    e = demo.table(spark, sf, "events").withColumn("day", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))).withColumn("failed", F.col("value") > 90)
    n = lambda x: F.count_if(F.expr(x))
    kinds = e.where("failed").groupBy("event_type", "day", F.concat(F.lit("kind "), F.col("event_id") % 3).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("event_type", "day").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("error_taxonomy"))
    runs = e.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("attempted"), n("value <= 50").alias("succeeded"), n("value > 50 and value <= 90").alias("cached"), n("failed").alias("failed")).join(kinds, ["event_type", "day"], "left")
    summary = F.struct("attempted", "succeeded", "cached", "failed", "error_taxonomy")
    text = F.to_json(F.struct(F.when(F.col("day") % 10 != 8, F.col("event_type")).alias("stage_name"), F.array(summary).alias("summaries")))
    path = W.shared_path(spark, "manifests")
    files = runs.withColumn("m", text).select(F.concat_ws("-", "event_type", "day").alias("name"), F.when(F.col("day") % 10 == 9, F.expr("left(m, cast(length(m) / 2 as int))")).otherwise(F.col("m")).alias("value"))
    files.repartition("name").write.partitionBy("name").text(path)
    raw = spark.read.option("basePath", path).text(path, wholetext=True).select("name", F.col("value").alias("text"))
    errors = F.array_join(F.transform(F.array_sort(F.map_entries("errors")), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return R.manifests(raw).select("stage", "runs", "attempted", "succeeded", "failed", "cached", "excluded", errors.alias("errors"))
