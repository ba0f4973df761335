"""Queries that put answers and payloads, some of them wrong in one way, before the validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validators as V
from . import demo
from .registry import query


def _case(rows: list[tuple]) -> str:
    """SQL for the reason of a row by its kind ``m``; a reason may be a condition on k: (reason, condition)."""
    whens = (f"WHEN {i} THEN " + ("NULL" if r is None else f"'{r}'" if isinstance(r, str) else f"CASE WHEN {r[1]} THEN '{r[0]}' END") for i, (*_, r) in enumerate(rows))
    return "CASE m " + " ".join(whens) + " END"


def _source(rows: list[tuple]) -> str:
    return f"(SELECT event_id, (event_id % {len(rows)})::INT AS m, json_extract_string(props, '$.k')::INT AS k FROM events)"


def _written(spark, sf, rows: list[tuple]):
    """Events with the texts of their kind; @ stands for the event's k, % for the same number in hundredths, # for its id."""
    e = demo.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("m", (F.col("event_id") % len(rows)).cast("int"))
    fill = lambda c: F.replace(F.replace(F.replace(c, F.lit("@"), F.col("k").cast("string")), F.lit("%"), F.concat(F.lit("0."), F.lpad(F.col("k").cast("string"), 2, "0"))), F.lit("#"), F.col("event_id").cast("string"))
    columns = [fill(F.get(F.array(*[F.lit(r[i]) for r in rows]), F.col("m"))).alias(f"t{i}") for i in range(len(rows[0]) - 1)]
    return e.select("event_id", "k", *columns)


#: Tag, payload, excerpt, locator, and the reason it is refused for.
EVIDENCE = [
    ("rank", '{"order_is_ranking": true, "order_basis": "so it says", "rank": @, "list_length": 50}', "x", "p", None), ("rank", '{"order_basis": "so", "rank": 1, "list_length": 50}', "x", "p", "order is no ranking"),
    ("rank", '{"order_is_ranking": true, "order_basis": "", "rank": 1, "list_length": 50}', "x", "p", "no order basis"), ("rank", '{"order_is_ranking": true, "order_basis": "so", "rank": true, "list_length": 50}', "x", "p", "rank is no positive whole number"),
    ("rank", '{"order_is_ranking": true, "order_basis": "so", "rank": @.5, "list_length": 500}', "x", "p", "rank is no positive whole number"), ("rank", '{"order_is_ranking": true, "order_basis": "so", "rank": "@", "list_length": 500}', "x", "p", "rank is no positive whole number"),
    ("rank", '{"order_is_ranking": true, "order_basis": "so", "rank": 1@}', "x", "p", "no list length"), ("rank", '{"order_is_ranking": true, "order_basis": "so", "rank": 1@, "list_length": null}', "x", "p", None),
    ("rank", '{"order_is_ranking": true, "order_basis": "so", "rank": 1, "list_length": true}', "x", "p", "list shorter than rank"), ("inclusion", '{"list_length": @}', "x", "p", ("length is no size", "k < 1")), ("inclusion", '{"rank": @, "list_length": 9}', "x", "p", "rank where none is stated"),
    ("inclusion", '{"size": @}', "x", "p", "no list length"), ("inclusion", '{"list_length": null}', "", "p", None), ("inclusion", '{"list_length": "@"}', "x", "p", "length is no size"), ("award", '{"award_name": "Best of @"}', "x", "p", None), ("award", '{"award_name": ""}', "x", "p", "no award name"),
    ("award", '{"award_name": "Best", "rank": @}', "x", "p", "an award is no rank"), ("rating", '{"rating_value": @, "rating_scale": "0-100"}', "x", "p", None), ("rating", '{"rating_value": @.5, "rating_scale": "0-100"}', "x", "p", None), ("rating", '{"rating_value": @}', "x", "p", "rating and scale are needed"),
    ("rating", '{"rating_value": "very high", "rating_scale": "0-10"}', "x", "p", "rating is no number"), ("rating", '{"rating_value": true, "rating_scale": "0-10"}', "x", "p", "rating is no number"), ("rating", '{"rating_value": null, "rating_scale": "0-10"}', "x", "p", "rating is no number"),
    ("ballot", '{"vote_share": %, "ballot_description": "all", "placement": 1, "is_plurality": true}', "x", "p", None), ("ballot", '{"vote_share": true, "ballot_description": "all"}', "x", "p", "share is not in 0 to 1"), ("ballot", '{"vote_share": @, "ballot_description": "all"}', "x", "p", ("share is not in 0 to 1", "k > 1")),
    ("ballot", '{"vote_share": %}', "x", "p", "no ballot description"), ("ballot", '{"vote_share": %, "ballot_description": "all", "placement": null, "is_plurality": false}', "x", "p", "plurality without outcome"),
    ("ballot", '{"vote_share": %, "ballot_description": "all", "outcome_published": true, "is_plurality": true}', "x", "p", None), ("ballot", '{"vote_share": %, "ballot_description": "all", "outcome_published": "yes", "is_plurality": true}', "x", "p", "plurality without outcome"),
    ("commentary", "{}", "said @", "p", None), ("commentary", "{}", " \n", "p", "no excerpt"), ("commentary", '{"rank": null}', "said", "p", "commentary with rank"), ("commentary", '{"vote_share": %}', "said", "p", "commentary with vote_share"),
    ("rumour", "{}", "x", "p", "unknown tag"), ("award", "{broken", "x", "p", "no payload"), ("award", "[1]", "x", "p", "no payload"), ("award", '{"award_name": "Best"}', "x", "", "no locator"),
]


@query(f"SELECT event_id, CASE WHEN m = 0 THEN CASE WHEN k < 1 THEN 'rank is no positive whole number' WHEN k > 50 THEN 'list shorter than rank' END ELSE {_case(EVIDENCE)} END AS reason FROM {_source(EVIDENCE)}")
def dq_evidence_union(spark, sf):
    df = _written(spark, sf, EVIDENCE)
    return df.select("event_id", V.evidence_reason(F.col("t0"), F.try_parse_json("t1"), F.col("t2"), F.col("t3")).alias("reason"))


_P = '"schema_version": "p1", "pairing_id": "e#"'
#: Answer, and the reason it is refused for.
PAIRINGS = [
    (f'So: {{{_P}, "judged": true, "reasoning": "r", "gap": 0.5, "f_absolute": 9.8, "m_absolute": 9.4, "centrality": %}} done', None), (f'```json\n{{{_P}, "judged": true, "reasoning": "r", "gap": -10}}\n```', None), ("nothing", "no object"), (f"{{{_P}, ", "no object"),
    (f'{{"schema_version": "p0", "pairing_id": "e#", "judged": true, "reasoning": "r", "gap": 1}}', "wrong version"), (f'{{"schema_version": "p1", "pairing_id": "e@x", "judged": true, "reasoning": "r", "gap": 1}}', "wrong pairing"), (f'{{"schema_version": "p1", "pairing_id": 7, "judged": true, "reasoning": "r", "gap": 1}}', "wrong pairing"),
    (f'{{{_P}, "judged": "true", "reasoning": "r", "gap": 1}}', "judged is no boolean"), (f'{{{_P}, "judged": 1, "reasoning": "r", "gap": 1}}', "judged is no boolean"), (f'{{{_P}, "judged": true, "reasoning": " ", "gap": 1}}', "no reasoning"), (f'{{{_P}, "judged": true, "reasoning": "r", "gap": true}}', "gap is no number"),
    (f'{{{_P}, "judged": true, "reasoning": "r", "gap": 1, "m_absolute": "9"}}', "m_absolute is no number"), (f'{{{_P}, "judged": false, "reasoning": "r", "centrality": false}}', "centrality is no number"), (f'{{{_P}, "judged": false, "reasoning": "r", "gap": 1, "cannot_judge_reason": "n"}}', "a gap without judgment"),
    (f'{{{_P}, "judged": false, "reasoning": "r", "gap": null}}', "no reason for not judging"), (f'{{{_P}, "judged": false, "reasoning": "r", "cannot_judge_reason": "never met", "f_absolute": 99}}', None), (f'{{{_P}, "judged": true, "reasoning": "r"}}', "judged without gap"), (f'{{{_P}, "judged": true, "reasoning": "r", "gap": null}}', "judged without gap"),
    (f'{{{_P}, "judged": true, "reasoning": "r", "gap": @}}', ("gap out of range", "k > 10")), (f'{{{_P}, "judged": true, "reasoning": "r", "gap": -11@}}', "gap out of range"), (f'{{{_P}, "judged": true, "reasoning": "r", "gap": 1, "f_absolute": 11@}}', "f_absolute out of range"),
    (f'{{{_P}, "judged": true, "reasoning": "r", "gap": 1, "m_absolute": -%1}}', "m_absolute out of range"), (f'{{{_P}, "judged": true, "reasoning": "r", "gap": 1, "centrality": @}}', ("centrality out of range", "k > 1")),
    (f'{{{_P}, "judged": true, "reasoning": "r", "gap": 0.4, "f_absolute": 9.0, "m_absolute": 9.4}}', "absolutes contradict the gap"), (f'{{{_P}, "judged": true, "reasoning": "r", "gap": 0, "f_absolute": %, "m_absolute": 0}}', ("absolutes contradict the gap", "k > 15")),
]


@query(f"SELECT event_id, {_case(PAIRINGS)} AS reason FROM {_source(PAIRINGS)}")
def dq_pairing_verdict(spark, sf):
    df = _written(spark, sf, PAIRINGS)
    return df.select("event_id", V.pairing_reason(F.col("t0"), F.concat(F.lit("e"), "event_id"), "p1").alias("reason"))


_S = '"schema_version": "s2"'
STANDINGS = [
    (f'Here {{{_S}, "scored": true, "estimate": @, "evidence_ids": ["o#"], "rationale": "as o# says"}}', None), ("{}", "wrong version"), ("no", "no object"), (f'{{{_S}, "scored": 1, "estimate": 5}}', "scored is no boolean"),
    (f'{{{_S}, "scored": true, "estimate": true, "evidence_ids": ["o#"], "rationale": "o#"}}', "estimate is no whole number from 0 to 100"), (f'{{{_S}, "scored": true, "estimate": @.5, "evidence_ids": ["o#"], "rationale": "o#"}}', "estimate is no whole number from 0 to 100"),
    (f'{{{_S}, "scored": true, "estimate": 10@, "evidence_ids": ["o#"], "rationale": "o#"}}', ("estimate is no whole number from 0 to 100", "k > 0")), (f'{{{_S}, "scored": true, "evidence_ids": ["o#"], "rationale": "o#"}}', "estimate is no whole number from 0 to 100"),
    (f'{{{_S}, "scored": true, "estimate": @, "evidence_ids": ["o#", "z"], "rationale": "o#"}}', "cites what is not in the dossier"), (f'{{{_S}, "scored": true, "estimate": @, "evidence_ids": [], "rationale": "o#"}}', "cites nothing"), (f'{{{_S}, "scored": true, "estimate": @, "rationale": "o#"}}', "cites nothing"),
    (f'{{{_S}, "scored": true, "estimate": @, "evidence_ids": ["q#", "o#"], "rationale": "by both"}}', "rationale names nothing it cites"), (f'{{{_S}, "scored": true, "estimate": @, "evidence_ids": ["q#", "o#"], "rationale": "by q#"}}', None), (f'{{{_S}, "scored": false, "estimate": @}}', "unscored with an estimate"),
    (f'{{{_S}, "scored": false, "estimate": null}}', "unscored without reason"), (f'{{{_S}, "scored": false, "missingness_reason": "no evidence", "evidence_ids": ["z"]}}', None),
]


@query(f"SELECT event_id, {_case(STANDINGS)} AS reason FROM {_source(STANDINGS)}")
def dq_standing_verdict(spark, sf):
    df = _written(spark, sf, STANDINGS)
    dossier = F.array(F.concat(F.lit("o"), "event_id"), F.concat(F.lit("q"), "event_id"))
    return df.select("event_id", V.standing_reason(F.col("t0"), dossier, "s2").alias("reason"))


_C = '{"a": "Ann @", "b": "Bob", "weight": "central", "in_billed_list": true, "confidence": "high"}'
#: Answer, pairs in it, and the reason it is refused for.
COUPLES = [
    (f'Pairs: {{"pairs": [{_C}, {_C}], "note": ""}}.', "2", None), ('{"pairs": []}', "0", None), ("none", "0", "no object"), ('{"pair": []}', "0", "no pairs"), ('{"pairs": {"a": 1}}', "0", "pairs are no list"), (f'{{"pairs": [{_C}, "x@"]}}', "2", "no object"),
    *[(f'{{"pairs": [{_C}, {_C.replace(chr(34) + f + chr(34), chr(34) + f + "x" + chr(34))}]}}', "2", f"no {f}") for f in ("a", "b", "weight", "in_billed_list", "confidence")],
    (f'{{"pairs": [{_C.replace("central", "vital")}, {_C.replace("high", "sure")}]}}', "2", "weight is none of the words"), (f'{{"pairs": [{_C}, {_C.replace("high", "sure")}]}}', "2", "confidence is none of the words"), (f'{{"pairs": [{_C.replace("true", "1")}]}}', "1", "in_billed_list is no boolean"),
    (f'{{"pairs": [{_C.replace("Bob", " ")}]}}', "1", "an empty name"), (f'{{"pairs": [{_C.replace("Bob", " ANN @ ")}]}}', "1", "paired with itself"),
]


@query(f"SELECT event_id, [{', '.join(r[1] for r in COUPLES)}][m + 1]::BIGINT AS pairs, {_case(COUPLES)} AS reason FROM {_source(COUPLES)}")
def dq_couples_verdict(spark, sf):
    return V.couples_reasons(_written(spark, sf, COUPLES), "event_id", "t0")


@query("""SELECT entity, period, CASE WHEN v = 0 THEN 'unscored without reason' WHEN v = 1 THEN 'unscored but cites' WHEN v = 2 THEN NULL WHEN estimate + CASE WHEN v = 3 THEN 60 ELSE 0 END NOT BETWEEN 0 AND 100 THEN 'out of range' WHEN v = 4 THEN 'cites nothing' WHEN v = 5 THEN 'scored but flagged missing'
    WHEN v = 6 THEN 'no rationale' WHEN v = 7 THEN 'no periods' WHEN v = 8 THEN 'a period twice' END AS reason FROM (SELECT *, (entity + period) % 11 AS v FROM estimates)""")
def dq_estimate(spark, sf):
    """Estimates as they are, and of nine kinds that lack something or say too much."""
    e, v = demo.estimates(spark, sf), F.expr("(entity + period) % 11")
    estimate = F.when(v > 2, F.col("estimate") + F.when(v == 3, 60).otherwise(0))
    none = F.array().cast("array<string>")
    cited = F.when(v.isin(0, 2, 4), none).otherwise(F.array(F.concat_ws("@", "entity", "period")))
    missing = F.when(v.isin(1, 2, 5), "no evidence")
    periods = F.when(v == 7, none).when(v == 8, F.array(F.col("period").cast("string"), F.col("period").cast("string"))).otherwise(F.array(F.col("period").cast("string"), F.lit("x")))
    return e.select("entity", "period", V.estimate_reason(estimate, cited, missing, F.when(v == 6, " ").otherwise(F.col("shape")), periods).alias("reason"))


@query("""SELECT coalesce(model, '-') AS model, coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN period % 5 = 0 THEN CASE family WHEN 'A' THEN 'model a' WHEN 'N' THEN 'model n' END ELSE grader END AS model,
    CASE WHEN period % 7 = 0 THEN 'no entity' WHEN period % 5 = 0 AND family = 'R' THEN 'no model for the family' END AS reason FROM gradings) GROUP BY ALL""")
def dq_grading(spark, sf):
    """Gradings of every fifth year do not name their model; it is recovered from the family where one is known."""
    g = demo.gradings(spark, sf)
    g = g.select(F.when(F.col("period") % 7 != 0, F.col("entity")).alias("entity"), "period", "family", F.when(F.col("period") % 5 != 0, F.col("grader")).alias("model"))
    models = spark.createDataFrame([("A", "model a"), ("N", "model n")], "family string, known string")
    return V.with_grader(g, models).groupBy(F.coalesce("model", F.lit("-")).alias("model"), F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_WS = r"'[\t\n\x0b\f\r ]+', ' ', 'g'"


@query(f"""SELECT doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN 'OTHER' WHEN q <> '' AND contains(trim(lower(regexp_replace(text, {_WS}))), trim(lower(regexp_replace(q, {_WS})))) THEN 'QUALIFYING' ELSE 'UNGROUNDED' END AS class
    FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN upper(trim(string_split(text, chr(10))[-1])) || ' ever' ELSE trim(string_split(text, chr(10))[1]) END AS q FROM documents)""")
def flt_qualifying(spark, sf):
    """Documents classified with a quote: their first line, or an altered last one; every fourth says something else."""
    d = demo.table(spark, sf, "documents")
    lines = F.split("text", "\n", -1)
    q = F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper(F.trim(F.element_at(lines, -1))), F.lit(" ever"))).otherwise(F.trim(lines[0]))
    said = F.when(F.col("doc_id") % 4 == 1, "OTHER").otherwise("QUALIFYING")
    d = d.withColumn("id", F.col("doc_id"))
    return V.qualifying(d.select("id", said.alias("said")), d.select("id", q.alias("q")), d.select("id", F.col("text").alias("t")))
