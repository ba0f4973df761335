"""Validators of payloads and answers: each gives the first rule that a row breaks, or null.

Fields are tested by the type they have in the JSON text: a boolean is no number, a number no text, and a field that is
there but null is told from one that is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_space, without_space
from .quality import first_object, kind, number, text

#: Words that verdicts may use.
WEIGHTS, CONFIDENCES = ("central", "secondary", "incidental"), ("high", "medium", "low")
#: How far two absolutes may differ from the gap they are given with.
TOLERANCE = 0.15


def _first(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule whose condition (of failure) holds; an unknown condition does not hold."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(rules):
        out = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(out)
    return out


def _there(o: Column, path: str) -> Column:
    return kind(o, path).isNotNull()


def _empty(o: Column, path: str) -> Column:
    """Missing, null, false, zero, or without content."""
    k, said = kind(o, path), F.try_variant_get(o, path, "string")
    return k.isNull() | (k == "VOID") | said.isNull() | said.isin("", "false", "[]", "{}") | F.coalesce(number(o, path) == 0, F.lit(False))


def _whole(o: Column, path: str) -> Column:
    """A whole number, or null for anything else."""
    return F.when(kind(o, path) == "BIGINT", F.try_variant_get(o, path, "long"))


def _odd_length(o: Column, least: Column) -> Column:
    k = kind(o, "$.list_length")
    return (k != "VOID") & (F.coalesce(_whole(o, "$.list_length") < least, F.lit(True)))


def evidence_reason(tag: Column, payload: Column, excerpt: Column, locator: Column) -> Column:
    """Why a piece of evidence is refused, by the rules of its tag.

    ``rank``: an order that is stated to be a ranking and why, a positive rank, and a list length of at least that (null:
    not stated). ``inclusion``: no rank; a length of 1 or more, or null. ``award``: a name, no rank. ``rating``: a number
    and its scale. ``ballot``: a share of 0 to 1 and what was on the ballot; no plurality without the outcome.
    ``commentary``: an excerpt, no numbers. Every tag: a place where to find it.
    """
    o = payload
    share = number(o, "$.vote_share")
    outcome = (F.coalesce(kind(o, "$.placement"), F.lit("VOID")) == "VOID") & ~F.coalesce((kind(o, "$.outcome_published") == "BOOLEAN") & F.try_variant_get(o, "$.outcome_published", "boolean"), F.lit(False))
    by_tag: dict[str, list[tuple[str, Column]]] = {
        "rank": [
            ("order is no ranking", _empty(o, "$.order_is_ranking")), ("no order basis", _empty(o, "$.order_basis")), ("rank is no positive whole number", F.coalesce(_whole(o, "$.rank") < 1, F.lit(True))),
            ("no list length", ~_there(o, "$.list_length")), ("list shorter than rank", _odd_length(o, _whole(o, "$.rank"))),
        ],
        "inclusion": [("rank where none is stated", _there(o, "$.rank")), ("no list length", ~_there(o, "$.list_length")), ("length is no size", _odd_length(o, F.lit(1)))],
        "award": [("no award name", _empty(o, "$.award_name")), ("an award is no rank", _there(o, "$.rank"))],
        "rating": [("rating and scale are needed", ~_there(o, "$.rating_value") | _empty(o, "$.rating_scale")), ("rating is no number", number(o, "$.rating_value").isNull())],
        "ballot": [
            ("share is not in 0 to 1", F.coalesce(~share.between(0, 1), F.lit(True))), ("no ballot description", _empty(o, "$.ballot_description")),
            ("plurality without outcome", outcome & _there(o, "$.is_plurality")),
        ],
        "commentary": [("no excerpt", F.coalesce(without_space(excerpt) == "", F.lit(True))), *[(f"commentary with {n}", _there(o, f"$.{n}")) for n in ("rank", "rating_value", "vote_share")]],
    }
    rules = F.lit(None).cast("string")
    for name, of in by_tag.items():
        rules = F.when(tag == name, _first(of)).otherwise(rules)
    unknown = F.coalesce(~tag.isin(*by_tag), F.lit(True))
    return F.when(unknown, "unknown tag").when(F.coalesce(~F.startswith(kind(o, "$"), F.lit("OBJECT")), F.lit(True)), "no payload").otherwise(F.coalesce(rules, F.when(F.coalesce(locator, F.lit("")) == "", "no locator")))


def pairing_reason(answer: Column, pairing_id: Column, version: str) -> Column:
    """Why a grader's answer on a pairing is refused: version, id, types, ranges, and that it judges or says why not.

    Two absolutes, where given, must agree with the gap within ``TOLERANCE``.
    """
    o = first_object(answer)
    n = {c: number(o, f"$.{c}") for c in ("gap", "f_absolute", "m_absolute", "centrality")}
    given = {c: F.coalesce(kind(o, f"$.{c}"), F.lit("VOID")) != "VOID" for c in n}
    judged = F.when(kind(o, "$.judged") == "BOOLEAN", F.try_variant_get(o, "$.judged", "boolean"))
    said = F.coalesce(text(o, "$.pairing_id"), F.lit("")) != pairing_id
    return _first([
        ("no object", o.isNull()), ("wrong version", F.coalesce(text(o, "$.schema_version"), F.lit("")) != version), ("wrong pairing", F.coalesce(said, F.lit(True))), ("judged is no boolean", judged.isNull()),
        ("no reasoning", F.coalesce(without_space(text(o, "$.reasoning")), F.lit("")) == ""), *[(f"{c} is no number", given[c] & v.isNull()) for c, v in n.items()],
        ("a gap without judgment", ~judged & given["gap"]), ("no reason for not judging", ~judged & _empty(o, "$.cannot_judge_reason")), ("judged without gap", judged & ~given["gap"]),
        ("gap out of range", judged & ~n["gap"].between(-10, 10)), *[(f"{c} out of range", judged & ~n[c].between(0, 10)) for c in ("f_absolute", "m_absolute")], ("centrality out of range", judged & ~n["centrality"].between(0, 1)),
        ("absolutes contradict the gap", judged & (F.abs(n["f_absolute"] - n["m_absolute"] - n["gap"]) > TOLERANCE)),
    ])


def standing_reason(answer: Column, dossier: Column, version: str) -> Column:
    """Why a grader's answer on a dossier (an array of observation ids) is refused."""
    o = first_object(answer)
    scored = F.when(kind(o, "$.scored") == "BOOLEAN", F.try_variant_get(o, "$.scored", "boolean"))
    cited = F.coalesce(F.try_variant_get(o, "$.evidence_ids", "array<string>"), F.array().cast("array<string>"))
    why = F.coalesce(text(o, "$.rationale"), F.lit(""))
    return _first([
        ("no object", o.isNull()), ("wrong version", F.coalesce(text(o, "$.schema_version"), F.lit("")) != version), ("scored is no boolean", scored.isNull()),
        ("estimate is no whole number from 0 to 100", scored & F.coalesce(~_whole(o, "$.estimate").between(0, 100), F.lit(True))),
        ("cites what is not in the dossier", scored & (F.size(F.array_except(cited, F.coalesce(dossier, F.array().cast("array<string>")))) > 0)), ("cites nothing", scored & (F.size(cited) == 0)),
        ("rationale names nothing it cites", scored & ~F.exists(cited, lambda c: F.contains(why, c))),
        ("unscored with an estimate", ~scored & (F.coalesce(kind(o, "$.estimate"), F.lit("VOID")) != "VOID")), ("unscored without reason", ~scored & _empty(o, "$.missingness_reason")),
    ])


def couples_reasons(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, pairs, reason): an answer that lists pairs is refused whole if one of them is; null if all are good.

    Of several faults that of the first pair counts. Each element keeps its own types, so nothing is read by default.
    """
    o = first_object(F.col(answer))
    listed = F.when(F.startswith(kind(o, "$.pairs"), F.lit("ARRAY")), F.try_variant_get(o, "$.pairs", "array<variant>"))
    df = answers.select(F.col(key), o.alias("o"), listed.alias("p"))
    x = F.col("x")
    lower = lambda f: F.lower(without_space(F.try_variant_get(x, f"$.{f}", "string")))
    rules = [
        ("no object", F.coalesce(~F.startswith(kind(x, "$"), F.lit("OBJECT")), F.lit(True))), *[(f"no {f}", ~_there(x, f"$.{f}")) for f in ("a", "b", "weight", "in_billed_list", "confidence")],
        *[(f"{f} is none of the words", F.coalesce(~text(x, f"$.{f}").isin(*of), F.lit(True))) for f, of in (("weight", WEIGHTS), ("confidence", CONFIDENCES))], ("in_billed_list is no boolean", kind(x, "$.in_billed_list") != "BOOLEAN"),
        ("an empty name", (F.coalesce(lower("a"), F.lit("none")) == "") | (F.coalesce(lower("b"), F.lit("none")) == "")), ("paired with itself", F.coalesce(lower("a"), F.lit("none")) == F.coalesce(lower("b"), F.lit("none"))),
    ]
    each = df.select(key, F.posexplode(F.coalesce("p", F.array().cast("array<variant>"))).alias("i", "x")).select(key, "i", _first(rules).alias("r"))
    bad = each.groupBy(key).agg(F.count(F.lit(1)).alias("pairs"), F.min_by("r", F.when(F.col("r").isNotNull(), F.col("i"))).alias("r"))
    whole = _first([("no object", F.col("o").isNull()), ("no pairs", ~_there(F.col("o"), "$.pairs")), ("pairs are no list", F.col("p").isNull())])
    return df.select(key, whole.alias("whole")).join(bad, key, "left").select(key, F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs"), F.coalesce("whole", "r").alias("reason"))


def estimate_reason(estimate: Column, cited: Column, missing: Column, rationale: Column, periods: Column) -> Column:
    """Why a standing estimate is refused: unscored needs a reason and cites nothing, scored needs all the rest."""
    none, some = estimate.isNull(), estimate.isNotNull()
    return _first([
        ("unscored without reason", none & (F.coalesce(missing, F.lit("")) == "")), ("unscored but cites", none & (F.coalesce(F.size(cited), F.lit(0)) > 0)), ("out of range", some & ~estimate.between(0, 100)),
        ("cites nothing", some & (F.coalesce(F.size(cited), F.lit(0)) <= 0)), ("scored but flagged missing", some & missing.isNotNull()), ("no rationale", some & (F.coalesce(without_space(rationale), F.lit("")) == "")),
        ("no periods", F.coalesce(F.size(periods), F.lit(0)) <= 0), ("a period twice", F.size(F.array_distinct(periods)) < F.size(periods)),
    ])


def with_grader(gradings: DataFrame, models: DataFrame) -> DataFrame:
    """Adds ``model``, recovered from the family (table ``models``: family, known) where it is missing, and ``reason``.

    A grading without entity, period or family, or whose model nothing names, is refused; an unknown time stays unknown.
    """
    df = gradings.join(F.broadcast(models), "family", "left").withColumn("model", F.coalesce(F.nullif("model", F.lit("")), "known")).drop("known")
    missing = [(f"no {c}", F.col(c).isNull()) for c in ("entity", "period", "family")]
    return df.withColumn("reason", _first([*missing, ("no model for the family", F.col("model").isNull())]))


def qualifying(answers: DataFrame, quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, class): what a classification is worth once its quote was looked up.

    ``answers``: id, said. ``quotes``: id, q; ``sources``: id, t, the text each quote should stand in. Qualifying answers
    keep their class only if the quote stands verbatim in the own text, white space and case aside; else they are
    ungrounded. Other answers keep what they said.
    """
    own = quotes.join(sources, "id", "left").groupBy("id").agg(F.bool_or((normal_space(F.col("q")) != "") & F.contains(normal_space(F.col("t")), normal_space(F.col("q")))).alias("ok"))
    df = answers.select("id", "said").join(own, "id", "left")
    return df.select("id", F.when(F.col("said") != "QUALIFYING", F.col("said")).when(F.col("ok"), F.col("said")).otherwise("UNGROUNDED").alias("class"))
