"""Small worked cases of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pairlens.functions import dates as D
from pairlens.functions import text as X
from pairlens.operators import gradings as G
from pairlens.operators import pairings as P
from pairlens.operators import quality as Q
from pairlens.operators import sampling as S
from pairlens.operators import temporal as T
from pairlens.plans.texts import holders
from pairlens.sources import readers as R
from pairlens.sources import writers as W


def day(s):
    return dt.date.fromisoformat(s)


def test_gap_of_unequal_years_is_exact(spark):
    rows = [("e", 2016, 366, 731, 8000, 9000), ("e", 2017, 365, 731, 8400, 8800), ("p", 2016, 1, 2, 8000, 9000), ("p", 2017, 1, 2, 8000, None), ("z", 2016, 1, 1, None, None)]
    df = spark.createDataFrame(rows, "pairing_id string, period int, days int, total_days int, a_h int, b_h int")
    got = {r.pairing_id: r for r in P.gap_measures(df).collect()}
    assert got["e"].num == 512000 and got["e"].gap == round(512000 / 731, 6) and got["e"].gap_years == round(512000 / 365.25, 6)
    assert got["p"].covered_share == 0.5 and got["p"].gap == 1000
    assert got["z"].gap is None and got["z"].covered_share == 0
    swapped = df.selectExpr("pairing_id", "period", "days", "total_days", "b_h as a_h", "a_h as b_h")
    assert all(r.num is None or r.num == -got[r.pairing_id].num for r in P.gap_measures(swapped).collect())
    assert sorted(map(str, P.gap_measures(df.repartition(7)).collect())) == sorted(map(str, P.gap_measures(df.coalesce(1)).collect()))


def test_refusals_are_not_zero(spark):
    rows = [("E1", 2006, "f1", "m1", 99, True, False, "c"), ("E1", 2006, "f1", "m2", 100, True, True, "c"), ("E1", 2006, "f2", "m3", 98, True, False, "c"), ("E1", 2006, "f3", "m3", 95, True, False, "c"), ("E1", 2006, "f4", "m4", None, False, False, "c"), ("E2", 2006, "f1", "m1", None, False, False, "c")]
    df = spark.createDataFrame(rows, "entity string, period int, family string, grader string, score_t int, judged boolean, evidence_used boolean, contract_id string")
    (r,) = G.canonical_scores(df, ["entity", "period"]).collect()
    assert (r.entity, r.sum_t, r.n, r.spread_t, r.graders) == ("E1", 392, 4, 5, "m1,m2,m3")


def test_normalisation_levels_the_sides(spark):
    rows = [("f", s, f"{s}{i}", i, x) for s, v in (("a", (7600, 8000, 8400, 8800, 9200, 9600)), ("b", (8800, 9000, 9100, 9200, 9300, 9500))) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "family string, side string, entity string, period int, x long")
    out = G.normalized(df).groupBy("side").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s")).collect()
    assert abs(out[0].m - out[1].m) < 1 and abs(out[0].s - out[1].s) < 1
    flat = spark.createDataFrame([("f", "a", "x", 1, 5), ("f", "a", "y", 1, 5)], df.schema)
    assert G.scales(flat).count() == 0


def test_nearest_period_prefers_exact_then_earlier(spark):
    want = spark.createDataFrame([("x", 2000), ("y", 2000), ("z", 2000)], "entity string, period int")
    have = spark.createDataFrame([("x", 2000, 1), ("x", 1999, 2), ("y", 1999, 3), ("y", 2001, 4), ("z", 1998, 5)], "entity string, period int, v int")
    assert {r.entity: (r.src, r.v) for r in T.nearest_period(want, have, 1, ["v"]).collect()} == {"x": (2000, 1), "y": (1999, 3), "z": (None, None)}
    assert {r.entity: r.distance for r in T.nearest_distance(want, have).collect()} == {"x": 0, "y": 1, "z": 2}
    tight = T.nearest_period(want, have, 0, ["v"]).where("src is not null").count()
    assert tight <= T.nearest_period(want, have, 1, ["v"]).where("src is not null").count()


def test_islands_join_stages_that_meet(spark):
    rows = [(1, day("1998-01-01"), day("2000-07-29")), (1, day("2000-07-29"), day("2005-10-02")), (2, day("2002-01-01"), day("2004-01-01")), (2, day("2022-01-01"), day("2024-01-01"))]
    df = T.islands(spark.createDataFrame(rows, "k int, start_d date, end_d date"), "k", ["start_d", "end_d"], 1)
    assert {r.k: r.n for r in df.groupBy("k").agg(F.max("island").alias("n")).collect()} == {1: 1, 2: 2}


def test_year_days_sum_to_the_interval(spark):
    df = spark.createDataFrame([(day("2015-12-31"), day("2018-01-01"))], "s date, e date")
    got = {r.period: (r.days, r.total_days) for r in T.year_days(df, "s", "e").collect()}
    assert got == {2015: (1, 733), 2016: (366, 733), 2017: (365, 733), 2018: (1, 733)}


@pytest.mark.parametrize("born, adult", [("1992-02-29", "2010-03-01"), ("1987-12-31", "2005-12-31"), ("1992-02-28", "2010-02-28")])
def test_adult_from(spark, born, adult):
    assert str(spark.range(1).select(D.adult_from(F.lit(born).cast("date")).alias("x")).first().x) == adult


def test_dates(spark):
    v = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [v(D.truncated(F.lit("+1984-05-06T00:00:00Z"), F.lit(c))) for c in (8, 9, 10, 11)] == [None, "1984", "1984-05", "1984-05-06"]
    assert v(D.is_valid(F.lit("2015-02-29"), F.lit("day"))) is False and v(D.is_valid(F.lit("2016-02"), F.lit("month"))) is True
    assert v(D.plain_date(F.lit("| {{dts|1993|10|9}}"))) == "1993-10-09" and v(D.plain_date(F.lit("November 13, 2024"))) == "2024-11-13" and v(D.plain_date(F.lit("x"))) is None


def test_text(spark):
    v = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert v(X.normal_title(F.lit("Film É & B. (Director's Cut)"))) == "film e b"
    assert v(X.normal_title(F.lit("Director's Cut"))) == "director s cut"
    assert v(X.redacted(F.lit("Ann Stone and stone; Ann"), F.lit("Ann Stone"))) == "[SUBJECT] and [SUBJECT]; Ann"
    assert [v(X.ordinal(F.lit(n))) for n in (1, 2, 3, 4, 11, 12, 13, 21, 112)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]
    assert v(X.asserted(F.lit("He was never a winner."), "winner")) is False and v(X.asserted(F.lit("A winner, not a loser."), "winner")) is True
    assert v(X.stripped_markup(F.lit("<b>[[A|b]]</b>{{x}} [[c]]"))) == "b c"


def test_booleans_are_no_numbers(spark):
    df = spark.createDataFrame([('x {"g": true} y',), ('{"g": 4.5}',), ("none",), ("{bad",), ('{"g": "7"}',)], "t string")
    o = Q.first_object(F.col("t"))
    assert [r.n for r in df.select(Q.number(o, "$.g").alias("n")).collect()] == [None, 4.5, None, None, None]
    reasons = Q.with_reason(spark.createDataFrame([(1, None), (5, 2), (None, 9)], "a int, b int"), [("small", "a < 2"), ("large", "b > 5")])
    assert [r.reason for r in reasons.collect()] == ["small", None, "large"]


def test_merge_twice_adds_nothing(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "id string, v int")
    once = P.merged([a], [F.col("id")], ["v"]).where("kept").select("id", "v")
    twice = P.merged([once, a.where("id is not null")], [F.col("id")], ["v"]).where("kept").select("id", "v")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_guarded_sink_keeps_the_richer_table(spark, tmp_path, monkeypatch):
    root, df = f"file://{tmp_path}/t", spark.range(10)
    with pytest.raises(FileNotFoundError):
        W.read_current(spark, root)
    assert W.guarded(df, root, "count(1)") and not W.guarded(df.limit(5), root, "count(1)") and W.read_current(spark, root).count() == 10
    assert len(list((tmp_path / "t").glob("v-*"))) == 1
    assert W.guarded(df.limit(5), root, "count(1)", force=True) and W.read_current(spark, root).count() == 5
    assert W.guarded(df.limit(3), root, "count(no_such_column)") and W.read_current(spark, root).count() == 3

    def fails(*_):
        raise OSError("the second step")

    monkeypatch.setattr(W, "_switch", fails)
    with pytest.raises(OSError):
        W.guarded(df, root, "count(1)")
    assert W.read_current(spark, root).count() == 3
    monkeypatch.undo()
    assert W.guarded(df, root, "count(1)") and W.read_current(spark, root).count() == 10


def test_manifests_add_up(spark):
    rows = [
        ("a", '{"stage_name": "s", "summaries": [{"attempted": 5, "failed": 2, "error_taxonomy": {"x": 1, "y": 1}}, {"attempted": 1, "cached": 1}]}'), ("b", '{"stage_name": "s", "summaries": [{"attempted": 2, "failed": 1, "error_taxonomy": {"x": 1}}]}'),
        ("c", '{"stage_name": "s", "summaries": [{"attem'), ("d", '{"summaries": []}'), ("e", "{}"), ("f", None),
    ]
    got = {r.stage: (r.runs, r.attempted, r.failed, r.cached, r.errors) for r in R.manifests(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert got == {"s": (2, 8, 3, 1, {"x": 2, "y": 1}), "d": (1, 0, 0, 0, {}), "e": (1, 0, 0, 0, {})}


def test_verdict_files(spark):
    raw = spark.createDataFrame([("7__f.txt", "a\n"), ("x__y__g", "b"), ("8__f", " c "), ("none", "d")], "name string, text string")
    got = R.verdict_files(raw, spark.createDataFrame([(7,), (7,)], "id long")).collect()
    assert sorted((r.id or "", r.family or "", r.text, r.matched) for r in got) == [("", "", "d", False), ("7", "f", "a", True), ("8", "f", "c", False), ("x__y", "g", "b", False)]


def test_quotes_of_any_length_are_found(spark):
    docs = [(1, "the cat sat on the mat"), (2, "a cathedral, the cat"), (3, None), (4, ""), (5, "one two three four five six seven eight nine ten eleven")]
    quotes = [(1, "cat"), (2, "the cat"), (3, "he cat sa"), (4, "e cat s"), (5, "wo three four five six seven eight nine ten el"), (6, ""), (7, "no such"), (8, "cat sat on the"), (9, "two three four five six seven eight nine ten")]
    got = holders(spark.createDataFrame(quotes, "item_id long, q string"), spark.createDataFrame(docs, "doc_id long, t string")).collect()
    assert {r.item_id: r.n for r in got} == {i: sum(q in t for _, t in docs if t is not None) for i, q in quotes}
