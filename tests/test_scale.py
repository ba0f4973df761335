"""Tables are dealt in parts whose number grows with them, and rows are not multiplied before they are grouped."""

import re

from pyspark.sql import functions as F

from pairlens import plans
from pairlens.operators import pairings as P
from pairlens.operators import sampling as S
from pairlens.plans import demo, registry

plans.load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_grow_with_the_table(spark, sf, monkeypatch):
    for rows in (500, 100):
        monkeypatch.setattr(demo, "PART_ROWS", rows)
        lines = demo.n_lines(spark, sf)
        n = -(-lines // rows)
        assert f", {n})" in plan(demo.order_lines(spark, sf))
        for name in ("dq_episode_defects", "tj_cast_lines", "tj_award_table", "jn_cooccur"):
            assert f", {n})" in plan(registry.QUERIES[name](spark, sf)), name


def test_no_rows_are_multiplied(spark, sf):
    assert "Expand" not in plan(registry.QUERIES["jn_cooccur"](spark, sf))
    assert "Expand" not in plan(registry.QUERIES["agg_pairing_counts"](spark, sf))
    assert "Generate" not in plan(P.offset_ladder(spark.createDataFrame([("x", 1, 2)], "a string, gap_u long, weight_h long"), [-1, 0, 1])).split("Exchange hashpartitioning(a")[-1]


def test_distinct_counts(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 1, "b"), ("k", 2, "b"), ("k", None, "b"), ("l", None, None)], "k string, x int, y string")
    got = {r.k: (r.xs, r.ys, r.n) for r in P.distinct_counts(df, ["k"], F.count(F.lit(1)).alias("n"), xs="x", ys="y").collect()}
    assert got == {"k": (2, 2, 4), "l": (0, 0, 1)}


def test_family_gaps_keep_uncovered_rows(spark):
    pairs = spark.createDataFrame([("p", "e", "f", 1), ("q", "e", "g", 1), ("r", "h", "f", 1)], "pairing_id string, a string, b string, period int")
    normal = spark.createDataFrame([("e", 1, "A", 1, 10), ("e", 1, "N", 2, 20), ("f", 1, "A", 4, 11), ("f", 1, "N", 8, 22), ("f", 1, "R", 9, 9), ("g", 1, "R", 5, 5)], "entity string, period int, family string, z long, x long")
    got = {r.pairing_id: tuple(r)[1:] for r in P.family_gaps(pairs, normal, ["pairing_id"], covered=False).collect()}
    assert got == {"p": (2, 5, 2), "q": (0, None, None), "r": (0, None, None)}
    assert [r.pairing_id for r in P.family_gaps(pairs, normal, ["pairing_id"]).collect()] == ["p"]


def test_profiles_move_by_customer_only(spark, sf, monkeypatch):
    monkeypatch.setattr(demo, "PART_ROWS", 500)
    text, n = plan(registry.QUERIES["agg_qualify"](spark, sf)), -(-demo.n_lines(spark, sf) // 500)
    moved = re.findall(r"Exchange hashpartitioning\((\w+)#.*?, (\d+)\)", text)
    assert {x for x, _ in moved} == {"o_custkey", "l_partkey", "p_partkey"} and {int(k) for _, k in moved} == {n}, text
    want = sorted(registry.QUERIES["agg_qualify"](spark, sf).collect(), key=repr)
    monkeypatch.setattr(demo, "FEW", 0)  # suppliers are shuffled, not sent to all
    assert sorted(registry.QUERIES["agg_qualify"](spark, sf).collect(), key=repr) == want


def test_both_boards_read_lines_that_met_their_orders(spark, sf, monkeypatch):
    monkeypatch.setattr(demo, "PART_ROWS", 500)
    text, n = plan(registry.QUERIES["st_entered_left"](spark, sf)), -(-demo.n_lines(spark, sf) // 500)
    assert "l_orderkey" not in text
    moved = re.findall(r"Exchange hashpartitioning\((\w+)#\w+, (\d+)\), REPARTITION_BY_NUM", text)
    assert {x for x, _ in moved} == {"o_custkey", "l_suppkey", "l_partkey", "p_partkey"} and {int(k) for _, k in moved} == {n}, text


def test_normalized_gaps_list_every_pairing(spark, sf):
    every, rows = demo.pairings_screen(spark, sf).select("pairing_id"), registry.QUERIES["agg_normalized_gaps"](spark, sf)
    uncovered = rows.where("families = 0")
    assert rows.count() == every.count() and not every.exceptAll(rows.select("pairing_id")).count()
    assert uncovered.count() and not uncovered.where("z_gap is not null or raw_gap is not null").count()
    assert sorted(uncovered.select("pairing_id").collect()) == sorted(registry.QUERIES["agg_uncovered"](spark, sf).collect())


def test_draws_are_summed_where_they_arrive(spark, sf, monkeypatch):
    monkeypatch.setattr(demo, "PART_ROWS", 500)
    text, n = plan(registry.QUERIES["rs_interval"](spark, sf)), -(-demo.n_lines(spark, sf) // 500)
    moved = [x for x in re.findall(r"Exchange (hashpartitioning\(.*?\)), ", text) if not x.startswith("hashpartitioning(publisher")]
    # Pairings and scores of side b, rows and scores of side a; sums do not move, and draws are not sent to every task.
    assert len(moved) == 4 and all(x.endswith(f", {n})") for x in moved), text
    assert text.count("SortMergeJoin") == 2


def test_draws_of_a_key_move_before_they_are_summed(spark, monkeypatch):
    c = spark.createDataFrame([("k", "i", 2, -2, 4), ("k", "j", -2, 2, 0), ("l", "j", 1, -1, 1)], "key string, id string, c long, mirror long, exposure long")
    specs = spark.createDataFrame([("i", 80.0, 3.0, "p"), ("j", 99.0, 3.0, None)], "id string, value double, sd double, publisher string")
    out = S.interval(c, specs, 20, 1, 0.1, 2.0)
    lines = plan(out).splitlines()
    (at,) = [i for i, x in enumerate(lines) if re.search(r"Exchange hashpartitioning\(key#\d+, \d+\)", x)]
    assert "Aggregate" not in lines[at + 1]
    one = sorted(map(tuple, out.collect()))
    monkeypatch.setattr(S, "FEW", 0)  # effects are shuffled, not sent to all
    assert sorted(map(tuple, S.interval(c, specs, 20, 1, 0.1, 2.0).collect())) == one
