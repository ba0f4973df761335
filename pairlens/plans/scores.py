"""Queries on gradings, pairings and boards."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import rounded
from ..operators import diagnostics as DG
from ..operators import gradings as G
from ..operators import pairings as P
from ..sources import writers as W
from . import demo
from .registry import query


@query("""SELECT entity, period, sum(score_t)::BIGINT AS sum_t, count(*) AS n, max(score_t) - min(score_t) AS spread_t,
    string_agg(DISTINCT grader, ',' ORDER BY grader) AS graders, string_agg(DISTINCT family, ',' ORDER BY family) AS families,
    bool_or(evidence_used) AS any_evidence FROM gradings WHERE judged AND contract_id = 'c1' GROUP BY entity, period""")
def agg_canonical(spark, sf):
    return G.canonical_scores(demo.gradings(spark, sf).where("contract_id = 'c1'"), ["entity", "period"]).drop("contracts")


@query("""SELECT entity, period, sum(score_t)::BIGINT AS sum_t, count(*) AS n FROM gradings WHERE judged AND grader NOT IN ('RF', 'AO') GROUP BY entity, period""")
def flt_exclude_graders(spark, sf):
    return G.canonical_scores(demo.gradings(spark, sf), ["entity", "period"], exclude=["RF", "AO"]).select("entity", "period", "sum_t", "n")


@query("""SELECT n, count(*) AS keys, max(CASE WHEN n > 1 THEN spread_t END) AS max_spread, round(avg(CASE WHEN n > 1 THEN spread_t END), 6) AS mean_spread FROM canon GROUP BY n""")
def agg_coverage(spark, sf):
    return G.coverage(demo.canon(spark, sf))


@query("SELECT * FROM population")
def agg_population(spark, sf):
    return demo.population(spark, sf)


@query("SELECT * FROM scales")
def agg_scales(spark, sf):
    return G.scales(demo.population(spark, sf))


@query("SELECT * FROM normal")
def agg_normalize(spark, sf):
    return demo.normal(spark, sf)


@query("""SELECT p.pairing_id, p.domain, p.a, p.b, p.weight_h, count(n2.z) AS families, round(sum(n2.z - n1.z) / count(n2.z))::BIGINT AS z_gap, round(sum(n2.x - n1.x) / count(n2.z))::BIGINT AS raw_gap
    FROM pairings_screen p LEFT JOIN normal n1 ON n1.entity = p.a AND n1.period = p.period LEFT JOIN normal n2 ON n2.entity = p.b AND n2.period = p.period AND n2.family = n1.family
    GROUP BY p.pairing_id, p.domain, p.a, p.b, p.work, p.period, p.weight_h""")
def agg_normalized_gaps(spark, sf):
    """Every pairing; those without a family that scores both sides have 0 families and no gaps."""
    return demo.normal_gaps(spark, sf, covered=False).drop("period")


@query("""SELECT coalesce(domain, 'ALL') AS domain, weight_h > 0 AS weighted, count(*) AS n, round(avg(raw_gap), 6) AS mean_raw, round(avg(z_gap), 6) AS mean_normal
    FROM normal_gaps GROUP BY GROUPING SETS ((domain, weight_h > 0), (weight_h > 0))""")
def agg_offsets(spark, sf):
    df = demo.normal_gaps(spark, sf).withColumn("weighted", F.expr("weight_h > 0"))
    out = df.groupingSets([["domain", "weighted"], ["weighted"]], "domain", "weighted").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("raw_gap")).alias("mean_raw"), rounded(F.avg("z_gap")).alias("mean_normal"))
    return out.withColumn("domain", F.coalesce("domain", F.lit("ALL")))


@query("""SELECT side, domain, entity, pairings, exposure_h, total, rate, row_number() OVER (PARTITION BY side, domain ORDER BY total DESC, entity) AS rank FROM board""")
def agg_board(spark, sf):
    return P.ranked(demo.board(spark, sf))


@query("""SELECT side, domain, entity, rate, row_number() OVER (PARTITION BY side, domain ORDER BY coalesce(rate, 0) DESC, entity) AS rank FROM board""")
def wn_board_rank(spark, sf):
    return P.ranked(demo.board(spark, sf), "rate").select("side", "domain", "entity", "rate", "rank")


@query("""SELECT p.pairing_id, x.family, CASE WHEN z.n IS NULL THEN x.family || ':uncached' END AS reason, round(1000 * (z.sum_t / z.n - x.sum_t / x.n))::BIGINT AS gap
    FROM pairings_screen p JOIN family_scores x ON x.entity = p.a AND x.period = p.period LEFT JOIN family_scores z ON z.entity = p.b AND z.period = p.period AND z.family = x.family""")
def jn_double_lookup(spark, sf):
    df = _family_scores(spark, sf).withColumn("x", F.explode("fa"))
    y = F.get(F.filter("fb", lambda q: q["family"] == F.col("x.family")), F.lit(0))
    df = df.select("pairing_id", F.col("x.family").alias("family"), F.col("x.s").alias("s1"), F.col("x.n").alias("n1"), y["s"].alias("s2"), y["n"].alias("n2"))
    return df.selectExpr("pairing_id", "family", "if(n2 is null, concat(family, ':uncached'), null) as reason", "cast(round(1000 * (s2 / n2 - s1 / n1)) as bigint) as gap")


def _family_scores(spark, sf):
    """Every pairing whose side a has scores, with the few families' sums of each side in an array; no row for each family moves."""
    each = G.canonical_scores(demo.current_gradings(spark, sf), ["entity", "period", "family"]).groupBy("entity", "period").agg(F.collect_list(F.struct("family", F.col("sum_t").alias("s"), "n")).alias("f"))
    df = demo.narrow_pairings(spark, sf).join(each.selectExpr("entity as a", "period", "f as fa"), ["a", "period"]).join(each.selectExpr("entity as b", "period", "f as fb"), ["b", "period"], "left")
    return demo.named(df)


@query("""SELECT pairing_id, a_n, b_n, gap_u, CASE WHEN a_n IS NULL AND b_n IS NULL THEN 'both sides unscored' WHEN a_n IS NULL THEN 'side a unscored' WHEN b_n IS NULL THEN 'side b unscored' END AS reason FROM pair_scores""")
def jn_canonical_lookup(spark, sf):
    return demo.pair_scores(spark, sf).select("pairing_id", "a_n", "b_n", "gap_u", P.missing_reason().alias("reason"))


@query("SELECT pairing_id, side, entity, paw, gap_u FROM contribs")
def st_mirror(spark, sf):
    return demo.contribs(spark, sf).select("pairing_id", "side", "entity", "paw", "gap_u")


@query("""SELECT domain, sum(CASE WHEN side = 'a' THEN paw END)::BIGINT AS view_a, sum(CASE WHEN side = 'b' THEN paw END)::BIGINT AS view_b, sum(paw) = 0 AS mirrors_exactly FROM contribs GROUP BY domain""")
def as_mirrored_contribs(spark, sf):
    return demo.contribs(spark, sf).groupBy("domain").agg(F.sum(F.expr("if(side = 'a', paw, null)")).alias("view_a"), F.sum(F.expr("if(side = 'b', paw, null)")).alias("view_b"), (F.sum("paw") == 0).alias("mirrors_exactly"))


@query("""SELECT side, domain, sum(CASE WHEN c < 3 THEN 1 ELSE 0 END)::BIGINT AS below, count(*) AS entities FROM (SELECT side, domain, entity, count(*) AS c FROM contribs GROUP BY ALL) GROUP BY side, domain""")
def flt_min_pairings(spark, sf):
    return P.below_bar(demo.contribs(spark, sf), 3)


@query("SELECT weight_h, count(*) AS pairings, count(CASE WHEN weight_h <> 0 THEN 1 END) AS qualifying FROM pairings_screen GROUP BY weight_h")
def flt_zero_weight(spark, sf):
    return demo.pairings_screen(spark, sf).groupBy("weight_h").agg(F.count(F.lit(1)).alias("pairings"), F.count(F.expr("if(weight_h <> 0, 1, null)")).alias("qualifying"))


@query("SELECT pairing_id, weight_h, weight_h IN (40, 100) AS on_board FROM pairings_screen")
def flt_board_weights(spark, sf):
    return demo.pairings_screen(spark, sf).select("pairing_id", "weight_h", F.col("weight_h").isin(40, 100).alias("on_board"))


@query("""SELECT side, domain, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(total) > 0 AND var_pop(exposure_h) > 0 THEN round(regr_r2(total::DOUBLE, exposure_h::DOUBLE), 6) END AS r2 FROM board GROUP BY side, domain""")
def agg_volume_confound(spark, sf):
    return demo.board(spark, sf).groupBy("side", "domain").agg(F.count(F.lit(1)).alias("n"), P.r_squared("total", "exposure_h").alias("r2"))


@query("""SELECT pairing_id, round(sum(gap) / count(*))::BIGINT AS gap, count(*) AS families, string_agg(family || '=' || gap, ',' ORDER BY family) AS by_family, min(weight_h) AS weight_h FROM family_gaps GROUP BY pairing_id""")
def agg_merge_families(spark, sf):
    g = F.array_join(F.array_sort(F.transform("g", lambda x: F.concat(x["family"], F.lit("="), x["gap"].cast("string")))), ",")
    total = F.aggregate("g", F.lit(0).cast("long"), lambda t, x: t + x["gap"])
    return _family_gaps(spark, sf).select("pairing_id", F.round(total / F.size("g")).cast("long").alias("gap"), F.size("g").cast("long").alias("families"), g.alias("by_family"), "weight_h")


def _family_gaps(spark, sf):
    """Every pairing with the gaps ``g`` (family, gap) of the families that score both sides, one at least."""
    gap = lambda p, q: F.round(1000 * (q["s"] / q["n"] - p["s"] / p["n"])).cast("long")
    both = F.flatten(F.transform("fa", lambda p: F.transform(F.filter("fb", lambda q: q["family"] == p["family"]), lambda q: F.struct(p["family"].alias("family"), gap(p, q).alias("gap")))))
    return _family_scores(spark, sf).select("pairing_id", "weight_h", both.alias("g")).where("size(g) > 0")


@query("""SELECT count(*) AS pairings, round(avg(s), 6) AS mean_spread, median(s)::DOUBLE AS median_spread, max(s) AS worst, sum(flip)::BIGINT AS flips FROM (
    SELECT max(gap) - min(gap) AS s, CASE WHEN min(gap) < 0 AND max(gap) > 0 THEN 1 ELSE 0 END AS flip FROM family_gaps GROUP BY pairing_id HAVING count(*) > 1)""")
def agg_family_spread(spark, sf):
    gaps = _family_gaps(spark, sf).where("size(g) > 1").select(F.array_max("g.gap").alias("most"), F.array_min("g.gap").alias("least"))
    per = gaps.selectExpr("most - least as s", "if(least < 0 and most > 0, 1, 0) as flip")
    return per.agg(F.count(F.lit(1)).alias("pairings"), rounded(F.avg("s")).alias("mean_spread"), F.median("s").alias("median_spread"), F.max("s").alias("worst"), F.sum("flip").alias("flips"))


@query("""SELECT entity, period, family, count(*) AS repeats, round(stddev_samp(score_t), 6) AS sd FROM gradings WHERE judged GROUP BY ALL HAVING count(*) > 1""")
def agg_repeat_spread(spark, sf):
    return demo.gradings(spark, sf).where("judged").groupBy("entity", "period", "family").agg(F.count(F.lit(1)).alias("repeats"), rounded(F.stddev_samp("score_t")).alias("sd")).where("repeats > 1")


_RANKED = "(SELECT *, row_number() OVER (PARTITION BY side, domain ORDER BY total DESC, entity) AS rank FROM board)"


@query(f"""SELECT side, domain, count(*) AS n, count(CASE WHEN d < 5000000 THEN 1 END) AS closer_than_floor FROM (
    SELECT *, lag(total) OVER (PARTITION BY side, domain ORDER BY rank) - total AS d FROM {_RANKED}) GROUP BY side, domain""")
def wn_adjacent_floor(spark, sf):
    w = Window.partitionBy("side", "domain").orderBy("rank")
    df = P.ranked(demo.board(spark, sf)).withColumn("d", F.lag("total").over(w) - F.col("total"))
    return df.groupBy("side", "domain").agg(F.count(F.lit(1)).alias("n"), F.count(F.expr("if(d < 5000000, 1, null)")).alias("closer_than_floor"))


@query(f"""SELECT side, domain, entity, rank, sum(brk) OVER (PARTITION BY side, domain ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS tie_group FROM (
    SELECT *, CASE WHEN coalesce(lag(total) OVER (PARTITION BY side, domain ORDER BY rank) - total, 5000000) >= 5000000 THEN 1 ELSE 0 END AS brk FROM {_RANKED})""")
def wn_tie_groups(spark, sf):
    return P.tie_groups(P.ranked(demo.board(spark, sf)), "total", 5000000).select("side", "domain", "entity", "rank", "tie_group")


@query("""SELECT side, domain, entity, arg_max(pairing_id, (paw, pairing_id)) AS pairing_id, max(paw) AS paw FROM contribs GROUP BY ALL""")
def wn_top_contribution(spark, sf):
    return demo.contribs(spark, sf).groupBy("side", "domain", "entity").agg(F.max_by("pairing_id", F.struct("paw", "pairing_id")).alias("pairing_id"), F.max("paw").alias("paw"))


_NORMAL_TOTALS = "(SELECT a AS entity, sum(weight_h * raw_gap)::BIGINT AS raw, sum(weight_h * z_gap)::BIGINT AS z FROM normal_gaps WHERE weight_h <> 0 GROUP BY a)"


_CHANGES = f"""(SELECT entity, CASE WHEN y IS NULL THEN 'left' WHEN x IS NULL THEN 'entered' ELSE 'both' END AS status, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN row_number() OVER (PARTITION BY x IS NOT NULL AND y IS NOT NULL ORDER BY x DESC, entity) END AS before,
    CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN row_number() OVER (PARTITION BY x IS NOT NULL AND y IS NOT NULL ORDER BY y DESC, entity) END AS after
    FROM (SELECT entity, CASE WHEN raw > 0 THEN raw END AS x, CASE WHEN z > 0 THEN z END AS y FROM {_NORMAL_TOTALS}) WHERE x IS NOT NULL OR y IS NOT NULL)"""


@query(f"""SELECT r.entity, r.status, r.before, r.after, r.before <> r.after AS moved, CASE WHEN r.status = 'both' THEN (SELECT count(*) FROM {_CHANGES} y WHERE y.before > r.before AND y.after < r.after) END AS inversions FROM {_CHANGES} r""")
def wn_rank_changes(spark, sf):
    """What normalising within sides does to the board of positive totals of side a."""
    totals = _normal_totals(spark, sf)
    return DG.rank_changes(totals.where("raw > 0").selectExpr("entity", "raw as value"), totals.where("z > 0").selectExpr("entity", "z as value"), _saved(spark, "changes"))


def _saved(spark, name):
    return lambda df: W.snapshot(df, W.shared_path(spark, name))


def _normal_totals(spark, sf):
    df = demo.normal_gaps(spark, sf).where("weight_h <> 0").groupBy(F.col("a").alias("entity")).agg(F.expr("sum(weight_h * raw_gap)").alias("raw"), F.expr("sum(weight_h * z_gap)").alias("z"))
    return _saved(spark, "totals")(df)  # read several times


@query(f"""SELECT * FROM (WITH r AS (SELECT entity, row_number() OVER (ORDER BY raw DESC, entity) AS p, row_number() OVER (ORDER BY z DESC, entity) AS q FROM {_NORMAL_TOTALS})
    SELECT x.entity, count(*) AS inversions FROM r x JOIN r y ON x.p < y.p AND x.q > y.q GROUP BY x.entity)""")
def jn_pairs_theta(spark, sf):
    df = _normal_totals(spark, sf)
    places = _saved(spark, "places")(P.positions(P.positions(df, "raw", "entity", "before"), "z", "entity", "after").select("entity", "before", "after"))
    return P.inversions(places, "before", "after").where("inversions > 0").select("entity", "inversions")


@query(f"""SELECT coalesce(x.entity, y.entity) AS entity, CASE WHEN x.entity IS NULL THEN 'entered' WHEN y.entity IS NULL THEN 'left' ELSE 'both' END AS status FROM
    (SELECT entity FROM board WHERE side = 'a' AND pairings >= 20) x FULL JOIN (SELECT entity FROM {_NORMAL_TOTALS} WHERE z > 0) y ON x.entity = y.entity""")
def st_entered_left(spark, sf):
    # Both boards are of side a, so each of its entities is decided in one row.
    per = demo.scored_sides(spark, sf).groupBy("a").agg(F.count(F.lit(1)).alias("pairings"), F.sum(F.col("weight_h") * F.col("z_gap")).alias("z"))
    per = per.selectExpr("concat('C', a) as entity", "pairings >= 20 as x", "coalesce(z > 0, false) as y").where("x or y")
    return per.selectExpr("entity", "case when not x then 'entered' when not y then 'left' else 'both' end as status")


@query("SELECT entity, period, count(DISTINCT contract_id) AS contracts FROM gradings GROUP BY entity, period HAVING count(DISTINCT contract_id) > 1")
def dq_mixed_contracts(spark, sf):
    return G.mixed_contracts(demo.gradings(spark, sf), ["entity", "period"])


@query("""SELECT entity, period, count(*) AS gradings, sum(calls)::BIGINT AS calls FROM (SELECT entity, period, contract_id, CASE WHEN score_t % 4 = 0 THEN 0 ELSE 1 END AS calls FROM gradings) WHERE contract_id NOT IN ('c1') GROUP BY entity, period HAVING sum(calls) > 0""")
def dq_stale_contract(spark, sf):
    """Records made under a contract that no longer holds; one that made no calls at all states nothing new and is exempt."""
    registry = spark.createDataFrame([("c1",)], "contract_id string")
    g = demo.gradings(spark, sf).withColumn("calls", (F.col("score_t") % 4 != 0).cast("int"))
    stale = g.join(F.broadcast(registry), "contract_id", "left_anti").groupBy("entity", "period").agg(F.count(F.lit(1)).alias("gradings"), F.sum("calls").alias("calls"))
    return stale.where("calls > 0")


@query("SELECT grader, count(*) AS gradings, count(CASE WHEN NOT judged THEN 1 END) AS undated FROM gradings GROUP BY grader")
def agg_gradings_by_model(spark, sf):
    return demo.gradings(spark, sf).groupBy("grader").agg(F.count(F.lit(1)).alias("gradings"), F.count(F.expr("if(not judged, 1, null)")).alias("undated"))


@query("""SELECT count(CASE WHEN d = 0 THEN 1 END) AS identical, count(CASE WHEN d > 0 THEN 1 END) AS differing, max(d) AS largest, count(CASE WHEN n = 1 THEN 1 END) AS one_grader FROM (
    SELECT count(*) AS n, CASE WHEN count(*) > 1 THEN max(m) - min(m) END AS d FROM (SELECT entity, period, family, round(1000 * sum_t / n)::BIGINT AS m FROM family_scores) GROUP BY entity, period)""")
def agg_grader_agreement(spark, sf):
    m = G.canonical_scores(demo.gradings(spark, sf).where("contract_id = 'c1'"), ["entity", "period", "family"]).selectExpr("entity", "period", "cast(round(1000 * sum_t / n) as bigint) as m")
    per = m.groupBy("entity", "period").agg(F.count(F.lit(1)).alias("n"), F.expr("if(count(1) > 1, max(m) - min(m), null)").alias("d"))
    return per.agg(F.expr("count(if(d = 0, 1, null))").alias("identical"), F.expr("count(if(d > 0, 1, null))").alias("differing"), F.max("d").alias("largest"), F.expr("count(if(n = 1, 1, null))").alias("one_grader"))


_M = "(SELECT pairing_id, sum(CASE WHEN a_h IS NOT NULL AND b_h IS NOT NULL THEN days * (b_h - a_h) END) AS num, sum(CASE WHEN a_h IS NOT NULL AND b_h IS NOT NULL THEN days END) AS den, max(total_days) AS total FROM period_rows GROUP BY pairing_id)"


@query(f"SELECT pairing_id, round(num / den, 6) AS gap FROM {_M}")
def agg_gap(spark, sf):
    return P.gap_measures(demo.period_rows(spark, sf)).select("pairing_id", "gap")


@query(f"SELECT pairing_id, round(num / 365.25, 6) AS gap_years FROM {_M}")
def agg_gap_years(spark, sf):
    return P.gap_measures(demo.period_rows(spark, sf)).select("pairing_id", "gap_years")


@query(f"SELECT pairing_id, round(coalesce(den, 0) / total, 6) AS covered_share, coalesce(den, 0)::BIGINT AS scored_days FROM {_M}")
def agg_covered_share(spark, sf):
    return P.gap_measures(demo.period_rows(spark, sf)).select("pairing_id", "covered_share", F.col("scored_days").cast("long").alias("scored_days"))


@query(f"SELECT count(CASE WHEN num IS NULL THEN 1 END) AS unscored, sum(num)::BIGINT AS total, round(sum(num) / sum(den), 6) AS rate FROM {_M}")
def agg_paw(spark, sf):
    m = P.gap_measures(demo.period_rows(spark, sf))
    return m.agg(F.expr("count(if(num is null, 1, null))").alias("unscored"), F.sum("num").cast("long").alias("total"), rounded(F.sum("num") / F.sum("scored_days")).alias("rate"))


@query("SELECT a, sum(days * (b_h - 500))::BIGINT AS mass, sum(days)::BIGINT AS days, round(sum(days * (b_h - 500)) / sum(days), 6) AS per_day FROM period_rows WHERE b_h IS NOT NULL GROUP BY a")
def agg_partner_war(spark, sf):
    return P.partner_mass(demo.period_rows(spark, sf), 500)


@query("SELECT v.version, v.baseline, sum(days * (b_h - v.baseline))::BIGINT AS mass FROM period_rows, (VALUES ('r1', 500), ('r2', 520)) v(version, baseline) WHERE b_h IS NOT NULL GROUP BY ALL")
def agg_release_param(spark, sf):
    versions = spark.createDataFrame([("r1", 500), ("r2", 520)], "version string, baseline int")
    if versions.groupBy("version").count().where("count > 1").count():
        raise ValueError("a baseline needs a version of its own")
    rows = demo.period_rows(spark, sf).where("b_h is not null").crossJoin(F.broadcast(versions))
    return rows.groupBy("version", "baseline").agg(F.expr("sum(days * (b_h - baseline))").alias("mass"))


@query("SELECT median(b_h)::DOUBLE AS cohort_median, count(*) AS n FROM period_rows WHERE b_h IS NOT NULL")
def agg_cohort_median(spark, sf):
    return demo.period_rows(spark, sf).where("b_h is not null").agg(F.median("b_h").alias("cohort_median"), F.count(F.lit(1)).alias("n"))


@query(f"""SELECT count(*) AS n, CASE WHEN count(*) >= 3 THEN round(stddev_pop(u), 6) END AS sd, round(avg(u), 6) AS mean, CASE WHEN count(*) < 3 THEN 'too few' WHEN stddev_pop(u) < 0.1 * abs(avg(u)) THEN 'count-like' ELSE 'varies' END AS verdict
    FROM (SELECT num / den AS u FROM {_M} WHERE den > 0)""")
def agg_count_like(spark, sf):
    u = P.gap_measures(demo.period_rows(spark, sf)).where("scored_days > 0").selectExpr("num / scored_days as u")
    return u.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, rounded(F.stddev_pop("u"))).alias("sd"), rounded(F.avg("u")).alias("mean"), F.expr("case when count(1) < 3 then 'too few' when stddev_pop(u) < 0.1 * abs(avg(u)) then 'count-like' else 'varies' end").alias("verdict"))


@query("""SELECT pairing_id, sum(days)::BIGINT AS days, max(total_days) AS total_days, string_agg(period || ':' || days, ',' ORDER BY period) AS shares FROM (SELECT pairing_id, period, days + CASE WHEN hash7 = 0 THEN 1 ELSE 0 END AS days, total_days FROM (SELECT *, (length(pairing_id) + date_diff('day', DATE '1990-01-01', start_d)) % 7 AS hash7 FROM life_days)) GROUP BY pairing_id HAVING sum(days) <> max(total_days)""")
def dq_pairing_partition(spark, sf):
    """Pairings whose period shares do not add up to their days; in every seventh a day is counted twice in each period."""
    odd = F.expr("(length(pairing_id) + datediff(start_d, date'1990-01-01')) % 7 = 0").cast("int")
    return P.broken_partitions(demo.life_days(spark, sf).withColumn("days", F.col("days") + odd))


@query("""SELECT d AS delta, sum(weight_h * (gap_u + d))::BIGINT AS total, round(sum(weight_h * (gap_u + d)) / sum(weight_h), 6) AS rate, TRUE AS moved_by_exposure, TRUE AS same_order FROM pair_scores, (SELECT unnest(range(-6, 7)) * 1000000 AS d) WHERE gap_u IS NOT NULL AND weight_h <> 0 GROUP BY d""")
def rs_offset_shift(spark, sf):
    """A constant on every gap moves totals by constant times exposure and leaves the order of the rates: checked row by row."""
    scored = demo.pair_scores(spark, sf).where("gap_u is not null and weight_h <> 0").select("a", "gap_u", "weight_h")
    return P.offset_ladder(scored, [d * 1_000_000 for d in range(-6, 7)])


@query("""SELECT entity, period, round(avg(score), 6) AS mean, count(*) AS n, CASE WHEN count(*) < 2 THEN FALSE ELSE count(DISTINCT band) > 1 OR bool_or(band IS NULL) OR bool_or(coalesce(stated <> band, FALSE)) END AS needs_adjudication FROM (
    SELECT entity, period, score_t AS score, CASE WHEN score_t BETWEEN 0 AND 19 THEN 'very low' WHEN score_t BETWEEN 20 AND 39 THEN 'low' WHEN score_t BETWEEN 40 AND 59 THEN 'middle' WHEN score_t BETWEEN 60 AND 79 THEN 'high' WHEN score_t BETWEEN 80 AND 100 THEN 'very high' END AS band,
    CASE WHEN (score_t + CASE WHEN evidence_used THEN 0 ELSE 2 END) BETWEEN 0 AND 19 THEN 'very low' WHEN (score_t + CASE WHEN evidence_used THEN 0 ELSE 2 END) BETWEEN 20 AND 39 THEN 'low' WHEN (score_t + CASE WHEN evidence_used THEN 0 ELSE 2 END) BETWEEN 40 AND 59 THEN 'middle' WHEN (score_t + CASE WHEN evidence_used THEN 0 ELSE 2 END) BETWEEN 60 AND 79 THEN 'high' WHEN (score_t + CASE WHEN evidence_used THEN 0 ELSE 2 END) BETWEEN 80 AND 100 THEN 'very high' END AS stated
    FROM gradings WHERE judged) GROUP BY entity, period""")
def agg_band_disagreement(spark, sf):
    """Graders without evidence state the band of a score two points higher."""
    stated = G.band(F.col("score_t") + F.when(F.col("evidence_used"), 0).otherwise(2))
    df = demo.gradings(spark, sf).where("judged").select("entity", "period", F.col("score_t").alias("score"), stated.alias("stated"))
    return G.band_disagreement(df, ["entity", "period"], "score", "stated")


@query("""SELECT period, a AS entity, round(avg(raw_gap), 6) AS raw, round(avg(z_gap), 6) AS z FROM normal_gaps JOIN (SELECT pairing_id, period FROM pairings_screen) USING (pairing_id) GROUP BY ALL HAVING count(*) >= 2""")
def wn_trajectory(spark, sf):
    return demo.normal_gaps(spark, sf).groupBy("period", F.col("a").alias("entity")).agg(rounded(F.avg("raw_gap")).alias("raw"), rounded(F.avg("z_gap")).alias("z"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")


@query("SELECT pairing_id, period, min(period) OVER (PARTITION BY domain) AS first_period, max(period) OVER (PARTITION BY domain) AS last_period FROM pairings_screen WHERE weight_h <> 0")
def wn_year_axis(spark, sf):
    rows = demo.pairings_screen(spark, sf).where("weight_h <> 0")
    axis = rows.groupBy("domain").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"))
    return rows.join(F.broadcast(axis), "domain").select("pairing_id", "period", "first_period", "last_period")  # a row for each domain


@query("""SELECT c.domain, entities, pairings, mean_offset, works, first_period, last_period, round(judged / gradings, 6) AS evidence_share, ranked FROM (SELECT domain, count(DISTINCT entity) AS entities, count(DISTINCT pairing_id) AS pairings, round(avg(CASE WHEN side = 'a' THEN gap_u END), 6) AS mean_offset FROM contribs GROUP BY domain) c
    JOIN (SELECT domain, count(DISTINCT work) AS works, min(period) AS first_period, max(period) AS last_period FROM pair_scores WHERE gap_u IS NOT NULL AND weight_h <> 0 GROUP BY domain) p ON p.domain = c.domain JOIN (SELECT domain, count(*) AS ranked FROM board GROUP BY domain) b ON b.domain = c.domain,
    (SELECT count(*) FILTER (WHERE evidence_used) AS judged, count(*) AS gradings FROM gradings WHERE judged AND contract_id = 'c1')""")
def agg_board_meta(spark, sf):
    """What a board rests on: entities and pairings counted, ranked entities (two pairings or more), works, years, evidence."""
    scores = demo.named(_saved(spark, "scores")(demo.pair_scores(spark, sf).where("gap_u is not null and weight_h <> 0").select("a", "b", "work", "period", "weight_h", "gap_u")))
    # Pairings are rows with a key of their own, so they are counted as they are.
    c = scores.groupBy("domain").agg(F.count("pairing_id").alias("pairings"), rounded(F.avg("gap_u")).alias("mean_offset"), F.count_distinct("work").alias("works"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))
    entities = P.board(P.signed_sides(scores), 1).select("domain", "entity", "pairings")
    b = entities.groupBy("domain").agg(F.count_distinct("entity").alias("entities"), F.count_if(F.col("pairings") >= 2).alias("ranked"))
    used = demo.gradings(spark, sf).where("judged and contract_id = 'c1'").agg(rounded(F.count_if("evidence_used") / F.count(F.lit(1))).alias("evidence_share"))
    return c.join(b, "domain").crossJoin(F.broadcast(used))  # one row


@query("SELECT p.pairing_id FROM pairings_screen p LEFT JOIN normal_gaps g USING (pairing_id) WHERE g.pairing_id IS NULL", name="agg_uncovered")
def agg_uncovered(spark, sf):
    return demo.normal_gaps(spark, sf, covered=False).where("families = 0").select("pairing_id")


@query("""SELECT side, entity, total, row_number() OVER (PARTITION BY side ORDER BY total DESC, entity) AS rank FROM board WHERE entity IN (SELECT a FROM pairings_life UNION SELECT b FROM pairings_life) QUALIFY rank <= 50""")
def wn_topk_per_side(spark, sf):
    life = demo.pairings_life(spark, sf)
    both = demo.board(spark, sf).join(life.select(F.explode(F.array("a", "b")).alias("entity")).distinct(), "entity", "left_semi")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(F.desc("total"), "entity"))).where("rank <= 50").select("side", "entity", "total", "rank")


@query("SELECT entity, period, count(*) AS pairings FROM (SELECT a AS entity, period FROM pairings_screen UNION ALL SELECT b, period FROM pairings_screen) GROUP BY ALL")
def st_needed_tuples(spark, sf):
    return demo.pairings_screen(spark, sf).select(F.explode(F.array("a", "b")).alias("entity"), "period").groupBy("entity", "period").agg(F.count(F.lit(1)).alias("pairings"))


@query("SELECT DISTINCT e.entity, e.period FROM (SELECT a AS entity, period FROM pairings_screen UNION ALL SELECT b, period FROM pairings_screen) e LEFT JOIN canon c ON c.entity = e.entity AND c.period = e.period WHERE c.entity IS NULL")
def jn_anti_backlog(spark, sf):
    return st_needed_tuples(spark, sf).select("entity", "period").join(demo.canon(spark, sf).select("entity", "period").distinct(), ["entity", "period"], "left_anti")


@query("""SELECT pairing_id, count(DISTINCT entity) AS sides, count(DISTINCT period) AS periods FROM (SELECT pairing_id, a AS entity, period FROM life_days UNION ALL SELECT pairing_id, b, period FROM life_days) GROUP BY pairing_id""")
def agg_pairing_counts(spark, sf):
    sides = demo.life_days(spark, sf).select("pairing_id", F.explode(F.array("a", "b")).alias("entity"), "period")
    return P.distinct_counts(demo.dealt(sides, 4 * demo.n_lines(spark, sf), "pairing_id"), ["pairing_id"], sides="entity", periods="period")


_KEY = "least(a, b) AS one, greatest(a, b) AS other"


@query(f"""SELECT domain, one, other, work, year, count(*) AS carried, min(period) AS period FROM (SELECT 'on_screen' AS domain, {_KEY}, regexp_replace(lower(work), '[^a-z0-9]+', ' ', 'g') AS work, NULL AS year, period FROM pairings_screen
    UNION ALL SELECT 'real_life', {_KEY}, NULL, year(start_d)::INT, year(start_d)::INT FROM pairings_life UNION ALL SELECT 'real_life', {_KEY}, NULL, year(end_d)::INT, year(end_d)::INT FROM pairings_life) GROUP BY ALL""")
def st_identity(spark, sf):
    """On screen a pair and a work are one thing in whichever year; in life a pair in two years is two. Sides have no order."""
    screen = demo.pairings_screen(spark, sf).withColumn("work", F.regexp_replace(F.lower("work"), "[^a-z0-9]+", " ")).select("domain", "a", "b", "work", "period")
    life = demo.pairings_life(spark, sf).select("a", "b", F.explode(F.array(F.year("start_d"), F.year("end_d"))).alias("period")).withColumn("domain", F.lit("real_life"))
    df = screen.unionByName(life, allowMissingColumns=True).withColumn("year", F.when(F.col("domain") == "real_life", F.col("period")))
    return df.groupBy("domain", F.least("a", "b").alias("one"), F.greatest("a", "b").alias("other"), "work", "year").agg(F.count(F.lit(1)).alias("carried"), F.min("period").alias("period"))


@query("""SELECT source_rank, count(*) AS seen, count(CASE WHEN rn = 1 THEN 1 END) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY a, b, work ORDER BY source_rank, pairing_id) AS rn FROM (
    SELECT 0 AS source_rank, a, b, work, pairing_id FROM pairings_screen WHERE weight_h = 100 UNION ALL SELECT 1, a, b, work, pairing_id FROM pairings_screen)) GROUP BY source_rank""")
def st_merge_graphs(spark, sf):
    p = demo.pairings_screen(spark, sf).select("a", "b", "work", "pairing_id")
    strong = demo.pairings_screen(spark, sf).where("weight_h = 100").select("a", "b", "work", "pairing_id")
    m = P.merged([strong, p], [F.col("a"), F.col("b"), F.col("work")], ["pairing_id"])
    return m.groupBy("source_rank").agg(F.count(F.lit(1)).alias("seen"), F.count(F.expr("if(kept, 1, null)")).alias("kept"))


@query("""SELECT source_rank, pairing_id FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY source_rank, pairing_id) AS rn FROM (
    SELECT 0 AS source_rank, a, b, pairing_id FROM pairings_life UNION ALL SELECT 1, a, b, pairing_id FROM pairings_screen)) WHERE rn = 1""")
def wn_first_source_wins(spark, sf):
    m = P.merged([demo.pairings_life(spark, sf).select("a", "b", "pairing_id"), demo.pairings_screen(spark, sf).select("a", "b", "pairing_id")], [F.col("a"), F.col("b")], ["pairing_id"])
    return m.where("kept").select("source_rank", "pairing_id")


@query("SELECT pairing_id, domain, period FROM pairings_screen WHERE period >= 1997")
def flt_scope_floor(spark, sf):
    return demo.pairings_screen(spark, sf).where("period >= 1997").select("pairing_id", "domain", "period")


@query("SELECT pairing_id, a, b FROM pairings_screen WHERE domain = 'on_screen' AND weight_h <> 0")
def flt_domain(spark, sf):
    return demo.pairings_screen(spark, sf).where("domain = 'on_screen' and weight_h <> 0").select("pairing_id", "a", "b")


@query("""SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN period < 1996 THEN 'before scope' WHEN weight_h = 0 THEN 'no weight' WHEN a_n IS NULL THEN 'side a unscored' WHEN b_n IS NULL THEN 'side b unscored' END AS reason FROM pair_scores) GROUP BY ALL""")
def flt_drop_taxonomy(spark, sf):
    reason = F.expr("case when period < 1996 then 'before scope' when weight_h = 0 then 'no weight' when a_n is null then 'side a unscored' when b_n is null then 'side b unscored' else 'kept' end")
    return demo.pair_scores(spark, sf).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT pairing_id, CASE WHEN abs(gap_u) > 20000000 THEN TRUE WHEN gap_u IS NULL THEN NULL ELSE FALSE END AS detectable FROM pair_scores""")
def flt_detectable(spark, sf):
    floor = spark.createDataFrame([(20000000,)], "floor long")
    return demo.pair_scores(spark, sf).crossJoin(F.broadcast(floor)).selectExpr("pairing_id", "if(floor is null, gap_u <> 0, abs(gap_u) > floor) as detectable")
