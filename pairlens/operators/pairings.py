"""Pairings: scores of both sides, exactly mirrored signed gaps, boards, and the measures over periods.

A gap is computed once and its mirror is the same column times -1. Missing scores give a null gap with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import rounded


def lookup_both(pairings: DataFrame, canon: DataFrame) -> DataFrame:
    """Adds sum and number of the scores of sides a and b in the pairing's period; null where there is none."""
    c = canon.groupBy("entity", "period").agg(F.sum("sum_t").alias("sum_t"), F.sum("n").alias("n"))
    a = c.select(F.col("entity").alias("a"), "period", F.col("sum_t").alias("a_sum"), F.col("n").alias("a_n"))
    b = c.select(F.col("entity").alias("b"), "period", F.col("sum_t").alias("b_sum"), F.col("n").alias("b_n"))
    return pairings.join(a, ["a", "period"], "left").join(b, ["b", "period"], "left")


def missing_reason(a: str = "a_n", b: str = "b_n") -> Column:
    return F.when(F.col(a).isNull() & F.col(b).isNull(), "both sides unscored").when(F.col(a).isNull(), "side a unscored").when(F.col(b).isNull(), "side b unscored")


def signed_sides(scored: DataFrame) -> DataFrame:
    """A row for each side of every pairing with a gap and a weight other than zero."""
    side = lambda e, s, sign: F.struct(F.col(e).alias("entity"), F.lit(s).alias("side"), F.lit(sign).cast("long").alias("sign"))
    df = scored.where("gap_u is not null and weight_h <> 0").withColumn("s", F.explode(F.array(side("a", "a", 1), side("b", "b", -1))))
    return df.select("s.entity", "s.side", "domain", "pairing_id", "weight_h", (F.col("s.sign") * F.col("gap_u") * F.col("weight_h")).alias("paw"), (F.col("s.sign") * F.col("gap_u")).alias("gap_u"))


def board(contributions: DataFrame, least: int) -> DataFrame:
    """Weighted signed totals of every entity with ``least`` or more pairings; rate per unit of weight."""
    df = contributions.groupBy("side", "domain", "entity").agg(F.count(F.lit(1)).alias("pairings"), F.sum("weight_h").alias("exposure_h"), F.sum("paw").alias("total"))
    return df.where(F.col("pairings") >= least).withColumn("rate", rounded(F.col("total") / F.col("exposure_h")))


def ranked(board: DataFrame, by: str = "total") -> DataFrame:
    """Positions within side and domain, highest first, names at ties; a missing rate sorts as zero."""
    w = Window.partitionBy("side", "domain").orderBy(F.desc(F.coalesce(F.col(by), F.lit(0))), "entity")
    return board.withColumn("rank", F.row_number().over(w))


def positions(df: DataFrame, by: str, tie: str, name: str, buckets: int = 64) -> DataFrame:
    """Positions in the whole table, largest first, without ordering it in one task.

    Approximate quantiles cut the values into buckets; a bucket's positions start after the rows of those before it.
    """
    cuts = sorted(set(df.approxQuantile(by, [i / buckets for i in range(1, buckets)], 0.01)))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col(by) < c)) if cuts else F.lit(0)
    df = df.withColumn("_b", bucket)
    n = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    start = n.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_s"))  # a row for each bucket
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(F.desc(by), tie))
    return df.withColumn("_r", rank).join(F.broadcast(start), "_b").withColumn(name, F.col("_s") + F.col("_r")).drop("_b", "_r", "_s")


def below_bar(contributions: DataFrame, least: int) -> DataFrame:
    """Entities on each side and domain with too few pairings, and all."""
    per = contributions.groupBy("side", "domain", "entity").count()
    return per.groupBy("side", "domain").agg(F.sum((F.col("count") < least).cast("int")).alias("below"), F.count(F.lit(1)).alias("entities"))


def family_gaps(pairings: DataFrame, normal: DataFrame, keys: list[str], covered: bool = True) -> DataFrame:
    """Mean raw and normalised gap of each row of ``pairings`` over the families that score both sides; without
    ``covered`` the rows without such a family stay, with 0 families and null gaps.

    The few families of an entity and period lie in one array, so a pairing stays one row and is not grouped again.
    """
    each = normal.groupBy("entity", "period").agg(F.collect_list(F.struct("family", "z", "x")).alias("f"))
    a, b = (each.select(F.col("entity").alias(e), "period", F.col("f").alias(f"_{e}")) for e in ("a", "b"))
    how = "inner" if covered else "left"
    df = pairings.join(a, ["a", "period"], how).join(b, ["b", "period"], how)
    both = F.flatten(F.transform("_a", lambda p: F.transform(F.filter("_b", lambda q: q["family"] == p["family"]), lambda q: F.struct((q["z"] - p["z"]).alias("z"), (q["x"] - p["x"]).alias("x")))))
    df = df.select(*keys, F.coalesce(both, F.array().cast("array<struct<z:bigint,x:bigint>>")).alias("_f")).withColumn("families", F.size("_f").cast("long"))
    mean = lambda c: F.when(F.col("families") > 0, F.round(F.aggregate("_f", F.lit(0).cast("long"), lambda t, x: t + x[c]) / F.col("families")).cast("long"))
    df = df.select(*keys, "families", mean("z").alias("z_gap"), mean("x").alias("raw_gap"))
    return df.where("families > 0") if covered else df


def distinct_counts(rows: DataFrame, keys: list[str], *also: Column, **values: str) -> DataFrame:
    """For each key the number of distinct values other than null of several columns (name=column), and ``also``.

    A value counts at its first row within the key. Rows dealt by the keys beforehand are not moved again, nor are they
    multiplied by the number of columns.
    """
    for name, c in values.items():
        first = F.row_number().over(Window.partitionBy(*keys, c).orderBy(F.lit(1))) == 1
        rows = rows.withColumn(f"_{name}", first & F.col(c).isNotNull())
    return rows.groupBy(*keys).agg(*[F.count_if(f"_{name}").alias(name) for name in values], *also)


def uncovered(pairings: DataFrame, covered: DataFrame) -> DataFrame:
    return pairings.join(covered.select("pairing_id").distinct(), "pairing_id", "left_anti")


def gap_measures(rows: DataFrame) -> DataFrame:
    """Share-weighted gap, gap years and covered share of each pairing from its period rows (a_h, b_h in hundredths).

    The total cancels in the gap: sum(days * (b - a)) over sum(days) of periods with both scores; null without any.
    """
    both = "a_h is not null and b_h is not null"
    return rows.groupBy("pairing_id").agg(
        F.expr(f"sum(if({both}, days * (b_h - a_h), null))").alias("num"), F.expr(f"sum(if({both}, days, null))").alias("den"),
        F.sum("days").alias("all_days"), F.max("total_days").alias("total_days"),
    ).select(
        "pairing_id", rounded(F.col("num") / F.col("den")).alias("gap"), rounded(F.col("num") / 365.25).alias("gap_years"),
        rounded(F.coalesce("den", F.lit(0)) / F.col("total_days")).alias("covered_share"), F.coalesce("den", F.lit(0)).alias("scored_days"), "num", "total_days",
    )


def broken_partitions(rows: DataFrame) -> DataFrame:
    """(pairing_id, days, total_days, shares): pairings whose period days do not sum to their total, with what they have."""
    shares = F.transform(F.array_sort(F.collect_list(F.struct("period", "days"))), lambda x: F.concat_ws(":", x["period"], x["days"]))
    per = rows.groupBy("pairing_id").agg(F.sum("days").alias("days"), F.max("total_days").alias("total_days"))
    bad = per.where("days <> total_days")
    return bad.join(rows.groupBy("pairing_id").agg(F.array_join(shares, ",").alias("shares")), "pairing_id")  # a row for each period


def offset_ladder(scored: DataFrame, deltas: list[int]) -> DataFrame:
    """(delta, total, rate, moved_by_exposure, same_order): every gap shifted by each of a few constants.

    The shift is applied to the gaps themselves and totals are taken anew, so the two checks can fail: that the total
    moved by the constant times the exposure, and that no two neighbours in the order of the rates changed places.
    """
    # One row for each entity with a sum for every shift, so that rows are not multiplied before they are grouped.
    sums = [F.sum(F.col("weight_h") * (F.col("gap_u") + F.lit(d).cast("long"))).alias(f"t{i}") for i, d in enumerate(deltas)]
    per = scored.groupBy("a").agg(*sums, F.sum(F.col("weight_h") * F.col("gap_u")).alias("t0_"), F.sum("weight_h").alias("w"))
    per = per.select(F.explode(F.array(*[F.struct(F.lit(d).cast("long").alias("delta"), F.col(f"t{i}").alias("t")) for i, d in enumerate(deltas)])).alias("s"), F.col("t0_").alias("t0"), "w").select("s.*", "t0", "w")
    # The order stays if each rate moved by one and the same amount.
    amount = F.col("t") * F.lit(1.0) / F.col("w") - F.col("t0") * F.lit(1.0) / F.col("w")
    out = per.groupBy("delta").agg(F.sum("t").alias("total"), F.sum("t0").alias("t0"), F.sum("w").alias("w"), (F.max(amount) - F.min(amount) < 1e-3).alias("same_order"))
    return out.select("delta", "total", rounded(F.col("total") / F.col("w")).alias("rate"), (F.col("total") - F.col("t0") == F.col("delta") * F.col("w")).alias("moved_by_exposure"), "same_order")


def partner_mass(rows: DataFrame, baseline: int) -> DataFrame:
    """Days-weighted partner scores above a frozen baseline, for each entity of side a."""
    df = rows.where("b_h is not null").groupBy("a").agg(F.sum(F.expr(f"days * (b_h - {baseline})")).alias("mass"), F.sum("days").alias("days"))
    return df.select("a", "mass", "days", rounded(F.col("mass") / F.col("days")).alias("per_day"))


def r_squared(y: str, x: str) -> Column:
    """R squared that is null for fewer than three rows or a constant variable."""
    return F.when((F.count(F.lit(1)) >= 3) & (F.var_pop(y) > 0) & (F.var_pop(x) > 0), rounded(F.regr_r2(F.col(y).cast("double"), F.col(x).cast("double"))))


def tie_groups(ranked_board: DataFrame, value: str, floor: float) -> DataFrame:
    """Consecutive rows closer than the floor form one group."""
    w = Window.partitionBy("side", "domain").orderBy("rank")
    df = ranked_board.withColumn("_new", (F.coalesce(F.lag(value).over(w) - F.col(value), F.lit(floor)) >= floor).cast("int"))
    return df.withColumn("tie_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merged(sources: list[DataFrame], identity: list[Column], order: list[str]) -> DataFrame:
    """Union of sources in which the first to carry an identity keeps it; rows without identity all stay."""
    df = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_rank", F.lit(i))
        df = s if df is None else df.unionByName(s, allowMissingColumns=True)
    df = df.withColumn("_id", F.when(F.greatest(F.lit(0), *[c.isNull().cast("int") for c in identity]) == 0, F.struct(*identity)))
    # Rows without identity are not compared, so they are spread over the windows.
    df = df.withColumn("_spread", F.when(F.col("_id").isNull(), F.xxhash64("source_rank", *order)))
    df = df.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_spread").orderBy("source_rank", *order)))
    return df.withColumn("kept", F.col("_id").isNull() | (F.col("_n") == 1)).drop("_n", "_id", "_spread")


#: Neighbouring places that are ordered in one task when inversions are counted.
RUN = 4096


def inversions(places: DataFrame, before: str, after: str) -> DataFrame:
    """Adds ``inversions``: how many rows stand behind a row by ``before`` but ahead of it by ``after`` (both whole
    numbers from 0, each once).

    Two places differ first at one bit, counted from the highest: a row whose bit is 0 is compared with the rows of the
    same higher bits whose bit is 1. So each pair belongs to one level, and a level needs running counts only, taken in
    runs of ``RUN`` places with the counts of the runs before; no pair is ever made.
    """
    top = places.agg(F.max(before)).first()[0] or 0
    rows = places.select(F.col(before).alias("_p"), F.col(after).alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(max(0, int(top).bit_length() - 1)))).alias("_l"))
    rows = rows.select("_p", "_q", "_l", F.expr("shiftright(_p, _l + 1)").alias("_g"), F.expr("shiftright(_p, _l) & 1").alias("_bit"), F.expr(f"_q div {RUN}").alias("_run"))
    runs = rows.groupBy("_l", "_g", "_run").agg(F.sum("_bit").alias("_n"))
    start = runs.select("_l", "_g", "_run", (F.sum("_n").over(Window.partitionBy("_l", "_g").orderBy("_run")) - F.col("_n")).alias("_s"))  # a row for each run
    own = F.sum("_bit").over(Window.partitionBy("_l", "_g", "_run").orderBy("_q"))
    found = rows.withColumn("_o", own).where("_bit = 0").join(start, ["_l", "_g", "_run"])
    n = found.groupBy("_p").agg(F.sum(F.col("_s") + F.col("_o")).alias("inversions"))
    return places.join(n.withColumnRenamed("_p", before), before, "left").withColumn("inversions", F.coalesce("inversions", F.lit(0).cast("long")))
