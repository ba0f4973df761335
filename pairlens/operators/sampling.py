"""Draws that depend on seeds and ids only, resampling, and snowball expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import rounded


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the digest of its parts, the same in every engine and partitioning."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def normal(*parts: Column) -> Column:
    u, v = uniform(F.lit("u"), *parts), uniform(F.lit("v"), *parts)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def weighted_sample(df: DataFrame, group: str, weight: str, k: int, *seed: Column) -> DataFrame:
    """k rows of each group without replacement, likelier with larger weight: the largest u ** (1 / weight)."""
    w = Window.partitionBy(group).orderBy(F.desc("_key"), *[c for c in df.columns if c != weight][:3])
    return df.withColumn("_key", F.pow(uniform(*seed), 1 / F.col(weight))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_key", "_n")


def interval(coefficients: DataFrame, specs: DataFrame, draws: int, seed: int, alpha: float, publisher_sd: float = 0.0) -> DataFrame:
    """Band of total and rate of each key when every estimate is redrawn.

    ``coefficients``: key, id, c and mirror (whole numbers: what the estimate adds to the key's total, and to that of the
    key with its sides swapped) and exposure (a part of what the total is divided by). ``specs``: id, value, sd, publisher.
    One draw of an id serves all its keys and periods, and one effect of a publisher all its ids. Values are clamped to
    0..100 and kept in hundredths, so totals are whole numbers; the share of clamped draws is reported. ``mirrored``: the
    swapped total of the first draw is the negative of the total. An id without spec is refused.

    A key and an id meet once, not once for each draw, and all draws of an id travel as one array of two-byte numbers to
    the key's task, which alone sums them: partial sums would be wider than what they sum, and as many.
    """
    c = coefficients.groupBy("key", "id").agg(F.sum("c").alias("c"), F.sum("mirror").alias("mirror"), F.sum("exposure").alias("exposure"))
    lost = c.join(specs, "id", "left_anti").select("id").distinct().limit(3).collect()
    if lost:
        raise ValueError(f"estimates without a spec of how far they may move: {', '.join(str(r.id) for r in lost)}")
    each = c.join(drawn(specs, effects(specs, draws, seed, publisher_sd), draws, seed), "id").select("key", "c", "mirror", "exposure", "point", "x", "clamped")
    sums = F.sum(F.col("c") * F.col("point")).alias("point_total"), F.sum("exposure").alias("exposure"), F.sum("clamped").alias("clamped"), F.count(F.lit(1)).alias("ids"), F.sum(F.col("mirror") * F.col("x")[0]).alias("m0")
    return bands(each.repartition("key").groupBy("key").agg(*sums, *[F.sum(F.col("c") * F.col("x")[i]).alias(f"t{i}") for i in range(draws)]), draws, alpha)


#: Publishers whose effects are sent to all tasks; with more, specs and effects are shuffled.
FEW = 10_000


def effects(specs: DataFrame, draws: int, seed: int, publisher_sd: float) -> DataFrame:
    """The effect of each publisher of the specs in each draw: (publisher, effects)."""
    of = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: publisher_sd * normal(F.lit("p"), F.lit(str(seed)), i.cast("string"), F.col("publisher")))
    found = specs.where(F.col("publisher").isNotNull() & F.lit(publisher_sd > 0)).select("publisher").distinct()
    return F.broadcast(found.withColumn("effects", of)) if found.count() <= FEW else found.withColumn("effects", of)


def drawn(specs: DataFrame, effects: DataFrame, draws: int, seed: int) -> DataFrame:
    """The specs with value (``point``) and draws (``x``) in hundredths, held between 0 and 100, and how many were held."""
    rest = [c for c in specs.columns if c not in ("value", "sd", "publisher")]
    raw = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: F.col("value") + F.col("sd") * normal(F.lit(str(seed)), i.cast("string"), F.col("id").cast("string")) + F.coalesce(F.get("effects", i), F.lit(0.0)))
    hundredths = lambda v: F.round(100 * F.least(F.lit(100.0), F.greatest(F.lit(0.0), v)))
    df = specs.join(effects, "publisher", "left").withColumn("raw", raw)
    return df.select(*rest, hundredths(F.col("value")).cast("long").alias("point"), F.transform("raw", lambda v: hundredths(v).cast("short")).alias("x"), F.size(F.filter("raw", lambda v: (v < 0) | (v > 100))).alias("clamped"))


def bands(sums: DataFrame, draws: int, alpha: float) -> DataFrame:
    """Bands of each key from its sums: point_total, exposure, clamped, ids, m0 (the swapped total of draw 0), t0, t1, ..."""
    t = F.array_sort(F.array(*[f"t{i}" for i in range(draws)]))
    low, high = int(alpha / 2 * draws), min(int((1 - alpha / 2) * draws), draws - 1)
    out = sums.select("key", "point_total", "exposure", t[low].alias("total_low"), t[high].alias("total_high"), rounded(F.col("clamped") / (F.col("ids") * draws)).alias("clamped_share"), (F.col("m0") == -F.col("t0")).alias("mirrored"))
    rate = lambda x: rounded(F.col(x) / F.nullif(F.col("exposure"), F.lit(0)))
    return out.select("key", "point_total", rate("point_total").alias("point_rate"), "total_low", "total_high", rate("total_low").alias("rate_low"), rate("total_high").alias("rate_high"), "clamped_share", "mirrored")


def digest_ranks(df: DataFrame, group: str, digest: str, name: str) -> DataFrame:
    """Positions from 0 in the order of a hexadecimal digest, in each group, without ordering a group in one task.

    The first three digits deal rows evenly to 4096 ranges; a range starts after the rows of those before it.
    """
    df = df.withColumn("_b", F.substring(digest, 1, 3))
    n = df.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    start = n.select(group, "_b", (F.sum("_n").over(Window.partitionBy(group).orderBy("_b")) - F.col("_n")).alias("_s"))  # 4096 rows a group
    own = F.row_number().over(Window.partitionBy(group, "_b").orderBy(digest))
    return df.withColumn("_r", own).join(start, [group, "_b"]).withColumn(name, F.col("_s") + F.col("_r") - 1).drop("_b", "_s", "_r")


def coverage_ladder(entities: DataFrame, episodes: DataFrame, first: int, last: int, ladder: list[int], trials: int, bound: int, seed: int) -> DataFrame:
    """Episodes covered on both sides if a source listed k names a period: (k, p10, median, p90) over trials.

    In each trial the ``entities`` (entity) get a popularity order of their own, i-th with weight 1 / (i + 3), and every
    period from ``first`` to ``last`` lists the largest u ** (1 / weight). An episode of ``episodes`` (episode, a, b, period)
    is covered by the k that lists both sides within ``bound`` of one of its periods. All rungs are read from one listing:
    the smallest k of an episode is the larger of its sides' best places.
    """
    spark, most = entities.sparkSession, max(ladder)
    s, trial = F.lit(str(seed)), F.col("trial").cast("string")
    e = entities.select("entity").distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    e = digest_ranks(e.withColumn("h", F.md5(F.concat_ws("|", s, F.lit("order"), trial, F.col("entity").cast("string")))), "trial", "h", "place")
    listed = e.withColumn("period", F.explode(F.sequence(F.lit(first), F.lit(last))))  # every period lists anew
    # u ** (1 / w) orders as -ln(u) / w does the other way round.
    key = -F.log(uniform(s, trial, F.col("period").cast("string"), F.col("entity").cast("string"))) * (F.col("place") + 3)
    top = F.row_number().over(Window.partitionBy("trial", "period").orderBy(key, "entity"))
    listed = listed.select("trial", "entity", F.col("period").alias("src"), top.alias("r")).where(F.col("r") <= most)
    near = episodes.select("episode", "a", "b", "period").distinct()
    sides = near.select("episode", F.struct("a", "b", "period").alias("one"), "period", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("entity")), F.struct(F.lit("b").alias("side"), F.col("b").alias("entity")))).alias("x"))
    sides = sides.select("episode", "one", "x.side", "x.entity", F.explode(F.sequence(F.col("period") - bound, F.col("period") + bound)).alias("src"))
    best = sides.join(listed, ["entity", "src"]).groupBy("trial", "episode", "one").agg(F.min(F.when(F.col("side") == "a", F.col("r"))).alias("x"), F.min(F.when(F.col("side") == "b", F.col("r"))).alias("y"))
    need = best.where("x is not null and y is not null").groupBy("trial", "episode").agg(F.min(F.greatest("x", "y")).alias("need"))
    counts = need.groupBy("trial").agg(*[F.count_if(F.col("need") <= k).alias(f"k{k}") for k in ladder])
    grid = spark.range(trials).select(F.col("id").cast("int").alias("trial")).join(counts, "trial", "left").fillna(0)
    at = lambda i: F.get("c", F.lit(i))
    rungs = grid.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("n")) for k in ladder])).alias("x")).groupBy(F.col("x.k").alias("k")).agg(F.array_sort(F.collect_list("x.n")).alias("c"))
    return rungs.select("k", at(int(0.1 * trials)).alias("p10"), at(trials // 2).alias("median"), at(min(trials - 1, int(0.9 * trials))).alias("p90"))


_ORDER = ("partner", "reach", "prominence")


def admitted(candidates: DataFrame, cap: int, partner: bool = False) -> DataFrame:
    """Half of the cap from each side by rank, then the rest from whoever is left, ties by id.

    Rank goes by reach and prominence; with ``partner`` (a column of 0 and 1) those with a partner edge come first.
    """
    by = [F.desc(c) for c in _ORDER[not partner :]]
    side = Window.partitionBy("side").orderBy(*by, "id")
    first = F.when(F.col("side") == "a", F.lit(cap // 2)).otherwise(F.lit(cap - cap // 2))
    df = candidates.withColumn("r", F.row_number().over(side)).withColumn("first", (F.col("r") <= first).cast("int"))
    order = [F.desc("first"), *by, F.asc("id")]
    best = df.orderBy(*order).limit(cap)  # each task hands on its best only, so at most cap rows are numbered
    return best.withColumn("n", F.row_number().over(Window.orderBy(*order))).drop("r", "first")


def snowball(edges: DataFrame, people: DataFrame, seeds: DataFrame, rounds: int, per_round: int, most: int, converge_at: int, save) -> tuple[DataFrame, list[dict], str]:
    """Entities reached from the seeds, a log entry for each round, and why it stopped.

    ``edges``: kind (partner or other), seed, id. ``people``: id, side (a or b; others are left out), prominence. A round
    expands only what the last one admitted (the first: the seeds); candidates are new ids with a side, a partner edge
    ranks first, then reach (different seeds of this round), prominence, and the smaller id. At most ``per_round`` are
    admitted, half from each side with what is left filled from the other, and ``most`` in all. It stops when rounds are
    exhausted, ``most`` is reached, a round admits fewer than ``converge_at``, or none.

    The roster has id, side, round, partner, reach, prominence. ``save`` writes a table and reads it again.
    """
    sided = people.where("side in ('a', 'b')").select("id", "side", F.col("prominence").cast("double").alias("prominence"))
    start = seeds.select("id").distinct().join(people.select("id", "side", F.col("prominence").cast("double").alias("prominence")), "id", "left")
    roster = save(start.select("id", "side", F.lit(0).alias("round"), F.lit(0).alias("partner"), F.lit(0).cast("long").alias("reach"), "prominence"))
    log: list[dict] = []
    size, why = roster.count(), "rounds exhausted"
    last = size
    for r in range(1, rounds + 1):
        if size >= most:
            why = "most reached"
            break
        frontier = roster.where(F.col("round") == r - 1).select(F.col("id").alias("seed"))
        met = edges.join(F.broadcast(frontier) if last <= 100_000 else frontier, "seed").where("id is not null")
        found = met.groupBy("id").agg(F.max((F.col("kind") == "partner").cast("int")).alias("partner"), F.count_distinct("seed").alias("reach"))
        cands = save(found.join(sided, "id").join(roster.select("id"), "id", "left_anti"))
        n, expanded = cands.count(), last
        new = save(admitted(cands, min(per_round, most - size), partner=True).select("id", "side", F.lit(r).alias("round"), "partner", "reach", "prominence"))
        sides = {x.side: x["count"] for x in new.groupBy("side").count().collect()}
        last = sum(sides.values())
        log.append({"round": r, "expanded": expanded, "candidates": n, "admitted": last, "cut_by_cap": n - last, "admitted_a": sides.get("a", 0), "admitted_b": sides.get("b", 0), "roster": size + last})
        roster = save(roster.unionByName(new))
        size += last
        if last < converge_at:
            why = "converged"
            break
        if not last:
            why = "no frontier"
            break
        if size >= most:
            why = "most reached"
            break
    return roster, log, why
