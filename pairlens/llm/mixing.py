"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: shares by weight of the budget, held to ``most`` times the source's own
words, with the excess going to the others by weight. Within a source longer documents are wanted more often: the
expected copies of a document go by its class of length (the binary logarithm of its words, plus ``LEAN``), held to
``most``, so that the expected words of all are the source's target. The whole part of the expected copies is certain;
the rest is the document's inclusion probability p. For that rest, the documents of a source are ranked by the odds of a
uniform number over the odds of their p, and the lowest ranks are taken until their words come nearest to what remains
of the target: a sample of fixed size in words with unequal probabilities.

The uniform number is a digest of seed and id (of the text where the id is null), so reruns agree. The cut is found from
sums over ranges of the rank for each source, twice ``BINS``-fold; only documents in the one range that holds a source's
cut are ordered, equal rows as one. Sources themselves are ranked in one task: a row each, not a row for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, Scratch

#: Weights of the sources in order, repeating; the budget as a multiple of all words; most copies.
WEIGHTS, BUDGET, MOST = (3, 1, 2), 1.5, 2
LEAN = 4
BINS = 4096
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in order of code points, null last, take the weights in turn. Where every share is held, all get the most.
    The targets equal those of handing the excess on again and again: sorted by room for each unit of weight, a first
    part is held and the rest share evenly by weight.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("w", w).withColumn("room", most * F.col("source_size"))
    by_room = Window.orderBy(F.col("room") / F.col("w"), F.asc_nulls_last("source"))
    before, rest = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) * budget - F.coalesce(F.sum("room").over(before), F.lit(0))
    df = df.withColumn("level", left / F.sum("w").over(rest)).withColumn("pos", F.row_number().over(by_room))
    fits = F.when(F.col("level") * F.col("w") <= F.col("room"), F.col("pos"))
    first = F.min(fits).over(Window.partitionBy())
    df = df.withColumn("first", first)
    df = df.withColumn("common", F.max(F.when(F.col("pos") == F.col("first"), F.col("level"))).over(Window.partitionBy()))
    target = F.when(F.col("first").isNull() | (F.col("pos") < F.col("first")), F.col("room").cast("double")).otherwise(F.col("w") * F.col("common"))
    return df.select("source", "source_size", target.alias("target"))


def _word_count(text: Column) -> Column:
    trimmed = F.trim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, SPACE, -1))).cast("long")


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *more: Column) -> DataFrame:
    """(doc_id, source, size, th, class, u) of every row: words, hash of the text, class of length, uniform number."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    id_ = F.col(id_col).cast("long")
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(id_.cast("string"), F.md5(text.cast("binary")))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    df = docs.select(id_.alias("doc_id"), F.col(source_col).cast("string").alias("source"), _word_count(F.col(text_col)).alias("size"), F.xxhash64(text).alias("th"), u.alias("u"), *more)
    return df.withColumn("class", (F.length(F.bin("size")) + (LEAN - 1)).cast("int"))


def class_copies(cells: DataFrame, most: int = MOST) -> DataFrame:
    """(source, class, words, target, expected): copies that a document of the class may expect.

    Classes share their source's target by class times words, none above ``most``: from the highest class on, a first
    part is held and the rest share evenly.
    """
    by_class = Window.partitionBy("source").orderBy(F.desc("class"))
    before, rest = by_class.rowsBetween(Window.unboundedPreceding, -1), by_class.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))
    df = cells.withColumn("level", left / F.greatest(F.sum(F.col("class") * F.col("words")).over(rest), F.lit(1)))
    df = df.withColumn("common", F.max(F.when(F.col("level") * F.col("class") <= most, F.struct("class", "level"))).over(Window.partitionBy("source")))
    free = F.col("class") <= F.col("common.class")
    expected = F.when(free, F.col("common.level") * F.col("class")).otherwise(F.lit(float(most)))
    return df.select("source", "class", "words", "source_size", "target", expected.alias("expected"))


def _ranked(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with their class's plan, the rank ``q`` (odds over odds; null where nothing is left to chance) and its range."""
    odds = lambda x: x / (1 - x)
    keys = F.col("source").eqNullSafe(F.col("key")) & (F.col("class") == F.col("key_class"))
    df = rows.join(classes, keys).drop("key", "key_class")
    q = F.when((F.col("p") > 0) & (F.col("size") > 0), F.try_divide(odds(F.col("u")), odds(F.col("p"))))
    df = df.withColumn("q", q)
    at = F.least(F.floor(F.col("q") / (1 + F.col("q")) * (BINS * BINS)), F.lit(BINS * BINS - 1)).cast("int")
    return df.withColumn("bin", F.when(F.col("q").isNotNull(), at))


def _cut(sums: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, bin, before) of the range in which the words taken reach the rest, from (source, bin, words)."""
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("words").over(upto)).join(plan, F.col("source").eqNullSafe(F.col("key")))
    at = F.col("before") + F.col("upto")
    found = sums.where(at >= F.col("rest")).groupBy("key").agg(F.min(F.struct("bin", (at - F.col("words")).alias("before"), "rest")).alias("c"))
    return found.select("key", "c.*")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def _plan(rows: DataFrame, scratch: Scratch, weights: tuple[int, ...], budget: float, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A row for each source and class; a row for each source's cut; rows at a cut (equal ones once) with how many of them are taken."""
    cells = scratch.save(rows.groupBy("source", "class").agg(F.sum("size").alias("words")))
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, most)
    targets = targets.withColumnRenamed("source", "key")
    classes = class_copies(cells.join(targets, F.col("source").eqNullSafe(F.col("key"))).drop("key"), most)
    classes = classes.withColumn("whole", F.floor("expected").cast("int")).withColumn("p", F.col("expected") - F.col("whole"))
    classes = scratch.save(classes.withColumnRenamed("source", "key").withColumnRenamed("class", "key_class"))
    sources = classes.groupBy("key").agg((F.max("target") - F.sum(F.col("whole") * F.col("words"))).alias("rest"), F.lit(0).cast("long").alias("before"))
    plan = _few(classes.drop("words", "expected"))
    ranked = _ranked(rows, plan).where(F.col("bin").isNotNull())
    coarse = ranked.groupBy("source", F.floor(F.col("bin") / BINS).cast("int").alias("bin")).agg(F.sum("size").alias("words"))
    coarse = scratch.save(_cut(coarse, _few(scratch.save(sources))).withColumnRenamed("bin", "part"))
    inside = ranked.join(_few(coarse), F.col("source").eqNullSafe(F.col("key")) & (F.floor(F.col("bin") / BINS).cast("int") == F.col("part")))
    inside = scratch.save(inside.groupBy("doc_id", "source", "size", "th", "q", "bin").agg(F.count(F.lit(1)).alias("n")))
    cuts = scratch.save(_cut(inside.groupBy("source", "bin").agg(F.sum(F.col("size") * F.col("n")).alias("words")), _few(coarse)))
    edge = inside.join(_few(cuts.withColumnRenamed("bin", "cut")), F.col("source").eqNullSafe(F.col("key")) & (F.col("bin") == F.col("cut")))
    by_rank = Window.partitionBy("source").orderBy("q", "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("at", F.col("before") + F.sum(F.col("size") * F.col("n")).over(by_rank) - F.col("size") * F.col("n"))
    fit = F.least(F.col("n"), F.greatest(F.lit(0), F.floor((F.col("rest") - F.col("at")) / F.col("size"))))
    edge = edge.withColumn("fit", fit).withColumn("upto", F.col("at") + F.col("fit") * F.col("size"))
    nearer = (F.col("fit") < F.col("n")) & (F.col("upto") < F.col("rest")) & (F.col("upto") + F.col("size") - F.col("rest") < F.col("rest") - F.col("upto"))
    edge = edge.withColumn("take", (F.col("fit") + nearer.cast("int")).cast("long")).where("take > 0")
    edge = edge.select(F.col("doc_id").alias("e_id"), F.col("source").alias("e_source"), F.col("size").alias("e_size"), F.col("th").alias("e_th"), "n", "take")
    return plan, cuts.select(F.col("key").alias("c_source"), F.col("bin").alias("cut")), scratch.save(edge)


def _copied(rows: DataFrame, parts: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """``rows`` with source_size, target and copies."""
    plan, cuts, edge = parts
    df = _ranked(rows, plan).join(_few(cuts), F.col("source").eqNullSafe(F.col("c_source")), "left")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("doc_id", "e_id"), ("source", "e_source"), ("size", "e_size"), ("th", "e_th"))]
    df = df.join(_few(edge), same[0] & same[1] & same[2] & same[3] & (F.col("bin") == F.col("cut")), "left")
    taken = F.when(F.col("bin").isNull(), False).when(F.col("cut").isNull() | (F.col("bin") < F.col("cut")), True).otherwise(F.col("take") == F.col("n"))
    if edge.where("take < n").limit(1).count():
        # Some of a group of equal rows are taken: numbers go through the partitions, so no task holds the group.
        df = df.withColumn("part", F.spark_partition_id())
        some = df.where("bin = cut and take < n")
        name = ["e_id", "e_source", "e_th"]
        each = some.groupBy("part", *name).agg(F.count(F.lit(1)).alias("rows"))
        each = each.withColumn("first", F.sum("rows").over(Window.partitionBy(*name).orderBy("part")) - F.col("rows"))
        each = each.select(F.col("part").alias("f_part"), *[F.col(c).alias("f" + c[1:]) for c in name], "first")
        own = F.row_number().over(Window.partitionBy("part", *name).orderBy("size"))
        ranked = some.withColumn("own", own).join(_few(each), (F.col("part") == F.col("f_part")) & F.col("e_id").eqNullSafe(F.col("f_id")) & F.col("e_source").eqNullSafe(F.col("f_source")) & F.col("e_th").eqNullSafe(F.col("f_th")))
        ranked = ranked.withColumn("chosen", F.col("first") + F.col("own") <= F.col("take")).drop("own", "first", "f_part", "f_id", "f_source", "f_th")
        df = df.where("not coalesce(bin = cut and take < n, false)").withColumn("chosen", F.coalesce(taken, F.lit(False))).unionByName(ranked)
    else:
        df = df.withColumn("chosen", F.coalesce(taken, F.lit(False)))
    return df.withColumn("copies", F.col("whole") + F.col("chosen").cast("int"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    most: int = MOST,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row.

    Null text has size 0, null source is a source of its own. Ids may be null or repeat: rows of one id draw the same
    number, rows without id draw by text; of rows equal in id, source and text at a cut, as many are taken as fit.
    Documents without words are taken whole times only. Other columns are ignored; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.save(_rows(docs, id_col, text_col, source_col, seed))
    out = _copied(rows, _plan(rows, scratch, weights, budget, most))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as ``mix_sources`` takes it, with the columns of ``docs``.

    Texts stay where they are: a row needs its source's plan and, at a cut, its own decision, both joined to it.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    parts = _plan(scratch.save(_rows(docs, id_col, text_col, source_col, seed)), scratch, WEIGHTS, BUDGET, MOST)
    out = _copied(_rows(docs, id_col, text_col, source_col, seed, F.struct("*").alias("row")), parts)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(MOST + 1)))).where(F.col("copy") <= F.col("copies")).select("row.*")
