"""Audits of records against texts: absence of names, evidence against its tables, numbers in prose, and rationales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources import writers as W
from .phrases import NO_WORD, phrase_hits, word_hits


def _save(df: DataFrame) -> DataFrame:
    return W.snapshot(df, W.shared_path(df.sparkSession, "audit"))


def _labels(hits: DataFrame, key: str, name: str) -> DataFrame:
    return hits.groupBy(key).agg(F.array_sort(F.collect_set("label")).alias(name))


def absence_audit(people: DataFrame, have: DataFrame, sources: DataFrame, articles: DataFrame, titles: DataFrame) -> DataFrame:
    """Why entities without evidence have none: (id, name, named_in, surname_only_in, own_article, verdict).

    ``people`` (id, name) without the ids of ``have`` are looked up in ``sources`` (tid, label, t): by full name anywhere
    in a source, else by surname as a whole word; and the ``titles`` (label, title) of the sources in the entity's own
    ``articles`` (tid, id, t). A surname alone is a prompt to look, so it does not count as named.
    """
    missing = _save(people.join(have.select("id").distinct(), "id", "left_anti").select("id", "name"))
    names = missing.select(F.col("name").alias("pid"), F.col("name").alias("q")).where("q <> ''").distinct()
    full = _save(phrase_hits(names, sources, "label").withColumnRenamed("pid", "name"))
    last = _save(names.select(F.col("pid").alias("name"), F.element_at(F.split(F.trim("pid"), r"\s+"), -1).alias("surname")))
    words = last.select(F.col("surname").alias("pid")).distinct()
    plain = word_hits(words.where(~F.col("pid").rlike(NO_WORD)).withColumn("q", F.col("pid")), sources, "label")
    # A surname of several words in the sense of a pattern is found by its longest one and then compared.
    longest = F.array_max(F.transform(F.split("pid", NO_WORD, -1), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    quoted = F.concat(F.lit(r"(?U)\b"), F.regexp_replace("pid", r"([^\w ])", r"\\$1"), F.lit(r"\b"))
    other = word_hits(words.where(F.col("pid").rlike(NO_WORD)).withColumn("q", longest), sources).join(sources.select("tid", "label", "t"), "tid")
    other = other.where(F.call_function("regexp_like", F.col("t"), quoted)).select("pid", "label").distinct()
    surname = last.join(plain.unionAll(other).withColumnRenamed("pid", "surname"), "surname").select("name", "label").join(full, ["name", "label"], "left_anti")
    mine = phrase_hits(titles.select(F.col("label").alias("pid"), F.col("title").alias("q")), articles.join(missing.select("id").distinct(), "id", "left_semi").select("tid", "id", "t"), "id")
    mine = mine.select("id", F.col("pid").alias("label"))
    out = missing.join(_labels(full, "name", "named_in"), "name", "left").join(_labels(surname, "name", "surname_only_in"), "name", "left").join(_labels(mine, "id", "own_article"), "id", "left")
    none = F.array().cast("array<string>")
    out = out.select("id", "name", *[F.coalesce(c, none).alias(c) for c in ("named_in", "surname_only_in", "own_article")])
    return out.withColumn("verdict", F.when((F.size("named_in") == 0) & (F.size("own_article") == 0), "no route").otherwise("named, investigate"))


#: The winner of a block, a ranked link, the first link, and a date.
WINNER, RANKED, LINK, DAY = r"'''\[\[([^\]|]+)", r"\b(\d+)(st|nd|rd|th):\s*\[\[([^\]|]+)", r"\[\[([^\]|]+)", r"\b\d{4}(?:-\d{2}){0,2}\b"


def placed_names(tables: DataFrame) -> DataFrame:
    """(publisher, period, rank, name) that the blocks of ``tables`` (publisher, text) state; rank 0 for the first link.

    A block counts for every date in it and for the month and year of that date. The winner is the first bold link;
    other ranks need their own ordinal ending, and the first line of a rank counts.
    """
    b = tables.select("publisher", F.explode(F.split("text", r"\n\|-", -1)).alias("b"))
    days = F.regexp_extract_all("b", F.lit(DAY), F.lit(0))
    periods = F.array_distinct(F.flatten(F.transform(days, lambda d: F.filter(F.array(F.left(d, F.lit(4)), F.left(d, F.lit(7)), d), lambda p: p != ""))))
    ranks, ends, names = (F.regexp_extract_all("b", F.lit(RANKED), F.lit(g)) for g in (1, 2, 3))
    lines = F.transform(F.arrays_zip(ranks.alias("r"), ends.alias("e"), names.alias("n")), lambda x: F.struct(x["r"].try_cast("int").alias("rank"), F.concat(x["r"], x["e"]).alias("said"), x["n"].alias("name")))
    lines = F.filter(lines, lambda x: (x["rank"] > 1) & (x["said"] == X.ordinal(x["rank"])))
    one = lambda rank, pattern: F.when(F.col("b").rlike(pattern), F.array(F.struct(F.lit(rank).alias("rank"), F.lit("").alias("said"), F.regexp_extract("b", pattern, 1).alias("name")))).otherwise(F.array().cast("array<struct<rank:int,said:string,name:string>>"))
    b = b.select("publisher", periods.alias("periods"), lines.alias("lines"), F.concat(one(1, WINNER), one(0, LINK)).alias("firsts")).where("size(periods) > 0")
    first = F.filter("lines", lambda x, i: ~F.exists(F.slice("lines", 1, i), lambda y: y["rank"] == x["rank"]))
    b = b.select("publisher", "periods", F.explode(F.concat("firsts", first)).alias("x"))
    return b.select("publisher", F.explode("periods").alias("period"), "x.rank", "x.name").distinct()


def source_recheck(evidence: DataFrame, tables: DataFrame, articles: DataFrame) -> DataFrame:
    """(observation_id, kind, status) of every row of evidence (observation_id, kind, publisher, period, rank, name, excerpt, article).

    ``kind`` prose: verified if the excerpt stands in the text of the article (article, t), white space aside. Others:
    verified if a block of the publisher's tables names the entity, letter by letter, at that rank and in that period
    (without rank: as its first link); a publisher without tables is unverifiable, never verified.
    """
    stated = placed_names(tables).withColumn("stated", F.lit(True))
    known = tables.select("publisher").distinct().withColumn("known", F.lit(True))
    listed = evidence.where("kind <> 'prose' or kind is null").withColumn("rank", F.coalesce(F.nullif("rank", F.lit(0)), F.lit(0)))
    listed = listed.join(known, "publisher", "left").join(stated, ["publisher", "period", "rank", "name"], "left")
    listed = listed.select("observation_id", "kind", F.when(F.col("known").isNull(), "unverifiable").when(F.col("stated"), "verified").otherwise("not verified").alias("status"))
    space = lambda c: F.trim(F.regexp_replace(c, X.WHITE, " "))
    prose = evidence.where("kind = 'prose'").join(articles.select("article", "t"), "article", "left")
    # An article has one row, so each excerpt is held against its own article only.
    held = prose.groupBy("observation_id", "kind").agg(F.bool_or(F.contains(space("t"), space("excerpt"))).alias("ok"))
    return listed.unionByName(held.select("observation_id", "kind", F.when(F.col("ok"), "verified").otherwise("not verified").alias("status")))


def claims_audit(docs: DataFrame, rules: list[tuple[str, str, str]], skip: dict[str, list] | None = None) -> tuple[DataFrame, DataFrame]:
    """Numbers in prose against what they should be, by ``rules`` (name, pattern with one group, expected).

    The first table has each place that states another value: (rule, doc_id, line, written, expected, excerpt). The second
    has each rule: (rule, occurrences, mismatches, unmatched); a rule that matches nothing verifies nothing. A blank in a
    pattern stands for any white space. ``skip``: documents that a rule does not apply to.
    """
    df = docs.select("doc_id", "text")
    cols = []
    for name, pattern, expected in rules:
        p = r"\s+".join(pattern.split(" "))
        ok = F.col("text").rlike(p) & ~F.coalesce(F.col("doc_id").isin((skip or {}).get(name, [])), F.lit(False))
        found = F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("m"), F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("g"), F.slice(F.split("text", p, -1), F.lit(1), F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))).alias("b"))
        cols.append(F.struct(F.lit(name).alias("rule"), F.lit(expected).alias("expected"), F.when(ok, found).alias("found")))
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    each = df.select("doc_id", F.xxhash64("text").alias("th"), F.explode(F.array(*cols)).alias("r")).where("r.found is not null").select("doc_id", "th", "r.rule", "r.expected", F.posexplode("r.found").alias("i", "x"))
    # Line ends before a match: in the parts up to it and in the matches before it.
    w = Window.partitionBy("doc_id", "th", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    line = F.sum(lines(F.col("x.b")) + lines(F.col("x.m"))).over(w) - lines(F.col("x.m")) + 1
    each = _save(each.select("doc_id", "rule", line.alias("line"), F.col("x.g").alias("written"), "expected", F.col("x.m").alias("excerpt")))
    names = docs.sparkSession.createDataFrame([(r[0],) for r in rules], "rule string")
    n = each.groupBy("rule").agg(F.count(F.lit(1)).alias("occurrences"), F.count_if(F.col("written") != F.col("expected")).alias("mismatches"))
    zero = F.lit(0).cast("long")
    summary = F.broadcast(names).join(n, "rule", "left").select("rule", F.coalesce("occurrences", zero).alias("occurrences"), F.coalesce("mismatches", zero).alias("mismatches"), F.col("occurrences").isNull().alias("unmatched"))
    return each.where("written <> expected"), summary


#: Claims of a rationale that its evidence must carry.
SEVERAL = r"(?i)\b(?:multiple|several|two|three|both) (?:independent )?(?:publications?|sources?|publishers?|magazines?)\b"
REPEATED = (
    r"(?i)\b(?:year after year|across (?:several|multiple|many) years|in (?:several|multiple) (?:different )?years|"
    r"repeatedly (?:named|recognised|recognized|listed|placed)|on (?:several|multiple) occasions|more than once)\b"
)
REPEATED_SOFT = r"(?i)\b(?:repeated(?:ly)?|consistent(?:ly)?|sustained)\b"
TOP = r"(?i)\b(?:top[- ](?:of[- ]the[- ]list|placement|ten|decile)|number one|first place|winner|headline)\b"
SUPERLATIVE = r"(?i)\b(?:most|greatest|unmatched|without equal|the single)\b"


def rationale_checks(rationales: DataFrame, observations: DataFrame) -> DataFrame:
    """(estimate_id, failures, warnings, passed, needs_read) of every rationale against its evidence.

    ``rationales``: estimate_id, estimate, rationale, cited and dossier (arrays of observation ids). ``observations``:
    estimate_id, observation_id, kind, publisher, source, period, rank, list_length. A failure asserts what the evidence
    cannot carry; a warning asks for a person. Claims count only where no word denies them in their sentence.
    """
    top = (F.col("kind") == "award") | ((F.col("kind") == "rank") & (F.col("list_length") > 0) & (F.coalesce("rank", F.lit(999)) <= F.greatest(F.lit(1), F.floor(F.col("list_length") / 10))))
    several = lambda c: F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))  # noqa: E731  an unstated one counts as one more
    of = observations.groupBy("estimate_id").agg(
        several("source").alias("sources"), F.count_distinct("publisher").alias("publishers"), several("period").alias("periods"), F.bool_or(F.coalesce(top, F.lit(False))).alias("top"),
    )
    df = rationales.join(of, "estimate_id", "left").fillna(0, ["sources", "publishers", "periods"]).withColumn("top", F.coalesce("top", F.lit(False)))
    cited = F.coalesce("cited", F.array().cast("array<string>"))
    text = F.coalesce("rationale", F.lit(""))
    says = lambda p: X.asserted(text, p)
    repeats = says(REPEATED)
    unknown = F.exists(cited, lambda c: ~F.coalesce(F.array_contains("dossier", c), F.lit(False)))
    failures: list[tuple[str, Column]] = [
        ("cites nothing", F.size(cited) == 0),
        ("cites what is not in the dossier", unknown),
        ("names none of the ids it cites", (F.size(cited) > 0) & ~F.exists(cited, lambda c: F.contains(text, c))),
        ("claims several sources", says(SEVERAL) & (F.col("sources") < 2)),
        ("claims repetition", repeats & (F.col("periods") < 2)),
        ("claims a top placement", says(TOP) & ~F.col("top")),
    ]
    warnings: list[tuple[str, Column]] = [
        ("words of repetition on one period", ~repeats & text.rlike(REPEATED_SOFT) & (F.col("periods") < 2)),
        ("superlative on one publisher", text.rlike(SUPERLATIVE) & (F.col("publishers") < 2)),
        ("top estimate from one source", F.coalesce(F.col("estimate") >= 90, F.lit(False)) & (F.col("sources") < 2)),
    ]
    named = lambda rules: F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))
    df = df.select("estimate_id", named(failures).alias("failures"), named(warnings).alias("warnings"))
    return df.select("estimate_id", "failures", "warnings", (F.size("failures") == 0).alias("passed"), (F.size("failures") + F.size("warnings") > 0).alias("needs_read"))


#: Characters of a sentence that is quoted, and sentences quoted from each side.
SENTENCE, EXCERPTS = 320, 2


def corroborate(episodes: DataFrame, articles: DataFrame) -> DataFrame:
    """(episode, label, stored, found, sides, excerpts): what both sides' articles say about an episode's years.

    ``episodes``: episode, a, b, a_name, b_name, stored (array of years). ``articles``: id, t, one row each. Each article
    is read for the other's name; sentences of up to ``SENTENCE`` characters count. Labels, never verdicts: not mentioned,
    mentioned without year, no stored date, prose confirms a stored year, prose names other years.
    """
    sides = F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("id"), F.col("b_name").alias("about")), F.struct(F.lit("b").alias("side"), F.col("b").alias("id"), F.col("a_name").alias("about")))
    read = episodes.select("episode", F.explode(sides).alias("x")).select("episode", "x.*").join(articles.select("id", "t"), "id", "left")
    read = read.withColumn("n", X.sentences_naming(F.col("t"), F.col("about")))
    short = F.filter("n.hits", lambda h: F.length(h) <= SENTENCE)
    read = read.select("episode", "side", F.col("n.how").alias("how"), short.alias("hits"))
    quoted = F.transform(F.slice("hits", 1, EXCERPTS), lambda h: F.concat(F.col("side"), F.lit(": "), h))
    per = read.groupBy("episode").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.collect_list(F.concat_ws(":", "side", "how", F.size("hits")))).alias("sides"), F.array_sort(F.flatten(F.collect_list(quoted))).alias("excerpts"),
    )
    df = episodes.select("episode", F.array_sort(F.array_distinct(F.transform("stored", lambda y: y.cast("string")))).alias("stored")).join(per, "episode").withColumn("found", X.years_of(F.col("hits")))
    label = F.when(F.size("hits") == 0, "not mentioned").when(F.size("found") == 0, "mentioned without year").when(F.coalesce(F.size("stored"), F.lit(0)) <= 0, "no stored date").when(F.arrays_overlap("found", "stored"), "prose confirms a stored year")
    return df.select("episode", label.otherwise("prose names other years").alias("label"), "stored", "found", "sides", "excerpts")


def identity_verdicts(people: DataFrame, known: DataFrame) -> DataFrame:
    """(id, name, verdict) of every person (id, name) against what a register (id, human, name) says under the id.

    missing, not human, no name, exact, exact after disambiguator (a bracket at the end of the register's name), mismatch.
    """
    k = known.select("id", F.col("name").alias("_n"), "human", F.lit(True).alias("_k"))
    df = people.select("id", "name").join(k, "id", "left")
    verdict = F.when(F.col("_k").isNull(), "missing").when(~F.coalesce("human", F.lit(False)), "not human").when(F.coalesce("_n", F.lit("")) == "", "no name").when(F.col("_n") == F.col("name"), "exact")
    return df.select("id", "name", verdict.when(X.without_disambiguator(F.col("_n")) == F.col("name"), "exact after disambiguator").otherwise("mismatch").alias("verdict"))
