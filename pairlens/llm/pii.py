"""Personal data: fixed shapes, and identifiers found by bootstrapped contextual extraction.

Base kinds are regular expressions with checks (address parts, Luhn digits, digit counts). Their occurrences are the
seeds. A lexical pattern is the pair of words before an identifier-like token (one with a digit or an at sign); a
pattern that ``min_seeds`` different believed tokens induce joins a graph of patterns and tokens, at first from seeds.
Scores go around the graph in rounds: a pattern is worth the share of all its occurrences in the corpus that precede
believed tokens, a token is believed as far as its best evidence says (seeds fully, others by the product of doubts).
Tokens that come to be believed by ``confidence`` or more count with the seeds in the next round and induce further
patterns. Tokens after patterns worth ``confidence`` or more are added as ``context`` spans. No limit depends on the
size of the corpus; a pair of words that mostly precedes other words is worth little, so chance contexts add nothing.

All of it is DataFrame functions; the corpus is read once for spans, once for the occurrences of the first patterns, and
once more in a round that induces further ones. Word pairs are held against the patterns where the text lies and only
those of patterns are counted: up to ``INLINE`` patterns are a set inside the filter, more are broadcast while they are
fewer than ``BROADCAST_PATTERNS`` (8 bytes each), and beyond that pairs are counted first and joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPANS, Scratch, let, match_spans, span_text

#: The base kinds in order, and what they match. Repetitions are possessive, so the matcher needs no
#: stack for long texts; an email or address may start where a run of its characters starts or a match has ended.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Identifier-like tokens: words of 6 or more characters with a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*[0-9@])[^\x20\x09-\x0D]{6,}+"
INLINE, BROADCAST_PATTERNS = 20_000, 200_000
BASE = "array<struct<o:int,s:int,e:int,k:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    value = lambda c, i: let(c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def _tagged(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(order).alias("o"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k")))


def base_spans(text: Column) -> Column:
    """Base spans of a text in order of kind, then start."""
    parts = lambda x: F.forall(F.split(x["m"], r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    card = lambda x: let(_digits(x["m"]), lambda d: F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    phone = lambda x: F.length(_digits(x["m"])).between(8, 15)
    found = (match_spans(text, EMAIL), F.filter(match_spans(text, IP), parts), F.filter(match_spans(text, CARD), card), F.filter(match_spans(text, PHONE), phone))
    return F.array_sort(F.concat(*[_tagged(x, i, k) for i, (k, x) in enumerate(zip(KINDS, found))]))


def _pattern(first: Column, second: Column) -> Column:
    plain = lambda w: F.translate(F.lower(w), "123456789", "0" * 9)
    return F.xxhash64(plain(first), plain(second))


def _tokens(text: Column) -> Column:
    """Identifier-like tokens without quotes and punctuation around them, and the pattern before each (or null)."""
    trimmed = lambda x: let(F.length(F.regexp_extract(x["m"], r"""^["'(\[{<]*+""", 0)), lambda a: let(F.length(F.regexp_replace(x["m"], r"""[.,;:!?"')\]}>]++$""", "")), lambda b: F.struct((x["s"] + a).alias("s"), (x["s"] + F.greatest(a, b)).alias("e"), F.substring(x["m"], a + 1, F.greatest(b - a, F.lit(0))).alias("m"))))
    # The words before a token are the last of the part between it and the token before.
    parts = F.transform(F.split(text, TOKEN, -1), lambda p: let(F.trim(p, F.lit(" \t\n\x0b\x0c\r")), lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(let(F.split(t, SPACE, -1), lambda w: F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), 2)))))
    return F.when(
        text.rlike(TOKEN),
        F.zip_with(F.transform(match_spans(text, TOKEN), trimmed), parts, lambda x, p: F.when(x.isNotNull(), F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.when(F.size(p) == 2, _pattern(p[0], p[1])).alias("p")))),
    ).otherwise(F.array().cast("array<struct<s:int,e:int,m:string,p:bigint>>"))


def _few(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _occurrences(pairs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(p, total): how often each pattern (p) stands among all word pairs (p)."""
    n, counted = patterns.count(), F.count(F.lit(1)).alias("total")
    if n <= INLINE:
        known = ",".join(f"{r.p}L" for r in patterns.select("p").collect())  # a bounded number of hashes, as in a broadcast
        return pairs.where(F.expr(f"p in ({known})") if n else F.lit(False)).groupBy("p").agg(counted)
    if n <= BROADCAST_PATTERNS:
        return pairs.join(F.broadcast(patterns), "p", "left_semi").groupBy("p").agg(counted)
    return pairs.groupBy("p").agg(counted).join(patterns, "p", "left_semi")


def find_pii(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_seeds: int = 5,
    rounds: int = 4,
    confidence: float = 0.5,
) -> DataFrame:
    """(id, th, base, spans): all base spans and all spans, with found contexts, of every row.

    Null or empty text: none. Ids may be null or repeat; rows of one id and text get the same spans. Positions count
    code points, ends are exclusive. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    df = scratch.save(src.select("id", F.xxhash64("text").alias("th"), base_spans(F.col("text")).alias("base"), F.filter(_tokens(F.col("text")), lambda x: x.isNotNull() & (x["e"] - x["s"] >= 6)).alias("t")))
    hits = F.exists("base", lambda b: (b["s"] < F.col("x.e")) & (b["e"] > F.col("x.s")))
    seen = df.where(F.size("t") > 0).select("id", "th", "base", F.explode("t").alias("x")).where(F.col("x.p").isNotNull())
    seen = scratch.save(seen.select("id", "th", "x.s", "x.e", F.col("x.p").alias("p"), F.xxhash64("x.m").alias("m"), hits.alias("seed")))
    held = scratch.save(seen.groupBy("p", "m").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("seed").cast("int")).alias("seed")))
    seeds = scratch.save(held.where("seed = 1").select("m").distinct())
    seeded = scratch.save(held.where("seed = 1").groupBy("p").agg(F.count(F.lit(1)).alias("k")))
    # How often a pattern stands anywhere in the corpus.
    trimmed = F.trim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    pairs = src.select(F.split(trimmed, SPACE, -1).alias("w"))
    pairs = pairs.select(F.explode(F.transform("w", lambda w, i: F.when(i > 0, _pattern(F.get("w", i - 1), w)))).alias("p")).where(F.col("p").isNotNull())
    new = scratch.save(seeded.where(F.col("k") >= min_seeds).select("p"))
    total = new.withColumn("total", F.lit(0).cast("long"))
    if new.limit(1).count():
        total = scratch.save(_occurrences(pairs, new))
    belief = seeds.withColumn("s", F.lit(1.0))
    for turn in range(rounds):
        edges = scratch.save(held.join(_few(total, BROADCAST_PATTERNS), "p"))
        worth = edges.join(belief, "m").groupBy("p", "total").agg(F.sum(F.col("n") * F.col("s")).alias("good"))
        worth = scratch.save(worth.select("p", F.least(F.lit(0.999), F.col("good") / F.greatest("total", F.lit(1))).alias("w")))
        doubt = edges.where("seed = 0").join(worth, "p").groupBy("m").agg(F.sum(F.log(1 - F.col("w"))).alias("d"))
        found = scratch.save(doubt.select("m", (1 - F.exp("d")).alias("s")).join(seeds, "m", "left_anti"))
        belief = seeds.withColumn("s", F.lit(1.0)).unionAll(found)
        if turn == rounds - 1:
            break
        # Patterns that seeds and tokens believed by now induce together.
        believed = found.where(F.col("s") >= confidence).select("m")
        more = held.where("seed = 0").join(_few(believed, BROADCAST_PATTERNS), "m").groupBy("p").agg(F.count(F.lit(1)).alias("j"))
        more = more.join(seeded, "p", "left").where(F.col("j") + F.coalesce("k", F.lit(0)) >= min_seeds).select("p")
        new = scratch.save(more.join(total, "p", "left_anti"))
        if new.limit(1).count():
            total = scratch.save(total.unionByName(_occurrences(pairs, new)))
    good = scratch.save(worth.where(F.col("w") >= confidence).select("p"))
    new = seen.where("not seed").join(_few(good, BROADCAST_PATTERNS), "p").select("id", "th", F.struct(F.lit(4).alias("o"), "s", "e", F.lit("context").alias("k")).alias("x"))
    new = scratch.save(new.groupBy("id", "th").agg(F.collect_set("x").alias("more")).select(F.col("id").alias("rid"), F.col("th").alias("rth"), "more"))
    out = df.drop("t").join(new, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left")
    return out.select("id", "th", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(BASE)))).alias("spans"))


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context, n_spans) of every row; see ``find_pii``."""
    out = find_pii(docs, id_col, text_col)
    count = lambda kind, of: F.size(F.filter(of, lambda x: x["k"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        F.col("id").alias("doc_id"), *[count(k, "base") for k in KINDS], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"), count("context", "spans"), F.size("spans").cast("long").alias("n_spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        put = F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit("["), F.upper(x["k"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], put).otherwise(a["out"]).alias("out"))

    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    whole = F.aggregate(by_start, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
