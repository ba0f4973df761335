"""Secret scans: fixed shapes, and tokens that a battery of randomness tests cannot tell from random keys.

Base kinds are regular expressions. Runs of token characters are split at inner ``=``; a part that mixes the signs of
base 64 and its URL form gives the parts that fit either, which may overlap and are all tested. Every further token of
``MIN_LENGTH`` or more characters with letters and digits, or of ``PLAIN_LENGTH`` or more with letters alone, gets the
smallest alphabet that fits it (hexadecimal, letters, base 32, 36, 62 or 64) and three tests of "drawn evenly and independently from this alphabet": chi-squared uniformity, runs above
and below the alphabet's middle, and serial correlation of neighbours. Short tokens leave most cells of the alphabet
empty; the chi-squared statistic is therefore used as what it counts, the number of equal pairs, on the square-root scale
that makes its law near normal for few and many pairs. The three p-values combine by Sidak's rule.

Two rules act within each class of length (tokens without digits have classes of their own). Benjamini and Hochberg's step-up rule sets aside structured tokens and bounds
the share of true keys among those. True keys have p-values spread evenly from 0 to 1 and structured tokens have small
ones, so the tokens above ``HALF`` tell how many keys a class holds; the second rule reports from the largest p down only
as far as the tokens beyond that number, over all reported, stay within the same level. That bounds the share of
structured tokens among the ``random`` spans that are added.

All of it is DataFrame functions. The step-up rule needs only a histogram of p-values for each length class, which has
a fixed number of cells however many tokens there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, match_spans, span_text

#: The base kinds in order, and what they match.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"

TOKEN = r"[A-Za-z0-9+/_=-]{20,}+"
#: Letters alone are tested from a length on at which the tests tell most words and names from keys.
MIN_LENGTH, PLAIN_LENGTH = 20, 32
#: Parts of a run between its inner ``=``, and the parts of those that mix both pairs of signs. Padding ends the run.
PART = r"[A-Za-z0-9+/_-]{20,}+(?:=++$)?+"
MIXED, PIECES = "[+/].*[_-]|[_-].*[+/]", (r"[A-Za-z0-9+/]{20,}+(?:=++$)?+", r"[A-Za-z0-9_-]{20,}+(?:=++$)?+")
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: Inferred encodings, smallest first: what the token must match, and the alphabet in order.
ENCODINGS = (
    ("[0-9a-f]+", DIGITS + LOWER[:6]),
    ("[0-9A-F]+", DIGITS + UPPER[:6]),
    ("[a-z]+", LOWER),
    ("[A-Z]+", UPPER),
    ("[A-Za-z]+", UPPER + LOWER),
    ("[A-Z2-7]+", UPPER + "234567"),
    ("[0-9a-z]+", DIGITS + LOWER),
    ("[0-9A-Z]+", DIGITS + UPPER),
    ("[0-9A-Za-z]+", DIGITS + UPPER + LOWER),
    ("[0-9A-Za-z+/]+", UPPER + LOWER + DIGITS + "+/"),
    ("[0-9A-Za-z_-]+", UPPER + LOWER + DIGITS + "-_"),
)
#: Steps of a histogram of -log10 p, and the cells whose p-values are above a half (10 ** (-HALF / STEP)).
STEP, HALF = 20, 6

BASE = "array<struct<s:int,o:int,e:int,k:string>>"


def _tagged(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("k")))


def base_spans(text: Column) -> Column:
    """Base spans of a text in order of start, then kind."""
    assign = F.filter(match_spans(text, ASSIGN, 2), lambda x: F.length(x["m"]) >= 8)
    return F.array_sort(F.concat(_tagged(assign, 0, "assign"), _tagged(match_spans(text, ACCESS), 1, "access"), _tagged(match_spans(text, HEX), 2, "hex")))


def two_sided(z: Column) -> Column:
    """P(|Z| > |z|) of the normal law, by the rational form 7.1.26 of Abramowitz and Stegun (error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def token_tests(tokens: DataFrame) -> DataFrame:
    """Adds n, plain (no digits), alphabet, p_chi, p_runs, p_serial and p to a column ``t`` of tokens; tokens of no alphabet go."""
    tokens = tokens.withColumn("plain", ~F.col("t").rlike("[0-9]"))
    alphabet = F.coalesce(*[F.when(F.col("t").rlike(f"^{r}$"), F.lit(a)) for r, a in ENCODINGS])
    df = tokens.withColumn("alphabet", alphabet).where(F.col("alphabet").isNotNull()).withColumn("n", F.length("t"))
    k = F.length("alphabet").cast("double")
    n = F.col("n").cast("double")
    counts = F.transform(F.split("alphabet", ""), lambda c: F.col("n") - F.length(F.replace(F.col("t"), c, F.lit(""))))
    df = df.withColumn("pairs", F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * (c - 1)) / 2)
    # Which half of the alphabet each character is in, as a text of 0 and 1.
    halves = F.concat(F.repeat(F.lit("0"), F.floor(k / 2).cast("int")), F.repeat(F.lit("1"), F.ceil(k / 2).cast("int")))
    df = df.withColumn("half", F.call_function("translate", F.col("t"), F.col("alphabet"), halves))
    df = df.withColumn("ones", F.col("n") - F.length(F.replace("half", F.lit("1"), F.lit(""))))
    df = df.withColumn("runs", F.length(F.regexp_replace("half", "0++|1++", "x")))
    df = df.withColumn("x", F.transform(F.split("t", ""), lambda c: F.call_function("instr", F.col("alphabet"), c).cast("double")))
    df = df.withColumn("mean", F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / n)
    df = df.withColumn("ss", F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))))
    near = F.transform("x", lambda v, i: (v - F.col("mean")) * (F.coalesce(F.get("x", i + 1), F.col("mean")) - F.col("mean")))
    df = df.withColumn("r", F.when(F.col("ss") > 0, F.aggregate(near, F.lit(0.0), lambda a, v: a + v) / F.col("ss")).otherwise(1.0))
    even = n * (n - 1) / (2 * k)
    z_chi = 2 * (F.sqrt(F.col("pairs") + 0.375) - F.sqrt(even + 0.375)) / F.sqrt(1 - 1 / k)
    mu = 2.0 * F.col("ones") * (n - F.col("ones")) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    df = df.withColumn("p_chi", two_sided(z_chi))
    df = df.withColumn("p_runs", F.when(var > 0, two_sided((F.col("runs") - mu) / F.sqrt(var))).otherwise(0.0))
    df = df.withColumn("p_serial", two_sided((F.col("r") + 1 / n) * F.sqrt(n)))
    return df.withColumn("p", 1 - F.pow(1 - F.least("p_chi", "p_runs", "p_serial", F.lit(1.0)), F.lit(3.0))).drop("pairs", "half", "ones", "runs", "x", "mean", "ss", "r")


def random_tokens(tests: DataFrame, q: float) -> DataFrame:
    """Rows of ``token_tests`` that both rules, at level q within each class of length, leave as random."""
    df = tests.withColumn("c", (F.least(F.floor(F.log2(F.col("n").cast("double"))), F.lit(12)) + F.when(F.col("plain"), 16).otherwise(0)).cast("int"))
    df = df.withColumn("b", F.floor(-F.log10(F.greatest("p", F.lit(1e-12))) * STEP).cast("int"))
    cells = df.groupBy("c", "b").agg(F.count(F.lit(1)).alias("n_b"))  # at most 2 * 13 * 241 rows
    of = Window.partitionBy("c")
    cells = cells.withColumn("rank", F.sum("n_b").over(of.orderBy(F.desc("b")))).withColumn("m", F.sum("n_b").over(of))
    cells = cells.withColumn("kept", F.sum("n_b").over(of.orderBy("b"))).withColumn("high", F.sum(F.when(F.col("b") < HALF, F.col("n_b")).otherwise(0)).over(of))
    aside = F.pow(F.lit(10.0), -F.col("b") / STEP) <= q * F.col("rank") / F.col("m")
    # Keys expected among the tokens of this cell and those above it (one more is granted, for classes of few tokens).
    least = F.pow(F.lit(10.0), -(F.col("b") + 1) / STEP)
    keys = (F.col("high") + 1) * (1 - least) / (1 - F.pow(F.lit(10.0), F.lit(-HALF / STEP)))
    sure = (F.col("b") < HALF) | (F.col("kept") - keys <= q * F.col("kept"))
    cut = cells.groupBy("c").agg(F.min(F.when(aside, F.col("b"))).alias("cut"), F.max(F.when(sure, F.col("b"))).alias("last"))
    df = df.join(F.broadcast(cut), "c").where((F.col("cut").isNull() | (F.col("b") < F.col("cut"))) & (F.col("b") <= F.col("last")))
    return df.drop("c", "b", "cut", "last")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.05) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, n_spans) for every row.

    Null or empty text: no spans, digest of the empty string. Ids may be null or repeat (rows of one id and text get
    the same spans). Positions count code points, ends are exclusive; the span of ``assign`` is its whole match.
    Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    df = df.select("id", F.xxhash64("text").alias("th"), base_spans(F.col("text")).alias("base"), match_spans(F.col("text"), TOKEN).alias("t"))
    mixed = lambda x: x["m"].rlike("[A-Za-z]") & (x["m"].rlike("[0-9]") | (F.length(x["m"]) >= PLAIN_LENGTH))
    apart = lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"]))
    df = scratch.save(df.withColumn("t", F.filter("t", mixed)))
    tokens = df.where(F.size("t") > 0).select("id", "th", "base", F.explode("t").alias("t"))
    tokens = tokens.select("id", "th", "base", F.col("t.s").alias("at"), F.explode(match_spans(F.col("t.m"), PART)).alias("t"))
    pieces = F.array_distinct(F.concat(*[match_spans(F.col("t.m"), r) for r in PIECES]))
    pieces = F.when(F.col("t.m").rlike(MIXED), pieces).otherwise(F.array(F.struct(F.lit(0).alias("s"), F.length("t.m").alias("e"), F.col("t.m").alias("m"))))
    tokens = tokens.select("id", "th", "base", (F.col("at") + F.col("t.s")).alias("at"), F.explode(pieces).alias("t"))
    tokens = tokens.select("id", "th", "base", F.struct((F.col("at") + F.col("t.s")).alias("s"), (F.col("at") + F.col("t.e")).alias("e"), "t.m").alias("t"))
    tokens = tokens.where(mixed(F.col("t")) & apart(F.col("t")))
    tokens = tokens.select("id", "th", "t.s", "t.e", F.rtrim(F.col("t.m"), F.lit("=")).alias("t"))
    tokens = tokens.where(F.length("t") >= F.when(F.col("t").rlike("[0-9]"), MIN_LENGTH).otherwise(PLAIN_LENGTH))
    tests = scratch.save(token_tests(tokens).select("id", "th", "s", "e", "n", "p", "plain"))
    added = random_tokens(tests, q).select("id", "th", F.struct("s", F.lit(3).alias("o"), "e", F.lit("random").alias("k")).alias("x"))
    added = scratch.save(added.groupBy("id", "th").agg(F.collect_set("x").alias("more")).select(F.col("id").alias("rid"), F.col("th").alias("rth"), "more"))
    out = df.drop("t").join(added, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left")
    more = F.coalesce("more", F.array().cast(BASE))
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        F.col("id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", more))).alias("spans"), F.size(more).cast("long").alias("n_random"), (F.size("base") + F.size(more)).cast("long").alias("n_spans"),
    )
