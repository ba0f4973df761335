"""Quality rules: text statistics of each document, and lines that too many documents of a host share.

Lines are normalised (lower case, digits as 0, runs of spaces as one) and hashed with their host. A line is boilerplate
when at least ``min_docs`` documents of the host, and at least ``share`` of its documents, hold it. Documents are told
apart by id and text, so a row that is repeated counts once and copies under other ids count each; ``copies_once`` tells
them apart by text alone, where copies are left to another stage. A document loses its boilerplate lines; if less than
``left_share`` of its words remain, it is rejected.

Everything is DataFrame functions. One pass over the texts writes the statistics and a hash and a number of words for
each line; the rest works on those. Counting goes through (line, document) pairs first, so that a line which a third of
all documents hold is dealt by document. The boilerplate lines are broadcast while they are fewer than
``BROADCAST_LINES`` (8 bytes each) and otherwise joined by shuffle, each line in ``SALTS`` places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SPACES = " \t\n\x0b\x0c\r"

BROADCAST_LINES, SALTS = 1_000_000, 32


def _word_array(text: Column) -> Column:
    """Words of a text without empty ends (spaces are trimmed first, so the split gives words only)."""
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE, -1))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")


def _normal_lines(text: Column, host: Column) -> Column:
    """Array of a hash, with the host, and a number of words for each line that has words."""
    signs = "123456789\t\x0b\x0c\r"
    plain = F.regexp_replace(F.translate(F.lower(text), signs, "0" * 9 + " " * 4), " {2,}", " ")
    lines = F.filter(F.transform(F.split(plain, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(host, x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n")))


def _host(col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(col).cast("string"), F.lit("\0")))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = None) -> DataFrame:
    """(id, th, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), th being a hash of the text.

    With ``host_col`` also host (a hash) and lines (``_normal_lines``).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    more = [] if host_col is None else ["host", "lines"]
    df = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *([] if host_col is None else [_host(host_col).alias("host")]))
    df = df.withColumn("w", F.transform(_word_array(F.col("text")), lambda w: F.xxhash64(w))).withColumn("l", _lines(F.col("text")))
    if host_col is not None:
        df = df.withColumn("lines", _normal_lines(F.col("text"), F.col("host")))
    n = F.size("w")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    df = df.select(
        "id",
        F.xxhash64("text").alias("th"),
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("w"), i, WINDOW))).alias("g"),
        *more,
    )
    # Windows in order of hash: those equal to a neighbour occur twice or more. Only texts with any are sorted.
    twice = F.size(F.array_distinct("g")) < F.size("g")
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("s", F.when(twice, F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty)).drop("g")
    found = F.filter("s", lambda e, i: F.coalesce(F.get("s", i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["h"] == e["h"], F.lit(False)))
    df = df.withColumn("p", F.array_sort(F.transform(found, lambda e: e["i"]))).drop("s")
    covered = F.aggregate(
        F.transform("p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return df.withColumn("n_repeat_words", covered).drop("p")


def _boilerplate(seen: DataFrame, min_docs: int, share: float, copies_once: bool) -> DataFrame:
    """(line, n_docs) above the limits from rows with id, th, host and lines."""
    doc = ["th"] if copies_once else ["id", "th"]
    lines = seen.select("host", *doc, F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("line"))
    lines = lines.groupBy("line", *doc).agg(F.max("host").alias("host"))
    lines = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n_docs"), F.max("host").alias("host")).where(F.col("n_docs") >= min_docs)
    hosts = seen.select("host", *doc).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    return lines.join(hosts, "host").where(F.col("n_docs") >= share * F.col("docs")).select("line", "n_docs")


def boilerplate_lines(docs: DataFrame, host_col: str, text_col: str, min_docs: int, share: float, id_col: str = "doc_id", copies_once: bool = False) -> DataFrame:
    """(line long, n_docs): hashes of (host, normalised line) that are above the limits."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    seen = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), _host(host_col).alias("host"), text.alias("text"))
    return _boilerplate(seen.select("id", "th", "host", _normal_lines(F.col("text"), F.col("host")).alias("lines")), min_docs, share, copies_once)


def quality_verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = 20,
    share: float = 0.02,
    left_share: float = 0.3,
    copies_once: bool = False,
) -> DataFrame:
    """Statistics, ``base_failed``, ``kept``, ``n_boiler_words`` and the text's hash ``th`` for every row.

    Null text counts as empty (no words, base fails), null host as a host of its own, ids may be null or repeat: rows
    with the same id and text get the same verdict. Other columns are ignored. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    seen = scratch.save(text_statistics(docs, id_col, text_col, host_col))
    common = scratch.save(_boilerplate(seen, min_docs, share, copies_once))
    lines = seen.select("id", "th", "host", F.posexplode("lines").alias("at", "x"))
    lines = lines.select("id", "th", "host", "at", F.col("x.h").alias("line"), F.col("x.n").alias("n"))
    if common.count() <= BROADCAST_LINES:
        hit = lines.join(F.broadcast(common), "line")
    else:
        salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = lines.withColumn("salt", F.pmod(F.xxhash64("id", "th"), F.lit(SALTS)).cast("int")).join(salted, ["line", "salt"])
    # Each line of a document once, however often its row is repeated.
    lost = hit.groupBy("id", "th", "host", "at").agg(F.max("n").alias("n")).groupBy("id", "th", "host").agg(F.sum("n").alias("n"))
    lost = scratch.save(lost.groupBy("id", "th").agg(F.max("n").alias("lost")))
    base = seen.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    r = lost.select(F.col("id").alias("rid"), F.col("th").alias("rth"), "lost")
    out = base.join(r, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left")
    boiler = F.least(F.coalesce("lost", F.lit(0)), F.col("n_words"))
    kept = ~F.col("base_failed") & ((F.col("n_words") - boiler) >= left_share * F.col("n_words"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        kept.alias("kept"), boiler.alias("n_boiler_words"), "th",
    )
