"""Entries of tables written as wiki text: ranked lists, awards by date, and cast lists.

A table is a text; its rows start with ``|-`` on a line of their own. Everything is column expressions over a row's
block, so tables are parsed where they lie; only a date that covers several rows needs a window within its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_name

#: Shapes of links, ranks and dates in such tables.
LINK = r"\[\[(?!File:|Image:)([^\]|]+)(?:\|[^\]]*)?\]\]"
BOLD_LINK = r"'''\[\[([^\]|]+)(?:\|[^\]]*)?\]\]'''"
YEAR_HEADER = (r"(?m)^!.*?\|[ \t]*(\d{4})[ \t]*$", r"(?m)^![ \t]*(\d{4})[ \t]*$")
RANK_LINKED = r"(\d{1,3})(?:st|nd|rd|th)\s*:\s*" + LINK
RANK_PLAIN = r"(\d{1,3})(?:st|nd|rd|th)\s*:\s*([^\[\]<>*|\n]+?)\s*(?:</small>|\n|$)"
DATE_TEMPLATE = r"\{\{dts\|(\d{4})(?:\|(\d{1,2}))?(?:\|(\d{1,2}))?[^}]*\}\}"
ROWSPAN = r"""(?i)rowspan\s*=\s*"?(\d+)"?"""
CAST_LINE = r"(?m)^\*+\s*\[\[(?!File:|Image:)([^\]|]+)(?:\|[^\]]*)?\]\][^a-zA-Z\n]*as\s+(.+)$"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.regexp_replace(F.col(text_col), r"(?s)<ref[^>]*/>|<ref[^>/]*>.*?</ref>", "")
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(body, r"\n\|-", -1)).alias("at", "block"))


def _pairs(block: Column, pattern: str, linked: bool) -> Column:
    ranks = F.regexp_extract_all(block, F.lit(pattern), F.lit(1))
    names = F.regexp_extract_all(block, F.lit(pattern), F.lit(2))
    return F.zip_with(ranks, names, lambda r, n: F.struct(r.cast("int").alias("rank"), F.trim(n).alias("name"), F.lit(linked).alias("linked")))


def ranked_entries(docs: DataFrame, list_length: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, at, year, rank, name, is_winner, linked, rejected, beyond) for each place of each row with a year.

    The winner is the bold link, else the first link that is no file. A linked place stands before a plain one of the
    same rank and the first before later ones; plain places count only if they read like a name (``rejected`` counts
    the others of the row), and linked places beyond ``list_length`` are counted in ``beyond`` and not returned.
    """
    df = _blocks(docs, id_col, text_col)
    df = df.withColumn("year", F.coalesce(*[_found(F.col("block"), p) for p in YEAR_HEADER]).cast("int")).where("year is not null")
    df = df.withColumn("bold", _found(F.col("block"), BOLD_LINK)).withColumn("winner", F.coalesce("bold", _found(F.col("block"), LINK)))
    linked, plain = _pairs(F.col("block"), RANK_LINKED, True), _pairs(F.col("block"), RANK_PLAIN, False)
    df = df.withColumn("l", linked).withColumn("p", F.filter(plain, lambda x: x["rank"] <= list_length))
    first = F.when(F.col("winner").isNotNull(), F.array(F.struct(F.lit(1).alias("rank"), F.trim("winner").alias("name"), F.lit(True).alias("linked")))).otherwise(F.array().cast("array<struct<rank:int,name:string,linked:boolean>>"))
    rest = F.filter(F.concat(F.filter("l", lambda x: x["rank"] <= list_length), F.filter("p", lambda x: is_name(x["name"]))), lambda x: x["rank"] != 1)
    df = df.withColumn("all", F.concat(first, rest))
    df = df.withColumn("all", F.filter("all", lambda x, i: ~F.exists(F.slice("all", 1, i), lambda y: y["rank"] == x["rank"])))
    held = F.filter("p", lambda x: ~is_name(x["name"]) & (x["rank"] != 1) & ~F.exists("l", lambda y: y["rank"] == x["rank"]))
    df = df.withColumn("rejected", F.size(held)).withColumn("beyond", F.size(F.filter("l", lambda x: x["rank"] > list_length)))
    return df.select("id", "at", "year", F.explode("all").alias("x"), "rejected", "beyond").select("id", "at", "year", "x.rank", "x.name", (F.col("x.rank") == 1).alias("is_winner"), "x.linked", "rejected", "beyond")


def _date(cell: Column) -> Column:
    """A date cell as text of its own precision, or null: a template, a plain date, or a bare year after any attributes."""
    part = lambda g: _found(cell, DATE_TEMPLATE, g)
    two = lambda g: F.lpad(part(g), 2, "0")
    text = F.trim(F.element_at(F.split(cell, r"\|", -1), -1))
    plain = F.date_format(F.try_to_timestamp(F.when(text.rlike(r"^[A-Z][a-z]+ \d{1,2}, *\d{4}$"), F.regexp_replace(text, ", *", ", ")), F.lit("MMMM d, yyyy")), "yyyy-MM-dd")
    template = F.when(part(3).isNotNull(), F.concat_ws("-", part(1), two(2), two(3))).when(part(2).isNotNull(), F.concat_ws("-", part(1), two(2))).otherwise(part(1))
    return F.coalesce(template, plain, F.when(text.rlike(r"^\d{4}$"), text))


def _plain_cell(cell: Column) -> Column:
    """The words of a cell without link: what stands after its attributes, up to a note in brackets; empty if it holds
    other wiki syntax."""
    shown = F.substring_index(F.translate(F.replace(cell, F.lit("&nbsp;"), F.lit(" ")), "\u00a0", " "), "|", -1)
    words = F.regexp_extract(shown, r"^((?:[^<(\[{]|<[^>]*>|\((?!\d+\)\s*$))*)(?:\(\d+\)\s*)?$", 1)
    return F.trim(F.array_join(F.split(words, r"<[^>]*>", -1), ""))


def _plain_role(role: Column) -> Column:
    """The name a cast line gives: its first piece, where links show their text and quotes, templates and marks are none."""
    pieces = F.split(role, r"\{\{[^}]*\}\}|'{2,}|\]\]", -1)
    shown = F.array_join(F.transform(pieces, lambda p: F.regexp_replace(p, r"\[\[(?:[^|]*\|)?", "")), "")
    return F.trim(F.regexp_extract(shown, r"^\s*(.*?)\s*(?:,.*|\s[-–]\s.*|\s\(.*)?$", 1), F.lit(" '\"*"))


def award_rows(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, at, value, precision, year, winner, status) for every row of two or more cells.

    A date cell with ``rowspan`` covers the rows after it, which have no date cell of their own, up to its number and
    up to the next date. ``status``: linked, unlinked (a bare text that reads like a name), no link, or no date.
    """
    df = _blocks(docs, id_col, text_col).withColumn("cells", F.transform(F.split("block", r"\n\|", -1), lambda c: F.trim(c, F.lit(" \t\n"))))
    df = df.withColumn("cells", F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0)))).where("size(cells) >= 2").withColumn("own", _date(F.col("cells")[0]))
    span = F.coalesce(_found(F.col("cells")[0], ROWSPAN).cast("int"), F.lit(1))
    table = Window.partitionBy("id").orderBy("at")
    df = df.withColumn("n", F.row_number().over(table))
    df = df.withColumn("last", F.last(F.when(F.col("own").isNotNull(), F.struct("own", "n", span.alias("span"))), ignorenulls=True).over(table))
    df = df.withColumn("value", F.when(F.col("n") < F.col("last.n") + F.col("last.span"), F.col("last.own")))
    cell = F.when(F.col("own").isNotNull(), F.col("cells")[1]).otherwise(F.col("cells")[0])
    df = df.withColumn("cell", cell).withColumn("link", F.trim(_found(F.col("cell"), r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]")))
    bare = _plain_cell(F.col("cell"))
    status = F.when(F.col("value").isNull(), "no date").when(F.col("link").isNotNull(), "linked").when(is_name(bare), "unlinked").otherwise("no link")
    df = df.withColumn("status", status)
    winner = F.when(F.col("status") == "linked", F.col("link")).when(F.col("status") == "unlinked", bare)
    precision = F.when(F.length("value") == 10, "day").when(F.length("value") == 7, "month").when(F.length("value") == 4, "year")
    return df.select("id", "at", "value", precision.alias("precision"), F.substring("value", 1, 4).cast("int").alias("year"), winner.alias("winner"), "status")


def cast_lines(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, actor, character) from the lines ``* [[actor]] as character``; of an actor's lines in a text the last counts."""
    actors, roles = (F.regexp_extract_all(F.col(text_col), F.lit(CAST_LINE), F.lit(g)) for g in (1, 2))
    df = docs.select(F.col(id_col).alias("id"), F.posexplode(F.arrays_zip(actors.alias("actor"), roles.alias("role"))).alias("at", "x"))
    df = df.select("id", F.trim("x.actor").alias("actor"), "at", _plain_role(F.col("x.role")).alias("character")).where("character <> ''")
    return df.groupBy("id", "actor").agg(F.max_by("character", "at").alias("character"))
