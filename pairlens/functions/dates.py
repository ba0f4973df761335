"""Columns for dates of known precision and for intervals that include both ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated(value: Column, code: Column) -> Column:
    """A padded time value cut to its precision code (9 year, 10 month, 11 day); null for coarser codes."""
    plain = F.regexp_extract(value, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.when(code == 9, F.substring(plain, 1, 4)).when(code == 10, F.substring(plain, 1, 7)).when(code == 11, plain)


def earliest(value: Column) -> Column:
    """First day of a year, month or day value; null where the calendar has no such day."""
    n = F.length(value)
    return F.when(n == 4, F.try_to_date(F.concat(value, F.lit("-01-01")))).when(n == 7, F.try_to_date(F.concat(value, F.lit("-01")))).when(n == 10, F.try_to_date(value))


def latest(value: Column) -> Column:
    n = F.length(value)
    return F.when(n == 4, F.try_to_date(F.concat(value, F.lit("-12-31")))).when(n == 7, F.last_day(F.try_to_date(F.concat(value, F.lit("-01"))))).when(n == 10, F.try_to_date(value))


def is_valid(value: Column, precision: Column) -> Column:
    shape = F.when(precision == "year", r"^\d{4}$").when(precision == "month", r"^\d{4}-\d{2}$").when(precision == "day", r"^\d{4}-\d{2}-\d{2}$")
    return F.coalesce(F.call_function("regexp_like", value, shape) & earliest(value).isNotNull(), F.lit(False))


def interval_days(start: Column, end: Column, last_active: Column) -> Column:
    """Days of an interval; an ongoing one closes at the last supported day."""
    return F.datediff(F.coalesce(end, last_active), start) + 1


def clipped(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Struct of the intersection and which bounds moved; null if empty."""
    s, e = F.greatest(start, low), F.least(end, high)
    moved = F.concat_ws("+", F.when(s != start, "start"), F.when(e != end, "end"))
    return F.when(s <= e, F.struct(s.alias("start"), e.alias("end"), moved.alias("moved")))


def adult_from(born: Column) -> Column:
    """The 18th birthday; 29 February becomes 1 March."""
    plain = F.add_months(born, 216)
    return F.when((F.month(born) == 2) & (F.dayofmonth(born) == 29) & (F.dayofmonth(plain) != 29), F.date_add(plain, 1)).otherwise(plain)


def plain_date(cell: Column) -> Column:
    """Date of a table cell: a date template, an English date, or a bare year; null otherwise."""
    t = F.regexp_extract(cell, r"\{\{dts\|(\d{4})\|(\d{1,2})\|(\d{1,2})", 0)
    of = lambda i: F.regexp_extract(cell, r"\{\{dts\|(\d{4})\|(\d{1,2})\|(\d{1,2})", i)
    dts = F.when(t != "", F.concat_ws("-", of(1), F.lpad(of(2), 2, "0"), F.lpad(of(3), 2, "0")))
    words = F.regexp_extract(cell, r"((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})", 1)
    named = F.when(words != "", F.date_format(F.try_to_timestamp(words, F.lit("MMMM d, yyyy")), "yyyy-MM-dd"))
    year = F.regexp_extract(cell, r"\b((?:19|20)\d{2})\b", 1)
    return F.coalesce(dts, named, F.when(year != "", year))
