"""Columns for rounded quotients and for means whose sums no order of the rows changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, places: int = 6) -> Column:
    """The double scaled, rounded half away from zero and scaled back, as SQL engines on IEEE doubles round.

    ``F.round`` rounds the shortest decimal that prints as the double, so the two differ where a quotient's decimal ends
    in a 5 and the scaled double lies just below it.
    """
    scale = F.lit(10.0**places)
    return F.round(value.cast("double") * scale) / scale


def exact_mean(name: str) -> Column:
    """Mean of a column of doubles from their exact decimal sum (12 places), so partitions cannot move a tie; where a
    value is no such decimal, the mean of the doubles."""
    v = F.col(name).try_cast("decimal(28,12)")
    return F.when(F.count(v) == F.count(name), F.sum(v).cast("double") / F.count(name)).otherwise(F.avg(name))
