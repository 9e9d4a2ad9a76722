"""Joins of intervals that overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_DAYS = 512
#: Days since 1970 (of 1900 and 2100) between which slices have their ordinary width.
NEAR_DAYS = (-25567, 47482)
#: A slice of the days before and after is this many times as wide.
FAR_WIDER = 128


def _slice_of(day: Column, slice_days: int) -> Column:
    """Number of the slice that holds ``day``; a later day has no smaller number."""
    number = F.unix_date(day)
    near = F.least(F.greatest(number, F.lit(NEAR_DAYS[0])), F.lit(NEAR_DAYS[1]))
    far = F.floor((number - near) / F.lit(FAR_WIDER * slice_days))
    return (F.floor(near / F.lit(slice_days)) + far).cast("bigint")


def _meetings(start: Column, end: Column, slice_days: int, side: int = 0) -> Column:
    """The slices of an interval, in which it may meet one of the other side.

    They are the same on either ``side``: of two intervals that overlap the earlier
    one holds the slice in which the other begins.
    """
    low, high = (_slice_of(day, slice_days) for day in (F.least(start, end), F.greatest(start, end)))
    return F.when(start.isNotNull() & end.isNotNull(), F.sequence(low, high))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[tuple[str, str]],
    left_interval: tuple[str, str],
    right_interval: tuple[str, str],
    how: str = "inner",
    slice_days: int = SLICE_DAYS,
) -> DataFrame:
    """Pairs with equal keys, each side starting no later than the other ends.

    Both sides are cut into slices of the day axis and joined on keys and slice, so
    one key's rows spread over many partitions and only neighbours in time are
    compared.  A pair counts in the slice in which the later of the two begins, which
    the earlier one holds too, so it appears once.  Neither side has to know the
    other's days: each is read once, and an ordinary interval is one row or two.
    Slices before 1900 and after 2100 are ``FAR_WIDER`` times as wide, so an open end
    (the year 9999) is some 100 rows.  Rows are sorted by the first key first.

    With ``how='left'`` a left row may also appear unmatched once per slice: the
    caller aggregates per left row, which ignores those.  Column names of the two
    sides must differ.
    """
    ls, le = (F.col(c) for c in left_interval)
    rs, re = (F.col(c) for c in right_interval)
    explode = F.explode_outer if how == "left" else F.explode
    cut_left = left.select(*left.columns, explode(_meetings(ls, le, slice_days, 0)).alias("__l"))
    cut_right = right.select(*right.columns, F.explode(_meetings(rs, re, slice_days, 1)).alias("__r"))
    on = F.lit(True)
    for l, r in keys:
        on = on & (F.col(l) == F.col(r))
    later = _slice_of(F.greatest(F.least(ls, le), F.least(rs, re)), slice_days)
    on = on & (F.col("__l") == F.col("__r")) & (rs <= le) & (re >= ls) & (F.col("__l") == later)
    return cut_left.join(cut_right, on, how).drop("__l", "__r")
