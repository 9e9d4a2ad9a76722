"""Taper schedules, read from the normalised text.

Two forms are recognised: steps spelled out one by one, and a starting dose with
a fixed decrement.  A text that gives fewer than two steps has no schedule.

A schedule is a plan of fixed size: the steps that the text spells out, or (start,
decrement, days, number of steps).  ``step_of`` gives any of its steps; rows are made
from it a few at a time by ``operators.parse``, never from an array of all steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posolog.functions import fixed_values as V
from posolog.functions.sig import frequency, normalised, unit_days
from posolog.functions.values import contains_any, evaluated, first_number, squish, words


# Days from year 1 to 9999: a decrement schedule that runs longer has no dates, so
# the text has no schedule; nor has one whose steps last no day.
CALENDAR_DAYS = 3_652_059


def _pieces(text: Column) -> Column:
    return F.filter(
        F.transform(F.split(text, V.TAPER_SEPARATOR), squish), lambda p: p != ""
    )


def _spelled_out_steps(pieces: Column) -> Column:
    """Steps of the pieces that name a dose and a time; the frequency is read of these only."""
    # The match begins with the dose and ends with the time: the costly pattern runs once.
    leading, trailing = "(?U)^" + V.NUMBER, "(?U)(" + V.NUMBER + r")\s*([a-z]+)$"

    def found(piece: Column) -> Column:
        return F.struct(
            F.regexp_extract(piece, words(V.TAPER_STEP), 0).alias("match"), piece.alias("piece")
        )

    def read(step: Column) -> Column:
        match = step["match"]
        return F.struct(
            first_number(match, leading).alias("dose"),
            (
                first_number(F.regexp_extract(match, trailing, 1))
                * unit_days(F.regexp_extract(match, trailing, 2))
            ).alias("days"),
            step["piece"].alias("piece"),
        )

    def with_frequency(step: Column) -> Column:
        return F.struct(
            step["dose"].alias("dose"),
            step["days"].alias("days"),
            F.coalesce(frequency(step["piece"]), F.lit(1.0)).alias("freq"),
            step["piece"].rlike(V.TAPER_PER_DOSE).alias("per_dose"),
        )

    def daily(step: Column) -> Column:
        each = step["per_dose"] & (step["freq"] > 1)
        return F.struct(
            F.when(each, step["dose"] * step["freq"]).otherwise(step["dose"]).alias("dose"),
            step["freq"].alias("freq"),
            step["days"].alias("days"),
        )

    complete = F.filter(
        F.transform(F.transform(pieces, found), read),
        lambda s: s["dose"].isNotNull() & s["days"].isNotNull(),
    )
    # One step is no schedule, whatever its frequency.
    several = F.filter(F.array(complete), lambda steps: F.size(steps) >= 2)
    return F.get(F.transform(several, lambda steps: F.transform(F.transform(steps, with_frequency), daily)), F.lit(0))


def _decrement(text: Column) -> Column:
    """Array of the one (start, by, days, count), or empty."""
    pattern = words(V.TAPER_DECREMENT)
    start = first_number(F.regexp_extract(text, V.TAPER_START, 1))
    by = first_number(F.regexp_extract(text, pattern, 1))
    every = F.coalesce(first_number(F.regexp_extract(text, pattern, 2)), F.lit(1.0))
    days = every * unit_days(F.regexp_extract(text, pattern, 3))
    # A one-element array names the three numbers so each is read once.
    found = F.filter(
        F.array(F.struct(start.alias("start"), by.alias("by"), days.alias("days"))),
        lambda f: (f["by"] > 0)
        & (f["by"] < f["start"])
        & (f["days"] > 0)
        & (f["start"] / f["by"] * f["days"] <= CALENDAR_DAYS),
    )
    counted = F.transform(
        found,
        lambda f: F.struct(
            f["start"].alias("start"),
            f["by"].alias("by"),
            f["days"].alias("days"),
            (F.floor((f["start"] - f["by"]) / f["by"] + F.lit(1e-10)) + 1).cast("int").alias("count"),
        ),
    )
    return F.filter(counted, lambda f: f["count"] >= 2)


def _started(steps: Column) -> Column:
    """Add the days before each spelled-out step."""

    def place(step: Column, i: Column) -> Column:
        before = F.aggregate(
            F.slice(steps, F.lit(1), i), F.lit(0.0), lambda acc, s: acc + s["days"]
        )
        return F.struct(
            step["dose"].alias("dose"), step["freq"].alias("freq"), step["days"].alias("days"), before.alias("before")
        )

    return F.transform(steps, place)


def _may_taper(text: Column) -> Column:
    mentions = F.size(F.regexp_extract_all(text, F.lit(V.TAPER_MG_MENTION), F.lit(0)))
    return text.rlike(V.TAPER_GATE_WORD) | (mentions >= 2)


def _plan(text: Column, pieces: Column) -> Column:
    # Arrays of at most one reading name each once; the spelled-out one wins.
    steps = F.when(F.size(pieces) >= 2, _spelled_out_steps(pieces))
    spelled = F.filter(F.transform(F.array(steps), _started), lambda s: F.size(s) >= 2)
    decrement = F.when(contains_any(text, _DECREMENT_WORDS), _decrement(text))
    plans = F.concat(
        F.transform(spelled, lambda s: F.struct(s.alias("steps"), F.lit(None).cast(_FALLING).alias("falling"))),
        F.coalesce(
            F.transform(decrement, lambda f: F.struct(F.lit(None).cast(_STEPS).alias("steps"), f.alias("falling"))),
            F.array().cast(f"array<struct<steps:{_STEPS},falling:{_FALLING}>>"),
        ),
    )
    return F.get(plans, F.lit(0))


def taper_plan(sig: Column) -> Column:
    """``struct<steps, falling>`` of which one is NULL, or NULL when not decomposable."""
    text = normalised(sig)
    return F.when(_may_taper(text), _plan(text, _pieces(text)))


def add_taper_plan(df: DataFrame, sig: Column, out_col: str) -> DataFrame:
    """``taper_plan`` as a column, its text and pieces each computed once per row."""
    out = evaluated(df, {"__taper_text": normalised(sig)})
    text = F.col("__taper_text")
    out = evaluated(out, {"__taper_pieces": F.when(_may_taper(text), _pieces(text))})
    pieces = F.col("__taper_pieces")
    out = evaluated(out, {out_col: F.when(pieces.isNotNull(), _plan(text, pieces))})
    return out.drop("__taper_text", "__taper_pieces")


#: Every text that ``V.TAPER_DECREMENT`` matches holds one of these.
_DECREMENT_WORDS = ("decreas", "reduce", "taper", "drop")
_STEPS = "array<struct<dose:double,freq:double,days:double,before:double>>"
_FALLING = "struct<start:double,by:double,days:double,count:int>"


def step_count(plan: Column) -> Column:
    """Steps of a plan; NULL without one."""
    return F.coalesce(plan["falling"]["count"], F.when(plan["steps"].isNotNull(), F.size(plan["steps"])))


def step_of(plan: Column, i: Column) -> Column:
    """Step ``i`` (from 0) of a plan, on the day axis."""
    falling, spelled = plan["falling"], F.get(plan["steps"], i)
    falls = falling.isNotNull()

    def either(fallen: Column, field: str) -> Column:
        return F.when(falls, fallen).otherwise(spelled[field])

    days = either(falling["days"], "days")
    before = either(i * falling["days"], "before")
    return F.struct(
        (i + 1).cast("int").alias("step"),
        either(F.greatest(falling["start"] - i * falling["by"], falling["by"]), "dose").alias("daily_dose_mg"),
        either(F.lit(1.0), "freq").alias("freq_per_day"),
        days.alias("duration_days"),
        before.alias("step_start_day"),
        (before + days - 1).alias("step_end_day"),
    )


def taper_schedule(sig: Column) -> Column:
    """``array<struct<step, daily_dose_mg, ...>>`` or NULL when not decomposable.

    One value holds all steps; ``operators.parse.taper_steps`` gives rows instead.
    """
    plans = F.filter(F.array(taper_plan(sig)), lambda p: p.isNotNull())
    schedules = F.transform(
        plans, lambda p: F.transform(F.sequence(F.lit(0), step_count(p) - 1), lambda i: step_of(p, i))
    )
    return F.get(schedules, F.lit(0))
