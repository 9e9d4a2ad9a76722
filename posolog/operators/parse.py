"""Table-level prescription parsing and taper expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posolog.functions.sig import (
    ADVANCED_READING,
    BASIC_READING,
    PARSED_FIELDS,
    add_both_readings,
    add_parsed_sig,
)
from posolog.functions.taper import add_taper_plan, step_count, step_of, taper_schedule
from posolog.schema import require_columns


def parse_sig(
    df: DataFrame,
    sig_col: str = "sig",
    advanced: bool = False,
    dictionary: bool = False,
) -> DataFrame:
    """Append the parsed fields of each prescription text.

    By default the text is parsed in place: a narrow transformation, so a text
    that fills a third of the table costs no more than any other.

    ``dictionary=True`` parses every distinct text once and looks the rows up,
    which is several times cheaper where texts repeat.  The input is read twice,
    so use it on a written table rather than on a long plan.  Whether the lookup
    shuffles or broadcasts follows from measured sizes, and a text that fills a
    large share of the rows is split by adaptive execution.
    """
    require_columns(df, [sig_col])
    if not dictionary or df.isStreaming:
        return add_parsed_sig(df, sig_col, advanced)
    texts = df.select(F.col(sig_col).alias("__sig")).where("__sig IS NOT NULL").distinct()
    keep = [c for c in df.columns if c not in PARSED_FIELDS]
    parsed = add_parsed_sig(texts, "__sig", advanced)
    # A NULL text never joins; it reads as a blank one.
    joined = df.select(*keep).join(parsed, F.col(sig_col) == F.col("__sig"), "left")
    blank = {
        "mg_total_flag": F.lit(False),
        "taper_flag": F.lit(False),
        "prn_flag": F.lit(False),
        "free_text_flag": F.lit(False),
        "parsed_status": F.lit("empty"),
    }
    return joined.withColumns(
        {c: F.coalesce(F.col(c), v) for c, v in blank.items()}
    ).select(*keep, *PARSED_FIELDS)


def parse_both(df: DataFrame, sig_col: str = "sig") -> DataFrame:
    """Read each text once for the basic and the advanced method.

    The readings stay in two struct columns, which the text methods take in place of
    a parse of their own; ``without_readings`` drops them.
    """
    require_columns(df, [sig_col])
    return add_both_readings(df, sig_col)


def without_readings(df: DataFrame) -> DataFrame:
    return df.drop(BASIC_READING, ADVANCED_READING)


def take_reading(df: DataFrame, sig_col: str, advanced: bool) -> DataFrame:
    """The parsed fields, from ``parse_both`` where it was run, else by parsing."""
    reading = ADVANCED_READING if advanced else BASIC_READING
    if reading not in df.columns:
        return parse_sig(df, sig_col, advanced=advanced)
    keep = [c for c in df.columns if c not in (*PARSED_FIELDS, BASIC_READING, ADVANCED_READING)]
    return df.select(*keep, f"{reading}.*")


def parse_sig_advanced(
    df: DataFrame, sig_col: str = "sig", dictionary: bool = False
) -> DataFrame:
    """``parse_sig`` with number words and fractions of tablets."""
    return parse_sig(df, sig_col, advanced=True, dictionary=dictionary)


def add_taper_schedule(
    df: DataFrame, sig_col: str = "sig", out_col: str = "taper_schedule"
) -> DataFrame:
    require_columns(df, [sig_col])
    return df.withColumn(out_col, taper_schedule(F.col(sig_col)))


#: Steps that a row holds at a time while it is expanded.
STEPS_AT_ONCE = 256


def _step_rows(df: DataFrame, sig: Column) -> DataFrame:
    """A row per step of the plan of ``sig`` with ``__step``; without a plan one row with NULL.

    Steps are numbered in two goes, so a row never holds more than the numbers of
    its portions and of one portion, however long its schedule is.
    """
    planned = add_taper_plan(df, sig, "__plan")
    last = step_count(F.col("__plan")) - 1
    portions = F.sequence(F.lit(0), F.floor(last / STEPS_AT_ONCE).cast("int"))
    dealt = planned.select("*", F.explode_outer(portions).alias("__portion"))
    first = F.col("__portion") * STEPS_AT_ONCE
    numbers = F.sequence(first, F.least(first + (STEPS_AT_ONCE - 1), last))
    rows = dealt.select("*", F.explode_outer(numbers).alias("__number"))
    step = F.when(F.col("__number").isNotNull(), step_of(F.col("__plan"), F.col("__number")))
    return rows.withColumn("__step", step).drop("__plan", "__portion", "__number")


def taper_steps(df: DataFrame, sig_col: str = "sig") -> DataFrame:
    """The rows with a schedule, once per step, with the fields of the step."""
    require_columns(df, [sig_col])
    rows = _step_rows(df, F.col(sig_col)).where("__step IS NOT NULL")
    return rows.select(*df.columns, "__step.*")


def expand_tapers(df: DataFrame, sig_col: str = "sig") -> DataFrame:
    """One row per taper step for rows with status ``taper``.

    A taper that cannot be decomposed and every other row stay one row with
    NULL step columns.
    """
    require_columns(df, [sig_col, "parsed_status"])
    overridden = ("daily_dose_mg", "freq_per_day", "duration_days")
    is_taper = F.col("parsed_status") == "taper"
    step = F.col("__step")
    exploded = _step_rows(df, F.when(is_taper, F.col(sig_col)))
    return exploded.withColumns(
        {
            **{c: F.coalesce(step[c], F.col(c)) for c in overridden},
            "parsed_status": F.when(step.isNotNull(), "taper_ok").otherwise(
                F.col("parsed_status")
            ),
            "taper_step": step["step"],
            "step_start_day": step["step_start_day"],
            "step_end_day": step["step_end_day"],
        }
    ).drop("__step")
