"""Column expressions that read a prescription text ("SIG").

Everything here is a native expression: the JVM evaluates it per row inside the
scan stage, with no shuffle and no Python worker.  ``add_parsed_sig`` stacks the
expressions in steps, so that no regular expression runs twice for one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posolog.functions import fixed_values as V
from posolog.functions.values import (
    contains_any,
    evaluated,
    first_number,
    matched_number,
    matches,
    squish,
    words,
)

PARSED_FIELDS = (
    "tablets",
    "freq_per_day",
    "mg_per_admin",
    "mg_total_flag",
    "duration_days",
    "taper_flag",
    "prn_flag",
    "free_text_flag",
    "daily_dose_mg",
    "parsed_status",
)

_TABLET_HINTS = ("tab", "pill", "cap")
_POSITIVE_LEADING = r"^(?=[\d.]*[1-9])" + V.NUMBER


def normalised(text: Column) -> Column:
    return squish(F.lower(text.cast("string")), text.cast("string"))


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text, F.lit(" \t\r\n")) == "")


def words_replaced(text: Column) -> Column:
    """Number words to digits and Spanish terms to English.

    The replacements run only on texts that hold one of the words.  None creates
    another's input, so words with the same replacement share one expression.
    """
    same: dict[str, list[str]] = {}
    for pattern, becomes in V.WORD_REPLACEMENTS:
        same.setdefault(becomes, []).append(pattern)
    replaced = text
    for becomes, patterns in same.items():
        replaced = F.regexp_replace(replaced, words("|".join(patterns)), becomes)
    some_word = matches(text, "|".join(p for p, _ in V.WORD_REPLACEMENTS))
    return F.when(some_word, replaced).otherwise(text)


def remarks_removed(text: Column) -> Column:
    """Without parentheticals that hold no amount, such as ``(twelve)``; of a squished text."""
    without = F.regexp_replace(text, words(V.WORD_ONLY_PARENTHETICAL), "")
    # From the parenthesis on, the pattern tells at once where it cannot match.
    some = text.contains("(") & text.rlike(words(V.WORD_ONLY_PARENTHETICAL.removeprefix(r"\s*")))
    return F.when(some, squish(without)).otherwise(text)


def _frequency_rules(text: Column) -> list[Column]:
    """Doses per day by each rule in order; NULL where a rule does not apply.

    A zero count falls through to the next rule: ``try_divide`` gives NULL, and a
    leading count is only read when it holds a digit other than zero.
    """

    def leading_count(pattern: str, *hints: str) -> Column:
        found = F.regexp_extract(text, words(pattern), 0)
        return F.when(contains_any(text, hints), first_number(found, _POSITIVE_LEADING))

    def per(amount: float, pattern: str, *hints: str) -> Column:
        return F.try_divide(F.lit(amount), matched_number(text, pattern, *hints))

    def has(pattern: str, value: float, *hints: str) -> Column:
        return F.when(matches(text, pattern, *hints), F.lit(value))

    intake = matches(text, V.BY_MOUTH, "mouth", "po", "orally")
    by_mouth = F.when(intake & ~matches(text, V.NOT_A_DAILY_INTAKE), F.lit(1.0))
    weeks = matched_number(text, V.EVERY_N_WEEKS, "week") * F.lit(V.DAYS_PER_WEEK)
    return [
        per(24.0, V.EVERY_N_HOURS, "every", "q"),
        has(V.TWICE_DAILY, 2.0),
        leading_count(V.N_TIMES_DAILY, "daily", "day"),
        has(V.FOUR_DAILY, 4.0),
        has(V.THREE_DAILY, 3.0),
        has(V.TWO_DAILY, 2.0),
        has(V.ONCE_DAILY, 1.0),
        has(V.ALTERNATE_DAYS, 0.5),
        per(1.0, V.EVERY_N_DAYS, "every", "q"),
        has(V.TWICE_WEEKLY, 2.0 / 7.0),
        leading_count(V.N_TIMES_WEEKLY, "week") / F.lit(V.DAYS_PER_WEEK),
        F.try_divide(F.lit(1.0), weeks),
        has(V.ONCE_WEEKLY, 1.0 / 7.0),
        has(V.ONCE_MONTHLY, 1.0 / 30.0),
        has(V.ONCE_ORAL, 1.0),
        has(V.NIGHTLY, 1.0),
        has(V.MORNING, 1.0),
        has(V.ONCE_FOR_DOSES, 1.0),
        has(V.ONLY_MG, 1.0, "mg"),
        by_mouth,
        has(V.PER_DAY, 1.0, "day", "per"),
    ]


def frequency(text: Column) -> Column:
    """Doses per day, or NULL.  ``coalesce`` is lazy: the first rule that applies ends it."""
    return F.coalesce(*_frequency_rules(text))


def tablets_basic(text: Column) -> Column:
    return F.coalesce(matched_number(text, V.TABLETS, *_TABLET_HINTS), F.lit(1.0))


def _word_number(word: Column) -> Column:
    pairs = [F.lit(x) for pair in V.WORD_NUMBERS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), word)


def tablets_advanced(text: Column, fraction: Column) -> Column:
    """Tablets per dose with halves and number words; one when none is named.

    ``fraction`` is the text's ``fraction_text``, named by the caller because it
    is read twice.
    """
    half = F.lit(0.5)
    return F.coalesce(
        matched_number(text, V.N_AND_A_HALF, "half") + half,
        F.when(~fraction.isin("", "1/2", "½"), fraction.try_cast("double")),
        F.when(fraction.isin("1/2", "½"), half),
        F.when(
            text.contains("half"),
            _word_number(F.regexp_extract(text, words(V.WORD_AND_A_HALF), 1)) + half,
        ),
        F.when(
            contains_any(text, _TABLET_HINTS),
            _word_number(F.regexp_extract(text, words(V.WORD_TABLETS), 1)),
        ),
        F.lit(1.0),
    )


def fraction_text(text: Column) -> Column:
    return F.when(
        contains_any(text, _TABLET_HINTS),
        F.regexp_extract(text, words(V.N_OR_FRACTION), 1),
    )


def unit_days(unit: Column) -> Column:
    """Days in one unit, told apart by the letters only that unit holds."""
    return (
        F.when(unit.contains("day"), F.lit(1.0))
        .when(unit.contains("w"), F.lit(V.DAYS_PER_WEEK))
        .otherwise(F.lit(V.DAYS_PER_MONTH))
    )


def duration(text: Column) -> Column:
    found = F.regexp_extract(text, words(V.DURATION), 0)
    days = first_number(found) * unit_days(found)
    return F.when(contains_any(text, ["for", "x"]), days)


#: Columns of ``add_both_readings``: structs of the parsed fields.
BASIC_READING, ADVANCED_READING = "sig_basic", "sig_advanced"


def add_parsed_sig(df: DataFrame, sig_col: str, advanced: bool = False) -> DataFrame:
    """Append the parsed fields of ``sig_col``.

    Input columns with the name of a parsed field are replaced.
    """
    keep = [c for c in df.columns if c not in PARSED_FIELDS]
    out, fields = _read(df.select(*keep), sig_col, [advanced])
    return out.select(*keep, F.inline(F.array(fields[0])))  # see values.evaluated


def add_both_readings(df: DataFrame, sig_col: str) -> DataFrame:
    """Append the basic and the advanced reading of ``sig_col``, each as a struct.

    The readings differ in the tablets only, so a text is read once for both.
    """
    keep = [c for c in df.columns if c not in (BASIC_READING, ADVANCED_READING)]
    out, (basic, advanced) = _read(df.select(*keep), sig_col, [False, True])
    both = F.struct(basic.alias(BASIC_READING), advanced.alias(ADVANCED_READING))
    return out.select(*keep, F.inline(F.array(both)))


def _read(df: DataFrame, sig_col: str, readings: list[bool]) -> tuple[DataFrame, list[Column]]:
    """The columns the rules give, and a struct of parsed fields a reading (advanced or not).

    Each step is ``evaluated`` by itself: no rule runs twice for one row, a filter on
    a field is not rewritten into copies of the rules, and the generated code of a
    step stays small enough for the JVM to compile it.
    """
    text, raw = F.col("__text"), F.col(sig_col).cast("string")

    def step(frame: DataFrame, **columns: Column) -> DataFrame:
        return evaluated(frame, {f"__{k}": c for k, c in columns.items()})

    def cheap(frame: DataFrame, **columns: Column) -> DataFrame:
        return frame.withColumns({f"__{k}": c for k, c in columns.items()})

    def mg(pattern: str, hint: str = "mg") -> Column:
        return matched_number(text, pattern, hint)

    total, per_dose = F.col("__total"), F.col("__per_dose")
    plain, per_day, bare = F.col("__plain"), F.col("__per_day"), F.col("__bare")
    freq = F.col("__freq")

    out = cheap(df, text=F.when(~is_blank(raw), F.lower(raw)))
    out = step(out, text=squish(text))
    out = step(out, text=words_replaced(text))
    out = step(out, text=remarks_removed(text))
    if any(readings):
        out = step(out, fraction=fraction_text(text))
    tablets = [
        tablets_advanced(text, F.col("__fraction")) if advanced else tablets_basic(text)
        for advanced in readings
    ]
    named_tablets = {f"tablets{n}": F.when(text.isNotNull(), t) for n, t in enumerate(tablets)}
    out = step(out, **named_tablets, duration=duration(text))
    rules = _frequency_rules(text)
    out = step(out, freq=F.coalesce(*rules[:4]))
    for first, last in ((4, 7), (7, 10), (10, 13), (13, 17), (17, 21)):
        out = step(out, freq=F.coalesce(freq, *rules[first:last]))
    out = step(
        out,
        taper=F.coalesce(matches(text, V.TAPER_WORD), F.lit(False)),
        prn=F.coalesce(matches(text, V.PRN_WORD), F.lit(False)),
        free=F.coalesce(matches(text, V.FREE_TEXT_WORD), F.lit(False)),
    )
    out = step(out, total=mg(V.MG_TOTAL, "total"), per_dose=mg(V.MG_PER_DOSE, "dose"))
    named = total.isNotNull() | per_dose.isNotNull()
    out = step(out, plain=F.when(~named, mg(V.MG_PARENTHESISED, "mg)")))
    unnamed = ~named & plain.isNull()
    out = step(out, per_day=F.when(unnamed, mg(V.MG_PER_DAY, "day")))
    once_a_day = freq.isNull() & matches(text, V.DAILY_WORD)
    out = step(
        out, bare=F.when(unnamed & per_day.isNull(), mg(V.MG_BARE)), once=once_a_day
    )
    fields = []
    whole = total.isNotNull() | per_day.isNotNull()
    for n in range(len(readings)):
        admin, dose = F.col(f"__admin{n}"), F.col(f"__dose{n}")
        each = F.coalesce(per_dose, F.coalesce(plain, bare) * F.col(f"__tablets{n}"))
        out = cheap(out, **{f"admin{n}": F.when(~whole, each)})
        daily = F.coalesce(total, per_day, admin * freq, F.when(F.col("__once"), admin))
        out = cheap(out, **{f"dose{n}": daily})
        status = (
            F.when(text.isNull(), "empty")
            .when(F.col("__free"), "free_text")
            .when(F.col("__taper"), "taper")
            .when(F.col("__prn"), "prn")
            .when(dose.isNotNull(), "ok")
            .otherwise("no_parse")
        )
        fields.append(
            F.struct(
                F.col(f"__tablets{n}").alias("tablets"),
                freq.alias("freq_per_day"),
                admin.alias("mg_per_admin"),
                whole.alias("mg_total_flag"),
                F.col("__duration").alias("duration_days"),
                F.col("__taper").alias("taper_flag"),
                F.col("__prn").alias("prn_flag"),
                F.col("__free").alias("free_text_flag"),
                dose.alias("daily_dose_mg"),
                status.alias("parsed_status"),
            )
        )
    return out, fields
