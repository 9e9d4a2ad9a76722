"""The three dose methods.

Each is one lazy plan without a shuffle: candidate doses are columns, the choice
between them is ``coalesce`` in the caller's order.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posolog.functions import fixed_values as V
from posolog.functions.sig import PARSED_FIELDS, is_blank
from posolog.functions.values import day, mg_in_name, number, positive_days
from posolog.operators.filters import (
    NAME_COLUMNS,
    exceeds,
    known_steroids,
    oral_only,
    plausible,
    with_drug_name,
)
from posolog.operators.parse import expand_tapers, parse_both, take_reading
from posolog.schema import first_present, optional, require_columns
from posolog.session import written

log = logging.getLogger(__name__)

DOSE_COLUMN = {
    "original": "dose_from_original",
    "tablets_freq": "dose_from_tablets_freq",
    "supply_based": "dose_from_supply",
    "actual_duration": "dose_from_actual_duration",
}
FALLBACK_METHODS = ("original", "actual_duration", "supply_based")


@dataclass(frozen=True)
class _Candidates:
    """Expressions for the strength and the four candidate doses of a row."""

    strength: Column
    dose: dict[str, Column]

    def first(self, methods: Sequence[str]) -> Column:
        return F.coalesce(*[self.dose[m] for m in methods], F.lit(None).cast("double"))

    def first_method(self, methods: Sequence[str]) -> Column:
        return F.coalesce(
            *[F.when(self.dose[m].isNotNull(), F.lit(m)) for m in methods],
            F.lit("missing"),
        )


def strength_mg(df: DataFrame) -> Column:
    """Strength in mg: the structured amount if its unit may be mg, else the text."""
    unit = optional(df, "amount_unit_concept_id", "int").cast("int")
    amount = F.when(
        unit.isNull() | unit.isin(*V.MG_UNIT_CONCEPTS), number(df, "amount_value")
    )
    return F.coalesce(amount, mg_in_name(optional(df, "drug_source_value", "string")))


def _end_date(df: DataFrame, as_of: str | None) -> Column:
    """End date, or ``as_of`` (today by default) when the source has no such column."""
    if "drug_exposure_end_date" in df.columns:
        return day(df, "drug_exposure_end_date")
    log.warning("drug_exposure_end_date is absent; the as-of date stands in for it")
    return F.lit(as_of).cast("date") if as_of else F.current_date()


def _candidates(
    df: DataFrame,
    original: Column,
    tablets: Column,
    freq: Column,
    strength: Column,
    methods: Sequence[str],
    as_of: str | None,
) -> _Candidates:
    amount = number(df, "quantity") * strength
    supply = number(df, "days_supply")
    days = positive_days(day(df, "drug_exposure_start_date"), _end_date(df, as_of))
    dose = {
        "original": F.when(original > 0, original),
        "tablets_freq": tablets * freq * strength,
        "supply_based": F.try_divide(amount, F.when(supply > 0, supply)),
        "actual_duration": F.try_divide(amount, days),
    }
    none = F.lit(None).cast("double")
    return _Candidates(
        strength, {m: (c if m in methods else none) for m, c in dose.items()}
    )


def calc_daily_dose_baseline(
    df: DataFrame,
    methods: Sequence[str] = V.DOSE_METHODS,
    m2_sig_parse: str = "auto",
    max_daily_dose_mg: float | None = V.MAX_DAILY_DOSE_MG,
    filter_oral: bool = True,
    equiv_table: DataFrame | None = None,
    drug_name_map: Sequence[tuple[str, str]] | None = None,
    strict_original: bool = False,
    as_of: str | None = None,
) -> DataFrame:
    """Impute a daily dose from structured fields, first candidate in order wins.

    ``m2_sig_parse='auto'`` reads ``tablets`` and ``freq_per_day`` from the
    prescription text when the source gives no value for either in any row.
    After such a parse a source without ``daily_dose`` also offers the parsed
    ``daily_dose_mg`` as its original dose; ``strict_original=True`` turns that
    off.
    """
    if m2_sig_parse not in ("auto", "warn", "none"):
        raise ValueError("m2_sig_parse must be 'auto', 'warn' or 'none'")
    require_columns(df, ["drug_exposure_start_date"])
    methods = [m for m in methods if m in DOSE_COLUMN]
    if "drug_name_std" not in df.columns:
        df = with_drug_name(df, drug_name_map=drug_name_map)
    df = known_steroids(df, equiv_table)
    if filter_oral:
        df = oral_only(df)

    source_dose = first_present(df, ("daily_dose", "daily_dose_mg"))
    wants_parse = "tablets_freq" in methods and "sig" in df.columns
    if wants_parse and m2_sig_parse == "warn":
        log.warning("tablets_freq may stay empty: the prescription text is not parsed")
    if wants_parse and m2_sig_parse == "auto":
        df, original, tablets, freq = _auto_parsed(df, source_dose, strict_original)
    else:
        original = number(df, source_dose)
        tablets, freq = number(df, "tablets"), number(df, "freq_per_day")

    df = df.withColumns(
        {
            "__original": original,
            "__tablets": tablets,
            "__freq": freq,
            "strength_mg": strength_mg(df),
        }
    )
    c = _candidates(
        df,
        F.col("__original"),
        F.col("__tablets"),
        F.col("__freq"),
        F.col("strength_mg"),
        methods,
        as_of,
    )
    df = df.withColumns({DOSE_COLUMN[m]: e for m, e in c.dose.items()})
    named = _Candidates(c.strength, {m: F.col(DOSE_COLUMN[m]) for m in c.dose})
    df = df.withColumns(
        {
            "daily_dose_mg_imputed": named.first(methods),
            "imputation_method": named.first_method(methods),
        }
    ).drop("__original", "__tablets", "__freq")
    return df.withColumns(
        {
            "daily_dose_mg_imputed": plausible(
                F.col("daily_dose_mg_imputed"), max_daily_dose_mg
            ),
            "imputation_method": F.when(
                exceeds(F.col("daily_dose_mg_imputed"), max_daily_dose_mg), "missing"
            ).otherwise(F.col("imputation_method")),
        }
    )


def _auto_parsed(
    df: DataFrame, source_dose: str | None, strict_original: bool
) -> tuple[DataFrame, Column, Column, Column]:
    """Parse ``sig``; decide per table whether the parsed values are used.

    Without ``tablets`` and ``freq_per_day`` columns the answer is known from
    the schema.  With them it depends on the data, and one scalar subquery asks
    whether any row has a value; the main plan stays a single pass.
    """
    source = {c: f"__src_{c}" for c in PARSED_FIELDS if c in df.columns}
    given = [source[c] for c in ("tablets", "freq_per_day") if c in source]
    kept = df.withColumns({new: F.col(old) for old, new in source.items()})
    parsed = take_reading(kept, "sig", advanced=False)
    dose_from_sig = None if strict_original else "daily_dose_mg"

    if not given:
        if source_dose is None:
            original = number(parsed, dose_from_sig)
        else:
            original = number(parsed, source.get(source_dose, source_dose))
        parsed = parsed.drop(*[n for c, n in source.items() if c != "daily_dose_mg"])
        if "daily_dose_mg" in source:
            parsed = parsed.withColumnRenamed(source["daily_dose_mg"], "daily_dose_mg_src")
            if source_dose == "daily_dose_mg":
                original = number(parsed, "daily_dose_mg_src")
        return parsed, original, number(parsed, "tablets"), number(parsed, "freq_per_day")

    has_value = F.lit(False)
    for c in ("tablets", "freq_per_day"):
        if c in source:
            has_value = has_value | number(df, c).isNotNull()
    use_parse = (
        df.agg(
            (
                ~F.coalesce(F.bool_or(has_value), F.lit(False))
                & F.coalesce(F.bool_or(~is_blank(F.col("sig"))), F.lit(False))
            ).alias("use_parse")
        )
    ).scalar()
    parsed = parsed.withColumn("__use", use_parse)
    use = F.col("__use")

    def choose(c: str) -> Column:
        return F.when(use, number(parsed, c)).otherwise(number(parsed, source.get(c)))

    if source_dose is not None:
        original = number(parsed, source.get(source_dose, source_dose))
    else:
        original = F.when(use, number(parsed, dose_from_sig))
    columns = {"tablets": choose("tablets"), "freq_per_day": choose("freq_per_day")}
    chosen = parsed.withColumns({"__original": original, **columns})
    chosen = chosen.drop("__use", *[n for c, n in source.items() if c != "daily_dose_mg"])
    if "daily_dose_mg" in source:
        chosen = chosen.withColumnRenamed(source["daily_dose_mg"], "daily_dose_mg_src")
    return chosen, F.col("__original"), F.col("tablets"), F.col("freq_per_day")


def _nlp(
    df: DataFrame,
    advanced: bool,
    expand: bool,
    drug_name_col: str,
    sig_col: str,
    filter_oral: bool,
    baseline_fallback: bool,
    max_daily_dose_mg: float | None,
    equiv_table: DataFrame | None,
    drug_name_map: Sequence[tuple[str, str]] | None,
    as_of: str | None,
) -> DataFrame:
    require_columns(df, [drug_name_col])
    if sig_col not in df.columns:
        df = df.withColumn(sig_col, F.lit(None).cast("string"))
    df = with_drug_name(df, drug_name_col, drug_name_map)
    df = known_steroids(df, equiv_table)
    if filter_oral:
        df = oral_only(df)

    # Parsed columns replace the source's; its dose stays readable beside them.
    if "daily_dose_mg" in df.columns:
        df = df.withColumnRenamed("daily_dose_mg", "daily_dose_mg_src")
    df = take_reading(df, sig_col, advanced)
    df = _strength_fallback(df)
    if advanced:
        df = _cap_parsed(df, max_daily_dose_mg)
        if expand:
            df = expand_tapers(df, sig_col)
    if baseline_fallback and "daily_dose_mg_orig" in df.columns:
        df = df.withColumn(
            "daily_dose_mg", F.coalesce("daily_dose_mg", number(df, "daily_dose_mg_orig"))
        )
    df = _structured_fallback(df, max_daily_dose_mg, as_of)
    return df if advanced else _cap_parsed(df, max_daily_dose_mg)


def _strength_fallback(df: DataFrame) -> DataFrame:
    """Dose of a text that names tablets and frequency but no strength."""
    name = first_present(df, NAME_COLUMNS)
    strength = F.coalesce(
        number(df, "amount_value"), mg_in_name(optional(df, name, "string"))
    )
    lacks_mg = (F.col("parsed_status") == "no_parse") & F.col("mg_per_admin").isNull()
    admin = F.col("__strength") * F.coalesce(F.col("tablets"), F.lit(1.0))
    df = df.withColumn("__strength", F.when(lacks_mg, strength))
    filled = F.col("__strength").isNotNull()
    df = df.withColumns(
        {
            "mg_per_admin": F.when(filled, admin).otherwise(F.col("mg_per_admin")),
            "daily_dose_mg": F.when(
                filled & F.col("freq_per_day").isNotNull(), admin * F.col("freq_per_day")
            ).otherwise(F.col("daily_dose_mg")),
        }
    )
    return df.withColumn(
        "parsed_status",
        F.when(filled & F.col("daily_dose_mg").isNotNull(), "ok").otherwise(
            F.col("parsed_status")
        ),
    ).drop("__strength")


def _structured_fallback(
    df: DataFrame, max_daily_dose_mg: float | None, as_of: str | None
) -> DataFrame:
    """Fill what the text left open from the structured fields of the same row."""
    source = first_present(df, ("daily_dose", "daily_dose_mg_src"))
    none = F.lit(None).cast("double")
    c = _candidates(
        df, number(df, source), none, none, strength_mg(df), FALLBACK_METHODS, as_of
    )
    still_open = F.col("daily_dose_mg").isNull() & F.col("parsed_status").isin(
        "no_parse", "empty"
    )
    # Evaluated for open rows only; a candidate's method follows from which one
    # is not NULL, so the three candidates are named once.
    df = df.withColumns(
        {"__open": still_open, **{f"__{m}": c.dose[m] for m in FALLBACK_METHODS}}
    )
    named = _Candidates(c.strength, {m: F.col(f"__{m}") for m in FALLBACK_METHODS})
    df = df.withColumn(
        "__dose",
        F.when(
            F.col("__open"), plausible(named.first(FALLBACK_METHODS), max_daily_dose_mg)
        ),
    )
    label = F.when(
        F.col("__dose").isNotNull(),
        F.concat(F.lit("fallback_"), named.first_method(FALLBACK_METHODS)),
    ).otherwise("no_parse")
    return df.withColumns(
        {
            "daily_dose_mg": F.coalesce("daily_dose_mg", "__dose"),
            "parsed_status": F.when(F.col("__open"), label).otherwise(
                F.col("parsed_status")
            ),
        }
    ).drop("__open", "__dose", *[f"__{m}" for m in FALLBACK_METHODS])


def _cap_parsed(df: DataFrame, max_daily_dose_mg: float | None) -> DataFrame:
    dose = F.col("daily_dose_mg")
    return df.withColumns(
        {
            "daily_dose_mg": plausible(dose, max_daily_dose_mg),
            "parsed_status": F.when(
                exceeds(dose, max_daily_dose_mg), "implausible"
            ).otherwise(F.col("parsed_status")),
        }
    )


def calc_daily_dose_nlp(
    df: DataFrame,
    drug_name_col: str = "drug_concept_name",
    sig_col: str = "sig",
    filter_oral: bool = True,
    baseline_fallback: bool = False,
    max_daily_dose_mg: float | None = V.MAX_DAILY_DOSE_MG,
    equiv_table: DataFrame | None = None,
    drug_name_map: Sequence[tuple[str, str]] | None = None,
    as_of: str | None = None,
) -> DataFrame:
    """Daily dose from the prescription text, structured fields where it fails."""
    return _nlp(
        df, False, False, drug_name_col, sig_col, filter_oral, baseline_fallback,
        max_daily_dose_mg, equiv_table, drug_name_map, as_of,
    )


def calc_daily_dose_nlp_advanced(
    df: DataFrame,
    drug_name_col: str = "drug_concept_name",
    sig_col: str = "sig",
    filter_oral: bool = True,
    expand_tapers: bool = True,
    max_daily_dose_mg: float | None = V.MAX_DAILY_DOSE_MG,
    baseline_fallback: bool = False,
    equiv_table: DataFrame | None = None,
    drug_name_map: Sequence[tuple[str, str]] | None = None,
    as_of: str | None = None,
) -> DataFrame:
    """``calc_daily_dose_nlp`` with the wider vocabulary and taper steps as rows.

    The plausibility cap is applied before tapers are expanded, so the dose of a
    single step is not capped.
    """
    return _nlp(
        df, True, expand_tapers, drug_name_col, sig_col, filter_oral, baseline_fallback,
        max_daily_dose_mg, equiv_table, drug_name_map, as_of,
    )


def dose_side_by_side(df: DataFrame, expand_tapers: bool = False) -> DataFrame:
    """Record-level doses of the three methods stacked under a ``method`` label.

    Where all three read the same names and texts, the oral rows are written with both
    readings of their texts first: names, routes and texts are read once.
    """
    shared = {"sig", "drug_concept_name"} <= set(df.columns) and "drug_name_std" not in df.columns
    shared = shared and not df.isStreaming
    if shared:
        df = written(parse_both(oral_only(known_steroids(with_drug_name(df)))))
    baseline = calc_daily_dose_baseline(df, filter_oral=not shared).withColumnRenamed(
        "daily_dose_mg_imputed", "dose_mg"
    )
    nlp = calc_daily_dose_nlp(df, filter_oral=not shared).withColumnRenamed(
        "daily_dose_mg", "dose_mg"
    )
    advanced = calc_daily_dose_nlp_advanced(
        df, expand_tapers=expand_tapers, filter_oral=not shared
    ).withColumnRenamed("daily_dose_mg", "dose_mg")
    stacked = [
        d.withColumn("method", F.lit(name))
        for name, d in (("Baseline", baseline), ("NLP", nlp), ("Advanced NLP", advanced))
    ]
    out = stacked[0]
    for other in stacked[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
