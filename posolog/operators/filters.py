"""Row filters shared by the dose methods."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posolog.functions import fixed_values as V
from posolog.functions.values import (
    canonical_name,
    clean_name,
    evaluated,
    route_class,
    route_text,
)
from posolog.schema import first_present, require_columns

log = logging.getLogger(__name__)

NAME_COLUMNS = ("drug_concept_name", "drug_source_value")
ROUTE_COLUMNS = ("route_concept_name", "route_source_value", "drug_source_value")


def with_drug_name(
    df: DataFrame,
    name_col: str | None = None,
    drug_name_map: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Add ``drug_name_std`` from ``name_col`` or the first usual name column."""
    source = name_col or first_present(df, NAME_COLUMNS)
    if source is None:
        return df
    require_columns(df, [source])
    cleaned = df.withColumn("__clean", clean_name(F.col(source)))
    name = canonical_name(F.col("__clean"), drug_name_map)
    return evaluated(cleaned, {"drug_name_std": name}).drop("__clean")


def with_route_class(df: DataFrame, out_col: str = "route_class") -> DataFrame:
    """Add the route class read from the first non-NULL route or drug text."""
    present = [F.col(c) for c in ROUTE_COLUMNS if c in df.columns]
    read = df.withColumn("__route", route_text(*present))
    return evaluated(read, {out_col: route_class(F.col("__route"))}).drop("__route")


def known_steroids(df: DataFrame, equiv_table: DataFrame | None = None) -> DataFrame:
    """Keep drugs with a potency factor.

    The built-in list is a literal predicate.  A caller's table is a semi join;
    its size is not ours to assume, so the optimizer picks the join.
    """
    if "drug_name_std" not in df.columns:
        return df
    if equiv_table is None:
        names = [n for n, f in V.PREDNISONE_FACTORS.items() if f is not None]
        return df.where(F.col("drug_name_std").isin(names))
    known = equiv_table.where("equiv_factor IS NOT NULL").select("drug_name_std")
    return df.join(known, "drug_name_std", "left_semi").select(*df.columns)


def oral_only(df: DataFrame) -> DataFrame:
    """Keep oral rows; a source without any route column is left as it is."""
    if not any(c in df.columns for c in ROUTE_COLUMNS):
        log.warning("no route column found; the oral filter is skipped")
        return df
    return with_route_class(df, "__class").where("__class = 'oral'").drop("__class")


def plausible(dose: Column, max_daily_dose_mg: float | None) -> Column:
    """The dose, or NULL above the cap.  ``None`` or infinity switches it off."""
    if not _has_cap(max_daily_dose_mg):
        return dose
    return F.when(dose <= F.lit(float(max_daily_dose_mg)), dose)


def exceeds(dose: Column, max_daily_dose_mg: float | None) -> Column:
    if not _has_cap(max_daily_dose_mg):
        return F.lit(False)
    return F.coalesce(dose > F.lit(float(max_daily_dose_mg)), F.lit(False))


def _has_cap(value: float | None) -> bool:
    return value is not None and value != float("inf")


def positive_doses(df: DataFrame, dose_col: str = "median_daily_dose") -> DataFrame:
    return df.where(F.col(dose_col) > 0)
