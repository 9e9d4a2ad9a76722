"""Column contract of the exposure table and helpers for optional columns.

Sources differ in which columns they carry.  Operators look at the schema while
the plan is built (never at the data) and read an absent column as a typed NULL,
so each operator is one static plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPOSURE = T.StructType(
    [
        T.StructField("person_id", T.LongType()),
        T.StructField("drug_exposure_id", T.LongType()),
        T.StructField("drug_concept_id", T.LongType()),
        T.StructField("drug_source_concept_id", T.LongType()),
        T.StructField("drug_exposure_start_date", T.DateType()),
        T.StructField("drug_exposure_end_date", T.DateType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("days_supply", T.DoubleType()),
        T.StructField("sig", T.StringType()),
        T.StructField("route_concept_id", T.LongType()),
        T.StructField("route_concept_name", T.StringType()),
        T.StructField("route_source_value", T.StringType()),
        T.StructField("dose_unit_source_value", T.StringType()),
        T.StructField("drug_source_value", T.StringType()),
        T.StructField("drug_concept_name", T.StringType()),
        T.StructField("amount_value", T.DoubleType()),
        T.StructField("amount_unit_concept_id", T.IntegerType()),
        T.StructField("daily_dose", T.DoubleType()),
        T.StructField("tablets", T.DoubleType()),
        T.StructField("freq_per_day", T.DoubleType()),
    ]
)
REQUIRED = ("person_id", "drug_exposure_start_date")

GOLD = T.StructType(
    [
        T.StructField("patient_id", T.LongType()),
        T.StructField("episode_start", T.DateType()),
        T.StructField("episode_end", T.DateType()),
        T.StructField("median_daily_dose", T.DoubleType()),
    ]
)


def require_columns(df: DataFrame, columns: Iterable[str], name: str = "input") -> None:
    """Raise when the schema of ``df`` lacks one of ``columns``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(
            f"{name} is missing required column(s): {', '.join(missing)}. "
            f"Available columns: {', '.join(df.columns)}"
        )


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate that is a column of ``df``."""
    return next((c for c in candidates if c in df.columns), None)


def optional(df: DataFrame, name: str | None, dtype: str) -> Column:
    """The column, or a typed NULL where the source does not carry it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def conform(df: DataFrame) -> DataFrame:
    """Add every absent column of the exposure contract as a typed NULL."""
    absent = {
        f.name: F.lit(None).cast(f.dataType)
        for f in EXPOSURE.fields
        if f.name not in df.columns
    }
    return df.withColumns(absent) if absent else df


def capabilities(df: DataFrame) -> dict[str, bool]:
    """What a source can support, read from its schema alone."""
    have = set(df.columns)
    return {
        "has_sig": "sig" in have,
        "has_days_supply": "days_supply" in have,
        "has_quantity": "quantity" in have,
        "has_route": bool(
            have & {"route_concept_id", "route_concept_name", "route_source_value"}
        ),
        "has_drug_source": "drug_source_value" in have,
        "has_drug_concept": "drug_concept_id" in have,
    }
