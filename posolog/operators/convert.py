"""Conversion of native doses to prednisone-equivalents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posolog.functions import fixed_values as V
from posolog.functions.values import canonical_name, clean_name, evaluated, number
from posolog.schema import first_present, require_columns

DRUG_FALLBACKS = ("dmard_name", "drug_concept_name", "ingredient_concept_name")


def convert_pred_equiv(
    df: DataFrame,
    drug_col: str = "drug_name_std",
    dose_col: str = "daily_dose_mg",
    out_col: str = "pred_equiv_mg",
    equiv_table: DataFrame | None = None,
    drug_name_map: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Add ``out_col``, ``equiv_factor`` and ``pred_equiv_status``.

    The seven built-in factors are a map literal, so no join is planned.  A
    caller's table (``drug_name_std``, ``equiv_factor``) is a left join whose
    strategy the optimizer picks from the table's size.
    """
    if drug_col not in df.columns:
        found = first_present(df, DRUG_FALLBACKS)
        if found is None:
            raise ValueError(
                f"column {drug_col!r} not found; tried {', '.join(DRUG_FALLBACKS)}. "
                f"Available columns: {', '.join(df.columns)}"
            )
        drug_col = found
    require_columns(df, [dose_col])

    keep = [c for c in df.columns if c not in (out_col, "equiv_factor", "pred_equiv_status")]
    # A name of the table is its own standard name, unless the caller has rules.
    given = F.col(drug_col).cast("string")
    standard = F.lit(False) if drug_name_map else F.coalesce(
        given.isin(list(V.PREDNISONE_FACTORS)), F.lit(False)
    )
    cleaned = df.withColumn("__clean", F.when(~standard, clean_name(F.col(drug_col))))
    name = canonical_name(F.col("__clean"), drug_name_map)
    named = evaluated(cleaned, {"__name": F.when(standard, given).otherwise(name)})
    if equiv_table is None:
        factors = F.create_map(
            *[
                F.lit(x).cast(t)
                for drug, factor in V.PREDNISONE_FACTORS.items()
                for x, t in ((drug, "string"), (factor, "double"))
            ]
        )
        joined = named.withColumns(
            {
                "equiv_factor": F.try_element_at(factors, F.col("__name")),
                "__in_table": F.col("__name").isin(list(V.PREDNISONE_FACTORS)),
            }
        )
    else:
        require_columns(equiv_table, ["drug_name_std", "equiv_factor"], "equiv_table")
        table = equiv_table.select(
            F.col("drug_name_std").alias("__name"),
            F.col("equiv_factor").cast("double").alias("equiv_factor"),
            F.lit(True).alias("__in_table"),
        )
        joined = named.select(*[c for c in named.columns if c != "equiv_factor"]).join(
            table, "__name", "left"
        )
    factor = F.col("equiv_factor")
    status = (
        F.when(factor.isNotNull(), "ok")
        .when(F.col("__in_table"), "missing_factor")
        .otherwise("unknown_drug")
    )
    return joined.select(
        *keep,
        (number(df, dose_col) * factor).alias(out_col),
        factor,
        status.alias("pred_equiv_status"),
    )
