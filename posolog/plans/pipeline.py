"""The one-call pipeline: exposures to doses to episodes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame

from posolog.functions import fixed_values as V
from posolog.operators.convert import convert_pred_equiv
from posolog.operators.dose import (
    calc_daily_dose_baseline,
    calc_daily_dose_nlp,
    calc_daily_dose_nlp_advanced,
)
from posolog.operators.episodes import build_episodes
from posolog.operators.filters import with_drug_name
from posolog.operators.parse import parse_sig
from posolog.sources.exposure import ClinicalTables, IdSet, to_exposures

METHODS = ("baseline", "nlp", "nlp_advanced")


def run_pipeline(
    source: ClinicalTables | DataFrame,
    method: str = "baseline",
    m2_sig_parse: str = "auto",
    drug_concept_ids: IdSet = None,
    person_ids: IdSet = None,
    start_date: str | date | None = None,
    end_date: str | date | None = None,
    sig_source: str = "sig",
    gap_days: int = V.GAP_DAYS,
    equiv_table: DataFrame | None = None,
    return_level: str = "episode",
    drug_name_map: Sequence[tuple[str, str]] | None = None,
    expand_tapers: bool = False,
) -> DataFrame:
    """Doses per exposure, or episodes, in one lazy plan.

    ``m2_sig_parse='nlp_first'`` parses every text before the baseline cascade.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    if m2_sig_parse not in ("auto", "warn", "nlp_first", "none"):
        raise ValueError("m2_sig_parse must be 'auto', 'warn', 'nlp_first' or 'none'")
    if return_level not in ("episode", "exposure"):
        raise ValueError("return_level must be 'episode' or 'exposure'")

    rows = to_exposures(
        source,
        drug_concept_ids=drug_concept_ids,
        person_ids=person_ids,
        start_date=start_date,
        end_date=end_date,
        sig_source=sig_source,
    )
    if method == "baseline":
        dose_col = "daily_dose_mg_imputed"
        sig_parse = m2_sig_parse
        if m2_sig_parse == "nlp_first":
            sig_col = "sig" if "sig" in rows.columns else sig_source
            if sig_col in rows.columns:
                rows = parse_sig(rows, sig_col)
            sig_parse = "none"
        dosed = calc_daily_dose_baseline(
            rows, m2_sig_parse=sig_parse, drug_name_map=drug_name_map
        )
    else:
        dose_col = "daily_dose_mg"
        if method == "nlp":
            dosed = calc_daily_dose_nlp(rows, drug_name_map=drug_name_map)
        else:
            dosed = calc_daily_dose_nlp_advanced(
                rows, expand_tapers=expand_tapers, drug_name_map=drug_name_map
            )
    if "drug_name_std" not in dosed.columns:
        dosed = with_drug_name(dosed, drug_name_map=drug_name_map)
    dosed = convert_pred_equiv(dosed, dose_col=dose_col, equiv_table=equiv_table)
    if return_level == "exposure":
        return dosed
    end_col = "drug_exposure_end_date"
    return build_episodes(
        dosed,
        end_col=end_col if end_col in dosed.columns else None,
        dose_col="pred_equiv_mg",
        gap_days=gap_days,
    )
