"""Medication-dose analytics on Spark DataFrames."""

from posolog.operators.cohort import build_cohort, concept_set, persons_with_concepts
from posolog.operators.convert import convert_pred_equiv
from posolog.operators.dose import (
    calc_daily_dose_baseline,
    calc_daily_dose_nlp,
    calc_daily_dose_nlp_advanced,
    dose_side_by_side,
)
from posolog.operators.episodes import build_episodes
from posolog.operators.evaluate import (
    compare_episodes,
    day_agreement,
    evaluate_against_gold,
    gold_to_pred_equiv,
)
from posolog.operators.parse import (
    add_taper_schedule,
    expand_tapers,
    parse_sig,
    parse_sig_advanced,
)
from posolog.plans.pipeline import run_pipeline
from posolog.plans.study import run_study
from posolog.schema import capabilities, conform
from posolog.sources.exposure import (
    ClinicalTables,
    extract_exposures,
    select_exposures,
    to_exposures,
)

__all__ = [
    "ClinicalTables",
    "add_taper_schedule",
    "build_cohort",
    "build_episodes",
    "calc_daily_dose_baseline",
    "calc_daily_dose_nlp",
    "calc_daily_dose_nlp_advanced",
    "capabilities",
    "compare_episodes",
    "concept_set",
    "conform",
    "convert_pred_equiv",
    "day_agreement",
    "dose_side_by_side",
    "evaluate_against_gold",
    "expand_tapers",
    "extract_exposures",
    "gold_to_pred_equiv",
    "parse_sig",
    "parse_sig_advanced",
    "persons_with_concepts",
    "run_pipeline",
    "run_study",
    "select_exposures",
    "to_exposures",
]
