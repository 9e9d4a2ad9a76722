"""The whole comparison study: three methods against one gold standard.

The methods are stacked under a ``method`` column, so episodes, comparison and
metrics of all three are one pass each.  Tables that later stages share are
written once and read back, which cuts the lineage at a copy that outlives lost
executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from posolog.functions import fixed_values as V
from posolog.operators import analysis as A
from posolog.operators.convert import convert_pred_equiv
from posolog.operators.dose import (
    calc_daily_dose_baseline,
    calc_daily_dose_nlp,
    calc_daily_dose_nlp_advanced,
)
from posolog.operators.episodes import build_episodes
from posolog.operators.evaluate import (
    by_dose_range,
    compare_episodes,
    day_agreement,
    gold_to_pred_equiv,
    metrics_table,
    summarise,
)
from posolog.operators.filters import known_steroids, oral_only, with_drug_name
from posolog.operators.parse import parse_both, without_readings
from posolog.session import written
from posolog.sources.files import write_tables

METHODS = ("Baseline", "NLP", "Advanced NLP")


def method_records(exposures: DataFrame, m2_sig_parse: str = "warn") -> dict[str, DataFrame]:
    """Record-level doses of each method with prednisone-equivalents."""
    named = with_drug_name(exposures)
    return _doses_of(oral_only(known_steroids(named)), m2_sig_parse)


def _doses_of(oral: DataFrame, m2_sig_parse: str = "warn") -> dict[str, DataFrame]:
    """``oral`` may hold the readings of ``parse_both``; else each text method parses."""
    baseline = calc_daily_dose_baseline(
        without_readings(oral), m2_sig_parse=m2_sig_parse, filter_oral=False
    )
    nlp = calc_daily_dose_nlp(oral, filter_oral=False)
    advanced = calc_daily_dose_nlp_advanced(oral, filter_oral=False, expand_tapers=False)
    return {
        "Baseline": convert_pred_equiv(baseline, dose_col="daily_dose_mg_imputed"),
        "NLP": convert_pred_equiv(nlp),
        "Advanced NLP": convert_pred_equiv(advanced),
    }


_EPISODE_INPUT = (
    "person_id",
    "drug_name_std",
    "drug_exposure_start_date",
    "drug_exposure_end_date",
    "pred_equiv_mg",
)


def stacked_episodes(records: dict[str, DataFrame], gap_days: int = V.GAP_DAYS) -> DataFrame:
    """Episodes of all methods in one pass, told apart by ``method``."""
    rows = A.stack({name: df.select(*_EPISODE_INPUT) for name, df in records.items()})
    return build_episodes(
        rows,
        end_col="drug_exposure_end_date",
        dose_col="pred_equiv_mg",
        gap_days=gap_days,
        by=["method"],
    )


@dataclass(frozen=True)
class StudyTables:
    """Shared tables of a study, each written once."""

    raw: DataFrame
    oral: DataFrame
    records: dict[str, DataFrame]
    episodes: DataFrame
    gold: DataFrame
    comparison: DataFrame


def study_tables(
    exposures: DataFrame, gold: DataFrame, gap_days: int = V.GAP_DAYS
) -> StudyTables:
    """Records, episodes, converted gold standard and comparison of all methods.

    The oral steroid rows are written before the methods branch, with both readings
    of their texts: names, routes and texts are read once.
    """
    raw = with_drug_name(exposures)
    rows = oral_only(known_steroids(raw))
    read = written(parse_both(rows) if "sig" in rows.columns else rows)
    records = _doses_of(read)
    oral = without_readings(read)
    # In one folder: a folder a method would have the rows sorted once more.
    episodes = written(stacked_episodes(records, gap_days))
    reviewed = written(gold_to_pred_equiv(gold, oral))
    comparison = written(compare_episodes(episodes, reviewed, methods=METHODS))
    return StudyTables(raw, oral, records, episodes, reviewed, comparison)


@dataclass(frozen=True)
class StudyResult:
    tables: dict[str, DataFrame]
    paths: dict[str, str]


def result_tables(
    study: StudyTables,
    threshold_mg: float | None = V.DAY_AGREEMENT_MG,
    threshold_pct: float | None = None,
) -> dict[str, DataFrame]:
    """Every result table of the study, lazily."""
    scatter = A.scatter_pairs(study.comparison)
    ba_pairs = A.bland_altman_pairs(scatter)
    doses = A.dose_rows(study.episodes, study.gold)
    errors = A.high_errors(study.comparison)
    slug = {name: name.lower().replace(" ", "_") for name in METHODS}
    return {
        **{f"records_{slug[n]}": df for n, df in study.records.items()},
        "episodes": study.episodes,
        "gold_standard": study.gold,
        "comparison": study.comparison,
        "summary": summarise(study.comparison, ["method"]),
        "by_dose_range": by_dose_range(study.comparison, by=["method"]),
        "episode_counts": A.episode_counts(study.episodes, study.gold, study.comparison),
        "metrics_table": metrics_table(study.comparison, study.episodes, study.gold),
        "agreement_table": day_agreement(
            study.episodes, study.gold, threshold_mg, threshold_pct, by=["method"]
        ),
        "plot_data_dose_distribution": doses,
        "dose_distribution": A.dose_distribution(doses),
        "plot_data_scatter": scatter,
        "plot_data_bland_altman": ba_pairs,
        "bland_altman_limits": A.bland_altman_limits(ba_pairs),
        "high_error_episodes": A.errors_with_gold_drug(errors, study.gold),
        "error_by_drug": A.error_by_drug(errors, study.gold),
        "error_by_direction": A.error_by_direction(errors),
        "eligibility": A.eligibility_funnel(
            study.raw, study.oral, study.episodes, study.gold, study.comparison, METHODS
        ),
        "timeline_segments": A.timeline_segments(study.episodes),
    }


def run_study(
    exposures: DataFrame,
    gold: DataFrame,
    output_dir: str,
    gap_days: int = V.GAP_DAYS,
    threshold_mg: float | None = V.DAY_AGREEMENT_MG,
    threshold_pct: float | None = None,
    file_format: str = "parquet",
) -> StudyResult:
    """Run the study and write its result tables under ``output_dir``."""
    study = study_tables(exposures, gold, gap_days)
    tables = result_tables(study, threshold_mg, threshold_pct)
    return StudyResult(tables, write_tables(tables, output_dir, file_format))
