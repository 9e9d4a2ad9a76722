"""Tables behind the study's figures and reviews."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posolog.functions import fixed_values as V
from posolog.functions.stats import exact_quantiles
from posolog.functions.values import number
from posolog.operators.evaluate import matched_only
from posolog.operators.filters import positive_doses


def stack(tables: Mapping[str, DataFrame], label: str = "method") -> DataFrame:
    """Rows of all tables under a label column."""
    parts = [df.withColumn(label, F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


# ------------------------------------------------------------- counts (G6-G8) ---
def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their share in percent."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    # Summed from the counts, whose exchange is reused: the input is computed once.
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.lit(100.0) * F.col("n") / total)


def non_null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its number of non-NULL values; a single pass."""
    counted = df.agg(*[F.count(c).alias(c) for c in columns])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in columns]
    )
    return counted.select(F.inline(pairs))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; equal counts are ordered by value."""
    return (
        df.groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), F.col(column).asc_nulls_last())
        .limit(n)
    )


def top_unparsed_sigs(records: DataFrame, n: int = 15) -> DataFrame:
    return top_values(records.where("parsed_status = 'no_parse'"), "sig", n)


def top_patient_trajectories(episodes: DataFrame, n_patients: int = 3) -> DataFrame:
    """Episodes of the patients who have the most of them."""
    top = top_values(episodes, "person_id", n_patients).select("person_id")
    return episodes.join(top, "person_id", "left_semi").select(
        "person_id",
        "drug_name_std",
        "episode_start",
        "episode_end",
        "n_days",
        "n_records",
        "median_daily_dose",
        "mean_daily_dose",
    )


# ------------------------------------------------------ distributions (A1-A3) ---
def dose_rows(episodes: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """Positive doses of the stacked episodes, and of the gold standard."""
    columns = ["person_id", "drug_name_std", "median_daily_dose", "method"]
    rows = positive_doses(episodes).select(*columns)
    if gold is None:
        return rows
    drug = F.col("drug_name_std") if "drug_name_std" in gold.columns else F.lit(None)
    reviewed = positive_doses(gold).select(
        F.col("patient_id").alias("person_id"),
        F.coalesce(drug, F.lit("unknown")).alias("drug_name_std"),
        "median_daily_dose",
        F.lit("Gold").alias("method"),
    )
    return rows.unionByName(reviewed)


def dose_distribution(rows: DataFrame) -> DataFrame:
    """Counts, five-number summary and mean per method; quantiles are exact."""
    dose = "median_daily_dose"
    simple = rows.groupBy("method").agg(
        F.count("*").alias("n_episodes"),
        F.countDistinct("person_id").alias("n_patients"),
        F.min(dose).alias("min"),
        F.avg(dose).alias("mean"),
        F.max(dose).alias("max"),
    )
    quantiles = exact_quantiles(
        rows, dose, {"q25": 0.25, "median": 0.5, "q75": 0.75}, by=["method"]
    )
    return simple.join(quantiles, "method").select(
        "method", "n_episodes", "n_patients", "min", "q25", "median", "mean", "q75", "max"
    )


def scatter_pairs(comparison: DataFrame) -> DataFrame:
    return matched_only(comparison).select(
        "method", "patient_id", "gold_dose", F.col("computed_dose").alias("method_dose")
    )


def bland_altman_pairs(pairs: DataFrame) -> DataFrame:
    complete = pairs.where("gold_dose IS NOT NULL AND method_dose IS NOT NULL")
    return complete.withColumns(
        {
            "mean_dose": (F.col("method_dose") + F.col("gold_dose")) / 2,
            "diff": F.col("method_dose") - F.col("gold_dose"),
        }
    )


def bland_altman_limits(ba_pairs: DataFrame) -> DataFrame:
    limits = ba_pairs.groupBy("method").agg(
        F.count("*").alias("n"),
        F.avg("diff").alias("bias"),
        F.stddev_samp("diff").alias("sd_diff"),
    )
    reach = F.lit(V.LIMITS_OF_AGREEMENT_Z) * F.col("sd_diff")
    return limits.withColumns(
        {"loa_lo": F.col("bias") - reach, "loa_hi": F.col("bias") + reach}
    )


# ------------------------------------------------------------- errors (A4-A6) ---
def high_errors(
    comparison: DataFrame,
    abs_error_mg: float = V.HIGH_ERROR_MG,
    rel_error_pct: float = V.HIGH_ERROR_PCT,
) -> DataFrame:
    """Matched gold episodes whose absolute or relative error is large.

    An infinite relative error (gold dose zero) counts as large.
    """
    zero_gold = (F.col("gold_dose") == 0) & (F.col("bias_error") != 0)
    return matched_only(comparison).where(
        (F.col("absolute_error") > abs_error_mg)
        | (F.col("absolute_relative_error_pct") > rel_error_pct)
        | zero_gold
    )


def top_errors(errors: DataFrame, n: int = 10) -> DataFrame:
    return errors.orderBy(
        F.col("absolute_error").desc_nulls_last(),
        "patient_id",
        "episode_start",
        "episode_end",
        "gold_dose",
        "computed_dose",
        *(["method"] if "method" in errors.columns else []),
    ).limit(n)


def high_error_context(
    errors: DataFrame, gold: DataFrame, records: DataFrame, n_patients: int = 20
) -> dict[str, DataFrame]:
    """Gold rows, raw records and errors of the patients with the largest errors."""
    worst = (
        errors.groupBy("patient_id")
        .agg(F.max("absolute_error").alias("worst"))
        .orderBy(F.col("worst").desc_nulls_last(), "patient_id")
        .limit(n_patients)
        .select("patient_id")
    )
    people = worst.withColumnRenamed("patient_id", "person_id")
    return {
        "gold": gold.join(worst, "patient_id", "left_semi"),
        "records": records.join(people, "person_id", "left_semi"),
        "errors": errors.join(worst, "patient_id", "left_semi"),
    }


def errors_with_gold_drug(errors: DataFrame, gold: DataFrame) -> DataFrame:
    """High errors beside the drug and raw dose of their gold episode."""
    extra = [c for c in ("drug_name_std", "median_daily_dose_raw") if c in gold.columns]
    key = ["patient_id", "episode_start", "episode_end"]
    return errors.join(gold.select(*key, *extra), key, "left")


def error_by_drug(errors: DataFrame, gold: DataFrame) -> DataFrame:
    return (
        errors_with_gold_drug(errors, gold)
        .groupBy("method", "drug_name_std")
        .agg(
            F.count("*").alias("n"),
            F.avg("absolute_error").alias("MAE"),
            F.avg("bias_error").alias("MBE"),
            F.avg("absolute_relative_error_pct").alias("MAPE"),
        )
    )


def error_by_direction(errors: DataFrame) -> DataFrame:
    return errors.groupBy("method", "error_direction").agg(
        F.count("*").alias("n"), F.avg("absolute_error").alias("mean_abs_error")
    )


# -------------------------------------------------------- eligibility (A7-A8) ---
def _per_method(
    stacked: DataFrame, methods: Sequence[str], first: int, label: str, *aggregates
) -> DataFrame:
    """One funnel step per method in a single aggregation; empty methods show zero."""
    names = F.array(
        *[
            F.struct(
                F.lit(first + i).alias("step_order"),
                F.lit(label.format(m)).alias("Step"),
                F.lit(m).alias("method"),
            )
            for i, m in enumerate(methods)
        ]
    )
    rows = stacked.sparkSession.range(1).select(F.inline(names))
    counts = stacked.groupBy("method").agg(*aggregates)
    return rows.join(counts, "method", "left").drop("method").fillna(0)


def eligibility_funnel(
    raw: DataFrame,
    oral_records: DataFrame,
    episodes: DataFrame,
    gold: DataFrame,
    comparison: DataFrame,
    methods: Sequence[str],
) -> DataFrame:
    """Patients and episodes left after each step of the study.

    ``episodes`` and ``comparison`` are stacked under ``method``.
    """
    none = F.lit(None).cast("bigint")

    def step(order: int, label: str, df: DataFrame, person: str, rows: bool = True):
        return df.agg(
            F.lit(order).alias("step_order"),
            F.lit(label).alias("Step"),
            F.countDistinct(person).alias("Patients"),
            (F.count("*") if rows else none).alias("Episodes"),
        )

    patients = F.countDistinct("person_id").alias("Patients")
    rows = F.count("*").alias("Episodes")
    n = len(methods)
    gold_people = gold.select(F.col("patient_id").alias("person_id"))
    raw_people = raw.select(F.col("person_id").alias("patient_id"))
    reviewed = episodes.join(gold_people, "person_id", "left_semi")
    parts = [
        step(1, "DB: raw records (all steroids)", raw, "person_id"),
        step(2, "DB: after oral/drug filter", oral_records, "person_id"),
        _per_method(episodes, methods, 3, "DB: with >=1 episode ({})", patients, rows),
        step(3 + n, "Gold: total", gold, "patient_id"),
        step(
            4 + n,
            "Gold: found in DB",
            gold.join(raw_people, "patient_id", "left_semi"),
            "patient_id",
            rows=False,
        ),
        _per_method(reviewed, methods, 5 + n, "Gold: with {} episode", patients).withColumn(
            "Episodes", none
        ),
        _per_method(
            matched_only(comparison), methods, 5 + 2 * n, "Gold eps matched ({})", rows
        ).withColumn("Patients", none),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def episode_counts(episodes: DataFrame, gold: DataFrame, comparison: DataFrame) -> DataFrame:
    """Patients, episodes, matches and median dose per method and for the gold."""
    columns = ["method", "person_id", "median_daily_dose"]
    stacked = episodes.select(*columns).unionByName(
        gold.select(
            F.lit("Gold Standard").alias("method"),
            F.col("patient_id").alias("person_id"),
            "median_daily_dose",
        )
    )
    counts = stacked.groupBy("method").agg(
        F.countDistinct("person_id").alias("Patients"), F.count("*").alias("Episodes")
    )
    matches = comparison.groupBy("method").agg(
        F.count("computed_dose").alias("Overlap_with_Gold")
    )
    medians = exact_quantiles(stacked, "median_daily_dose", {"Median_mg": 0.5}, ["method"])
    return (
        counts.join(matches, "method", "left")
        .join(medians, "method", "left")
        .select(
            F.col("method").alias("Source"),
            "Patients",
            "Episodes",
            "Overlap_with_Gold",
            "Median_mg",
        )
    )


def dropped_patients(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """Patients of ``raw`` without any row in ``kept``."""
    return (
        raw.select("person_id")
        .join(kept.select("person_id"), "person_id", "left_anti")
        .distinct()
    )


def dropped_patient_drugs(raw: DataFrame, kept: DataFrame, n: int = 10) -> DataFrame:
    lost = raw.join(kept.select("person_id"), "person_id", "left_anti")
    return top_values(lost, "drug_name_std", n)


def gold_missing_from(raw: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold episodes of patients without any raw record."""
    people = raw.select(F.col("person_id").alias("patient_id"))
    return gold.join(people, "patient_id", "left_anti")


def unmatched_gold(comparison: DataFrame) -> DataFrame:
    return comparison.where("computed_dose IS NULL").select(
        "patient_id", "episode_start", "episode_end", "gold_dose"
    )


def unmatched_gold_records(comparison: DataFrame, raw: DataFrame) -> DataFrame:
    """Raw records of the patients who have an unmatched gold episode."""
    people = unmatched_gold(comparison).select(F.col("patient_id").alias("person_id"))
    return raw.join(people, "person_id", "left_semi")


# ----------------------------------------------------------- review tables (A9) ---
def timeline_segments(
    episodes: DataFrame, dose_col: str = "median_daily_dose"
) -> DataFrame:
    """Stacked episodes as line segments (person, drug, method, x, xend, y)."""
    person = "person_id" if "person_id" in episodes.columns else "patient_id"
    drug = F.col("drug_name_std") if "drug_name_std" in episodes.columns else F.lit("unknown")
    return episodes.where(F.col(dose_col).isNotNull()).select(
        F.col(person).cast("string").alias("person_id"),
        drug.alias("drug_name_std"),
        "method",
        F.col("episode_start").alias("x"),
        F.col("episode_end").alias("xend"),
        number(episodes, dose_col).alias("y"),
    )


def review_rows(
    rows: DataFrame,
    person_ids: Sequence[str] | None = None,
    drugs: Sequence[str] | None = None,
) -> DataFrame:
    """Stacked episodes or records of chosen persons and drugs."""
    if "person_id" not in rows.columns and "patient_id" in rows.columns:
        rows = rows.withColumnRenamed("patient_id", "person_id")
    if person_ids is not None:
        wanted = [str(p) for p in person_ids]
        rows = rows.where(F.col("person_id").cast("string").isin(wanted))
    if drugs is not None and "drug_name_std" in rows.columns:
        rows = rows.where(F.col("drug_name_std").isin(list(drugs)))
    return rows
