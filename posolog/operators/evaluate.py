"""Comparison of computed episodes with a reviewed gold standard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posolog.functions import fixed_values as V
from posolog.functions.stats import exact_quantiles, pearson, spearman
from posolog.functions.values import bucket, day, inclusive_days, number, overlap_days
from posolog.operators.convert import convert_pred_equiv
from posolog.operators.joins import overlap_join
from posolog.schema import require_columns


@dataclass(frozen=True)
class Evaluation:
    comparison: DataFrame
    summary: DataFrame
    by_dose_range: DataFrame
    by_taper_status: DataFrame | None


def compare_episodes(
    computed: DataFrame,
    gold: DataFrame,
    min_overlap_days: int = 1,
    computed_id_col: str = "person_id",
    computed_start_col: str = "episode_start",
    computed_end_col: str = "episode_end",
    computed_dose_col: str = "median_daily_dose",
    gold_id_col: str = "patient_id",
    gold_start_col: str = "episode_start",
    gold_end_col: str = "episode_end",
    gold_dose_col: str = "median_daily_dose",
    methods: Sequence[str] | None = None,
) -> DataFrame:
    """One row per gold episode with the computed episode that overlaps it most.

    With ``methods`` the computed episodes carry a ``method`` column, and every
    gold episode is compared once per method in the same pass.

    The best match is an aggregate (smallest of a struct that orders by overlap,
    then drug and start), so candidates are reduced before they are shuffled.
    Gold rows that repeat are counted once and restored at the end.
    """
    if min_overlap_days < 1:
        raise ValueError("min_overlap_days must be at least 1")
    require_columns(
        computed,
        [computed_id_col, computed_start_col, computed_end_col, computed_dose_col],
        "computed",
    )
    require_columns(gold, [gold_id_col, gold_start_col, gold_end_col, gold_dose_col], "gold")

    drug = F.col("drug_name_std") if "drug_name_std" in computed.columns else F.lit("")
    candidates = computed.select(
        *([F.col("method").alias("c_method")] if methods else []),
        F.col(computed_id_col).alias("c_person"),
        drug.alias("c_drug"),
        day(computed, computed_start_col).alias("c_start"),
        day(computed, computed_end_col).alias("c_end"),
        number(computed, computed_dose_col).alias("c_dose"),
    )
    key = ["patient_id", "episode_start", "episode_end", "gold_dose"]
    reviewed = (
        gold.select(
            F.col(gold_id_col).alias("patient_id"),
            day(gold, gold_start_col).alias("episode_start"),
            day(gold, gold_end_col).alias("episode_end"),
            number(gold, gold_dose_col).alias("gold_dose"),
        )
        .groupBy(*key)
        .agg(F.count("*").alias("copies"))
    )
    pairs = overlap_join(
        reviewed,
        candidates.where(F.col("c_method").isin(list(methods))) if methods else candidates,
        [("patient_id", "c_person")],
        ("episode_start", "episode_end"),
        ("c_start", "c_end"),
    )
    shared = overlap_days(
        F.col("episode_start"), F.col("episode_end"), F.col("c_start"), F.col("c_end")
    )
    choice = F.struct(
        (-shared).alias("less_overlap"),
        F.col("c_drug"),
        F.col("c_start"),
        F.col("c_end"),
        F.col("c_dose"),
    )
    if methods:
        key = [*key, "method"]
        pairs = pairs.withColumnRenamed("c_method", "method")
        labels = F.array(*[F.lit(m) for m in methods])
        reviewed = reviewed.select("*", F.explode(labels).alias("method"))
    found = pairs.where(shared >= min_overlap_days).select(*key, "copies", choice.alias("choice"))
    # A gold episode is a row without a choice beside its pairs, so it stays if none fits.
    unmatched = reviewed.select(
        *key, "copies", F.lit(None).cast(found.schema["choice"].dataType).alias("choice")
    )
    best = found.unionByName(unmatched).groupBy(*key, "copies").agg(F.min("choice").alias("best"))
    key = [*(["method"] if methods else []), *[c for c in key if c != "method"]]
    one_per_copy = best.select(
        *key,
        F.col("best.c_dose").alias("computed_dose"),
        (-F.col("best.less_overlap")).alias("overlap_days"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"),
    ).drop("__copy")
    return _with_errors(one_per_copy)


def _with_errors(matched: DataFrame) -> DataFrame:
    computed, gold = F.col("computed_dose"), F.col("gold_dose")
    duration = inclusive_days(F.col("episode_start"), F.col("episode_end"))
    out = matched.withColumns(
        {
            "gold_duration": duration,
            "overlap_pct": F.try_divide(F.lit(100.0) * F.col("overlap_days"), duration),
            "bias_error": computed - gold,
        }
    ).withColumns(
        {
            "absolute_error": F.abs("bias_error"),
            # A gold dose of zero has no relative error; it is NULL here.
            "relative_error_pct": F.try_divide(F.col("bias_error"), gold) * 100,
        }
    )
    out = out.withColumn("absolute_relative_error_pct", F.abs("relative_error_pct"))
    relative, bias = F.col("absolute_relative_error_pct"), F.col("bias_error")
    *graded, (_, worst) = V.AGREEMENT_CATEGORIES
    category = F.when((gold == 0) & (bias != 0), worst)
    for limit, label in graded:
        category = category.when(relative <= limit, label)
    category = category.when(relative.isNotNull(), worst)
    direction = (
        F.when(bias > 0, "Over-estimation")
        .when(bias < 0, "Under-estimation")
        .when(bias == 0, "Exact match")
    )
    return out.withColumns({"agreement_category": category, "error_direction": direction})


def matched_only(comparison: DataFrame) -> DataFrame:
    return comparison.where("computed_dose IS NOT NULL")


def _error_means() -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.avg("absolute_error").alias("MAE"),
        F.avg("bias_error").alias("MBE"),
        F.avg("absolute_relative_error_pct").alias("MAPE"),
    ]


SUMMARY_COLUMNS = (
    "n_gold_periods",
    "n_matched_periods",
    "coverage_pct",
    "MAE",
    "MBE",
    "RMSE",
    "median_AE",
    "MAPE",
    "mean_relative_bias_pct",
    "pearson_corr",
    "spearman_corr",
)


def summarise(comparison: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summary of a comparison: one row, or one per group of ``by``."""
    matched = F.col("computed_dose").isNotNull()

    def over_matched(column: str) -> Column:
        return F.when(matched, F.col(column))

    pairs = matched_only(comparison)
    means = comparison.groupBy(*by).agg(
        F.count("*").alias("n_gold_periods"),
        F.count("computed_dose").alias("n_matched_periods"),
        F.try_divide(F.lit(100.0) * F.count("computed_dose"), F.count("*")).alias(
            "coverage_pct"
        ),
        F.avg(over_matched("absolute_error")).alias("MAE"),
        F.avg(over_matched("bias_error")).alias("MBE"),
        F.sqrt(F.avg(over_matched("bias_error") * F.col("bias_error"))).alias("RMSE"),
        F.avg(over_matched("absolute_relative_error_pct")).alias("MAPE"),
        F.avg(over_matched("relative_error_pct")).alias("mean_relative_bias_pct"),
        pearson(F.col("computed_dose"), F.col("gold_dose")).alias("pearson_corr"),
    )
    median = exact_quantiles(pairs, "absolute_error", {"median_AE": 0.5}, by)
    rank = spearman(pairs, "computed_dose", "gold_dose", by).withColumnRenamed(
        "spearman", "spearman_corr"
    )
    if by:
        full = means.join(median, list(by), "left").join(rank, list(by), "left")
    else:
        full = means.withColumns(
            {"median_AE": median.scalar(), "spearman_corr": rank.scalar()}
        )
    return full.select(*by, *SUMMARY_COLUMNS)


def by_dose_range(
    comparison: DataFrame,
    dose_breaks: Sequence[float] = V.DOSE_BREAKS,
    dose_labels: Sequence[str] = V.DOSE_LABELS,
    by: Sequence[str] = (),
) -> DataFrame:
    ranged = matched_only(comparison).withColumn(
        "dose_range", bucket(F.col("gold_dose"), dose_breaks, dose_labels)
    )
    return ranged.groupBy(*by, "dose_range").agg(*_error_means())


def by_taper_status(
    comparison: DataFrame,
    computed: DataFrame,
    computed_id_col: str = "person_id",
    computed_start_col: str = "episode_start",
) -> DataFrame:
    """Errors by ``has_taper`` of computed episodes that start with the gold episode."""
    tapers = computed.select(
        F.col(computed_id_col).alias("patient_id"),
        day(computed, computed_start_col).alias("episode_start"),
        "has_taper",
    )
    return (
        matched_only(comparison)
        .join(tapers, ["patient_id", "episode_start"], "left")
        .groupBy("has_taper")
        .agg(*_error_means())
    )


def evaluate_against_gold(
    computed: DataFrame,
    gold: DataFrame,
    min_overlap_days: int = 1,
    dose_breaks: Sequence[float] = V.DOSE_BREAKS,
    dose_labels: Sequence[str] = V.DOSE_LABELS,
    **columns: str,
) -> Evaluation:
    """Comparison, summary and strata as lazy tables.

    ``columns`` are the column-name arguments of ``compare_episodes``.  Callers
    that read several of the tables should write ``comparison`` once and build
    the rest from the written copy, as the study plan does.
    """
    if len(dose_breaks) != len(dose_labels) + 1:
        raise ValueError("dose_breaks must have exactly one more element than dose_labels")
    comparison = compare_episodes(computed, gold, min_overlap_days, **columns)
    taper = None
    if "has_taper" in computed.columns:
        taper = by_taper_status(
            comparison,
            computed,
            columns.get("computed_id_col", "person_id"),
            columns.get("computed_start_col", "episode_start"),
        )
    return Evaluation(
        comparison=comparison,
        summary=summarise(comparison),
        by_dose_range=by_dose_range(comparison, dose_breaks, dose_labels),
        by_taper_status=taper,
    )


def gold_drug_names(records: DataFrame, gold: DataFrame, pick: str = "most_frequent") -> DataFrame:
    """Drug of each gold episode, from the oral records that overlap it.

    ``most_frequent`` takes the drug with most records (ties by name);
    ``earliest`` the drug of the record that starts first.
    """
    if pick not in ("most_frequent", "earliest"):
        raise ValueError("pick must be 'most_frequent' or 'earliest'")
    key = ["patient_id", "episode_start", "episode_end"]
    exposures = records.select(
        F.col("person_id").alias("r_person"),
        F.col("drug_name_std").alias("r_drug"),
        day(records, "drug_exposure_start_date").alias("r_start"),
        day(records, "drug_exposure_end_date").alias("r_end"),
    ).where("r_drug IS NOT NULL")
    # Equal records of a person collapse before the join and keep their count.
    counted = exposures.groupBy("r_person", "r_drug", "r_start", "r_end").agg(
        F.count("*").alias("r_n")
    )
    episodes = gold.select(
        "patient_id",
        day(gold, "episode_start").alias("episode_start"),
        day(gold, "episode_end").alias("episode_end"),
    )
    pairs = overlap_join(
        episodes.distinct(),
        counted,
        [("patient_id", "r_person")],
        ("episode_start", "episode_end"),
        ("r_start", "r_end"),
    )
    if pick == "earliest":
        first = F.min(F.struct("r_start", "r_drug"))
        return pairs.groupBy(*key).agg(first["r_drug"].alias("drug_name_std"))
    per_drug = pairs.groupBy(*key, "r_drug").agg(F.sum("r_n").alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("n"), F.col("r_drug")))
    return per_drug.groupBy(*key).agg(top["r_drug"].alias("drug_name_std"))


def gold_to_pred_equiv(
    gold: DataFrame, records: DataFrame, pick: str = "most_frequent"
) -> DataFrame:
    """Gold doses as prednisone-equivalents; the raw dose stays where no factor fits."""
    key = ["patient_id", "episode_start", "episode_end"]
    dated = gold.withColumns(
        {c: day(gold, c) for c in ("episode_start", "episode_end")}
    )
    named = dated.drop("drug_name_std").join(
        gold_drug_names(records, gold, pick), key, "left"
    )
    converted = convert_pred_equiv(
        named, "drug_name_std", "median_daily_dose", "gold_pred_equiv_mg"
    )
    raw = F.col("median_daily_dose")
    return converted.withColumns(
        {
            "median_daily_dose_raw": raw,
            "median_daily_dose": F.coalesce(F.col("gold_pred_equiv_mg"), raw),
        }
    )


def day_agreement(
    computed: DataFrame,
    gold: DataFrame,
    threshold_mg: float | None = V.DAY_AGREEMENT_MG,
    threshold_pct: float | None = None,
    gold_id_col: str = "patient_id",
    gold_start_col: str = "episode_start",
    gold_end_col: str = "episode_end",
    gold_dose_col: str = "median_daily_dose",
    computed_dose_col: str = "median_daily_dose",
    by: Sequence[str] = (),
) -> DataFrame:
    """Patient-day agreement: counts and rates over each patient's gold window.

    ``by`` names columns of the computed episodes, such as a method label, that
    are judged separately in the same pass.

    No day is expanded: a sweep over the boundaries of a patient's episodes cuts the
    window into segments in which the same episodes hold, and a segment counts as
    many days as it has.  Where episodes overlap the first one gives the dose (of
    gold the earliest; computed ones by drug, then start).  An episode that an
    earlier one of its layer (all gold, or a drug) covers in part holds from the day
    after that one, which is a running maximum; so a layer's pieces are disjoint, and
    rows grow with episodes times drugs, whatever their lengths.  The days outside
    every episode follow from the length of the windows.  ``computed`` is read more
    than once, so pass a written table rather than a long plan.
    """
    if threshold_mg is None and threshold_pct is None:
        raise ValueError("threshold_mg and threshold_pct must not both be None")
    drug = F.col("drug_name_std") if "drug_name_std" in computed.columns else F.lit("")
    by = list(by)
    reviewed = (
        gold.select(
            F.col(gold_id_col).alias("patient"),
            day(gold, gold_start_col).alias("start"),
            day(gold, gold_end_col).alias("end"),
            number(gold, gold_dose_col).alias("dose"),
        )
        .where("patient IS NOT NULL")
        .groupBy("patient", "start", "end")
        .agg(F.when(F.count("dose") == F.count("*"), F.min("dose")).alias("dose"))
    )
    found = computed.select(
        *by,
        F.col("person_id").alias("patient"),
        drug.alias("drug"),
        day(computed, "episode_start").alias("start"),
        day(computed, "episode_end").alias("end"),
        number(computed, computed_dose_col).alias("dose"),
    ).where("patient IS NOT NULL")
    windows = (
        reviewed.groupBy("patient")
        .agg(F.min("start").alias("w_start"), F.max("end").alias("w_end"))
        .where("w_start <= w_end")
        .join(found.select(*by, "patient").distinct(), "patient")
        .select(*by, "patient", "w_start", "w_end")
    )
    gold_side = reviewed.join(windows, "patient").withColumn("layer", F.lit(None).cast("string"))
    comp_side = found.withColumnRenamed("drug", "layer").join(windows, [*by, "patient"])
    segments = _segments(
        _pieces(gold_side, by, "gold").unionByName(_pieces(comp_side, by, "comp")), by
    )
    gold_dose, comp_dose = F.col("gold_dose"), F.col("comp_dose")
    difference = F.abs(comp_dose - gold_dose)
    close = F.lit(False)
    if threshold_mg is not None:
        close = close | (difference <= threshold_mg)
    if threshold_pct is not None:
        close = close | (F.try_divide(difference * 100, gold_dose) <= threshold_pct)
    ok = F.coalesce(close, F.lit(False))
    g, c = gold_dose.isNotNull(), comp_dose.isNotNull()

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("days"))), F.lit(0).cast("long"))

    episode_days = segments.groupBy(*by).agg(
        total(g & c & ok).alias("TP"),
        total(~g & c).alias("FP"),
        total(g & ~(c & ok)).alias("FN"),
    )
    all_days = windows.groupBy(*by).agg(
        F.coalesce(F.sum(inclusive_days(F.col("w_start"), F.col("w_end"))), F.lit(0)).alias(
            "__days"
        )
    )
    if by:
        counts = all_days.join(episode_days, by, "left").fillna(0, ["TP", "FP", "FN"])
    else:
        counts = episode_days.withColumn("__days", all_days.scalar())
    counts = counts.withColumn(
        "TN", F.col("__days") - F.col("TP") - F.col("FP") - F.col("FN")
    )
    return agreement_rates(counts, _threshold_label(threshold_mg, threshold_pct), by)


def _pieces(episodes: DataFrame, by: Sequence[str], side: str) -> DataFrame:
    """Part of each episode in the patient's window that no earlier one of its layer holds.

    Days are numbers here: ``since`` is the first, ``until`` the day after the last.
    """
    in_order = Window.partitionBy(*by, "patient", "layer").orderBy("start", "end", "dose")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    since = F.greatest(F.unix_date("start"), F.unix_date("w_start"), F.col("covered") + 1)
    until = F.least(F.unix_date("end"), F.unix_date("w_end")) + 1
    return (
        episodes.where("start <= end")
        .withColumn("covered", F.unix_date(F.max("end").over(earlier)))
        .select(
            *by,
            "patient",
            F.lit(side).alias("side"),
            "layer",
            since.alias("since"),
            until.alias("until"),
            "dose",
        )
        .where("since < until")
    )


def _segments(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, patient, days, gold_dose, comp_dose) between neighbouring boundaries of pieces.

    Boundaries are numbered per patient; a piece holds in the segments from its first
    to before its last boundary.
    """
    patient = [*by, "patient"]
    ends = pieces.select("*", F.explode(F.array("since", "until")).alias("at"))
    downwards = Window.partitionBy(*patient).orderBy(F.desc("at"))
    numbered = ends.withColumn("number", F.dense_rank().over(downwards))
    piece = [*patient, "side", "layer", "since", "until"]
    held = (
        numbered.groupBy(*piece)
        .agg(F.first("dose").alias("dose"), F.max("number").alias("first"), F.min("number").alias("last"))
        .select(
            *patient,
            F.explode(F.sequence(F.col("last") + 1, F.col("first"))).alias("number"),
            "side",
            "layer",
            "dose",
        )
    )
    next_at = F.lag("at").over(Window.partitionBy(*patient).orderBy("number"))
    lengths = (
        numbered.groupBy(*patient, "number")
        .agg(F.first("at").alias("at"))
        .withColumn("days", (next_at - F.col("at")).cast("long"))
        .drop("at")
    )
    # The layer orders the computed side; a NULL drug comes first, as in a sort.
    order = F.struct(F.col("layer").isNotNull().alias("named"), "layer")
    doses = held.groupBy(*patient, "number").agg(
        F.first(F.when(F.col("side") == "gold", F.col("dose")), ignorenulls=True).alias("gold_dose"),
        F.min_by(F.when(F.col("side") == "comp", F.col("dose")), F.when(F.col("side") == "comp", order)).alias("comp_dose"),
    )
    return doses.join(lengths, [*patient, "number"])


def agreement_rates(counts: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rates from TP, FP, FN, TN; one NULL row when there was nothing to compare."""
    some = F.col("__days") > 0
    tp, fp, fn, tn = (F.when(some, F.col(c)) for c in ("TP", "FP", "FN", "TN"))
    n = tp + fp + fn + tn
    observed = F.try_divide(tp + tn, n)
    size = n.cast("double")
    chance = F.try_divide(
        (tp + fn).cast("double") * (tp + fp) + (tn + fp).cast("double") * (tn + fn),
        size * size,
    )
    return counts.select(
        *by,
        F.when(some, F.lit(label)).alias("Threshold"),
        tp.alias("TP"),
        fp.alias("FP"),
        fn.alias("FN"),
        tn.alias("TN"),
        F.try_divide(tp, tp + fn).alias("Sensitivity"),
        F.try_divide(tn, tn + fp).alias("Specificity"),
        F.try_divide(tp, tp + fp).alias("PPV"),
        F.try_divide(tn, tn + fn).alias("NPV"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("F1"),
        F.try_divide(observed - chance, 1 - chance).alias("Kappa"),
    )


def _threshold_label(mg: float | None, pct: float | None) -> str:
    parts = [f"{mg:g} mg"] if mg is not None else []
    parts += [f"{pct:g}%"] if pct is not None else []
    return " OR ".join(parts)


def common_patients(
    computed: DataFrame, gold: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Number of patients on both sides, in all or per group of ``by``."""
    return (
        computed.select(*by, F.col("person_id").alias("patient_id"))
        .join(gold.select("patient_id"), "patient_id", "left_semi")
        .groupBy(*by)
        .agg(F.countDistinct("patient_id").alias("n_common_patients"))
    )


def metrics_table(comparison: DataFrame, episodes: DataFrame, gold: DataFrame) -> DataFrame:
    """Headline metrics, one row per ``method`` of the stacked inputs."""
    shared = common_patients(episodes, gold, ["method"])
    return (
        summarise(comparison, ["method"])
        .join(shared, "method", "left")
        .select(
            F.col("method").alias("Method"),
            F.coalesce("n_common_patients", F.lit(0)).alias("Common_Patients"),
            F.col("coverage_pct").alias("Coverage_pct"),
            F.col("MAE").alias("MAE_mg"),
            F.col("MBE").alias("MBE_mg"),
            F.col("RMSE").alias("RMSE_mg"),
            F.col("MAPE").alias("MAPE_pct"),
            F.col("pearson_corr").alias("Pearson_r"),
            F.col("spearman_corr").alias("Spearman_rho"),
        )
    )
