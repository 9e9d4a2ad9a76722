"""Treatment episodes: exposures of one drug bridged over short gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posolog.functions import fixed_values as V
from posolog.functions.values import day, inclusive_days, not_before, number
from posolog.operators.filters import with_drug_name
from posolog.schema import first_present, require_columns

DOSE_CANDIDATES = (
    "daily_dose_mg_imputed",
    "daily_dose_mg",
    "pred_equiv_mg",
    "median_daily_dose",
    "mean_daily_dose",
)
EPISODE_COLUMNS = (
    "person_id",
    "drug_name_std",
    "episode_id",
    "episode_start",
    "episode_end",
    "n_days",
    "n_records",
    "median_daily_dose",
    "min_daily_dose",
    "max_daily_dose",
    "mean_daily_dose",
)


def build_episodes(
    df: DataFrame,
    person_col: str = "person_id",
    drug_col: str = "drug_name_std",
    start_col: str = "drug_exposure_start_date",
    end_col: str | None = None,
    dose_col: str | None = None,
    gap_days: int = V.GAP_DAYS,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per episode of each person and drug.

    A record starts a new episode when it begins more than ``gap_days`` after
    every earlier record has ended.  ``by`` names extra columns that keep
    episodes apart, such as a method label, so several methods share one pass.

    Records are first combined per (person, drug, start, dose): a map-side
    aggregation, so a person who holds a large share of the rows reaches the
    windows as one row per distinct start and dose, spread by that finer key.
    The windows, the per-episode aggregate and the numbering then share a single
    exchange on (person, drug).
    """
    if gap_days < 0:
        raise ValueError("gap_days must not be negative")
    if drug_col not in df.columns:
        df, drug_col = with_drug_name(df), "drug_name_std"
    require_columns(df, [person_col, drug_col, start_col, *by])
    dose_col = dose_col or first_present(df, DOSE_CANDIDATES)

    start, end = F.col("start"), F.col("end")
    rows = df.select(
        *by,
        F.col(person_col).alias("person_id"),
        F.col(drug_col).alias("drug_name_std"),
        day(df, start_col).alias("start"),
        day(df, end_col).alias("end"),
        number(df, dose_col).alias("dose"),
    ).where(F.col("person_id").isNotNull() & start.isNotNull())
    rows = rows.withColumn("end", not_before(start, end))

    key = ["person_id", "drug_name_std", *by]  # sorts tell most rows apart by the first
    compact = rows.groupBy(*key, "start", "dose").agg(
        F.max("end").alias("end"),
        F.count("*").alias("n"),
        F.sum(inclusive_days(start, end)).alias("dose_days"),
    ).withColumn("day", F.unix_date("start"))  # a column: one sort serves all its windows

    # Frames run over distinct start days: rows sharing a start see the same
    # earlier ends, whatever their order.
    by_start = Window.partitionBy(*key).orderBy("day")
    earlier = by_start.rangeBetween(Window.unboundedPreceding, -1)
    so_far = by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = compact.withColumns(
        {
            "previous_end": F.max("end").over(earlier),
            "previous_start": F.lag("start").over(by_start),
        }
    ).withColumn(
        "opens",
        F.col("previous_end").isNull()
        | (F.datediff("start", "previous_end") > F.lit(int(gap_days))),
    )
    # All rows of the day that opens an episode do; the first of them counts it.
    counts = F.col("opens") & ~F.col("previous_start").eqNullSafe(start)
    spans = flagged.withColumns(
        {
            "episode_start": F.max(F.when(F.col("opens"), start)).over(so_far),
            "episode_id": F.count(F.when(counts, 1)).over(so_far).cast("int"),
        }
    )

    # The median: an episode's rows in the order of their doses, each as many places as
    # it stands for records, and the dose that holds the middle place (or both).
    dose, days = F.col("dose"), F.col("dose_days")
    episode = Window.partitionBy(*key, "episode_start", "episode_id")
    by_dose = episode.orderBy("dose")
    dosed = F.when(dose.isNotNull(), F.col("n")).otherwise(F.lit(0))
    placed = spans.withColumns(
        {
            "upto": F.sum(dosed).over(by_dose.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "of": F.sum(dosed).over(by_dose.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )

    def at(place: Column) -> Column:
        holds = (place >= F.col("upto") - dosed) & (place < F.col("upto"))
        return F.max(F.when(holds, dose))

    half = F.lit(0.5)
    low, high = F.col("low"), F.col("high")
    episodes = placed.groupBy(*key, "episode_start", "episode_id").agg(
        F.max("end").alias("episode_end"),
        F.sum("n").alias("n_records"),
        at(F.shiftright(F.col("of") - 1, 1)).alias("low"),
        at(F.shiftright(F.col("of"), 1)).alias("high"),
        F.min("dose").alias("min_daily_dose"),
        F.max("dose").alias("max_daily_dose"),
        F.try_divide(
            F.sum(dose * days), F.sum(F.when(dose.isNotNull(), days))
        ).alias("mean_daily_dose"),
    ).withColumn("median_daily_dose", F.when(low == high, low).otherwise(half * low + half * high))
    return episodes.withColumn(
        "n_days", inclusive_days(F.col("episode_start"), F.col("episode_end"))
    ).select(*by, *EPISODE_COLUMNS)
