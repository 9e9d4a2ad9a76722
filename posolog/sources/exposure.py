"""Where exposure rows come from: clinical tables or any DataFrame."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posolog.functions import fixed_values as V
from posolog.schema import REQUIRED, require_columns

_FACT_COLUMNS = (
    "person_id",
    "drug_exposure_id",
    "drug_concept_id",
    "drug_source_concept_id",
    "drug_exposure_start_date",
    "drug_exposure_end_date",
    "quantity",
    "days_supply",
    "sig",
    "route_concept_id",
    "dose_unit_source_value",
    "drug_source_value",
)

IdSet = Iterable[int] | DataFrame | None


@dataclass(frozen=True)
class ClinicalTables:
    """The clinical and vocabulary tables, as catalog names or DataFrames.

    ``ClinicalTables.from_schemas(spark, "cdm", "vocab")`` reads catalog tables;
    the vocabulary schema defaults to the clinical one.
    """

    drug_exposure: DataFrame
    concept: DataFrame
    drug_strength: DataFrame

    @classmethod
    def from_schemas(
        cls, spark: SparkSession, cdm_schema: str, vocab_schema: str | None = None
    ) -> ClinicalTables:
        if not cdm_schema:
            raise ValueError("cdm_schema must be given")
        vocab = vocab_schema or cdm_schema
        return cls(
            drug_exposure=spark.table(f"{cdm_schema}.drug_exposure"),
            concept=spark.table(f"{vocab}.concept"),
            drug_strength=spark.table(f"{vocab}.drug_strength"),
        )


def restrict(df: DataFrame, column: str, ids: IdSet) -> DataFrame:
    """Keep rows whose ``column`` is in ``ids``: a literal list or a one-column table."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias(column))
        return df.join(wanted, column, "left_semi").select(*df.columns)
    return df.where(F.col(column).isin(list(ids)))


def extract_exposures(
    tables: ClinicalTables,
    drug_concept_ids: IdSet = None,
    person_ids: IdSet = None,
    start_date: str | date | None = None,
    end_date: str | date | None = None,
    sig_source: str = "sig",
) -> DataFrame:
    """Exposure rows with drug name, route name and strength.

    Date, concept and person filters sit on the scan of the fact table.  The
    name and strength lookups share the key ``drug_concept_id``, so they are
    joined to each other first and the fact table meets one lookup per key, in one
    read of the facts.  Join strategies follow from measured sizes.
    """
    low = F.lit(str(start_date or V.FIRST_START_DATE)).cast("date")
    high = F.lit(str(end_date)).cast("date") if end_date else F.current_date()
    start = F.col("drug_exposure_start_date")
    facts = tables.drug_exposure.select(*_FACT_COLUMNS).where(
        (start >= low) & (start < F.date_add(high, 1))
    )
    facts = restrict(facts, "drug_concept_id", drug_concept_ids)
    facts = restrict(facts, "person_id", person_ids)

    concept = tables.concept.select("concept_id", "concept_name")
    # Combination drugs have several strength rows; one per drug may remain.
    strength = (
        restrict(tables.drug_strength, "drug_concept_id", drug_concept_ids)
        .where("amount_value IS NOT NULL")
        .groupBy("drug_concept_id")
        .agg(
            F.max("amount_value").alias("amount_value"),
            F.max("amount_unit_concept_id").alias("amount_unit_concept_id"),
        )
    )
    drugs = restrict(
        concept.select(
            F.col("concept_id").alias("drug_concept_id"),
            F.col("concept_name").alias("drug_concept_name"),
        ),
        "drug_concept_id",
        drug_concept_ids,
    ).join(strength, "drug_concept_id", "full")
    routes = concept.select(
        F.col("concept_id").alias("route_concept_id"),
        F.col("concept_name").alias("route_concept_name"),
    )
    named = facts.join(drugs, "drug_concept_id", "left").join(routes, "route_concept_id", "left")
    rows = named.select(
        "person_id",
        "drug_exposure_id",
        "drug_concept_id",
        "drug_source_concept_id",
        start.cast("date").alias("drug_exposure_start_date"),
        F.col("drug_exposure_end_date").cast("date").alias("drug_exposure_end_date"),
        "quantity",
        "days_supply",
        "sig",
        "route_concept_id",
        "route_concept_name",
        "dose_unit_source_value",
        "drug_source_value",
        "drug_concept_name",
        "amount_value",
        "amount_unit_concept_id",
    )
    return apply_sig_source(rows, sig_source)


def select_exposures(
    df: DataFrame,
    drug_concept_ids: IdSet = None,
    person_ids: IdSet = None,
    start_date: str | date | None = None,
    end_date: str | date | None = None,
    sig_source: str = "sig",
) -> DataFrame:
    """The same filters on any DataFrame; only the filters given are applied."""
    require_columns(df, REQUIRED, "exposures")
    out = restrict(df, "person_id", person_ids)
    if "drug_concept_id" in df.columns:
        out = restrict(out, "drug_concept_id", drug_concept_ids)
    start = F.col("drug_exposure_start_date").cast("date")
    if start_date is not None:
        out = out.where(start >= F.lit(str(start_date)).cast("date"))
    if end_date is not None:
        out = out.where(start <= F.lit(str(end_date)).cast("date"))
    return apply_sig_source(out, sig_source)


def to_exposures(source: ClinicalTables | DataFrame, **filters) -> DataFrame:
    """Exposure rows of either kind of source."""
    if isinstance(source, ClinicalTables):
        return extract_exposures(source, **filters)
    if isinstance(source, DataFrame):
        return select_exposures(source, **filters)
    raise TypeError("source must be ClinicalTables or a DataFrame")


def apply_sig_source(df: DataFrame, sig_source: str) -> DataFrame:
    """Use the drug text as the prescription text where the table has none at all.

    Whether every ``sig`` is NULL is one scalar subquery over that column.
    """
    if sig_source != "drug_source_value" or "drug_source_value" not in df.columns:
        return df
    if "sig" not in df.columns:
        return df.withColumn("sig", F.col("drug_source_value"))
    some_sig = df.agg(
        F.coalesce(F.bool_or(F.col("sig").isNotNull()), F.lit(False)).alias("some_sig")
    ).scalar()
    return df.withColumn(
        "sig", F.when(some_sig, F.col("sig")).otherwise(F.col("drug_source_value"))
    )


def with_exposure_id(df: DataFrame, slots: int = 4096) -> DataFrame:
    """Add ``drug_exposure_id``, numbered from 1, where the source has none.

    Ids follow from the rows' content, so a recomputed partition gives the same
    ids.  Rows are spread over a fixed number of hash slots and stand there in the
    order of two 64-bit hashes of all their columns (the second one tells NULLs
    apart); equal rows take a range of ids.  Only the slot totals (one row per slot,
    which is why they may be broadcast) are scanned in order.  Rows are moved once,
    with no column beside the hashes that the reader of the result does not ask for.
    """
    if "drug_exposure_id" in df.columns:
        return df
    columns = df.columns
    # A slot that may be NULL gets a filter on one side of the join below, and the two
    # sides would no longer share their shuffle.
    hashed = df.withColumns(
        {
            "__hash": F.xxhash64(*columns),
            "__other": F.xxhash64(*[F.col(c).isNull() for c in columns], *columns),
        }
    ).withColumn("__slot", F.coalesce(F.pmod("__hash", F.lit(slots)), F.lit(0)))
    inside = Window.partitionBy("__slot").orderBy("__hash", "__other").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    numbered = hashed.withColumn("__at", F.count(F.lit(1)).over(inside))
    before = Window.partitionBy(F.lit(0)).orderBy("__slot").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        numbered.groupBy("__slot")
        .agg(F.max("__at").alias("__size"))
        .select("__slot", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    )
    return numbered.join(F.broadcast(offsets), "__slot").select(
        *columns, (F.col("__before") + F.col("__at")).alias("drug_exposure_id")
    )
