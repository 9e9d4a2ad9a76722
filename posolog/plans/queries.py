"""Registered queries: each operator on the test tables, with its check.

A query is a function ``(spark, sf_dir) -> DataFrame`` over whole tables.  Its
check is SQL for another engine, built in ``checks``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posolog.functions import fixed_values as V
from posolog.functions.stats import exact_quantiles
from posolog.operators import analysis as A
from posolog.operators import cohort as K
from posolog.operators.convert import convert_pred_equiv
from posolog.operators.dose import (
    calc_daily_dose_baseline,
    calc_daily_dose_nlp,
    calc_daily_dose_nlp_advanced,
    dose_side_by_side,
)
from posolog.operators.episodes import build_episodes
from posolog.operators.evaluate import (
    by_dose_range,
    by_taper_status,
    compare_episodes,
    day_agreement,
    gold_to_pred_equiv,
    metrics_table,
    summarise,
)
from posolog.operators.filters import known_steroids, oral_only, with_drug_name, with_route_class
from posolog.operators.parse import expand_tapers, parse_sig, taper_steps
from posolog.plans import checks as C
from posolog.plans import test_tables as TT
from posolog.plans.pipeline import run_pipeline
from posolog.plans.study import (
    METHODS,
    StudyTables,
    method_records,
    stacked_episodes,
    study_tables,
)
from posolog.session import shared_folder, written
from posolog.sources.exposure import (
    ClinicalTables,
    apply_sig_source,
    extract_exposures,
    select_exposures,
    with_exposure_id,
)
from posolog.sources.files import read_exposure_csv, unreadable_cells, write_ordered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
r = C.r


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, as the checks show them."""
    return df.select(
        *[
            (F.round(f.name, 6) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(check: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its check if it has one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if check is not None:
            CHECKS[fn.__name__] = check() if callable(check) else check
        return fn

    return register


def _exposures(spark: SparkSession, sf_dir: str, daily_dose: bool = False) -> DataFrame:
    return TT.exposures(spark, sf_dir, daily_dose)


# --------------------------------------------------------------------- sources ---
_EXTRACT = [
    "person_id", "drug_exposure_id", "drug_concept_id", "drug_source_concept_id",
    "drug_exposure_start_date", "drug_exposure_end_date", "quantity", "days_supply", "sig",
    "route_concept_id", "route_concept_name", "dose_unit_source_value", "drug_source_value",
    "drug_concept_name", "amount_value", "amount_unit_concept_id",
]


def _clinical_sql(q: C.With, *names: str) -> C.With:
    for name in names:
        q.add(name, TT.plain(TT.CLINICAL_SQL[name]))
    return q


def _extract_check() -> str:
    """Each fact row picks its names and strength by key."""
    strong = "FROM drug_strength AS k WHERE k.drug_concept_id = f.drug_concept_id"
    picked = {
        "route_concept_name": "(SELECT max(concept_name) FROM concept WHERE concept_id = f.route_concept_id)",
        "drug_concept_name": "(SELECT max(concept_name) FROM concept WHERE concept_id = f.drug_concept_id)",
        "amount_value": f"(SELECT max(k.amount_value) {strong})",
        "amount_unit_concept_id": "(SELECT max(k.amount_unit_concept_id) FILTER (WHERE k.amount_value "
                                  f"IS NOT NULL) {strong})",
    }
    columns = ", ".join(f"{picked.get(n, 'f.' + n)} AS {n}" for n in _EXTRACT)
    q = _clinical_sql(C.With(), "fact", "concept", "drug_strength")
    return q.select(f"SELECT {columns} FROM fact AS f WHERE year(f.drug_exposure_start_date) IN "
                    "(1996, 1997, 1998, 1999, 2000)")


def _clinical_tables(spark: SparkSession, sf_dir: str) -> ClinicalTables:
    t = TT.clinical(spark, sf_dir, "fact", "concept", "drug_strength")
    return ClinicalTables(t["fact"], t["concept"], t["drug_strength"])


@query(_extract_check)
def extract_exposure(spark, sf_dir):
    return extract_exposures(
        _clinical_tables(spark, sf_dir), start_date="1996-01-01", end_date="2000-12-31"
    ).select(*_EXTRACT)


@query(lambda: _clinical_sql(C.With(), "fact").select(
    "SELECT year(drug_exposure_start_date) AS year, count(*) AS n, count(drug_exposure_end_date) AS "
    "n_ended FROM fact WHERE drug_exposure_start_date >= DATE '1900-01-01' AND "
    "drug_exposure_start_date <= current_date GROUP BY ALL"))
def extract_default_window(spark, sf_dir):
    """Without dates given, rows from the first known start date to today."""
    return extract_exposures(_clinical_tables(spark, sf_dir)).groupBy(
        F.year("drug_exposure_start_date").alias("year")
    ).agg(F.count("*").alias("n"), F.count("drug_exposure_end_date").alias("n_ended"))


_CONCEPT_FILTER = "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#3', 'Brand#7', 'Brand#11')"
_PERSON_FILTER = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'"


@query(lambda: C.rows().select(
    f"SELECT person_id, drug_concept_id, drug_exposure_start_date, sig, {r('quantity')} FROM x "
    f"WHERE person_id IN ({_PERSON_FILTER}) AND drug_concept_id IN ({_CONCEPT_FILTER}) "
    "AND drug_exposure_start_date BETWEEN DATE '1996-01-01' AND DATE '1999-06-30'"))
def select_exposure(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return select_exposures(
        _exposures(spark, sf_dir),
        drug_concept_ids=part.where(
            F.col("p_brand").isin("Brand#3", "Brand#7", "Brand#11")
        ).select("p_partkey"),
        person_ids=customer.where("c_mktsegment = 'MACHINERY'").select("c_custkey"),
        start_date="1996-01-01",
        end_date="1999-06-30",
    ).select("person_id", "drug_concept_id", "drug_exposure_start_date", "sig", "quantity")


@query(lambda: C.rows().select(
    "SELECT person_id, drug_exposure_start_date, drug_source_value AS sig FROM x"))
def sig_source_alias(spark, sf_dir):
    rows = _exposures(spark, sf_dir).withColumn(
        "sig", F.when(F.col("quantity") < 0, F.col("sig"))
    )
    return apply_sig_source(rows, "drug_source_value").select(
        "person_id", "drug_exposure_start_date", "sig"
    )


@query("SELECT count(*) AS n, 1 AS first_id, count(*) AS last_id, count(*) AS n_ids FROM lineitem "
       "JOIN orders ON l_orderkey = o_orderkey")
def exposure_ids(spark, sf_dir):
    ids = with_exposure_id(_exposures(spark, sf_dir).drop("drug_exposure_id"))
    i = "drug_exposure_id"
    return ids.agg(
        F.count("*").alias("n"),
        F.min(i).alias("first_id"),
        F.max(i).alias("last_id"),
        F.countDistinct(i).alias("n_ids"),
    )


# -------------------------------------------------------------- names and routes ---
@query(lambda: C.rows().select(
    "SELECT drug_concept_name, drug_name_std, count(*) AS n FROM x GROUP BY ALL"))
def standardize_names(spark, sf_dir):
    return (
        with_drug_name(_exposures(spark, sf_dir))
        .groupBy("drug_concept_name", "drug_name_std")
        .agg(F.count("*").alias("n"))
    )


@query(lambda: C.rows().select(
    "SELECT drug_concept_name, CASE WHEN d = 9 THEN 'seizure drug' WHEN d IN (0, 1) THEN 'site "
    "prednisone' ELSE drug_name_std END AS drug_name_std, count(*) AS n FROM x GROUP BY ALL"))
def name_overrides(spark, sf_dir):
    overrides = [
        ("PREDNISONE", "first rule"),
        ("^prednisone", "site prednisone"),
        ("Levetir", "seizure drug"),
    ]
    return (
        with_drug_name(_exposures(spark, sf_dir), drug_name_map=overrides)
        .groupBy("drug_concept_name", "drug_name_std")
        .agg(F.count("*").alias("n"))
    )


@query(lambda: C.rows().select(
    "SELECT route_concept_name, route_source_value, drug_source_value, route_class, count(*) AS n "
    "FROM x GROUP BY ALL"))
def route_classes(spark, sf_dir):
    keys = ["route_concept_name", "route_source_value", "drug_source_value", "route_class"]
    return (
        with_route_class(_exposures(spark, sf_dir)).groupBy(*keys).agg(F.count("*").alias("n"))
    )


@query(lambda: C.rows().select(
    f"SELECT person_id, drug_exposure_start_date, drug_name_std FROM x WHERE drug_name_std IN ({C.STEROIDS})"))
def steroid_filter(spark, sf_dir):
    return known_steroids(with_drug_name(_exposures(spark, sf_dir))).select(
        "person_id", "drug_exposure_start_date", "drug_name_std"
    )


@query(lambda: C.oral(C.rows()).select(
    "SELECT person_id, drug_exposure_start_date, drug_name_std, drug_source_value FROM o"))
def oral_steroids(spark, sf_dir):
    return oral_only(known_steroids(with_drug_name(_exposures(spark, sf_dir)))).select(
        "person_id", "drug_exposure_start_date", "drug_name_std", "drug_source_value"
    )


# ----------------------------------------------------------------------- parsing ---
_PARSED = [
    "person_id", "sig", "tablets", "freq_per_day", "mg_per_admin", "mg_total_flag",
    "duration_days", "taper_flag", "prn_flag", "free_text_flag", "daily_dose_mg",
    "parsed_status",
]


def _parse_check(advanced: bool) -> Callable[[], str]:
    return lambda: C.parsed(C.rows(), "x", "p", advanced).select(
        f"SELECT person_id, sig, {C.PARSED_SELECT} FROM p"
    )


@query(_parse_check(False))
def parse_sig_basic(spark, sf_dir):
    return parse_sig(_exposures(spark, sf_dir)).select(*_PARSED)


@query(_parse_check(True))
def parse_sig_wide(spark, sf_dir):
    return parse_sig(_exposures(spark, sf_dir), advanced=True).select(*_PARSED)


@query(_parse_check(False))
def parse_sig_dictionary(spark, sf_dir):
    return parse_sig(_exposures(spark, sf_dir), dictionary=True).select(*_PARSED)


def _schedule_check() -> str:
    q = C.expanded(C.parsed(C.rows(), "x", "p", True), "p", "e")
    return q.select(
        f"SELECT person_id, sig, step, {r('step_dose', 'daily_dose_mg')}, {r('1.0', 'freq_per_day')}, "
        f"{r('step_days', 'duration_days')}, {r('step_from', 'step_start_day')}, "
        f"{r('step_from + step_days - 1', 'step_end_day')} FROM e1 WHERE step IS NOT NULL"
    )


@query(_schedule_check)
def taper_schedule_steps(spark, sf_dir):
    return taper_steps(_exposures(spark, sf_dir).select("person_id", "sig"))


def _expand_check() -> str:
    q = C.expanded(C.parsed(C.rows(), "x", "p", True), "p", "e")
    return q.select(
        f"SELECT person_id, sig, {r('daily', 'daily_dose_mg')}, {r('freq', 'freq_per_day')}, "
        f"{r('dur', 'duration_days')}, status AS parsed_status, step AS taper_step, "
        f"{r('CASE WHEN step IS NOT NULL THEN step_from END', 'step_start_day')}, "
        f"{r('CASE WHEN step IS NOT NULL THEN step_from + step_days - 1 END', 'step_end_day')} FROM e"
    )


_STEPS = ["taper_step", "step_start_day", "step_end_day"]


@query(_expand_check)
def taper_expand(spark, sf_dir):
    return expand_tapers(parse_sig(_exposures(spark, sf_dir), advanced=True)).select(
        "person_id", "sig", "daily_dose_mg", "freq_per_day", "duration_days", "parsed_status",
        *_STEPS,
    )


# ------------------------------------------------------------------ dose methods ---
_BASE = [
    "person_id", "drug_exposure_start_date", "drug_name_std", "sig", "strength_mg",
    "dose_from_original", "dose_from_tablets_freq", "dose_from_supply",
    "dose_from_actual_duration", "daily_dose_mg_imputed", "imputation_method",
]


def _baseline_select(source: str, only: tuple[str, ...] = C.DEFAULT_ORDER) -> str:
    columns = {"c_original": "dose_from_original", "c_tablets": "dose_from_tablets_freq",
               "c_supply": "dose_from_supply", "c_duration": "dose_from_actual_duration"}
    doses = ", ".join(
        r(c if c in only else "CAST(NULL AS DOUBLE)", name) for c, name in columns.items()
    )
    return (f"SELECT person_id, drug_exposure_start_date, drug_name_std, sig, "
            f"{r('strength', 'strength_mg')}, {doses}, {r('dose', 'daily_dose_mg_imputed')}, "
            f"method_label AS imputation_method FROM {source}")


@query(lambda: C.baseline(False).select(_baseline_select("b")))
def dose_baseline(spark, sf_dir):
    return calc_daily_dose_baseline(_exposures(spark, sf_dir)).select(*_BASE)


@query(lambda: C.baseline(True).select(_baseline_select("b")))
def dose_baseline_given_dose(spark, sf_dir):
    return calc_daily_dose_baseline(_exposures(spark, sf_dir, True)).select(*_BASE)


def _order_check() -> str:
    order = ("c_supply", "c_duration")
    q = C.oral(C.rows())
    q.add("p", "SELECT *, CAST(NULL AS DOUBLE) AS tab, CAST(NULL AS DOUBLE) AS freq FROM o")
    C.candidates(q, "p", "c", "daily_dose")
    return C.cascade(q, "c", "b", order).select(_baseline_select("b", order))


@query(_order_check)
def dose_baseline_order(spark, sf_dir):
    return calc_daily_dose_baseline(
        _exposures(spark, sf_dir, True),
        methods=("supply_based", "actual_duration"),
        m2_sig_parse="none",
    ).select(*_BASE)


def _flag_check() -> str:
    # tablets are given in some rows, so no text is parsed anywhere.
    q = C.oral(C.rows())
    q.add("p", "SELECT *, CASE WHEN quantity > 40 THEN 2e0 END AS tab, CASE WHEN quantity > 30 THEN "
          "3e0 END AS freq FROM o")
    C.candidates(q, "p", "c", "CAST(NULL AS DOUBLE)")
    return C.cascade(q, "c", "b").select(_baseline_select("b"))


@query(_flag_check)
def dose_baseline_given_tablets(spark, sf_dir):
    rows = _exposures(spark, sf_dir).withColumns(
        {
            "tablets": F.when(F.col("quantity") > 40, F.lit(2.0)),
            "freq_per_day": F.when(F.col("quantity") > 30, F.lit(3.0)),
        }
    )
    return calc_daily_dose_baseline(rows).select(*_BASE)


@query(lambda: C.baseline(False).select(_baseline_select("b")))
def dose_baseline_empty_tablets(spark, sf_dir):
    """Columns without any value do not keep the texts from being parsed."""
    none = F.lit(None).cast("double")
    rows = _exposures(spark, sf_dir).withColumns({"tablets": none, "freq_per_day": none})
    return calc_daily_dose_baseline(rows).select(*_BASE)


def _as_of_check() -> str:
    q = C.parsed(C.oral(C.rows()), "o", "p")
    q.add("pe", "SELECT * REPLACE (DATE '1999-12-31' AS drug_exposure_end_date) FROM p")
    C.candidates(q, "pe", "c", "daily")
    return C.cascade(q, "c", "b").select(_baseline_select("b"))


@query(_as_of_check)
def dose_baseline_as_of(spark, sf_dir):
    """A source without end dates: the as-of date ends every exposure."""
    rows = _exposures(spark, sf_dir).drop("drug_exposure_end_date")
    return calc_daily_dose_baseline(rows, as_of="1999-12-31").select(*_BASE)


def _as_csv(rows: DataFrame, formats: tuple[str, ...]) -> str:
    """Write rows as CSV with start dates in several formats; returns the path."""
    start, by = F.col("drug_exposure_start_date"), F.col("drug_exposure_id") % len(formats)
    text = F.date_format(start, formats[0])
    for i, pattern in enumerate(formats):
        text = F.when(by == i, F.date_format(start, pattern)).otherwise(text)
    path = f"{shared_folder(rows.sparkSession)}/posolog-csv/{uuid.uuid4().hex}"
    rows.withColumn("drug_exposure_start_date", text).write.options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return path


def _csv_check() -> str:
    q = C.baseline(False)
    # An empty route cell holds nothing, so the drug text decides.
    q.parts["x"] = q.parts["x"].replace("WHEN 1 THEN 'other' ELSE", "ELSE")
    return q.select(_baseline_select("b"))


@query(_csv_check)
def dose_baseline_from_csv(spark, sf_dir):
    """The same doses from text: four date formats, numbers as text, empty cells."""
    path = _as_csv(_exposures(spark, sf_dir), V.DATE_FORMATS)
    return calc_daily_dose_baseline(read_exposure_csv(spark, path)).select(*_BASE)


@query("SELECT 'quantity' AS \"column\", 'n/a' AS cell, 'not a number' AS reason, count(*) AS n FROM lineitem "
       "JOIN orders ON l_orderkey = o_orderkey WHERE (l_orderkey * 8 + l_linenumber) % 11 = 0 UNION ALL "
       "SELECT 'days_supply', CAST(l_linenumber AS VARCHAR) || ' days', 'not a number', count(*) FROM "
       "lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (l_orderkey * 8 + l_linenumber) % 7 = 0 "
       "GROUP BY l_linenumber UNION ALL SELECT 'drug_exposure_start_date', strftime(CAST(l_shipdate AS "
       "DATE), '%d.%m.%Y'), 'not a date', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
       "WHERE (l_orderkey * 8 + l_linenumber) % 2 = 1 GROUP BY CAST(l_shipdate AS DATE)")
def csv_unreadable_cells(spark, sf_dir):
    """Cells that no number or date can be read from, kept with their text."""
    i = F.col("drug_exposure_id")
    text = {"quantity": F.col("quantity").cast("string"), "days_supply": F.col("days_supply").cast("string")}
    rows = _exposures(spark, sf_dir).withColumns({
        "quantity": F.when(i % 11 == 0, "n/a").otherwise(text["quantity"]),
        "days_supply": F.when(i % 7 == 0, F.concat((i % 8).cast("string"), F.lit(" days"))).otherwise(
            text["days_supply"]),
    })
    bad = unreadable_cells(spark, _as_csv(rows, ("yyyy-MM-dd", "dd.MM.yyyy")))
    return bad.groupBy("column", "cell", "reason").agg(F.count("*").alias("n"))


_NLP = [
    "person_id", "drug_exposure_start_date", "drug_name_std", "sig", "tablets", "freq_per_day",
    "mg_per_admin", "daily_dose_mg", "parsed_status",
]
_NLP_SELECT = ", ".join([
    "person_id", "drug_exposure_start_date", "drug_name_std", "sig", r("tab", "tablets"),
    r("freq", "freq_per_day"), r("admin", "mg_per_admin"), r("nlp_dose", "daily_dose_mg"),
    "nlp_status AS parsed_status",
])


def _nlp_check(**options) -> Callable[[], str]:
    steps = (
        f", step AS taper_step, {r('CASE WHEN step IS NOT NULL THEN step_from END', 'step_start_day')}, "
        f"{r('CASE WHEN step IS NOT NULL THEN step_from + step_days - 1 END', 'step_end_day')}"
        if options.get("expand") else ""
    )
    return lambda: C.nlp(C.oral(C.rows()), "n", **options).select(
        f"SELECT {_NLP_SELECT}{steps} FROM n"
    )


@query(_nlp_check())
def dose_nlp(spark, sf_dir):
    return calc_daily_dose_nlp(_exposures(spark, sf_dir)).select(*_NLP)


@query(_nlp_check(daily_dose=True))
def dose_nlp_given_dose(spark, sf_dir):
    return calc_daily_dose_nlp(_exposures(spark, sf_dir, True)).select(*_NLP)


def _original_fallback_check() -> str:
    q = C.nlp(C.oral(C.rows()), "n")
    q.parts["ns"] = ("SELECT * REPLACE (coalesce(daily, CASE WHEN quantity > 30 THEN quantity * 2 END) AS "
                     f"daily) FROM ({q.parts['ns']}) AS before")
    return q.select(f"SELECT {_NLP_SELECT} FROM n")


@query(_original_fallback_check)
def dose_nlp_original_fallback(spark, sf_dir):
    """A dose the site carries fills what the text leaves open."""
    rows = _exposures(spark, sf_dir).withColumn(
        "daily_dose_mg_orig", F.when(F.col("quantity") > 30, F.col("quantity") * 2)
    )
    return calc_daily_dose_nlp(rows, baseline_fallback=True).select(*_NLP)


@query(_nlp_check(advanced=True))
def dose_nlp_advanced(spark, sf_dir):
    return calc_daily_dose_nlp_advanced(_exposures(spark, sf_dir), expand_tapers=False).select(
        *_NLP
    )


@query(_nlp_check(advanced=True, expand=True))
def dose_nlp_advanced_tapers(spark, sf_dir):
    return calc_daily_dose_nlp_advanced(_exposures(spark, sf_dir)).select(*_NLP, *_STEPS)


def _stack_check() -> str:
    q = C.baseline(False)
    C.nlp(q, "n")
    C.nlp(q, "adv", advanced=True)
    rows = "person_id, drug_exposure_start_date, drug_name_std"
    return q.select(
        f"SELECT {rows}, {r('dose', 'dose_mg')}, 'Baseline' AS method FROM b UNION ALL SELECT {rows}, "
        f"{r('nlp_dose', 'dose_mg')}, 'NLP' FROM n UNION ALL SELECT {rows}, "
        f"{r('nlp_dose', 'dose_mg')}, 'Advanced NLP' FROM adv"
    )


@query(_stack_check)
def dose_methods_stacked(spark, sf_dir):
    return dose_side_by_side(_exposures(spark, sf_dir)).select(
        "person_id", "drug_exposure_start_date", "drug_name_std", "dose_mg", "method"
    )


# -------------------------------------------------------------------- conversion ---
_ALL_FACTORS = (
    "CASE WHEN drug_name_std = 'budesonide' THEN 'missing_factor' WHEN drug_name_std IN "
    f"({C.STEROIDS}) THEN 'ok' ELSE 'unknown_drug' END"
)


@query(lambda: C.rows().select(
    f"SELECT person_id, drug_name_std, {r('quantity')}, {r(f'quantity * {C.FACTOR}', 'pred_equiv_mg')}, "
    f"{r(C.FACTOR, 'equiv_factor')}, {_ALL_FACTORS} AS pred_equiv_status FROM x"))
def pred_equiv(spark, sf_dir):
    named = with_drug_name(_exposures(spark, sf_dir))
    return convert_pred_equiv(named, dose_col="quantity").select(
        "person_id", "drug_name_std", "quantity", "pred_equiv_mg", "equiv_factor",
        "pred_equiv_status",
    )


@query(lambda: C.rows().select(
    "SELECT person_id, drug_name_std, " + r("CASE drug_name_std WHEN 'prednisone' THEN quantity * 2 "
    "WHEN 'dexamethasone' THEN quantity * 9.5 END", "pred_equiv_mg") + ", CASE WHEN drug_name_std IN "
    "('prednisone', 'dexamethasone') THEN 'ok' WHEN drug_name_std = 'hydrocortisone' THEN "
    "'missing_factor' ELSE 'unknown_drug' END AS pred_equiv_status FROM x"))
def pred_equiv_custom_table(spark, sf_dir):
    table = spark.createDataFrame(
        [("prednisone", 2.0), ("dexamethasone", 9.5), ("hydrocortisone", None)],
        "drug_name_std string, equiv_factor double",
    )
    rows = _exposures(spark, sf_dir)
    named = with_drug_name(rows)
    return convert_pred_equiv(named, dose_col="quantity", equiv_table=table).select(
        "person_id", "drug_name_std", "pred_equiv_mg", "pred_equiv_status"
    )


@query(lambda: C.rows().select(
    f"SELECT person_id, drug_concept_name, {r(f'quantity * {C.FACTOR}', 'pred_equiv_mg')}, "
    f"{_ALL_FACTORS} AS pred_equiv_status FROM x"))
def pred_equiv_unnamed(spark, sf_dir):
    """Without standard names the first name column there is gives the factor."""
    rows = _exposures(spark, sf_dir).drop("drug_source_value")
    return convert_pred_equiv(rows, dose_col="quantity").select(
        "person_id", "drug_concept_name", "pred_equiv_mg", "pred_equiv_status"
    )


# ---------------------------------------------------------------------- episodes ---
def _pipeline_check(method: str, gap: int = 30) -> Callable[[], str]:
    def build() -> str:
        if method == "baseline":
            q, source, dose = C.baseline(False), "b", "dose"
        else:
            q = C.nlp(C.oral(C.rows()), "n", advanced=method == "nlp_advanced")
            source, dose = "n", "nlp_dose"
        return C.episodes(q, source, "ep", dose, gap).select(
            f"SELECT {C.EPISODE_SELECT} FROM ep"
        )

    return build


@query(_pipeline_check("baseline"))
def episodes_30(spark, sf_dir):
    return run_pipeline(_exposures(spark, sf_dir), "baseline")


@query(_pipeline_check("baseline", 180))
def episodes_180(spark, sf_dir):
    return run_pipeline(_exposures(spark, sf_dir), "baseline", gap_days=180)


@query(_pipeline_check("nlp"))
def pipeline_nlp(spark, sf_dir):
    return run_pipeline(_exposures(spark, sf_dir), "nlp")


@query(_pipeline_check("nlp_advanced"))
def pipeline_nlp_advanced(spark, sf_dir):
    return run_pipeline(_exposures(spark, sf_dir), "nlp_advanced")


def _no_end_check() -> str:
    q = C.oral(C.rows())
    q.add("z", "SELECT * REPLACE (drug_exposure_start_date AS drug_exposure_end_date), "
          "CAST(NULL AS DOUBLE) AS dose FROM o")
    return C.episodes(q, "z", "ep", "dose", 60).select(f"SELECT {C.EPISODE_SELECT} FROM ep")


@query(_no_end_check)
def episodes_without_end_or_dose(spark, sf_dir):
    rows = oral_only(known_steroids(with_drug_name(_exposures(spark, sf_dir))))
    return build_episodes(rows, gap_days=60)


@query(lambda: C.episodes(C.rows(), "x", "ep", "quantity", 30, factor="1").select(
    f"SELECT {C.EPISODE_SELECT} FROM ep"))
def episodes_unnamed(spark, sf_dir):
    """Rows without standard names are named on the way."""
    return build_episodes(
        _exposures(spark, sf_dir), end_col="drug_exposure_end_date", dose_col="quantity"
    )


@query(lambda: C.episodes(C.baseline(False), "b", "ep", "dose").select(
    "SELECT count(*) AS n_rows, 0 AS n_inside, 0 AS n_between FROM ep"))
def ordered_episodes(spark, sf_dir):
    """Episodes written in order and read back: no row stands before a smaller one."""
    keys = ["person_id", "drug_name_std", "episode_start"]
    path = write_ordered(
        run_pipeline(_exposures(spark, sf_dir)),
        f"{shared_folder(spark)}/posolog-ordered/{uuid.uuid4().hex}",
        *keys,
    )
    rows = spark.read.parquet(path).select(
        F.struct(*keys).alias("key"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.row_index").alias("at"),
    )
    before = F.lag("key").over(Window.partitionBy("file").orderBy("at"))
    files = (
        rows.withColumn("late", (before > F.col("key")).cast("long"))
        .groupBy("file")
        .agg(
            F.count("*").alias("n"),
            F.sum("late").alias("inside"),
            F.min("key").alias("low"),
            F.max("key").alias("high"),
        )
    )  # one row a file
    last = F.lag("high").over(Window.partitionBy(F.lit(0)).orderBy("file"))
    return files.withColumn("between", (last > F.col("low")).cast("long")).agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum("inside"), F.lit(0)).alias("n_inside"),
        F.coalesce(F.sum("between"), F.lit(0)).alias("n_between"),
    )


def _exposure_level_check() -> str:
    return C.baseline(False).select(
        f"SELECT person_id, drug_exposure_start_date, drug_name_std, {r('dose', 'daily_dose_mg_imputed')}, "
        f"{r(f'dose * {C.FACTOR}', 'pred_equiv_mg')}, 'ok' AS pred_equiv_status FROM b"
    )


@query(_exposure_level_check)
def pipeline_texts_first(spark, sf_dir):
    """Every text is parsed before the baseline cascade."""
    return run_pipeline(
        _exposures(spark, sf_dir), m2_sig_parse="nlp_first", return_level="exposure"
    ).select(
        "person_id", "drug_exposure_start_date", "drug_name_std", "daily_dose_mg_imputed",
        "pred_equiv_mg", "pred_equiv_status",
    )


@query(_exposure_level_check)
def pipeline_exposure_level(spark, sf_dir):
    return run_pipeline(_exposures(spark, sf_dir), return_level="exposure").select(
        "person_id", "drug_exposure_start_date", "drug_name_std", "daily_dose_mg_imputed",
        "pred_equiv_mg", "pred_equiv_status",
    )


def _study_check(select: str, gap: int = 30) -> str:
    return C.three_methods(gap).select(select)


@query(lambda: _study_check(" UNION ALL ".join(
    f"SELECT '{name}' AS method, {C.EPISODE_SELECT} FROM {eps}" for name, eps in C.METHODS.items())))
def study_episodes(spark, sf_dir):
    return stacked_episodes(method_records(_exposures(spark, sf_dir)))


# -------------------------------------------------------------------- evaluation ---
def _baseline_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_pipeline(_exposures(spark, sf_dir), "baseline")


def _written_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same episodes, for operators that read them more than once."""
    return written(_baseline_episodes(spark, sf_dir))


def _baseline_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_episodes(
        _baseline_episodes(spark, sf_dir), TT.gold_standard(spark, sf_dir)
    )


def _comparison_sql() -> C.With:
    q = C.episodes(C.baseline(False), "b", "ep", "dose")
    return C.comparison(q, "ep", "cmp")


@query(lambda: _comparison_sql().select(f"SELECT {C.COMPARISON_SELECT} FROM cmp"))
def eval_comparison(spark, sf_dir):
    return _baseline_comparison(spark, sf_dir)


@query(lambda: C.summary(_comparison_sql(), "cmp", "sm").select(f"SELECT {C.SUMMARY_SELECT} FROM sm"))
def eval_summary(spark, sf_dir):
    # The summary reads its input several times, so the comparison is written once.
    return summarise(written(_baseline_comparison(spark, sf_dir)))


_RANGE = ("CASE WHEN gold_dose > 0 AND gold_dose <= 10 THEN 'Low (<=10mg)' WHEN gold_dose > 10 AND "
          "gold_dose <= 20 THEN 'Medium (10-20mg)' WHEN gold_dose > 20 AND gold_dose <= 40 THEN "
          "'High (20-40mg)' WHEN gold_dose > 40 THEN 'Very High (>40mg)' END")


@query(lambda: _comparison_sql().select(
    f"SELECT {_RANGE} AS dose_range, {C.MEANS} FROM cmp WHERE computed_dose IS NOT NULL GROUP BY 1"))
def eval_by_range(spark, sf_dir):
    return by_dose_range(_baseline_comparison(spark, sf_dir))


@query(lambda: _comparison_sql().select(
    f"SELECT has_taper, {C.MEANS} FROM cmp LEFT JOIN (SELECT person_id, episode_start, n_records > 1 "
    "AS has_taper FROM ep) AS t ON t.person_id = cmp.patient_id AND t.episode_start = "
    "cmp.episode_start WHERE computed_dose IS NOT NULL GROUP BY 1"))
def eval_by_taper(spark, sf_dir):
    episodes = _written_episodes(spark, sf_dir).withColumn(
        "has_taper", F.col("n_records") > 1
    )
    comparison = compare_episodes(episodes, TT.gold_standard(spark, sf_dir))
    return by_taper_status(comparison, episodes)


_GOLD_SELECT = ("SELECT patient_id, episode_start, episode_end, drug_name_std, "
                f"{r('median_daily_dose_raw')}, {r('gold_pred_equiv_mg')}, {r('equiv_factor')}, "
                f"{r('median_daily_dose')} FROM gp")
_GOLD = ["patient_id", "episode_start", "episode_end", "drug_name_std", "median_daily_dose_raw",
         "gold_pred_equiv_mg", "equiv_factor", "median_daily_dose"]


def _oral_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oral_only(known_steroids(with_drug_name(_exposures(spark, sf_dir))))


@query(lambda: C.gold_converted(C.oral(C.rows())).select(_GOLD_SELECT))
def gold_pred_equiv(spark, sf_dir):
    gold = TT.gold_standard(spark, sf_dir)
    return gold_to_pred_equiv(gold, _oral_rows(spark, sf_dir)).select(*_GOLD)


@query(lambda: C.gold_converted(C.oral(C.rows()), earliest=True).select(_GOLD_SELECT))
def gold_pred_equiv_earliest(spark, sf_dir):
    gold = TT.gold_standard(spark, sf_dir)
    return gold_to_pred_equiv(gold, _oral_rows(spark, sf_dir), "earliest").select(*_GOLD)


def _agreement_check(label: str, condition: str) -> Callable[[], str]:
    def build() -> str:
        q = C.episodes(C.baseline(False), "b", "ep", "dose").add("gold", TT.plain(TT.GOLD_SQL))
        C.agreement(q, "ep", "ag", "gold", condition)
        return q.select(C.agreement_select(label, "ag"))

    return build


@query(_agreement_check("10 mg", "abs(cd - gd) <= 10"))
def day_agreement_mg(spark, sf_dir):
    return day_agreement(
        _written_episodes(spark, sf_dir), TT.gold_standard(spark, sf_dir)
    )


@query(_agreement_check(
    "5 mg OR 25%", "abs(cd - gd) <= 5 OR (gd <> 0 AND 100 * abs(cd - gd) / gd <= 25)"))
def day_agreement_mg_or_pct(spark, sf_dir):
    return day_agreement(
        _written_episodes(spark, sf_dir), TT.gold_standard(spark, sf_dir), 5.0, 25.0
    )


def _study(spark: SparkSession, sf_dir: str) -> StudyTables:
    """Shared tables of the three-method study, written once per query."""
    return study_tables(_exposures(spark, sf_dir), TT.gold_standard(spark, sf_dir))


def _study_sql(comparisons: bool = True) -> C.With:
    q = C.gold_converted(C.three_methods())
    if comparisons:
        for eps in C.METHODS.values():
            C.comparison(q, eps, f"c{eps}", "gp")
    return q


def _per_method(select: str, label: str = "method") -> str:
    """``select`` for each method; {c} and {e} are its comparison and episodes."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS {label}, " + select.format(c=f"c{eps}", e=eps)
        for name, eps in C.METHODS.items()
    )


def _metrics_check() -> str:
    q = _study_sql()
    for eps in C.METHODS.values():
        C.summary(q, f"c{eps}", f"s{eps}")
    names = {"coverage_pct": "Coverage_pct", "MAE": "MAE_mg", "MBE": "MBE_mg", "RMSE": "RMSE_mg",
             "MAPE": "MAPE_pct", "pearson_corr": "Pearson_r", "spearman_corr": "Spearman_rho"}
    columns = ", ".join(r(c, n) for c, n in names.items())
    return q.select(" UNION ALL ".join(
        f"SELECT '{name}' AS Method, (SELECT count(DISTINCT person_id) FROM {eps} WHERE person_id IN "
        f"(SELECT patient_id FROM gp)) AS Common_Patients, {columns} FROM s{eps}"
        for name, eps in C.METHODS.items()
    ))


@query(_metrics_check)
def metrics(spark, sf_dir):
    s = _study(spark, sf_dir)
    return metrics_table(s.comparison, s.episodes, s.gold)


def _all_agreement_check() -> str:
    q = _study_sql(comparisons=False)
    for eps in C.METHODS.values():
        C.agreement(q, eps, f"ag{eps}", "gp", "abs(cd - gd) <= 10")
    return q.select(" UNION ALL ".join(
        f"SELECT '{name}' AS method, * FROM ({C.agreement_select('10 mg', f'ag{eps}')}) AS y"
        for name, eps in C.METHODS.items()
    ))


@query(_all_agreement_check)
def day_agreement_by_method(spark, sf_dir):
    s = _study(spark, sf_dir)
    return day_agreement(s.episodes, s.gold, by=["method"])


# ---------------------------------------------------------------------- analyses ---
def _quantile(p: float) -> str:
    return f"quantile_cont(median_daily_dose, {p})"


@query(lambda: _study_sql(False).select(" UNION ALL ".join(
    f"SELECT '{name}' AS method, count(*) AS n_episodes, count(DISTINCT {pid}) AS n_patients, "
    f"{r('min(median_daily_dose)', 'min')}, {r(_quantile(0.25), 'q25')}, "
    f"{r(_quantile(0.5), 'median')}, {r('avg(median_daily_dose)', 'mean')}, "
    f"{r(_quantile(0.75), 'q75')}, {r('max(median_daily_dose)', 'max')} FROM {table} "
    "WHERE median_daily_dose > 0"
    for name, table, pid in [*((n, e, "person_id") for n, e in C.METHODS.items()),
                             ("Gold", "gp", "patient_id")])))
def dist_summary(spark, sf_dir):
    s = _study(spark, sf_dir)
    return A.dose_distribution(A.dose_rows(s.episodes, s.gold))


_MATCHED = "computed_dose IS NOT NULL"


@query(lambda: _study_sql().select(_per_method(
    f"patient_id, {r('gold_dose').replace('{', '{{')}, {r('computed_dose', 'method_dose')}, "
    f"{r('(computed_dose + gold_dose) / 2', 'mean_dose')}, {r('computed_dose - gold_dose', 'diff')} "
    f"FROM {{c}} WHERE {_MATCHED} AND gold_dose IS NOT NULL")))
def bland_altman_points(spark, sf_dir):
    return A.bland_altman_pairs(A.scatter_pairs(_study(spark, sf_dir).comparison))


@query(lambda: _study_sql().select(_per_method(
    f"count(*) AS n, {r('avg(bias_error)', 'bias')}, {r('stddev_samp(bias_error)', 'sd_diff')}, "
    f"{r('avg(bias_error) - 1.96 * stddev_samp(bias_error)', 'loa_lo')}, "
    f"{r('avg(bias_error) + 1.96 * stddev_samp(bias_error)', 'loa_hi')} "
    f"FROM {{c}} WHERE {_MATCHED} AND gold_dose IS NOT NULL")))
def bland_altman(spark, sf_dir):
    pairs = A.bland_altman_pairs(A.scatter_pairs(_study(spark, sf_dir).comparison))
    return A.bland_altman_limits(pairs)


_HIGH = (f"{_MATCHED} AND (absolute_error > 10 OR absolute_relative_error_pct > 50 OR "
         "(gold_dose = 0 AND bias_error <> 0))")


def _high_sql() -> C.With:
    q = _study_sql()
    return q.add("he", _per_method(f"* FROM {{c}} WHERE {_HIGH}"))


@query(lambda: _high_sql().select(f"SELECT method, {C.COMPARISON_SELECT} FROM he"))
def high_error_episodes(spark, sf_dir):
    return A.high_errors(_study(spark, sf_dir).comparison)


@query(lambda: _high_sql().select(
    f"SELECT method, {C.COMPARISON_SELECT} FROM he ORDER BY he.absolute_error DESC NULLS LAST, "
    "patient_id, episode_start, episode_end, he.gold_dose, he.computed_dose, method LIMIT 20"))
def top_error_episodes(spark, sf_dir):
    return A.top_errors(A.high_errors(_study(spark, sf_dir).comparison), 20)


_GROUP_MEANS = C.MEANS


@query(lambda: _high_sql().select(
    f"SELECT method, drug_name_std, {_GROUP_MEANS} FROM he LEFT JOIN gp USING (patient_id, "
    "episode_start, episode_end) GROUP BY 1, 2"))
def error_by_drug(spark, sf_dir):
    s = _study(spark, sf_dir)
    return A.error_by_drug(A.high_errors(s.comparison), s.gold)


@query(lambda: _high_sql().select(
    f"SELECT method, error_direction, count(*) AS n, {r('avg(absolute_error)', 'mean_abs_error')} "
    "FROM he GROUP BY 1, 2"))
def error_by_direction(spark, sf_dir):
    return A.error_by_direction(A.high_errors(_study(spark, sf_dir).comparison))


_WORST = ("SELECT patient_id FROM (SELECT patient_id, max(absolute_error) AS w FROM he GROUP BY 1 "
          "ORDER BY w DESC NULLS LAST, patient_id LIMIT 20)")


@query(lambda: _high_sql().select(
    f"SELECT person_id, drug_exposure_start_date, sig, {r('quantity')} FROM x WHERE person_id IN ({_WORST})"))
def high_error_records(spark, sf_dir):
    s = _study(spark, sf_dir)
    context = A.high_error_context(A.high_errors(s.comparison), s.gold, s.raw)
    return context["records"].select("person_id", "drug_exposure_start_date", "sig", "quantity")


def _funnel_check() -> str:
    def row(order: int, label: str, patients: str, rows: str) -> str:
        return f"SELECT {order} AS step_order, '{label}' AS Step, {patients} AS Patients, {rows} AS Episodes"

    def persons(table: str, column: str = "person_id") -> str:
        return f"(SELECT count(DISTINCT {column}) FROM {table})"

    def n(table: str) -> str:
        return f"(SELECT count(*) FROM {table})"

    def gold_in(table: str) -> str:
        return (f"(SELECT count(DISTINCT patient_id) FROM gp WHERE patient_id IN (SELECT person_id "
                f"FROM {table}))")

    steps = [("DB: raw records (all steroids)", persons("x"), n("x")),
             ("DB: after oral/drug filter", persons("b"), n("b"))]
    steps += [(f"DB: with >=1 episode ({m})", persons(e), n(e)) for m, e in C.METHODS.items()]
    steps += [("Gold: total", persons("gp", "patient_id"), n("gp")),
              ("Gold: found in DB", gold_in("x"), "CAST(NULL AS BIGINT)")]
    steps += [(f"Gold: with {m} episode", gold_in(e), "CAST(NULL AS BIGINT)")
              for m, e in C.METHODS.items()]
    steps += [(f"Gold eps matched ({m})", "CAST(NULL AS BIGINT)", n(f"c{e} WHERE {_MATCHED}"))
              for m, e in C.METHODS.items()]
    return _study_sql().select(
        " UNION ALL ".join(row(i, *step) for i, step in enumerate(steps, start=1))
    )


@query(_funnel_check)
def funnel(spark, sf_dir):
    s = _study(spark, sf_dir)
    return A.eligibility_funnel(s.raw, s.oral, s.episodes, s.gold, s.comparison, METHODS)


def _counts_check() -> str:
    q = _study_sql()
    parts = [
        f"SELECT '{m}' AS Source, count(DISTINCT person_id) AS Patients, count(*) AS Episodes, (SELECT "
        f"count(*) FROM c{e} WHERE {_MATCHED}) AS Overlap_with_Gold, "
        f"{r('median(median_daily_dose)', 'Median_mg')} FROM {e}"
        for m, e in C.METHODS.items()
    ]
    parts.append("SELECT 'Gold Standard', count(DISTINCT patient_id), count(*), CAST(NULL AS BIGINT), "
                 f"{r('median(median_daily_dose)', 'Median_mg')} FROM gp")
    return q.select(" UNION ALL ".join(parts))


@query(_counts_check)
def episode_counts(spark, sf_dir):
    s = _study(spark, sf_dir)
    return A.episode_counts(s.episodes, s.gold, s.comparison)


@query(lambda: C.nlp(C.oral(C.rows()), "n").select(
    "SELECT nlp_status AS parsed_status, count(*) AS n, "
    f"{r('100.0 * count(*) / sum(count(*)) OVER ()', 'pct')} FROM n GROUP BY 1"))
def status_share(spark, sf_dir):
    return A.value_shares(calc_daily_dose_nlp(_exposures(spark, sf_dir)), "parsed_status")


@query(lambda: _comparison_sql().select(
    "SELECT agreement_category, count(*) AS n, "
    f"{r('100.0 * count(*) / sum(count(*)) OVER ()', 'pct')} FROM cmp WHERE {_MATCHED} GROUP BY 1"))
def agreement_share(spark, sf_dir):
    comparison = _baseline_comparison(spark, sf_dir).where(_MATCHED)
    return A.value_shares(comparison, "agreement_category")


def _non_null_check() -> str:
    columns = {"dose_from_original": "c_original", "dose_from_tablets_freq": "c_tablets",
               "dose_from_supply": "c_supply", "dose_from_actual_duration": "c_duration",
               "daily_dose_mg_imputed": "dose"}
    return C.baseline(True).select(" UNION ALL ".join(
        f"SELECT '{name}' AS column_name, count({c}) AS n FROM b" for name, c in columns.items()))


@query(_non_null_check)
def non_null_counts(spark, sf_dir):
    records = calc_daily_dose_baseline(_exposures(spark, sf_dir, True))
    return A.non_null_counts(
        records,
        ["dose_from_original", "dose_from_tablets_freq", "dose_from_supply",
         "dose_from_actual_duration", "daily_dose_mg_imputed"],
    )


@query(lambda: C.parsed(C.rows(), "x", "p").select(
    "SELECT sig, count(*) AS n FROM p WHERE status = 'no_parse' GROUP BY 1 ORDER BY n DESC, sig LIMIT 15"))
def top_unparsed(spark, sf_dir):
    return A.top_unparsed_sigs(parse_sig(_exposures(spark, sf_dir)))


@query(lambda: C.episodes(C.baseline(False), "b", "ep", "dose").select(
    "SELECT person_id, drug_name_std, episode_start, episode_end, n_days, n_records, "
    f"{r('median_daily_dose')}, {r('mean_daily_dose')} FROM ep WHERE person_id IN (SELECT person_id "
    "FROM (SELECT person_id, count(*) AS n FROM ep GROUP BY 1 ORDER BY n DESC, person_id LIMIT 3))"))
def top_trajectories(spark, sf_dir):
    return A.top_patient_trajectories(_written_episodes(spark, sf_dir))


@query(lambda: C.oral(C.rows()).select(
    "SELECT drug_name_std, count(*) AS n FROM x WHERE person_id NOT IN (SELECT person_id FROM o) "
    "GROUP BY 1 ORDER BY n DESC, drug_name_std NULLS LAST LIMIT 10"))
def dropped_patients_drugs(spark, sf_dir):
    raw = with_drug_name(_exposures(spark, sf_dir))
    return A.dropped_patient_drugs(raw, oral_only(known_steroids(raw)))


@query(lambda: C.oral(C.rows()).select(
    "SELECT DISTINCT person_id FROM x WHERE person_id NOT IN (SELECT person_id FROM o)"))
def dropped_patients(spark, sf_dir):
    raw = with_drug_name(_exposures(spark, sf_dir))
    return A.dropped_patients(raw, oral_only(known_steroids(raw)))


@query(lambda: C.oral(C.rows()).add("gold", TT.plain(TT.GOLD_SQL)).select(
    f"SELECT patient_id, episode_start, episode_end, {r('median_daily_dose')} FROM gold WHERE "
    "patient_id NOT IN (SELECT person_id FROM o)"))
def gold_without_records(spark, sf_dir):
    return A.gold_missing_from(_oral_rows(spark, sf_dir), TT.gold_standard(spark, sf_dir))


@query(lambda: _comparison_sql().select(
    f"SELECT patient_id, episode_start, episode_end, {r('gold_dose')} FROM cmp WHERE computed_dose IS NULL"))
def unmatched_gold(spark, sf_dir):
    return A.unmatched_gold(_baseline_comparison(spark, sf_dir))


@query(lambda: _comparison_sql().select(
    f"SELECT person_id, drug_exposure_start_date, sig, {r('quantity')} FROM x WHERE person_id IN "
    "(SELECT patient_id FROM cmp WHERE computed_dose IS NULL)"))
def unmatched_gold_records(spark, sf_dir):
    return A.unmatched_gold_records(
        _baseline_comparison(spark, sf_dir), _exposures(spark, sf_dir)
    ).select("person_id", "drug_exposure_start_date", "sig", "quantity")


@query(lambda: _study_check(" UNION ALL ".join(
    f"SELECT CAST(person_id AS VARCHAR) AS person_id, drug_name_std, episode_start AS x, episode_end "
    f"AS xend, {r('median_daily_dose', 'y')}, '{name}' AS method FROM {eps} WHERE median_daily_dose "
    "IS NOT NULL" for name, eps in C.METHODS.items())))
def timeline_segments(spark, sf_dir):
    return A.timeline_segments(
        stacked_episodes(method_records(_exposures(spark, sf_dir)))
    )


@query(lambda: _study_check(" UNION ALL ".join(
    f"SELECT person_id, drug_name_std, episode_start, n_records, '{name}' AS method FROM {eps} WHERE "
    "drug_name_std IN ('prednisone', 'dexamethasone')" for name, eps in C.METHODS.items())))
def review_episodes(spark, sf_dir):
    episodes = stacked_episodes(method_records(_exposures(spark, sf_dir)))
    return A.review_rows(episodes, drugs=["prednisone", "dexamethasone"]).select(
        "person_id", "drug_name_std", "episode_start", "n_records", "method"
    )


@query(lambda: C.rows().select(
    "SELECT drug_name_std, " + r("quantile_cont(quantity, 0.25)", "q25") + ", "
    + r("median(quantity)", "q50") + ", " + r("quantile_cont(quantity, 0.9)", "q90")
    + " FROM x WHERE quantity IS NOT NULL GROUP BY 1"))
def quantity_quantiles(spark, sf_dir):
    named = with_drug_name(_exposures(spark, sf_dir))
    return exact_quantiles(
        named, "quantity", {"q25": 0.25, "q50": 0.5, "q90": 0.9}, ["drug_name_std"]
    )


# ----------------------------------------------------------------------- cohorts ---
_COHORT_TABLES = ("concept", "concept_ancestor", "person", "observation_period",
                  "condition_occurrence", "drug_exposure", "procedure_occurrence")


def _brand(*numbers: int) -> list[int]:
    return [1_000_000_000 + n for n in numbers]


def _ids(ids: list[int]) -> str:
    return ", ".join(str(i) for i in ids)


def _cohort_sql() -> C.With:
    return _clinical_sql(C.With(), *_COHORT_TABLES)


def _set_sql(listed: list[int], ancestors: list[int], excluded: list[int] = ()) -> str:
    skip = f" AND ca.descendant_concept_id NOT IN ({_ids(excluded)})" if excluded else ""
    children = (
        " UNION SELECT ca.descendant_concept_id FROM concept_ancestor AS ca JOIN concept AS c ON "
        "ca.descendant_concept_id = c.concept_id WHERE ca.ancestor_concept_id IN "
        f"({_ids(ancestors)}) AND c.invalid_reason IS NULL{skip}" if ancestors else ""
    )
    return f"SELECT DISTINCT concept_id FROM concept WHERE concept_id IN ({_ids(listed)}){children}"


_LISTED = [3, 14, 15, *_brand(2, 5)]


@query(lambda: _cohort_sql().select(_set_sql(_LISTED, _LISTED)))
def concept_set(spark, sf_dir):
    tables = TT.clinical(spark, sf_dir, "concept", "concept_ancestor")
    return K.concept_set(tables, _LISTED, include_descendants=True)


CONFIG = {
    "cohort_name": "Brands in sequence",
    "index_event": {
        "domain": "condition_occurrence",
        "concept_ids": _brand(3, 4),
        "include_descendants": True,
    },
    "required_exposures": [
        {
            "name": "later",
            "domain": "drug_exposure",
            "concept_ids": _brand(5, 6, 7, 8),
            "include_descendants": True,
            "timing": "on_or_after_index",
        },
        {
            "name": "any",
            "domain": "drug_exposure",
            "concept_ids": _brand(9, 10, 11, 12),
            "include_descendants": True,
            "timing": "anytime",
        },
    ],
    "inclusion_rules": [{"type": "age_min", "value": 18}],
}
# Listed concepts expand from fewer ancestors, others count as listed only.
EXACT_CONFIG = {
    "cohort_name": "Exact and expanded lists",
    "index_event": {
        "domain": "condition_occurrence",
        "concept_ids": [*_brand(13, 14), 21, 22],
        "descendant_of": _brand(13),
        "exact_concept_ids": [1, 2, 5, 8, 13, 34, 55, 89, 144],
    },
    "required_exposures": [
        {
            "name": "any",
            "domain": "drug_exposure",
            "concept_ids": _brand(15, 16, 17),
            "include_descendants": True,
            "timing": "anytime",
        }
    ],
    "inclusion_rules": [{"type": "age_min", "value": 18}],
}


def _first_events(q: C.With, concepts: str) -> C.With:
    """first_events: of the events in watched time, ranked by day, each person's first."""
    q.add("listed_days", "SELECT person_id, condition_start_date AS day FROM condition_occurrence WHERE "
          f"condition_concept_id IN ({concepts})")
    q.add("watched_days", "SELECT w.*, row_number() OVER (PARTITION BY person_id ORDER BY day) AS place, "
          "min(since) OVER (PARTITION BY person_id) AS first_watched, max(until) OVER (PARTITION BY "
          "person_id) AS last_watched FROM (SELECT listed_days.person_id, day, "
          "observation_period_start_date AS since, observation_period_end_date AS until FROM "
          "observation_period, listed_days WHERE listed_days.person_id = observation_period.person_id "
          "AND day >= observation_period_start_date AND day <= observation_period_end_date) AS w")
    return q.add("first_events", "SELECT person_id, day, first_watched, last_watched, (SELECT "
                 "max(year_of_birth) FROM person WHERE person.person_id = watched_days.person_id) AS born "
                 "FROM watched_days WHERE place = 1")


_LATER = "taken >= day"
_ANY = "taken >= first_watched AND taken <= last_watched"


def _adults_with(*needs: tuple[str, str]) -> str:
    """Persons of 18 or more who belong to the takers of every listed set in its time."""
    takers = [
        "SELECT first_events.person_id FROM first_events JOIN (SELECT person_id, drug_concept_id, "
        "drug_exposure_start_date AS taken FROM drug_exposure) AS t USING (person_id) WHERE "
        f"{when} AND drug_concept_id IN ({concepts})" for concepts, when in needs
    ]
    return " INTERSECT ".join(["SELECT person_id FROM first_events WHERE born <= year(day) - 18", *takers])


def _config_members() -> str:
    return _adults_with((_set_sql(_brand(5, 6, 7, 8), _brand(5, 6, 7, 8)), _LATER),
                        (_set_sql(_brand(9, 10, 11, 12), _brand(9, 10, 11, 12)), _ANY))


def _config_sql(q: C.With) -> C.With:
    return _first_events(q, _set_sql(_brand(3, 4), _brand(3, 4)))


@query(lambda: _config_sql(_cohort_sql()).select(_config_members()))
def cohort_config(spark, sf_dir):
    return K.build_cohort(TT.clinical(spark, sf_dir, *_COHORT_TABLES), CONFIG)


def _exact_check() -> str:
    exact = EXACT_CONFIG["index_event"]["exact_concept_ids"]
    concepts = (_set_sql([*_brand(13, 14), 21, 22], _brand(13))
                + f" UNION SELECT concept_id FROM concept WHERE concept_id IN ({_ids(exact)})")
    return _first_events(_cohort_sql(), concepts).select(
        _adults_with((_set_sql(_brand(15, 16, 17), _brand(15, 16, 17)), _ANY))
    )


@query(_exact_check)
def cohort_exact_and_expanded(spark, sf_dir):
    return K.build_cohort(TT.clinical(spark, sf_dir, *_COHORT_TABLES), EXACT_CONFIG)


_EVIDENCE = {
    "concept_ids": _brand(18, 19),
    "include_descendants": True,
    "exclude_descendants": [7, 19, 31],
    "valid_only": True,
}


def _evidence_sql() -> str:
    concepts = _set_sql(_brand(18, 19), _brand(18, 19), [7, 19, 31])
    return ("SELECT person_id FROM drug_exposure WHERE drug_concept_id IN "
            f"({concepts}) UNION SELECT person_id FROM procedure_occurrence WHERE "
            f"procedure_concept_id IN ({concepts})")


@query(lambda: _cohort_sql().select(_evidence_sql()))
def cohort_union_evidence(spark, sf_dir):
    return K.persons_with_concepts(
        TT.clinical(spark, sf_dir, *_COHORT_TABLES),
        _EVIDENCE,
        ("drug_exposure", "procedure_occurrence"),
    )


_INFECTION = {"concept_ids": _brand(20, 21), "descendant_of": _brand(20)}


@query(lambda: _config_sql(_cohort_sql()).add("base", _config_members()).add(
    "infection", "SELECT DISTINCT person_id FROM condition_occurrence WHERE condition_concept_id IN "
    f"({_set_sql(_brand(20, 21), _brand(20))}) AND person_id IN (SELECT person_id FROM base)").add(
    "vaccinated", f"SELECT person_id FROM ({_evidence_sql()}) AS ev WHERE person_id IN (SELECT "
    "person_id FROM infection)").select(
    "SELECT 'base' AS tier, person_id FROM base UNION ALL SELECT 'infection', person_id FROM "
    "infection UNION ALL SELECT 'vaccinated', person_id FROM vaccinated"))
def cohort_tiers(spark, sf_dir):
    tables = TT.clinical(spark, sf_dir, *_COHORT_TABLES)
    return K.tier_members(tables, CONFIG, _INFECTION, _EVIDENCE)


@query(lambda: _config_sql(_cohort_sql()).add("a", _config_members()).add("b", _evidence_sql()).select(
    "SELECT 'both' AS part, person_id FROM (SELECT person_id FROM a INTERSECT SELECT person_id FROM "
    "b) AS i UNION ALL SELECT 'first only', person_id FROM (SELECT person_id FROM a EXCEPT SELECT "
    "person_id FROM b) AS e"))
def cohort_set_operations(spark, sf_dir):
    tables = TT.clinical(spark, sf_dir, *_COHORT_TABLES)
    a = K.build_cohort(tables, CONFIG)
    b = K.persons_with_concepts(
        tables, _EVIDENCE, ("drug_exposure", "procedure_occurrence")
    )
    parts = {"both": K.intersect_cohorts(a, b), "first only": K.subtract_cohort(a, b)}
    return A.stack(parts, "part")


def _cohort_pipeline_check() -> str:
    q = C.oral(C.rows())
    _clinical_sql(q, *_COHORT_TABLES)
    _config_sql(q).add("members", _config_members())
    q.parts["o"] += " AND person_id IN (SELECT person_id FROM members)"
    names = list(q.parts)
    order = ["x0", "x", *[n for n in names if n not in ("x0", "x", "o")], "o"]
    q.parts = {n: q.parts[n] for n in order}
    C.parsed(q, "o", "p")
    C.candidates(q, "p", "c0", "daily")
    C.cascade(q, "c0", "b0")
    return C.episodes(q, "b0", "ep", "dose").select(f"SELECT {C.EPISODE_SELECT} FROM ep")


@query(_cohort_pipeline_check)
def cohort_pipeline(spark, sf_dir):
    """The whole chain: a cohort restricts the exposures of the pipeline."""
    members = K.build_cohort(TT.clinical(spark, sf_dir, *_COHORT_TABLES), CONFIG)
    return run_pipeline(_exposures(spark, sf_dir), "baseline", person_ids=members)


# Bundled cohorts, on tables whose events carry their concept ids.
def _bundled(name: str) -> dict:
    return K.load_config(name)


def _bundled_codes() -> list[int]:
    found: set[int] = set()
    for name in ("rheumatic_dmard", "zoster_antivirals", "zoster_infection", "zoster_vaccine"):
        config = _bundled(name)
        for spec in (config["index_event"], *config.get("required_exposures", [])):
            for part in ("concept_ids", "exact_concept_ids", "exclude_descendants"):
                found.update(spec.get(part) or [])
    return sorted(found)


def _coded(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return TT.coded(spark, sf_dir, _bundled_codes())


def _coded_sql() -> C.With:
    q = C.With()
    for name, sql in TT.coded_sql(_bundled_codes()).items():
        q.add(name, TT.plain(sql))
    return q


def _antiviral_check(everything: bool) -> Callable[[], str]:
    def build() -> str:
        config = _bundled("zoster_antivirals")
        index, (first, second) = config["index_event"], config["required_exposures"]
        above = index["concept_ids"] if everything else index["descendant_of"]
        q = _first_events(_coded_sql(), _set_sql(index["concept_ids"], above))
        return q.select(_adults_with(
            (_set_sql(first["concept_ids"], first["concept_ids"]), _LATER),
            (_set_sql(second["concept_ids"], second["concept_ids"]), _ANY)))
    return build


@query(_antiviral_check(False))
def cohort_zoster_antivirals(spark, sf_dir):
    return K.zoster_antivirals(_coded(spark, sf_dir))


@query(_antiviral_check(True))
def cohort_zoster_antivirals_expanded(spark, sf_dir):
    return K.build_cohort(_coded(spark, sf_dir), "zoster_antivirals_all_descendants")


def _rheumatic_sql(q: C.With) -> str:
    config = _bundled("rheumatic_dmard")
    index, (drug,) = config["index_event"], config["required_exposures"]
    _first_events(q, _set_sql(index["concept_ids"], index["descendant_of"]) + " UNION SELECT concept_id "
                  f"FROM concept WHERE concept_id IN ({_ids(index['exact_concept_ids'])})")
    return _adults_with((_set_sql(drug["concept_ids"], drug["concept_ids"]), _ANY))


def _rheumatic_check() -> str:
    q = _coded_sql()
    return q.select(_rheumatic_sql(q))


@query(_rheumatic_check)
def cohort_rheumatic_dmard(spark, sf_dir):
    return K.rheumatic_dmard(_coded(spark, sf_dir))


def _infection_sql() -> str:
    index = _bundled("zoster_infection")["index_event"]
    return ("SELECT DISTINCT person_id FROM condition_occurrence WHERE condition_concept_id IN "
            f"({_set_sql(index['concept_ids'], index['descendant_of'])})")


def _vaccine_sql() -> str:
    index = _bundled("zoster_vaccine")["index_event"]
    listed = index["concept_ids"]
    concepts = (f"SELECT concept_id FROM ({_set_sql(listed, listed, index['exclude_descendants'])}) AS s "
                "WHERE concept_id IN (SELECT concept_id FROM concept WHERE invalid_reason IS NULL)")
    return (f"SELECT person_id FROM drug_exposure WHERE drug_concept_id IN ({concepts}) UNION SELECT "
            f"person_id FROM procedure_occurrence WHERE procedure_concept_id IN ({concepts})")


@query(lambda: _coded_sql().select(_infection_sql()))
def cohort_zoster_infection(spark, sf_dir):
    return K.zoster_infection(_coded(spark, sf_dir))


@query(lambda: _coded_sql().select(_vaccine_sql()))
def cohort_zoster_vaccine(spark, sf_dir):
    return K.zoster_vaccine(_coded(spark, sf_dir))


def _bundled_tiers_check() -> str:
    q = _coded_sql()
    base = _rheumatic_sql(q)
    q.add("base", base)
    q.add("infection", f"SELECT person_id FROM base INTERSECT ({_infection_sql()})")
    q.add("vaccinated", f"SELECT person_id FROM infection INTERSECT ({_vaccine_sql()})")
    return q.select(" UNION ALL ".join(
        f"SELECT '{tier}' AS tier, person_id FROM {tier}" for tier in ("base", "infection", "vaccinated")))


@query(_bundled_tiers_check)
def cohort_bundled_tiers(spark, sf_dir):
    return A.stack(K.cohort_tiers(_coded(spark, sf_dir)), "tier")
