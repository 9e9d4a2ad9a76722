"""Sources, sinks, cohorts, the pipeline and the study on small fixtures."""

import datetime as dt
import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from posolog import ClinicalTables, extract_exposures, run_pipeline, run_study, to_exposures
from posolog.operators import cohort as K
from posolog.sources.exposure import apply_sig_source, select_exposures, with_exposure_id
from posolog.sources.files import (
    read_concept_ids,
    read_exposure_csv,
    read_gold_csv,
    unreadable_cells,
    write_ordered,
    write_tables,
)

D = dt.date
HEADER = ("person_id,drug_concept_name,drug_source_value,drug_exposure_start_date,"
          "drug_exposure_end_date,quantity,days_supply,amount_value,daily_dose,sig,route_concept_name\n")
CSV = HEADER + (
    "1,prednisone 10 MG oral tablet,PREDNISONE 10 MG TABLET,2023-01-01,2023-03-31,90,90,10,10,"
    "Take 1 tablet (10 mg) by mouth daily.,Oral\n"
    "1,prednisone 5 MG oral tablet,PREDNISONE 5 MG TABLET,2023-04-10,2023-06-30,90,,5,,"
    "\"Take 2 tablets, daily\",Oral\n"
    # one field is missing: the text lands in the dose column
    "2,prednisone 10 MG oral tablet,PREDNISONE 10 MG TABLET,2023-07-01,2023-09-30,92,92,,"
    "Take 1 tab (10 mg per dose) daily.,Oral\n"
)


@pytest.fixture(scope="module")
def exposures(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "exposures.csv"
    path.write_text(CSV)
    return read_exposure_csv(spark, str(path))


def test_csv_keeps_a_malformed_row(exposures, rows):
    out = rows(exposures, "drug_exposure_start_date")
    assert len(out) == 3
    assert out[0]["daily_dose"] == 10 and out[0]["drug_exposure_start_date"] == D(2023, 1, 1)
    assert out[2]["daily_dose"] is None and out[2]["sig"] == "Oral"
    # its route is read from the drug text, its strength too
    row = run_pipeline(exposures, return_level="exposure").where("person_id = 2").first()
    assert (row.daily_dose_mg_imputed, row.imputation_method) == (10, "actual_duration")


def test_unreadable_cells(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("person_id,drug_exposure_start_date,quantity,sig\n"
                    "1,2023-01-01,ten,a\n2,31.12.2023,NA,b\n3,20230105,,c\n4,1/6/2023,5\n5,2023-01-07,1e1,\"\"\n")
    bad = unreadable_cells(spark, str(path)).collect()
    assert sorted((r.column or "", r.cell or "", r.reason) for r in bad) == [
        ("", "", "wrong number of fields"),
        ("drug_exposure_start_date", "31.12.2023", "not a date"),
        ("quantity", "ten", "not a number"),
    ]
    assert {r.file for r in bad} == {"bad.csv"}
    assert [r.record for r in bad if r.column is None] == ["4,1/6/2023,5"]
    read = {r.person_id: (r.drug_exposure_start_date, r.quantity, r.sig)
            for r in read_exposure_csv(spark, str(path)).collect()}
    assert read == {1: (D(2023, 1, 1), None, "a"), 2: (None, None, "b"), 3: (D(2023, 1, 5), None, "c"),
                    4: (D(2023, 1, 6), 5.0, None), 5: (D(2023, 1, 7), 10.0, None)}


def test_ordered_files(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 7).selectExpr("id * 7919 % 1000 AS a", "id AS b", "CAST(NULL AS INT) AS c")
    path = write_ordered(rows, str(tmp_path / "ordered"), "a", files=5)
    files = sorted((tmp_path / "ordered").glob("*.parquet"))
    got = [r.a for file in files for r in spark.read.parquet(str(file)).collect()]
    assert got == sorted(got) and len(got) == 1000 and len(files) > 1 and path.endswith("ordered")


def test_other_files(spark, tmp_path):
    (tmp_path / "gold.csv").write_text(
        "patient_id,episode_start,episode_end,median_daily_dose,days_covered\n1,2023-01-01,2023-06-30,10,3\n")
    (tmp_path / "ids.csv").write_text("1518254\n40224131\n")
    gold = read_gold_csv(spark, str(tmp_path / "gold.csv"))
    assert tuple(gold.first()) == (1, D(2023, 1, 1), D(2023, 6, 30), 10.0, "3")
    assert read_concept_ids(spark, str(tmp_path / "ids.csv")).count() == 2
    for kind in ("csv", "parquet"):
        paths = write_tables({"gold": gold}, str(tmp_path / kind), kind)
        assert spark.read.format(kind).load(paths["gold"]).count() >= 1


def test_selection(spark, exposures):
    assert select_exposures(exposures, person_ids=[1]).count() == 2
    assert select_exposures(exposures, person_ids=spark.createDataFrame([(2,)], "p long")).count() == 1
    assert select_exposures(exposures, start_date="2023-04-01", end_date="2023-06-30").count() == 1
    with pytest.raises(ValueError):
        select_exposures(exposures.drop("person_id"))
    with pytest.raises(TypeError):
        to_exposures("table")
    aliased = apply_sig_source(exposures.drop("sig"), "drug_source_value")
    assert aliased.first().sig == "PREDNISONE 10 MG TABLET"
    assert apply_sig_source(exposures, "drug_source_value").where("sig LIKE 'PRED%'").count() == 0
    ids = with_exposure_id(exposures.union(exposures))
    assert sorted(r.drug_exposure_id for r in ids.collect()) == [1, 2, 3, 4, 5, 6]


def test_exposure_ids_move_rows_once_and_only_what_is_read(spark):
    rows = [(i % 40, "a" if i % 3 else None, "a" if i % 3 == 0 else None, i / 7 if i % 5 else None) for i in range(200)] + [(1, "x", None, 2.0)] * 50
    schema = "person_id long, sig string, drug_source_value string, quantity double"
    frame = spark.createDataFrame(rows, schema)
    found = {tuple(r) for r in with_exposure_id(frame, slots=8).collect()}
    assert Counter(r[:4] for r in found) == Counter(rows)
    assert sorted(r[4] for r in found) == list(range(1, len(rows) + 1))
    again = with_exposure_id(spark.createDataFrame(rows[::-1], schema).repartition(7), slots=8)
    assert {tuple(r) for r in again.collect()} == found

    def moved(df):
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return re.findall(r"\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning", plan)

    ids = with_exposure_id(frame)
    assert sum("sig#" in columns for columns in moved(ids)) == 1
    assert not any("sig#" in columns for columns in moved(ids.agg(F.countDistinct("drug_exposure_id"))))


@pytest.fixture(scope="module")
def tables(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    day = D(2020, 6, 1)
    return {
        "concept": make([(1, "a", None), (2, "b", None), (3, "old", "D"), (4, "drug", None),
                         (5, "route", None)],
                        "concept_id long, concept_name string, invalid_reason string"),
        "concept_ancestor": make([(1, 2), (1, 3), (4, 4)],
                                 "ancestor_concept_id long, descendant_concept_id long"),
        "person": make([(1, 1980), (2, 2010), (3, 1980)], "person_id long, year_of_birth int"),
        "observation_period": make(
            [(p, D(2020, 1, 1), D(2020, 12, 31)) for p in (1, 2, 3)],
            "person_id long, observation_period_start_date date, observation_period_end_date date"),
        "condition_occurrence": make(
            [(1, 2, day), (2, 1, day), (3, 2, day), (3, 3, D(2020, 1, 2)), (1, 1, D(2019, 1, 1))],
            "person_id long, condition_concept_id long, condition_start_date date"),
        "drug_exposure": make(
            [(1, 4, D(2021, 1, 1)), (2, 4, day), (3, 4, D(2020, 2, 1))],
            "person_id long, drug_concept_id long, drug_exposure_start_date date"),
        "procedure_occurrence": make([(9, 4)], "person_id long, procedure_concept_id long"),
    }


def _config(timing, **extra):
    return {"index_event": {"concept_ids": [1], "include_descendants": True},
            "required_exposures": [{"concept_ids": [4], "timing": timing}], **extra}


def _ids(df):
    return sorted(r.person_id for r in df.collect())


def test_cohorts(tables, tmp_path):
    assert _ids(K.build_cohort(tables, _config("on_or_after_index"))) == [1, 2]
    assert _ids(K.build_cohort(tables, _config("anytime"))) == [2, 3]
    adults = {"inclusion_rules": [{"type": "age_min", "value": 18}]}
    assert _ids(K.build_cohort(tables, _config("on_or_after_index", **adults))) == [1]
    with pytest.raises(ValueError):
        K.build_cohort(tables, _config("anytime", inclusion_rules=[{"type": "sex"}]))
    with pytest.raises(ValueError):
        K.check_config({"index_event": {"concept_ids": []}})
    both = K.persons_with_concepts(tables, {"concept_ids": [4]}, ("drug_exposure", "procedure_occurrence"))
    assert _ids(both) == [1, 2, 3, 9]
    concepts = K.concept_set(tables, [1], True, exclude_descendants=[2])
    assert [r.concept_id for r in concepts.collect()] == [1]
    path = tmp_path / "c.json"
    path.write_text(json.dumps(_config("anytime")))
    assert _ids(K.build_cohort(tables, path)) == [2, 3]


def test_bundled_cohorts_plan(tables):
    for name in ("zoster_antivirals", "zoster_antivirals_all_descendants", "rheumatic_dmard"):
        assert K.build_cohort(tables, name).columns == ["person_id"]
    assert set(K.cohort_tiers(tables)) == {"base", "infection", "vaccinated"}
    assert len(K.load_config("rheumatic_dmard")["index_event"]["exact_concept_ids"]) == 172


def test_one_scan_per_event_table(spark, tables, tmp_path):
    stored = {}
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    flags = K.cohort_flags(
        stored,
        {"early": _config("anytime"), "late": _config("on_or_after_index")},
        {"ill": ({"concept_ids": [2]}, ("condition_occurrence",)),
         "treated": ({"concept_ids": [4]}, ("drug_exposure", "procedure_occurrence"))},
    )
    got = {r.person_id: (r.early, r.late, r.ill, r.treated) for r in flags.collect()}
    assert got == {1: (False, True, True, True), 2: (True, True, False, True),
                   3: (True, False, True, True), 9: (False, False, False, True)}
    plan = flags._jdf.queryExecution().optimizedPlan().toString()
    relations = plan.count("Relation [")
    # three event tables, periods, and the vocabulary for listed, expanded and valid concepts
    assert relations == 7, plan


def test_extraction(spark, tables):
    fact = spark.createDataFrame(
        [(1, 10, 4, 4, D(2020, 1, 1), None, 1.0, 1.0, "x", 5, "MG", "src"),
         (2, 11, 77, 77, D(2031, 1, 1), None, 1.0, 1.0, "x", 6, "MG", "src")],
        "person_id long, drug_exposure_id long, drug_concept_id long, drug_source_concept_id long, "
        "drug_exposure_start_date date, drug_exposure_end_date date, quantity double, days_supply "
        "double, sig string, route_concept_id long, dose_unit_source_value string, "
        "drug_source_value string")
    strength = spark.createDataFrame([(4, 5.0, 8576), (4, 7.0, 8576), (4, None, 1)],
                                     "drug_concept_id long, amount_value double, amount_unit_concept_id int")
    source = ClinicalTables(fact, tables["concept"], strength)
    out = extract_exposures(source, end_date="2032-01-01")
    got = {r.person_id: (r.drug_concept_name, r.route_concept_name, r.amount_value) for r in out.collect()}
    assert got == {1: ("drug", "route", 7.0), 2: (None, None, None)}
    assert extract_exposures(source, end_date="2026-01-01").count() == 1
    assert extract_exposures(source, drug_concept_ids=[4]).count() == 1


def test_study(spark, exposures, tmp_path):
    gold = spark.createDataFrame([(1, D(2023, 1, 1), D(2023, 6, 30), 10.0), (7, D(2023, 1, 1), D(2023, 2, 1), 5.0)],
                                 "patient_id long, episode_start date, episode_end date, median_daily_dose double")
    result = run_study(exposures, gold, str(tmp_path / "study"))
    metrics = {r.Method: r for r in spark.read.parquet(result.paths["metrics_table"]).collect()}
    assert set(metrics) == {"Baseline", "NLP", "Advanced NLP"}
    assert metrics["NLP"].Coverage_pct == 50 and metrics["NLP"].MAE_mg == 0
    funnel = spark.read.parquet(result.paths["eligibility"]).orderBy("step_order").collect()
    assert [r.step_order for r in funnel] == list(range(1, 14))
    agreement = spark.read.parquet(result.paths["agreement_table"])
    assert agreement.where("TP + FP + FN + TN = 181").count() == 3
