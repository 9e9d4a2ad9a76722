"""The dose methods on single rows."""

import pytest
from pyspark.sql import functions as F

from posolog.operators.dose import (
    calc_daily_dose_baseline,
    calc_daily_dose_nlp,
    calc_daily_dose_nlp_advanced,
)

SCHEMA = {
    "person_id": "long", "drug_source_value": "string", "drug_concept_name": "string",
    "route_concept_name": "string", "amount_value": "double", "amount_unit_concept_id": "int",
    "quantity": "double", "days_supply": "double", "tablets": "double", "freq_per_day": "double",
    "sig": "string", "drug_exposure_start_date": "string", "drug_exposure_end_date": "string",
    "daily_dose": "double", "daily_dose_mg": "double",
}


@pytest.fixture(scope="module")
def table(spark):
    def make(*records, **common):
        base = {"person_id": 1, "drug_source_value": "PREDNISONE 5 MG TABLET",
                "route_concept_name": "Oral", "amount_value": 5.0, "quantity": 90.0,
                "days_supply": 90.0, "drug_exposure_start_date": "2023-01-01",
                "drug_exposure_end_date": "2023-03-31", **common}
        full = [{**base, **r} for r in (records or [{}])]
        names = [c for c in SCHEMA if any(c in r for r in full)]
        schema = ", ".join(f"{c} {SCHEMA[c]}" for c in names)
        return spark.createDataFrame([tuple(r.get(c) for c in names) for r in full], schema)

    return make


def _one(df):
    row = df.first()
    return row.daily_dose_mg_imputed, row.imputation_method


@pytest.mark.parametrize(
    "row, dose, method",
    [
        ({"daily_dose": 10.0}, 10, "original"),
        ({"tablets": 2.0, "freq_per_day": 1.0, "daily_dose": None}, 10, "tablets_freq"),
        ({"tablets": 3.0, "freq_per_day": 2.0, "amount_value": 4.0}, 24, "tablets_freq"),
        ({"quantity": 30.0, "days_supply": None, "drug_exposure_end_date": "2023-01-30"}, 5,
         "actual_duration"),
        ({"quantity": None, "days_supply": None, "amount_value": None}, None, "missing"),
        ({"quantity": 30.0, "days_supply": None, "drug_exposure_start_date": "2023-06-30",
          "drug_exposure_end_date": "2023-06-01"}, None, "missing"),
        ({"daily_dose_mg": 20.0}, 20, "original"),
        ({"daily_dose": 10.0, "daily_dose_mg": 99.0}, 10, "original"),
        ({"daily_dose": -1.0}, 5, "actual_duration"),
        ({"amount_value": None, "drug_source_value": "PREDNISONE 10 MG TABLET"}, 10,
         "actual_duration"),
        ({"amount_unit_concept_id": 9655, "drug_source_value": "PREDNISONE 2 MG"}, 2,
         "actual_duration"),
        ({"amount_unit_concept_id": 0}, 5, "actual_duration"),
        ({"quantity": 90000.0}, None, "missing"),
        ({"sig": "Take 2 tablets daily", "quantity": None}, 10, "tablets_freq"),
        ({"sig": "Take 2 tablets (10 mg total) daily", "quantity": None, "tablets": None,
          "freq_per_day": None, "daily_dose": None}, 10, "tablets_freq"),
        # without a source dose, a dose read from the text counts as the original one
        ({"sig": "Take 2 tablets (40 mg total) daily"}, 40, "original"),
    ],
)
def test_baseline(table, row, dose, method):
    assert _one(calc_daily_dose_baseline(table(row))) == (dose, method)


def test_baseline_methods_and_order(table):
    row = {"tablets": 2.0, "freq_per_day": 1.0}
    assert _one(calc_daily_dose_baseline(table(row), methods=["supply_based", "tablets_freq"])) == (
        5, "supply_based")
    row = {"quantity": 30.0, "amount_value": 10.0, "drug_exposure_end_date": "2023-01-30"}
    for order in (["supply_based", "actual_duration"], ["actual_duration", "supply_based"]):
        assert _one(calc_daily_dose_baseline(table(row), methods=order))[1] == order[0]
    assert _one(calc_daily_dose_baseline(table(row), methods=["supply_based"]))[1] == "supply_based"


def test_baseline_options(table):
    row = {"sig": "Take 2 tablets (40 mg total) daily"}
    assert _one(calc_daily_dose_baseline(table(row), strict_original=True)) == (10, "tablets_freq")
    assert _one(calc_daily_dose_baseline(table(row), m2_sig_parse="none"))[1] == "actual_duration"
    assert _one(calc_daily_dose_baseline(table({"quantity": 90000.0}), max_daily_dose_mg=None))[0] == 5000
    with pytest.raises(ValueError):
        calc_daily_dose_baseline(table(), m2_sig_parse="maybe")


def test_given_tablets_switch_the_parse_off_for_the_whole_table(table):
    df = table({"person_id": 1, "tablets": 2.0, "freq_per_day": 1.0, "sig": "x"},
               {"person_id": 2, "sig": "Take 3 tablets daily", "quantity": None})
    got = {r.person_id: r.imputation_method for r in calc_daily_dose_baseline(df).collect()}
    assert got == {1: "tablets_freq", 2: "missing"}


def test_absent_end_date_uses_the_as_of_day(table):
    df = table().drop("drug_exposure_end_date")
    assert _one(calc_daily_dose_baseline(df, as_of="2023-01-30"))[0] == 15


def test_filters(table):
    df = table({"person_id": 1}, {"person_id": 2, "route_concept_name": "Inhalation"},
               {"person_id": 3, "drug_source_value": "budesonide 3 mg oral capsule"},
               {"person_id": 4, "drug_source_value": "levetiracetam 500 mg tablet"})
    assert [r.person_id for r in calc_daily_dose_baseline(df).collect()] == [1]
    kept = calc_daily_dose_baseline(df, filter_oral=False)
    assert sorted(r.person_id for r in kept.collect()) == [1, 2]
    no_route = calc_daily_dose_baseline(
        df.withColumnRenamed("drug_source_value", "drug_concept_name").drop("route_concept_name")
    )
    assert no_route.count() == 2


def _nlp(table, row, fn=calc_daily_dose_nlp, **options):
    row = {"drug_concept_name": "prednisone 5 MG oral tablet", **row}
    out = fn(table(row), **options).first()
    return out.daily_dose_mg, out.parsed_status


@pytest.mark.parametrize(
    "row, dose, status",
    [
        ({"sig": "Take 2 tablets (10 mg total) daily."}, 10, "ok"),
        ({"sig": None, "quantity": 28.0, "drug_exposure_end_date": "2023-01-28"}, 5,
         "fallback_actual_duration"),
        ({"sig": None, "drug_exposure_end_date": None}, 5, "fallback_supply_based"),
        ({"sig": None, "daily_dose": 7.0}, 7, "fallback_original"),
        ({"sig": "Take 2 tablets daily"}, 10, "ok"),
        ({"sig": "Take 2 tablets daily", "amount_value": None}, 10, "ok"),
        # the text's strength fallback does not look at the unit
        ({"sig": "Take 1 tablet daily", "amount_value": 9.0, "amount_unit_concept_id": 9655}, 9, "ok"),
        ({"sig": "Use as directed."}, None, "free_text"),
        ({"sig": "Take 3000 mg daily"}, None, "implausible"),
        ({"sig": "whatever", "quantity": None}, None, "no_parse"),
        ({"sig": None, "quantity": 900000.0}, None, "no_parse"),
    ],
)
def test_nlp(table, row, dose, status):
    assert _nlp(table, row) == (dose, status)


def test_nlp_legacy_carry(table):
    row = {"sig": "Use as directed.", "drug_concept_name": "prednisone"}
    df = table(row).withColumn("daily_dose_mg_orig", F.lit("12.5"))
    assert calc_daily_dose_nlp(df, baseline_fallback=True).first().daily_dose_mg == 12.5
    assert calc_daily_dose_nlp(df).first().daily_dose_mg is None


def test_nlp_without_text_column(table):
    df = table({"drug_concept_name": "prednisone"})
    assert calc_daily_dose_nlp(df).first().parsed_status == "fallback_actual_duration"


def test_advanced(table):
    adv = calc_daily_dose_nlp_advanced
    assert _nlp(table, {"sig": "Take half tablet (10 mg) daily"}, adv) == (5, "ok")
    assert _nlp(table, {"sig": "Take 3000 mg daily"}, adv) == (None, "implausible")
    taper = {"sig": "3000 mg daily for 2 weeks, then 40 mg daily for 2 weeks",
             "drug_concept_name": "prednisone"}
    # the cap acts before the expansion and turns the row into an implausible one
    assert [r.parsed_status for r in adv(table(taper)).collect()] == ["implausible"]
    taper["sig"] = "60 mg daily for 2 weeks, then 3000 mg daily for 2 weeks"
    steps = {(r.taper_step, r.daily_dose_mg, r.parsed_status) for r in adv(table(taper)).collect()}
    assert steps == {(1, 60.0, "taper_ok"), (2, 3000.0, "taper_ok")}
    assert adv(table(taper), expand_tapers=False).count() == 1


def test_one_reading_for_both_text_methods(spark):
    """``parse_both`` holds what the two parses give, and the methods take it over."""
    from posolog.operators.dose import calc_daily_dose_nlp, calc_daily_dose_nlp_advanced
    from posolog.operators.parse import parse_both, parse_sig, take_reading, without_readings
    from posolog.plans.test_tables import SIG_TEMPLATES

    texts = [t and t.format(t=2, m=10, u=20, v=40) for t in SIG_TEMPLATES] + ["two and a half tablets (5 mg) bid", "½ tab 10 mg daily", ""]
    frame = spark.createDataFrame(
        [(i, t, "prednisone 5 MG oral tablet", "Oral", 7.0) for i, t in enumerate(texts)],
        "person_id long, sig string, drug_concept_name string, route_concept_name string, daily_dose_mg double",
    ).selectExpr("*", "DATE'2020-01-01' AS drug_exposure_start_date", "DATE'2020-01-10' AS drug_exposure_end_date")
    read = parse_both(frame)
    assert without_readings(read).columns == frame.columns
    rows = lambda df: sorted(map(str, (r.asDict() for r in df.collect())))
    for advanced, method in ((False, calc_daily_dose_nlp), (True, calc_daily_dose_nlp_advanced)):
        assert rows(take_reading(read, "sig", advanced)) == rows(parse_sig(frame, "sig", advanced=advanced))
        taken, parsed = method(read), method(frame)
        assert taken.columns == parsed.columns
        assert rows(taken) == rows(parsed)
