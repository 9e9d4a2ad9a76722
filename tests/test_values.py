"""Names, routes, numbers, dates, buckets, conversion."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from posolog.functions import fixed_values as V
from posolog.functions.values import bucket, day, number, overlap_days, positive_days
from posolog.operators.convert import convert_pred_equiv
from posolog.operators.filters import with_drug_name, with_route_class
from posolog.schema import capabilities, conform, require_columns

NAMES = {
    "PREDNISONE 5 MG": "prednisone",
    "Prednisone Oral Tablet 10mg": "prednisone",
    "Rayos 5": "prednisone",
    "methylprednisolone 4mg": "methylprednisolone",
    "Medrol 8 MG": "methylprednisolone",
    "Solu-Medrol": "methylprednisolone",
    "methyl prednisolone": "methylprednisolone",
    "prednisolone 5 mg": "prednisolone",
    "dexamethasone 4mg oral": "dexamethasone",
    "Decadron": "dexamethasone",
    "Cortef": "hydrocortisone",
    "KENALOG-40": "triamcinolone",
    "Entocort EC": "budesonide",
    "  Vitamin   D ": "vitamin d",
    None: None,
}
ROUTES = [
    ("Oral", None, None, "oral"),
    (None, "tablet", None, "oral"),
    ("Inhalation", None, None, "inhaled"),
    ("Intramuscular", None, None, "injection"),
    (None, "IV", None, "injection"),
    (None, None, "methylpred 500mg solution", "other"),
    (None, None, "solu-medrol 500mg vial", "injection"),
    (None, None, "methylpred solution for injection", "injection"),
    (None, None, "methylpred inj 125mg", "injection"),
    (None, None, "prednisolone oral solution 5mg/5ml", "oral"),
    (None, None, "prednisone 5mg oral tab", "oral"),
    ("Intravenous", None, None, "injection"),
    ("Intrathecal", None, None, "injection"),
    (None, None, "fluticasone 100mcg diskus", "inhaled"),
    (None, None, "budesonide 200mcg turbuhaler", "inhaled"),
    (None, None, "budesonide 90mcg flexhaler", "inhaled"),
    (None, None, "fluticasone furoate 100mcg ellipta", "inhaled"),
    (None, None, "budesonide 90mcg/act inh", "inhaled"),
    (None, None, "beclomethasone 40mcg mdi", "inhaled"),
    ("Ophthalmic", None, None, "ophthalmic"),
    ("Topical cream", None, None, "topical"),
    ("", "tablet", "oral", "other"),
    (None, None, None, "other"),
]


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "drug_concept_name string")
    got = {r.drug_concept_name: r.drug_name_std for r in with_drug_name(df).collect()}
    assert got == NAMES


def test_name_overrides_win_and_last_rule_wins(spark):
    df = spark.createDataFrame([("Prednisone X",), ("LODOTRA 5",)], "drug_concept_name string")
    rules = [("pred", "first"), ("PREDNISONE", "second"), ("lodotra", "prednisone")]
    got = {r.drug_concept_name: r.drug_name_std for r in with_drug_name(df, None, rules).collect()}
    assert got == {"Prednisone X": "second", "LODOTRA 5": "prednisone"}


def test_routes(spark):
    df = spark.createDataFrame(
        [(i, *r[:3]) for i, r in enumerate(ROUTES)],
        "id int, route_concept_name string, route_source_value string, drug_source_value string",
    )
    got = {r.id: r.route_class for r in with_route_class(df).collect()}
    assert [got[i] for i in range(len(ROUTES))] == [r[3] for r in ROUTES]


def test_numbers(spark):
    df = spark.createDataFrame(
        [("5",), (" 2.5 ",), ("1e3",), ("5d",), ("NaN",), ("text",), ("",), (None,)], "x string"
    )
    got = [r[0] for r in df.select(number(df, "x")).collect()]
    assert got == [5.0, 2.5, 1000.0, None, None, None, None, None]
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r[0] for r in nan.select(number(nan, "x")).collect()] == [None, 1.0]


def test_dates(spark):
    texts = ["2023-06-01", "06/01/2023", "6/1/2023", "20230601", "2023/6/1", "not-a-date", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    june = dt.date(2023, 6, 1)
    assert [r[0] for r in df.select(day(df, "x")).collect()] == [june] * 5 + [None, None]


def test_day_counts(spark):
    d = "DATE'2023-01-01'"
    row = spark.range(1).select(
        positive_days(F.expr(d), F.expr("DATE'2023-01-31'")).alias("month"),
        positive_days(F.expr(d), F.expr("DATE'2022-12-01'")).alias("reversed"),
        overlap_days(F.expr(d), F.lit(None).cast("date"), F.expr(d), F.expr(d)).alias("open"),
        overlap_days(F.expr(d), F.expr(d), F.expr("DATE'2023-02-01'"), F.expr("DATE'2023-02-02'")).alias("apart"),
    ).first()
    assert (row.month, row.reversed, row.open, row.apart) == (31.0, None, None, 0)


def test_buckets_are_right_closed(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 10.0, 10.1, 20.0, 40.0, 41.0)], "x double")
    got = [r[0] for r in df.select(bucket(F.col("x"), V.DOSE_BREAKS, V.DOSE_LABELS)).collect()]
    low, medium, high, very = V.DOSE_LABELS
    assert got == [None, low, low, medium, medium, high, very]
    with pytest.raises(ValueError):
        bucket(F.col("x"), [0, 1], ["a", "b"])


def test_conversion(spark, rows):
    data = [("prednisone", 10.0), ("methylprednisolone", 8.0), ("dexamethasone", 4.0),
            ("hydrocortisone", 20.0), ("prednisolone", 7.5), ("budesonide", 3.0),
            ("hydroxychloroquine", 400.0), ("PREDNISONE 5 MG TABLET", 10.0)]
    out = convert_pred_equiv(spark.createDataFrame(data, "drug_name_std string, daily_dose_mg double"))
    got = {r["drug_name_std"]: (r["pred_equiv_mg"], r["pred_equiv_status"]) for r in rows(out)}
    assert got == {
        "prednisone": (10.0, "ok"), "methylprednisolone": (10.0, "ok"),
        "dexamethasone": (30.0, "ok"), "hydrocortisone": (5.0, "ok"),
        "prednisolone": (7.5, "ok"), "budesonide": (None, "missing_factor"),
        "hydroxychloroquine": (None, "unknown_drug"), "PREDNISONE 5 MG TABLET": (10.0, "ok"),
    }


def test_conversion_with_own_table_and_name_fallback(spark):
    df = spark.createDataFrame([("prednisone", 5.0)], "dmard_name string, daily_dose_mg double")
    assert convert_pred_equiv(df).first().pred_equiv_mg == 5.0
    table = spark.createDataFrame([("prednisone", 2.0)], "drug_name_std string, equiv_factor double")
    assert convert_pred_equiv(df, equiv_table=table).first().pred_equiv_mg == 10.0
    with pytest.raises(ValueError, match="not found"):
        convert_pred_equiv(df.drop("dmard_name"))


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, "x")], "person_id long, sig string")
    caps = capabilities(df)
    assert caps["has_sig"] and not caps["has_route"] and not caps["has_quantity"]
    full = conform(df)
    assert {"quantity", "drug_exposure_end_date", "route_source_value"} <= set(full.columns)
    require_columns(df, ["sig"])
    with pytest.raises(ValueError, match="table.*missing.*quantity"):
        require_columns(df, ["sig", "quantity"], "table")
