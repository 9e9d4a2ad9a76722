"""Prescription texts: literal cases for the parser and for tapers."""

import pytest
from pyspark.sql import functions as F

from posolog.functions import fixed_values as V
from posolog.functions.taper import taper_plan
from posolog.functions.values import squish
from posolog.operators.dose import dose_side_by_side
from posolog.operators.parse import (
    add_taper_schedule,
    expand_tapers,
    parse_sig,
    parse_sig_advanced,
)

# text, expected fields
BASIC = [
    ("Take 2 tablets (10 mg total) daily.", {"daily_dose_mg": 10, "mg_total_flag": True}),
    ("Take 4 tablets (20 mg per dose) by mouth daily.", {"mg_per_admin": 20, "daily_dose_mg": 20}),
    ("Take 1 tablet (5 mg per dose) BID.", {"freq_per_day": 2, "daily_dose_mg": 10}),
    ("Take 1 tablet (10 mg) three times daily.", {"freq_per_day": 3, "daily_dose_mg": 30}),
    ("Take 1 tablet (10 mg) four times daily.", {"freq_per_day": 4, "daily_dose_mg": 40}),
    ("Take 2 tablets (10 mg per dose) every other day.",
     {"freq_per_day": 0.5, "daily_dose_mg": 5, "parsed_status": "taper"}),
    ("Take 1 tablet (8 mg) every 12 hours.", {"freq_per_day": 2, "daily_dose_mg": 16}),
    ("Take 1 tablet (5 mg) daily for 14 days.", {"duration_days": 14}),
    ("Take 1 tablet (5 mg) daily for 2 weeks.", {"duration_days": 14}),
    ("Take 1 tablet (5 mg) daily for 3 months.", {"duration_days": 90}),
    ("Take 1 tablet (5 mg) daily x 2 wks", {"duration_days": 14}),
    ("Taper by 1 mg every 4 weeks to stop.", {"taper_flag": True, "parsed_status": "taper"}),
    ("Use as directed.",
     {"free_text_flag": True, "parsed_status": "free_text", "daily_dose_mg": None}),
    ("Take 1 tablet as needed for pain.", {"prn_flag": True, "parsed_status": "prn"}),
    ("Take 1 tab 4 mg qd.", {"daily_dose_mg": 4}),
    (None, {"parsed_status": "empty", "daily_dose_mg": None, "freq_per_day": None,
            "tablets": None, "taper_flag": False}),
    ("", {"parsed_status": "empty"}),
    (" \t\n", {"parsed_status": "empty"}),
    ("    Once Oral", {"freq_per_day": 1, "tablets": 1}),
    ("    Every evening Oral", {"freq_per_day": 1, "tablets": 1}),
    ("    Nightly Oral", {"freq_per_day": 1, "tablets": 1}),
    ("5 mg daily", {"tablets": 1, "freq_per_day": 1, "daily_dose_mg": 5}),
    ("3 tabs in am for 5 days.", {"freq_per_day": 1, "tablets": 3, "duration_days": 5}),
    ("Take 1 tablet (1 mg per dose) by mouth once for 1 dose.",
     {"freq_per_day": 1, "mg_per_admin": 1}),
    ("Take 1 tablet (10 mg per dose) by mouth every 12 (twelve) hours for 14 days.",
     {"freq_per_day": 2, "mg_per_admin": 10, "daily_dose_mg": 20}),
    ("10 mg.", {"freq_per_day": 1}),
    ("Take 40 mg by mouth.", {"freq_per_day": 1, "daily_dose_mg": 40}),
    ("Take 40 mg by mouth before surgery.", {"freq_per_day": None, "daily_dose_mg": None}),
    ("TOME CUATRO TABLETAS POR VIA ORAL A DIARIO", {"freq_per_day": 1, "tablets": 4}),
    ("Take 1 tablet (10 mg) every 5 hours.", {"freq_per_day": 24 / 5, "daily_dose_mg": 48}),
    ("Take 1 tablet (5 mg) every 4 hours.", {"freq_per_day": 6, "daily_dose_mg": 30}),
    ("Take 10 mg q5h.", {"freq_per_day": 24 / 5}),
    ("Take 1 tab (4 mg) 5 times a day.", {"freq_per_day": 5, "daily_dose_mg": 20}),
    ("Take 1 tab (5 mg) 6 times daily.", {"freq_per_day": 6, "daily_dose_mg": 30}),
    ("Take 2 tablets (20 mg per dose) every 10 days.", {"freq_per_day": 1 / 10}),
    ("Take 1 tab (5 mg) every 5 days.", {"freq_per_day": 1 / 5}),
    ("Take 10 mg q3d.", {"freq_per_day": 1 / 3}),
    ("Take 1 tab (5 mg) 4 times a week.", {"freq_per_day": 4 / 7}),
    ("Take 1 tab (10 mg) 5 times per week.", {"freq_per_day": 5 / 7}),
    ("Take 1 tab twice weekly", {"freq_per_day": 2 / 7}),
    ("Take 4 tablets (20 mg per dose) every 2 weeks.", {"freq_per_day": 1 / 14}),
    ("Take 1 tab (10 mg) every 3 weeks.", {"freq_per_day": 1 / 21}),
    ("Take 1 tab once weekly", {"freq_per_day": 1 / 7}),
    ("Take 1 tab once a month", {"freq_per_day": 1 / 30}),
    ("Take 2 tablets 60 mg/day.",
     {"daily_dose_mg": 60, "mg_total_flag": True, "mg_per_admin": None}),
    ("Take 2 tablets 60 mg per day.", {"daily_dose_mg": 60}),
    ("60 mg a day by mouth.", {"daily_dose_mg": 60}),
    ("Take 2 tabs 10 mg daily.", {"daily_dose_mg": 20}),
    ("Take six tablets (5 mg) daily.", {"tablets": 6}),
    ("Take 1 tab (1 mg) seven times a day.", {"freq_per_day": 7}),
    ("Take eight tablets (5 mg) daily.", {"tablets": 8}),
    ("Take 1 tablet TID", {"freq_per_day": 3}),
    ("Take 1 tablet QID", {"freq_per_day": 4}),
    # zero counts fall through to a later rule
    ("every 0 hours daily", {"freq_per_day": 1}),
    ("0 times a day, nightly", {"freq_per_day": 1}),
    # white space of any kind, and letters outside ASCII at a word's edge
    ("Take 2  tablets\tdaily", {"tablets": 2, "freq_per_day": 1}),
    ("10 mg poço", {"freq_per_day": None}),
    ("1/2 tablet daily", {"tablets": 2}),
    ("Take one pill (12.5 mg) daily, before meals", {"daily_dose_mg": 12.5}),
]
ADVANCED = [
    ("Take one tablet daily", {"tablets": 1, "freq_per_day": 1}),
    ("Take half a tablet (5 mg) once weekly", {"tablets": 1, "freq_per_day": 1 / 7}),
    ("Take half tablet (5 mg) daily", {"tablets": 0.5, "daily_dose_mg": 2.5}),
    ("1/2 tab daily", {"tablets": 0.5}),
    ("½ tab daily", {"tablets": 0.5}),
    ("1 and a half tablets daily", {"tablets": 1.5}),
    ("two and half tablets daily", {"tablets": 2.5}),
    ("a and a half tabs daily", {"tablets": 1.5}),
    ("Take 2 tabs every 3 days", {"tablets": 2, "freq_per_day": 1 / 3}),
    ("take daily", {"tablets": 1}),
]


def _check(spark, cases, parse):
    data = [(i, text) for i, (text, _) in enumerate(cases)]
    got = {
        r["id"]: r
        for r in parse(spark.createDataFrame(data, "id int, sig string")).collect()
    }
    assert len(got) == len(cases)
    wrong = []
    for i, (text, expected) in enumerate(cases):
        for field, value in expected.items():
            found = got[i][field]
            same = found == pytest.approx(value) if isinstance(value, (int, float)) and not isinstance(
                value, bool) and found is not None else found == value
            if not same:
                wrong.append((text, field, value, found))
    assert not wrong


def test_basic_cases(spark):
    _check(spark, BASIC, parse_sig)


def test_dictionary_gives_the_same(spark):
    _check(spark, BASIC, lambda df: parse_sig(df, dictionary=True))


def test_advanced_cases(spark):
    _check(spark, ADVANCED, parse_sig_advanced)


def test_parse_keeps_rows_and_replaces_old_fields(spark):
    df = spark.createDataFrame([(1, "Take 2 tabs BID", 9.0), (2, None, 9.0)],
                               "person_id int, sig string, tablets double")
    out = parse_sig(df)
    assert out.columns.count("tablets") == 1
    assert sorted((r.person_id, r.tablets) for r in out.collect()) == [(1, 2.0), (2, None)]


def test_missing_text_column_is_an_error(spark):
    with pytest.raises(ValueError, match="sig"):
        parse_sig(spark.range(1))


TAPERS = [
    ("60 mg daily for 2 weeks, then 40 mg daily for 2 weeks, then 20 mg daily for 2 weeks",
     [(60, 14, 0, 13), (40, 14, 14, 27), (20, 14, 28, 41)]),
    ("40 mg daily x 4 weeks then 20 mg daily x 4 weeks", [(40, 28, 0, 27), (20, 28, 28, 55)]),
    ("start 60 mg then decrease by 10 mg every week",
     [(60 - 10 * i, 7, 7 * i, 7 * i + 6) for i in range(6)]),
    ("60 mg daily then drop dose by 20 mg every 2 weeks",
     [(60, 14, 0, 13), (40, 14, 14, 27), (20, 14, 28, 41)]),
    ("40 mg for 3 days; 20 mg for 3 days; stop", [(40, 3, 0, 2), (20, 3, 3, 5)]),
    ("40 mg for 1 month, 20 mg for 1 month", [(40, 30, 0, 29), (20, 30, 30, 59)]),
    ("Take 5 mg per dose twice daily for 2 days then 5 mg daily for 2 days",
     [(10, 2, 0, 1), (5, 2, 2, 3)]),
    ("Take 1 tablet daily", None),
    ("Taper by 5 mg every 4 weeks to stop.", None),
    ("start 10 mg then decrease by 20 mg every week", None),
    (None, None),
]


def test_taper_schedules(spark):
    data = [(i, text) for i, (text, _) in enumerate(TAPERS)]
    out = add_taper_schedule(spark.createDataFrame(data, "id int, sig string"))
    got = {r.id: r.taper_schedule for r in out.collect()}
    for i, (text, expected) in enumerate(TAPERS):
        steps = got[i] and [
            (s.daily_dose_mg, s.duration_days, s.step_start_day, s.step_end_day) for s in got[i]
        ]
        assert steps == expected, text
        if expected:
            assert [s.step for s in got[i]] == list(range(1, len(expected) + 1))


def test_expansion_keeps_other_rows(spark):
    data = [(1, TAPERS[0][0]), (2, "Taper by 5 mg every 4 weeks to stop."), (3, "5 mg daily")]
    out = expand_tapers(parse_sig_advanced(spark.createDataFrame(data, "id int, sig string")))
    counts = {r["id"]: r["count"] for r in out.groupBy("id").count().collect()}
    assert counts == {1: 3, 2: 1, 3: 1}
    status = {(r.id, r.parsed_status, r.taper_step) for r in out.collect()}
    assert status == {(1, "taper_ok", 1), (1, "taper_ok", 2), (1, "taper_ok", 3),
                      (2, "taper", None), (3, "ok", None)}


def test_filter_does_not_repeat_the_parse(spark):
    df = spark.createDataFrame([("5 mg daily",)], "sig string").repartition(2)
    plan = parse_sig(df).where(F.col("daily_dose_mg") > 3)._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("every\\s*(\\d+(?:\\.\\d+)?)\\s*weeks?") == 1


def test_white_space_is_squished_alike_with_and_without_other_letters(spark):
    texts = ["a  b", " a b ", "a\tb", "a\x0b\x0cb\r\nc", "a b", "é  b", "a\x1cb", "", "  ", "é b", "plain text"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(squish(F.col("t"))).collect()]
    want = [r[0] for r in rows.select(F.trim(F.regexp_replace("t", r"(?U)\s{2,}|[\s&&[^ ]]", " "))).collect()]
    assert got == want


def test_spelled_out_steps_are_planned_without_nesting(spark):
    """The steps' expression stood inside its own lambda and was read anew for each step."""
    rows = spark.createDataFrame([("40 mg daily for 2 weeks, then 20 mg bid per dose x 3 days; 5 mg for 1.5 months",)], "sig string")
    plan = taper_plan(F.col("sig"))
    (r,) = rows.select(plan.alias("p")).collect()
    assert [(s.dose, s.freq, s.days, s.before) for s in r.p.steps] == [
        (40.0, 1.0, 14.0, 0.0), (40.0, 2.0, 3.0, 14.0), (5.0, 1.0, 45.0, 17.0)]
    text = rows.select(plan.alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("[^.!?;]{0,50}") == 1


def test_texts_are_read_once_for_the_stacked_methods(spark):
    rows = spark.createDataFrame(
        [(1, "prednisone 5 MG oral tablet", "oral", "take 2 tablets (5 mg) daily", None)],
        "person_id long, drug_concept_name string, route_concept_name string, sig string, quantity double",
    ).withColumn("drug_exposure_start_date", F.lit("2020-01-01").cast("date"))
    rows = rows.withColumn("drug_exposure_end_date", F.lit("2020-01-10").cast("date"))
    out = dose_side_by_side(rows)
    assert {(r.method, r.dose_mg) for r in out.collect()} == {("Baseline", 10.0), ("NLP", 10.0), ("Advanced NLP", 10.0)}
    assert V.MG_TOTAL not in out._jdf.queryExecution().optimizedPlan().toString()


def test_generated_methods_stay_within_what_the_jvm_compiles(spark, tmp_path):
    """HotSpot interprets methods beyond 8000 bytes; rows then take several times as long."""
    from datetime import date

    from posolog.operators.dose import calc_daily_dose_nlp
    from posolog.plans import test_tables as tables

    lines = [(k, k % 7, k % 5, 1 + k % 3, 10.0 + k, date(2020, 1, 1)) for k in range(60)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate date"
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, k % 13) for k in range(60)], "o_orderkey long, o_custkey long").write.parquet(
        str(tmp_path / "orders.parquet")
    )
    rows = tables.exposures(spark, str(tmp_path), True)
    plain = tables._sql(spark, str(tmp_path), tables.exposure_sql(f", {tables.DAILY_DOSE} AS daily_dose"))
    assert rows.schema == plain.schema
    assert sorted(map(str, rows.collect())) == sorted(map(str, plain.collect()))

    compiler = getattr(
        getattr(spark._jvm.org.apache.spark.sql.catalyst.expressions.codegen, "CodeGenerator$"), "MODULE$"
    )

    def sizes(plan):
        own = []
        if plan.getClass().getSimpleName() == "WholeStageCodegenExec":
            own = [compiler.compile(plan.doCodeGen()._2())._2().maxMethodCodeSize()]
        children = plan.children()
        return own + [s for i in range(children.size()) for s in sizes(children.apply(i))]

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (rows.select("*"), calc_daily_dose_nlp(rows)):
            assert 0 < max(sizes(df._jdf.queryExecution().executedPlan())) <= 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_first_number(spark):
    from posolog.functions.values import first_number

    texts = ["", None, "no", "0 mg", "2.5 mg, 10 mg", "x 007"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.select("i", first_number(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [None, None, None, 0.0, 2.5, 7.0]
