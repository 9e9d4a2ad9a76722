"""Texts and dates that must not end or blow up a job; plans that start none."""

import datetime as dt

from pyspark.sql import functions as F

from posolog.functions.taper import taper_schedule
from posolog.operators.evaluate import day_agreement
from posolog.operators.joins import overlap_join
from posolog.operators.parse import expand_tapers, taper_steps

D = dt.date
OPEN = D(9999, 12, 31)


def test_taper_that_no_calendar_holds_has_no_schedule(spark):
    texts = [
        ("start 3000000 mg then decrease by 0.001 mg every week",),
        ("start 3000000 mg then decrease by 1 mg every month",),
        ("start 40 mg then decrease by 10 mg every week",),
    ]
    got = spark.createDataFrame(texts, "sig string").select(taper_schedule(F.col("sig")).alias("s")).collect()
    assert got[0].s is None and got[1].s is None
    assert [(s.step, s.daily_dose_mg, s.step_start_day) for s in got[2].s] == [
        (1, 40.0, 0.0), (2, 30.0, 7.0), (3, 20.0, 14.0), (4, 10.0, 21.0)
    ]


def test_long_tapers_are_rows_not_arrays(spark):
    texts = [
        (1, "start 2000000 mg then decrease by 0.001 mg every 0 weeks"),
        (2, "start 3600 mg then decrease by 0.001 mg every day"),
        (3, "start 40 mg then decrease by 10 mg every week"),
        (4, "no schedule"),
        (5, None),
        (6, "40 mg daily for 2 weeks, then 20 mg daily for 2 weeks, then 5 mg daily x 7 days"),
    ]
    frame = spark.createDataFrame(texts, "id long, sig string")
    steps = taper_steps(frame)
    counts = {r.id: (r.n, r.d) for r in steps.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("step").alias("d")).collect()}
    assert counts == {2: (3_599_999, 3_599_999), 3: (4, 4), 6: (3, 3)}
    last = steps.where("id = 2").orderBy(F.desc("step")).first()
    assert (last.step, last.step_start_day, last.step_end_day) == (3_599_999, 3_599_998.0, 3_599_998.0)
    assert abs(last.daily_dose_mg - 0.002) < 1e-6
    rows = expand_tapers(frame.withColumns({"parsed_status": F.lit("taper"), **{c: F.lit(0.0) for c in ("daily_dose_mg", "freq_per_day", "duration_days")}}))
    assert rows.count() == 3_599_999 + 4 + 3 + 3
    kept = rows.where("parsed_status = 'taper'").collect()
    assert sorted(r.id for r in kept) == [1, 4, 5] and all(r.taper_step is None for r in kept)
    in_one = frame.where("id in (3, 6)").select("id", F.inline(taper_schedule(F.col("sig"))))
    assert sorted(map(tuple, in_one.collect())) == sorted(map(tuple, steps.where("id in (3, 6)").drop("sig").collect()))


def test_open_ended_intervals(spark):
    left = spark.createDataFrame(
        [(1, D(2020, 1, 1), OPEN), (1, D(2021, 1, 1), D(2021, 1, 5)), (2, D(2020, 1, 1), OPEN), (3, D(2019, 5, 1), OPEN)],
        "p long, a date, b date",
    )
    right = spark.createDataFrame(
        [(1, D(2019, 1, 1), OPEN), (1, D(2023, 6, 1), OPEN), (2, D(2010, 1, 1), D(2011, 1, 1)), (3, D(9999, 1, 1), OPEN)],
        "q long, c date, d date",
    )
    expected = sorted(
        (*x, *y) for x in map(tuple, left.collect()) for y in map(tuple, right.collect())
        if x[0] == y[0] and y[1] <= x[2] and y[2] >= x[1]
    )
    assert sorted(map(tuple, overlap_join(left, right, [("p", "q")], ("a", "b"), ("c", "d")).collect())) == expected


def test_first_gold_episode_gives_the_day_even_if_open_ended(spark):
    gold = spark.createDataFrame(
        [(1, D(2020, 1, 1), D(6020, 1, 10), 5.0), (1, D(2020, 1, 2), D(2020, 1, 10), 50.0)],
        "patient_id long, episode_start date, episode_end date, median_daily_dose double",
    ).where("episode_end < '2021-01-01' or episode_end > '6000-01-01'")
    computed = spark.createDataFrame(
        [(1, "prednisone", D(2020, 1, 2), D(2020, 1, 3), 5.0)],
        "person_id long, drug_name_std string, episode_start date, episode_end date, median_daily_dose double",
    )
    row = day_agreement(computed, gold, threshold_mg=1.0).collect()[0].asDict()
    assert row["TP"] == 2, row
