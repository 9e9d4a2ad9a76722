"""Episodes: literal cases, invariants, and a brute-force comparison."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from posolog.operators.episodes import build_episodes

D = dt.date
SCHEMA = ("person_id long, drug_name_std string, drug_exposure_start_date date, "
          "drug_exposure_end_date date, daily_dose_mg_imputed double")
END = "drug_exposure_end_date"


def _make(spark, *records):
    return spark.createDataFrame([(p, d, s, e, x) for p, d, s, e, x in records], SCHEMA)


def test_merge_split_overlap(spark, rows):
    p = "prednisone"
    df = _make(
        spark,
        (1, p, D(2023, 1, 1), D(2023, 2, 1), 20.0), (1, p, D(2023, 2, 10), D(2023, 3, 31), 10.0),
        (2, p, D(2023, 1, 1), D(2023, 3, 31), 10.0), (2, p, D(2023, 9, 1), D(2023, 11, 30), 5.0),
        (3, p, D(2023, 1, 1), D(2023, 4, 30), 20.0), (3, p, D(2023, 2, 1), D(2023, 3, 31), None),
        (None, p, D(2023, 1, 1), None, 1.0), (4, p, None, None, 1.0),
        (5, None, D(2023, 6, 30), D(2023, 6, 1), 1.0),
    )
    out = rows(build_episodes(df, end_col=END), "person_id", "episode_start")
    short = [(r["person_id"], r["episode_id"], r["episode_start"], r["episode_end"],
              r["n_records"], r["median_daily_dose"]) for r in out]
    assert short == [
        (1, 1, D(2023, 1, 1), D(2023, 3, 31), 2, 15.0),
        (2, 1, D(2023, 1, 1), D(2023, 3, 31), 1, 10.0),
        (2, 2, D(2023, 9, 1), D(2023, 11, 30), 1, 5.0),
        (3, 1, D(2023, 1, 1), D(2023, 4, 30), 2, 20.0),
        (5, 1, D(2023, 6, 30), D(2023, 6, 30), 1, 1.0),
    ]
    assert out[0]["n_days"] == 90
    assert out[0]["mean_daily_dose"] == pytest.approx((20 * 32 + 10 * 50) / 82)


def test_gap_is_inclusive_and_not_negative(spark):
    df = _make(spark, (1, "p", D(2023, 1, 1), D(2023, 1, 10), 1.0),
               (1, "p", D(2023, 2, 9), D(2023, 2, 10), 1.0))
    assert build_episodes(df, end_col=END, gap_days=30).count() == 1
    assert build_episodes(df, end_col=END, gap_days=29).count() == 2
    with pytest.raises(ValueError):
        build_episodes(df, gap_days=-1)


def _brute(records, gap):
    groups = {}
    for p, d, s, e, x in records:
        groups.setdefault((p, d), []).append((s, max(s, e), x))
    out = []
    for (p, d), items in groups.items():
        items.sort(key=lambda i: i[:2])
        current, last = [], None
        for item in items:
            if last is not None and (item[0] - last).days > gap:
                out.append((p, d, current))
                current, last = [], None
            current.append(item)
            last = item[1] if last is None else max(last, item[1])
        out.append((p, d, current))
    return sorted(
        (p, d, min(i[0] for i in c), max(i[1] for i in c), len(c),
         statistics.median(i[2] for i in c))
        for p, d, c in out
    )


@pytest.mark.parametrize("gap", [0, 30])
def test_brute_force_with_a_dominating_person(spark, gap):
    rng = random.Random(gap)
    records = []
    for _ in range(1500):
        person = 0 if rng.random() < 0.4 else rng.randint(1, 20)
        start = D(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 1500))
        end = start + dt.timedelta(days=rng.randint(-5, 20))
        records.append((person, rng.choice("ab"), start, end, float(rng.randint(1, 9))))
    df = _make(spark, *records)
    got = build_episodes(df.repartition(7), end_col=END, gap_days=gap)
    short = got.select("person_id", "drug_name_std", "episode_start", "episode_end", "n_records",
                       "median_daily_dose")
    assert sorted(tuple(r) for r in short.collect()) == _brute(records, gap)
    wide = build_episodes(df, end_col=END, gap_days=gap + 60)
    assert wide.count() <= got.count()
    assert got.agg(F.sum("n_records")).first()[0] == len(records)


def test_windows_share_one_exchange(spark):
    df = _make(spark, (1, "p", D(2023, 1, 1), D(2023, 1, 10), 1.0))
    plan = build_episodes(df, end_col=END)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # counted rows, then (person, drug)


def test_medians_need_no_aggregate_that_falls_back_to_sorting(spark):
    p, day = "p", [D(2023, 1, n) for n in range(1, 8)]
    df = _make(
        spark,
        *[(1, p, day[0], None, x) for x in (4.0, 1.0, 1.0, 10.0)], (1, p, day[3], None, None),
        *[(2, p, day[n], None, x) for n, x in enumerate((7.0, 3.0, 3.0, 8.0, 9.0))],
        (3, p, day[0], None, None), (4, p, day[0], None, float("inf")), (4, p, day[1], None, float("inf")),
    )
    out = build_episodes(df, end_col=END)
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.person_id: (r.median_daily_dose, r.n_records) for r in out.collect()}
    assert got == {1: (2.5, 5), 2: (7.0, 5), 3: (None, 1), 4: (float("inf"), 2)}


def test_episodes_are_numbered_without_a_sort_of_their_own(spark):
    p, day = "p", D(2023, 1, 1)
    later, last = D(2023, 6, 1), D(2023, 12, 1)
    df = _make(
        spark,
        # Rows of one day, with doses and ends of their own, open one episode.
        (1, p, day, None, 1.0), (1, p, day, D(2023, 1, 9), 2.0), (1, p, day, None, None),
        (1, p, later, None, 5.0), (1, p, later, None, 6.0), (1, p, D(2023, 6, 20), None, 6.0), (1, p, last, None, 1.0),
        (2, p, later, None, 1.0), (1, None, day, None, 1.0), (1, None, last, None, 1.0),
    )
    out = build_episodes(df, end_col=END)
    got = sorted((r.person_id, r.drug_name_std or "", r.episode_id, r.episode_start, r.n_records) for r in out.collect())
    assert got == [
        (1, "", 1, day, 1), (1, "", 2, last, 1),
        (1, p, 1, day, 3), (1, p, 2, later, 3), (1, p, 3, last, 1), (2, p, 1, later, 1),
    ]
    assert dict(out.dtypes)["episode_id"] == "int"
    plan = build_episodes(df, end_col=END)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2  # by day, then by dose
