"""Comparison with the gold standard, order statistics and joins."""

import datetime as dt
import random
import statistics

import pytest

from posolog.functions.stats import exact_quantiles, spearman
from posolog.operators.evaluate import (
    compare_episodes,
    day_agreement,
    evaluate_against_gold,
    gold_to_pred_equiv,
)
from posolog.operators.joins import SLICE_DAYS, _meetings, overlap_join

D = dt.date
EP = "person_id long, episode_start date, episode_end date, median_daily_dose double"
GOLD = EP.replace("person_id", "patient_id")
Y = (D(2023, 1, 1), D(2023, 6, 30))


def _pair(spark, computed, gold):
    return spark.createDataFrame(computed, EP), spark.createDataFrame(gold, GOLD)


def test_perfect_match_and_bias(spark):
    ev = evaluate_against_gold(*_pair(spark, [(1, *Y, 10.0)], [(1, *Y, 10.0)]))
    s = ev.summary.first()
    assert (s.MAE, s.MBE, s.coverage_pct, s.pearson_corr) == (0, 0, 100, None)
    c = ev.comparison.first()
    assert (c.agreement_category, c.error_direction, c.overlap_pct) == ("Exact (<=5%)", "Exact match", 100)
    assert ev.by_dose_range.first().n == 1
    s = evaluate_against_gold(*_pair(spark, [(1, *Y, 12.0)], [(1, *Y, 10.0)])).summary.first()
    assert (s.MAE, s.MBE, s.median_AE) == (2, 2, 2)


def test_no_overlap_zero_gold_and_copies(spark, rows):
    later = (D(2024, 1, 1), D(2024, 6, 30))
    ev = evaluate_against_gold(*_pair(spark, [(1, *later, 10.0)], [(1, *Y, 10.0)]))
    s = ev.summary.first()
    assert (s.n_matched_periods, s.coverage_pct, s.MAE) == (0, 0, None)
    computed, gold = _pair(spark, [(1, *Y, 5.0)], [(1, *Y, 0.0), (1, *Y, 0.0), (1, *Y, 10.0)])
    out = rows(evaluate_against_gold(computed, gold).comparison, "gold_dose")
    assert [r["gold_dose"] for r in out] == [0, 0, 10]
    assert out[0]["agreement_category"] == "Poor (>50%)" and out[0]["relative_error_pct"] is None
    with pytest.raises(ValueError):
        evaluate_against_gold(computed, gold, min_overlap_days=0)


def test_taper_strata(spark):
    computed, gold = _pair(spark, [(1, *Y, 10.0)], [(1, *Y, 10.0)])
    from pyspark.sql import functions as F

    ev = evaluate_against_gold(computed.withColumn("has_taper", F.lit(True)), gold)
    assert ev.by_taper_status.first().has_taper is True


@pytest.mark.parametrize("how", ["inner", "left"])
def test_overlap_join_against_brute_force(spark, how):
    rng = random.Random(5)

    def make(n):
        out = []
        for i in range(n):
            s = D(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 900))
            e = s + dt.timedelta(days=rng.choice([-40, 0, 3, 100, 700]))
            out.append((i, 0 if rng.random() < 0.4 else rng.randint(1, 4), s, e if rng.random() > 0.05 else None))
        return out

    a, b = make(120), make(120)
    left = spark.createDataFrame(a, "ai int, ak int, s date, e date")
    right = spark.createDataFrame(b, "bi int, bk int, t date, u date")
    out = overlap_join(left, right, [("ak", "bk")], ("s", "e"), ("t", "u"), how)
    got = sorted((r.ai, r.bi) for r in out.collect() if r.bi is not None)
    expected = sorted(
        (x[0], y[0]) for x in a for y in b
        if x[1] == y[1] and None not in (x[3], y[3]) and y[2] <= x[3] and y[3] >= x[2]
    )
    assert got == expected
    if how == "left":
        assert {r.ai for r in out.collect()} == {x[0] for x in a}


def test_overlap_join_of_all_widths_against_brute_force(spark):
    rng = random.Random(8)

    def make(n):
        out = []
        for i in range(n):
            s = D(1960, 1, 1) + dt.timedelta(days=rng.randint(0, 9000))
            e = s + dt.timedelta(days=rng.choice([-400, 0, 60, 300, 5000, 40000, 90000]))
            out.append((i, rng.randint(0, 1), s, e if rng.random() > 0.1 else D(9999, 12, 31)))
        return out

    a, b = make(90), make(90)
    left = spark.createDataFrame(a, "ai int, ak int, s date, e date")
    right = spark.createDataFrame(b, "bi int, bk int, t date, u date")
    for width in (3, 90, SLICE_DAYS):
        out = overlap_join(left, right, [("ak", "bk")], ("s", "e"), ("t", "u"), slice_days=width)
        expected = [(x[0], y[0]) for x in a for y in b if x[1] == y[1] and y[2] <= x[3] and y[3] >= x[2]]
        assert sorted((r.ai, r.bi) for r in out.collect()) == sorted(expected)


def test_an_ordinary_interval_is_few_rows(spark):
    from pyspark.sql import functions as F

    days = [(D(2020, 1, 1) + dt.timedelta(days=n), D(2020, 1, 1) + dt.timedelta(days=n + 60)) for n in range(600)]
    sides = [_meetings(F.col("s"), F.col("e"), SLICE_DAYS, holds) for holds in (0, 1)]
    sizes = spark.createDataFrame(days, "s date, e date").select(*[F.avg(F.size(x)) for x in sides]).first()
    assert max(sizes) < 2.5
    assert spark.sql("select date'2020-01-01' s, date'9999-12-31' e").select(F.size(sides[0])).first()[0] < 350


def test_an_ordinary_interval_is_one_row_or_two(spark):
    from pyspark.sql import functions as F

    days = [(D(2020, 1, 1) + dt.timedelta(days=n), D(2020, 1, 1) + dt.timedelta(days=n + 60)) for n in range(600)]
    sizes = spark.createDataFrame(days, "s date, e date").select(F.size(_meetings(F.col("s"), F.col("e"), SLICE_DAYS, 0)).alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 2
    assert sizes.agg(F.avg("n")).first()[0] < 1.3


def test_overlap_join_beyond_ordinary_days_against_brute_force(spark):
    rng = random.Random(3)
    days = [D(1, 1, 1), D(1500, 6, 1), D(1899, 12, 31), D(1900, 1, 1), D(1969, 12, 31), D(1970, 1, 1),
            D(2099, 12, 31), D(2100, 1, 1), D(2100, 1, 2), D(2600, 1, 1), D(9999, 12, 31), None]

    def make(n):
        return [(i, rng.randint(0, 1), rng.choice(days), rng.choice(days)) for i in range(n)]

    a, b = make(80), make(80)
    left = spark.createDataFrame(a, "ai int, ak int, s date, e date")
    right = spark.createDataFrame(b, "bi int, bk int, t date, u date")
    expected = sorted(
        (x[0], y[0]) for x in a for y in b
        if x[1] == y[1] and None not in (*x, *y) and y[2] <= x[3] and y[3] >= x[2]
    )
    for width in (300, SLICE_DAYS):
        out = overlap_join(left, right, [("ak", "bk")], ("s", "e"), ("t", "u"), slice_days=width)
        assert sorted((r.ai, r.bi) for r in out.collect()) == expected


def test_a_gold_episode_meets_all_methods_at_once(spark):
    from pyspark.sql import functions as F

    gold = _pair(spark, [], [(1, *Y, 10.0), (1, *Y, 10.0), (2, *Y, 4.0)])[1]
    found = [("a", 1, *Y, 9.0), ("b", 1, D(2030, 1, 1), D(2030, 2, 1), 8.0), ("c", 2, *Y, 7.0), ("x", 2, *Y, 1.0)]
    computed = spark.createDataFrame(
        found, "method string, person_id long, episode_start date, episode_end date, median_daily_dose double"
    )
    out = compare_episodes(computed, gold, methods=["a", "b", "c"])
    assert out.columns[:2] == ["method", "patient_id"]
    got = sorted((r.method, r.patient_id, r.computed_dose) for r in out.collect() if r.computed_dose is not None)
    assert got == [("a", 1, 9.0), ("a", 1, 9.0), ("c", 2, 7.0)]
    assert out.groupBy("method").agg(F.count("*").alias("n")).where("n = 3").count() == 3


def test_quantiles_and_ranks_against_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), round(rng.lognormvariate(2, 2), 1), float(rng.randint(-9, 9)))
            for _ in range(400)] + [("a", 10.0, 1.0)] * 200
    df = spark.createDataFrame(data, "g string, x double, y double")
    got = {r.g: r for r in exact_quantiles(df, "x", {"q1": 0.25, "q5": 0.5, "q9": 0.9}, ["g"]).collect()}
    for g in "ab":
        values = sorted(x for k, x, _ in data if k == g)
        assert got[g].q5 == pytest.approx(statistics.median(values))
        for name, p in (("q1", 0.25), ("q9", 0.9)):
            h = (len(values) - 1) * p
            lo, hi = values[int(h)], values[min(int(h) + 1, len(values) - 1)]
            assert got[g][name] == pytest.approx(lo + (hi - lo) * (h - int(h)))

    def ranks(v):
        s = sorted(v)
        return [s.index(a) + (s.count(a) + 1) / 2 for a in v]

    expected = statistics.correlation(ranks([d[1] for d in data]), ranks([d[2] for d in data]))
    assert spearman(df, "x", "y").first().spearman == pytest.approx(expected)
    assert spearman(df.limit(2), "x", "y").first().spearman is None


def test_day_agreement_counts(spark):
    computed, gold = _pair(
        spark,
        [(1, D(2023, 1, 3), D(2023, 1, 12), 10.0), (2, *Y, 5.0)],
        [(1, D(2023, 1, 1), D(2023, 1, 5), 12.0), (1, D(2023, 1, 9), D(2023, 1, 10), 50.0),
         (1, D(2023, 1, 14), D(2023, 1, 14), 5.0), (3, *Y, 5.0)],
    )
    r = day_agreement(computed, gold).first()
    # window 1..14 Jan: 3-5 agree; 6-8, 11-12 spurious; 1-2, 9-10, 14 missed or wrong; 13 neither
    assert (r.TP, r.FP, r.FN, r.TN, r.Threshold) == (3, 5, 5, 1, "10 mg")
    assert day_agreement(computed, gold, None, 20.0).first().TP == 3
    nobody = day_agreement(computed.where("person_id = 2"), gold).first()
    assert nobody.TP is None and nobody.Threshold is None
    with pytest.raises(ValueError):
        day_agreement(computed, gold, None, None)


def test_gold_conversion(spark):
    records = spark.createDataFrame(
        [(1, "methylprednisolone", D(2023, 1, 1), D(2023, 2, 1))] * 2
        + [(1, "prednisone", D(2022, 12, 1), D(2023, 1, 5))],
        "person_id long, drug_name_std string, drug_exposure_start_date date, "
        "drug_exposure_end_date date",
    )
    _, gold = _pair(spark, [(1, *Y, 1.0)], [(1, *Y, 8.0), (2, *Y, 8.0)])
    got = {r.patient_id: (r.drug_name_std, r.median_daily_dose, r.pred_equiv_status)
           for r in gold_to_pred_equiv(gold, records).collect()}
    assert got == {1: ("methylprednisolone", 10.0, "ok"), 2: (None, 8.0, "unknown_drug")}
    first = gold_to_pred_equiv(gold, records, "earliest").where("patient_id = 1").first()
    assert first.drug_name_std == "prednisone"


def test_day_agreement_equals_days_one_by_one(spark):
    """The sweep over boundaries counts what a walk over the days counts."""
    rng = random.Random(11)
    epoch = D(2020, 1, 1)
    dose = lambda: rng.choice([None, 0.0, 5.0, 20.0, 40.0])
    span = lambda: (lambda s: (epoch + dt.timedelta(s), epoch + dt.timedelta(s + rng.randint(-2, 12))))(rng.randint(0, 40))
    gold = [(p, *span(), dose()) for p in range(12) for _ in range(rng.randint(1, 5))]
    computed = [(p, rng.choice(["a", "b", None]), *span(), dose()) for p in range(2, 14) for _ in range(rng.randint(0, 9))]
    gold.append((3, epoch, D(9999, 12, 31), 20.0))
    computed += [(3, "c", epoch + dt.timedelta(50), D(9999, 12, 31), 25.0), (3, None, D(2021, 1, 1), D(2021, 1, 3), 90.0)]

    def first_dose(rows, at):
        active = [r for r in rows if r[0] <= at <= r[1]]
        return min(active, key=lambda r: r[2])[3] if active else None

    counts = dict.fromkeys(("TP", "FP", "FN", "TN"), 0)
    for p in {g[0] for g in gold} & {c[0] for c in computed}:
        known = {}
        for _, s, e, d in (g for g in gold if g[0] == p):
            known.setdefault((s, e), []).append(d)
        g = [(s, e, (s, e), None if None in ds else min(ds)) for (s, e), ds in known.items()]
        c = [(s, e, (n is not None, n or "", s, e, d is not None, d or 0.0), d) for q, n, s, e, d in computed if q == p]
        at, last = min(r[0] for r in g), max(r[1] for r in g)
        while at <= last:
            # Nothing begins or ends after 2022 but on the last day.
            step = 1 if at < D(2022, 1, 1) else (last - at).days + 1
            gd, cd = first_dose(g, at), first_dose(c, at)
            if gd is None and cd is None:
                counts["TN"] += step
            elif gd is None:
                counts["FP"] += step
            elif cd is not None and abs(cd - gd) <= 10:
                counts["TP"] += step
            else:
                counts["FN"] += step
            if (last - at).days < step:
                break
            at += dt.timedelta(step)
    schema = "episode_start date, episode_end date, median_daily_dose double"
    g_frame = spark.createDataFrame(gold, f"patient_id long, {schema}")
    c_frame = spark.createDataFrame(computed, f"person_id long, drug_name_std string, {schema}")
    row = day_agreement(c_frame, g_frame).first().asDict()
    assert {k: row[k] for k in counts} == counts
    assert counts["TP"] > 2_900_000  # days of an open end, none of them a row


def test_names_of_the_factor_table_are_their_own_standard_names(spark):
    from pyspark.sql import functions as F

    from posolog.functions import fixed_values as V
    from posolog.functions.values import standard_drug_name
    from posolog.operators.convert import convert_pred_equiv

    names = [*V.PREDNISONE_FACTORS, "Medrol 4 MG", " Prednisone ", "", None, "other"]
    df = spark.createDataFrame([(n, 10.0) for n in names], "drug_name_std string, daily_dose_mg double")
    read = df.select("drug_name_std", standard_drug_name(F.col("drug_name_std")).alias("s"))
    assert all(r.s == r.drug_name_std for r in read.collect() if r.drug_name_std in V.PREDNISONE_FACTORS)
    got = {r.drug_name_std: (r.equiv_factor, r.pred_equiv_status) for r in convert_pred_equiv(df).collect()}
    for n, factor in V.PREDNISONE_FACTORS.items():
        assert got[n] == (factor, "ok" if factor is not None else "missing_factor")
    assert got["Medrol 4 MG"] == (V.PREDNISONE_FACTORS["methylprednisolone"], "ok")
    assert got[" Prednisone "] == (1.0, "ok")
    assert {got[n] for n in ("", None, "other")} == {(None, "unknown_drug")}
    mapped = convert_pred_equiv(df, drug_name_map=[("^prednisone$", "dexamethasone")])
    assert mapped.where("drug_name_std = 'prednisone'").first().equiv_factor == V.PREDNISONE_FACTORS["dexamethasone"]
