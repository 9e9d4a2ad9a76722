"""SQL that computes the registered queries' expected results independently.

The statements know the *expected* reading of each prescription template (as
listed by hand below) and the meaning of each coded key, so they repeat neither
the regular expressions nor the DataFrame code they check.
"""

from __future__ import annotations

from posolog.plans import test_tables as T

N = "NULL"
# Expected reading per template number, as SQL over t, m, u and v.
TABLETS = ["t", "t", "t", "t", "t", "t", "t", "1", "t", N, N, "t", "4", "1", "1", "t", "t",
           "t", "t", "1", "1", "1", "1", "1", "2", "1"]
TABLETS_ADVANCED = [*TABLETS[:22], "0.5e0", "2.5e0", "0.5e0", "1"]
FREQ = ["1", "1", "2", "3", "0.5e0", "2", "1", N, N, N, N, "1", "1", "1", "1", N, "4e0/7",
        "1e0/21", "1e0/10", "1", N, "1", "1", "1", "24e0/5", "1e0/28"]
# mg per administration; tab is the number of tablets of the parser in question.
ADMIN = [N, "m", "m", "m*t", "m", "m*t", "m*t", N, N, N, N, N, N, "m", "m", N, "m*t", "m",
         "m*t", "u", "v", "m", "m*tab", N, "m*tab", "t"]
DAILY_TOTAL = {0: "m", 15: "m"}
DURATION = {3: "14", 5: "14", 6: "90", 19: "14"}
TAPERS = "(4, 19, 20, 25)"

STEROIDS = ("'prednisone', 'prednisolone', 'methylprednisolone', 'dexamethasone', "
            "'hydrocortisone', 'triamcinolone'")
NAME = ("CASE d WHEN 0 THEN 'prednisone' WHEN 1 THEN 'prednisone' WHEN 2 THEN 'prednisolone' "
        "WHEN 3 THEN 'methylprednisolone' WHEN 4 THEN 'dexamethasone' WHEN 5 THEN "
        "'hydrocortisone' WHEN 6 THEN 'prednisone' WHEN 7 THEN 'triamcinolone' WHEN 8 THEN "
        "'budesonide' WHEN 9 THEN 'levetiracetam ' || st || ' mg oral tablet' WHEN 11 THEN "
        "'dexamethasone' END")
SOURCE_ROUTE = ("CASE WHEN supp % 9 = 0 THEN 'other' WHEN d = 7 THEN 'injection' "
                "WHEN d = 10 THEN 'other' ELSE 'oral' END")
ROUTE = ("CASE supp % 8 WHEN 5 THEN 'inhaled' WHEN 6 THEN 'injection' WHEN 4 THEN "
         f"CASE (supp // 8) % 3 WHEN 0 THEN 'oral' WHEN 1 THEN 'other' ELSE {SOURCE_ROUTE} END "
         "ELSE 'oral' END")
FACTOR = ("CASE drug_name_std WHEN 'prednisone' THEN 1.0 WHEN 'prednisolone' THEN 1.0 "
          "WHEN 'methylprednisolone' THEN 1.25 WHEN 'dexamethasone' THEN 7.5 "
          "WHEN 'hydrocortisone' THEN 0.25 WHEN 'triamcinolone' THEN 1.25 END::DOUBLE")


def r(sql: str, name: str | None = None) -> str:
    """Six decimals on both engines; adding zero removes a negative zero."""
    return f"round({sql}, 6) + 0.0 AS {name or sql}"


def _by_template(values: list[str], kind: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CAST(CASE k {arms} END AS {kind})"


def _some_templates(values: dict[int, str], kind: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in values.items())
    return f"CAST(CASE k {arms} END AS {kind})"


class With:
    """Common table expressions collected in order, then one final select."""

    def __init__(self) -> None:
        self.parts: dict[str, str] = {}

    def add(self, name: str, sql: str) -> With:
        self.parts.setdefault(name, sql)
        return self

    def select(self, sql: str) -> str:
        body = ",\n".join(f"{n} AS ({s})" for n, s in self.parts.items())
        return f"WITH {body}\n{sql}"


def rows() -> With:
    """x: exposure rows with their keys, expected name and route."""
    extra = f", {T.DAILY_DOSE} AS daily_dose, d, st, k, t, m, u, v, supp, g"
    q = With().add("x0", T.plain(T.exposure_sql(extra)))
    return q.add("x", f"SELECT *, {NAME} AS drug_name_std, {ROUTE} AS route_class FROM x0")


def oral(q: With) -> With:
    return q.add(
        "o", f"SELECT * FROM x WHERE drug_name_std IN ({STEROIDS}) AND route_class = 'oral'"
    )


def parsed(q: With, source: str, name: str, advanced: bool = False) -> With:
    """Expected reading of every row of ``source``."""
    tablets = _by_template(TABLETS_ADVANCED if advanced else TABLETS, "DOUBLE")
    q.add(f"{name}1", f"SELECT *, {tablets} AS tab, {_by_template(FREQ, 'DOUBLE')} AS freq FROM {source}")
    q.add(f"{name}2", f"SELECT *, {_by_template(ADMIN, 'DOUBLE')} AS admin, "
          f"{_some_templates(DURATION, 'DOUBLE')} AS dur, k IN {TAPERS} AS taper, "
          f"{_some_templates(DAILY_TOTAL, 'DOUBLE')} AS total FROM {name}1")
    q.add(f"{name}3", f"SELECT *, coalesce(total, admin * freq) AS daily FROM {name}2")
    return q.add(name, "SELECT *, CASE WHEN k IN (9, 10) THEN 'empty' WHEN k = 7 THEN 'free_text' "
                 "WHEN taper THEN 'taper' WHEN k = 8 THEN 'prn' WHEN daily IS NOT NULL THEN 'ok' "
                 f"ELSE 'no_parse' END AS status FROM {name}3")


PARSED_SELECT = ", ".join([
    r("tab", "tablets"), r("freq", "freq_per_day"), r("admin", "mg_per_admin"),
    "k IN (0, 15) AS mg_total_flag", r("dur", "duration_days"), "taper AS taper_flag",
    "k = 8 AS prn_flag", "k = 7 AS free_text_flag", r("daily", "daily_dose_mg"),
    "status AS parsed_status",
])


def candidates(q: With, source: str, name: str, original: str) -> With:
    """Strength and the four candidate doses; ``original`` is SQL over the row."""
    q.add(f"{name}1", "SELECT *, coalesce(CASE WHEN amount_unit_concept_id IS NULL OR "
          "amount_unit_concept_id IN (0, 8576) THEN amount_value END, CASE WHEN supp % 9 = 0 OR "
          "d IN (10, 11) THEN NULL ELSE CAST(st AS DOUBLE) END) AS strength, "
          "CASE WHEN drug_exposure_end_date >= drug_exposure_start_date THEN "
          "drug_exposure_end_date - drug_exposure_start_date + 1 END AS days, "
          f"{original} AS orig FROM {source}")
    return q.add(name, "SELECT *, CASE WHEN orig > 0 THEN orig END AS c_original, "
                 "tab * freq * strength AS c_tablets, quantity * strength / days AS c_duration, "
                 "CASE WHEN days_supply > 0 THEN quantity * strength / days_supply END AS c_supply "
                 f"FROM {name}1")


LABELS = {"c_original": "original", "c_tablets": "tablets_freq",
          "c_duration": "actual_duration", "c_supply": "supply_based"}
DEFAULT_ORDER = ("c_original", "c_tablets", "c_duration", "c_supply")


def cascade(q: With, source: str, name: str, order: tuple[str, ...] = DEFAULT_ORDER) -> With:
    first = f"coalesce({', '.join(order)})"
    label = "CASE " + " ".join(f"WHEN {c} IS NOT NULL THEN '{LABELS[c]}'" for c in order) + \
        " ELSE 'missing' END"
    q.add(f"{name}1", f"SELECT *, {first} AS first_dose, {label} AS first_label FROM {source}")
    return q.add(name, "SELECT *, CASE WHEN first_dose <= 2000 THEN first_dose END AS dose, "
                 "CASE WHEN first_dose > 2000 THEN 'missing' ELSE first_label END AS method_label "
                 f"FROM {name}1")


def baseline(daily_dose: bool) -> With:
    """b: baseline records with the automatic parse."""
    q = parsed(oral(rows()), "o", "p")
    candidates(q, "p", "c", "daily_dose" if daily_dose else "daily")
    return cascade(q, "c", "b")


def nlp(q: With, name: str, advanced: bool = False, expand: bool = False,
        daily_dose: bool = False) -> With:
    """Records of the text methods: columns dose, status and step numbers."""
    parsed(q, "o", f"{name}p", advanced)
    q.add(f"{name}s", "SELECT * REPLACE (CASE WHEN needs THEN fb * tab ELSE admin END AS admin, "
          "CASE WHEN needs AND freq IS NOT NULL THEN fb * tab * freq ELSE daily END AS daily, "
          "CASE WHEN needs AND freq IS NOT NULL THEN 'ok' ELSE status END AS status) FROM ("
          "SELECT *, coalesce(amount_value, CAST(st AS DOUBLE)) AS fb, "
          f"status = 'no_parse' AND admin IS NULL AS needs FROM {name}p) AS y")
    source = f"{name}s"
    if advanced:
        q.add(f"{name}k", "SELECT * REPLACE (CASE WHEN daily <= 2000 THEN daily END AS daily, "
              f"CASE WHEN daily > 2000 THEN 'implausible' ELSE status END AS status) FROM {source}")
        source = f"{name}k"
        if expand:
            expanded(q, source, f"{name}e")
            source = f"{name}e"
    candidates(q, source, f"{name}c", "daily_dose" if daily_dose else "CAST(NULL AS DOUBLE)")
    cascade(q, f"{name}c", f"{name}f", ("c_original", "c_duration", "c_supply"))
    q.add(f"{name}g", "SELECT *, CASE WHEN open THEN dose ELSE daily END AS nlp_dose, CASE WHEN open "
          "THEN CASE WHEN dose IS NULL THEN 'no_parse' ELSE 'fallback_' || method_label END "
          "ELSE status END AS nlp_status FROM (SELECT *, daily IS NULL AND status IN "
          f"('no_parse', 'empty') AS open FROM {name}f) AS y")
    cap = "" if advanced else (
        " REPLACE (CASE WHEN nlp_dose <= 2000 THEN nlp_dose END AS nlp_dose, "
        "CASE WHEN nlp_dose > 2000 THEN 'implausible' ELSE nlp_status END AS nlp_status)")
    return q.add(name, f"SELECT *{cap} FROM {name}g")


def expanded(q: With, source: str, name: str) -> With:
    """One row per step of the two templates that can be decomposed."""
    q.add(f"{name}1", "SELECT z.*, w.step, CASE WHEN k = 19 THEN CASE w.step WHEN 1 THEN u "
          "WHEN 2 THEN m ELSE 5 END WHEN k = 20 THEN v - 10 * (w.step - 1) END AS step_dose, "
          "CASE WHEN k = 19 THEN CASE w.step WHEN 3 THEN 7 ELSE 14 END ELSE 7 END AS step_days, "
          "CASE WHEN k = 19 THEN 14 ELSE 7 END * (w.step - 1) AS step_from "
          f"FROM {source} AS z, LATERAL (SELECT unnest(CASE WHEN k = 19 THEN generate_series(1, 3) "
          "WHEN k = 20 THEN generate_series(1, CAST(v // 10 AS BIGINT)) ELSE [NULL] END) AS step) AS w")
    return q.add(name, "SELECT * REPLACE (CASE WHEN step IS NULL THEN daily ELSE step_dose END AS "
                 "daily, CASE WHEN step IS NULL THEN freq ELSE 1 END AS freq, CASE WHEN step IS NULL "
                 "THEN dur ELSE step_days END AS dur, CASE WHEN step IS NULL THEN status ELSE "
                 f"'taper_ok' END AS status) FROM {name}1")


def episodes(q: With, source: str, name: str, dose: str, gap: int = 30, by: str = "",
             factor: str = FACTOR) -> With:
    """Gap-bridged episodes of ``source`` rows, doses as prednisone-equivalents."""
    key = f"{by}person_id, drug_name_std"
    q.add(f"{name}1", f"SELECT {key}, drug_exposure_start_date AS s, CASE WHEN "
          "drug_exposure_end_date >= drug_exposure_start_date THEN drug_exposure_end_date ELSE "
          f"drug_exposure_start_date END AS e, {dose} * {factor} AS dose FROM {source}")
    q.add(f"{name}2", f"SELECT *, max(e) OVER (PARTITION BY {key} ORDER BY s, e ROWS BETWEEN "
          f"UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {name}1")
    q.add(f"{name}3", f"SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > {gap} THEN 1 ELSE 0 END) OVER "
          f"(PARTITION BY {key} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS eid FROM {name}2")
    return q.add(name, f"SELECT {key}, CAST(eid AS BIGINT) AS episode_id, min(s) AS episode_start, "
                 "max(e) AS episode_end, max(e) - min(s) + 1 AS n_days, count(*) AS n_records, "
                 "median(dose) AS median_daily_dose, min(dose) AS min_daily_dose, max(dose) AS "
                 "max_daily_dose, sum(dose * (e - s + 1)) / sum(CASE WHEN dose IS NOT NULL THEN "
                 f"e - s + 1 END) AS mean_daily_dose FROM {name}3 GROUP BY {key}, eid")


EPISODE_SELECT = ", ".join([
    "person_id", "drug_name_std", "episode_id", "episode_start", "episode_end", "n_days",
    "n_records", r("median_daily_dose"), r("min_daily_dose"), r("max_daily_dose"),
    r("mean_daily_dose"),
])


def comparison(q: With, eps: str, name: str, gold: str = "gold") -> With:
    """Gold rows with the best overlapping computed episode and the errors."""
    q.add("gold", T.plain(T.GOLD_SQL))
    q.add(f"{name}1", "SELECT g.patient_id, g.episode_start, g.episode_end, c.median_daily_dose AS "
          "cd, least(g.episode_end, c.episode_end) - greatest(g.episode_start, c.episode_start) + 1 "
          "AS ov, row_number() OVER (PARTITION BY g.patient_id, g.episode_start, g.episode_end ORDER "
          "BY least(g.episode_end, c.episode_end) - greatest(g.episode_start, c.episode_start) DESC, "
          "c.drug_name_std, c.episode_start) AS rn FROM (SELECT DISTINCT patient_id, episode_start, "
          f"episode_end FROM {gold}) AS g JOIN {eps} AS c ON c.person_id = g.patient_id AND "
          "c.episode_start <= g.episode_end AND c.episode_end >= g.episode_start")
    q.add(f"{name}2", "SELECT g.patient_id, g.episode_start, g.episode_end, g.median_daily_dose AS "
          f"gold_dose, b.cd AS computed_dose, b.ov AS overlap_days FROM {gold} AS g LEFT JOIN {name}1 "
          "AS b ON b.rn = 1 AND b.patient_id = g.patient_id AND b.episode_start = g.episode_start "
          "AND b.episode_end = g.episode_end")
    q.add(f"{name}3", "SELECT *, episode_end - episode_start + 1 AS gold_duration, 100.0 * "
          "overlap_days / (episode_end - episode_start + 1) AS overlap_pct, computed_dose - gold_dose "
          "AS bias_error, abs(computed_dose - gold_dose) AS absolute_error, CASE WHEN gold_dose <> 0 "
          "THEN (computed_dose - gold_dose) / gold_dose * 100 END AS relative_error_pct "
          f"FROM {name}2")
    return q.add(name, "SELECT *, abs(relative_error_pct) AS absolute_relative_error_pct, CASE WHEN "
                 "gold_dose = 0 AND bias_error <> 0 THEN 'Poor (>50%)' WHEN abs(relative_error_pct) <= "
                 "5 THEN 'Exact (<=5%)' WHEN abs(relative_error_pct) <= 20 THEN 'Good (<=20%)' WHEN "
                 "abs(relative_error_pct) <= 50 THEN 'Moderate (<=50%)' WHEN relative_error_pct IS NOT "
                 "NULL THEN 'Poor (>50%)' END AS agreement_category, CASE WHEN bias_error > 0 THEN "
                 "'Over-estimation' WHEN bias_error < 0 THEN 'Under-estimation' WHEN bias_error = 0 "
                 f"THEN 'Exact match' END AS error_direction FROM {name}3")


COMPARISON_SELECT = ", ".join([
    "patient_id", "episode_start", "episode_end", r("gold_dose"), r("computed_dose"),
    "overlap_days", "gold_duration", r("overlap_pct"), r("absolute_error"), r("bias_error"),
    r("relative_error_pct"), r("absolute_relative_error_pct"), "agreement_category",
    "error_direction",
])
MEANS = ("count(*) AS n, " + r("avg(absolute_error)", "MAE") + ", " + r("avg(bias_error)", "MBE")
         + ", " + r("avg(absolute_relative_error_pct)", "MAPE"))


def summary(q: With, comp: str, name: str) -> With:
    """One-row summary of a comparison."""
    q.add(f"{name}m", f"SELECT * FROM {comp} WHERE computed_dose IS NOT NULL")
    q.add(f"{name}r", "SELECT rank() OVER (ORDER BY computed_dose) + (count(*) OVER (PARTITION BY "
          "computed_dose) - 1) / 2.0 AS rx, rank() OVER (ORDER BY gold_dose) + (count(*) OVER "
          f"(PARTITION BY gold_dose) - 1) / 2.0 AS ry FROM {name}m WHERE gold_dose IS NOT NULL")
    return q.add(name, f"SELECT (SELECT count(*) FROM {comp}) AS n_gold_periods, (SELECT count(*) FROM "
                 f"{name}m) AS n_matched_periods, 100.0 * (SELECT count(*) FROM {name}m) / (SELECT "
                 f"count(*) FROM {comp}) AS coverage_pct, avg(absolute_error) AS MAE, avg(bias_error) AS "
                 "MBE, sqrt(avg(bias_error * bias_error)) AS RMSE, median(absolute_error) AS median_AE, "
                 "avg(absolute_relative_error_pct) AS MAPE, avg(relative_error_pct) AS "
                 "mean_relative_bias_pct, corr(computed_dose, gold_dose) AS pearson_corr, (SELECT "
                 f"corr(rx, ry) FROM {name}r) AS spearman_corr FROM {name}m")


SUMMARY_SELECT = ", ".join(
    ["n_gold_periods", "n_matched_periods"]
    + [r(c) for c in ("coverage_pct", "MAE", "MBE", "RMSE", "median_AE", "MAPE",
                      "mean_relative_bias_pct", "pearson_corr", "spearman_corr")]
)


def three_methods(gap: int = 30) -> With:
    """eb, en, ea: episodes of the three methods as the study runs them."""
    q = oral(rows())
    # The study's baseline does not parse texts: tablets and frequency stay open.
    q.add("plain", "SELECT *, CAST(NULL AS DOUBLE) AS tab, CAST(NULL AS DOUBLE) AS freq FROM o")
    candidates(q, "plain", "bc", "CAST(NULL AS DOUBLE)")
    cascade(q, "bc", "b")
    nlp(q, "n")
    nlp(q, "adv", advanced=True)
    episodes(q, "b", "eb", "dose", gap)
    episodes(q, "n", "en", "nlp_dose", gap)
    return episodes(q, "adv", "ea", "nlp_dose", gap)


METHODS = {"Baseline": "eb", "NLP": "en", "Advanced NLP": "ea"}


def gold_converted(q: With, earliest: bool = False) -> With:
    """gp: gold with its drug and prednisone-equivalent dose (over b's records)."""
    q.add("gold", T.plain(T.GOLD_SQL))
    q.add("gd1", "SELECT g.patient_id, g.episode_start, g.episode_end, x.drug_name_std, "
          "x.drug_exposure_start_date AS s FROM (SELECT DISTINCT patient_id, episode_start, "
          "episode_end FROM gold) AS g JOIN o AS x ON x.person_id = g.patient_id AND "
          "x.drug_exposure_start_date <= g.episode_end AND x.drug_exposure_end_date >= "
          "g.episode_start")
    if earliest:
        q.add("gd2", "SELECT patient_id, episode_start, episode_end, drug_name_std, row_number() OVER "
              "(PARTITION BY patient_id, episode_start, episode_end ORDER BY s, drug_name_std) AS rn "
              "FROM gd1")
    else:
        q.add("gd2", "SELECT patient_id, episode_start, episode_end, drug_name_std, row_number() OVER "
              "(PARTITION BY patient_id, episode_start, episode_end ORDER BY count(*) DESC, "
              "drug_name_std) AS rn FROM gd1 GROUP BY patient_id, episode_start, episode_end, "
              "drug_name_std")
    q.add("gp0", "SELECT g.patient_id, g.episode_start, g.episode_end, g.median_daily_dose AS raw, "
          "w.drug_name_std FROM gold AS g LEFT JOIN gd2 AS w ON w.rn = 1 AND w.patient_id = "
          "g.patient_id AND w.episode_start = g.episode_start AND w.episode_end = g.episode_end")
    return q.add("gp", f"SELECT patient_id, episode_start, episode_end, drug_name_std, raw AS "
                 f"median_daily_dose_raw, raw * {FACTOR} AS gold_pred_equiv_mg, {FACTOR} AS "
                 f"equiv_factor, coalesce(raw * {FACTOR}, raw) AS median_daily_dose FROM gp0")


def agreement(q: With, eps: str, name: str, gold: str, condition: str) -> With:
    """Day counts; ``condition`` is SQL over gd (gold dose) and cd (computed dose)."""
    q.add(f"{name}w", "SELECT patient_id, min(episode_start) AS ws, max(episode_end) AS we FROM "
          f"{gold} WHERE patient_id IN (SELECT person_id FROM {eps}) GROUP BY patient_id")
    q.add(f"{name}g", "SELECT patient_id, CAST(unnest(generate_series(ws, we, INTERVAL 1 DAY)) AS DATE) "
          f"AS day FROM {name}w")
    q.add(f"{name}x", "SELECT *, row_number() OVER (PARTITION BY patient_id, day ORDER BY s, e, dose "
          "NULLS FIRST) AS rn FROM (SELECT patient_id, episode_start AS s, episode_end AS e, "
          "median_daily_dose AS dose, CAST(unnest(generate_series(episode_start, episode_end, INTERVAL "
          f"1 DAY)) AS DATE) AS day FROM {gold}) AS y")
    q.add(f"{name}y", "SELECT *, row_number() OVER (PARTITION BY person_id, day ORDER BY drug_name_std, "
          "s) AS rn FROM (SELECT person_id, drug_name_std, episode_start AS s, median_daily_dose AS "
          "dose, CAST(unnest(generate_series(episode_start, episode_end, INTERVAL 1 DAY)) AS DATE) AS "
          f"day FROM {eps}) AS z")
    q.add(f"{name}d", f"SELECT w.day, x.dose AS gd, y.dose AS cd FROM {name}g AS w LEFT JOIN {name}x AS "
          f"x ON x.rn = 1 AND x.patient_id = w.patient_id AND x.day = w.day LEFT JOIN {name}y AS y ON "
          "y.rn = 1 AND y.person_id = w.patient_id AND y.day = w.day")
    ok = f"coalesce(gd IS NOT NULL AND cd IS NOT NULL AND ({condition}), false)"
    q.add(f"{name}c", f"SELECT count(*) FILTER ({ok})::DOUBLE AS tp, count(*) FILTER (gd IS NULL AND cd "
          f"IS NOT NULL)::DOUBLE AS fp, count(*) FILTER (gd IS NOT NULL AND NOT {ok})::DOUBLE AS fn, "
          f"count(*) FILTER (gd IS NULL AND cd IS NULL)::DOUBLE AS tn FROM {name}d")
    return q.add(name, "SELECT *, (tp + tn) / (tp + fp + fn + tn) AS po, ((tp + fn) * (tp + fp) + (tn + "
                 f"fp) * (tn + fn)) / (tp + fp + fn + tn) ^ 2 AS pe FROM {name}c")


def agreement_select(label: str, source: str) -> str:
    return (f"SELECT '{label}' AS Threshold, tp::BIGINT AS TP, fp::BIGINT AS FP, fn::BIGINT AS FN, "
            f"tn::BIGINT AS TN, {r('tp / nullif(tp + fn, 0)', 'Sensitivity')}, "
            f"{r('tn / nullif(tn + fp, 0)', 'Specificity')}, {r('tp / nullif(tp + fp, 0)', 'PPV')}, "
            f"{r('tn / nullif(tn + fn, 0)', 'NPV')}, "
            f"{r('2 * tp / nullif(2 * tp + fp + fn, 0)', 'F1')}, "
            f"{r('(po - pe) / nullif(1 - pe, 0)', 'Kappa')} FROM {source}")
