"""Exposure, gold and clinical tables derived from the TPC-H-like test tables.

The expressions use integer arithmetic and text that Spark SQL and an ANSI SQL
engine read alike, so a check can rebuild the same tables.  Every row of the
source tables becomes a row here: nothing is sampled or left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posolog.functions.values import evaluated
from posolog.session import well_spread

# Prescription texts by template number; {t} tablets and {m} milligrams vary.
SIG_TEMPLATES = [
    "Take {t} tablets ({m} mg total) daily.",
    "Take {t} tablets ({m} mg per dose) by mouth daily.",
    "Take {t} tablet ({m} mg per dose) BID.",
    "Take {t} tablet ({m} mg) three times daily for 14 days.",
    "Take {t} tabs ({m} mg per dose) every other day.",
    "Take {t} tablet ({m} mg) every 12 (twelve) hours for 2 weeks.",
    "Take {t} tab {m} mg qd x 3 months",
    "Use as directed.",
    "Take {t} tablet as needed for pain.",
    None,
    "   ",
    "Take {t}   tablet daily",
    "TOME CUATRO TABLETAS POR VIA ORAL A DIARIO",
    "{m} mg.",
    "Take {m} mg by mouth.",
    "Take {t} tablets {m} mg/day.",
    "Take {t} tab ({m} mg) 4 times a week.",
    "Take {t} tablets ({m} mg per dose) every 3 weeks.",
    "Take {t} tab ({m} mg) every 10 days.",
    "{u} mg daily for 2 weeks, then {m} mg daily for 2 weeks, then 5 mg daily x 7 days",
    "start {v} mg then decrease by 10 mg every week",
    "Take one tablet ({m} mg) by mouth in the morning",
    "Take half tablet ({m} mg) nightly",
    "Take two and a half tablets daily",
    "1/2 tablet ({m} mg) q5h",
    "Taper by {t} mg every 4 weeks to stop.",
]


def _template_sql(text: str | None) -> str:
    if text is None:
        return "CAST(NULL AS STRING)"
    out, rest = [], text
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if head:
            out.append(f"'{head}'")
        out.append(f"CAST({name} AS STRING)")
    if rest:
        out.append(f"'{rest}'")
    return " || ".join(out)


def _case(on: str, values: list[str], otherwise: str | None = None) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    tail = f" ELSE {otherwise}" if otherwise is not None else ""
    return f"CASE {on} {arms}{tail} END"


_NO_TEXT = "CAST(NULL AS STRING)"

# Keys of a row: part, supplier, line, quantity, person, and numbers made of them.
KEYS_SQL = """
SELECT *, 2 * m AS u, 40 + 10 * t AS v,
       (part * 1 + supp * 3 + line * 5) % TEMPLATES AS k,
       g % 6 AS s, part - part % 12 + d AS concept
FROM (
  SELECT l_orderkey AS okey, l_partkey AS part, l_suppkey AS supp,
         CAST(l_linenumber AS BIGINT) AS line, l_quantity AS quantity,
         o_custkey AS person, CAST(l_shipdate AS DATE) AS ship,
         CAST(l_quantity AS BIGINT) AS m, 1 + l_linenumber % 4 AS t,
         (o_custkey + l_linenumber % 3) % 12 AS d,
         CAST((l_partkey - l_partkey % 12) / 12 AS BIGINT) AS g
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
) AS r
""".strip().replace("TEMPLATES", str(len(SIG_TEMPLATES)))

STRENGTH_TEXT = _case("s", ["'1'", "'2.5'", "'5'", "'10'", "'20'", "'50'"])
STRENGTH = _case("s", ["1.0e0", "2.5e0", "5.0e0", "1.0e1", "2.0e1", "5.0e1"])
# Names by drug number d; st is the strength as text.
CONCEPT_NAME = _case(
    "d",
    [
        "'prednisone ' || st || ' MG oral tablet'",
        "'prednisone ' || st || ' MG oral tablet'",
        "'prednisolone ' || st || ' MG oral tablet'",
        "'methylPREDNISolone ' || st || ' MG Oral Tablet [Medrol]'",
        "'dexamethasone ' || st || ' MG oral tablet'",
        "'hydrocortisone ' || st || ' MG oral tablet'",
        "'Rayos ' || st || ' MG delayed release'",
        "'triamcinolone ' || st || ' MG/ML injectable'",
        "'budesonide ' || st || ' MG oral capsule'",
        "'levetiracetam ' || st || ' MG oral tablet'",
        _NO_TEXT,
        "'  Decadron   ' || st || ' mg  tab '",
    ],
)
SOURCE_VALUE = _case(
    "d",
    [
        "'PREDNISONE ' || st || ' MG TABLET'",
        "'PREDNISONE ' || st || ' MG TABLET'",
        "'PREDNISOLONE ' || st || ' MG TAB'",
        "'MEDROL ' || st || ' MG TABLET'",
        "'DEXAMETHASONE ' || st || ' MG TABLET'",
        "'HYDROCORTISONE ' || st || ' MG TABLET'",
        "'RAYOS ' || st || ' MG CAPSULE'",
        "'KENALOG ' || st || ' MG/ML INJ VIAL'",
        "'ENTOCORT ' || st || ' MG CAPSULE'",
        "'KEPPRA ' || st || ' MG TABLET'",
        "'SOLUTION'",
        "'DECADRON TAB'",
    ],
)
ROUTE_NAME = _case(
    "supp % 8",
    ["'Oral'", "'Oral'", "'oral'", "'Oral'", _NO_TEXT, "'Inhalation'", "'Intravenous'", "'Oral'"],
)
ROUTE_SOURCE = _case(
    "CAST((supp - supp % 8) / 8 AS BIGINT) % 3", ["'PO tablet'", "''", _NO_TEXT]
)
AMOUNT_UNIT = (
    "CASE WHEN g % 7 = 0 THEN 0 "
    "ELSE CASE g % 4 WHEN 2 THEN CAST(NULL AS INT) WHEN 3 THEN 9655 ELSE 8576 END END"
)

# Columns of the exposure table over the keys (with st added).
EXPOSURE_COLUMNS = {
    "person_id": "person",
    "drug_exposure_id": "okey * 8 + line",
    "drug_concept_id": "concept",
    "drug_source_concept_id": "part",
    "drug_exposure_start_date": "ship",
    "drug_exposure_end_date": (
        "CASE (supp + line) % 10 WHEN 0 THEN CAST(NULL AS DATE) "
        "WHEN 1 THEN ship - CAST(5 AS INT) WHEN 2 THEN ship "
        "ELSE ship + CAST(13 + (part % 7) * 15 AS INT) END"
    ),
    "quantity": "CASE WHEN (part + supp) % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE quantity END",
    "days_supply": (
        "CASE (part + line) % 6 WHEN 0 THEN 3.0e1 WHEN 1 THEN 6.0e1 WHEN 2 THEN 9.0e1 "
        "WHEN 3 THEN CAST(NULL AS DOUBLE) WHEN 4 THEN 0.0e0 ELSE 1.4e1 END"
    ),
    "sig": _case("k", [_template_sql(t) for t in SIG_TEMPLATES]),
    "route_concept_id": "900000000 + supp % 8",
    "route_concept_name": ROUTE_NAME,
    "route_source_value": ROUTE_SOURCE,
    "dose_unit_source_value": "'MG'",
    "drug_source_value": (
        f"CASE WHEN supp % 9 = 0 THEN {_NO_TEXT} ELSE {SOURCE_VALUE} END"
    ),
    "drug_concept_name": CONCEPT_NAME,
    "amount_value": f"CASE WHEN g % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE {STRENGTH} END",
    "amount_unit_concept_id": AMOUNT_UNIT,
}
# A pre-computed dose some sites carry: absent, zero or a number.
DAILY_DOSE = (
    "CASE (part + m) % 10 WHEN 0 THEN CAST(m AS DOUBLE) WHEN 1 THEN 0.0e0 "
    "ELSE CAST(NULL AS DOUBLE) END"
)


def exposure_sql(extra: str = "") -> str:
    """The exposure rows as SQL; ``extra`` adds select items over the keys."""
    columns = ", ".join(f"{sql} AS {name}" for name, sql in EXPOSURE_COLUMNS.items())
    keyed = f"SELECT *, {STRENGTH_TEXT} AS st FROM ({KEYS_SQL}) AS keyed"
    return f"SELECT {columns}{extra} FROM ({keyed}) AS named"


GOLD_SQL = """
SELECT o_custkey AS patient_id, CAST(o_orderdate AS DATE) AS episode_start,
       CAST(o_orderdate AS DATE) + CAST(20 + o_orderkey % 80 AS INT) AS episode_end,
       CASE o_orderkey % 25 WHEN 0 THEN 0.0e0 WHEN 1 THEN CAST(NULL AS DOUBLE)
            ELSE 2.5e0 * (1 + o_orderkey % 16) END AS median_daily_dose
FROM {orders}
""".strip()

# Clinical and vocabulary tables.
CLINICAL_SQL = {
    "fact": exposure_sql(),
    "concept": f"""
SELECT p_partkey AS concept_id, CASE WHEN p_partkey % 12 = 10 THEN 'unnamed' ELSE {CONCEPT_NAME} END AS concept_name,
       CASE WHEN p_size % 10 = 0 THEN 'D' ELSE CAST(NULL AS STRING) END AS invalid_reason
FROM (SELECT p_partkey, p_size, d, {STRENGTH_TEXT} AS st
      FROM (SELECT p_partkey, p_size, p_partkey % 12 AS d,
                   CAST((p_partkey - p_partkey % 12) / 12 AS BIGINT) % 6 AS s FROM {{part}}) AS p0) AS p1
UNION ALL
SELECT CAST(1000000000 + n_nationkey AS BIGINT), n_name, CAST(NULL AS STRING) FROM {{nation}}
UNION ALL
SELECT CAST(900000000 + r_regionkey AS BIGINT),
       CASE r_regionkey WHEN 0 THEN 'Oral' WHEN 1 THEN 'Inhalation' WHEN 2 THEN 'Intravenous'
            ELSE r_name END, CAST(NULL AS STRING)
FROM {{region}}
""".strip(),
    # Two rows for some drugs, none or NULL amounts for others.
    "drug_strength": f"""
SELECT p_partkey AS drug_concept_id,
       CASE WHEN g % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE {STRENGTH} END AS amount_value,
       {AMOUNT_UNIT} AS amount_unit_concept_id
FROM (SELECT p_partkey, g, g % 6 AS s
      FROM (SELECT p_partkey, CAST((p_partkey - p_partkey % 12) / 12 AS BIGINT) AS g FROM {{part}}) AS p0) AS p1
UNION ALL
SELECT p_partkey, 0.5e0, CAST(8576 AS INT) FROM {{part}} WHERE p_size > 25
""".strip(),
    # Brands are the ancestors of their parts.
    "concept_ancestor": """
SELECT 1000000000 + CAST(substr(p_brand, 7) AS BIGINT) AS ancestor_concept_id,
       p_partkey AS descendant_concept_id
FROM {part}
""".strip(),
    "person": """
SELECT c_custkey AS person_id, CAST(1930 + c_custkey % 70 AS INT) AS year_of_birth FROM {customer}
""".strip(),
    "observation_period": """
SELECT o_custkey AS person_id, CAST(min(o_orderdate) AS DATE) AS observation_period_start_date,
       CAST(min(o_orderdate) AS DATE) + CAST(1200 AS INT) AS observation_period_end_date
FROM {orders} GROUP BY o_custkey
UNION ALL
SELECT o_custkey, CAST(min(o_orderdate) AS DATE) + CAST(1500 AS INT), CAST(max(o_orderdate) AS DATE)
FROM {orders} GROUP BY o_custkey
""".strip(),
    "condition_occurrence": """
SELECT o_custkey AS person_id, l_partkey AS condition_concept_id,
       CAST(o_orderdate AS DATE) AS condition_start_date
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
""".strip(),
    "drug_exposure": """
SELECT o_custkey AS person_id, l_partkey AS drug_concept_id,
       CAST(l_shipdate AS DATE) AS drug_exposure_start_date
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
""".strip(),
    "procedure_occurrence": """
SELECT user_id AS person_id, event_id % 1000 AS procedure_concept_id,
       CAST(ts AS DATE) AS procedure_date
FROM {events}
""".strip(),
}



def coded_sql(codes: list[int]) -> dict[str, str]:
    """Clinical tables whose events carry ``codes``, concept ids of bundled cohorts.

    A code stands for a part key by its remainder; events of other parts carry concepts
    of their own, some of them descendants of a code.
    """
    n = len(codes)
    values = ", ".join(f"({i}, {code})" for i, code in enumerate(codes))
    table = f"(SELECT CAST(i AS BIGINT) AS i, CAST(c AS BIGINT) AS c FROM (VALUES {values}) AS v0(i, c))"
    lines = "FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"

    def event(key: str, own: str, modulus: int) -> str:
        return (f"SELECT person_id, COALESCE(c, {own}) AS concept, day FROM ({key}) AS e LEFT JOIN "
                f"{table} AS v ON e.at % {modulus} = v.i")

    parts = ("SELECT o_custkey AS person_id, l_partkey, CAST({0} AS DATE) AS day, l_partkey * 31 + "
             "l_suppkey * 7 + l_linenumber AS at " + lines)
    own = "2000000000 + l_partkey"
    conditions = event(parts.replace("{0}", "o_orderdate"), own, 8 * n)
    drugs = event(parts.replace("{0}", "l_shipdate"), own, 5 * n)
    procedures = event("SELECT user_id AS person_id, event_id, CAST(ts AS DATE) AS day, event_id * 13 "
                       "AS at FROM {events}", "3000000000 + event_id % 50", 3 * n)
    return {
        "concept": f"""
SELECT c AS concept_id, CASE WHEN i % 10 = 3 THEN 'D' ELSE CAST(NULL AS STRING) END AS invalid_reason
FROM {table} AS v
UNION ALL
SELECT 2000000000 + p_partkey, CASE WHEN p_size % 10 = 0 THEN 'D' ELSE CAST(NULL AS STRING) END FROM {{part}}
""".strip(),
        "concept_ancestor": f"""
SELECT c AS ancestor_concept_id, 2000000000 + p_partkey AS descendant_concept_id
FROM {{part}} JOIN {table} AS v ON p_partkey % {5 * n} = v.i
UNION ALL
SELECT a.c, b.c FROM {table} AS a JOIN {table} AS b ON (a.i * 7 + 3) % {n} = b.i
""".strip(),
        "person": CLINICAL_SQL["person"],
        "observation_period": CLINICAL_SQL["observation_period"],
        "condition_occurrence": "SELECT person_id, concept AS condition_concept_id, day AS "
                                f"condition_start_date FROM ({conditions}) AS ev",
        "drug_exposure": "SELECT person_id, concept AS drug_concept_id, day AS "
                         f"drug_exposure_start_date FROM ({drugs}) AS ev",
        "procedure_occurrence": "SELECT person_id, concept AS procedure_concept_id, day AS "
                                f"procedure_date FROM ({procedures}) AS ev",
    }


_SOURCES = ("lineitem", "orders", "part", "customer", "nation", "region", "events")


def plain(sql: str) -> str:
    """The text with bare table names, for an engine that knows them as views."""
    for name in _SOURCES:
        sql = sql.replace("{" + name + "}", name)
    return sql


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run ``text`` over the source tables it names; the catalog is not touched."""
    used = {
        name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
        for name in _SOURCES
        if "{" + name + "}" in text
    }
    if "lineitem" in used:
        used["lineitem"] = well_spread(used["lineitem"])
    return spark.sql(text, **used)


def exposures(spark: SparkSession, sf_dir: str, with_daily_dose: bool = False) -> DataFrame:
    """The rows of ``exposure_sql``.

    The long texts are made in steps of their own: in one method with all other columns
    they exceed the size up to which the JVM compiles, and every row would be interpreted.
    """
    rows = _sql(spark, sf_dir, f"SELECT *, {STRENGTH_TEXT} AS st FROM ({KEYS_SQL}) AS keyed")
    texts = ("sig", "drug_source_value", "drug_concept_name")
    for name in texts:
        rows = evaluated(rows, {name: F.expr(EXPOSURE_COLUMNS[name])})
    made = {**EXPOSURE_COLUMNS, **({"daily_dose": DAILY_DOSE} if with_daily_dose else {})}
    return rows.select(*[F.col(c) if c in texts else F.expr(sql).alias(c) for c, sql in made.items()])


def gold_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, GOLD_SQL)


def coded(spark: SparkSession, sf_dir: str, codes: list[int]) -> dict[str, DataFrame]:
    return {name: _sql(spark, sf_dir, sql) for name, sql in coded_sql(codes).items()}


def clinical(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {name: _sql(spark, sf_dir, CLINICAL_SQL[name]) for name in names}
