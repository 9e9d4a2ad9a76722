"""Streamed doses give what the batch operators give."""

import datetime as dt

from posolog import run_pipeline

D = dt.date
SCHEMA = ("person_id long, drug_concept_name string, route_concept_name string, sig string, "
          "drug_exposure_start_date date, drug_exposure_end_date date")
COLUMNS = ["person_id", "drug_name_std", "drug_exposure_start_date", "drug_exposure_end_date", "pred_equiv_mg"]


def test_stream_matches_batch(spark, tmp_path):
    data = [
        (p, "prednisone 5 MG", "Oral", f"Take {n} tablets (5 mg) daily.",
         D(2023, 1, 1) + dt.timedelta(days=s), D(2023, 1, 1) + dt.timedelta(days=e))
        for p, n, s, e in [(1, 1, 0, 10), (1, 2, 40, 50), (1, 1, 81, 90), (2, 3, 5, 3),
                           (2, 1, 200, 210)]
    ]
    df = spark.createDataFrame(data, SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    dosed = run_pipeline(stream, "nlp", return_level="exposure")
    query = (
        dosed.select(*COLUMNS).writeStream.format("memory").queryName("streamed")
        .outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    batch = run_pipeline(df, "nlp", return_level="exposure")
    got = sorted(tuple(r) for r in spark.table("streamed").collect())
    assert got == sorted(tuple(r) for r in batch.select(*COLUMNS).collect())
