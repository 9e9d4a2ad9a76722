"""Headline queries on local Spark; prints one JSON line.

Each query runs to a ``noop`` sink, once to warm up and then ``BENCH_RUNS``
times; the median is reported.  ``BENCH_SF_DIR``, ``BENCH_CPUS``, ``BENCH_RUNS``
and ``BENCH_QUERIES`` (comma separated) override the defaults.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from posolog.plans.queries import QUERIES
from posolog.session import RECOMMENDED_CONF

HEADLINE = {
    "extract_exposure": "S1 extraction",
    "parse_sig_basic": "text parsing",
    "dose_baseline": "D1 baseline",
    "dose_nlp": "D2 text method",
    "dose_nlp_advanced_tapers": "D3 advanced with tapers",
    "episodes_30": "E1 pipeline to episodes",
    "eval_comparison": "V1 comparison",
    "eval_summary": "V2 summary",
    "day_agreement_mg": "V5 patient-day agreement",
    "metrics": "V6 three methods against gold",
    "cohort_config": "K2 cohort",
    "cohort_pipeline": "K2 into E1",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(HEADLINE)

    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("posolog-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="posolog-bench-"))
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    seconds = {}
    for name in names:
        times = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "posolog_headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
