"""Benchmark of the headline queries.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` (default 8) and prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed in full through the ``noop`` sink (no collect to
the driver); one warm-up run, then the median of ``$BENCH_REPS`` (default
3) timed runs. The crawl plan materialises its rounds under a fresh
folder of the checkpoint root each run.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    # name in output: registered query
    "host_summary": "host_summary",                 # X1/X2/X4 + U1 + per-host aggregate (flagship)
    "page_extraction_x7": "x7_scrape_pages",        # X1-X5 + S2 incl. markdown tree walk
    "url_normalise_links_u1": "u1_normalize_links",  # every link of every page
    "crawl_all_hosts_c7": "c7_crawl_pages",          # bounded BFS over all link-graph jobs
    "change_detect_diff_m7_m8": "m8_line_diff",      # snapshot hash join + Myers diff
    "scrape_stats_q12": "q12_scrape_stats",          # one-pass conditional aggregates
    "job_counts_q8": "q8_job_counts",                # lineitem/orders derived tables
    "job_progress_c11": "c11_job_progress",
    "extract_results_e6": "e5_e6_extract_results",
}


LONG_S = 30


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("webloom-bench")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.shuffle.partitions", str(int(cpus) * 2))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
             .config("spark.driver.memory", "16g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="webloom-bench-"))
    from webloom.plans import catalog
    from webloom.session import configure
    configure(spark)   # UTC, optimizer thresholds, ship the package to Python workers

    times: dict[str, float] = {}
    for out_name, qname in HEADLINE.items():
        fn, _ = catalog.REGISTRY[qname]
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        # a long job (the crawl's rounds) varies little: one timed run
        for _ in range(1 if time.perf_counter() - t0 > LONG_S else reps):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[out_name] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_median_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "reps": reps,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
