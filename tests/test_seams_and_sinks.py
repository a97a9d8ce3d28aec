"""Caller-supplied fetch / complete seams and the metrics text sink."""
import os

import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as E
from webloom.operators import extract as X
from webloom.operators import llm as L
from webloom.operators import ops as Q
from webloom.sources import fixtures as FX
from webloom.sources.seams import captures_from, completions_from

SF = "/root/testdata/sf0.001"


def test_fetch_seam_feeds_extraction(spark):
    pages = {r.url: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}

    def fetch(b: pd.DataFrame) -> pd.DataFrame:  # stands in for an HTTP client
        return pd.DataFrame({"url": b["url"], "engine": "fetch", "http_status": 200, "etag": None,
                             "last_modified": None, "html": [pages[u] for u in b["url"]], "error": None,
                             "fetched_at": pd.Timestamp("2024-01-30"), "duration_ms": 1})

    urls = spark.read.parquet(f"{SF}/pages.parquet").select("url")
    out = X.scrape_pages(captures_from(urls, fetch)).where(F.col("status") == "scraped")
    assert out.count() == urls.count()


def test_complete_seam_feeds_retry(spark):
    prompts = spark.createDataFrame([("h1", "p1"), ("h2", "p2")], "prompt_hash string, prompt string")
    comp = completions_from(prompts, lambda p: ('{"ok": true}', None) if p == "p1" else (None, "down"))
    r = {x.prompt_hash: x.error for x in L.retry_failed(prompts.drop("prompt"), comp).collect()}
    assert r == {"h1": None, "h2": "extraction-failed"}


def test_metrics_text_file(spark, tmp_path):
    lines = Q.metrics_exposition(FX.jobs(spark, SF), FX.monitors(spark, SF))
    Q.write_metrics(lines, str(tmp_path / "metrics"))
    part = [f for f in os.listdir(tmp_path / "metrics") if f.startswith("part-")][0]
    text = open(tmp_path / "metrics" / part).read().splitlines()
    pre = Q.METRIC_PREFIX
    assert text[0] == f"# HELP {pre}_jobs_total Crawl jobs by status"
    assert text[2].startswith(pre + '_jobs_total{status="queued"}')
    assert text[-1].startswith(f"{pre}_monitors_active ")


def test_nested_job_pages_sorted(spark):
    rows = E.queries()["q1_job_with_pages_nested"](spark, SF).collect()
    for r in rows:
        ords = [p.ord for p in r.results]
        assert ords == sorted(ords)


def test_scrape_log_sink_partitions_by_date(spark, tmp_path):
    from webloom.operators.sinks import write_scrape_log
    log = FX.scrape_requests(spark, SF)
    write_scrape_log(log, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == log.count()
    assert back.select("created_date").distinct().count() == log.select(F.to_date("created_at")).distinct().count()
