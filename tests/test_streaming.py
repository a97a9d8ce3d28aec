"""Streaming operators equal their batch counterparts."""
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_t1_equals_batch_extraction(spark):
    q = E.queries()
    s = q["t1_stream_scrape"](spark, SF).select("url", "status", "title", "markdown_sha256", "n_links")
    b = q["x7_scrape_pages"](spark, SF).select("url", "status", "title", "markdown_sha256", "n_links")
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_t3_equals_batch_backoff(spark):
    q = E.queries()
    s = q["t3_stream_backoff"](spark, SF).select("job_id", "ord", "skipped", "backoff_until")
    b = q["c8_apply_backoff"](spark, SF).select("job_id", "ord", "skipped", "backoff_until")
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_t5_reports_only_expired_heartbeats(spark):
    out = E.queries()["t5_stream_stale_jobs"](spark, SF)
    assert out.count() > 0
    assert out.where(F.col("last_heartbeat_at").isNull()).count() == 0
