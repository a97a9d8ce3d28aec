"""One monitor run for every due monitor at once.

due_monitors -> (captured crawl of each monitor) -> content_hash ->
changed_pages -> line_diff -> upsert / check_summary / change_records ->
judge_prompts -> completions join -> apply_verdicts -> touch_monitors ->
monitor_outbox. The crawl step is ``webloom.plans.crawl.crawl`` when
captures are raw responses; here it takes the run's already extracted
pages (monitor_id, url, http_status, markdown, etag, checked_at).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import monitor as M
from ..session import fresh_dir


@dataclass
class MonitorRun:
    due: DataFrame
    changes: DataFrame
    state: DataFrame
    checks: DataFrame
    change_rows: DataFrame
    verdicts: DataFrame
    monitors: DataFrame
    outbox: DataFrame
    jobs: DataFrame          # the synthetic job row of each run


def monitor_run(monitors: DataFrame, state: DataFrame, fetched: DataFrame, run_at: str,
                completions: DataFrame | None = None, failures: DataFrame | None = None) -> MonitorRun:
    """All due monitors at once. ``completions`` holds captured judge
    replies (prompt_hash, attempt, text, error); without it every judge
    call counts as failed, so changes are kept without a verdict.

    ``failures`` (monitor_id, error) names crawls that broke off. Such a run
    ends ``failed`` and its check counts zero pages and changes; nothing is
    sent. What it had fetched before is stored all the same. The runs of
    other monitors are not touched."""
    spark = monitors.sparkSession
    due = M.due_monitors(monitors, run_at)
    ids = due.select(F.col("id").alias("monitor_id"))
    cur = fetched.join(ids, "monitor_id", "left_semi")
    if failures is None:
        failures = spark.createDataFrame([], "monitor_id string, error string")
    broken = failures.groupBy("monitor_id").agg(F.min("error").alias("error"))
    whole = cur.join(broken, "monitor_id", "left_anti")
    changed = M.changed_pages(whole, state)
    diffs = M.line_diff(changed)
    new_state = M.upsert_monitor_pages(state, cur)
    checks = M.check_summary(due, whole, changed, run_at)
    rows = M.change_records(diffs, run_at)
    if completions is None:
        completions = spark.createDataFrame([], "prompt_hash string, attempt int, text string, error string")
    verdicts = M.apply_verdicts(diffs, due, completions)
    touched = M.touch_monitors(monitors, checks)
    outbox = M.monitor_outbox(verdicts, checks, due, run_at)
    ts = F.lit(run_at).cast("timestamp_ntz")
    jobs = due.join(checks.select(F.col("monitor_id").alias("id"), "job_id", "pages_checked"), "id") \
        .join(broken.select(F.col("monitor_id").alias("id"), F.lit(True).alias("broke"), F.coalesce("error", F.lit("unknown error")).alias("error")), "id", "left") \
        .select(F.col("job_id").alias("id"), F.when(F.col("broke"), "failed").otherwise("completed").alias("status"), "url", "max_depth", "max_pages",
                "include_patterns", "exclude_patterns", F.col("pages_checked").alias("pages_scraped"),
                ts.alias("started_at"), ts.alias("completed_at"), F.col("id").alias("monitor_id"), "error")
    return MonitorRun(due, diffs, new_state, checks, rows, verdicts, touched, outbox, jobs)


def crawl_snapshot(spark, monitors: DataFrame, captures: DataFrame, run_at: str,
                   sitemaps: DataFrame | None = None, robots: DataFrame | None = None,
                   rendered: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """The crawl step of a monitor run: every monitor's site crawled with
    its own depth / page / glob settings (C7), as fetched-page rows
    (monitor_id, url, http_status, markdown, etag, last_modified,
    checked_at). The validators of ``state`` go with the requests (M6); a 304
    (scraped, no markdown) keeps status 304 so it counts as checked but is
    never diffed. With ``rendered`` captures blocked, thin and unchanged
    pages are taken from their rendering, which has no validators. The rows
    are stored: a run reads them several times, and each reading of lazy rows
    would convert every page again."""
    from .crawl import _materialize, crawl
    jobs = monitors.select("id", "url", "max_depth", "max_pages", "include_patterns", "exclude_patterns",
                           "webhook_url")
    known = None
    if state is not None:
        header = lambda c: F.when(F.col(c) != "", F.col(c))
        known = state.join(jobs.select(F.col("id").alias("monitor_id")), "monitor_id", "left_semi").select(
            F.col("monitor_id").alias("job_id"), "url", header("last_etag").alias("if_none_match"), header("last_modified").alias("if_modified_since"))
    r = crawl(spark, jobs, captures, sitemaps, robots, rendered=rendered, validators=known)
    scraped = F.col("status") == "scraped"
    rows = r.pages.join(r.validators, ["job_id", "url"], "left").select(
        F.col("job_id").alias("monitor_id"), "url",
        F.when(scraped & F.col("markdown").isNotNull(), 200).when(scraped, 304).otherwise(0).alias("http_status"),
        "markdown", "etag", "last_modified", F.lit(run_at).cast("timestamp_ntz").alias("checked_at"))
    return _materialize(rows, fresh_dir(spark, "snapshot"))


def monitor_run_crawl(spark, monitors: DataFrame, state: DataFrame, captures: DataFrame, run_at: str,
                      sitemaps: DataFrame | None = None, robots: DataFrame | None = None,
                      completions: DataFrame | None = None, rendered: DataFrame | None = None,
                      failures: DataFrame | None = None) -> MonitorRun:
    """M16 end to end: due monitors -> crawl of their sites -> M5..M15 -> K4."""
    due = M.due_monitors(monitors, run_at)
    fetched = crawl_snapshot(spark, due, captures, run_at, sitemaps, robots, rendered, state)
    return monitor_run(monitors, state, fetched, run_at, completions, failures)
