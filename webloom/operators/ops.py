"""Operational queries over jobs / job_pages / monitors / scrape_requests / logs.

Q1-Q17 plus the derived-counter operators C11, C12, C14 and the metrics
text K5. Everything is a projection, a filter, a hash aggregate (partial +
final, so a hot job or status value is pre-aggregated map-side) or a
window partitioned by job. The two "latest N then filter" dashboards keep
the reference's order of operations (limit first, then filter); Spark
plans that as TakeOrderedAndProject followed by a Filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import math_round

# Job statuses reported with zero fill, and the metrics text.
JOB_STATUSES = ["queued", "running", "completed", "failed"]
STALE_AFTER_SECONDS = 120
METRIC_PREFIX = "webloom"   # a parameter of metrics_exposition
METRICS_LAST_LINE = 112


def _ts(x):
    return F.lit(x).cast("timestamp_ntz") if isinstance(x, str) else x


def job_with_pages(jobs: DataFrame, pages: DataFrame, job_id: str | None = None) -> DataFrame:
    """Q1 (nested): one row per job with its page list ordered by ord
    (no markdown). A job's list is bounded by its max_pages."""
    j = jobs if job_id is None else jobs.where(F.col("id") == job_id)
    p = pages.select("job_id", "ord", "url", "status", "engine", "title", "scraped_at")
    nested = p.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct(
        "ord", "url", "status", "engine", "title", "scraped_at"))).alias("results"))
    return j.select(F.col("id").alias("job_id"), "status", "url", "pages_discovered", "pages_scraped",
                    "pages_failed", "started_at", "completed_at", "error") \
            .join(nested, "job_id", "left") \
            .withColumn("results", F.coalesce("results", F.array().cast(nested.schema["results"].dataType)))


def job_with_pages_flat(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Q1 (flat twin): one row per (job, page); jobs without pages kept."""
    p = pages.select("job_id", F.col("ord").alias("page_ord"), F.col("url").alias("page_url"),
                     F.col("status").alias("page_status"), F.col("engine").alias("page_engine"),
                     F.col("title").alias("page_title"), F.col("scraped_at").alias("page_scraped_at"))
    j = jobs.select(F.col("id").alias("job_id"), "status", "url", "pages_discovered", "pages_scraped",
                    "pages_failed", "started_at", "completed_at", "error")
    return j.join(p, "job_id", "left")


def list_jobs(jobs: DataFrame) -> DataFrame:
    """Q2: nine columns, created_at ascending (id breaks ties), no limit."""
    return jobs.select("id", "status", "url", "pages_discovered", "pages_scraped", "pages_failed",
                       "started_at", "completed_at", "created_at").orderBy("created_at", "id")


def recent_jobs(jobs: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """Q3: newest ``limit`` jobs, *then* filtered by status ('all'/None = no filter)."""
    top = jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return top if status in (None, "all") else top.where(F.col("status") == status)


def job_page_log(pages: DataFrame, job_id: str | None = None) -> DataFrame:
    """Q4: all page columns of a job ordered by ord (all jobs when None)."""
    p = pages if job_id is None else pages.where(F.col("job_id") == job_id)
    return p.orderBy("job_id", "ord")


def page_log_rank(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Q5: 1-based ordinal per job, is_new for the last three pages of a
    running job, display title falling back to the error."""
    w = Window.partitionBy("job_id").orderBy("ord")
    n = F.count(F.lit(1)).over(Window.partitionBy("job_id"))
    j = jobs.select(F.col("id").alias("job_id"), (F.col("status") == "running").alias("_running"))
    p = pages.join(j, "job_id", "left")
    i = F.row_number().over(w)
    return p.select("job_id", "ord", i.cast("long").alias("i"),
                    (F.coalesce("_running", F.lit(False)) & (i > n - 3)).alias("is_new"),
                    F.coalesce("title", "error").alias("display_title"))


def job_avg_duration(pages: DataFrame) -> DataFrame:
    """Q6: per job, Math.round of the mean non-null duration_ms, null if none."""
    return pages.groupBy("job_id").agg(math_round(F.avg("duration_ms")).cast("long").alias("avg_duration_ms"))


def progress_pct(jobs: DataFrame) -> DataFrame:
    """Q7: round(100*scraped/discovered), 0 when nothing was discovered."""
    pct = F.when(F.col("pages_discovered") > 0,
                 math_round(F.col("pages_scraped") * 100.0 / F.col("pages_discovered"))).otherwise(F.lit(0))
    return jobs.select("id", pct.cast("long").alias("progress_pct"))


def job_counts(jobs: DataFrame) -> DataFrame:
    """Q8: count per status, zero-filled for the four known statuses,
    other statuses appended."""
    counts = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    known = jobs.sparkSession.createDataFrame([(s, i) for i, s in enumerate(JOB_STATUSES)],
                                              "status string, known_pos int")
    return known.join(counts, "status", "full_outer").select(
        "status", F.coalesce("n", F.lit(0)).cast("long").alias("jobs"))


def page_totals(jobs: DataFrame) -> DataFrame:
    """Q9: coalesce(sum(pages_scraped), 0), coalesce(sum(pages_failed), 0)."""
    return jobs.agg(F.coalesce(F.sum("pages_scraped"), F.lit(0)).cast("long").alias("pages_scraped"),
                    F.coalesce(F.sum("pages_failed"), F.lit(0)).cast("long").alias("pages_failed"))


def active_monitors(monitors: DataFrame) -> DataFrame:
    """Q10: number of monitors with status 'active'."""
    return monitors.agg(F.count_if(F.col("status") == "active").cast("long").alias("active_monitors"))


def running_jobs(jobs: DataFrame) -> DataFrame:
    """Q11 (list): running jobs."""
    return jobs.where(F.col("status") == "running").select("id", "url", "pages_discovered", "pages_scraped")


def running_count(jobs: DataFrame) -> DataFrame:
    """Q11 (count): number of running jobs, one partial+final aggregate."""
    return jobs.agg(F.count_if(F.col("status") == "running").cast("long").alias("running_count"))


def scrape_stats(log: DataFrame, as_of: str) -> DataFrame:
    """Q12: one pass of conditional aggregates over the scrape log.

    total, today (>= UTC midnight of as_of), total24 (>= as_of - 24h),
    avg_ms = Math.round(mean duration of ok rows in 24 h), 0 when none,
    success_rate = Math.round(100*ok24/total24), 100 when total24 = 0.
    Rows after ``as_of`` are not counted (as_of plays "now").
    """
    now = _ts(as_of)
    seen = log.where(F.col("created_at") <= now)
    in24 = F.col("created_at") >= now - F.expr("INTERVAL 24 HOURS")
    ok24 = in24 & (F.col("status") == "ok")
    a = seen.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("created_at") >= F.date_trunc("day", now)).alias("today"),
        F.count_if(in24).alias("total24"),
        F.avg(F.when(ok24, F.col("duration_ms"))).alias("_avg"),
        F.count_if(ok24).alias("_ok24"))
    return a.select(
        F.col("total").cast("long"), F.col("today").cast("long"), F.col("total24").cast("long"),
        F.coalesce(math_round("_avg"), F.lit(0)).cast("long").alias("avg_ms"),
        F.when(F.col("total24") > 0, math_round(F.col("_ok24") * 100.0 / F.col("total24")))
         .otherwise(F.lit(100)).cast("long").alias("success_rate"))


def engine_mix(log: DataFrame, as_of: str) -> DataFrame:
    """Q13: scrapes per engine over the 24 h before as_of; null -> 'unknown'."""
    now = _ts(as_of)
    w = log.where((F.col("created_at") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("created_at") <= now))
    return w.groupBy(F.coalesce("engine", F.lit("unknown")).alias("engine")) \
            .agg(F.count(F.lit(1)).cast("long").alias("n"))


def browser_share(mix: DataFrame) -> DataFrame:
    """Q14: round(100*browser/(fetch+browser)); 'unknown' excluded; 0 if none."""
    a = mix.agg(F.sum(F.when(F.col("engine") == "browser", F.col("n")).otherwise(0)).alias("b"),
                F.sum(F.when(F.col("engine") == "fetch", F.col("n")).otherwise(0)).alias("f"))
    tot = F.coalesce(F.col("b"), F.lit(0)) + F.coalesce(F.col("f"), F.lit(0))
    return a.select(F.when(tot > 0, math_round(F.col("b") * 100.0 / tot)).otherwise(F.lit(0))
                    .cast("long").alias("browser_pct"))


def recent_scrapes(log: DataFrame, source: str = "all", engine: str = "all", limit: int = 200) -> DataFrame:
    """Q15: newest ``limit`` log rows, *then* filter by source / engine
    ('all' = off; a null engine never matches a named engine)."""
    top = log.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    if source != "all":
        top = top.where(F.col("source") == source)
    if engine != "all":
        top = top.where(F.col("engine") == engine)
    return top


def overview(jobs: DataFrame, log: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Q16: the dashboard's four small result sets."""
    return {
        "stats": scrape_stats(log, as_of),
        "scrapes": recent_scrapes(log.where(F.col("created_at") <= _ts(as_of))).orderBy(
            F.desc("created_at"), F.desc("id")).limit(10),
        "jobs": recent_jobs(jobs).orderBy(F.desc("created_at"), F.desc("id")).limit(8),
        "running": recent_jobs(jobs, "running"),
    }


def retain_logs(logs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Q17: rows kept by retention (created_at >= as_of - days; equal kept).

    A log partitioned by ``created_date`` (``sinks.write_scrape_log``) is read
    from the cutoff's day on; ``sinks.drop_expired`` removes the rest."""
    cutoff = _ts(as_of) - F.make_dt_interval(F.lit(days))
    kept = logs.where(F.col("created_at") >= cutoff)
    return kept.where(F.col("created_date") >= F.to_date(cutoff)) if "created_date" in logs.columns else kept


def job_progress(pages: DataFrame) -> DataFrame:
    """C11: counters derived from page rows (304s count as scraped)."""
    return pages.groupBy("job_id").agg(
        F.count_if(F.col("status") == "scraped").cast("int").alias("pages_scraped"),
        F.count_if(F.col("status") != "scraped").cast("int").alias("pages_failed"),
        F.max("scraped_at").alias("last_heartbeat_at"),
        F.max("ord").alias("last_ord"))


def finalize_jobs(jobs: DataFrame, progress: DataFrame, as_of: str) -> DataFrame:
    """Running jobs end 'failed' when the run recorded an error, else
    'completed'; page failures never fail a job. Counters come from C11."""
    p = progress.withColumnRenamed("job_id", "id")
    j = jobs.join(p.select("id", F.col("pages_scraped").alias("_s"), F.col("pages_failed").alias("_f"),
                           F.col("last_heartbeat_at").alias("_hb")), "id", "left")
    run = F.col("status") == "running"
    return j.select(
        "id",
        F.when(run, F.when(F.col("error").isNotNull(), "failed").otherwise("completed"))
         .otherwise(F.col("status")).alias("status"),
        F.when(run, F.coalesce("_s", F.lit(0))).otherwise(F.col("pages_scraped")).cast("int").alias("pages_scraped"),
        F.when(run, F.coalesce("_f", F.lit(0))).otherwise(F.col("pages_failed")).cast("int").alias("pages_failed"),
        F.when(run, _ts(as_of)).otherwise(F.col("completed_at")).alias("completed_at"),
        F.coalesce("_hb", "last_heartbeat_at").alias("last_heartbeat_at"),
        F.col("error"))


def stale_jobs(jobs: DataFrame, as_of: str) -> DataFrame:
    """C14: running jobs whose heartbeat is older than two minutes
    (a null heartbeat never matches)."""
    cutoff = _ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(STALE_AFTER_SECONDS))
    return jobs.where((F.col("status") == "running") & (F.col("last_heartbeat_at") < cutoff)) \
               .select("id", "url", "last_heartbeat_at")


def resume_jobs(jobs: DataFrame, as_of: str) -> DataFrame:
    """The heartbeat of every stale job (C14) becomes ``as_of``; its
    crawl goes on from its last committed round (``plans.crawl.resume_crawl``)."""
    stale = stale_jobs(jobs, as_of).select("id", F.lit(True).alias("_stale"))
    return jobs.join(stale, "id", "left").withColumn(
        "last_heartbeat_at", F.when(F.col("_stale"), _ts(as_of)).otherwise(F.col("last_heartbeat_at"))).drop("_stale")


def metrics_exposition(jobs: DataFrame, monitors: DataFrame, prefix: str = METRIC_PREFIX) -> DataFrame:
    """K5: the metrics text as (line_no, line) rows; write with
    ``.orderBy('line_no').select('line').write.text``."""
    counts = job_counts(jobs)
    totals = page_totals(jobs)
    active = active_monitors(monitors)
    spark = jobs.sparkSession
    order = spark.createDataFrame([(s, i) for i, s in enumerate(JOB_STATUSES)], "status string, pos int")
    status_lines = counts.join(order, "status", "left").select(
        (F.lit(10) + F.coalesce("pos", F.lit(len(JOB_STATUSES)) + F.dense_rank().over(
            Window.orderBy("status")))).cast("int").alias("line_no"),
        F.format_string(f'{prefix}_jobs_total{{status="%s"}} %d', "status", "jobs").alias("line"))
    fixed = spark.createDataFrame([
        (1, f"# HELP {prefix}_jobs_total Crawl jobs by status"),
        (2, f"# TYPE {prefix}_jobs_total gauge"),
        (100, ""),
        (101, f"# HELP {prefix}_pages_scraped_total Total pages successfully scraped across all jobs"),
        (102, f"# TYPE {prefix}_pages_scraped_total counter"),
        (104, ""),
        (105, f"# HELP {prefix}_pages_failed_total Total pages that failed across all jobs"),
        (106, f"# TYPE {prefix}_pages_failed_total counter"),
        (108, ""),
        (109, f"# HELP {prefix}_monitors_active Active monitors"),
        (110, f"# TYPE {prefix}_monitors_active gauge"),
        (METRICS_LAST_LINE, ""),
    ], "line_no int, line string")
    scraped = totals.select(F.lit(103).alias("line_no"),
                            F.format_string(f"{prefix}_pages_scraped_total %d", "pages_scraped").alias("line"))
    failed = totals.select(F.lit(107).alias("line_no"),
                           F.format_string(f"{prefix}_pages_failed_total %d", "pages_failed").alias("line"))
    act = active.select(F.lit(111).alias("line_no"),
                        F.format_string(f"{prefix}_monitors_active %d", "active_monitors").alias("line"))
    return fixed.unionByName(status_lines).unionByName(scraped).unionByName(failed).unionByName(act)



def write_metrics(lines: DataFrame, path: str) -> None:
    """K5 sink: the exposition text as one file, lines in order. The line
    array ends with an empty element, i.e. the text ends with a newline;
    the text writer already ends every row with one, so that element is
    not written. The frame holds a few dozen rows (bounded by the number
    of job statuses)."""
    body = lines.where(F.col("line_no") != METRICS_LAST_LINE)
    body.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)
