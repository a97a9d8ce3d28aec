"""Change monitoring: M1-M15 and the monitor outbox K4.

Keyed everything by (monitor_id, url): the snapshot join, the upsert and
the per-line counts all partition on that key, so a monitor with a third
of all pages is still spread over many tasks. Old markdown is only read
for pages whose hash changed (late materialisation: a hash-only join
first, then the text join on the changed keys).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from . import crawl as C
from . import llm as L
from ..session import fresh_dir
from .diff import render_line_diff

# Fixed values.
FREQUENCIES = ("hourly", "daily", "weekly")
ACTIONS = {"pause": "paused", "resume": "active", "delete": "deleted"}


def create_monitors(req: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M1: as C1 plus frequency (default daily, one of hourly/daily/weekly),
    a *required* webhook URL and an optional goal. Returns (monitors, rejected)."""
    valid, rejected = C.validate_crawl_requests(req.drop("frequency", "goal"))
    extra = req.select("id", "frequency", "goal")
    freq = F.coalesce("frequency", F.lit("daily"))
    v = valid.join(extra, "id").withColumn("frequency", freq)
    bad = ~F.col("frequency").isin(*FREQUENCIES) | F.col("webhook_url").isNull()
    ok = v.where(~bad).select(
        "id", "url", "max_depth", "max_pages", "include_patterns", "exclude_patterns", "frequency",
        "webhook_url", F.lit("active").alias("status"), "goal",
        F.lit(None).cast("timestamp_ntz").alias("last_checked_at"),
        F.lit(None).cast("string").alias("last_job_id"), "created_at")
    rej = v.where(bad).select("id").unionByName(rejected.select("id"))
    return ok, rej


def list_monitors(monitors: DataFrame) -> DataFrame:
    """M2: all monitors (deleted included), newest first."""
    return monitors.orderBy(F.desc("created_at"), F.desc("id"))


def transition_monitors(monitors: DataFrame, commands: DataFrame) -> DataFrame:
    """M3: apply (monitor_id, seq, action) commands; the last one per
    monitor wins; pause/resume/delete are plain status writes (soft delete)."""
    w = Window.partitionBy("monitor_id").orderBy(F.desc("seq"))
    last = commands.where(F.col("action").isin(*ACTIONS)) \
                   .withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    mapping = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    last = last.select(F.col("monitor_id").alias("id"), mapping[F.col("action")].alias("_new"))
    return monitors.join(last, "id", "left") \
                   .withColumn("status", F.coalesce("_new", "status")).drop("_new")


def due_monitors(monitors: DataFrame, as_of: str) -> DataFrame:
    """M4: active monitors whose latest schedule tick (hourly at :00, daily
    at 00:00, weekly Sunday 00:00, unknown -> daily) is after their last
    check (never checked = due)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    day = F.date_trunc("day", now)
    sunday = day - F.make_dt_interval(F.dayofweek(now) - 1)
    tick = (F.when(F.col("frequency") == "hourly", F.date_trunc("hour", now))
            .when(F.col("frequency") == "weekly", sunday).otherwise(day))
    return monitors.where((F.col("status") == "active")
                          & (F.col("last_checked_at").isNull() | (F.col("last_checked_at") < tick))) \
                   .withColumn("tick", tick.cast("timestamp_ntz"))


def content_hash(markdown) -> F.Column:
    """M5: SHA-256 hex of the markdown's UTF-8 bytes."""
    return F.sha2(F.col(markdown) if isinstance(markdown, str) else markdown, 256)


def snapshot_state(prev: DataFrame) -> DataFrame:
    """monitor_pages rows from a previous snapshot (monitor_id, url, markdown,
    etag, checked_at; last_modified where it has one)."""
    return prev.select("monitor_id", "url", content_hash("markdown").alias("last_content_hash"),
                       F.col("markdown").alias("last_markdown"), F.col("etag").alias("last_etag"),
                       _last_modified(prev), F.col("checked_at").alias("last_checked_at"))


def _last_modified(pages: DataFrame) -> Column:
    has = "last_modified" in pages.columns
    return (F.col("last_modified") if has else F.lit(None)).cast("string").alias("last_modified")


def conditional_requests(urls: DataFrame, state: DataFrame) -> DataFrame:
    """M6: the validators to send with each (monitor_id, url): its stored
    etag as If-None-Match and last_modified as If-Modified-Since; null for a
    page not seen before or stored without them."""
    stored = state.select("monitor_id", "url", "last_etag", "last_modified")

    def header(c):
        return F.when(F.col(c) != "", F.col(c))

    return urls.select("monitor_id", "url").join(stored, ["monitor_id", "url"], "left").select(
        "monitor_id", "url", header("last_etag").alias("if_none_match"), header("last_modified").alias("if_modified_since"))


def changed_pages(cur: DataFrame, state: DataFrame) -> DataFrame:
    """M6 + M7: pages of this run whose hash differs from a stored hash.

    304 answers (conditional fetch) are unchanged by definition; a first
    sighting is not a change; vanished pages are not reported. The join
    sees keys and hashes only; the changed keys are written once, and both
    texts are fetched for them alone."""
    keys = ["monitor_id", "url"]
    fetched = cur.where(F.col("http_status") == 200).select(*keys, "markdown", content_hash("markdown").alias("hash"))
    hashes = state.select(*keys, F.col("last_content_hash").alias("prev_hash"))
    path = fresh_dir(cur.sparkSession, "changed-keys")
    fetched.select(*keys, "hash").join(hashes, keys) \
        .where(F.col("prev_hash").isNotNull() & (F.col("prev_hash") != F.col("hash"))).distinct().write.parquet(path)
    ch = cur.sparkSession.read.parquet(path)
    old = state.select(*keys, F.col("last_markdown").alias("old_markdown")).join(ch.select(*keys).distinct(), keys, "left_semi")
    return fetched.join(ch, keys + ["hash"]).join(old, keys, "left") \
        .select(*keys, "prev_hash", "hash", F.coalesce("old_markdown", F.lit("")).alias("old_markdown"),
                F.col("markdown").alias("new_markdown"))


@pandas_udf(StringType())
def _diff_udf(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([render_line_diff(o or "", n or "") for o, n in zip(old, new)])


def line_diff(changed: DataFrame) -> DataFrame:
    """M8: '+'/'-' prefixed added/removed chunks (one prefix per chunk),
    concatenated; Arrow-batched over the changed rows only."""
    return changed.withColumn("diff", _diff_udf(F.col("old_markdown"), F.col("new_markdown")))


def _lines(text_col: str) -> F.Column:
    # Line tokens keep their newline; a final empty token is dropped.
    return F.filter(F.regexp_extract_all(F.col(text_col), F.lit(r"([^\n]*\n|[^\n]+$)"), 1), lambda x: x != "")


def line_change_counts(changed: DataFrame) -> DataFrame:
    """M9: per changed page and distinct line, new count - old count
    (the multiset difference every correct line diff must realise)."""
    keys = ["monitor_id", "url"]
    old = changed.select(*keys, F.explode(_lines("old_markdown")).alias("line")) \
                 .groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("n_old"))
    new = changed.select(*keys, F.explode(_lines("new_markdown")).alias("line")) \
                 .groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("n_new"))
    j = old.join(new, keys + ["line"], "full_outer")
    net = (F.coalesce("n_new", F.lit(0)) - F.coalesce("n_old", F.lit(0))).cast("long")
    return j.select(*keys, "line", net.alias("net")).where(F.col("net") != 0)


def line_change_totals(counts: DataFrame) -> DataFrame:
    """M9 (page level): lines added / removed per changed page."""
    return counts.groupBy("monitor_id", "url").agg(
        F.sum(F.when(F.col("net") > 0, F.col("net")).otherwise(0)).cast("long").alias("lines_added"),
        F.sum(F.when(F.col("net") < 0, -F.col("net")).otherwise(0)).cast("long").alias("lines_removed"))


def upsert_monitor_pages(state: DataFrame, cur: DataFrame) -> DataFrame:
    """Every fetched 200 overwrites (hash, markdown, etag,
    last_modified, last_checked_at) of its (monitor_id, url), changed or
    not; 304s and other statuses leave the stored row alone. Anti-join +
    union gives the new snapshot version (a MERGE sink can replace it)."""
    upd = cur.where(F.col("http_status") == 200).select(
        "monitor_id", "url", content_hash("markdown").alias("last_content_hash"),
        F.col("markdown").alias("last_markdown"), F.col("etag").alias("last_etag"),
        _last_modified(cur), F.col("checked_at").alias("last_checked_at"))
    keep = state.join(upd.select("monitor_id", "url"), ["monitor_id", "url"], "left_anti")
    return keep.unionByName(upd)


def check_id(monitor_id, run_at: str) -> F.Column:
    """Deterministic run key: first 16 hex of sha256(monitor_id || '@' || run_at)."""
    return F.substring(F.sha2(F.concat(monitor_id, F.lit("@" + run_at)), 256), 1, 16)


def check_summary(monitors: DataFrame, cur: DataFrame, changed: DataFrame, run_at: str) -> DataFrame:
    """One row per monitor run - pages_checked = scraped pages
    (200 and 304), pages_changed = all changes before judging; zeros when
    nothing was fetched."""
    checked = cur.where(F.col("http_status").isin(200, 304)).groupBy("monitor_id") \
                 .agg(F.count(F.lit(1)).alias("pages_checked"))
    ch = changed.groupBy("monitor_id").agg(F.count(F.lit(1)).alias("pages_changed"))
    m = monitors.select(F.col("id").alias("monitor_id"))
    out = m.join(checked, "monitor_id", "left").join(ch, "monitor_id", "left")
    return out.select(check_id(F.col("monitor_id"), run_at).alias("check_id"), "monitor_id",
                      check_id(F.col("monitor_id"), run_at + "#job").alias("job_id"),
                      F.coalesce("pages_checked", F.lit(0)).cast("int").alias("pages_checked"),
                      F.coalesce("pages_changed", F.lit(0)).cast("int").alias("pages_changed"),
                      F.lit(run_at).cast("timestamp_ntz").alias("checked_at"))


def change_records(diffs: DataFrame, run_at: str) -> DataFrame:
    """One monitor_changes row per changed page, keyed to its check."""
    return diffs.select(check_id(F.col("monitor_id"), run_at).alias("check_id"), "monitor_id", "url", "diff",
                        F.lit(run_at).cast("timestamp_ntz").alias("changed_at"))


def has_goal(goal) -> Column:
    """A goal counts if it is neither null nor empty."""
    return F.coalesce(goal != "", F.lit(False))


def judge_prompts(changes: DataFrame, monitors: DataFrame) -> DataFrame:
    """One judging prompt per change of a monitor with a goal."""
    g = monitors.where(has_goal(F.col("goal"))).select(F.col("id").alias("monitor_id"), "goal")
    p = changes.join(g, "monitor_id")
    return p.withColumn("prompt", L.judge_prompt(F.col("goal"), F.col("diff"))) \
            .withColumn("prompt_hash", L.prompt_hash(F.col("prompt")))


def apply_verdicts(changes: DataFrame, monitors: DataFrame, completions: DataFrame) -> DataFrame:
    """Keep a change when its monitor has no goal; otherwise keep it
    if the parsed verdict's ``relevant`` is truthy (with the reason), keep
    it without a verdict when the call failed (an error or no captured
    reply), and drop it when the reply does not parse (reported in
    ``dropped_unparsed``)."""
    goals = monitors.select(F.col("id").alias("monitor_id"), "goal")
    c = changes.join(goals, "monitor_id", "left")
    with_goal = judge_prompts(changes, monitors)
    replies = L.complete(with_goal, completions, 1)
    v = L.parse_llm_json(F.col("reply"))
    judged = replies.select(
        "monitor_id", "url", "diff", "goal", F.col("call_error"), "has_reply",
        F.try_variant_get(v, "$.relevant", "variant").alias("_rel"),
        F.try_variant_get(v, "$.reason", "string").alias("reason"), v.isNull().alias("_unparsed"))
    # a call error, or no reply captured at all, is a failed call
    failed = F.col("call_error").isNotNull() | ~F.col("has_reply")
    relevant = L.is_truthy(F.col("_rel"))
    judged = judged.select(
        "monitor_id", "url", "diff", "goal",
        F.when(failed, F.lit(None).cast("boolean")).otherwise(F.lit(True)).alias("relevant"),
        F.when(failed, F.lit(None).cast("string")).otherwise(F.col("reason")).alias("reason"),
        (failed | relevant).alias("keep"),
        (~failed & F.col("_unparsed")).alias("dropped_unparsed"))
    no_goal = c.where(~has_goal(F.col("goal"))).select(
        "monitor_id", "url", "diff", "goal", F.lit(None).cast("boolean").alias("relevant"),
        F.lit(None).cast("string").alias("reason"), F.lit(True).alias("keep"),
        F.lit(False).alias("dropped_unparsed"))
    return judged.unionByName(no_goal)


def touch_monitors(monitors: DataFrame, checks: DataFrame) -> DataFrame:
    """last_checked_at / last_job_id from each monitor's latest check."""
    last = checks.groupBy("monitor_id").agg(F.max("checked_at").alias("_at"),
                                            F.max_by("job_id", "checked_at").alias("_job"))
    m = monitors.join(last.withColumnRenamed("monitor_id", "id"), "id", "left")
    return m.withColumn("last_checked_at", F.coalesce("_at", "last_checked_at")) \
            .withColumn("last_job_id", F.coalesce("_job", "last_job_id")).drop("_at", "_job")


def monitor_outbox(verdicts: DataFrame, checks: DataFrame, monitors: DataFrame, run_at: str) -> DataFrame:
    """K4: one payload per monitor with at least one kept change;
    pages-changed counts kept changes; goal/relevant/reason only when the
    monitor has a goal (relevant defaults to true). ``to_json`` omits null
    fields, which is how absent keys disappear. A payload holds one
    monitor's changes of one run (bounded by its max_pages)."""
    kept = verdicts.where(F.col("keep"))
    kept = kept.withColumn("goal", F.when(has_goal(F.col("goal")), F.col("goal")))
    judged = F.col("goal").isNotNull()
    item = F.struct("url", "diff", F.when(judged, F.coalesce("relevant", F.lit(True))).alias("relevant"),
                    F.when(judged, F.col("reason")).alias("reason"))
    g = kept.groupBy("monitor_id", "goal").agg(F.sort_array(F.collect_list(item)).alias("changes"),
                                               F.count(F.lit(1)).alias("n"))
    g = g.join(checks.select("monitor_id", "pages_checked"), "monitor_id") \
         .join(monitors.select(F.col("id").alias("monitor_id"), "webhook_url"), "monitor_id")
    payload = F.to_json(F.struct(
        F.col("monitor_id").alias("monitor-id"),
        F.date_format(F.lit(run_at).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("checked-at"),
        F.col("pages_checked").alias("pages-checked"), F.col("n").alias("pages-changed"),
        F.col("goal"), F.col("changes")))
    return g.select("monitor_id", "webhook_url", F.col("n").cast("long").alias("pages_changed"),
                    payload.alias("payload"))


def monitor_runs(verdicts: DataFrame, checks: DataFrame, monitors: DataFrame, run_at: str) -> DataFrame:
    """One row per monitor run with all its judged changes (at most its
    max_pages), for ``run_outbox`` and ``run_changes``."""
    item = F.struct("url", "diff", "relevant", "reason", "keep")
    changes = verdicts.groupBy("monitor_id").agg(F.sort_array(F.collect_list(item)).alias("changes"))
    return checks.join(changes, "monitor_id", "left") \
        .join(monitors.select(F.col("id").alias("monitor_id"), "webhook_url", "goal"), "monitor_id") \
        .select("monitor_id", "check_id", F.lit(run_at).cast("timestamp_ntz").alias("run_at"), "webhook_url", "goal", "pages_checked",
                F.coalesce("changes", F.array().cast("array<struct<url:string,diff:string,relevant:boolean,reason:string,keep:boolean>>")).alias("changes"))


def run_outbox(runs: DataFrame) -> DataFrame:
    """K4 of whole run rows: the payload of ``monitor_outbox``, with a batch
    key (check_id) and no shuffle."""
    judged = has_goal(F.col("goal"))
    kept = F.filter("changes", lambda c: c["keep"])
    item = F.transform("kept", lambda c: F.struct(
        c["url"].alias("url"), c["diff"].alias("diff"), F.when(judged, F.coalesce(c["relevant"], F.lit(True))).alias("relevant"),
        F.when(judged, c["reason"]).alias("reason")))
    payload = F.to_json(F.struct(
        F.col("monitor_id").alias("monitor-id"), F.date_format("run_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("checked-at"),
        F.col("pages_checked").alias("pages-checked"), F.size("kept").cast("long").alias("pages-changed"),
        F.when(judged, F.col("goal")).alias("goal"), item.alias("changes")))
    return runs.withColumn("kept", kept).where(F.size("kept") > 0).select(
        "monitor_id", "check_id", "webhook_url", F.size("kept").cast("long").alias("pages_changed"), payload.alias("payload"))


def run_changes(runs: DataFrame) -> DataFrame:
    """M12 of whole run rows: one change row per changed page, judged away or not."""
    return runs.select("check_id", "monitor_id", F.explode("changes").alias("c"), F.col("run_at").alias("changed_at")) \
               .select("check_id", "monitor_id", "c.url", "c.diff", "changed_at")
