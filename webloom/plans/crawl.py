"""Bounded breadth-first crawl of many jobs at once, resumable.

The reference pops one URL at a time from a FIFO per job. Because
children get depth+1 and the queue is FIFO, pops are ordered by depth and,
inside a level, by (parent position, link position). So processing a
whole level per round, ordering admissions by that pair and cutting with
``row_number`` against ``max_pages`` / ``3*max_pages`` yields the same pages
in the same order. A round is a handful of joins and windows over *all*
jobs; the driver only loops over depth levels (at most 11) and only sees
an emptiness flag.

A crawl lives in one folder of shared storage:

* ``facts``: status, title, links and validators of the captures on the
  jobs' hosts, extracted once, in buckets of the URL. Rounds read these and
  no HTML; HTML is read once more at the end, for the markdown of the pages
  that were crawled.
* ``visited``: every admitted URL, in buckets of (job_id, url). A round
  appends its own rows; its candidates are checked against the table where
  it lies, no stored row moves.
* ``pages-<round>-<attempt>``: a round's page rows.
* ``commits``: one small file a round, written when all its rows are. Rows of
  a round that was cut short carry an attempt that no commit names, and are
  ignored.

The frontier is what the last committed round admitted; backoff deadlines
and the number of visited URLs of a job follow from its rows. So
``resume_crawl`` goes on from the last commit, in this or another session.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import evaluate_once, normalize_url, parse_url_parts, url_host, url_origin_of
from ..operators import crawl as C
from ..operators import extract as X
from ..session import fresh_dir
from ..sources import folders
from ..sources.buckets import BucketTable

NO_CAPTURE = "no capture for URL"
NO_RENDERING = "no rendering captured"
FEW_HOSTS = 10_000      # hosts up to which they are sent to all tasks (under 1 MB)
BUCKET_ROWS = 20_000    # facts or visited URLs that a bucket is meant for


@dataclass
class CrawlResult:
    pages: DataFrame        # job_pages rows (+ depth)
    visited: DataFrame      # (job_id, url, depth, ord): every admitted URL
    jobs: DataFrame         # finished job rows with derived counters
    rounds: int             # rounds committed so far
    store: str              # folder that resume_crawl takes
    validators: DataFrame   # (job_id, url, etag, last_modified) of the fetched pages


def _materialize(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def seed_frontier(jobs: DataFrame, sitemaps: DataFrame | None, rules: DataFrame | None):
    """Sitemap candidates at depth 0 in order, else the normalised
    root. Returns (frontier, jobs with uses_sitemap flag)."""
    if sitemaps is not None:
        sm = C.discover_from_sitemap(jobs, sitemaps, rules)
        sm = _materialize(sm, fresh_dir(jobs.sparkSession, "sitemap-seeds"))
        sm_seeds = sm.select("job_id", "url", F.lit(0).alias("depth"), F.col("n").cast("long").alias("ord"))
        flag = sm.select(F.col("job_id").alias("id")).distinct().withColumn("uses_sitemap", F.lit(True))
        j = jobs.join(flag, "id", "left").withColumn("uses_sitemap", F.coalesce("uses_sitemap", F.lit(False)))
    else:
        sm_seeds = None
        j = jobs.withColumn("uses_sitemap", F.lit(False))
    roots = j.where(~F.col("uses_sitemap")).select(
        F.col("id").alias("job_id"), normalize_url("url", "url").alias("url"),
        F.lit(0).alias("depth"), F.lit(1).cast("long").alias("ord")).where(F.col("url").isNotNull())
    frontier = roots if sm_seeds is None else sm_seeds.unionByName(roots)
    return frontier, j



_FACTS = ["url", "status", "unchanged", "error", "title", "links", "fetched_at", "duration_ms", "etag", "last_modified"]
_RENDERED = ["status", "error", "title", "links", "fetched_at", "duration_ms"]


def _on_hosts(captures: DataFrame, hosts: DataFrame, few: bool) -> DataFrame:
    """Captures (or their facts) on the given hosts; in a store of host
    buckets only those buckets are read."""
    hosts = F.broadcast(hosts) if few else hosts
    if "bucket" in captures.columns:
        return captures.join(hosts, ["bucket", "host"], "left_semi")
    keyed = evaluate_once(captures, host=url_host("url"))
    return keyed.join(hosts, "host", "left_semi")


def page_facts(responses: DataFrame, rendered: DataFrame | None, hosts: DataFrame | None = None) -> DataFrame:
    """One row per URL with what a crawl needs of its captures: the plain
    fetch, the rendering (columns ``r_``) and, where both succeeded, whether
    the plain page is thin. ``hosts`` (host) restricts them; many hosts are
    matched after the extraction, so that no HTML is shuffled for them."""
    few = None
    if hosts is not None:
        hosts = hosts.withColumn("bucket", X.host_bucket("host"))
        few = hosts.limit(FEW_HOSTS + 1).count() <= FEW_HOSTS

    def facts(captures, keep):
        stored = [c for c in ("bucket", "host") if c in captures.columns]
        if few:
            captures = _on_hosts(captures, hosts, True)
        out = X.scrape_pages(captures, keep=tuple(keep) + tuple(stored), with_markdown=False)
        return _on_hosts(out, hosts, False) if few is False else out

    plain = facts(responses, ["fetched_at", "duration_ms", "etag", "last_modified"]).select(*_FACTS)
    if rendered is None:
        return plain.select("*", *[F.lit(None).cast(plain.schema[c].dataType).alias("r_" + c) for c in _RENDERED],
                            F.lit(False).alias("thin"))
    other = facts(rendered, ["fetched_at", "duration_ms"]).select("url", *[F.col(c).alias("r_" + c) for c in _RENDERED])
    both = plain.where((F.col("status") == "scraped") & ~F.col("unchanged")).select("url") \
        .join(other.where(F.col("r_status") == "scraped").select("url"), "url", "left_semi")
    thin = X.captures_of(responses, both.distinct()).select("url", X.is_thin(X.html_to_markdown(F.col("html"))).alias("thin")) \
        .dropDuplicates(["url"])
    return plain.join(other, "url", "full_outer").join(thin, "url", "left").withColumn("thin", F.coalesce("thin", F.lit(False)))


def _fetch_round(proc: DataFrame, facts: DataFrame, cfg: DataFrame, validators: DataFrame | None) -> DataFrame:
    """This round's URLs with the facts of the capture that each is taken from.

    A stored validator that the capture still carries makes the plain fetch
    a 304. ``fetch`` jobs take the plain capture, ``browser`` jobs the
    rendering, ``auto`` jobs the plain one unless it is blocked, thin or
    unchanged (no content counts as thin) and a rendering succeeded."""
    got = proc.join(cfg.select(F.col("id").alias("job_id"), F.col("engine").alias("asked"), "has_renderings"), "job_id") \
              .join(facts, "url", "left")
    missing = F.col("status").isNull()
    fresh = F.coalesce(F.col("unchanged"), F.lit(False))
    if validators is not None:
        sent = validators.select("job_id", "url", F.col("if_none_match").alias("_etag"), F.col("if_modified_since").alias("_since"))
        got = got.join(sent, ["job_id", "url"], "left")
        same = F.when(F.col("_etag").isNotNull(), F.col("_etag").eqNullSafe(F.col("etag"))) \
                .otherwise(F.col("_since").isNotNull() & F.col("_since").eqNullSafe(F.col("last_modified")))
        fresh = fresh | (F.coalesce(F.col("status") == "scraped", F.lit(False)) & same)
    got = got.withColumn("error", F.when(missing, F.lit(NO_CAPTURE)).otherwise(F.col("error"))) \
             .withColumn("status", F.coalesce("status", F.lit("error"))).withColumn("unchanged", fresh)
    r_ok = F.coalesce(F.col("r_status") == "scraped", F.lit(False))
    browser = F.col("has_renderings") & (F.col("asked") == "browser")
    tried = F.col("has_renderings") & (F.col("asked") == "auto") & (
        (F.col("status") == "blocked") | ((F.col("status") == "scraped") & (F.col("unchanged") | F.coalesce("thin", F.lit(False)))))
    use = browser | (tried & r_ok)
    took = F.when(browser, F.col("r_duration_ms")).when(tried, F.coalesce(F.col("duration_ms") + F.col("r_duration_ms"), F.col("duration_ms"))) \
            .otherwise(F.col("duration_ms"))
    return got.select(
        "job_id", "ord", "url", "depth",
        F.when(use, F.when(r_ok, "scraped").otherwise("error")).otherwise(F.col("status")).alias("status"),
        F.when(use, F.lit(False)).otherwise(F.col("unchanged")).alias("unchanged"),
        F.when(use, F.when(~r_ok, F.coalesce("r_error", F.lit(NO_RENDERING)))).otherwise(F.col("error")).alias("error"),
        F.when(use, F.col("r_title")).when(~F.col("unchanged"), F.col("title")).alias("title"),
        F.when(use & r_ok, F.lit("browser")).otherwise(F.lit("fetch")).alias("engine"),
        F.coalesce("fetched_at", "r_fetched_at").alias("fetched_at"), took.alias("duration_ms"),
        F.when(~use, F.col("etag")).alias("etag"), F.when(~use, F.col("last_modified")).alias("last_modified")) \
        .withColumn("blocked", F.col("status") == "blocked")


def stage_captures(responses: DataFrame) -> DataFrame:
    """Write captures in buckets of hosts under the checkpoint root and read
    them back, so every crawl round prunes to the buckets of its hosts. A
    range partitioning by (bucket, host, url) cuts a host with many pages
    into as many files as it needs and keeps each file's URLs together."""
    spark = responses.sparkSession
    path = fresh_dir(spark, "captures")
    keyed = responses.withColumn("host", url_host("url")).withColumn("bucket", X.host_bucket("host"))
    keyed.repartitionByRange("bucket", "host", "url").sortWithinPartitions("bucket", "host", "url") \
         .write.partitionBy("bucket").parquet(path)
    return spark.read.parquet(path)


def _linked(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Scraped page rows with the links of the capture they were taken from."""
    links = F.when(F.col("engine") == "browser", F.col("r_links")).otherwise(F.col("links"))
    open_ = rows.where("status = 'scraped'").select("job_id", "ord", "url", "depth", "status", "unchanged", "engine")
    return open_.join(facts.select("url", "links", "r_links"), "url").withColumn("links", links).drop("r_links")


VISITED = "job_id string, url string, depth int, ord bigint, processable boolean, round int, attempt string"
_PAGE = ["url", "depth", "status", "unchanged", "error", "title", "engine", "duration_ms", "etag", "last_modified"]


class _Store:
    """The folder of a crawl."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = {c["round"]: c for c in folders.get_jsons(spark, f"{self.root}/commits")}
        if self.commits:
            self.deal(self.commits[0]["buckets"])

    def deal(self, n: int) -> None:
        self.buckets = n
        self.facts = BucketTable(self.spark, f"{self.root}/facts", ["url"], n)
        self.visited = BucketTable(self.spark, f"{self.root}/visited", ["job_id", "url"], n)

    def deal_for(self, rows: int) -> None:
        """Buckets for so many rows. Every round has a task or more a bucket,
        so small crawls take fewer than there are shuffle partitions."""
        most, cores = int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism
        self.deal(min(most, max(cores, -(-rows // BUCKET_ROWS))))

    def table(self, name: str, df: DataFrame | None = None) -> DataFrame:
        return _materialize(df, f"{self.root}/{name}") if df is not None else self.spark.read.parquet(f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        return name in self.commits[0]["tables"]

    def commit(self, rnd: int, attempt: str, **more) -> None:
        value = {"round": rnd, "attempt": attempt, "buckets": self.buckets, **more}
        folders.put_json(self.spark, f"{self.root}/commits/{rnd:04d}.json", value)
        self.commits[rnd] = value

    def admitted(self) -> DataFrame:
        """Rows of committed rounds; the others belong to a round cut short."""
        return self.visited.read().where(F.col("attempt").isin([c["attempt"] for c in self.commits.values()]))

    def pages(self, rnd: int) -> str:
        return f"{self.root}/pages-{rnd}-{self.commits[rnd]['attempt']}"


def crawl(spark: SparkSession, jobs: DataFrame, responses: DataFrame, sitemaps: DataFrame | None = None,
          robots: DataFrame | None = None, expand_unchanged: bool = False, max_rounds: int | None = None,
          rendered: DataFrame | None = None, validators: DataFrame | None = None,
          failures: DataFrame | None = None, store: str | None = None) -> CrawlResult:
    """Run every job of ``jobs`` (validated requests) to completion, or for
    ``max_rounds`` rounds. A job outside of C1's bounds is an error, never cut.

    ``rendered`` (optional) holds browser renderings; jobs then follow
    their ``engine`` (fetch / browser / auto, default auto). Without it
    every page is a plain fetch, as when no browser is configured.
    ``validators`` (job_id, url, if_none_match, if_modified_since) are sent
    with the plain fetches. ``failures`` (job_id, error) names runs that broke
    off: they end ``failed`` with zero counters, the other jobs are not
    touched, and pages written before stay. ``store`` is a new folder of
    shared storage that ``resume_crawl`` can go on from."""
    root = store or fresh_dir(spark, "crawl")
    in_bounds = F.col("max_depth").between(C.DEPTH_MIN, C.DEPTH_MAX) & F.col("max_pages").between(C.PAGES_MIN, C.PAGES_MAX)
    if not jobs.where(~F.coalesce(in_bounds, F.lit(False))).isEmpty():
        raise ValueError("jobs outside of the bounds of validate_crawl_requests")
    at = _Store(spark, root)
    if at.commits:
        raise ValueError(f"{root} holds a crawl already; resume_crawl goes on with it")
    given = {"sitemaps": sitemaps, "rules": C.robots_rules(robots) if robots is not None else None,
             "validators": validators, "failures": failures}
    tables = {k: at.table(k, v) for k, v in given.items() if v is not None}
    jobs = evaluate_once(jobs, _sp=parse_url_parts("url"))
    jobs = at.table("requests", jobs.select("*", F.col("_sp.host").alias("seed_host"),
                                            url_origin_of(F.col("_sp")).alias("seed_origin")).drop("_sp"))
    frontier, cfg = seed_frontier(jobs, tables.get("sitemaps"), tables.get("rules"))
    engine = F.col("engine") if "engine" in cfg.columns else F.lit("auto")
    cfg = at.table("jobs", cfg.select("id", "url", "seed_host", "seed_origin", "max_depth", "max_pages",
                                      "include_patterns", "exclude_patterns", "uses_sitemap", "webhook_url",
                                      F.coalesce(engine, F.lit("auto")).alias("engine"), F.lit(rendered is not None).alias("has_renderings")))
    hosts = cfg.where("seed_host is not null").select(F.col("seed_host").alias("host")).distinct()
    extracted = at.table("extracted", page_facts(responses, rendered, hosts))
    urls = cfg.agg(F.sum("max_pages")).first()[0] or 0
    at.deal_for(max(extracted.count(), urls * C.DISCOVERY_FACTOR))
    at.facts.append(extracted)
    folders.delete(spark, f"{at.root}/extracted")
    attempt = uuid.uuid4().hex
    # seeds are always within budget (sitemap seeds are cut to max_pages)
    at.visited.append(frontier.select("job_id", "url", "depth", "ord", F.lit(True).alias("processable"),
                                      F.lit(0).alias("round"), F.lit(attempt).alias("attempt")))
    at.commit(0, attempt, tables=sorted(tables), expand_unchanged=bool(expand_unchanged), facts=at.facts.read()._jdf.schema().toDDL())
    return _advance(at, responses, rendered, max_rounds, keep=store is not None)


def resume_crawl(spark: SparkSession, store: str, responses: DataFrame, rendered: DataFrame | None = None,
                 max_rounds: int | None = None) -> CrawlResult:
    """Go on with the crawl in ``store`` from its last committed round.
    ``responses`` and ``rendered`` are read for markdown only."""
    at = _Store(spark, store)
    if not at.commits:
        raise ValueError(f"no crawl in {store}")
    at.facts.attach(at.commits[0]["facts"])
    at.visited.attach(VISITED)
    return _advance(at, responses, rendered, max_rounds, keep=True)


def _advance(at: _Store, responses: DataFrame, rendered: DataFrame | None, max_rounds: int | None, keep: bool) -> CrawlResult:
    cfg = at.table("jobs")
    rules, validators, failures = (at.table(k) if at.has(k) else None for k in ("rules", "validators", "failures"))
    expand_unchanged = at.commits[0]["expand_unchanged"]
    facts = at.facts.read()
    done = 0
    while max_rounds is None or done < max_rounds:
        last = max(at.commits)
        if last > C.DEPTH_MAX:
            break
        admitted = at.admitted()
        newest = admitted.where(F.col("attempt") == at.commits[last]["attempt"]).drop("round", "attempt")
        proc = newest.where("processable").drop("processable")          # C6
        if proc.isEmpty():      # the only value that reaches the driver
            break
        rnd, attempt = last + 1, uuid.uuid4().hex
        fetched = _fetch_round(proc, facts, cfg, validators)
        # the backoff fold carries a page's small columns, not its links
        state = None
        if last:
            state = at.spark.read.parquet(at.pages(last)).groupBy("job_id").agg(F.max_by("backoff_until", "ord").alias("backoff_until"))
        bo = C.apply_backoff(fetched, state, carry=tuple(_PAGE))
        skip = F.col("skipped")
        rows = bo.select(
            "job_id", "ord", "url", "depth", "skipped", "backoff_until", "fetched_at", "duration_ms",
            F.when(skip, "blocked").otherwise(F.col("status")).alias("status"),
            F.when(skip, False).otherwise(F.col("unchanged")).alias("unchanged"),
            F.when(skip, F.lit(C.BACKOFF_MESSAGE)).otherwise(F.col("error")).alias("error"),
            *[F.when(~skip, F.col(c)).alias(c) for c in ("engine", "title", "etag", "last_modified")])
        rows = _materialize(rows, f"{at.root}/pages-{rnd}-{attempt}")
        cands = C.expand_links(_linked(rows, facts), cfg, rules, expand_unchanged)
        # a job's positions run on, so the newest one counts its visited URLs
        seen = newest.groupBy("job_id").agg(F.max("ord").alias("n_visited"))
        new = C.admit_new(cands, admitted, cfg, seen)
        at.visited.append(new.select("job_id", "url", "depth", "ord", "processable", F.lit(rnd).alias("round"), F.lit(attempt).alias("attempt")))
        at.commit(rnd, attempt)
        done += 1
    return _result(at, cfg, responses, rendered, failures, keep)


def _result(at: _Store, cfg: DataFrame, responses: DataFrame, rendered: DataFrame | None, failures: DataFrame | None,
            keep: bool) -> CrawlResult:
    spark, rounds = at.spark, max(at.commits)
    if rounds:
        rows = spark.read.parquet(*[at.pages(r) for r in range(1, rounds + 1)])
        # markdown only for scraped pages, once per distinct URL, after the
        # loop, from the capture each page was taken from
        if rendered is None:
            with_md = X.attach_markdown(rows, responses)
        else:
            by_browser = F.coalesce(F.col("engine") == "browser", F.lit(False))
            with_md = X.attach_markdown(rows.where(~by_browser), responses) \
                       .unionByName(X.attach_markdown(rows.where(by_browser), rendered))
        pages = C.page_results(with_md)
        validators = rows.where("status = 'scraped' and not unchanged").select("job_id", "url", "etag", "last_modified")
    else:
        from .. import schemas
        pages = spark.createDataFrame([], schemas.JOB_PAGES + ", depth int")
        validators = spark.createDataFrame([], "job_id string, url string, etag string, last_modified string")
    at.facts.detach()
    attempts = [c["attempt"] for c in at.commits.values()]
    visited = at.visited.detach().where(F.col("attempt").isin(attempts)).drop("round", "attempt", "processable")
    if not keep:        # nothing that is returned reads the facts
        folders.delete(spark, at.facts.path)
    discovered = visited.groupBy("job_id").agg(F.count(F.lit(1)).cast("int").alias("pages_discovered"))
    progress = pages.groupBy("job_id").agg(
        F.count_if(F.col("status") == "scraped").cast("int").alias("pages_scraped"),
        F.count_if(F.col("status") != "scraped").cast("int").alias("pages_failed"),
        F.max("scraped_at").alias("last_heartbeat_at"))
    none = spark.createDataFrame([], "job_id string, error string")
    broken = (none if failures is None else failures).groupBy("job_id").agg(F.first("error").alias("error"))
    done = cfg.withColumnRenamed("id", "job_id").join(discovered, "job_id", "left").join(progress, "job_id", "left") \
              .join(broken.withColumn("broke", F.lit(True)), "job_id", "left")
    broke = F.coalesce("broke", F.lit(False))
    count = lambda c: F.when(broke, F.lit(0)).otherwise(F.coalesce(c, F.lit(0)))
    finished = done.select(
        F.col("job_id").alias("id"), F.when(broke, "failed").otherwise("completed").alias("status"), "url", "webhook_url",
        F.coalesce("pages_discovered", F.lit(0)).alias("pages_discovered"),
        count("pages_scraped").alias("pages_scraped"), count("pages_failed").alias("pages_failed"),
        "last_heartbeat_at", F.when(broke, F.coalesce("error", F.lit("unknown error"))).alias("error"),
        (F.coalesce("pages_scraped", F.lit(0)) + F.coalesce("pages_failed", F.lit(0)) == 0).alias("root_failed"))
    return CrawlResult(pages=pages, visited=visited, jobs=finished, rounds=rounds, store=at.root, validators=validators)
