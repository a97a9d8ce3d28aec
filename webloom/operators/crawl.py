"""Crawl operators: S3-S6, U5, U6, C1-C6, C8-C10, C13, C15, K3.

Every operator is keyed by job (and URL), so the work spreads with the
number of jobs and URLs; a single huge job is spread too, because the
candidate collapse (U6) and the visited anti-join (C5) are keyed by
(job_id, url) and only the final rank is per job - over at most
``3 * max_pages`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import lag_within, row_number_within
from ..functions.urls import (allowed_path, canonical_parts, evaluate_once, normalize_url, parse_url_parts, url_host,
                             url_origin, url_origin_of, wildcard_match)

# Fixed values (request validation bounds and crawler constants).
DEPTH_MIN, DEPTH_MAX, DEPTH_DEFAULT = 1, 10, 2
PAGES_MIN, PAGES_MAX, PAGES_DEFAULT = 1, 1000, 100
ENGINES = ("fetch", "browser", "auto")
DISCOVERY_FACTOR = 3
BACKOFF_STEP_SECONDS = 30
POLITENESS_MS = 300
USER_AGENT = "Webloom/0.1 (web corpus engine)"   # the package's own token; a parameter of robots_rules
BACKOFF_MESSAGE = "Domain in backoff window"


# ------------------------------------------------------------------ C1 / C2

def validate_crawl_requests(req: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected). Defaults: depth 2, pages 100, patterns [],
    engine auto. url must carry a protocol; depth 1..10; pages 1..1000;
    engine in fetch/browser/auto; webhook optional but must be a URL."""
    url_ok = F.col("url").isNotNull() & F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^\s/?#]+")
    d = F.coalesce(F.col("max_depth"), F.lit(DEPTH_DEFAULT))
    p = F.coalesce(F.col("max_pages"), F.lit(PAGES_DEFAULT))
    e = F.coalesce(F.col("engine"), F.lit("auto"))
    hook_ok = F.col("webhook_url").isNull() | F.col("webhook_url").rlike(r"^https?://[^\s/?#]+")
    errors = F.filter(F.array(
        F.when(~url_ok, F.lit("url must be a URL address with protocol")),
        F.when((d < DEPTH_MIN) | (d > DEPTH_MAX), F.lit("max-depth must be between 1 and 10")),
        F.when((p < PAGES_MIN) | (p > PAGES_MAX), F.lit("max-pages must be between 1 and 1000")),
        F.when(~e.isin(*ENGINES), F.lit("engine must be one of fetch, browser, auto")),
        F.when(~hook_ok, F.lit("webhook-url must be a URL address"))), lambda x: x.isNotNull())
    out = req.select(
        "id", "url", d.cast("int").alias("max_depth"), p.cast("int").alias("max_pages"),
        F.coalesce("include_patterns", F.array().cast("array<string>")).alias("include_patterns"),
        F.coalesce("exclude_patterns", F.array().cast("array<string>")).alias("exclude_patterns"),
        "webhook_url", e.alias("engine"), "created_at", errors.alias("errors"))
    return out.where(F.size("errors") == 0).drop("errors"), out.where(F.size("errors") > 0)


def create_jobs(valid: DataFrame) -> DataFrame:
    """New job rows, status queued, counters zero."""
    return valid.select(
        "id", F.lit("queued").alias("status"), "url", "max_depth", "max_pages", "include_patterns",
        "exclude_patterns", "webhook_url", "engine", F.lit(0).alias("pages_discovered"),
        F.lit(0).alias("pages_scraped"), F.lit(0).alias("pages_failed"),
        F.lit(None).cast("timestamp_ntz").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_heartbeat_at"),
        F.lit(None).cast("string").alias("error"), "created_at")


# ------------------------------------------------------------------ S3 / S4 / S5

def sitemap_locs(sitemaps: DataFrame) -> DataFrame:
    """S3: (sitemap_url, loc_pos, loc) for every http(s) <loc>, trimmed."""
    locs = F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*(https?://[^<]+?)\s*</loc>"), 1)
    return sitemaps.select("sitemap_url", F.posexplode(locs).alias("loc_pos", "loc")) \
                   .select("sitemap_url", "loc_pos", F.trim("loc").alias("loc"))


def expand_sitemaps(roots: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """Page URLs under each root sitemap, one level of index.

    roots: (job_id, sitemap_url). An index root contributes the non-.xml
    locs of its .xml children (missing children skipped); a plain root its
    own non-.xml locs. Output (job_id, src_pos, loc_pos, loc) in order."""
    docs = sitemaps.select("sitemap_url", F.col("xml").rlike(r"(?i)<sitemapindex[\s>]").alias("is_index"))
    locs = sitemap_locs(sitemaps)
    r = roots.join(docs, "sitemap_url")
    plain = r.where(~F.col("is_index")).join(locs, "sitemap_url") \
             .select("job_id", F.lit(-1).alias("src_pos"), "loc_pos", "loc")
    children = r.where(F.col("is_index")).join(locs, "sitemap_url") \
                .where(F.col("loc").endswith(".xml")) \
                .select("job_id", F.col("loc_pos").alias("src_pos"), F.col("loc").alias("child_url"))
    sub = children.join(locs.withColumnRenamed("sitemap_url", "child_url"), "child_url") \
                  .select("job_id", "src_pos", "loc_pos", "loc")
    return plain.unionByName(sub).where(~F.col("loc").endswith(".xml"))


def _admissible(df: DataFrame, href, base) -> DataFrame:
    """Normalise ``href`` against ``base`` once, parse the result once and
    keep rows on the seed's host whose path passes the globs. Adds
    ``url``, ``_origin`` and ``_pq`` (path + query, for robots)."""
    d = evaluate_once(df, url=normalize_url(href, base))
    d = d.where(F.col("url").isNotNull())
    d = d.withColumn("_p", canonical_parts(F.col("url")))
    d = d.where((F.col("_p.host") == F.col("seed_host"))
                & allowed_path(F.col("_p.path"), F.col("include_patterns"), F.col("exclude_patterns")))
    d = d.withColumn("_origin", url_origin_of(F.col("_p"))) \
         .withColumn("_pq", F.concat(F.col("_p.path"), F.when(F.col("_p.query").isNotNull(),
                                                              F.concat(F.lit("?"), F.col("_p.query")))
                                     .otherwise(F.lit(""))))
    return d.drop("_p")


def _budget(max_pages: str = "max_pages") -> Column:
    """A job's page budget; one beyond C1's bound ends the query, it is never cut."""
    c = F.col(max_pages)
    return F.when(c > PAGES_MAX, F.raise_error(F.lit(f"{max_pages} above {PAGES_MAX}")).cast("int")).otherwise(c)


def discover_from_sitemap(jobs: DataFrame, sitemaps: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Sitemap seed candidates per job: normalised against the site,
    same host, robots, globs; first 3*max_pages candidates; deduplicated
    (first occurrence wins, SURVEY trap 2) and cut to max_pages.
    Output (job_id, url, src_pos, loc_pos, n)."""
    roots = jobs.select(F.col("id").alias("job_id"),
                        F.concat(url_origin("url"), F.lit("/sitemap.xml")).alias("sitemap_url"))
    locs = expand_sitemaps(roots, sitemaps)
    cfg = evaluate_once(jobs.select(F.col("id").alias("job_id"), F.col("url").alias("seed"), _budget().alias("max_pages"),
                                    "include_patterns", "exclude_patterns"), _sp=parse_url_parts("seed"))
    cfg = cfg.select("*", F.col("_sp.host").alias("seed_host"), url_origin_of(F.col("_sp")).alias("seed_origin")) \
             .drop("_sp")
    c = locs.join(cfg, "job_id")
    c = _admissible(c, F.col("loc"), F.col("seed"))
    # robots.txt is scoped to the seed's origin: another scheme/port is refused
    c = c.where(F.col("_origin") == F.col("seed_origin"))
    c = robots_filter(c, rules)
    w = Window.partitionBy("job_id").orderBy("src_pos", "loc_pos")
    # The literal bound lets Spark run the per-job top-k partially before the
    # shuffle (WindowGroupLimit), so a job with a huge sitemap ships at most
    # 3,000 candidates per map task.
    c = c.withColumn("n", F.row_number().over(w)) \
         .where((F.col("n") <= PAGES_MAX * DISCOVERY_FACTOR) & (F.col("n") <= F.col("max_pages") * DISCOVERY_FACTOR))
    first = dedupe_urls(c, ["job_id", "url"], ["n"])
    w2 = Window.partitionBy("job_id").orderBy("n")
    return first.withColumn("k", F.row_number().over(w2)) \
                .where((F.col("k") <= PAGES_MAX) & (F.col("k") <= F.col("max_pages"))) \
                .select("job_id", "url", "src_pos", "loc_pos", F.col("k").alias("n"))


# ------------------------------------------------------------------ S6 / U5

def robots_rules(robots: DataFrame, user_agent: str = USER_AGENT) -> DataFrame:
    """Robots bodies -> (origin, allow, pattern, regex) of the group
    that applies to our agent (its own group, else '*').

    Lines are split with ``posexplode``; consecutive User-agent lines form
    one group; an empty Disallow is ignored. The group choice is a window
    over origin only, so it scales with the number of sites."""
    token = user_agent.lower().split("/")[0].strip()
    lines = robots.select("origin", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("ln", "raw"))
    lines = lines.select("origin", "ln",
                         F.trim(F.regexp_replace("raw", r"#.*$", "")).alias("line"))
    kv = lines.select("origin", "ln",
                      F.lower(F.trim(F.regexp_extract("line", r"^([^:]+):", 1))).alias("key"),
                      F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1)).alias("value"))
    kv = kv.where(F.col("key").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("origin").orderBy("ln")
    prev_key = F.lag("key").over(w)
    kv = kv.withColumn("new_group", (F.col("key") == "user-agent") & (prev_key.isNull() | (prev_key != "user-agent")))
    kv = kv.withColumn("grp", F.sum(F.col("new_group").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agents = kv.where(F.col("key") == "user-agent").groupBy("origin", "grp") \
               .agg(F.collect_set(F.lower("value")).alias("agents"))
    rules = kv.where(F.col("key").isin("allow", "disallow") & (F.col("value") != "")) \
              .select("origin", "grp", "ln", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))
    g = agents.select("origin", "grp",
                      F.when(F.array_contains("agents", token), 2)
                       .when(F.array_contains("agents", "*"), 1).otherwise(0).alias("score"))
    best = g.where(F.col("score") > 0).groupBy("origin").agg(F.max("score").alias("score"))
    chosen = g.join(best, ["origin", "score"]).select("origin", "grp")
    out = rules.join(chosen, ["origin", "grp"])
    anchored = F.col("pattern").endswith("$")
    body = F.when(anchored, F.expr("substring(pattern, 1, length(pattern) - 1)")).otherwise(F.col("pattern"))
    esc = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.replace(esc, F.lit("*"), F.lit(".*")),
                     F.when(anchored, F.lit("$")).otherwise(F.lit("")))
    return out.select("origin", "ln", "allow", "pattern", regex.alias("regex"))


def robots_match(path_query: Column, pattern: Column) -> Column:
    """A robots rule covers paths that start with its pattern; '*' is any run
    of characters, a final '$' the end. Linear in the lengths of both."""
    end = F.endswith(pattern, F.lit("$"))
    whole = F.when(end, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(F.concat(pattern, F.lit("*")))
    return wildcard_match(path_query, whole)


def robots_filter(cands: DataFrame, rules: DataFrame | None, url_col: str = "url") -> DataFrame:
    """Keep candidates robots.txt allows for our agent.

    Equi-join on origin first (no cartesian product), the linear wildcard
    match as residual, then the longest matching pattern wins and allow wins ties. URLs on an
    origin without rules are allowed; callers refuse URLs outside of the
    seed's origin before (S5, C4).
    """
    if rules is None:
        return cands.drop("_origin", "_pq")
    c = cands
    if "_origin" not in c.columns:
        c = c.withColumn("_origin", url_origin(url_col))
    if "_pq" not in c.columns:
        c = c.withColumn("_pq", F.regexp_extract(url_col, r"^[a-z]+://[^/]+(/[^#]*)?", 1))
    # Verdicts are keyed by the deterministic (origin, path+query), so a
    # recomputed task after an executor loss joins back the same rows.
    keys = c.select("_origin", "_pq").distinct()
    m = keys.join(rules.withColumnRenamed("origin", "_origin"), "_origin") \
            .where(robots_match(F.col("_pq"), F.col("pattern")))
    verdict = m.groupBy("_origin", "_pq").agg(
        F.max_by("allow", F.struct(F.length("pattern"), F.col("allow"))).alias("_allow"))
    out = c.join(verdict, ["_origin", "_pq"], "left")
    return out.where(F.coalesce("_allow", F.lit(True))).drop("_origin", "_pq", "_allow")


# ------------------------------------------------------------------ U6 / C4 / C5

def dedupe_urls(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order`` - a hash aggregate of
    min(struct(order..., row)) (partial aggregation, no global sort)."""
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in others]).alias("_row"))
    agg = df.groupBy(*keys).agg(F.min(packed).alias("_m"))
    return agg.select(*keys, *[F.col("_m._row")[c].alias(c) for c in others])


def expand_links(pages: DataFrame, jobs: DataFrame, rules: DataFrame | None,
                 expand_unchanged: bool = False) -> DataFrame:
    """C4: candidate children of this round's pages.

    pages: (job_id, ord, url, depth, status, unchanged, links). Only
    scraped (not 304 unless ``expand_unchanged``) pages of link-following
    jobs with depth < max_depth expand. Links are normalised against the
    *page* URL and must share the *seed* host, the seed's robots origin,
    robots rules and globs. Output (job_id, url, parent_ord, pos, depth).
    """
    cfg = jobs.select(F.col("id").alias("job_id"), F.col("url").alias("seed"), "seed_host", "seed_origin",
                      "max_depth", "include_patterns", "exclude_patterns", "uses_sitemap")
    live = (F.col("status") == "scraped") & (F.lit(expand_unchanged) | ~F.col("unchanged"))
    p = pages.where(live).join(cfg, "job_id") \
             .where(~F.col("uses_sitemap") & (F.col("depth") < F.col("max_depth")))
    ex = p.select("job_id", "seed", "seed_host", "seed_origin", "include_patterns", "exclude_patterns",
                  F.col("ord").alias("parent_ord"), (F.col("depth") + 1).alias("depth"),
                  F.col("url").alias("page_url"), F.posexplode("links").alias("pos", "href"))
    ex = _admissible(ex, F.col("href"), F.col("page_url"))
    # robots.txt is scoped to the seed's origin: another scheme/port is refused
    ex = ex.where(F.col("_origin") == F.col("seed_origin"))
    ex = robots_filter(ex, rules)
    return ex.select("job_id", "url", "parent_ord", "pos", "depth")


def admit_new(cands: DataFrame, visited: DataFrame, jobs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """First occurrence per (job, url), not yet visited, in (parent
    order, link position), until a job has 3*max_pages visited URLs.

    visited: (job_id, url, ord); ``seen`` (job_id, n_visited) if its counts
    are known. Output (job_id, url, depth, ord,
    processable) with ord continuing the job's FIFO numbering."""
    first = dedupe_urls(cands, ["job_id", "url"], ["parent_ord", "pos"])
    fresh = first.join(visited.select("job_id", "url"), ["job_id", "url"], "left_anti")
    if seen is None:
        seen = visited.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_visited"))
    cap = jobs.select(F.col("id").alias("job_id"), (_budget() * DISCOVERY_FACTOR).alias("cap"), "max_pages")
    w = Window.partitionBy("job_id").orderBy("parent_ord", "pos")
    r = fresh.join(seen, "job_id", "left").join(cap, "job_id") \
             .withColumn("n_visited", F.coalesce("n_visited", F.lit(0))) \
             .withColumn("k", F.row_number().over(w))
    r = r.where((F.col("k") <= PAGES_MAX * DISCOVERY_FACTOR) & (F.col("k") <= F.col("cap") - F.col("n_visited")))
    ord_ = (F.col("n_visited") + F.col("k")).cast("long")
    # C6 decided at admission: a URL is ever processed iff its FIFO position
    # is within the job's page budget
    return r.select("job_id", "url", "depth", ord_.alias("ord"), (ord_ <= F.col("max_pages")).alias("processable"))


def cap_pages(frontier: DataFrame, jobs: DataFrame) -> DataFrame:
    """The frontier rows processed before the job hits max_pages.

    Every popped page counts as scraped or failed and ord is the FIFO
    position, so the processed set is exactly ord <= max_pages."""
    cfg = jobs.select(F.col("id").alias("job_id"), "max_pages")
    return frontier.join(cfg, "job_id").where(F.col("ord") <= F.col("max_pages")).drop("max_pages")


# ------------------------------------------------------------------ C8

def apply_backoff(round_pages: DataFrame, state: DataFrame | None, carry: tuple = ()) -> DataFrame:
    """Mark pages popped inside a host's backoff window as skipped.

    round_pages: (job_id, ord, fetched_at, blocked, *carry); state:
    (job_id, backoff_until) carried from earlier rounds. On ``blocked`` the
    window becomes (until or now) + 30 s - a fixed step that extends the old
    deadline; pages popped while now < until are skipped (not fetched) and
    do not extend it. All admitted URLs share the seed's host, so the fold
    is per job: an ordered ``aggregate`` over one job's pages of one round
    (at most max_pages <= 1000 rows), evaluated in the JVM. The clock is
    the capture's ``fetched_at``. ``carry`` columns ride along so the caller
    needs no join back. Returns (job_id, ord, *carry, fetched_at, blocked,
    skipped, backoff_until); the highest ord per job is the next state.
    """
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(BACKOFF_STEP_SECONDS))
    cols = ["ord", "fetched_at", "blocked", *carry]
    evs = round_pages.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("evs"))
    if state is not None:
        evs = evs.join(state.select("job_id", F.col("backoff_until").alias("prev_until")), "job_id", "left")
    else:
        evs = evs.withColumn("prev_until", F.lit(None).cast("timestamp_ntz"))
    out_t = "array<struct<skipped:boolean,backoff_until:timestamp_ntz>>"
    init = F.struct(F.col("prev_until").alias("until"), F.array().cast(out_t).alias("out"))

    def fold(acc, e):
        skipped = F.coalesce(acc["until"].isNotNull() & (e["fetched_at"] < acc["until"]), F.lit(False))
        until = F.when(~skipped & e["blocked"], F.coalesce(acc["until"], e["fetched_at"]) + step) \
                 .otherwise(acc["until"])
        row = F.struct(skipped.alias("skipped"), until.alias("backoff_until"))
        return F.struct(until.alias("until"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = evs.select("job_id", "evs", F.aggregate("evs", init, fold)["out"].alias("out"))
    zipped = F.transform("evs", lambda e, i: F.struct(
        *[e[c].alias(c) for c in cols],
        F.element_at("out", i + 1)["skipped"].alias("skipped"),
        F.element_at("out", i + 1)["backoff_until"].alias("backoff_until")))
    return folded.select("job_id", F.inline(zipped))


# ------------------------------------------------------------------ C9 / C10

def politeness_plan(urls: DataFrame, order_col: str = "ord", gap_ms: int = POLITENESS_MS) -> DataFrame:
    """Fetch-list planner - slot_ms = (rank within host - 1) * 300.
    The rank is skew-safe: one host may hold a large share of the URLs."""
    u = urls.withColumn("host", url_host("url"))
    r = row_number_within(u, "host", [order_col, "url"], out="_rank")
    return r.withColumn("slot_ms", ((F.col("_rank") - 1) * gap_ms).cast("long")).drop("_rank")


def politeness_violations(pages: DataFrame, gap_ms: int = POLITENESS_MS) -> DataFrame:
    """Consecutive requests to one host closer than the gap (skew-safe lag)."""
    u = pages.select("job_id", "ord", "url", "scraped_at").withColumn("host", url_host("url"))
    ln = lag_within(u, "host", ["scraped_at", "job_id", "ord"], "scraped_at", "prev_scraped_at")
    gap = (F.unix_micros(F.col("scraped_at").cast("timestamp"))
           - F.unix_micros(F.col("prev_scraped_at").cast("timestamp"))) / 1000
    return ln.select("host", "job_id", "ord", "url", "scraped_at", "prev_scraped_at", gap.cast("long").alias("gap_ms")) \
             .where(F.col("prev_scraped_at").isNotNull() & (F.col("gap_ms") < gap_ms))


# ------------------------------------------------------------------ C13 / C15 / K3

def page_results(processed: DataFrame) -> DataFrame:
    """job_pages rows - scraped, unchanged ('(unchanged)', no markdown,
    engine fetch) or failed (engine always 'fetch', error)."""
    s = F.col("status")
    unchanged = F.coalesce(F.col("unchanged"), F.lit(False))
    ok = (s == "scraped") & ~unchanged
    return processed.select(
        "job_id", "ord", "url", "depth", "status",
        F.when(ok, F.col("engine")).otherwise(F.lit("fetch")).alias("engine"),
        F.when(ok, F.col("markdown")).alias("markdown"),
        F.when(ok, F.col("title")).when(unchanged & (s == "scraped"), F.lit("(unchanged)")).alias("title"),
        F.when(s != "scraped", F.col("error")).alias("error"),
        F.when(~F.col("skipped"), F.col("duration_ms")).alias("duration_ms"),
        F.when(ok, F.coalesce("markdown_length", F.lit(0))).alias("markdown_length"),
        F.col("fetched_at").alias("scraped_at"), F.col("fetched_at").alias("created_at"))


def resume_frontier(stale: DataFrame, frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Remaining frontier of stale jobs - checkpointed frontier rows
    of those jobs that have no page row yet, in FIFO order."""
    f = frontier.join(stale.select(F.col("id").alias("job_id")), "job_id")
    return f.join(pages.select("job_id", "url"), ["job_id", "url"], "left_anti")


def crawl_outbox(jobs: DataFrame) -> DataFrame:
    """K3: webhook payloads for finished jobs that configured a webhook."""
    j = jobs.where(F.col("webhook_url").isNotNull() & F.col("status").isin("completed", "failed"))
    payload = F.to_json(F.struct(
        F.col("id").alias("job-id"), F.col("status"), F.col("pages_scraped").alias("pages-scraped"),
        F.col("pages_failed").alias("pages-failed"),
        F.concat(F.lit("/jobs/"), F.col("id")).alias("results-url")))
    return j.select(F.col("id").alias("job_id"), "webhook_url", payload.alias("payload"))
