"""Stand-in inputs derived from the given test tables.

The reference keeps its operational state in a relational store and reads
pages from the network. Here every such input is *derived* from the
driver tables so that work grows with the data: each function below only
lays rows into the schema an operator expects. None of them does any of
the operators' work (no parsing, normalising, hashing, diffing, ranking
of crawl order, ...); that all happens in ``webloom.operators``.

Derivations (mirrored one-to-one by the DuckDB oracle CTEs):

* responses / rendered_responses <- pages (HTTP status by page_id residues)
* jobs, crawl_requests, monitor_requests <- orders
* job_pages      <- lineitem
* scrape_requests, logs <- events
* monitors, monitor_commands, monitor_prev / monitor_cur <- documents
* crawl_responses (+ an earlier version), crawl_rendered, crawl_jobs,
  crawl_monitors, crawl_robots, crawl_sitemaps <- pages (per-host link graph)
* completions    <- a prompt table (captured model replies keyed by prompt hash)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import driver_table

from ..operators.crawl import USER_AGENT

AGENT_TOKEN = USER_AGENT.split("/")[0]   # product token of the crawler's User-Agent

# Fixed values of the fixtures (shared with the DuckDB oracle).
AS_OF = "2024-01-30 12:00:00"          # rolling statistics clock (events span January 2024)
JOBS_AS_OF = "1998-08-02 00:03:00"     # heartbeat clock for stale-job checks
FETCH_EPOCH = "2024-01-30 00:00:00"    # capture time base of responses
PAGE_RUN = 1_000                       # page ids that are ranked together in a link graph


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured plain-fetch responses, one per page.

    Status by residue of page_id: 404 (17), 403 (19), 304 (23), transport
    timeout (29), connection error (31), 429 (37), 500 (41), else 200.
    """
    p = driver_table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    transport = (F.when(pid % 17 == 0, None).when(pid % 19 == 0, None).when(pid % 23 == 0, None)
                 .when(pid % 29 == 0, F.lit("TimeoutError: The operation was aborted due to timeout"))
                 .when(pid % 31 == 0, F.lit("fetch failed: ECONNREFUSED")))
    status = (F.when(pid % 17 == 0, 404).when(pid % 19 == 0, 403).when(pid % 23 == 0, 304)
              .when(transport.isNotNull(), None)
              .when(pid % 37 == 0, 429).when(pid % 41 == 0, 500).otherwise(200))
    return p.select(
        F.col("page_id"),
        F.col("url"),
        F.lit("fetch").alias("engine"),
        status.cast("int").alias("http_status"),
        F.concat(F.lit('"e'), pid.cast("string"), F.lit('"')).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.when(status.isNull() | (status == 304), None).otherwise(F.col("html")).alias("html"),
        transport.alias("error"),
        (_ts(FETCH_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), pid.cast("int"))).alias("fetched_at"),
        (F.lit(100) + pid % 400).cast("int").alias("duration_ms"),
    )


def rendered_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured browser renderings for every third page (same HTML)."""
    p = driver_table(spark, sf_dir, "pages").where(F.col("page_id") % 3 == 0)
    return p.select(
        "page_id", "url", F.lit("browser").alias("engine"), F.lit(200).alias("http_status"),
        F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.col("html"), F.lit(None).cast("string").alias("error"),
        _ts(FETCH_EPOCH).alias("fetched_at"), F.lit(900).alias("duration_ms"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = driver_table(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderstatus") == "P", "queued")
              .when(F.col("o_orderstatus") == "O", "running")
              .when(F.col("o_orderpriority") == "5-LOW", "failed")
              .otherwise("completed"))
    k = F.col("o_orderkey")
    created = F.col("o_orderdate")
    started = F.when(status != "queued", created + F.expr("INTERVAL 1 HOUR"))
    return o.select(
        F.concat(F.lit("job_"), k.cast("string")).alias("id"),
        status.alias("status"),
        F.concat(F.lit("https://c"), F.col("o_custkey").cast("string"), F.lit(".example.com/")).alias("url"),
        F.lit(2).alias("max_depth"), F.lit(100).alias("max_pages"),
        F.array().cast("array<string>").alias("include_patterns"),
        F.array().cast("array<string>").alias("exclude_patterns"),
        F.when(F.col("o_custkey") % 4 == 0,
               F.concat(F.lit("https://hooks.example.com/"), F.col("o_custkey").cast("string"))).alias("webhook_url"),
        F.lit("auto").alias("engine"),
        (k % 12).cast("int").alias("pages_discovered"),
        (k % 7).cast("int").alias("pages_scraped"),
        (k % 3).cast("int").alias("pages_failed"),
        started.alias("started_at"),
        F.when(status.isin("completed", "failed"), created + F.expr("INTERVAL 2 HOURS")).alias("completed_at"),
        F.when(status == "running",
               created + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 240).cast("int"))
               ).alias("last_heartbeat_at"),
        F.when(status == "failed", F.lit("crawl aborted")).alias("error"),
        created.alias("created_at"),
    )


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = driver_table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax")
    status = (F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "blocked")
              .when(F.col("l_returnflag") == "R", "not_found").otherwise("scraped"))
    scraped = status == "scraped"
    return li.select(
        F.concat(F.lit("job_"), F.col("l_orderkey").cast("string")).alias("job_id"),
        F.row_number().over(w).cast("long").alias("ord"),
        F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example.com/p/"),
                 F.col("l_partkey").cast("string")).alias("url"),
        status.alias("status"),
        F.when(F.col("l_linestatus") == "O", "browser").otherwise("fetch").alias("engine"),
        F.lit(None).cast("string").alias("markdown"),
        F.when(scraped, F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))).alias("title"),
        F.when(status == "blocked", "HTTP 403").when(status == "not_found", "HTTP 404").alias("error"),
        F.when(F.col("l_linenumber") == 7, None)
         .otherwise(F.round(F.col("l_quantity") * 10).cast("int")).alias("duration_ms"),
        F.when(scraped, (F.col("l_partkey") % 5000).cast("int")).alias("markdown_length"),
        F.col("l_shipdate").alias("scraped_at"),
        F.col("l_shipdate").alias("created_at"),
    )


def scrape_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = driver_table(spark, sf_dir, "events")
    ok = F.col("event_type") != "error"
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("https://u"), (F.col("user_id") % 50).cast("string"), F.lit(".example.com/e/"),
                 F.col("event_id").cast("string")).alias("url"),
        F.when(F.col("event_type") == "signup", "extract").otherwise("scrape").alias("source"),
        F.when(F.col("user_id") % 3 == 0, "fetch").when(F.col("user_id") % 3 == 1, "browser").alias("engine"),
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.floor(F.col("value") * 10).cast("int").alias("duration_ms"),
        F.when(ok, F.floor(F.col("value") * 100).cast("int")).alias("markdown_length"),
        F.when(ok, F.concat(F.lit("Event "), F.col("event_id").cast("string"))).alias("title"),
        F.when(~ok, F.lit("HTTP 500")).alias("error"),
        F.col("ts").alias("created_at"),
    )


def monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One monitor per document source."""
    d = driver_table(spark, sf_dir, "documents").select("source").distinct()
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return d.select(
        F.concat(F.lit("mon_"), F.col("source")).alias("id"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/")).alias("url"),
        F.lit(2).alias("max_depth"), F.lit(100).alias("max_pages"),
        F.array().cast("array<string>").alias("include_patterns"),
        F.array().cast("array<string>").alias("exclude_patterns"),
        F.element_at(F.array(F.lit("hourly"), F.lit("daily"), F.lit("weekly")), (n % 3 + 1).cast("int")).alias("frequency"),
        F.concat(F.lit("https://hooks.example.com/m/"), F.col("source")).alias("webhook_url"),
        F.when(n % 7 == 0, "paused").otherwise("active").alias("status"),
        F.when(n % 10 == 5, F.lit("")).when(n % 2 == 0, F.concat(F.lit("Track updates for "), F.col("source"))).alias("goal"),
        _ts("2024-01-29 23:30:00").alias("last_checked_at"),
        F.lit(None).cast("string").alias("last_job_id"),
        _ts("2024-01-01 00:00:00").alias("created_at"),
    )


def _doc_url():
    return F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/d/"), F.col("doc_id").cast("string"))


def monitor_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored monitor state (monitor_pages) before the run."""
    d = driver_table(spark, sf_dir, "documents").where(F.col("doc_id") % 11 != 0)
    return d.select(
        F.concat(F.lit("mon_"), F.col("source")).alias("monitor_id"),
        _doc_url().alias("url"),
        F.col("text").alias("markdown"),
        F.concat(F.lit('"d'), F.col("doc_id").cast("string"), F.lit('"')).alias("etag"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("Mon, 29 Jan 2024 00:00:00 GMT")).alias("last_modified"),
        _ts("2024-01-29 00:00:00").alias("checked_at"),
    )


def monitor_cur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown fetched by the current run."""
    d = driver_table(spark, sf_dir, "documents").where(F.col("doc_id") % 7 != 0)
    text = F.when(F.col("doc_id") % 5 == 0,
                  F.concat(F.col("text"), F.lit("\nUpdated line "), F.col("doc_id").cast("string"))
                  ).otherwise(F.col("text"))
    return d.select(
        F.concat(F.lit("mon_"), F.col("source")).alias("monitor_id"),
        _doc_url().alias("url"),
        F.when(F.col("doc_id") % 13 == 0, 304).otherwise(200).alias("http_status"),
        text.alias("markdown"),
        F.concat(F.lit('"d'), F.col("doc_id").cast("string"), F.lit('"')).alias("etag"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("Tue, 30 Jan 2024 00:00:00 GMT")).alias("last_modified"),
        _ts("2024-01-30 00:00:00").alias("checked_at"),
    )


def link_graph_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages ranked per host (by page_id) with their host and rank.

    One host may hold a large share of the pages, so no task takes a whole
    host with its HTML: a page is ranked within its host's run of page ids,
    and the pages of the host's earlier runs, counted without HTML, are
    added. A run is a struct, so that null hosts and ids join too."""
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    p = driver_table(spark, sf_dir, "pages").select("page_id", "url", "html", host.alias("host")) \
        .withColumn("run", F.struct("host", F.floor(F.col("page_id") / PAGE_RUN).alias("no")))
    earlier = Window.partitionBy("run.host").orderBy("run.no").rowsBetween(Window.unboundedPreceding, -1)
    before = p.groupBy("run").agg(F.count(F.lit(1)).alias("n")) \
              .select("run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("run").orderBy("page_id"))
    return (p.withColumn("place", place).join(before, "run")
             .select("page_id", "url", "html", "host", (F.col("before") + F.col("place")).cast("int").alias("rank"))
             .withColumn("path", F.concat(F.lit("/n/"), F.col("rank").cast("string"))))


def crawl_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured responses of a per-host link graph.

    Page of rank r lives at ``https://<host>/n/<r>`` and its nav links to
    ranks 2r (relative), 2r+1 (absolute with fragment) and back to rank 1
    (trailing slash); the rest of the page is the original HTML. A rank
    with no page is simply not captured.
    """
    g = link_graph_pages(spark, sf_dir)
    r = F.col("rank")
    nav = F.concat(
        F.lit('<nav><a href="/n/'), (r * 2).cast("string"), F.lit('">next</a>'),
        F.lit('<a href="https://'), F.col("host"), F.lit("/n/"), (r * 2 + 1).cast("string"),
        F.lit('#top">more</a><a href="/n/1/">home</a></nav>'))
    html = F.regexp_replace("html", r"(?s)<nav>.*?</nav>", "")
    html = F.concat(F.regexp_extract(html, r"(?s)^(.*?<body>)", 1), nav,
                    F.regexp_replace(html, r"(?s)^.*?<body>", ""))
    status = F.when(F.col("page_id") % 19 == 0, 403).when(F.col("page_id") % 17 == 0, 404).otherwise(200)
    return g.select(
        F.concat(F.lit("https://"), F.col("host"), F.col("path")).alias("url"),
        F.lit("fetch").alias("engine"), status.alias("http_status"),
        F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.when(status == 200, html).alias("html"), F.lit(None).cast("string").alias("error"),
        (_ts(FETCH_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("page_id") * 7).cast("int"))).alias("fetched_at"),
        F.lit(120).alias("duration_ms"))


def crawl_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crawl request per host, seeded at rank 1. Budgets go from 2 to
    1,000 pages and depths from 1 to 10, so that caps bind on some hosts and
    others are crawled in full."""
    g = link_graph_pages(spark, sf_dir).where(F.col("rank") == 1)
    n = F.col("page_id")
    return g.select(
        F.concat(F.lit("job_h"), n.cast("string")).alias("id"),
        F.concat(F.lit("https://"), F.col("host"), F.lit("/n/1")).alias("url"),
        (F.lit(1) + n % 10).cast("int").alias("max_depth"),
        F.when(n % 3 == 0, F.lit(2) + n % 9).otherwise(F.lit(20) + (n * 37) % 981).cast("int").alias("max_pages"),
        F.when(n % 5 == 0, F.array(F.lit("/n/*"))).otherwise(F.array()).cast("array<string>").alias("include_patterns"),
        F.when(n % 6 == 0, F.array(F.lit("/n/3"))).otherwise(F.array()).cast("array<string>").alias("exclude_patterns"),
        F.when(n % 2 == 0, F.lit("https://hooks.example.com/c")).alias("webhook_url"),
        F.when(n % 3 == 0, "auto").when(n % 3 == 1, "browser").otherwise("fetch").alias("engine"),
        _ts("2024-01-30 00:00:00").alias("created_at"),
    )


def completions(spark: SparkSession, sf_dir: str, prompts: DataFrame) -> DataFrame:
    """Captured model replies, one per distinct prompt and attempt.

    The reply kind is picked by the prompt hash (a stand-in for what a
    model said): attempt 1 is fenced JSON, bare JSON, prose (invalid) or
    empty; attempt 2 answers every prompt, invalid for one residue class,
    so some extractions fail twice.
    """
    h = prompts.select("prompt_hash").distinct()
    n = F.conv(F.substring("prompt_hash", 1, 6), 16, 10).cast("long")
    good = F.concat(F.lit('{"title": "T'), F.substring("prompt_hash", 1, 8), F.lit('", "n": '), n.cast("string"),
                    F.lit(', "ok": true, "tags": ["a", "b"]}'))
    first = (F.when(n % 4 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
             .when(n % 4 == 1, good)
             .when(n % 4 == 2, F.lit("Sorry, I cannot help with that."))
             .otherwise(F.lit("")))
    second = F.when(n % 8 == 2, F.lit("still not json")).otherwise(good)
    a1 = h.select("prompt_hash", F.lit(1).alias("attempt"), first.alias("text"),
                  F.lit(None).cast("string").alias("error"))
    a2 = h.select("prompt_hash", F.lit(2).alias("attempt"), second.alias("text"),
                  F.lit(None).cast("string").alias("error"))
    return a1.unionByName(a2)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in ``logs`` rows laid out from the events table."""
    e = driver_table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn") \
             .otherwise("info")
    return e.select(
        F.col("event_id").alias("id"),
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("job_"), F.col("user_id").cast("string"))).alias("job_id"),
        F.when(F.col("user_id") % 2 == 1,
               F.concat(F.lit("mon_src"), (F.col("user_id") % 20).cast("string"))).alias("monitor_id"),
        level.alias("level"), F.col("event_type").alias("message"), F.col("props").alias("context"),
        F.col("ts").alias("created_at"))


def crawl_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots.txt bodies for a third of the link-graph hosts each (two styles)."""
    g = link_graph_pages(spark, sf_dir).where(F.col("rank") == 1)
    n = F.col("page_id")
    body = (F.when(n % 3 == 0, F.lit("User-agent: *\nDisallow: /n/5\nAllow: /n/5$\n\n"
                                     "User-agent: otherbot\nDisallow: /\n"))
            .when(n % 3 == 1, F.lit(f"# crawl rules\nUser-agent: {AGENT_TOKEN}\nDisallow: /n/1*3\nDisallow:\n")))
    return g.where(n % 3 != 2).select(F.concat(F.lit("https://"), F.col("host")).alias("origin"),
                                      body.alias("body"))


def crawl_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sitemap.xml documents for a quarter of the link-graph hosts.

    The root is an index of child sitemaps of at most 1,000 pages each
    (plus one missing child); each child lists its pages in descending
    rank, repeats rank 1, uses an upper-case tag once and names another
    scheme, another port and one foreign host."""
    g = link_graph_pages(spark, sf_dir)
    first = g.where(F.col("rank") == 1).select("host", F.col("page_id").alias("root_id"))
    hosts = first.where(F.col("root_id") % 4 == 0)
    pages = g.join(hosts, "host").withColumn("bucket", ((F.col("rank") - 1) / 1000).cast("int"))
    origin = F.concat(F.lit("https://"), F.col("host"))
    entry = F.concat(F.lit("<url><loc> "), origin, F.col("path"), F.lit(" </loc></url>"))
    child = pages.groupBy("host", "bucket").agg(
        F.array_sort(F.collect_list(F.struct(-F.col("rank"), entry.alias("e")))).alias("items"))
    child_url = F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap-"), F.col("bucket").cast("string"),
                         F.lit(".xml"))
    child_docs = child.select(
        child_url.alias("sitemap_url"),
        F.concat(F.lit('<?xml version="1.0"?><urlset>'), F.array_join(F.transform("items", lambda x: x["e"]), ""),
                 F.lit("<url><LOC>https://"), F.col("host"), F.lit("/n/1</LOC></url>"),
                 F.lit("<url><loc>http://"), F.col("host"), F.lit("/n/2</loc></url><url><loc>https://"), F.col("host"),
                 F.lit(":8443/n/3</loc></url>"),
                 F.lit("<url><loc>https://elsewhere.example.com/n/1</loc></url></urlset>")).alias("xml"))
    idx_items = child.select("host", F.concat(F.lit("<sitemap><loc>"), child_url, F.lit("</loc></sitemap>")).alias("e"),
                             "bucket")
    index = idx_items.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("bucket", "e"))).alias("items")) \
        .select(F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap.xml")).alias("sitemap_url"),
                F.concat(F.lit('<?xml version="1.0"?><sitemapindex>'),
                         F.array_join(F.transform("items", lambda x: x["e"]), ""),
                         F.lit("<sitemap><loc>https://"), F.col("host"),
                         F.lit("/sitemap-missing.xml</loc></sitemap></sitemapindex>")).alias("xml"))
    return index.unionByName(child_docs)


def crawl_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw crawl requests (some invalid) laid out from orders."""
    o = driver_table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    host = F.concat(F.lit("c"), c.cast("string"), F.lit(".example.com/"))
    return o.select(
        F.concat(F.lit("req_"), k.cast("string")).alias("id"),
        F.when(k % 10 == 3, host).otherwise(F.concat(F.lit("https://"), host)).alias("url"),
        F.when(k % 7 == 0, None).otherwise((k % 13 - 1).cast("int")).alias("max_depth"),
        F.when(k % 5 == 0, None).otherwise(((c * 37) % 1200).cast("int")).alias("max_pages"),
        F.when(k % 9 == 0, F.array(F.lit("/docs/*"))).alias("include_patterns"),
        F.lit(None).cast("array<string>").alias("exclude_patterns"),
        F.when(k % 6 == 0, "not a url").when(k % 6 == 1, "https://hooks.example.com/x").alias("webhook_url"),
        F.when(k % 4 == 0, None).when(k % 4 == 1, "fetch").when(k % 4 == 2, "browser")
         .when(k % 8 == 3, "chrome").otherwise("auto").alias("engine"),
        F.col("o_orderdate").alias("created_at"))


def monitor_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pause / resume / delete commands for some monitors, in sequence."""
    m = monitors(spark, sf_dir).select("id", F.regexp_extract("id", r"(\d+)$", 1).cast("int").alias("n"))
    a = m.where(F.col("n") % 2 == 0).select(F.col("id").alias("monitor_id"), F.lit(1).alias("seq"), F.lit("pause").alias("action"))
    b = m.where(F.col("n") % 4 == 0).select(F.col("id").alias("monitor_id"), F.lit(2).alias("seq"), F.lit("resume").alias("action"))
    c = m.where(F.col("n") % 5 == 0).select(F.col("id").alias("monitor_id"), F.lit(3).alias("seq"), F.lit("delete").alias("action"))
    d = m.where(F.col("n") % 3 == 0).select(F.col("id").alias("monitor_id"), F.lit(4).alias("seq"), F.lit("archive").alias("action"))
    return a.unionByName(b).unionByName(c).unionByName(d)


def monitor_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitor creation requests: crawl requests plus frequency and goal."""
    r = crawl_requests(spark, sf_dir)
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    freq = (F.when(k % 5 == 0, None).when(k % 5 == 1, "hourly").when(k % 5 == 2, "daily")
            .when(k % 5 == 3, "weekly").otherwise("monthly"))
    return r.withColumn("frequency", freq) \
            .withColumn("goal", F.when(k % 3 == 0, F.concat(F.lit("Watch "), F.col("url"))))


def crawl_monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One monitor per link-graph site, configured like that site's crawl job."""
    j = crawl_jobs(spark, sf_dir)
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    return j.select(
        F.concat(F.lit("mon_"), F.col("id")).alias("id"), "url", "max_depth", "max_pages", "include_patterns",
        "exclude_patterns", F.lit("daily").alias("frequency"),
        F.lit("https://hooks.example.com/m").alias("webhook_url"), F.lit("active").alias("status"),
        F.when(n % 2 == 0, F.lit("Track headline changes")).alias("goal"),
        F.lit(None).cast("timestamp_ntz").alias("last_checked_at"),
        F.lit(None).cast("string").alias("last_job_id"), _ts("2024-01-01 00:00:00").alias("created_at"))


def crawl_responses_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier capture of the link graph: every third page had a draft
    headline and one paragraph fewer."""
    r = crawl_responses(spark, sf_dir)
    g = link_graph_pages(spark, sf_dir).select(
        F.concat(F.lit("https://"), F.col("host"), F.col("path")).alias("url"), "page_id")
    r = r.join(g, "url")
    old = F.regexp_replace(F.regexp_replace("html", "</h1>", " (draft)</h1>"), r"(?s)<p>[^<]*</p>(?=</article>)", "")
    return r.withColumn("html", F.when(F.col("page_id") % 3 == 0, old).otherwise(F.col("html"))).drop("page_id")


def crawl_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Browser renderings captured for a quarter of the link-graph pages
    (rank 1 always, so every site's seed can be rendered); a rendering
    succeeds even where the plain fetch was refused."""
    r = crawl_responses(spark, sf_dir).drop("html", "http_status")
    g = link_graph_pages(spark, sf_dir).select(
        F.concat(F.lit("https://"), F.col("host"), F.col("path")).alias("url"), "page_id", "rank")
    ok = g.where((F.col("page_id") % 4 == 1) | (F.col("rank") == 1)).select("url")
    html_src = link_graph_pages(spark, sf_dir).select(
        F.concat(F.lit("https://"), F.col("host"), F.col("path")).alias("url"), "html", "rank", "host")
    nav = F.concat(
        F.lit('<nav><a href="/n/'), (F.col("rank") * 2).cast("string"), F.lit('">next</a>'),
        F.lit('<a href="https://'), F.col("host"), F.lit("/n/"), (F.col("rank") * 2 + 1).cast("string"),
        F.lit('#top">more</a><a href="/n/1/">home</a></nav>'))
    body = F.regexp_replace("html", r"(?s)<nav>.*?</nav>", "")
    rendered_html = F.concat(F.regexp_extract(body, r"(?s)^(.*?<body>)", 1), nav,
                             F.regexp_replace(body, r"(?s)^.*?<body>", ""))
    h = html_src.join(ok, "url").select("url", rendered_html.alias("html"))
    return r.join(h, "url").select("url", F.lit("browser").alias("engine"), F.lit(200).alias("http_status"),
                                   "etag", "last_modified", "html", "error", "fetched_at", "duration_ms")


def judge_completions(prompts: DataFrame) -> DataFrame:
    """Stand-in captured judge replies keyed by prompt hash: relevant,
    fenced irrelevant, unparseable, failed call, truthy number - by the
    hash's leading hex digit."""
    d = F.conv(F.substring("prompt_hash", 1, 2), 16, 10).cast("int") % 5
    text = (F.when(d == 0, F.lit('{"relevant": true, "reason": "matches the goal"}'))
            .when(d == 1, F.lit('```json\n{"relevant": false, "reason": "cosmetic edit"}\n```'))
            .when(d == 2, F.lit("I think this is relevant."))
            .when(d == 3, F.lit(None))
            .otherwise(F.lit('{"relevant": 1, "reason": "new section"}')))
    return prompts.select("prompt_hash", F.lit(1).alias("attempt"), text.alias("text"),
                          F.when(d == 3, F.lit("LLM call failed: 503")).alias("error")).distinct()
