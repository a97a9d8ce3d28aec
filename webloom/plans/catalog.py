"""Registered queries: name -> (spark callable, oracle SQL or None).

Every callable takes (spark, sf_dir) and reads the given tables (or
fixtures Spark derives from them), so its work grows with the data.
Queries are grouped by operator family; the oracle SQL for each lives
next to it so the two can be read side by side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import oracle_sql as O
from ..functions import urls as U
from ..functions.html import page_links, page_title, strip_nodes
from ..operators import crawl as C
from ..operators import extract as X
from ..operators import llm as L
from ..operators import monitor as M
from ..operators import ops as Q
from ..operators import pages as P
from ..operators import sinks as SK
from ..session import fresh_dir
from ..sources import fixtures as FX
from ..sources import folders
from ..sources.monitor_state import MonitorState
from ..sources import tables as TB
from ..sources.tables import driver_table
from ..streaming import stream_ops as S
from . import crawl as PC
from . import monitor_run as MR

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _pages(spark, sf):
    return driver_table(spark, sf, "pages")


# ------------------------------------------------------------------ flagship

_doc = O.strip_nodes("html")
_HOST_SUMMARY_SQL = f"""
WITH f AS (
  SELECT page_id, url, {O.normalize_url('url', 'url')} AS canonical,
         {O.page_title(_doc)} AS title, {O.page_links(_doc)} AS links
  FROM pages),
g AS (SELECT *, {O.url_host('canonical')} AS host FROM f),
x AS (
  SELECT page_id, host, canonical, title, l.link AS link
  FROM g LEFT JOIN LATERAL (SELECT unnest(list_transform(links, lambda h_: {O.normalize_url('h_', 'url')})) AS link) l ON true)
SELECT host, CAST(count(DISTINCT page_id) AS BIGINT) AS n_pages,
  CAST(count(DISTINCT CASE WHEN title <> '' THEN page_id END) AS BIGINT) AS n_titled,
  CAST(count(link) AS BIGINT) AS n_links,
  CAST(count(DISTINCT link) AS BIGINT) AS n_distinct_links,
  CAST(count(DISTINCT canonical) AS BIGINT) AS n_canonical
FROM x GROUP BY host
"""


@register("host_summary", _HOST_SUMMARY_SQL)
def q_host_summary(spark, sf):
    """Flagship: pages -> canonical URL, title, links -> per-host summary."""
    return P.host_summary(_pages(spark, sf))


# ------------------------------------------------------------------ X1 X2 X4 X5

@register("x1_strip_nodes", f"""
SELECT page_id, CAST(length({O.strip_nodes('html')}) AS BIGINT) AS stripped_chars,
       CAST(length(html) AS BIGINT) AS raw_chars FROM pages""")
def q_strip(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", F.length(strip_nodes("html")).cast("long").alias("stripped_chars"),
                    F.length("html").cast("long").alias("raw_chars"))


@register("x2_page_title", f"SELECT page_id, {O.page_title(O.strip_nodes('html'))} AS title FROM pages")
def q_title(spark, sf):
    return _pages(spark, sf).select("page_id", page_title("html").alias("title"))


@register("x4_page_links", f"""
SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM (
  SELECT page_id, unnest(links) AS href, generate_subscripts(links, 1) - 1 AS pos
  FROM (SELECT page_id, {O.page_links(O.strip_nodes('html'))} AS links FROM pages))""")
def q_links(spark, sf):
    p = _pages(spark, sf).select("page_id", page_links("html").alias("links"))
    return p.select("page_id", F.posexplode("links").alias("pos", "href"))


# ------------------------------------------------------------------ U1-U4, U7

_LINKS_CTE = f"""
links AS (
  SELECT page_id, url, CAST(pos AS INTEGER) AS pos, href FROM (
    SELECT page_id, url, unnest(links) AS href, generate_subscripts(links, 1) - 1 AS pos
    FROM (SELECT page_id, url, {O.page_links(O.strip_nodes('html'))} AS links FROM pages)))"""


@register("u1_normalize_links", f"""
WITH {_LINKS_CTE}
SELECT page_id, pos, href, {O.normalize_url('href', 'url')} AS link_url FROM links""")
def q_normalize_links(spark, sf):
    return P.page_links_exploded(_pages(spark, sf))


@register("u1_canonical_pages", f"SELECT page_id, url, {O.normalize_url('url', 'url')} AS canonical FROM pages")
def q_canonical(spark, sf):
    return _pages(spark, sf).select("page_id", "url", U.normalize_url("url", "url").alias("canonical"))


@register("u2_same_host_links", f"""
WITH {_LINKS_CTE},
n AS (SELECT page_id, pos, {O.normalize_url('href', 'url')} AS link_url, url FROM links)
SELECT page_id, pos, {O.same_host('link_url', 'url')} AS same_host,
       {O.url_host('link_url')} AS link_host FROM n""")
def q_same_host(spark, sf):
    ln = P.page_links_exploded(_pages(spark, sf), keep=["url"])
    return ln.select("page_id", "pos", U.same_host("link_url", "url").alias("same_host"),
                     U.url_host("link_url").alias("link_host"))


# Fixed parameters of the pattern queries (a crawl request's globs).
INCLUDE = ["/en/*", "/de/*", "/fr/?*"]
EXCLUDE = ["*.html", "/en/1*"]


def _arr_sql(xs):
    return "[" + ", ".join(O.q(x) for x in xs) + "]::VARCHAR[]"


@register("u3_u4_pattern_filter", f"""
WITH c AS (SELECT page_id, {O.normalize_url('url', 'url')} AS canonical FROM pages)
SELECT page_id, canonical, {O.url_path('canonical')} AS path,
  {O.glob_match(O.url_path('canonical'), O.q(INCLUDE[0]))} AS matches_first_include,
  {O.allowed_by_patterns('canonical', _arr_sql(INCLUDE), _arr_sql(EXCLUDE))} AS allowed
FROM c""")
def q_patterns(spark, sf):
    c = _pages(spark, sf).select("page_id", U.normalize_url("url", "url").alias("canonical"))
    inc = F.array(*[F.lit(x) for x in INCLUDE])
    exc = F.array(*[F.lit(x) for x in EXCLUDE])
    return c.select("page_id", "canonical", U.url_path("canonical").alias("path"),
                    U.glob_match(U.url_path("canonical"), F.lit(INCLUDE[0])).alias("matches_first_include"),
                    U.allowed_by_patterns("canonical", inc, exc).alias("allowed"))


@register("u7_masked_config", """
SELECT c_custkey,
  CASE WHEN position(':' IN substr(u, 14)) > 0 AND regexp_matches(u, ':([^:@]+)@')
       THEN regexp_replace(u, ':([^:@]+)@', ':••••@') ELSE u END AS database_url,
  CASE WHEN k IS NULL OR k = '' THEN 'not set' ELSE substr(k, 1, 6) || repeat('•', 12) END AS api_key
FROM (SELECT c_custkey,
        'postgresql://' || lower(replace(c_name, '#', '')) || ':' || CAST(c_custkey AS VARCHAR)
          || '@db.example.com:5432/app' AS u,
        CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'sk-' || c_mktsegment || CAST(c_custkey AS VARCHAR) END AS k
      FROM customer)""")
def q_masked(spark, sf):
    c = driver_table(spark, sf, "customer")
    cfg = c.select(
        "c_custkey",
        F.concat(F.lit("postgresql://"), F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit(":"),
                 F.col("c_custkey").cast("string"), F.lit("@db.example.com:5432/app")).alias("u"),
        F.when(F.col("c_custkey") % 5 == 0, None)
         .otherwise(F.concat(F.lit("sk-"), "c_mktsegment", F.col("c_custkey").cast("string"))).alias("k"))
    return cfg.select("c_custkey", U.redact_url("u").alias("database_url"), U.mask_secret("k").alias("api_key"))


# ------------------------------------------------------------------ Q1-Q17, C11, C12, C14, K5


_W = O.with_fixtures
_AS_OF = FX.AS_OF
_JAS = FX.JOBS_AS_OF
_RET_DAYS = 7


@register("q1_job_with_pages", _W("jobs", "job_pages") + """
SELECT j.id AS job_id, j.status, j.url, j.pages_discovered, j.pages_scraped, j.pages_failed, j.started_at,
  j.completed_at, j.error, p.ord AS page_ord, p.url AS page_url, p.status AS page_status,
  p.engine AS page_engine, p.title AS page_title, p.scraped_at AS page_scraped_at
FROM jobs j LEFT JOIN job_pages p ON p.job_id = j.id""")
def q_job_with_pages(spark, sf):
    return Q.job_with_pages_flat(FX.jobs(spark, sf), FX.job_pages(spark, sf))


@register("q1_job_with_pages_nested")
def q_job_with_pages_nested(spark, sf):
    """Q1 (nested): each job with its page list ordered by ord (no markdown)."""
    return Q.job_with_pages(FX.jobs(spark, sf), FX.job_pages(spark, sf))


@register("q2_list_jobs", _W("jobs") + """
SELECT id, status, url, pages_discovered, pages_scraped, pages_failed, started_at, completed_at, created_at
FROM jobs ORDER BY created_at, id""")
def q_list_jobs(spark, sf):
    return Q.list_jobs(FX.jobs(spark, sf))


@register("q3_recent_running_jobs", _W("jobs") + """
SELECT * FROM (SELECT * FROM jobs ORDER BY created_at DESC, id DESC LIMIT 100) WHERE status = 'running'""")
def q_recent_jobs(spark, sf):
    return Q.recent_jobs(FX.jobs(spark, sf), "running")


@register("q4_job_page_log", _W("job_pages") + " SELECT * FROM job_pages ORDER BY job_id, ord")
def q_page_log(spark, sf):
    return Q.job_page_log(FX.job_pages(spark, sf))


@register("q5_page_log_rank", _W("jobs", "job_pages") + """
SELECT p.job_id, p.ord, CAST(row_number() OVER (PARTITION BY p.job_id ORDER BY p.ord) AS BIGINT) AS i,
  coalesce(j.status = 'running', false)
    AND row_number() OVER (PARTITION BY p.job_id ORDER BY p.ord) > count(*) OVER (PARTITION BY p.job_id) - 3 AS is_new,
  coalesce(p.title, p.error) AS display_title
FROM job_pages p LEFT JOIN jobs j ON j.id = p.job_id""")
def q_page_rank(spark, sf):
    return Q.page_log_rank(FX.jobs(spark, sf), FX.job_pages(spark, sf))


@register("q6_job_avg_duration", _W("job_pages") + """
SELECT job_id, CAST(floor(avg(duration_ms) + 0.5) AS BIGINT) AS avg_duration_ms FROM job_pages GROUP BY job_id""")
def q_avg_duration(spark, sf):
    return Q.job_avg_duration(FX.job_pages(spark, sf))


@register("q7_progress_pct", _W("jobs") + """
SELECT id, CAST(CASE WHEN pages_discovered > 0 THEN floor(pages_scraped * 100.0 / pages_discovered + 0.5)
  ELSE 0 END AS BIGINT) AS progress_pct FROM jobs""")
def q_progress(spark, sf):
    return Q.progress_pct(FX.jobs(spark, sf))


@register("q8_job_counts", _W("jobs") + """,
known AS (SELECT * FROM (VALUES ('queued'), ('running'), ('completed'), ('failed')) t(status)),
c AS (SELECT status, count(*) AS n FROM jobs GROUP BY status)
SELECT coalesce(known.status, c.status) AS status, CAST(coalesce(c.n, 0) AS BIGINT) AS jobs
FROM known FULL OUTER JOIN c ON known.status = c.status""")
def q_job_counts(spark, sf):
    return Q.job_counts(FX.jobs(spark, sf))


@register("q9_page_totals", _W("jobs") + """
SELECT CAST(coalesce(sum(pages_scraped), 0) AS BIGINT) AS pages_scraped,
       CAST(coalesce(sum(pages_failed), 0) AS BIGINT) AS pages_failed FROM jobs""")
def q_page_totals(spark, sf):
    return Q.page_totals(FX.jobs(spark, sf))


@register("q10_active_monitors", _W("monitors") + """
SELECT CAST(count(*) FILTER (WHERE status = 'active') AS BIGINT) AS active_monitors FROM monitors""")
def q_active_monitors(spark, sf):
    return Q.active_monitors(FX.monitors(spark, sf))


@register("q11_running_jobs", _W("jobs") + """
SELECT id, url, pages_discovered, pages_scraped FROM jobs WHERE status = 'running'""")
def q_running(spark, sf):
    return Q.running_jobs(FX.jobs(spark, sf))


@register("q11_running_count", _W("jobs") + """
SELECT CAST(count(*) FILTER (WHERE status = 'running') AS BIGINT) AS running_count FROM jobs""")
def q_running_count(spark, sf):
    return Q.running_count(FX.jobs(spark, sf))


_NOW = f"TIMESTAMP '{_AS_OF}'"


@register("q12_scrape_stats", _W("scrape_requests") + f""",
s AS (SELECT * FROM scrape_requests WHERE created_at <= {_NOW}),
a AS (SELECT count(*) AS total,
  count(*) FILTER (WHERE created_at >= date_trunc('day', {_NOW})) AS today,
  count(*) FILTER (WHERE created_at >= {_NOW} - INTERVAL 24 HOUR) AS total24,
  avg(duration_ms) FILTER (WHERE created_at >= {_NOW} - INTERVAL 24 HOUR AND status = 'ok') AS av,
  count(*) FILTER (WHERE created_at >= {_NOW} - INTERVAL 24 HOUR AND status = 'ok') AS ok24 FROM s)
SELECT CAST(total AS BIGINT) AS total, CAST(today AS BIGINT) AS today, CAST(total24 AS BIGINT) AS total24,
  CAST(coalesce(floor(av + 0.5), 0) AS BIGINT) AS avg_ms,
  CAST(CASE WHEN total24 > 0 THEN floor(ok24 * 100.0 / total24 + 0.5) ELSE 100 END AS BIGINT) AS success_rate
FROM a""")
def q_scrape_stats(spark, sf):
    return Q.scrape_stats(FX.scrape_requests(spark, sf), _AS_OF)


_MIX_SQL = _W("scrape_requests") + f""",
mix AS (SELECT coalesce(engine, 'unknown') AS engine, CAST(count(*) AS BIGINT) AS n FROM scrape_requests
  WHERE created_at >= {_NOW} - INTERVAL 24 HOUR AND created_at <= {_NOW} GROUP BY 1)"""


@register("q13_engine_mix", _MIX_SQL + " SELECT * FROM mix")
def q_engine_mix(spark, sf):
    return Q.engine_mix(FX.scrape_requests(spark, sf), _AS_OF)


@register("q14_browser_share", _MIX_SQL + """,
t AS (SELECT coalesce(sum(n) FILTER (WHERE engine = 'browser'), 0) AS b,
             coalesce(sum(n) FILTER (WHERE engine = 'fetch'), 0) AS f FROM mix)
SELECT CAST(CASE WHEN b + f > 0 THEN floor(b * 100.0 / (b + f) + 0.5) ELSE 0 END AS BIGINT) AS browser_pct FROM t""")
def q_browser_share(spark, sf):
    return Q.browser_share(Q.engine_mix(FX.scrape_requests(spark, sf), _AS_OF))


@register("q15_recent_browser_scrapes", _W("scrape_requests") + """
SELECT * FROM (SELECT * FROM scrape_requests ORDER BY created_at DESC, id DESC LIMIT 200)
WHERE source = 'scrape' AND engine = 'browser'""")
def q_recent_scrapes(spark, sf):
    return Q.recent_scrapes(FX.scrape_requests(spark, sf), "scrape", "browser")


@register("q16_overview_jobs", _W("jobs") + " SELECT * FROM jobs ORDER BY created_at DESC, id DESC LIMIT 8")
def q_overview_jobs(spark, sf):
    return Q.overview(FX.jobs(spark, sf), FX.scrape_requests(spark, sf), _AS_OF)["jobs"]


@register("q16_overview_scrapes", _W("scrape_requests") + f"""
SELECT * FROM scrape_requests WHERE created_at <= {_NOW} ORDER BY created_at DESC, id DESC LIMIT 10""")
def q_overview_scrapes(spark, sf):
    return Q.overview(FX.jobs(spark, sf), FX.scrape_requests(spark, sf), _AS_OF)["scrapes"]


@register("q17_retain_logs", _W("logs") + f"""
SELECT * FROM logs WHERE created_at >= {_NOW} - INTERVAL {_RET_DAYS} DAY""")
def q_retain_logs(spark, sf):
    return Q.retain_logs(FX.logs(spark, sf), _AS_OF, _RET_DAYS)


@register("q17_stored_logs", _W("logs") + f"""
SELECT * FROM logs WHERE created_at >= {_NOW} - INTERVAL {_RET_DAYS} DAY""")
def q_retain_stored(spark, sf):
    """Q17 on a stored log: whole days are dropped, the day of the cutoff is rewritten."""
    path = fresh_dir(spark, "logs")
    logs = FX.logs(spark, sf)
    SK.write_scrape_log(logs, path)
    SK.drop_expired(spark, path, _AS_OF, _RET_DAYS)
    return SK.read_dated(spark, path, logs.schema).drop("created_date")


_PROGRESS_SQL = """,
progress AS (SELECT job_id, CAST(count(*) FILTER (WHERE status = 'scraped') AS INTEGER) AS pages_scraped,
  CAST(count(*) FILTER (WHERE status <> 'scraped') AS INTEGER) AS pages_failed,
  max(scraped_at) AS last_heartbeat_at, max(ord) AS last_ord FROM job_pages GROUP BY job_id)"""


@register("c11_job_progress", _W("job_pages") + _PROGRESS_SQL + " SELECT * FROM progress")
def q_job_progress(spark, sf):
    return Q.job_progress(FX.job_pages(spark, sf))


@register("c12_finalize_jobs", _W("jobs", "job_pages") + _PROGRESS_SQL + f"""
SELECT j.id,
  CASE WHEN j.status = 'running' THEN CASE WHEN j.error IS NOT NULL THEN 'failed' ELSE 'completed' END
       ELSE j.status END AS status,
  CAST(CASE WHEN j.status = 'running' THEN coalesce(p.pages_scraped, 0) ELSE j.pages_scraped END AS INTEGER) AS pages_scraped,
  CAST(CASE WHEN j.status = 'running' THEN coalesce(p.pages_failed, 0) ELSE j.pages_failed END AS INTEGER) AS pages_failed,
  CASE WHEN j.status = 'running' THEN TIMESTAMP '{_JAS}' ELSE j.completed_at END AS completed_at,
  coalesce(p.last_heartbeat_at, j.last_heartbeat_at) AS last_heartbeat_at, j.error
FROM jobs j LEFT JOIN progress p ON p.job_id = j.id""")
def q_finalize(spark, sf):
    return Q.finalize_jobs(FX.jobs(spark, sf), Q.job_progress(FX.job_pages(spark, sf)), _JAS)


@register("c14_stale_jobs", _W("jobs") + f"""
SELECT id, url, last_heartbeat_at FROM jobs
WHERE status = 'running' AND last_heartbeat_at < TIMESTAMP '{_JAS}' - INTERVAL 120 SECOND""")
def q_stale(spark, sf):
    return Q.stale_jobs(FX.jobs(spark, sf), _JAS)


@register("k5_metrics_exposition", (_W("jobs", "monitors") + """,
known AS (SELECT * FROM (VALUES ('queued', 0), ('running', 1), ('completed', 2), ('failed', 3)) t(status, pos)),
c AS (SELECT status, count(*) AS n FROM jobs GROUP BY status),
counts AS (SELECT coalesce(known.status, c.status) AS status, coalesce(c.n, 0) AS n, known.pos
           FROM known FULL OUTER JOIN c ON known.status = c.status),
tot AS (SELECT coalesce(sum(pages_scraped), 0) AS s, coalesce(sum(pages_failed), 0) AS f FROM jobs),
act AS (SELECT count(*) FILTER (WHERE status = 'active') AS a FROM monitors)
SELECT * FROM (VALUES
  (1, '# HELP __P___jobs_total Crawl jobs by status'), (2, '# TYPE __P___jobs_total gauge'), (100, ''),
  (101, '# HELP __P___pages_scraped_total Total pages successfully scraped across all jobs'),
  (102, '# TYPE __P___pages_scraped_total counter'), (104, ''),
  (105, '# HELP __P___pages_failed_total Total pages that failed across all jobs'),
  (106, '# TYPE __P___pages_failed_total counter'), (108, ''),
  (109, '# HELP __P___monitors_active Active monitors'), (110, '# TYPE __P___monitors_active gauge'), (112, '')
) t(line_no, line)
UNION ALL SELECT CAST(10 + coalesce(pos, 4 + dense_rank() OVER (ORDER BY status)) AS INTEGER),
  '__P___jobs_total{status="' || status || '"} ' || CAST(n AS VARCHAR) FROM counts
UNION ALL SELECT 103, '__P___pages_scraped_total ' || CAST(s AS VARCHAR) FROM tot
UNION ALL SELECT 107, '__P___pages_failed_total ' || CAST(f AS VARCHAR) FROM tot
UNION ALL SELECT 111, '__P___monitors_active ' || CAST(a AS VARCHAR) FROM act""").replace("__P___", Q.METRIC_PREFIX + "_"))
def q_metrics(spark, sf):
    return Q.metrics_exposition(FX.jobs(spark, sf), FX.monitors(spark, sf))


# ------------------------------------------------------------------ S1, S2, X3, X5, X6, X7, K2



@register("s2_classify_responses", _W("responses") + """
SELECT url, http_status,
  CASE WHEN error IS NOT NULL AND (contains(error, 'TimeoutError') OR contains(error, 'abort')) THEN 'timeout'
       WHEN error IS NOT NULL THEN 'error' WHEN http_status = 304 THEN 'scraped'
       WHEN http_status = 404 THEN 'not_found' WHEN http_status IN (403, 429) THEN 'blocked'
       WHEN http_status IS NULL OR http_status < 200 OR http_status >= 300 THEN 'error' ELSE 'scraped' END AS status,
  coalesce(error IS NULL AND http_status = 304, false) AS unchanged,
  CASE WHEN error IS NOT NULL AND (contains(error, 'TimeoutError') OR contains(error, 'abort')) THEN 'Request timed out'
       WHEN error IS NOT NULL THEN error WHEN http_status = 304 THEN NULL
       WHEN http_status IS NULL OR http_status < 200 OR http_status >= 300 THEN 'HTTP ' || CAST(http_status AS VARCHAR)
  END AS error
FROM responses""")
def q_classify(spark, sf):
    r = FX.responses(spark, sf)
    status, unchanged, err = X.classify_response()
    return r.select("url", "http_status", status.alias("status"), unchanged.alias("unchanged"), err.alias("error"))


@register("x7_scrape_pages")
def q_scrape_pages(spark, sf):
    """X1-X5 + S2 over captured responses; markdown via the Python tree walk."""
    s = X.scrape_pages(FX.responses(spark, sf), keep=("page_id",))
    return s.select("page_id", "url", "status", "unchanged", "title", "markdown_length", "thin",
                    F.size("links").alias("n_links"), "error",
                    F.sha2(F.col("markdown"), 256).alias("markdown_sha256"))


@register("x7_scrape_facts", _W("responses") + f""",
c AS (SELECT *,
  CASE WHEN error IS NOT NULL AND (contains(error, 'TimeoutError') OR contains(error, 'abort')) THEN 'timeout'
       WHEN error IS NOT NULL THEN 'error' WHEN http_status = 304 THEN 'scraped'
       WHEN http_status = 404 THEN 'not_found' WHEN http_status IN (403, 429) THEN 'blocked'
       WHEN http_status IS NULL OR http_status < 200 OR http_status >= 300 THEN 'error' ELSE 'scraped' END AS status,
  coalesce(error IS NULL AND http_status = 304, false) AS unchanged FROM responses)
SELECT page_id, url, status, unchanged,
  CASE WHEN status = 'scraped' AND NOT unchanged THEN {O.page_title(O.strip_nodes('html'))} END AS title,
  CASE WHEN status = 'scraped' AND NOT unchanged THEN {O.page_links(O.strip_nodes('html'))} END AS links FROM c""")
def q_scrape_facts(spark, sf):
    """X7 as crawl rounds run it: status, title and links without markdown."""
    s = X.scrape_pages(FX.responses(spark, sf), keep=("page_id",), with_markdown=False)
    return s.select("page_id", "url", "status", "unchanged", "title", "links")


@register("x6_choose_rendering_auto")
def q_choose_rendering(spark, sf):
    plain = X.scrape_pages(FX.responses(spark, sf))
    rendered = X.scrape_pages(FX.rendered_responses(spark, sf))
    return X.choose_rendering(plain, rendered, "auto", "crawl").select(
        "url", "engine", "status", "title", "markdown_length", "error")


@register("k2_scrape_log_rows")
def q_scrape_log(spark, sf):
    plain = X.scrape_pages(FX.responses(spark, sf), keep=("duration_ms", "fetched_at"))
    rendered = X.scrape_pages(FX.rendered_responses(spark, sf), keep=("duration_ms", "fetched_at"))
    chosen = X.choose_rendering(plain, rendered, "auto", "scrape")
    return X.scrape_log_rows(chosen, "auto", "scrape")


@register("k2_scrape_log_facts", _W("responses") + f"""
SELECT url, 'scrape' AS source, CASE WHEN ok THEN 'fetch' END AS engine, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status, duration_ms,
  CASE WHEN ok THEN {O.page_title(O.strip_nodes('html'))} END AS title,
  CASE WHEN ok THEN NULL WHEN error IS NOT NULL THEN 'Failed to fetch ' || url || ': ' || error
       ELSE url || ' returned HTTP ' || http_status END AS error, fetched_at AS created_at
FROM (SELECT *, coalesce(error IS NULL AND http_status BETWEEN 200 AND 299, false) AS ok FROM responses)""")
def q_scrape_log_facts(spark, sf):
    """K2 of plain scrapes: every column of the log row but the markdown's length."""
    plain = X.scrape_pages(FX.responses(spark, sf), keep=("duration_ms", "fetched_at"), with_markdown=False)
    return X.scrape_log_rows(plain, "auto", "scrape").drop("markdown_length")


@register("x5_thin_texts", f"""
SELECT doc_id, {O.utf16_length("coalesce(text, '')")} < 150 AS thin FROM documents""")
def q_thin_texts(spark, sf):
    """X5 over texts that are markdown already: under 150 UTF-16 units."""
    from ..functions.html import is_thin
    return driver_table(spark, sf, "documents").select("doc_id", is_thin(F.coalesce("text", F.lit(""))).alias("thin"))


# ------------------------------------------------------------------ crawl: S3-S6, U5, U6, C1-C15, K1, K3



@register("c1_validate_crawl_requests", _W("crawl_requests") + """,
v AS (SELECT id, url, coalesce(max_depth, 2) AS d, coalesce(max_pages, 100) AS p, coalesce(engine, 'auto') AS e,
        webhook_url FROM crawl_requests),
x AS (SELECT id, d, p, e, list_filter([
        CASE WHEN NOT coalesce(regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^\\s/?#]+'), false)
             THEN 'url must be a URL address with protocol' END,
        CASE WHEN d < 1 OR d > 10 THEN 'max-depth must be between 1 and 10' END,
        CASE WHEN p < 1 OR p > 1000 THEN 'max-pages must be between 1 and 1000' END,
        CASE WHEN e NOT IN ('fetch', 'browser', 'auto') THEN 'engine must be one of fetch, browser, auto' END,
        CASE WHEN NOT (webhook_url IS NULL OR regexp_matches(webhook_url, '^https?://[^\\s/?#]+'))
             THEN 'webhook-url must be a URL address' END], lambda z_: z_ IS NOT NULL) AS errs FROM v)
SELECT id, CAST(d AS INTEGER) AS max_depth, CAST(p AS INTEGER) AS max_pages, e AS engine,
  len(errs) = 0 AS valid, array_to_string(errs, '; ') AS errors FROM x""")
def q_validate(spark, sf):
    valid, rejected = C.validate_crawl_requests(FX.crawl_requests(spark, sf))
    v = valid.select("id", "max_depth", "max_pages", "engine", F.lit(True).alias("valid"), F.lit("").alias("errors"))
    r = rejected.select("id", "max_depth", "max_pages", "engine", F.lit(False).alias("valid"),
                        F.array_join("errors", "; ").alias("errors"))
    return v.unionByName(r)


@register("c2_create_jobs", _W("crawl_requests") + """
SELECT id, 'queued' AS status, url, CAST(coalesce(max_depth, 2) AS INTEGER) AS max_depth,
  CAST(coalesce(max_pages, 100) AS INTEGER) AS max_pages, coalesce(engine, 'auto') AS engine
FROM crawl_requests
WHERE coalesce(regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^\\s/?#]+'), false)
  AND coalesce(max_depth, 2) BETWEEN 1 AND 10 AND coalesce(max_pages, 100) BETWEEN 1 AND 1000
  AND coalesce(engine, 'auto') IN ('fetch', 'browser', 'auto')
  AND (webhook_url IS NULL OR regexp_matches(webhook_url, '^https?://[^\\s/?#]+'))""")
def q_create_jobs(spark, sf):
    valid, _ = C.validate_crawl_requests(FX.crawl_requests(spark, sf))
    return C.create_jobs(valid).select("id", "status", "url", "max_depth", "max_pages", "engine")


@register("s3_sitemap_locs", _W("link_graph", "crawl_sitemaps") + """
SELECT sitemap_url, CAST(pos - 1 AS INTEGER) AS loc_pos, trim(loc) AS loc FROM (
  SELECT sitemap_url, unnest(l) AS loc, generate_subscripts(l, 1) AS pos FROM (
    SELECT sitemap_url, regexp_extract_all(xml, '(?i)<loc>\\s*(https?://[^<]+?)\\s*</loc>', 1) AS l
    FROM crawl_sitemaps))""")
def q_sitemap_locs(spark, sf):
    return C.sitemap_locs(FX.crawl_sitemaps(spark, sf))


@register("s4_expand_sitemaps", _W("link_graph", "crawl_sitemaps") + """,
locs AS (SELECT sitemap_url, CAST(pos - 1 AS INTEGER) AS loc_pos, trim(loc) AS loc FROM (
  SELECT sitemap_url, unnest(l) AS loc, generate_subscripts(l, 1) AS pos FROM (
    SELECT sitemap_url, regexp_extract_all(xml, '(?i)<loc>\\s*(https?://[^<]+?)\\s*</loc>', 1) AS l
    FROM crawl_sitemaps))),
roots AS (SELECT 'job_h' || CAST(page_id AS VARCHAR) AS job_id, 'https://' || host || '/sitemap.xml' AS sitemap_url
          FROM link_graph WHERE rank = 1),
r AS (SELECT roots.*, regexp_matches(xml, '(?i)<sitemapindex[\\s>]') AS is_index
      FROM roots JOIN crawl_sitemaps USING (sitemap_url)),
plain AS (SELECT job_id, -1 AS src_pos, loc_pos, loc FROM r JOIN locs USING (sitemap_url) WHERE NOT is_index),
children AS (SELECT job_id, loc_pos AS src_pos, loc AS child_url FROM r JOIN locs USING (sitemap_url)
             WHERE is_index AND ends_with(loc, '.xml')),
sub AS (SELECT job_id, src_pos, l.loc_pos, l.loc FROM children c JOIN locs l ON l.sitemap_url = c.child_url)
SELECT job_id, CAST(src_pos AS INTEGER) AS src_pos, loc_pos, loc FROM (SELECT * FROM plain UNION ALL SELECT * FROM sub)
WHERE NOT ends_with(loc, '.xml')""")
def q_expand_sitemaps(spark, sf):
    jobs = FX.crawl_jobs(spark, sf)
    roots = jobs.select(F.col("id").alias("job_id"),
                        F.concat(U.url_origin("url"), F.lit("/sitemap.xml")).alias("sitemap_url"))
    return C.expand_sitemaps(roots, FX.crawl_sitemaps(spark, sf))


def _s5_sql():
    norm = O.normalize_url("loc", "seed")
    return _W("link_graph", "crawl_sitemaps", "crawl_robots", "robots_rules", "crawl_jobs") + f""",
locs AS (SELECT sitemap_url, CAST(pos - 1 AS INTEGER) AS loc_pos, trim(loc) AS loc FROM (
  SELECT sitemap_url, unnest(l) AS loc, generate_subscripts(l, 1) AS pos FROM (
    SELECT sitemap_url, regexp_extract_all(xml, '(?i)<loc>\\s*(https?://[^<]+?)\\s*</loc>', 1) AS l
    FROM crawl_sitemaps))),
roots AS (SELECT id AS job_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/sitemap.xml' AS sitemap_url FROM crawl_jobs),
r AS (SELECT roots.*, regexp_matches(xml, '(?i)<sitemapindex[\\s>]') AS is_index
      FROM roots JOIN crawl_sitemaps USING (sitemap_url)),
plain AS (SELECT job_id, -1 AS src_pos, loc_pos, loc FROM r JOIN locs USING (sitemap_url) WHERE NOT is_index),
children AS (SELECT job_id, loc_pos AS src_pos, loc AS child_url FROM r JOIN locs USING (sitemap_url)
             WHERE is_index AND ends_with(loc, '.xml')),
sub AS (SELECT job_id, src_pos, l.loc_pos, l.loc FROM children c JOIN locs l ON l.sitemap_url = c.child_url),
ex AS (SELECT * FROM (SELECT * FROM plain UNION ALL SELECT * FROM sub) WHERE NOT ends_with(loc, '.xml')),
c0 AS (SELECT ex.job_id, ex.src_pos, ex.loc_pos, j.url AS seed, j.max_pages, j.include_patterns, j.exclude_patterns,
         {norm} AS url
       FROM ex JOIN crawl_jobs j ON j.id = ex.job_id),
c1 AS (SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
         regexp_extract(url, '^[a-z]+://[^/]+(/[^#]*)?', 1) AS pq FROM c0
       WHERE url IS NOT NULL AND {O.url_host('url')} = {O.url_host('seed')}
         AND regexp_extract(url, '^(https?://[^/?#]+)', 1) = regexp_extract(seed, '^(https?://[^/?#]+)', 1)
         AND {O.allowed_by_patterns('url', 'include_patterns', 'exclude_patterns')}),
m AS (SELECT DISTINCT c1.origin, c1.pq, r.allow, length(r.pattern) AS plen FROM c1 JOIN robots_rules r ON r.origin = c1.origin
      WHERE regexp_matches(c1.pq, r.regex)),
v AS (SELECT origin, pq, arg_max(allow, plen * 2 + CAST(allow AS INTEGER)) AS allow FROM m GROUP BY origin, pq),
c2 AS (SELECT c1.* FROM c1 LEFT JOIN v USING (origin, pq) WHERE coalesce(v.allow, true)),
c3 AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY src_pos, loc_pos) AS n FROM c2),
c4 AS (SELECT * FROM c3 WHERE n <= max_pages * 3),
c5 AS (SELECT *, row_number() OVER (PARTITION BY job_id, url ORDER BY n) AS dup FROM c4),
c6 AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n) AS k FROM c5 WHERE dup = 1),
seeds AS (SELECT job_id, url, CAST(src_pos AS INTEGER) AS src_pos, loc_pos, CAST(k AS INTEGER) AS n FROM c6 WHERE k <= max_pages)"""


@register("s5_discover_from_sitemap", _s5_sql() + " SELECT * FROM seeds")
def q_discover(spark, sf):
    jobs = FX.crawl_jobs(spark, sf)
    jobs = U.evaluate_once(jobs, _sp=U.parse_url_parts("url"))
    jobs = jobs.select("*", F.col("_sp.host").alias("seed_host"), U.url_origin_of(F.col("_sp")).alias("seed_origin"))
    rules = C.robots_rules(FX.crawl_robots(spark, sf))
    return C.discover_from_sitemap(jobs.drop("_sp"), FX.crawl_sitemaps(spark, sf), rules)


@register("u6_dedupe_links", f"""
WITH {_LINKS_CTE},
n AS (SELECT page_id, pos, {O.normalize_url('href', 'url')} AS link_url,
        regexp_extract(url, '^https?://([^/?#]+)', 1) AS site FROM links),
r AS (SELECT *, row_number() OVER (PARTITION BY site, link_url ORDER BY page_id, pos) AS rn FROM n
      WHERE link_url IS NOT NULL)
SELECT site, link_url, page_id, pos FROM r WHERE rn = 1""")
def q_dedupe(spark, sf):
    ln = P.page_links_exploded(_pages(spark, sf), keep=["url"]) \
        .withColumn("site", F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    ln = ln.where(F.col("link_url").isNotNull()).select("site", "link_url", "page_id", "pos")
    return C.dedupe_urls(ln, ["site", "link_url"], ["page_id", "pos"])


@register("c9_politeness_plan", f"""
WITH c AS (SELECT page_id, {O.normalize_url('url', 'url')} AS url FROM pages),
h AS (SELECT page_id, url, {O.url_host('url')} AS host FROM c WHERE url IS NOT NULL)
SELECT page_id, url, host, CAST((row_number() OVER (PARTITION BY host ORDER BY page_id, url) - 1) * 300 AS BIGINT) AS slot_ms
FROM h""")
def q_politeness(spark, sf):
    c = _pages(spark, sf).select("page_id", U.normalize_url("url", "url").alias("url")).where(F.col("url").isNotNull())
    return C.politeness_plan(c, "page_id").select("page_id", "url", "host", "slot_ms")


@register("c10_politeness_violations", _W("job_pages") + f""",
h AS (SELECT job_id, ord, url, scraped_at, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM job_pages),
l AS (SELECT *, lag(scraped_at) OVER (PARTITION BY host ORDER BY scraped_at, job_id, ord) AS prev_scraped_at FROM h)
SELECT host, job_id, ord, url, scraped_at, prev_scraped_at,
  CAST((epoch_us(scraped_at) - epoch_us(prev_scraped_at)) / 1000 AS BIGINT) AS gap_ms
FROM l WHERE prev_scraped_at IS NOT NULL AND (epoch_us(scraped_at) - epoch_us(prev_scraped_at)) / 1000 < 300""")
def q_violations(spark, sf):
    return C.politeness_violations(FX.job_pages(spark, sf))


@register("k3_crawl_outbox", _W("jobs") + """
SELECT id AS job_id, webhook_url,
  '{"job-id":' || to_json(id) || ',"status":' || to_json(status) || ',"pages-scraped":' || CAST(pages_scraped AS VARCHAR)
  || ',"pages-failed":' || CAST(pages_failed AS VARCHAR) || ',"results-url":' || to_json('/jobs/' || id) || '}' AS payload
FROM jobs WHERE webhook_url IS NOT NULL AND status IN ('completed', 'failed')""")
def q_outbox(spark, sf):
    return C.crawl_outbox(FX.jobs(spark, sf))


def _crawl(spark, sf):
    return PC.crawl(spark, FX.crawl_jobs(spark, sf), FX.crawl_responses(spark, sf), FX.crawl_sitemaps(spark, sf),
                    FX.crawl_robots(spark, sf), rendered=FX.crawl_rendered(spark, sf))


@register("c7_crawl_pages")
def q_crawl_pages(spark, sf):
    """Every page row of a bounded BFS over all link-graph jobs."""
    return _crawl(spark, sf).pages.select("job_id", "ord", "url", "depth", "status", "engine", "title",
                                          "error", "markdown_length", "scraped_at")


@register("c7_crawl_jobs")
def q_crawl_jobs(spark, sf):
    """C7 + C11/C12 counters + K3 payload of the crawl's jobs."""
    j = _crawl(spark, sf).jobs
    return j.join(C.crawl_outbox(j).select(F.col("job_id").alias("id"), "payload"), "id", "left") \
            .select("id", "status", "pages_discovered", "pages_scraped", "pages_failed", "root_failed", "payload")


@register("c15_resumed_jobs", _W("jobs") + f"""
SELECT id, status, CASE WHEN status = 'running' AND last_heartbeat_at < TIMESTAMP '{_JAS}' - INTERVAL 2 MINUTE
  THEN TIMESTAMP '{_JAS}' ELSE last_heartbeat_at END AS last_heartbeat_at FROM jobs""")
def q_resumed_jobs(spark, sf):
    """C14 + C15: stale jobs are taken up again, which resets their heartbeat."""
    return Q.resume_jobs(FX.jobs(spark, sf), _JAS).select("id", "status", "last_heartbeat_at")


def _crawl_sql(levels: int) -> str:
    """CTEs of a plain crawl (no sitemaps, robots or renderings) level by
    level: ``pages`` (job_id, ord, url, depth, status, skipped, title,
    scraped_at) of the first ``levels`` levels and ``visited`` (job_id, url,
    depth, ord) up to the next one. A level's backoff is a recursion over
    its pops."""
    status = """CASE WHEN c.url IS NULL OR c.error IS NOT NULL THEN 'error' WHEN http_status = 404 THEN 'not_found'
      WHEN http_status IN (403, 429) THEN 'blocked' WHEN http_status BETWEEN 200 AND 299 THEN 'scraped' ELSE 'error' END"""
    doc = O.strip_nodes("html")
    sql = _W("link_graph", "crawl_jobs", "crawl_responses").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
cfg AS MATERIALIZED (SELECT id AS job_id, url AS seed, {O.normalize_url('url', 'url')} AS root, {O.url_host('url')} AS host,
  regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, max_pages, max_depth, include_patterns, exclude_patterns FROM crawl_jobs),
caps AS MATERIALIZED (SELECT url, http_status, error, fetched_at, {O.page_title(doc)} AS title FROM crawl_responses),
raw AS (SELECT url AS page_url, unnest(links) AS href, generate_subscripts(links, 1) - 1 AS pos
        FROM (SELECT url, {O.page_links(doc)} AS links FROM crawl_responses WHERE http_status = 200)),
edge AS MATERIALIZED (SELECT page_url, pos, cand, {O.url_host('cand')} AS host, regexp_extract(cand, '^(https?://[^/?#]+)', 1) AS origin
         FROM (SELECT *, {O.normalize_url('href', 'page_url')} AS cand FROM raw) WHERE cand IS NOT NULL),
v0 AS (SELECT job_id, root AS url, 0 AS depth, CAST(1 AS BIGINT) AS ord FROM cfg WHERE root IS NOT NULL),
u0 AS (SELECT job_id, NULL::TIMESTAMP AS until FROM cfg)"""
    for r in range(levels):
        seen = " UNION ALL ".join(f"SELECT job_id, url FROM v{i}" for i in range(r + 1))
        sql += f""",
p{r} AS MATERIALIZED (SELECT v.*, {status} AS status, c.fetched_at, c.title, row_number() OVER (PARTITION BY v.job_id ORDER BY v.ord) AS k
  FROM v{r} v JOIN cfg USING (job_id) LEFT JOIN caps c ON c.url = v.url WHERE v.ord <= cfg.max_pages),
b{r} AS (SELECT job_id, CAST(0 AS BIGINT) AS k, false AS skipped, until FROM u{r}
  UNION ALL
  SELECT p.job_id, p.k, s.skip, CASE WHEN NOT s.skip AND p.status = 'blocked' THEN coalesce(b.until, p.fetched_at) + INTERVAL 30 SECOND ELSE b.until END
  FROM b{r} b JOIN p{r} p ON p.job_id = b.job_id AND p.k = b.k + 1,
       LATERAL (SELECT coalesce(b.until IS NOT NULL AND p.fetched_at < b.until, false) AS skip) s),
g{r} AS MATERIALIZED (SELECT p.*, b.skipped FROM p{r} p JOIN b{r} b ON b.job_id = p.job_id AND b.k = p.k),
u{r + 1} AS MATERIALIZED (SELECT job_id, arg_max(until, k) AS until FROM b{r} GROUP BY job_id),
c{r} AS (SELECT g.job_id, e.cand, g.depth + 1 AS depth, g.ord, e.pos FROM g{r} g JOIN cfg USING (job_id) JOIN edge e ON e.page_url = g.url
  WHERE g.status = 'scraped' AND NOT g.skipped AND g.depth < cfg.max_depth AND e.host = cfg.host AND e.origin = cfg.origin
    AND {O.allowed_by_patterns('e.cand', 'cfg.include_patterns', 'cfg.exclude_patterns')}),
d{r} AS (SELECT job_id, cand, depth, row_number() OVER (PARTITION BY job_id ORDER BY ord, pos) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id, cand ORDER BY ord, pos) AS f FROM c{r}) x
  WHERE f = 1 AND NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.job_id = x.job_id AND s.url = x.cand)),
v{r + 1} AS MATERIALIZED (SELECT d.job_id, d.cand AS url, d.depth, h.n + d.n AS ord FROM d{r} d JOIN cfg USING (job_id)
  JOIN (SELECT job_id, max(ord) AS n FROM v{r} GROUP BY job_id) h USING (job_id) WHERE h.n + d.n <= 3 * cfg.max_pages)"""
    return sql + f""",
pages AS (SELECT job_id, ord, url, depth, skipped, CASE WHEN skipped THEN 'blocked' ELSE status END AS status,
    CASE WHEN NOT skipped AND status = 'scraped' THEN title END AS title, fetched_at AS scraped_at
  FROM ({" UNION ALL ".join(f"SELECT * FROM g{r}" for r in range(levels))})),
visited AS ({" UNION ALL ".join(f"SELECT * FROM v{r}" for r in range(levels + 1))})"""


@register("c7_plain_crawl_pages", _crawl_sql(C.DEPTH_MAX + 1) + f"""
SELECT job_id, ord, url, depth, status, title, scraped_at FROM pages""")
def q_plain_pages(spark, sf):
    """C7 with plain fetches: every page row of the link-graph jobs."""
    return PC.crawl(spark, FX.crawl_jobs(spark, sf), FX.crawl_responses(spark, sf)).pages.select(
        "job_id", "ord", "url", "depth", "status", "title", "scraped_at")


@register("c7_plain_crawl_jobs", _crawl_sql(C.DEPTH_MAX + 1) + f"""
SELECT c.job_id AS id, 'completed' AS status, CAST(coalesce(v.n, 0) AS INTEGER) AS pages_discovered,
  CAST(coalesce(p.s, 0) AS INTEGER) AS pages_scraped, CAST(coalesce(p.f, 0) AS INTEGER) AS pages_failed, p.hb AS last_heartbeat_at
FROM cfg c LEFT JOIN (SELECT job_id, count(*) AS n FROM visited GROUP BY 1) v USING (job_id)
LEFT JOIN (SELECT job_id, count(*) FILTER (status = 'scraped') AS s, count(*) FILTER (status <> 'scraped') AS f, max(scraped_at) AS hb
           FROM pages GROUP BY 1) p USING (job_id)""")
def q_plain_jobs(spark, sf):
    """C7 + C11/C12: job rows of the crawl with plain fetches."""
    return PC.crawl(spark, FX.crawl_jobs(spark, sf), FX.crawl_responses(spark, sf)).jobs.select(
        "id", "status", "pages_discovered", "pages_scraped", "pages_failed", "last_heartbeat_at")


@register("c15_resume_frontier", _crawl_sql(2) + f"""
SELECT job_id, url, depth, ord FROM visited v WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.job_id = v.job_id AND p.url = v.url)""")
def q_resume(spark, sf):
    """C14 + C15: crawls stopped after two rounds are marked running with
    an old heartbeat; C14 finds them stale and C15 returns their remaining
    frontier (admitted URLs without a page row) in FIFO order."""
    jobs = FX.crawl_jobs(spark, sf)
    r = PC.crawl(spark, jobs, FX.crawl_responses(spark, sf), max_rounds=2)
    stale = r.jobs.select("id", "url", F.lit("running").alias("status"),
                          F.lit("2024-01-30 00:00:00").cast("timestamp_ntz").alias("last_heartbeat_at"))
    stale = Q.stale_jobs(stale, "2024-01-30 00:05:00")
    return C.resume_frontier(stale, r.visited, r.pages).select("job_id", "url", "depth", "ord")


@register("c15_resumed_crawl", _crawl_sql(C.DEPTH_MAX + 1) + """
SELECT job_id, ord, url, depth, status, title, scraped_at FROM pages""")
def q_resumed(spark, sf):
    """Crawls stopped after one round and resumed from their store have the pages of an uninterrupted crawl."""
    store, caps = fresh_dir(spark, "stopped-crawl"), FX.crawl_responses(spark, sf)
    PC.crawl(spark, FX.crawl_jobs(spark, sf), caps, max_rounds=1, store=store)
    return PC.resume_crawl(spark, store, caps).pages.select("job_id", "ord", "url", "depth", "status", "title", "scraped_at")


# ------------------------------------------------------------------ monitoring: M1-M16, K4


_RUN_AT = "2024-01-30 12:00:00"


def _state(spark, sf):
    return M.snapshot_state(FX.monitor_prev(spark, sf))


@register("m1_create_monitors", _W("crawl_requests") + """,
r AS (SELECT *, CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT) AS k FROM crawl_requests),
f AS (SELECT *, coalesce(CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'hourly' WHEN k % 5 = 2 THEN 'daily'
        WHEN k % 5 = 3 THEN 'weekly' ELSE 'monthly' END, 'daily') AS frequency,
        CASE WHEN k % 3 = 0 THEN 'Watch ' || url END AS goal FROM r)
SELECT id, url, CAST(coalesce(max_depth, 2) AS INTEGER) AS max_depth, CAST(coalesce(max_pages, 100) AS INTEGER) AS max_pages,
  frequency, webhook_url, 'active' AS status, goal FROM f
WHERE coalesce(regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^\\s/?#]+'), false)
  AND coalesce(max_depth, 2) BETWEEN 1 AND 10 AND coalesce(max_pages, 100) BETWEEN 1 AND 1000
  AND coalesce(engine, 'auto') IN ('fetch', 'browser', 'auto')
  AND webhook_url IS NOT NULL AND regexp_matches(webhook_url, '^https?://[^\\s/?#]+')
  AND frequency IN ('hourly', 'daily', 'weekly')""")
def q_create_monitors(spark, sf):
    ok, _ = M.create_monitors(FX.monitor_requests(spark, sf))
    return ok.select("id", "url", "max_depth", "max_pages", "frequency", "webhook_url", "status", "goal")


@register("m2_list_monitors", _W("monitors") + " SELECT * FROM monitors ORDER BY created_at DESC, id DESC")
def q_list_monitors(spark, sf):
    return M.list_monitors(FX.monitors(spark, sf))


@register("m3_transition_monitors", _W("monitors") + """,
n AS (SELECT id, CAST(regexp_extract(id, '(\\d+)$', 1) AS INTEGER) AS n FROM monitors),
cmd AS (SELECT id AS monitor_id, 1 AS seq, 'pause' AS action FROM n WHERE n % 2 = 0
  UNION ALL SELECT id, 2, 'resume' FROM n WHERE n % 4 = 0
  UNION ALL SELECT id, 3, 'delete' FROM n WHERE n % 5 = 0
  UNION ALL SELECT id, 4, 'archive' FROM n WHERE n % 3 = 0),
last AS (SELECT monitor_id, action FROM (SELECT *, row_number() OVER (PARTITION BY monitor_id ORDER BY seq DESC) AS r
         FROM cmd WHERE action IN ('pause', 'resume', 'delete')) WHERE r = 1)
SELECT m.id, m.url, m.max_depth, m.max_pages, m.include_patterns, m.exclude_patterns, m.frequency, m.webhook_url,
  coalesce(CASE l.action WHEN 'pause' THEN 'paused' WHEN 'resume' THEN 'active' WHEN 'delete' THEN 'deleted' END,
           m.status) AS status, m.goal, m.last_checked_at, m.last_job_id, m.created_at
FROM monitors m LEFT JOIN last l ON l.monitor_id = m.id""")
def q_transition(spark, sf):
    return M.transition_monitors(FX.monitors(spark, sf), FX.monitor_commands(spark, sf))


@register("m4_due_monitors", _W("monitors") + f""",
t AS (SELECT *, CASE WHEN frequency = 'hourly' THEN date_trunc('hour', TIMESTAMP '{_RUN_AT}')
  WHEN frequency = 'weekly' THEN date_trunc('day', TIMESTAMP '{_RUN_AT}') - to_days(CAST(dayofweek(TIMESTAMP '{_RUN_AT}') AS INTEGER))
  ELSE date_trunc('day', TIMESTAMP '{_RUN_AT}') END AS tick FROM monitors)
SELECT * FROM t WHERE status = 'active' AND (last_checked_at IS NULL OR last_checked_at < tick)""")
def q_due(spark, sf):
    return M.due_monitors(FX.monitors(spark, sf), _RUN_AT)


@register("m5_content_hash", _W("monitor_cur") + """
SELECT monitor_id, url, sha256(markdown) AS content_hash FROM monitor_cur""")
def q_hash(spark, sf):
    return FX.monitor_cur(spark, sf).select("monitor_id", "url", M.content_hash("markdown").alias("content_hash"))


_CHANGED_SQL = _W("monitor_prev", "monitor_cur") + """,
changed AS (SELECT c.monitor_id, c.url, sha256(p.markdown) AS prev_hash, sha256(c.markdown) AS hash,
    p.markdown AS old_markdown, c.markdown AS new_markdown
  FROM monitor_cur c JOIN monitor_prev p ON p.monitor_id = c.monitor_id AND p.url = c.url
  WHERE c.http_status = 200 AND sha256(p.markdown) <> sha256(c.markdown))"""


@register("m7_changed_pages", _CHANGED_SQL + " SELECT monitor_id, url, prev_hash, hash FROM changed")
def q_changed(spark, sf):
    return M.changed_pages(FX.monitor_cur(spark, sf), _state(spark, sf)).select("monitor_id", "url", "prev_hash", "hash")


# The runs' changes append a line to a text: its last line, if it has no
# newline yet, is removed and added again with one, before the new line.
_DIFF_SQL = _CHANGED_SQL + """,
diffs AS (SELECT monitor_id, url,
    CASE WHEN last <> '' THEN '-' || last ELSE '' END || '+' || last || substr(new_markdown, length(old_markdown) + 1) AS diff
  FROM (SELECT *, regexp_extract(old_markdown, '([^\\n]*)$', 1) AS last FROM changed))"""
_DUE_DIFF_SQL = _DIFF_SQL.replace("WITH ", _W("monitors") + f""",
due AS (SELECT * FROM monitors WHERE status = 'active' AND (last_checked_at IS NULL OR last_checked_at <
  CASE WHEN frequency = 'hourly' THEN date_trunc('hour', TIMESTAMP '{_RUN_AT}')
       WHEN frequency = 'weekly' THEN date_trunc('day', TIMESTAMP '{_RUN_AT}') - to_days(CAST(dayofweek(TIMESTAMP '{_RUN_AT}') AS INTEGER))
       ELSE date_trunc('day', TIMESTAMP '{_RUN_AT}') END)),
""", 1)
_JUDGE_SQL = _DUE_DIFF_SQL + f""",
prompts AS (SELECT monitor_id, url, prompt, sha256(prompt) AS prompt_hash FROM (
  SELECT d.monitor_id, d.url, {O.q(L.JUDGE_HEAD)} || m.goal || {O.q(L.JUDGE_MID)} || d.diff || {O.q(L.JUDGE_TAIL)} AS prompt
  FROM diffs d JOIN due m ON m.id = d.monitor_id WHERE m.goal <> ''))"""


@register("m8_line_diff", _DIFF_SQL + " SELECT * FROM diffs")
def q_line_diff(spark, sf):
    """M8: Myers line diff of every changed page."""
    ch = M.changed_pages(FX.monitor_cur(spark, sf), _state(spark, sf))
    return M.line_diff(ch).select("monitor_id", "url", "diff")


@register("m9_line_change_counts", _CHANGED_SQL + """,
o AS (SELECT monitor_id, url, line, count(*) AS n_old FROM (
        SELECT monitor_id, url, unnest(list_filter(regexp_extract_all(old_markdown, '([^\\n]*\\n|[^\\n]+$)', 1), lambda x_: x_ <> '')) AS line
        FROM changed) GROUP BY ALL),
n AS (SELECT monitor_id, url, line, count(*) AS n_new FROM (
        SELECT monitor_id, url, unnest(list_filter(regexp_extract_all(new_markdown, '([^\\n]*\\n|[^\\n]+$)', 1), lambda x_: x_ <> '')) AS line
        FROM changed) GROUP BY ALL)
SELECT coalesce(o.monitor_id, n.monitor_id) AS monitor_id, coalesce(o.url, n.url) AS url, coalesce(o.line, n.line) AS line,
  CAST(coalesce(n.n_new, 0) - coalesce(o.n_old, 0) AS BIGINT) AS net
FROM o FULL OUTER JOIN n ON o.monitor_id = n.monitor_id AND o.url = n.url AND o.line = n.line
WHERE coalesce(n.n_new, 0) <> coalesce(o.n_old, 0)""")
def q_line_counts(spark, sf):
    ch = M.changed_pages(FX.monitor_cur(spark, sf), _state(spark, sf))
    return M.line_change_counts(ch)


@register("m9_line_change_totals", _CHANGED_SQL + """,
o AS (SELECT monitor_id, url, line, count(*) AS n_old FROM (
        SELECT monitor_id, url, unnest(list_filter(regexp_extract_all(old_markdown, '([^\\n]*\\n|[^\\n]+$)', 1), lambda x_: x_ <> '')) AS line
        FROM changed) GROUP BY ALL),
n AS (SELECT monitor_id, url, line, count(*) AS n_new FROM (
        SELECT monitor_id, url, unnest(list_filter(regexp_extract_all(new_markdown, '([^\\n]*\\n|[^\\n]+$)', 1), lambda x_: x_ <> '')) AS line
        FROM changed) GROUP BY ALL),
net AS (SELECT coalesce(o.monitor_id, n.monitor_id) AS monitor_id, coalesce(o.url, n.url) AS url,
          coalesce(n.n_new, 0) - coalesce(o.n_old, 0) AS d
        FROM o FULL OUTER JOIN n ON o.monitor_id = n.monitor_id AND o.url = n.url AND o.line = n.line
        WHERE coalesce(n.n_new, 0) <> coalesce(o.n_old, 0))
SELECT monitor_id, url, CAST(sum(CASE WHEN d > 0 THEN d ELSE 0 END) AS BIGINT) AS lines_added,
  CAST(sum(CASE WHEN d < 0 THEN -d ELSE 0 END) AS BIGINT) AS lines_removed FROM net GROUP BY monitor_id, url""")
def q_line_totals(spark, sf):
    """M9 (page level): lines added / removed per changed page."""
    ch = M.changed_pages(FX.monitor_cur(spark, sf), _state(spark, sf))
    return M.line_change_totals(M.line_change_counts(ch))


_M10_SQL = _W("monitor_prev", "monitor_cur") + """,
upd AS (SELECT monitor_id, url, sha256(markdown) AS last_content_hash, markdown AS last_markdown, etag AS last_etag,
          last_modified, checked_at AS last_checked_at FROM monitor_cur WHERE http_status = 200),
st AS (SELECT monitor_id, url, sha256(markdown) AS last_content_hash, markdown AS last_markdown, etag AS last_etag,
          last_modified, checked_at AS last_checked_at FROM monitor_prev)
SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM upd WHERE upd.monitor_id = st.monitor_id AND upd.url = st.url)
UNION ALL SELECT * FROM upd"""


@register("m10_upsert_monitor_pages", _M10_SQL)
def q_upsert(spark, sf):
    return M.upsert_monitor_pages(_state(spark, sf), FX.monitor_cur(spark, sf))


@register("m10_bucketed_state", _M10_SQL)
def q_upsert_buckets(spark, sf):
    """M10 on the stored state: only buckets with fetched pages are read and written anew."""
    store = MonitorState(spark, fresh_dir(spark, "monitor-state"), buckets=64)
    return store.replace(_state(spark, sf), list(range(64))).upsert(FX.monitor_cur(spark, sf)).read()


@register("m11_check_summary", _CHANGED_SQL + f""",
mon AS (SELECT DISTINCT 'mon_' || source AS monitor_id FROM documents),
chk AS (SELECT monitor_id, count(*) AS n FROM monitor_cur WHERE http_status IN (200, 304) GROUP BY 1),
chg AS (SELECT monitor_id, count(*) AS n FROM changed GROUP BY 1)
SELECT substr(sha256(mon.monitor_id || '@{_RUN_AT}'), 1, 16) AS check_id, mon.monitor_id,
  substr(sha256(mon.monitor_id || '@{_RUN_AT}#job'), 1, 16) AS job_id,
  CAST(coalesce(chk.n, 0) AS INTEGER) AS pages_checked, CAST(coalesce(chg.n, 0) AS INTEGER) AS pages_changed,
  TIMESTAMP '{_RUN_AT}' AS checked_at
FROM mon LEFT JOIN chk USING (monitor_id) LEFT JOIN chg USING (monitor_id)""")
def q_check_summary(spark, sf):
    mons = FX.monitors(spark, sf)
    cur = FX.monitor_cur(spark, sf)
    ch = M.changed_pages(cur, _state(spark, sf))
    return M.check_summary(mons, cur, ch, _RUN_AT)


def _run(spark, sf):
    mons, state, cur = FX.monitors(spark, sf), _state(spark, sf), FX.monitor_cur(spark, sf)
    # stand-in judge replies for this run's prompts (captured model output)
    ch = M.line_diff(M.changed_pages(cur.join(M.due_monitors(mons, _RUN_AT).select(
        F.col("id").alias("monitor_id")), "monitor_id", "left_semi"), state))
    replies = FX.judge_completions(M.judge_prompts(ch, mons))
    return MR.monitor_run(mons, state, cur, _RUN_AT, replies)


@register("m12_change_records", _DUE_DIFF_SQL + f"""
SELECT substr(sha256(d.monitor_id || '@{_RUN_AT}'), 1, 16) AS check_id, d.monitor_id, d.url, d.diff,
  TIMESTAMP '{_RUN_AT}' AS changed_at FROM diffs d JOIN due m ON m.id = d.monitor_id""")
def q_change_rows(spark, sf):
    return _run(spark, sf).change_rows


@register("m13_judge_prompts", _JUDGE_SQL + """
SELECT monitor_id, url, prompt_hash, CAST(length(prompt) AS INTEGER) AS prompt_chars FROM prompts""")
def q_judge_prompts(spark, sf):
    r = _run(spark, sf)
    return M.judge_prompts(r.changes, r.due).select("monitor_id", "url", "prompt_hash", F.length("prompt").alias("prompt_chars"))


# Replies by the prompt hash, as laid out in fixtures.judge_completions.
@register("m14_apply_verdicts", _JUDGE_SQL + """,
r AS (SELECT *, CAST('0x' || substr(prompt_hash, 1, 2) AS INTEGER) % 5 AS k FROM prompts)
SELECT monitor_id, url, CASE WHEN k <> 3 THEN true END AS relevant,
  CASE k WHEN 0 THEN 'matches the goal' WHEN 1 THEN 'cosmetic edit' WHEN 4 THEN 'new section' END AS reason,
  k IN (0, 3, 4) AS keep, k = 2 AS dropped_unparsed FROM r
UNION ALL
SELECT d.monitor_id, d.url, NULL, NULL, true, false FROM diffs d JOIN due m ON m.id = d.monitor_id
WHERE coalesce(m.goal, '') = ''""")
def q_verdicts(spark, sf):
    return _run(spark, sf).verdicts.select("monitor_id", "url", "relevant", "reason", "keep", "dropped_unparsed")


@register("m15_touch_monitors", _W("monitors") + f""",
t AS (SELECT *, CASE WHEN frequency = 'hourly' THEN date_trunc('hour', TIMESTAMP '{_RUN_AT}')
  WHEN frequency = 'weekly' THEN date_trunc('day', TIMESTAMP '{_RUN_AT}') - to_days(CAST(dayofweek(TIMESTAMP '{_RUN_AT}') AS INTEGER))
  ELSE date_trunc('day', TIMESTAMP '{_RUN_AT}') END AS tick FROM monitors),
d AS (SELECT *, status = 'active' AND (last_checked_at IS NULL OR last_checked_at < tick) AS due FROM t)
SELECT id, status,
  CASE WHEN due THEN TIMESTAMP '{_RUN_AT}' ELSE last_checked_at END AS last_checked_at,
  CASE WHEN due THEN substr(sha256(id || '@{_RUN_AT}#job'), 1, 16) ELSE last_job_id END AS last_job_id
FROM d""")
def q_touch(spark, sf):
    return _run(spark, sf).monitors.select("id", "status", "last_checked_at", "last_job_id")


_K4_SQL = _JUDGE_SQL + f""",
r AS (SELECT *, CAST('0x' || substr(prompt_hash, 1, 2) AS INTEGER) % 5 AS k FROM prompts),
kept AS (SELECT r.monitor_id, r.url, d.diff, m.goal, CASE k WHEN 0 THEN 'matches the goal' WHEN 4 THEN 'new section' END AS reason
         FROM r JOIN diffs d USING (monitor_id, url) JOIN due m ON m.id = r.monitor_id WHERE k IN (0, 3, 4)
         UNION ALL SELECT d.monitor_id, d.url, d.diff, NULL, NULL FROM diffs d JOIN due m ON m.id = d.monitor_id
         WHERE coalesce(m.goal, '') = ''),
chk AS (SELECT monitor_id, count(*) AS n FROM monitor_cur WHERE http_status IN (200, 304) GROUP BY 1),
pay AS (SELECT monitor_id, max(goal) AS goal, count(*) AS n, string_agg('{{"url":' || to_json(url) || ',"diff":' || to_json(diff)
          || CASE WHEN goal IS NULL THEN '' ELSE ',"relevant":true' || coalesce(',"reason":' || to_json(reason), '') END || '}}',
          ',' ORDER BY url) AS changes FROM kept GROUP BY monitor_id),
k4 AS (SELECT p.monitor_id, m.webhook_url, CAST(p.n AS BIGINT) AS pages_changed,
         '{{"monitor-id":' || to_json(p.monitor_id) || ',"checked-at":"{_RUN_AT.replace(' ', 'T')}.000Z","pages-checked":' || coalesce(c.n, 0)
         || ',"pages-changed":' || p.n || coalesce(',"goal":' || to_json(p.goal), '') || ',"changes":[' || p.changes || ']}}' AS payload
       FROM pay p JOIN due m ON m.id = p.monitor_id LEFT JOIN chk c USING (monitor_id))"""


@register("m16_k4_monitor_outbox", _K4_SQL + " SELECT * FROM k4")
def q_monitor_outbox(spark, sf):
    """M16 composite + K4 payloads (one per monitor with kept changes)."""
    return _run(spark, sf).outbox


def _m16_jobs_sql(failed: str) -> str:
    return _DUE_DIFF_SQL + f""",
chk AS (SELECT monitor_id, count(*) AS n FROM monitor_cur WHERE http_status IN (200, 304) GROUP BY 1),
b AS (SELECT *, {failed} AS broke FROM due)
SELECT substr(sha256(b.id || '@{_RUN_AT}#job'), 1, 16) AS id, CASE WHEN broke THEN 'failed' ELSE 'completed' END AS status, b.url,
  max_depth, max_pages, include_patterns, exclude_patterns,
  CAST(CASE WHEN broke THEN 0 ELSE coalesce(chk.n, 0) END AS INTEGER) AS pages_scraped,
  TIMESTAMP '{_RUN_AT}' AS started_at, TIMESTAMP '{_RUN_AT}' AS completed_at, b.id AS monitor_id,
  CASE WHEN broke THEN 'crawl of ' || b.id || ' broke off' END AS error FROM b LEFT JOIN chk ON chk.monitor_id = b.id"""


@register("m16_monitor_run_jobs", _m16_jobs_sql("false"))
def q_monitor_jobs(spark, sf):
    """The synthetic job row of every due monitor's run."""
    return _run(spark, sf).jobs


_BROKE = "CAST(regexp_extract(id, '(\\d+)$', 1) AS INTEGER) % 4 = 1"


def _failed_run(spark, sf):
    """A run in which the crawls of a quarter of the monitors break off."""
    broke = F.regexp_extract("id", r"(\d+)$", 1).cast("int") % 4 == 1
    mons = FX.monitors(spark, sf)
    failures = mons.where(broke).select(F.col("id").alias("monitor_id"),
                                        F.concat(F.lit("crawl of "), "id", F.lit(" broke off")).alias("error"))
    return MR.monitor_run(mons, _state(spark, sf), FX.monitor_cur(spark, sf), _RUN_AT, failures=failures)


@register("m16_failed_run_jobs", _m16_jobs_sql(_BROKE))
def q_failed_jobs(spark, sf):
    """Runs that break off end failed with zero counts, the others complete."""
    return _failed_run(spark, sf).jobs


@register("m16_failed_run_checks", _DUE_DIFF_SQL + f""",
chk AS (SELECT monitor_id, count(*) AS n FROM monitor_cur WHERE http_status IN (200, 304) GROUP BY 1),
chg AS (SELECT monitor_id, count(*) AS n FROM diffs GROUP BY 1),
b AS (SELECT *, {_BROKE} AS broke FROM due)
SELECT substr(sha256(b.id || '@{_RUN_AT}'), 1, 16) AS check_id, b.id AS monitor_id, substr(sha256(b.id || '@{_RUN_AT}#job'), 1, 16) AS job_id,
  CAST(CASE WHEN broke THEN 0 ELSE coalesce(chk.n, 0) END AS INTEGER) AS pages_checked,
  CAST(CASE WHEN broke THEN 0 ELSE coalesce(chg.n, 0) END AS INTEGER) AS pages_changed, TIMESTAMP '{_RUN_AT}' AS checked_at
FROM b LEFT JOIN chk ON chk.monitor_id = b.id LEFT JOIN chg ON chg.monitor_id = b.id""")
def q_failed_checks(spark, sf):
    """A run that breaks off still writes its check, with zeros."""
    return _failed_run(spark, sf).checks


# ------------------------------------------------------------------ LLM batch: E1-E7


EXTRACT_SCHEMA = {"title": "string", "n": "number", "ok": "boolean", "tags": "array of strings"}


def _doc_prompts(spark, sf):
    d = driver_table(spark, sf, "documents")
    content, truncated = L.truncate_for_prompt("text")
    p = d.select(F.col("doc_id").alias("page_id"), content.alias("content"), truncated.alias("truncated"))
    p = p.withColumn("prompt", L.extraction_prompt(F.col("content"), F.col("truncated"), EXTRACT_SCHEMA))
    return p.withColumn("prompt_hash", L.prompt_hash(F.col("prompt"))).drop("content")


def _prompt_sql():
    head = O.q(L.EXTRACTION_HEAD + L.schema_json(EXTRACT_SCHEMA) + L.EXTRACTION_RULES)
    note = O.q(L.TRUNCATION_NOTE)
    n = L.MAX_MARKDOWN_CHARS
    return f"""p AS (SELECT doc_id AS page_id, {O.utf16_length('text')} > {n} AS truncated,
    sha256({head} || CASE WHEN {O.utf16_length('text')} > {n} THEN substr(text, 1, {n}) ELSE text END
      || CASE WHEN {O.utf16_length('text')} > {n} THEN {note} ELSE '' END) AS prompt_hash
  FROM documents)"""


def _completion_sql():
    n = "CAST('0x' || substr(prompt_hash, 1, 6) AS BIGINT)"
    good = ("'{\"title\": \"T' || substr(prompt_hash, 1, 8) || '\", \"n\": ' || CAST(" + n + " AS VARCHAR) || "
            "', \"ok\": true, \"tags\": [\"a\", \"b\"]}'")
    return f"""h AS (SELECT DISTINCT prompt_hash FROM p),
c AS (
  SELECT prompt_hash, 1 AS attempt, CASE WHEN {n} % 4 = 0 THEN '```json' || chr(10) || {good} || chr(10) || '```'
    WHEN {n} % 4 = 1 THEN {good} WHEN {n} % 4 = 2 THEN 'Sorry, I cannot help with that.' ELSE '' END AS text FROM h
  UNION ALL SELECT prompt_hash, 2, CASE WHEN {n} % 8 = 2 THEN 'still not json' ELSE {good} END FROM h),
cl AS (SELECT p.page_id, c.*, trim(regexp_replace(regexp_replace(text, '(?i)^```(?:json)?\\s*', ''), '\\s*```\\s*$', ''),
         ' ' || chr(9) || chr(10) || chr(13)) AS cleaned FROM c JOIN p USING (prompt_hash))"""


@register("e1_truncate_for_prompt", f"""
SELECT doc_id, CAST({O.utf16_length('text')} AS INTEGER) AS units, {O.utf16_length('text')} > {L.MAX_MARKDOWN_CHARS} AS truncated,
  CAST(length(CASE WHEN {O.utf16_length('text')} > {L.MAX_MARKDOWN_CHARS} THEN substr(text, 1, {L.MAX_MARKDOWN_CHARS}) ELSE text END) AS INTEGER) AS content_chars
FROM documents""")
def q_truncate(spark, sf):
    d = driver_table(spark, sf, "documents")
    content, truncated = L.truncate_for_prompt("text")
    from ..functions.text import utf16_length
    return d.select("doc_id", utf16_length("text").alias("units"), truncated.alias("truncated"),
                    F.length(content).cast("int").alias("content_chars"))


@register("e2_extraction_prompt", "WITH " + _prompt_sql() + " SELECT page_id, truncated, prompt_hash FROM p")
def q_prompt(spark, sf):
    return _doc_prompts(spark, sf).select("page_id", "truncated", "prompt_hash")


@register("e3_parse_llm_json", "WITH " + _prompt_sql() + ", " + _completion_sql() + """
SELECT page_id, attempt, coalesce(json_valid(cleaned), false) AS parsed FROM cl""")
def q_parse(spark, sf):
    p = _doc_prompts(spark, sf)
    c = FX.completions(spark, sf, p).join(p.select("prompt_hash", "page_id"), "prompt_hash")
    return c.select("page_id", "attempt", L.parse_llm_json(F.col("text")).isNotNull().alias("parsed"))


@register("e4_retry_failed", "WITH " + _prompt_sql() + ", " + _completion_sql() + """,
a AS (SELECT page_id, bool_or(attempt = 1 AND coalesce(json_valid(cleaned), false)) AS ok1,
             bool_or(attempt = 2 AND coalesce(json_valid(cleaned), false)) AS ok2 FROM cl GROUP BY page_id)
SELECT page_id, CASE WHEN ok1 THEN 1 ELSE 2 END AS attempts,
  CASE WHEN ok1 OR ok2 THEN NULL ELSE 'extraction-failed' END AS error FROM a""")
def q_retry(spark, sf):
    p = _doc_prompts(spark, sf)
    r = L.retry_failed(p, FX.completions(spark, sf, p))
    return r.select("page_id", "attempts", "error")


@register("e7_complete", "WITH " + _prompt_sql() + ", " + _completion_sql() + """
SELECT page_id, text AS reply FROM cl WHERE attempt = 1""")
def q_complete(spark, sf):
    p = _doc_prompts(spark, sf)
    return L.complete(p, FX.completions(spark, sf, p), 1).select("page_id", "reply")


@register("e5_e6_extract_results")
def q_extract(spark, sf):
    """E1-E7 over scraped pages: typed fields from captured replies."""
    scraped = X.scrape_pages(FX.responses(spark, sf), keep=("page_id",)) \
               .where((F.col("status") == "scraped") & ~F.col("unchanged"))
    # the markdown pass is used twice below (reply stand-ins and extraction):
    # write it once to the shared checkpoint folder instead of recomputing
    staged = fresh_dir(spark, "e6-pages")
    scraped.write.parquet(staged)
    pages = spark.read.parquet(staged)
    content, truncated = L.truncate_for_prompt("markdown")
    pr = pages.select("page_id", content.alias("c"), truncated.alias("t"))
    pr = pr.withColumn("prompt_hash", L.prompt_hash(L.extraction_prompt(F.col("c"), F.col("t"), EXTRACT_SCHEMA)))
    comps = FX.completions(spark, sf, pr.select("page_id", "prompt_hash"))
    res = L.extract_results(pages, comps, EXTRACT_SCHEMA, extracted_at="2024-01-30 12:00:00")
    return res.select("page_id", "url", "attempts", "error", F.col("typed.title").alias("title"),
                      F.col("typed.n").alias("n"), F.col("typed.ok").alias("ok"), F.col("typed.tags").alias("tags"))


_C8_SQL = _W("job_pages").replace("WITH ", "WITH RECURSIVE ", 1) + """,
pops AS (SELECT job_id, ord, scraped_at + to_seconds(ord * 11) AS fetched_at, status = 'blocked' AS blocked
         FROM job_pages),
fold AS (
  SELECT job_id, ord, fetched_at, blocked, false AS skipped,
    CASE WHEN blocked THEN fetched_at + INTERVAL 30 SECOND END AS backoff_until
  FROM pops WHERE ord = 1
  UNION ALL
  SELECT p.job_id, p.ord, p.fetched_at, p.blocked, s.skip,
    CASE WHEN NOT s.skip AND p.blocked THEN coalesce(f.backoff_until, p.fetched_at) + INTERVAL 30 SECOND
         ELSE f.backoff_until END
  FROM fold f JOIN pops p ON p.job_id = f.job_id AND p.ord = f.ord + 1,
       LATERAL (SELECT coalesce(f.backoff_until IS NOT NULL AND p.fetched_at < f.backoff_until, false) AS skip) s)
SELECT job_id, ord, fetched_at, blocked, skipped, backoff_until FROM fold"""


@register("e5_e6_document_results", "WITH " + _prompt_sql() + f"""
SELECT page_id, truncated, prompt_hash, CASE WHEN n % 4 < 2 THEN 1 ELSE 2 END AS attempts,
  CASE WHEN n % 8 <> 2 THEN 'T' || substr(prompt_hash, 1, 8) END AS title, CASE WHEN n % 8 <> 2 THEN CAST(n AS DOUBLE) END AS n,
  CASE WHEN n % 8 <> 2 THEN true END AS ok, CASE WHEN n % 8 <> 2 THEN ['a', 'b'] END AS tags,
  CASE WHEN n % 8 = 2 THEN 'extraction-failed' END AS error, {O.q(L.DEFAULT_PROVIDER)} AS provider, {O.q(L.DEFAULT_MODEL)} AS model,
  TIMESTAMP '{_AS_OF}' AS extracted_at
FROM (SELECT *, CAST('0x' || substr(prompt_hash, 1, 6) AS BIGINT) AS n FROM p)""")
def q_document_results(spark, sf):
    """E4 + E5 + E6 over documents as pages: one retry, typed fields, failures."""
    pages = driver_table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("markdown"))
    got = L.extract_results(pages, FX.completions(spark, sf, _doc_prompts(spark, sf)), EXTRACT_SCHEMA, extracted_at=_AS_OF)
    return got.select("page_id", "truncated", "prompt_hash", "attempts", "typed.*", "error", "provider", "model", "extracted_at")


# ------------------------------------------------------------------ streaming: T1-T6



def _stage(df: DataFrame, tag: str) -> tuple[str, object]:
    """Write a derived input to a fresh folder, dealt out by a hash of its
    first column into as many files as its size asks for; return (path, schema)."""
    path = fresh_dir(df.sparkSession, tag)
    df.repartition(F.xxhash64(df.columns[0])).write.parquet(path)
    return path, df.schema


def _drain(df: DataFrame, tag: str, arrow_rows: int | None = None, partitions: int = 0, **more) -> DataFrame:
    out = fresh_dir(df.sparkSession, tag + "-out")
    S.run_available(df, out, out + "-ckpt", partitions=max(partitions, df.sparkSession.sparkContext.defaultParallelism), arrow_rows=arrow_rows, **more)
    return df.sparkSession.read.parquet(out)


def _stage_slices(df: DataFrame, tcol: str, tag: str, slices: int = 4) -> tuple[str, int]:
    """Write ``df`` as ``slices`` event-time slices in sequence, each as one
    file a core of the cluster, so a file stream reading that many files per
    trigger sees the data in event-time order, one slice per micro-batch.
    Returns (path, files a slice)."""
    spark = df.sparkSession
    path, files = fresh_dir(spark, tag), spark.sparkContext.defaultParallelism
    whole = path + "-whole"         # derived once, read once a slice
    df.write.parquet(whole)
    df = spark.read.schema(df.schema).parquet(whole)
    b = df.agg(F.min(tcol).alias("lo"), F.max(tcol).alias("hi")).collect()[0]
    step = (b.hi - b.lo) // slices   # whole microseconds, like the oracle
    for i in range(slices):
        lo = b.lo + step * i
        part = df.where(F.col(tcol) >= F.lit(lo).cast("timestamp_ntz"))
        if i < slices - 1:
            part = part.where(F.col(tcol) < F.lit(lo + step).cast("timestamp_ntz"))
        part.repartition(files).write.mode("append").parquet(path)
    return path, files


@register("t1_stream_scrape")
def q_t1(spark, sf):
    """X7 over a file stream of captures, two files per micro-batch."""
    path, schema = _stage(FX.responses(spark, sf), "t1-in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)
    return _drain(S.stream_scrape(src), "t1")


T2_BATCHES = 4
T2_PARTITION_BYTES = 64 << 20      # of compressed staged rows a state partition: its texts are sorted in memory


@register("t2_stream_changes", _CHANGED_SQL + """
SELECT c.monitor_id, c.url, c.prev_hash, c.hash, m.etag, m.last_modified FROM changed c JOIN monitor_cur m USING (monitor_id, url)""")
def q_t2(spark, sf):
    """State from the M10 table of the previous snapshot, then the
    previous snapshot again (a replay, ignored) and the current one: M7.
    A snapshot is staged as it comes, in about ``T2_BATCHES`` micro-batches,
    whose files go with them, and the current one once the previous is drained."""
    prev = FX.monitor_prev(spark, sf).withColumn("http_status", F.lit(200))
    cols = ["monitor_id", "url", "http_status", "markdown", "etag", "last_modified", "checked_at"]
    path = fresh_dir(spark, "t2-in")

    def arrive(snapshot: DataFrame) -> None:
        snapshot.select(*cols).write.mode("append").option("compression", "zstd").parquet(path)
    arrive(prev)
    sizes = folders.sizes(spark, path)
    src = spark.readStream.schema(prev.select(*cols).schema).option("maxFilesPerTrigger", max(4, -(-len(sizes) // T2_BATCHES))) \
        .option("cleanSource", "delete").parquet(path)
    got = _drain(S.stream_changes(src, _state(spark, sf)), "t2", partitions=sum(sizes) // T2_PARTITION_BYTES, lean=True,
                 arrivals=[lambda: arrive(FX.monitor_cur(spark, sf))])
    folders.delete(spark, path)
    return got.select("monitor_id", "url", "prev_hash", "hash", "etag", "last_modified")


@register("t3_stream_backoff", _C8_SQL.replace("SELECT job_id, ord, fetched_at, blocked, skipped, backoff_until FROM fold", "SELECT job_id, ord, skipped, backoff_until FROM fold"))
def q_t3(spark, sf):
    """C8 backoff as keyed state over page pops of the job fixture."""
    p = FX.job_pages(spark, sf).select(
        "job_id", "ord", (F.col("scraped_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("ord") * 11).cast("int"))).alias("fetched_at"),
        (F.col("status") == "blocked").alias("blocked"))
    # pops of a job are spread over the micro-batches in any order
    path, files = fresh_dir(spark, "t3-in"), spark.sparkContext.defaultParallelism
    p.repartition(4 * files, F.xxhash64("job_id", "ord")).write.parquet(path)
    schema = p.schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return _drain(S.stream_backoff(src, wait_minutes=None), "t3", S.SMALL_ROWS)


def _t4_sql():
    return _W("scrape_requests") + """,
wins AS (SELECT date_trunc('hour', created_at) - to_hours(k) AS window_start, status, duration_ms
         FROM scrape_requests, range(0, 24) t(k)),
mx AS (SELECT max(created_at) - INTERVAL 1 HOUR AS wm FROM scrape_requests),
agg AS (SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, count(*) AS total,
          count(*) FILTER (WHERE status = 'ok') AS ok, avg(duration_ms) FILTER (WHERE status = 'ok') AS av
        FROM wins GROUP BY window_start)
SELECT window_start, window_end, CAST(total AS BIGINT) AS total, CAST(ok AS BIGINT) AS ok,
  CAST(floor(av + 0.5) AS BIGINT) AS avg_ms,
  CAST(CASE WHEN total > 0 THEN floor(ok * 100.0 / total + 0.5) ELSE 100 END AS BIGINT) AS success_rate
FROM agg, mx WHERE window_end <= wm"""


@register("t4_stream_scrape_stats", _t4_sql())
def q_t4(spark, sf):
    """T4: sliding 24 h scrape statistics with a 1 h watermark. The log
    arrives in four time slices written in sequence (one trigger per slice); in append mode a window is emitted once
    the watermark (latest event - 1 h) passes its end."""
    log = FX.scrape_requests(spark, sf)
    path, files = _stage_slices(log, "created_at", "t4-in")
    # each trigger takes one slice's files (older slices were written first)
    src = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(path)
    return _drain(S.stream_scrape_stats(src), "t4")


_T5_SQL = _W("jobs", "job_pages") + """,
hb AS (SELECT job_id, scraped_at AS ts, epoch_us(scraped_at) AS us FROM job_pages),
b AS (SELECT min(us) AS lo, (max(us) - min(us)) // 4 AS step FROM hb),
sl AS (SELECT job_id, ts, CASE WHEN us < lo + step THEN 1 WHEN us < lo + 2 * step THEN 2
                               WHEN us < lo + 3 * step THEN 3 ELSE 4 END AS s FROM hb, b),
pj AS (SELECT job_id, max(ts) FILTER (WHERE s = 1) AS m1, max(ts) FILTER (WHERE s = 2) AS m2,
         max(ts) FILTER (WHERE s = 3) AS m3, max(ts) FILTER (WHERE s = 4) AS m4 FROM sl GROUP BY job_id),
w AS (SELECT max(ts) FILTER (WHERE s <= 1) AS w1, max(ts) FILTER (WHERE s <= 2) AS w2,
        max(ts) FILTER (WHERE s <= 3) AS w3, max(ts) AS w4 FROM sl),
s2 AS (SELECT pj.*, w.*, m1 AS st1,
         CASE WHEN m2 IS NULL AND m1 IS NOT NULL AND m1 + INTERVAL 2 MINUTE < w1 THEN m1 END AS e2 FROM pj, w),
s2b AS (SELECT *, CASE WHEN m2 IS NOT NULL THEN m2 WHEN e2 IS NOT NULL THEN NULL ELSE st1 END AS st2 FROM s2),
s3 AS (SELECT *, CASE WHEN m3 IS NULL AND st2 IS NOT NULL AND st2 + INTERVAL 2 MINUTE < w2 THEN st2 END AS e3 FROM s2b),
s3b AS (SELECT *, CASE WHEN m3 IS NOT NULL THEN m3 WHEN e3 IS NOT NULL THEN NULL ELSE st2 END AS st3 FROM s3),
s4 AS (SELECT *, CASE WHEN m4 IS NULL AND st3 IS NOT NULL AND st3 + INTERVAL 2 MINUTE < w3 THEN st3 END AS e4 FROM s3b),
s4b AS (SELECT *, CASE WHEN m4 IS NOT NULL THEN m4 WHEN e4 IS NOT NULL THEN NULL ELSE st3 END AS st4 FROM s4),
s5 AS (SELECT *, CASE WHEN st4 IS NOT NULL AND st4 + INTERVAL 2 MINUTE < w4 THEN st4 END AS e5 FROM s4b)
SELECT job_id, e AS last_heartbeat_at FROM s5, LATERAL (SELECT unnest([e2, e3, e4, e5]) AS e) WHERE e IS NOT NULL
  AND job_id IN (SELECT id FROM jobs WHERE status = 'running')"""


@register("t5_stream_stale_jobs", _T5_SQL)
def q_t5(spark, sf):
    """T5: each job's page timestamps as its heartbeat stream, arriving in
    four event-time slices; a running job is reported stale once event time
    passes its last heartbeat + 2 minutes."""
    hb = FX.job_pages(spark, sf).select("job_id", F.col("scraped_at").alias("ts"), F.lit(None).cast("string").alias("status"))
    # every job reports its status with its first page
    began = hb.groupBy("job_id").agg(F.min("ts").alias("ts")) \
        .join(FX.jobs(spark, sf).select(F.col("id").alias("job_id"), "status"), "job_id").select("job_id", "ts", "status")
    events = hb.unionByName(began)
    path, files = _stage_slices(events, "ts", "t5-in")
    src = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)
    return _drain(S.stream_stale_jobs(src), "t5", S.SMALL_ROWS).select(
        "job_id", F.col("last_heartbeat_at").cast("timestamp_ntz").alias("last_heartbeat_at"))


_K3_ROWS = """
SELECT id AS job_id, webhook_url,
  '{"job-id":' || to_json(id) || ',"status":' || to_json(status) || ',"pages-scraped":' || CAST(pages_scraped AS VARCHAR)
  || ',"pages-failed":' || CAST(pages_failed AS VARCHAR) || ',"results-url":' || to_json('/jobs/' || id) || '}' AS payload
FROM jobs WHERE webhook_url IS NOT NULL AND status IN ('completed', 'failed')"""
_T6_SQL = _K4_SQL.replace("WITH ", _W("jobs") + ", ", 1) + f", k3 AS ({_K3_ROWS})" + """
SELECT 'crawl' AS kind, job_id AS id, webhook_url, payload FROM k3
UNION ALL SELECT 'monitor', monitor_id, webhook_url, payload FROM k4"""


@register("t6_stream_outbox", _W("jobs") + _K3_ROWS)
def q_t6(spark, sf):
    """K3 payloads written per micro-batch (idempotent by batch id)."""
    path, schema = _stage(FX.jobs(spark, sf), "t6-in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = fresh_dir(spark, "t6-out")
    S.stream_outbox(src, out, out + "-ckpt")
    return spark.read.parquet(out).select("job_id", "webhook_url", "payload")


@register("t6_stream_outboxes", _T6_SQL)
def q_t6_both(spark, sf):
    """K3 and K4 payloads of finished jobs and monitor runs, one commit a micro-batch."""
    run = _run(spark, sf)
    runs = M.monitor_runs(run.verdicts, run.checks, run.due, _RUN_AT)
    jobs = FX.jobs(spark, sf)
    events = jobs.select(F.struct(*jobs.columns).alias("job"), F.lit(None).cast(S.RUN).alias("run")) \
        .unionByName(runs.select(F.lit(None).cast(jobs.schema.simpleString()).alias("job"),
                                 F.struct("monitor_id", "check_id", "run_at", "webhook_url", "goal", "pages_checked", "changes").cast(S.RUN).alias("run")))
    path = fresh_dir(spark, "t6-both")
    events.repartition(F.xxhash64("job.id", "run.monitor_id")).write.parquet(path)
    src = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(path)
    out = fresh_dir(spark, "t6-both-out")
    S.stream_outboxes(src, out, out + "-ckpt")
    got = S.read_outboxes(spark, out)
    return got["crawl"].select(F.lit("crawl").alias("kind"), F.col("job_id").alias("id"), "webhook_url", "payload") \
        .unionByName(got["monitor"].select(F.lit("monitor").alias("kind"), F.col("monitor_id").alias("id"), "webhook_url", "payload"))


# ------------------------------------------------------------------ S1, S7, K1: typed scans and page sink



@register("s7_read_ops_table", _W("jobs") + """
SELECT id, status, url, pages_discovered, pages_scraped, pages_failed, created_at FROM jobs""")
def q_read_ops(spark, sf):
    """The jobs table written as parquet and read back with the declared schema."""
    path = fresh_dir(spark, "ops-jobs")
    FX.jobs(spark, sf).write.parquet(path)
    return TB.read_ops_table(spark, path, "jobs").select(
        "id", "status", "url", "pages_discovered", "pages_scraped", "pages_failed", "created_at")


@register("s1_read_responses", _W("responses") + " SELECT url, http_status, error, duration_ms FROM responses")
def q_read_responses(spark, sf):
    """Captured responses written and read back with the declared schema."""
    path = fresh_dir(spark, "responses")
    FX.responses(spark, sf).drop("page_id").write.parquet(path)
    return TB.read_responses(spark, path).select("url", "http_status", "error", "duration_ms")


@register("k1_write_job_pages", _W("job_pages") + """
SELECT CAST(scraped_at AS DATE) AS scraped_date, CAST(count(*) AS BIGINT) AS n_pages,
  CAST(count(DISTINCT job_id) AS BIGINT) AS n_jobs FROM job_pages GROUP BY 1""")
def q_write_pages(spark, sf):
    """K1: page rows appended to a table partitioned by scrape date, read
    back per partition."""
    path = fresh_dir(spark, "job_pages")
    SK.write_job_pages(FX.job_pages(spark, sf), path)
    back = spark.read.parquet(path)
    return back.groupBy("scraped_date").agg(F.count(F.lit(1)).cast("long").alias("n_pages"),
                                            F.count_distinct("job_id").cast("long").alias("n_jobs"))


# ------------------------------------------------------------------ standalone forms of crawl / extraction steps

@register("s6_robots_rules_sql", _W("link_graph", "crawl_robots", "robots_rules") + """
SELECT origin, CAST(ln AS INTEGER) AS ln, allow, pattern, regex FROM robots_rules""")
def q_robots_rules_sql(spark, sf):
    """Robots bodies -> the rule group for our agent, per origin."""
    return C.robots_rules(FX.crawl_robots(spark, sf)).select(
        "origin", F.col("ln").cast("int").alias("ln"), "allow", "pattern", "regex")


@register("u5_robots_allowed", _W("link_graph", "crawl_robots", "robots_rules") + f""",
cand AS (SELECT DISTINCT 'https://' || host || path AS url, 'https://' || host AS origin, path AS pq FROM link_graph),
m AS (SELECT c.url, r.allow, length(r.pattern) AS plen FROM cand c JOIN robots_rules r ON r.origin = c.origin
      WHERE regexp_matches(c.pq, r.regex)),
v AS (SELECT url, arg_max(allow, plen * 2 + CAST(allow AS INTEGER)) AS allow FROM m GROUP BY url)
SELECT c.url, coalesce(v.allow, true) AS allowed FROM cand c LEFT JOIN v USING (url)""")
def q_robots_allowed(spark, sf):
    """Robots verdict for every link-graph page URL (longest matching
    rule wins, allow wins ties, no robots file = allow)."""
    cand = FX.link_graph_pages(spark, sf).select(
        F.concat(F.lit("https://"), "host", "path").alias("url")).distinct()
    rules = C.robots_rules(FX.crawl_robots(spark, sf))
    allowed = C.robots_filter(cand, rules).withColumn("allowed", F.lit(True))
    return cand.join(allowed, "url", "left").select("url", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def _crawl_cfg(spark, sf):
    jobs = FX.crawl_jobs(spark, sf)
    jobs = U.evaluate_once(jobs, _sp=U.parse_url_parts("url"))
    return jobs.select("*", F.col("_sp.host").alias("seed_host"),
                       U.url_origin_of(F.col("_sp")).alias("seed_origin")).drop("_sp")


@register("c3_seed_frontier", _s5_sql() + f""",
flag AS (SELECT DISTINCT job_id FROM seeds)
SELECT job_id, url, 0 AS depth, CAST(n AS BIGINT) AS ord, true AS uses_sitemap FROM seeds
UNION ALL
SELECT id AS job_id, {O.normalize_url('url', 'url')} AS url, 0, CAST(1 AS BIGINT), false
FROM crawl_jobs WHERE id NOT IN (SELECT job_id FROM flag)""")
def q_seed(spark, sf):
    """Sitemap seeds at depth 0 in order, else the normalised root."""
    frontier, cfg = PC.seed_frontier(_crawl_cfg(spark, sf), FX.crawl_sitemaps(spark, sf),
                                     C.robots_rules(FX.crawl_robots(spark, sf)))
    return frontier.join(cfg.select(F.col("id").alias("job_id"), "uses_sitemap"), "job_id")


def _first_round_sql():
    doc = O.strip_nodes("html")
    return _W("link_graph", "crawl_jobs", "crawl_responses") + f""",
roots AS (SELECT id AS job_id, {O.normalize_url('url', 'url')} AS url, url AS seed, max_pages, max_depth,
            include_patterns, exclude_patterns FROM crawl_jobs),
fetched AS (SELECT r.*, c.http_status, c.error, {O.page_links(doc)} AS links
            FROM roots r LEFT JOIN crawl_responses c ON c.url = r.url WHERE r.url IS NOT NULL),
live AS (SELECT * FROM fetched WHERE http_status = 200 AND error IS NULL AND max_depth > 0),
ex AS (SELECT job_id, seed, max_pages, include_patterns, exclude_patterns, url AS page_url,
         unnest(links) AS href, generate_subscripts(links, 1) - 1 AS pos FROM live),
n AS (SELECT *, {O.normalize_url('href', 'page_url')} AS cand FROM ex),
ok AS (SELECT * FROM n WHERE cand IS NOT NULL AND {O.url_host('cand')} = {O.url_host('seed')}
         AND regexp_extract(cand, '^(https?://[^/?#]+)', 1) = regexp_extract(seed, '^(https?://[^/?#]+)', 1)
         AND {O.allowed_by_patterns('cand', 'include_patterns', 'exclude_patterns')}),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, cand ORDER BY pos) AS d FROM ok) WHERE d = 1),
fresh AS (SELECT f.* FROM first f WHERE NOT EXISTS (SELECT 1 FROM roots r WHERE r.job_id = f.job_id AND r.url = f.cand)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY pos) AS k FROM fresh)
SELECT job_id, cand AS url, 1 AS depth, CAST(1 + k AS BIGINT) AS ord, 1 + k <= max_pages AS processable
FROM ranked WHERE k <= max_pages * 3 - 1"""


@register("c4_c5_c6_first_round", _first_round_sql())
def q_first_round(spark, sf):
    """C4 + C5 + C6: expand the seeds' links and admit depth-1 URLs."""
    jobs = _crawl_cfg(spark, sf)
    frontier, cfg = PC.seed_frontier(jobs, None, None)
    proc = C.cap_pages(frontier, cfg)
    facts = PC.page_facts(FX.crawl_responses(spark, sf), None)
    fetched = PC._fetch_round(proc, facts, cfg.withColumn("engine", F.lit("fetch")).withColumn("has_renderings", F.lit(False)), None)
    cands = C.expand_links(PC._linked(fetched, facts), cfg, None)
    return C.admit_new(cands, frontier, cfg)


@register("c8_apply_backoff", _C8_SQL)
def q_backoff(spark, sf):
    """Fixed-step host backoff folded per job over page pops in FIFO order."""
    p = FX.job_pages(spark, sf).select(
        "job_id", "ord",
        (F.col("scraped_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("ord") * 11).cast("int")))
        .alias("fetched_at"), (F.col("status") == "blocked").alias("blocked"))
    return C.apply_backoff(p, None)


_C13_CLASS = """
  CASE WHEN error IS NOT NULL AND (contains(error, 'TimeoutError') OR contains(error, 'abort')) THEN 'timeout'
       WHEN error IS NOT NULL THEN 'error' WHEN http_status = 304 THEN 'scraped'
       WHEN http_status = 404 THEN 'not_found' WHEN http_status IN (403, 429) THEN 'blocked'
       WHEN http_status IS NULL OR http_status < 200 OR http_status >= 300 THEN 'error' ELSE 'scraped' END"""
_C13_ERR = """
  CASE WHEN error IS NOT NULL AND (contains(error, 'TimeoutError') OR contains(error, 'abort')) THEN 'Request timed out'
       WHEN error IS NOT NULL THEN error WHEN http_status = 304 THEN NULL
       WHEN http_status IS NULL OR http_status < 200 OR http_status >= 300 THEN 'HTTP ' || CAST(http_status AS VARCHAR) END"""


@register("c13_page_results", _W("responses") + f""",
c AS (SELECT page_id, url, html, fetched_at, duration_ms, {_C13_CLASS} AS status,
        coalesce(error IS NULL AND http_status = 304, false) AS unchanged, {_C13_ERR} AS err FROM responses)
SELECT 'job_pages' AS job_id, page_id + 1 AS ord, url, 0 AS depth, status,
  'fetch' AS engine,
  CASE WHEN status = 'scraped' AND NOT unchanged THEN {O.page_title(O.strip_nodes('html'))}
       WHEN status = 'scraped' AND unchanged THEN '(unchanged)' END AS title,
  CASE WHEN status <> 'scraped' THEN err END AS error, duration_ms, fetched_at AS scraped_at, fetched_at AS created_at
FROM c""")
def q_page_results(spark, sf):
    """Scraped / unchanged / failed page-row shapes from classified captures."""
    r = FX.responses(spark, sf).withColumn("job_id", F.lit("job_pages")) \
          .withColumn("ord", F.col("page_id") + 1).withColumn("depth", F.lit(0))
    s = X.scrape_pages(r, keep=("job_id", "ord", "depth", "fetched_at", "duration_ms"), with_markdown=False)
    return C.page_results(s.withColumn("skipped", F.lit(False))).drop("markdown", "markdown_length")


@register("x3_html_to_markdown")
def q_markdown(spark, sf):
    """Body HTML -> markdown via the Arrow-batched tree walk."""
    md = _pages(spark, sf).select("page_id", X.html_to_markdown(F.col("html")).alias("md"))
    from ..functions.text import utf16_length
    return md.select("page_id", utf16_length("md").alias("markdown_length"), F.sha2("md", 256).alias("sha256"))


@register("x5_is_thin")
def q_thin(spark, sf):
    """Thin-page flag (markdown < 150 UTF-16 units) of every scraped page."""
    from ..functions.html import is_thin
    md = _pages(spark, sf).select("page_id", X.html_to_markdown(F.col("html")).alias("md"))
    return md.select("page_id", is_thin("md").alias("thin"))


@register("m6_conditional_requests", _W("monitor_prev", "monitor_cur") + """
SELECT c.monitor_id, c.url, nullif(p.etag, '') AS if_none_match, nullif(p.last_modified, '') AS if_modified_since
FROM monitor_cur c LEFT JOIN monitor_prev p ON p.monitor_id = c.monitor_id AND p.url = c.url""")
def q_conditional(spark, sf):
    """M6: stored validators of every page that a run fetches."""
    return M.conditional_requests(FX.monitor_cur(spark, sf), _state(spark, sf))


@register("m6_conditional_unchanged", _W("monitor_cur") + """
SELECT monitor_id, url, http_status = 304 AS unchanged, http_status IN (200, 304) AS counts_as_scraped FROM monitor_cur""")
def q_unchanged(spark, sf):
    """M6: a 304 answer counts as scraped, takes no diff and writes no state."""
    s, unchanged, _ = X.classify_response("http_status", "_err")
    cur = FX.monitor_cur(spark, sf).withColumn("_err", F.lit(None).cast("string"))
    return cur.select("monitor_id", "url", unchanged.alias("unchanged"), (s == "scraped").alias("counts_as_scraped"))



@register("m16_monitor_crawl_changes")
def q_monitor_crawl(spark, sf):
    """M16 over real crawls: run 1 crawls the earlier capture into monitor
    state, run 2 crawls the current capture; returns the run's change
    records (monitor_id, url, diff). Both captures are laid out once; a
    crawl reads its captures twice."""
    mons = FX.crawl_monitors(spark, sf)
    earlier, current = (PC._materialize(c, fresh_dir(spark, "captures"))
                        for c in (FX.crawl_responses_previous(spark, sf), FX.crawl_responses(spark, sf)))
    first = MR.crawl_snapshot(spark, mons, earlier, "2024-01-29 12:00:00")
    empty = spark.createDataFrame([], MR.M.snapshot_state(FX.monitor_prev(spark, sf)).schema)
    state = M.upsert_monitor_pages(empty, first)
    run = MR.monitor_run_crawl(spark, mons, state, current, _RUN_AT)
    return run.change_rows.select("monitor_id", "url", "diff")
