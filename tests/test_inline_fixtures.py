"""Edge cases the derived tables cannot reach, on small inline fixtures
(FIXTURES.md section 4), checked against hand-derived expectations."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from webloom.operators import crawl as C
from webloom.operators import extract as X
from webloom.operators import llm as L
from webloom.operators import monitor as M
from webloom.operators import ops as Q
from webloom.sources import fixtures as FX

RESP = "url string, engine string, http_status int, html string, error string"
THIN = "<html><body><p>tiny</p></body></html>"
FULL = "<html><head><title>Full</title></head><body><p>" + "long text " * 40 + "</p></body></html>"


def _resp(spark, rows):
    return spark.createDataFrame(rows, RESP)


def test_classify_transport_and_status(spark):
    rows = [("u1", "fetch", None, None, "TimeoutError: signal timed out"),
            ("u2", "fetch", None, None, "This operation was aborted"),
            ("u3", "fetch", None, None, "getaddrinfo ENOTFOUND"),
            ("u4", "fetch", 304, None, None), ("u5", "fetch", 403, None, None),
            ("u6", "fetch", 404, None, None), ("u7", "fetch", 429, None, None),
            ("u8", "fetch", 500, None, None), ("u9", "fetch", 200, FULL, None)]
    s, u, e = X.classify_response()
    got = {r.url: (r.s, r.u, r.e) for r in _resp(spark, rows).select("url", s.alias("s"), u.alias("u"), e.alias("e")).collect()}
    assert got == {
        "u1": ("timeout", False, "Request timed out"), "u2": ("timeout", False, "Request timed out"),
        "u3": ("error", False, "getaddrinfo ENOTFOUND"), "u4": ("scraped", True, None),
        "u5": ("blocked", False, "HTTP 403"), "u6": ("not_found", False, "HTTP 404"),
        "u7": ("blocked", False, "HTTP 429"), "u8": ("error", False, "HTTP 500"), "u9": ("scraped", False, None)}


@pytest.mark.parametrize("engine,flavour,expect", [
    ("auto", "scrape", {"thin-r": "browser", "thin-none": "fetch", "blocked-r": "fetch", "thin-rfail": "fetch", "full": "fetch"}),
    ("auto", "crawl", {"thin-r": "browser", "thin-none": "fetch", "blocked-r": "browser", "thin-rfail": "fetch", "full": "fetch"}),
    ("fetch", "crawl", {"thin-r": "fetch", "thin-none": "fetch", "blocked-r": "fetch", "thin-rfail": "fetch", "full": "fetch"}),
])
def test_choose_rendering(spark, engine, flavour, expect):
    plain = _resp(spark, [("thin-r", "fetch", 200, THIN, None), ("thin-none", "fetch", 200, THIN, None),
                          ("blocked-r", "fetch", 403, None, None), ("thin-rfail", "fetch", 200, THIN, None),
                          ("full", "fetch", 200, FULL, None)])
    rendered = _resp(spark, [("thin-r", "browser", 200, FULL, None), ("blocked-r", "browser", 200, FULL, None),
                             ("thin-rfail", "browser", None, None, "Navigation timeout"),
                             ("full", "browser", 200, FULL, None)])
    out = X.choose_rendering(X.scrape_pages(plain), X.scrape_pages(rendered), engine, flavour)
    assert {r.url: r.engine for r in out.collect()} == expect


def test_browser_engine_requires_rendering(spark):
    plain = _resp(spark, [("a", "fetch", 200, FULL, None), ("b", "fetch", 200, FULL, None)])
    rendered = _resp(spark, [("a", "browser", 200, FULL, None), ("b", "browser", None, None, "crashed")])
    out = {r.url: (r.status, r.engine) for r in
           X.choose_rendering(X.scrape_pages(plain), X.scrape_pages(rendered), "browser").collect()}
    assert out == {"a": ("scraped", "browser"), "b": ("error", None)}


def test_scrape_log_rows_engine_on_failure(spark):
    plain = X.scrape_pages(_resp(spark, [("ok", "fetch", 200, FULL, None), ("bad", "fetch", 500, None, None)]))
    auto = {r.url: (r.status, r.engine) for r in X.scrape_log_rows(X.choose_rendering(plain, plain.limit(0))).collect()}
    assert auto == {"ok": ("ok", "fetch"), "bad": ("error", None)}
    fetch = {r.url: r.engine for r in X.scrape_log_rows(plain, "fetch").collect()}
    assert fetch == {"ok": "fetch", "bad": "fetch"}
    errs = X.scrape_pages(_resp(spark, [("u1", "fetch", None, None, "getaddrinfo ENOTFOUND"),
                                        ("u2", "fetch", 404, None, None), ("u3", "fetch", 304, None, None)]))
    got = {r.url: r.error for r in X.scrape_log_rows(errs, "fetch").collect()}
    assert got == {"u1": "Failed to fetch u1: getaddrinfo ENOTFOUND", "u2": "u2 returned HTTP 404",
                   "u3": "u3 returned HTTP 304"}
    b = X.scrape_pages(_resp(spark, [("u4", "browser", None, None, "Navigation timeout of 30000 ms exceeded")]))
    got = {r.url: r.error for r in X.scrape_log_rows(b, "browser").collect()}
    assert got == {"u4": "Browser scrape failed for u4: Navigation timeout of 30000 ms exceeded"}


SITEMAPS = [
    ("https://a.com/sitemap.xml", '<urlset><url><loc>https://a.com/x</loc></url><url><LOC> https://a.com/y </LOC></url>'
                                  '<url><loc>https://a.com/x</loc></url><url><loc>https://b.com/z</loc></url>'
                                  '<url><loc>https://a.com/feed.xml</loc></url></urlset>'),
    ("https://i.com/sitemap.xml", '<sitemapindex><sitemap><loc>https://i.com/s1.xml</loc></sitemap>'
                                  '<sitemap><loc>https://i.com/missing.xml</loc></sitemap>'
                                  '<sitemap><loc>https://i.com/page</loc></sitemap></sitemapindex>'),
    ("https://i.com/s1.xml", "<urlset><url><loc>https://i.com/p1</loc></url><url><loc>https://i.com/p2/</loc></url></urlset>"),
]


def _jobs(spark, rows):
    df = spark.createDataFrame(rows, "id string, url string, max_pages int, max_depth int")
    df = df.withColumn("include_patterns", F.array().cast("array<string>")) \
           .withColumn("exclude_patterns", F.array().cast("array<string>"))
    from webloom.functions import urls as U
    df = U.evaluate_once(df, _sp=U.parse_url_parts("url"))
    return df.select("*", F.col("_sp.host").alias("seed_host"), U.url_origin_of(F.col("_sp")).alias("seed_origin")).drop("_sp")


def test_sitemap_discovery(spark):
    sm = spark.createDataFrame(SITEMAPS, "sitemap_url string, xml string")
    jobs = _jobs(spark, [("ja", "https://a.com/", 10, 2), ("ji", "https://i.com/", 10, 2), ("jn", "https://n.com/", 10, 2),
                         ("jcap", "https://a.com/", 1, 2)])
    got = {}
    for r in C.discover_from_sitemap(jobs, sm, None).collect():
        got.setdefault(r.job_id, []).append((r.n, r.url))
    assert sorted(got["ja"]) == [(1, "https://a.com/x"), (2, "https://a.com/y")]      # dup, foreign host, .xml dropped
    assert sorted(got["ji"]) == [(1, "https://i.com/p1"), (2, "https://i.com/p2")]   # index: child locs, missing child skipped
    assert "jn" not in got                                                          # no sitemap -> root fallback
    assert got["jcap"] == [(1, "https://a.com/x")]                                  # capped to max_pages


ROBOTS = [("https://r.com", "User-agent: *\nDisallow: /private\nAllow: /private/ok\nDisallow: /*.pdf$\n"
                            "Disallow: /tmp*x\n\nUser-agent: other\nDisallow: /\n"),
          ("https://q.com", f"User-agent: {C.USER_AGENT.split('/')[0]}\nDisallow: /\n\nUser-agent: *\nDisallow:\n"),
          ("https://e.com", "")]


def test_robots_rules(spark):
    rules = C.robots_rules(spark.createDataFrame(ROBOTS, "origin string, body string"))
    urls = ["https://r.com/private/x", "https://r.com/private/ok/1", "https://r.com/doc.pdf", "https://r.com/doc.pdf?x=1",
            "https://r.com/tmp/a/x", "https://r.com/public", "https://q.com/any", "https://e.com/any", "https://z.com/any"]
    cands = spark.createDataFrame([(u,) for u in urls], "url string")
    allowed = {r.url for r in C.robots_filter(cands, rules).collect()}
    assert allowed == {"https://r.com/private/ok/1", "https://r.com/doc.pdf?x=1", "https://r.com/public",
                       "https://e.com/any", "https://z.com/any"}


def _verdict_rows(spark, replies):
    changes = spark.createDataFrame([("m1", f"https://m.com/{i}", f"+line {i}\n") for i in range(len(replies))] +
                                    [("m2", "https://n.com/0", "-x\n")], "monitor_id string, url string, diff string")
    monitors = spark.createDataFrame([("m1", "Track prices"), ("m2", None)], "id string, goal string")
    prompts = M.judge_prompts(changes, monitors).select("url", "prompt_hash").collect()
    by_url = {r.url: r.prompt_hash for r in prompts}
    comp = spark.createDataFrame([(by_url[f"https://m.com/{i}"], 1, t, e) for i, (t, e) in enumerate(replies)],
                                 "prompt_hash string, attempt int, text string, error string")
    return {r.url: (r.keep, r.relevant, r.reason, r.dropped_unparsed)
            for r in M.apply_verdicts(changes, monitors, comp).collect()}


def test_judge_verdicts(spark):
    got = _verdict_rows(spark, [('{"relevant": true, "reason": "price"}', None),
                                ('```json\n{"relevant": false, "reason": "noise"}\n```', None),
                                ("not json", None), (None, "LLM down"), ('{"relevant": 0}', None)])
    assert got["https://m.com/0"] == (True, True, "price", False)
    assert got["https://m.com/1"][0] is False
    assert got["https://m.com/2"] == (False, True, None, True)      # unparseable: dropped, counted
    assert got["https://m.com/3"] == (True, None, None, False)      # call failure: kept without verdict
    assert got["https://m.com/4"][0] is False                        # falsy relevant
    assert got["https://n.com/0"] == (True, None, None, False)      # no goal: kept


def test_extraction_retry(spark):
    prompts = spark.createDataFrame([(f"h{i}",) for i in range(8)], "prompt_hash string")
    replies = [("h0", 1, '```json\n{"a": 1}\n```'), ("h1", 1, '{"a": 2}'), ("h2", 1, "nope"), ("h2", 2, '{"a": 3}'),
               ("h3", 1, "nope"), ("h3", 2, "still nope"), ("h4", 1, "[1, 2]"), ("h5", 1, "0"), ("h5", 2, "false"),
               ("h6", 1, '{"n": "x"}'), ("h7", 1, '""'), ("h7", 2, '{"a": 4}')]
    comp = spark.createDataFrame([(h, a, t, None) for h, a, t in replies],
                                 "prompt_hash string, attempt int, text string, error string")
    out = {r.prompt_hash: (r.attempts, r.error, r.data) for r in
           L.retry_failed(prompts, comp).select("prompt_hash", "attempts", "error",
                                                F.col("data").cast("string").alias("data")).collect()}
    assert out["h0"] == (1, None, '{"a":1}')
    assert out["h1"] == (1, None, '{"a":2}')
    assert out["h2"] == (2, None, '{"a":3}')
    assert out["h3"] == (2, "extraction-failed", None)
    assert out["h4"] == (1, None, "[1,2]")           # an array counts as success
    assert out["h5"] == (2, "extraction-failed", None)  # 0 then false: falsy twice
    assert out["h7"] == (2, None, '{"a":4}')         # "" is falsy -> retry
    typed = L.typed_fields(F.try_parse_json(F.lit('{"n": "x", "t": ["a"]}')), {"n": "number", "t": "array of strings"})
    row = spark.range(1).select(typed.alias("t")).collect()[0].t
    assert row.n is None and row.t == ["a"]          # wrong type -> NULL (extension)


def test_truncation_counts_utf16_units(spark):
    text = "😀" * 60000  # 120,000 UTF-16 units, 60,000 code points
    c, t = L.truncate_for_prompt(F.lit(text))
    r = spark.range(1).select(F.length(c).alias("n"), t.alias("t")).collect()[0]
    assert r.t is True and r.n == 50000


def test_stale_jobs_and_retention(spark):
    now = "2024-01-30 12:00:00"
    jobs = spark.createDataFrame([("a", "running", "2024-01-30 11:59:00"), ("b", "running", "2024-01-30 11:57:00"),
                                  ("c", "running", None), ("d", "completed", "2024-01-01 00:00:00")],
                                 "id string, status string, hb string") \
        .select("id", "status", F.lit("u").alias("url"), F.col("hb").cast("timestamp_ntz").alias("last_heartbeat_at"))
    assert {r.id for r in Q.stale_jobs(jobs, now).collect()} == {"b"}
    logs = spark.createDataFrame([(1, "2023-12-31 12:00:00"), (2, "2023-12-31 11:59:59.999999"), (3, "2024-01-15 00:00:00")],
                                 "id long, t string").select("id", F.col("t").cast("timestamp_ntz").alias("created_at"))
    assert {r.id for r in Q.retain_logs(logs, now, 30).collect()} == {1, 3}


def test_due_monitors(spark):
    # 2024-01-30 is a Tuesday; last Sunday tick is 2024-01-28 00:00
    rows = [("h1", "hourly", "active", "2024-01-30 11:59:59"), ("h2", "hourly", "active", "2024-01-30 12:00:00"),
            ("d1", "daily", "active", "2024-01-29 23:59:59"), ("d2", "daily", "active", "2024-01-30 00:00:00"),
            ("w1", "weekly", "active", "2024-01-27 23:59:59"), ("w2", "weekly", "active", "2024-01-28 00:00:00"),
            ("n1", "daily", "active", None), ("p1", "hourly", "paused", None), ("x1", "deleted", "deleted", None),
            ("u1", "monthly", "active", "2024-01-29 12:00:00")]
    mons = spark.createDataFrame(rows, "id string, frequency string, status string, t string") \
        .withColumn("last_checked_at", F.col("t").cast("timestamp_ntz"))
    due = {r.id for r in M.due_monitors(mons, "2024-01-30 12:00:00").collect()}
    assert due == {"h1", "d1", "w1", "n1", "u1"}


def test_fixture_completions_unique_per_prompt(spark):
    prompts = spark.createDataFrame([("a" * 64,), ("a" * 64,), ("b" * 64,)], "prompt_hash string")
    comp = FX.completions(spark, "", prompts)
    assert comp.count() == 4


def test_page_results_shapes(spark):
    rows = [("j", 1, "u1", 0, "scraped", False, None, "fetch", "T", "md", 2, False, dt.datetime(2024, 1, 1), 5),
            ("j", 2, "u2", 0, "scraped", True, None, "fetch", None, None, None, False, dt.datetime(2024, 1, 1), 6),
            ("j", 3, "u3", 0, "blocked", False, "HTTP 403", "browser", None, None, None, False, dt.datetime(2024, 1, 1), 7),
            ("j", 4, "u4", 0, "blocked", False, "Domain in backoff window", None, None, None, None, True,
             dt.datetime(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "job_id string, ord long, url string, depth int, status string, unchanged boolean, "
                                     "error string, engine string, title string, markdown string, markdown_length int, "
                                     "skipped boolean, fetched_at timestamp_ntz, duration_ms int")
    out = {r.ord: r for r in C.page_results(df).collect()}
    assert (out[1].title, out[1].engine, out[1].markdown_length) == ("T", "fetch", 2)
    assert (out[2].title, out[2].markdown, out[2].engine) == ("(unchanged)", None, "fetch")
    assert (out[3].engine, out[3].error) == ("fetch", "HTTP 403")
    assert (out[4].error, out[4].duration_ms) == ("Domain in backoff window", None)


def test_retry_prompt_exposed_for_live_callers(spark):
    prompts = spark.createDataFrame([("h1", "P1"), ("h2", "P2")], "prompt_hash string, prompt string")
    comp = spark.createDataFrame([("h1", 1, '{"a": 1}', None), ("h2", 1, "nope", None), ("h2", 2, '{"a": 2}', None)],
                                 "prompt_hash string, attempt int, text string, error string")
    out = {r.prompt_hash: r.retry_prompt for r in L.retry_failed(prompts, comp).collect()}
    assert out["h1"] is None
    assert out["h2"] == "P2" + L.RETRY_SUFFIX


def test_missing_judge_reply_keeps_change(spark):
    changes = spark.createDataFrame([("m1", "https://m.com/a", "+x\n")], "monitor_id string, url string, diff string")
    monitors = spark.createDataFrame([("m1", "Track prices")], "id string, goal string")
    empty = spark.createDataFrame([], "prompt_hash string, attempt int, text string, error string")
    r = M.apply_verdicts(changes, monitors, empty).collect()[0]
    assert (r.keep, r.relevant, r.dropped_unparsed) == (True, None, False)
