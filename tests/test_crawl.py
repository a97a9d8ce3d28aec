"""Crawl invariants and equality with a plain FIFO queue simulation."""
import datetime
import datetime as dt
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from webloom.operators import crawl as C
from webloom.operators.pages import page_links_exploded
from webloom.plans.crawl import crawl
from webloom.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def result(spark):
    jobs = FX.crawl_jobs(spark, SF)
    return crawl(spark, jobs, FX.crawl_responses(spark, SF)), jobs


def test_invariants(result):
    r, jobs = result
    cfg = {j.id: j for j in jobs.collect()}
    pages = r.pages.collect()
    visited = r.visited.collect()
    seen = set()
    for p in pages:
        assert (p.job_id, p.url) not in seen
        seen.add((p.job_id, p.url))
        assert p.ord <= cfg[p.job_id].max_pages
        assert p.depth <= cfg[p.job_id].max_depth
    per_job = {}
    for v in visited:
        per_job[v.job_id] = per_job.get(v.job_id, 0) + 1
    for jid, n in per_job.items():
        assert n <= 3 * cfg[jid].max_pages


def _glob_ok(path, inc, exc):
    def rx(g):
        return "^" + re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", g).replace("*", ".*") + "$"
    if any(re.match(rx(g), path) for g in exc):
        return False
    return not inc or any(re.match(rx(g), path) for g in inc)


def _simulate(job, graph, caps):
    """The reference's loop: FIFO queue, visited set, 3x discovery cap,
    max_pages budget, fixed-step host backoff on the capture clock."""
    frontier = deque([(job.url, 0)])
    visited = {job.url}
    out, until = [], None
    while len(out) < job.max_pages and frontier:
        url, depth = frontier.popleft()
        status, at = caps.get(url, (None, None))
        if until is not None and at is not None and at < until:
            out.append((url, depth, "blocked"))
            continue
        st = {200: "scraped", 403: "blocked", 404: "not_found"}.get(status, "error")
        out.append((url, depth, st))
        if st == "blocked":
            until = (until or at) + datetime.timedelta(seconds=30)
        if st != "scraped" or depth >= job.max_depth:
            continue
        host = job.url.split("/")[2]
        for child in graph.get(url, []):
            if len(visited) >= 3 * job.max_pages:
                break
            if child is None or child.split("/")[2] != host or not child.startswith("https://"):
                continue
            if not _glob_ok("/" + child.split("/", 3)[3], job.include_patterns, job.exclude_patterns):
                continue
            if child in visited:
                continue
            visited.add(child)
            frontier.append((child, depth + 1))
    return out, len(visited)


def test_equals_queue_simulation(spark, result):
    r, jobs = result
    resp = FX.crawl_responses(spark, SF)
    caps = {x.url: (x.http_status, x.fetched_at) for x in resp.collect()}
    ex = page_links_exploded(resp.where(F.col("html").isNotNull()).withColumn("pid", F.col("url")), "pid")
    graph = {}
    for e in sorted(ex.collect(), key=lambda e: (e.pid, e.pos)):
        graph.setdefault(e.pid, []).append(e.link_url)
    pages = r.pages.collect()
    discovered = {j.id: j.pages_discovered for j in r.jobs.collect()}
    for j in jobs.collect():
        want, n_visited = _simulate(j, graph, caps)
        got = [(p.url, p.depth, p.status) for p in sorted((p for p in pages if p.job_id == j.id),
                                                          key=lambda p: p.ord)]
        assert got == want, j.id
        assert discovered[j.id] == n_visited, j.id


def test_backoff_fold(spark):
    rows = [("j", 1, "2024-01-01 00:00:00", True), ("j", 2, "2024-01-01 00:00:10", False),
            ("j", 3, "2024-01-01 00:00:31", True), ("j", 4, "2024-01-01 00:01:35", False),
            ("j", 5, "2024-01-01 00:01:40", True), ("j", 6, "2024-01-01 00:01:50", False)]
    df = spark.createDataFrame(rows, "job_id string, ord long, fetched_at string, blocked boolean") \
              .withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))
    got = {r.ord: r.skipped for r in C.apply_backoff(df, None).collect()}
    # blocked at 0s -> window to 30s: page 2 skipped; page 3 at 31s fetched and
    # blocked -> window extends the old deadline to 60s; 95s and 100s are past it;
    # page 5 blocks again (60s + 30s = 90s < 110s), so page 6 is fetched
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_host_partitioned_captures_give_same_crawl(spark, result):
    from webloom.plans.crawl import stage_captures
    r, jobs = result
    staged = crawl(spark, jobs, stage_captures(FX.crawl_responses(spark, SF)))
    cols = ["job_id", "ord", "url", "depth", "status", "title", "error"]
    assert sorted(map(tuple, staged.pages.select(*cols).collect())) == sorted(map(tuple, r.pages.select(*cols).collect()))


def test_engine_routing_in_crawl(spark):
    full = lambda links: ("<html><head><title>T</title></head><body><p>" + "words " * 40 + "</p>"
                          + "".join(f'<a href="{h}">x</a>' for h in links) + "</body></html>")
    thin = lambda links: "<html><body><p>tiny</p>" + "".join(f'<a href="{h}">x</a>' for h in links) + "</body></html>"
    ts = dt.datetime(2024, 1, 30)
    plain = [("https://a.com/", 200, thin(["/pa"])), ("https://a.com/ra", 200, full([])),
             ("https://a.com/pa", 200, full([])),
             ("https://b.com/", 200, full(["/pb"])), ("https://b.com/rb", 200, full([])),
             ("https://c.com/", 200, thin(["/pc"])), ("https://c.com/pc", 200, full([])),
             ("https://d.com/", 403, None), ("https://d.com/rd", 200, full([])),
             ("https://e.com/", 200, full([]))]
    rend = [("https://a.com/", 200, full(["/ra"])), ("https://a.com/ra", 200, full([])),
            ("https://b.com/", 200, full(["/rb"])), ("https://b.com/rb", 200, full([])),
            ("https://c.com/", 200, full(["/rc"])), ("https://d.com/", 200, full(["/rd"])),
            ("https://d.com/rd", 200, full([]))]

    def caps(rows, engine):
        return spark.createDataFrame(
            [(u, engine, s, None, None, h, None, ts + dt.timedelta(minutes=i), 10) for i, (u, s, h) in enumerate(rows)],
            "url string, engine string, http_status int, etag string, last_modified string, html string, "
            "error string, fetched_at timestamp_ntz, duration_ms int")

    jobs = spark.createDataFrame(
        [("ja", "https://a.com/", "auto"), ("jb", "https://b.com/", "browser"), ("jc", "https://c.com/", "fetch"),
         ("jd", "https://d.com/", "auto"), ("je", "https://e.com/", "browser")],
        "id string, url string, engine string") \
        .withColumn("max_depth", F.lit(1)).withColumn("max_pages", F.lit(5)) \
        .withColumn("include_patterns", F.array().cast("array<string>")) \
        .withColumn("exclude_patterns", F.array().cast("array<string>")) \
        .withColumn("webhook_url", F.lit(None).cast("string"))
    r = crawl(spark, jobs, caps(plain, "fetch"), rendered=caps(rend, "browser"))
    got = {(p.job_id, p.url): (p.status, p.engine) for p in r.pages.collect()}
    assert got[("ja", "https://a.com/")] == ("scraped", "browser")       # thin -> rendering
    assert ("ja", "https://a.com/ra") in got                             # links of the rendering
    assert got[("jb", "https://b.com/rb")] == ("scraped", "browser")     # browser engine
    assert got[("jc", "https://c.com/")] == ("scraped", "fetch")         # fetch ignores renderings
    assert ("jc", "https://c.com/pc") in got
    assert got[("jd", "https://d.com/")] == ("scraped", "browser")       # blocked -> rendering
    assert got[("je", "https://e.com/")] == ("error", "fetch")           # no rendering captured
    md = {p.url: p.markdown_length for p in r.pages.where("job_id = 'ja'").collect()}
    assert md["https://a.com/"] > 150                                    # markdown of the rendering
