"""Crawls that stop and go on, the visited store, validators,
runs that break off."""
import re

import pytest
from pyspark.sql import functions as F

from webloom.operators import crawl as C
from webloom.plans import crawl as PC
from webloom.session import fresh_dir
from webloom.sources import fixtures as FX

SF = "/root/testdata/sf0.001"
PAGE = ["job_id", "ord", "url", "depth", "status", "engine", "title", "error", "markdown_length", "duration_ms", "scraped_at"]


@pytest.fixture(scope="module")
def inputs(spark):
    keep = lambda df, n: df.cache() if df.count() >= 0 else n
    jobs = FX.crawl_jobs(spark, SF).orderBy("id").limit(8).withColumn("max_depth", F.lit(3)).withColumn("include_patterns", F.array().cast("array<string>"))
    return {"jobs": keep(jobs, "jobs"), "responses": keep(FX.crawl_responses(spark, SF), "r"),
            "sitemaps": FX.crawl_sitemaps(spark, SF).limit(1), "robots": FX.crawl_robots(spark, SF), "rendered": keep(FX.crawl_rendered(spark, SF), "x")}


@pytest.fixture(scope="module")
def whole(spark, inputs):
    return PC.crawl(spark, **inputs)


def rows(result):
    return (sorted(map(str, result.pages.select(*PAGE).collect())), sorted(map(str, result.visited.collect())),
            sorted(map(str, result.jobs.drop("webhook_url").collect())))


def test_stopped_after_every_round(spark, inputs, whole):
    store = fresh_dir(spark, "resumed")
    part = PC.crawl(spark, **inputs, max_rounds=1, store=store)
    assert part.rounds == 1 and part.pages.count() < whole.pages.count()
    for n in range(2, 20):
        before = part
        part = PC.resume_crawl(spark, store, inputs["responses"], inputs["rendered"], max_rounds=1)
        if part.rounds == before.rounds:
            break
        assert part.rounds == n
    assert part.rounds == whole.rounds >= 3 and rows(part) == rows(whole)
    with pytest.raises(ValueError):
        PC.crawl(spark, **inputs, store=store)


def test_cut_short_within_a_round(spark, inputs, whole):
    """Rows of a round without a commit are done again, not counted twice."""
    store = fresh_dir(spark, "cut")
    PC.crawl(spark, **inputs, max_rounds=2, store=store)
    at = PC._Store(spark, store)
    at.visited.attach(PC.VISITED)
    lost = at.admitted().limit(7).withColumn("url", F.concat("url", F.lit("/lost"))).withColumn("attempt", F.lit("lost"))
    at.visited.append(lost.withColumn("round", F.lit(3)))
    at.visited.append(at.admitted().where("round = 2").withColumn("attempt", F.lit("twice")))
    assert rows(PC.resume_crawl(spark, store, inputs["responses"], inputs["rendered"])) == rows(whole)


def test_stored_visited_rows_do_not_move(spark, inputs):
    store = fresh_dir(spark, "plan")
    PC.crawl(spark, **inputs, max_rounds=1, store=store)
    at = PC._Store(spark, store)
    at.visited.attach(PC.VISITED)
    cands = at.admitted().select("job_id", "url", F.col("ord").alias("parent_ord"), F.lit(0).alias("pos"), "depth").repartition(3)
    seen = at.admitted().groupBy("job_id").agg(F.max("ord").alias("n_visited"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.admit_new(cands, at.admitted(), at.table("jobs"), seen)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan[plan.index("LeftAnti"):].split("\n")
    depth = lambda s: len(re.match(r"[\s:+\-|]*", s)[0])
    sides = [i for i, s in enumerate(lines[1:], 1) if depth(s) == depth(lines[1])][:2]
    right = "\n".join(lines[sides[1]: next((i for i, s in enumerate(lines[sides[1] + 1:], sides[1] + 1) if depth(s) <= depth(lines[1])), None)])
    assert "Bucketed: true" in right and "Exchange" not in right, plan


def test_validators_give_304(spark, inputs):
    """A capture that still carries the stored etag counts as unchanged."""
    jobs = inputs["jobs"].withColumn("engine", F.lit("fetch"))
    first = PC.crawl(spark, jobs, inputs["responses"].withColumn("etag", F.sha2("html", 256)))
    known = first.validators.where("etag is not null").select("job_id", "url", F.col("etag").alias("if_none_match"), F.lit(None).cast("string").alias("if_modified_since"))
    known = known.withColumn("if_none_match", F.when(F.crc32("url") % 2 == 0, F.col("if_none_match")).otherwise("old"))
    got = PC.crawl(spark, jobs, inputs["responses"].withColumn("etag", F.sha2("html", 256)), validators=known, expand_unchanged=True)
    a = {(r.job_id, r.url): r for r in first.pages.collect()}
    b = {(r.job_id, r.url): r for r in got.pages.collect()}
    same = {(r.job_id, r.url) for r in known.where("if_none_match <> 'old'").collect()}
    assert same and set(a) == set(b)
    for k, r in b.items():
        assert r.status == a[k].status
        assert (r.title == "(unchanged)" and r.markdown is None) if k in same and r.error is None else r.title == a[k].title


def test_a_run_that_breaks_off(spark, inputs, whole):
    ids = sorted(r.id for r in whole.jobs.where("pages_scraped > 0").select("id").collect())
    broken = spark.createDataFrame([(ids[0], "connection lost"), (ids[0], "connection lost")], "job_id string, error string")
    got = {r.id: r for r in PC.crawl(spark, **inputs, failures=broken).jobs.collect()}
    want = {r.id: r for r in whole.jobs.collect()}
    b = got.pop(ids[0])
    assert (b.status, b.pages_scraped, b.pages_failed, b.error) == ("failed", 0, 0, "connection lost")
    assert got == {k: v for k, v in want.items() if k != ids[0]}


def test_budgets_beyond_the_bound_are_refused(spark):
    """S5 and C5 by themselves fail for a job above 1,000 pages instead of cutting it."""
    jobs = spark.createDataFrame([("j", "https://a.com/", 1001)], "id string, url string, max_pages int") \
        .withColumn("include_patterns", F.array().cast("array<string>")).withColumn("exclude_patterns", F.array().cast("array<string>"))
    cands = spark.createDataFrame([("j", "https://a.com/x", 1, 0, 1)], "job_id string, url string, parent_ord long, pos int, depth int")
    visited = spark.createDataFrame([("j", "https://a.com/", 1)], "job_id string, url string, ord long")
    with pytest.raises(Exception, match="above 1000"):
        C.admit_new(cands, visited, jobs).collect()
    sitemaps = spark.createDataFrame([("https://a.com/sitemap.xml", "<urlset><loc>https://a.com/x</loc></urlset>")], "sitemap_url string, xml string")
    with pytest.raises(Exception, match="above 1000"):
        C.discover_from_sitemap(jobs, sitemaps, None).collect()
    assert C.admit_new(cands, visited, jobs.withColumn("max_pages", F.lit(1000))).count() == 1
