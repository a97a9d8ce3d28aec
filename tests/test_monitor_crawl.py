"""Monitor runs over real crawls at size: hosts with many pages, stored snapshots, buckets of small crawls."""

from collections import Counter
from contextlib import contextmanager

import pytest

from webloom.plans import crawl as PC
from webloom.plans import monitor_run as MR
from webloom.session import configure
from webloom.sources import fixtures as FX

HTML = "<html><head><title>t</title></head><body><nav></nav><article><h1>a</h1><p>one</p><p>two</p></article></body></html>"


@contextmanager
def conf(spark, **values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _write(spark, folder, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def large_host(spark, tmp_path_factory):
    """Most pages on one host; ids that come twice, in runs far apart, null; null URLs."""
    configure(spark)
    rows = [(i * 700, f"https://big.example/{i}", HTML) for i in range(400)]
    rows += [(700, "https://big.example/1", HTML), (None, "https://big.example/x", HTML), (None, None, HTML), (5, None, HTML), (9000, None, HTML)]
    rows += [(i, f"https://small{i % 3}.example/{i}", HTML) for i in range(12)]
    return _write(spark, tmp_path_factory.mktemp("pages"), rows), rows


def test_ranks_of_a_host_follow_its_page_ids(spark, large_host):
    folder, rows = large_host
    got = FX.link_graph_pages(spark, folder).collect()
    by_host = {}
    for i, url, _ in rows:
        by_host.setdefault(url and url.split("/")[2], []).append(i)
    want = [(h, i, r) for h, ids in by_host.items() for r, i in enumerate(sorted(ids, key=lambda i: (i is not None, i)), 1)]
    assert Counter((r.host, r.page_id, r.rank) for r in got) == Counter(want)
    assert all(r.path == f"/n/{r.rank}" and r.html == HTML for r in got)
    assert dict(FX.link_graph_pages(spark, folder).dtypes)["rank"] == "int"


def test_no_task_takes_a_whole_host(spark, large_host):
    folder, rows = large_host
    with conf(spark, **{"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        sizes = FX.link_graph_pages(spark, folder).rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(sizes) == len(rows) and max(sizes) < 0.5 * len(rows)


def test_small_crawl_takes_few_buckets_and_its_snapshot_is_stored(spark, tmp_path):
    configure(spark)
    sf = _write(spark, tmp_path / "in", [(11 + i * 10, f"https://one.example/{i}", HTML) for i in range(4)])
    most = max(64, spark.sparkContext.defaultParallelism * 4)
    with conf(spark, **{"spark.sql.shuffle.partitions": str(most)}):
        store = f"{tmp_path}/store"
        PC.crawl(spark, FX.crawl_jobs(spark, sf), FX.crawl_responses(spark, sf), store=store, max_rounds=1)
        at = PC._Store(spark, store)
        assert at.buckets == spark.sparkContext.defaultParallelism
    snapshot = MR.crawl_snapshot(spark, FX.crawl_monitors(spark, sf), FX.crawl_responses(spark, sf), "2024-01-29 12:00:00")
    assert "EvalPython" not in snapshot._jdf.queryExecution().toString()
    # two levels below the root; ranks 5 to 7 are linked but have no page
    assert {r.url: r.http_status for r in snapshot.collect()} == {f"https://one.example/n/{r}": 200 if r < 5 else 0 for r in range(1, 8)}


def test_buckets_grow_with_the_rows_up_to_the_shuffle_partitions(spark, tmp_path):
    at = PC._Store(spark, f"{tmp_path}/s")
    cores = spark.sparkContext.defaultParallelism
    with conf(spark, **{"spark.sql.shuffle.partitions": str(cores * 10)}):
        for rows, n in ((0, cores), (PC.BUCKET_ROWS * cores * 2 + 1, cores * 2 + 1), (PC.BUCKET_ROWS * cores * 99, cores * 10)):
            at.deal_for(rows)
            assert (at.buckets, at.facts.buckets, at.visited.buckets) == (n, n, n)
