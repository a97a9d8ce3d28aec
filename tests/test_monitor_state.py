"""M10 on the stored state: what an upsert reads and writes."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from webloom.operators import monitor as M
from webloom.sources import fixtures as FX
from webloom.sources.monitor_state import MonitorState

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def store(spark, tmp_path):
    return MonitorState(spark, str(tmp_path / "state"), buckets=32).replace(M.snapshot_state(FX.monitor_prev(spark, SF)), list(range(32)))


def files(store):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(store.path) for f in names if f.startswith("part-")}


def some(spark, store, n):
    """Fetched pages of ``n`` buckets, among them a new page, and a 304 of another bucket."""
    cur = FX.monitor_cur(spark, SF).where("http_status = 200").withColumn("b", store.bucket())
    buckets = sorted(r.b for r in cur.select("b").distinct().collect())[:n + 1]
    new = cur.where(F.col("b") == buckets[0]).limit(1).withColumn("http_status", F.lit(200))
    other = cur.where(F.col("b") == buckets[n]).withColumn("http_status", F.lit(304))
    return cur.where(F.col("b").isin(buckets[:n])).unionByName(other).drop("b"), buckets[:n], new


def test_upsert_touches_its_buckets_only(spark, store):
    cur, buckets, _ = some(spark, store, 3)
    before, kept = files(store), store.read()
    want = sorted(map(str, M.upsert_monitor_pages(store.read(), cur).collect()))
    near = store.near(cur.where("http_status = 200"))
    assert {int(p.split("bucket=")[1].split("/")[0]) for p in near.inputFiles()} == set(buckets)
    store.upsert(cur)
    assert sorted(map(str, store.read().collect())) == want
    after = files(store)
    assert {k: after[k] for k in before} == before and kept.count() > 0
    assert {int(p.split("bucket=")[1].split("/")[0]) for p in set(after) - set(before)} == set(buckets)
    assert sorted(map(str, MonitorState(spark, store.path).read().collect())) == want      # another session


def test_a_run_that_breaks_off_changes_nothing(spark, store, monkeypatch):
    cur, _, _ = some(spark, store, 2)
    before = sorted(map(str, store.read().collect()))
    from webloom.sources import folders
    put = folders.put_json
    monkeypatch.setattr(folders, "put_json", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        store.upsert(cur)
    monkeypatch.setattr(folders, "put_json", put)
    again = MonitorState(spark, store.path)
    assert sorted(map(str, again.read().collect())) == before
    want = sorted(map(str, M.upsert_monitor_pages(again.read(), cur).collect()))
    assert sorted(map(str, again.upsert(cur).read().collect())) == want


def test_forget_keeps_what_is_named(spark, store):
    cur, _, _ = some(spark, store, 2)
    for _ in range(3):
        store.upsert(cur)
    want, n = sorted(map(str, store.read().collect())), len(files(store))
    store.forget(1)
    assert sorted(map(str, store.read().collect())) == want and len(files(store)) < n


def test_empty_state_and_empty_run(spark, tmp_path):
    store = MonitorState(spark, str(tmp_path / "new"), buckets=4)
    assert store.read().count() == 0
    row = ("m", "u", 200, "text", '"e"', "Mon", dt.datetime(2024, 1, 1))
    schema = "monitor_id string, url string, http_status int, markdown string, etag string, last_modified string, checked_at timestamp_ntz"
    store.upsert(spark.createDataFrame([], schema))
    assert store.read().count() == 0 and store.version == 0
    store.upsert(spark.createDataFrame([row], schema))
    assert [(r.monitor_id, r.last_markdown, r.last_etag, r.last_modified) for r in store.read().collect()] == [("m", "text", '"e"', "Mon")]
