"""State that a query starts from, timers, replays."""
import datetime as dt
import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from webloom.operators import monitor as M
from webloom.operators import sinks as SK
from webloom.operators import ops as Q
from webloom.sources import fixtures as FX
from webloom.streaming import stream_ops as S

SF = "/root/testdata/sf0.001"
DAY = dt.datetime(2024, 1, 30)


def batches(spark, path, schema, *parts):
    """A stream with one micro-batch a part."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def drained(df, path, tmp):
    S.run_available(df, path, tmp + "/ckpt", partitions=2)
    return df.sparkSession.read.parquet(path)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_changes_start_from_the_stored_state(spark, tmp_path):
    state = spark.createDataFrame(
        [("m", "a", sha("one\n"), "one\n", '"1"', "Mon", DAY), ("m", "b", sha("old"), "old", None, None, DAY), ("m", "c", None, None, None, None, None)],
        "monitor_id string, url string, last_content_hash string, last_markdown string, last_etag string, last_modified string, last_checked_at timestamp_ntz")
    h = [DAY + dt.timedelta(hours=k) for k in range(9)]
    schema = "monitor_id string, url string, http_status int, markdown string, etag string, last_modified string, checked_at timestamp_ntz"
    src = batches(spark, str(tmp_path / "in"), schema,
                  [("m", "a", 200, "one\ntwo\n", '"2"', "Tue", h[2]), ("m", "a", 200, "stale", '"0"', "Sun", DAY), ("m", "b", 304, None, None, None, h[2]), ("m", "c", 200, "first", None, None, h[2])],
                  [("m", "a", 200, "one\ntwo\n", '"3"', "Wed", h[3]), ("m", "b", 200, "new", '"b"', None, h[3]), ("m", "c", 500, None, None, None, h[3]), ("n", "a", 200, "x", None, None, h[3])],
                  [("m", "a", 200, "one\n", None, None, h[4]), ("m", "a", 200, "", None, "Thu", h[5]), ("m", "c", 200, "second", None, None, h[1])])
    got = sorted(map(tuple, drained(S.stream_changes(src, state), str(tmp_path / "out"), str(tmp_path)).select("url", "prev_hash", "hash", "diff", "etag", "last_modified").collect()), key=str)
    assert got == sorted([
        ("a", sha("one\n"), sha("one\ntwo\n"), "+two\n", '"2"', "Tue"), ("b", sha("old"), sha("new"), "-old+new", '"b"', None),
        ("a", sha("one\ntwo\n"), sha("one\n"), "-two\n", None, None), ("a", sha("one\n"), sha(""), "-one\n", None, "Thu")], key=str)


def test_state_of_the_stream_equals_the_table(spark, tmp_path):
    """The stream started from M10's table reports what M7 reports."""
    state = M.snapshot_state(FX.monitor_prev(spark, SF))
    cur = FX.monitor_cur(spark, SF).select("monitor_id", "url", "http_status", "markdown", "etag", "last_modified", "checked_at")
    cur.repartition(3).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(cur.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(S.stream_changes(src, state), str(tmp_path / "out"), str(tmp_path))
    want = M.changed_pages(cur, state)
    cols = ["monitor_id", "url", "prev_hash", "hash"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect())) != []


def test_jobs_that_end_between_heartbeats(spark, tmp_path):
    at = lambda m, s=0: DAY + dt.timedelta(minutes=m, seconds=s)
    schema = "job_id string, ts timestamp_ntz, status string"
    src = batches(
        spark, str(tmp_path / "in"), schema,
        [(j, at(0), "running") for j in "abcd"] + [(j, at(0, 1), None) for j in "abcdx"],
        [("b", at(1), "completed"), ("c", at(1), None), ("a", at(0, 30), None)],
        [("c", at(2, 59), None), ("d", at(2), "failed"), ("d", at(2, 10), "running"), ("z", at(5), None)],
        [("c", at(5), "completed"), ("z", at(5, 10), None)], [("a", at(6), None), ("z", at(6), None)],
        [("z", at(9), None)], [("z", at(9, 1), None)])
    got = drained(S.stream_stale_jobs(src), str(tmp_path / "out"), str(tmp_path)).select("job_id", F.col("last_heartbeat_at").cast("timestamp_ntz").alias("at")).collect()
    # b ended, c ended before its deadline, x and z never said that they run; a was silent twice
    assert sorted((r.job_id, r["at"]) for r in got) == [("a", at(0, 30)), ("a", at(6)), ("d", at(0, 1))]


class _Group:
    """The parts of a group state that the backoff function uses."""

    def __init__(self):
        self.exists, self.get, self.hasTimedOut, self.wait = False, None, False, None

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutDuration(self, ms):
        self.wait = ms


def test_a_missing_pop_is_given_up(spark):
    run, state = S._backoff_or_gap(60_000), _Group()
    pop = lambda o, blocked=False: {"job_id": "j", "ord": o, "fetched_at": pd.Timestamp(DAY) + pd.Timedelta(seconds=o), "blocked": blocked}

    def feed(*rows):
        return [int(o) for pdf in run(("j",), iter([pd.DataFrame(list(rows))] if rows else []), state) for o in pdf["ord"]]
    assert feed(pop(1), pop(3), pop(4), pop(7)) == [1] and state.wait == 60_000
    state.hasTimedOut = True
    assert feed() == [3, 4]
    state.hasTimedOut, state.wait = False, None
    assert feed(pop(2), pop(5)) == [5] and state.wait == 60_000       # 2 came too late; 7 waits for 6
    state.hasTimedOut = True
    assert feed() == [7]


def test_a_failure_between_two_writes_is_replayed(spark, tmp_path, monkeypatch):
    jobs = FX.jobs(spark, SF).where("webhook_url is not null").limit(40)
    item = "struct<url:string,diff:string,relevant:boolean,reason:string,keep:boolean>"
    runs = spark.createDataFrame([(f"m{i}", f"c{i}", DAY, "https://h", "goal" if i % 2 else "", i, [(f"u{k}", "+x\n", True, None, k > 0) for k in range(i)]) for i in range(6)],
                                 f"monitor_id string, check_id string, run_at timestamp_ntz, webhook_url string, goal string, pages_checked int, changes array<{item}>")
    events = jobs.select(F.struct(*jobs.columns).alias("job"), F.lit(None).cast(S.RUN).alias("run")).unionByName(
        runs.select(F.lit(None).cast(jobs.schema.simpleString()).alias("job"), F.struct(*runs.columns).cast(S.RUN).alias("run")))
    events.repartition(3, F.xxhash64("job.id", "run.monitor_id")).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    tables = lambda: {k: sorted(map(str, df.drop("batch_id").collect())) for k, df in S.read_outboxes(spark, out).items()}
    whole, count = M.run_outbox, [0]

    def breaks(df):
        count[0] += 1
        if count[0] == 2:
            raise RuntimeError("lost between two writes")
        return whole(df)
    monkeypatch.setattr(M, "run_outbox", breaks)
    with pytest.raises(Exception):
        S.stream_outboxes(src, out, ckpt)
    first = tables()
    S.stream_outboxes(src, out, ckpt)
    got = tables()
    assert all(set(first[k]) < set(got[k]) or first[k] == got[k] for k in first) and count[0] >= 4
    assert len(got["crawl"]) == len(set(got["crawl"])) == jobs.where("status in ('completed', 'failed')").count()
    assert got["monitor"] == sorted(map(str, whole(runs).collect())) and len(got["monitor"]) == 4
    assert len(got["changes"]) == sum(range(6))


def test_retention_reads_and_drops_days(spark, tmp_path):
    path = str(tmp_path / "log")
    log = FX.scrape_requests(spark, SF)
    SK.write_scrape_log(log, path)
    hi = log.agg(F.max("created_at")).head()[0]
    as_of = str((hi + dt.timedelta(hours=3)).replace(microsecond=0))
    kept = Q.retain_logs(SK.read_dated(spark, path, log.schema), as_of, 5)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "created_date" in plan.split("PartitionFilters:")[1].split("]")[0]
    want = sorted(map(str, Q.retain_logs(log, as_of, 5).collect()))
    assert 0 < len(want) < log.count() and sorted(map(str, kept.select(*log.columns).collect())) == want
    gone = SK.drop_expired(spark, path, as_of, 5)
    assert gone and sorted(map(str, SK.read_dated(spark, path, log.schema).select(*log.columns).collect())) == want
    assert SK.drop_expired(spark, path, as_of, 5) == []


def test_backoff_keeps_the_jobs_of_a_bucket_together(spark, tmp_path):
    """One state row a bucket, whatever the number of jobs; rows as of C8."""
    pops = spark.range(2400).select(
        F.concat(F.lit("j"), (F.col("id") % 600).cast("string")).alias("job_id"), (F.floor(F.col("id") / 600) + 1).cast("long").alias("ord"),
        F.expr("timestamp_ntz'2024-01-30 00:00:00' + make_dt_interval(0, 0, 0, id div 600 * (7 + id % 31))").alias("fetched_at"), (F.col("id") % 7 < 3).alias("blocked"))
    pops = pops.unionByName(pops.where("ord = 4").withColumn("job_id", F.lit(None).cast("string")).withColumn("ord", F.lit(1).cast("long")).limit(1))
    pops.repartition(3, F.xxhash64("job_id", "ord")).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(pops.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(S.stream_backoff(src, wait_minutes=None, buckets=4), str(tmp_path / "out"), str(tmp_path))
    cols = ["job_id", "ord", "skipped", "backoff_until"]
    want = S.C.apply_backoff(pops, None)
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect())) and got.where("skipped").count()
    assert 0 < spark.read.format("statestore").load(str(tmp_path / "ckpt")).count() <= 4


def test_stale_jobs_of_a_bucket_share_a_state(spark, tmp_path):
    at = lambda m: DAY + dt.timedelta(minutes=m)
    src = batches(spark, str(tmp_path / "in"), "job_id string, ts timestamp_ntz, status string",
                  [(f"j{i}", at(i % 5), "failed" if i % 10 == 3 else "running") for i in range(600)] + [(f"j{i}", at(i % 5), None) for i in range(600)] + [(None, at(1), "running"), (None, at(2), None)],
                  [(f"j{i}", at(10), None) for i in range(0, 600, 2)], [("z", at(20), None)], [("z", at(21), None)])
    got = drained(S.stream_stale_jobs(src, buckets=4), str(tmp_path / "out"), str(tmp_path)).select("job_id", F.col("last_heartbeat_at").cast("timestamp_ntz").alias("at")).collect()
    want = [(f"j{i}", at(10 if i % 2 == 0 else i % 5)) for i in range(600) if i % 10 != 3] + [(None, at(2))]
    assert sorted(((r.job_id, r["at"]) for r in got), key=str) == sorted(want, key=str)
    assert 0 < spark.read.format("statestore").option("stateVarName", "jobs").load(str(tmp_path / "ckpt")).count() <= 4


SNAPSHOT = "monitor_id string, url string, http_status int, markdown string, etag string, last_modified string, checked_at timestamp_ntz"


def test_changes_keep_the_pages_of_a_bucket_together(spark, tmp_path):
    """A state value a bucket and few segments of texts, whatever the number
    of pages; null keys, repeated rows and a page without a stored hash."""
    text = lambda i, k: f"page {i}\n" + "the same line\n" * 60 + f"version {k}\n"
    names = [("m", f"u{i}") for i in range(600)] + [(None, "n"), ("m", None), (None, None)]
    state = spark.createDataFrame([(*n, sha(text(i, 0)), text(i, 0), None, None, DAY) for i, n in enumerate(names)] + [("m", "none", None, None, None, None, DAY)],
                                  "monitor_id string, url string, last_content_hash string, last_markdown string, last_etag string, last_modified string, last_checked_at timestamp_ntz")
    rows = lambda k, step: [(*n, 200, text(i, k if i % step == 0 else 0), f"{k}", None, DAY + dt.timedelta(hours=k)) for i, n in enumerate(names)]
    src = batches(spark, str(tmp_path / "in"), SNAPSHOT, rows(0, 1), [*rows(1, 3), *rows(1, 3), ("m", "none", 200, "x", None, None, DAY)], rows(2, 1))
    got = drained(S.stream_changes(src, state, buckets=4), str(tmp_path / "out"), str(tmp_path))
    want = [(*n, sha(text(i, a)), sha(text(i, b)), f"-version {a}\n+version {b}\n", f"{b}")
            for i, n in enumerate(names) for a, b in ([(0, 1), (1, 2)] if i % 3 == 0 else [(0, 2)])]
    assert sorted(map(str, map(tuple, got.select("monitor_id", "url", "prev_hash", "hash", "diff", "etag").collect()))) == sorted(map(str, want))
    stored = spark.read.format("statestore").option("stateVarName", "pages").load(str(tmp_path / "ckpt"))
    assert 0 < stored.count() <= 4


class _Handle:
    """The value and the map that the page states of a bucket use."""

    def __init__(self):
        self.value, self.map = None, {}

    def getValueState(self, *_):
        value = type("Value", (), {})()
        value.get, value.update = lambda: self.value, lambda x: setattr(self, "value", x)
        return value

    def getMapState(self, *_):
        texts = type("Map", (), {})()
        texts.getValue, texts.updateValue, texts.removeKey = self.map.get, self.map.__setitem__, self.map.pop
        return texts


def _fed(changes, hour, ms, *pages, status=200):
    rows = pd.DataFrame([("m", u, status, t, None, None, pd.Timestamp(DAY) + pd.Timedelta(hours=hour)) for u, t in pages], columns=[c.split()[0] for c in SNAPSHOT.split(", ")])
    clock = type("Clock", (), {"getCurrentProcessingTimeInMs": lambda self: ms})()
    return [tuple(r) for pdf in changes.handleInputRows((0,), iter([rows]), clock) for r in pdf[["url", "diff"]].itertuples(index=False)]


def test_texts_of_pages_lie_in_segments(monkeypatch):
    monkeypatch.setattr(S, "SMALL_SEGMENT", 2000)
    monkeypatch.setattr(S, "SEGMENT_BYTES", 4000)
    handle, changes, now = _Handle(), S._Changes(None), {}
    changes.init(handle)
    assert _fed(changes, 0, 0, *((f"u{i}", f"{i}\n" + "x" * 1000) for i in range(20))) == [] and len(handle.map) == 7
    now = {f"u{i}": f"{i}\n" + "x" * 1000 for i in range(20)}
    first = dict(handle.map)
    assert _fed(changes, 1, 0, *now.items()) == []       # nothing new: no text is written again
    assert handle.map == first
    assert _fed(changes, 2, 0, ("u3", None), ("u4", "y"), status=304) == [] and handle.map == first
    for k in range(3, 120):
        u = f"u{k * 7 % 20 if k % 3 else 5}"
        text = f"{now[u]}\n{k}" if k % 5 else f"{k}\n"
        assert _fed(changes, k, 0, (u, text), (u, text)) == [(u, S.render_line_diff(now[u], text))]
        now[u] = text
    pages, segments = changes._load(0)
    assert dict(zip((u for _, u in pages), changes._old_texts(list(pages.values())))) == now
    assert {k for k, in handle.map} == set(segments) and sum(segments.values()) <= 2 * sum(map(len, now.values())) and len(segments) < 20


def test_a_page_not_fetched_for_long_is_forgotten():
    day = 86_400_000
    handle, changes = _Handle(), S._Changes(2 * day)
    changes.init(handle)
    assert _fed(changes, 0, 0, ("a", "1"), ("b", "1")) == []
    assert _fed(changes, 1, day, ("b", "1")) == []
    assert _fed(changes, 2, 2 * day, ("a", "2"), ("b", "2")) == [("b", "-1+2")]
    assert _fed(changes, 3, 4 * day - 1, ("a", "3")) == [("a", "-2+3")]
    assert {u for _, u in changes._load(4 * day)[0]} == {"a"}


def test_a_page_whose_stored_text_is_not_that_of_its_hash():
    handle, changes = _Handle(), S._Changes(None)
    changes.init(handle)
    columns = ["monitor_id", "url", "last_content_hash", "last_markdown", "last_etag", "last_modified", "last_checked_at"]
    clock = type("Clock", (), {"getCurrentProcessingTimeInMs": lambda self: -1})()
    changes.handleInitialState((0,), pd.DataFrame([("m", "a", sha("one"), None, None, None, DAY), ("m", "b", sha("one"), "other", None, None, DAY)], columns=columns), clock)
    assert _fed(changes, 1, 0, ("a", "one"), ("b", "two")) == [("b", "-other+two")]
    assert _fed(changes, 2, 0, ("a", "two")) == [("a", "-one+two")]


def test_a_drained_stream_leaves_no_staged_rows(spark, tmp_path, monkeypatch):
    from webloom.plans import catalog
    from webloom.sources import folders
    made = []
    monkeypatch.setattr(catalog, "fresh_dir", lambda spark, tag: made.append(str(tmp_path / f"{tag}-{len(made)}")) or made[-1])
    assert catalog.q_t2(spark, SF).count()
    staged = [p for p in made if "t2-in" in p]
    assert len(staged) == 1 and folders.names(spark, str(tmp_path)) and not [n for n in folders.names(spark, staged[0]) if n.startswith("part")]
