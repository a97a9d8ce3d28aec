"""Structured Streaming forms of the recurring work: T1-T6.

The reference re-runs crawls on a schedule and keeps state in tables;
here the same work runs on arriving captures:

* T1 ``stream_scrape``        stateless extraction (X7) per micro-batch.
* T2 ``stream_changes``       last content of every (monitor_id, url), kept in buckets of pages, started from M10's table -> M7/M8.
* T3 ``stream_backoff``       backoff deadline per job_id, kept in buckets of jobs -> C8.
* T4 ``stream_scrape_stats``  watermark + sliding 24 h window counts (Q12 form).
* T5 ``stream_stale_jobs``    heartbeats and status changes with event-time timers (C14 form).
* T6 ``stream_outboxes``      foreachBatch writes of both webhook outboxes and the change rows, one commit a batch.

State lives in the state store under the query checkpoint (put it on the
cluster's shared storage). T2, T3 and T5 keep theirs in RocksDB, which holds
large keyed state such as the last markdown of every page on disk.
"""

from __future__ import annotations

import hashlib
import pickle
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import crawl as C
from ..operators import extract as X
from ..operators import monitor as M
from ..operators.diff import render_line_diff
from ..sources import folders

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """Typed state variables need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


SMALL_ROWS = 10_000     # rows of an Arrow batch where they hold no texts
BUCKETS = 1024          # states of jobs that travel together; a parameter of a new query
NONE = np.iinfo(np.int64).min   # no time; also NaT as a number


def _bucket(buckets: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(*(key or ("job_id",))), F.lit(buckets)).cast("int").alias("bucket")


TEXT_CODEC = ("zstd", 3)


def _packed(columns: dict[str, pa.Array], codec: tuple = ("lz4", None)) -> bytes:
    t = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec(codec[0], compression_level=codec[1]))) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", partitions: int | None = None,
                  arrow_rows: int | None = None, lean: bool = False, arrivals: Sequence[Callable[[], None]] = ()) -> None:
    """Drain every available input once into a parquet sink (batch-like
    run). ``partitions`` is the number of state partitions of a new query,
    if not the session's number of shuffle partitions; ``arrow_rows`` the
    rows of an Arrow batch, if not the session's. ``lean``: the shuffle
    files of a batch go with it, and no long history of state is kept.
    ``arrivals`` bring more input, each once all that came before is drained."""
    conf = df.sparkSession.conf
    wanted = {"spark.sql.shuffle.partitions": partitions, "spark.sql.execution.arrow.maxRecordsPerBatch": arrow_rows}
    if lean:
        wanted |= {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.streaming.minBatchesToRetain": 2}
    before = {k: conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, str(v or before[k]))
    try:
        out = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
        if not arrivals:
            out.trigger(availableNow=True).start().awaitTermination()
        else:
            q = out.start()
            try:
                for bring in arrivals:
                    q.processAllAvailable()
                    bring()
                q.processAllAvailable()
            finally:
                q.stop()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


# ------------------------------------------------------------------ T1

def stream_scrape(responses: DataFrame) -> DataFrame:
    """X7 on a streaming DataFrame of captures (stateless)."""
    s = X.scrape_pages(responses)
    return s.select("url", "status", "unchanged", "title", "markdown_length", "thin",
                    F.size("links").alias("n_links"), "error", F.sha2("markdown", 256).alias("markdown_sha256"))


# ------------------------------------------------------------------ T2

CHANGE_SCHEMA = ("monitor_id string, url string, checked_at timestamp_ntz, prev_hash string, hash string, diff string, "
                 "etag string, last_modified string")
PAGE_STATE = "pages binary, segments binary"
PAGE = ("monitor_id", "url", "hash", "etag", "last_modified", "checked_us", "seen_ms", "segment", "row", "bytes", "sure")
PAGE_TYPES = (pa.string(),) * 5 + (pa.int64(),) * 5 + (pa.bool_(),)
SEGMENT_BYTES = 256 << 10   # of texts written together; a longer text has a segment of its own
SMALL_SEGMENT = 128 << 10   # larger ones are not written again while half of them counts


@dataclass(slots=True)
class _Page:
    """What is known of a page. Its text lies at ``row`` of ``segment``, or is
    new in ``text``; ``sure`` if the text is known to have the hash."""
    hash: str
    etag: str | None
    last_modified: str | None
    checked_us: int | None
    seen_ms: int
    segment: int = -1
    row: int = -1
    bytes: int = 0
    sure: bool = True
    text: str | None = None


class _Changes(StatefulProcessor):
    """The last fetched content and validators of the pages of a bucket. One
    value holds all but the texts; these lie in compressed segments, which
    are written once and again only if most of their texts count no more, or
    if they are small beside what is added. So a batch costs a bucket a few
    state calls, and disk only the texts that it brings."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        # both live as long as the page of theirs that was seen last
        self.pages = handle.getValueState("pages", PAGE_STATE, self.ttl_ms)
        self.texts = handle.getMapState("texts", "segment int", "texts binary", self.ttl_ms)

    def _load(self, now_ms: int) -> tuple[dict, dict]:
        """({(monitor_id, url): page}, {segment: bytes of its texts})"""
        got = self.pages.get()
        if got is None:
            return {}, {}
        t, s = map(_unpacked, got)
        pages = {(m, u): _Page(*rest) for m, u, *rest in zip(*(t[c].to_pylist() for c in PAGE))}
        if self.ttl_ms:
            pages = {k: p for k, p in pages.items() if p.seen_ms + self.ttl_ms > now_ms}
        return pages, dict(zip(s["segment"].to_pylist(), s["bytes"].to_pylist()))

    def _old_texts(self, pages: list[_Page]) -> list[str | None]:
        """The texts of pages; each segment is read once."""
        out, stored = [p.text for p in pages], {}
        for i, p in enumerate(pages):
            if p.text is None and p.segment >= 0:
                stored.setdefault(p.segment, []).append(i)
        for no, places in stored.items():
            texts = _unpacked(self.texts.getValue((no,))[0])["text"]
            for i in places:
                out[i] = texts[pages[i].row].as_py()
        return out

    def _save(self, pages: dict, segments: dict) -> None:
        no = max(segments, default=-1) + 1
        counts, fresh = dict.fromkeys(segments, 0), 0
        for p in pages.values():
            if p.text is not None:
                fresh += p.bytes
            elif p.segment >= 0:
                counts[p.segment] += p.bytes
        moved = set()
        for k in sorted(segments, reverse=True):
            if counts[k] * 2 < segments[k] or segments[k] <= min(fresh, SMALL_SEGMENT):
                moved.add(k)
                fresh += counts[k]
        again = [p for p in pages.values() if p.text is None and p.segment in moved]
        for p, text in zip(again, self._old_texts(again)):
            p.text = text
        for k in moved:
            self.texts.removeKey((k,))
            del segments[k]
        rest, size = [], 0
        for p in [*(p for p in pages.values() if p.text is not None), None]:
            if rest and (p is None or size + p.bytes > SEGMENT_BYTES):
                self.texts.updateValue((no,), (_packed({"text": pa.array(rest, pa.string())}, TEXT_CODEC),))
                segments[no] = size
                no, rest, size = no + 1, [], 0
            if p is not None:
                p.segment, p.row = no, len(rest)
                rest.append(p.text)
                size += p.bytes
                p.text = None
        rows = zip(*((*k, *(getattr(p, c) for c in PAGE[2:])) for k, p in pages.items())) if pages else [[]] * len(PAGE)
        index = {c: pa.array(v, t) for c, t, v in zip(PAGE, PAGE_TYPES, rows)}
        self.pages.update((_packed(index, TEXT_CODEC), _packed({"segment": pa.array(list(segments), pa.int64()), "bytes": pa.array(list(segments.values()), pa.int64())})))

    def handleInitialState(self, key, rows, timerValues) -> None:
        now_ms = timerValues.getCurrentProcessingTimeInMs()
        pages, segments = self._load(now_ms)
        last = {(_text(r.monitor_id), _text(r.url)): r for r in rows.sort_values("last_checked_at", kind="stable").itertuples(index=False)}
        for name, r in last.items():
            if isinstance(r.last_content_hash, str):
                text = _text(r.last_markdown)
                pages[name] = page = _Page(r.last_content_hash, _text(r.last_etag), _text(r.last_modified), _micros(r.last_checked_at), now_ms, text=text)
                blob = (text or "").encode("utf-8")
                page.bytes, page.sure = len(blob), text is not None and hashlib.sha256(blob).hexdigest() == page.hash
        self._save(pages, segments)

    def handleInputRows(self, key, rows, timerValues):
        now_ms = timerValues.getCurrentProcessingTimeInMs()
        pages, segments = self._load(now_ms)
        found, was, fetched = [], [], False
        new_rows = pd.concat(list(rows), ignore_index=True).sort_values("checked_at", kind="stable")
        for r in new_rows.itertuples(index=False):
            name, at = (_text(r.monitor_id), _text(r.url)), _micros(r.checked_at)
            old = pages.get(name)
            if old is not None and old.checked_us is not None and at <= old.checked_us:
                continue  # replay or older than the stored state: ignored
            if r.http_status != 200 or not isinstance(r.markdown, str):
                continue  # 304 / failures leave the state alone
            blob = r.markdown.encode("utf-8")
            h = hashlib.sha256(blob).hexdigest()
            new = _Page(h, _text(r.etag), _text(r.last_modified), at, now_ms, bytes=len(blob), text=r.markdown)
            if old is not None and old.hash != h:
                found.append((*name, r.checked_at, old.hash, h, r.markdown, new.etag, new.last_modified))
                was.append(old)
            elif old is not None and old.sure and not self.ttl_ms:      # the text is there already
                new.segment, new.row, new.text = old.segment, old.row, old.text
            pages[name], fetched = new, True
        if found:
            out = [(*f[:5], render_line_diff(old or "", f[5]), *f[6:]) for f, old in zip(found, self._old_texts(was))]
        if fetched:
            self._save(pages, segments)
        if found:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in CHANGE_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def _text(x) -> str | None:
    return x if isinstance(x, str) else None


def _micros(x) -> int | None:
    return None if pd.isna(x) else int(pd.Timestamp(x).value // 1000)


def stream_changes(snapshots: DataFrame, state: DataFrame | None = None, ttl_days: int | None = None,
                   buckets: int = BUCKETS) -> DataFrame:
    """For every fetched 200 of a page whose content differs from the
    stored one, a change row with the line diff and the new validators.

    ``snapshots``: (monitor_id, url, http_status, markdown, etag,
    last_modified, checked_at). ``state``: the monitor_pages table (M10) that
    a new query starts from. With ``ttl_days`` a page that is not fetched for
    so long (processing time) is forgotten, and its next sight is a first.
    The states of the pages of a bucket travel together."""
    use_rocksdb(snapshots.sparkSession)
    bucket = _bucket(buckets, "monitor_id", "url")
    src = snapshots.select(bucket, "monitor_id", "url", "http_status", "markdown", "etag", "last_modified", "checked_at")
    first = None if state is None else state.select(
        bucket, "monitor_id", "url", "last_content_hash", "last_markdown", "last_etag", "last_modified", "last_checked_at").groupBy("bucket")
    ttl = ttl_days * 86_400_000 if ttl_days else None
    return src.groupBy("bucket").transformWithStateInPandas(
        _Changes(ttl), CHANGE_SCHEMA, "Append", "ProcessingTime" if ttl else "None", initialState=first)


# ------------------------------------------------------------------ T3

BACKOFF_OUT = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("ord", T.LongType()),
    T.StructField("skipped", T.BooleanType()), T.StructField("backoff_until", T.TimestampNTZType())])
BACKOFF_STATE = T.StructType([T.StructField("jobs", T.BinaryType())])


def _fold(name: str | None, job: list, out: list) -> None:
    """Handles the pops of a job up to the first that is missing."""
    until, nxt, _, held = job
    while nxt in held:
        at, blocked = held.pop(nxt)
        skipped = until is not None and at is not None and at < until
        if not skipped and blocked:
            since = until if until is not None else at
            until = None if since is None else since + C.BACKOFF_STEP_SECONDS * 1_000_000
        out.append((name, nxt, skipped, until))
        nxt += 1
    job[:2] = until, nxt


def _backoff_or_gap(wait_ms: int | None):
    """The state of a bucket: job_id -> [until, next_ord, give_up, {ord: (at,
    blocked)}], times in whole microseconds and give_up in milliseconds. A
    timeout comes when the first of its jobs is due to give up a pop."""
    def run(key, pdfs, state: GroupState):
        jobs = pickle.loads(state.get[0]) if state.exists else {}
        now = time.time_ns() // 1_000_000
        if wait_ms and state.hasTimedOut:
            now = max(now, min((j[2] for j in jobs.values() if j[2] is not None), default=now))
        touched, out = {}, []
        for pdf in pdfs:
            ats = pdf["fetched_at"].to_numpy("datetime64[us]")
            for name, o, at, blocked in zip(pdf["job_id"].tolist(), pdf["ord"].tolist(), ats.astype("int64").tolist(), pdf["blocked"].tolist()):
                name = _text(name)
                job = touched.get(name)
                if job is None:
                    job = touched[name] = jobs.setdefault(name, [None, 1, None, {}])
                if o >= job[1]:       # a smaller one was handled before: a repeat
                    # pops that came before an earlier one wait in the state, at most a job's page budget
                    job[3][int(o)] = (None if at == NONE else at, blocked is True)
        for name, job in touched.items():
            _fold(name, job, out)
            job[2] = now + wait_ms if wait_ms and job[3] else None
        due = [n for n, j in jobs.items() if j[2] is not None and j[2] <= now] if wait_ms else []
        for name in due:              # the missing pop is given up: go on with the first that waits
            job = jobs[name]
            job[1] = min(job[3])
            _fold(name, job, out)
            job[2] = now + wait_ms if job[3] else None
        state.update((pickle.dumps(jobs, 5),))
        first = min((j[2] for j in jobs.values() if j[2] is not None), default=None) if wait_ms else None
        if first is not None:
            state.setTimeoutDuration(max(first - now, 1))
        if out:
            got = pd.DataFrame(out, columns=BACKOFF_OUT.fieldNames())
            got["backoff_until"] = pd.to_datetime(got["backoff_until"].astype("Int64"), unit="us")
            yield got
    return run


_backoff_fn = _backoff_or_gap(None)     # waits for a missing pop without end


def stream_backoff(pops: DataFrame, wait_minutes: int | None = 10, buckets: int = BUCKETS) -> DataFrame:
    """C8 as keyed state per job over (job_id, ord, fetched_at, blocked).
    A job's pops are numbered from 1 and may arrive in any order: each is
    handled once all earlier ones are, or once nothing new of its job came
    for ``wait_minutes`` (processing time); a pop that comes later than that
    has no row. Without ``wait_minutes`` a missing pop is waited for until
    the stream ends, as a drained one must (processing-time timers keep an
    ``availableNow`` query running). The states of the jobs of a bucket
    travel together."""
    use_rocksdb(pops.sparkSession)
    timeout = GroupStateTimeout.NoTimeout if wait_minutes is None else GroupStateTimeout.ProcessingTimeTimeout
    return pops.select(_bucket(buckets), "job_id", "ord", "fetched_at", "blocked").groupBy("bucket").applyInPandasWithState(
        _backoff_fn if wait_minutes is None else _backoff_or_gap(wait_minutes * 60_000), BACKOFF_OUT, BACKOFF_STATE, "append", timeout)


# ------------------------------------------------------------------ T4

def stream_scrape_stats(log: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """T4: per sliding 24 h window (1 h slide): total, ok, avg ok duration
    and success rate; late rows beyond the watermark are dropped."""
    # event time must be TIMESTAMP; the session time zone is UTC, so the
    # NTZ values keep their wall-clock meaning
    log = log.withColumn("created_at", F.col("created_at").cast("timestamp"))
    w = log.withWatermark("created_at", watermark).groupBy(
        F.window("created_at", "24 hours", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.avg(F.when(F.col("status") == "ok", F.col("duration_ms"))).alias("avg_ok_ms"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    F.col("total").cast("long"), F.col("ok").cast("long"),
                    F.floor(F.col("avg_ok_ms") + 0.5).cast("long").alias("avg_ms"),
                    F.when(F.col("total") > 0, F.floor(F.col("ok") * 100.0 / F.col("total") + 0.5))
                     .otherwise(F.lit(100)).cast("long").alias("success_rate"))


# ------------------------------------------------------------------ T5

STALE_OUT = T.StructType([T.StructField("job_id", T.StringType()),
                          T.StructField("last_heartbeat_at", T.TimestampType())])
STALE_MS = 120_000


class _Stale(StatefulProcessor):
    """Status and last heartbeat of every job of a bucket. Each job's timer
    is its heartbeat's end; the bucket has one, at the first of them."""

    def init(self, handle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", "jobs binary")

    def _load(self):
        """(job ids, heartbeats, statuses, their times, whether a timer is set)"""
        if not self.jobs.exists():
            return np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, bool)
        t = _unpacked(self.jobs.get()[0])
        return tuple(t[c].to_numpy() for c in ("job_id", "beat", "status", "since", "timer"))

    def _save(self, ids, beat, status, since, timer) -> None:
        self.jobs.update((_packed({"job_id": pa.array(ids, pa.string()), "beat": pa.array(beat), "status": pa.array(status, pa.string()),
                                   "since": pa.array(since), "timer": pa.array(timer)}),))

    def _expire(self, told, watermark, ids, beat, status, since, timer) -> pd.DataFrame:
        """Ends the timers that event time has passed; the rows of the jobs
        that ran, after those of ``told``, which are stale already."""
        ended = timer & (_deadline(beat) <= watermark)
        timer[ended] = False
        stale = told | (ended & (status == "running"))
        out = pd.DataFrame({"job_id": ids[stale], "last_heartbeat_at": beat[stale].astype("datetime64[us]")})
        beat[stale] = NONE
        if timer.any():
            self.handle.registerTimer(int(_deadline(beat)[timer].min()))
        self._save(ids, beat, status, since, timer)
        return out

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True)
        ids, *old = self._load()
        if old[3].any():
            self.handle.deleteTimer(int(_deadline(old[0])[old[3]].min()))
        at, names = pd.factorize(np.concatenate([ids, new["job_id"].to_numpy(object)]), use_na_sentinel=False)
        at, ids = at[len(ids):], np.array([_text(n) for n in names], object)
        beat, status, since, timer = (np.concatenate([o, np.full(len(ids) - len(o), e, o.dtype)]) for o, e in zip(old, (NONE, None, NONE, False)))
        us = new["ts"].to_numpy("datetime64[us]").astype(np.int64)
        said = new["status"].notna().to_numpy()
        np.maximum.at(beat, at[~said], us[~said])
        # the latest status counts, of equal times the one that came last
        told = np.flatnonzero(said & (us != NONE))
        told = told[np.lexsort((told, us[told], at[told]))]
        told = told[np.append(at[told][1:] != at[told][:-1], True)] if len(told) else told
        told = told[us[told] >= since[at[told]]]
        status[at[told]], since[at[told]] = new["status"].to_numpy(object)[told], us[told]
        touched = np.zeros(len(ids), bool)
        touched[at] = True
        touched &= beat != NONE
        watermark = timerValues.getCurrentWatermarkInMs()
        stale = touched & (status == "running") & (_deadline(beat) <= watermark)      # older than event time allows
        timer = (timer | touched) & ~stale
        yield self._expire(stale, watermark, ids, beat, status, since, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ids, *state = (x.copy() for x in self._load())
        yield self._expire(np.zeros(len(ids), bool), timerValues.getCurrentWatermarkInMs(), ids, *state)

    def close(self) -> None:
        pass


def _deadline(beat: np.ndarray) -> np.ndarray:
    return beat // 1000 + STALE_MS


def stream_stale_jobs(events: DataFrame, watermark: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """T5: a running job is reported stale once event time passes its last
    heartbeat + 2 minutes without a newer one, once per silence.

    ``events``: (job_id, ts, status); a row with a status is a status
    change, one without is a heartbeat. A job counts as running from a
    ``running`` row until its next status change; a job that ended between
    heartbeats is not reported. The states of the jobs of a bucket travel
    together."""
    use_rocksdb(events.sparkSession)
    ev = events.select(_bucket(buckets), "job_id", F.col("ts").cast("timestamp").alias("ts"), "status").withWatermark("ts", watermark)
    return ev.groupBy("bucket").transformWithStateInPandas(_Stale(), STALE_OUT, "Append", "EventTime")


# ------------------------------------------------------------------ T6

def stream_outbox(finished_jobs: DataFrame, out_dir: str, checkpoint: str) -> None:
    """K3 payloads per micro-batch; each batch overwrites its own
    ``batch_id=N`` folder, so a replayed batch rewrites the same rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        C.crawl_outbox(batch).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    q = (finished_jobs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


RUN = ("struct<monitor_id:string,check_id:string,run_at:timestamp_ntz,webhook_url:string,goal:string,pages_checked:int,"
       "changes:array<struct<url:string,diff:string,relevant:boolean,reason:string,keep:boolean>>>")


def _write_outboxes(batch: DataFrame, batch_id: int, out_dir: str) -> None:
    """The three tables of one batch, then the commit that makes them visible."""
    part = f"batch_id={batch_id}"
    jobs = batch.where("job is not null").select("job.*")
    runs = batch.where("run is not null").select("run.*")
    C.crawl_outbox(jobs).write.mode("overwrite").parquet(f"{out_dir}/crawl/{part}")
    M.run_outbox(runs).write.mode("overwrite").parquet(f"{out_dir}/monitor/{part}")
    M.run_changes(runs).write.mode("overwrite").parquet(f"{out_dir}/changes/{part}")
    folders.put_json(batch.sparkSession, f"{out_dir}/commits/{batch_id:010d}.json", {"batch_id": batch_id})


def stream_outboxes(events: DataFrame, out_dir: str, checkpoint: str) -> None:
    """Finished crawl jobs (column ``job``, K3) and finished monitor runs
    (column ``run``, ``RUN``, K4) -> both outboxes and the change rows.

    A batch writes its own folders anew, so one that broke off between two
    tables is replayed into the same rows, and ``read_outboxes`` shows only
    batches that are complete: no payload is lost, none is doubled."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if batch_id not in _committed(batch.sparkSession, out_dir):
                _write_outboxes(batch, batch_id, out_dir)
        finally:
            batch.unpersist()

    q = (events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def _committed(spark, out_dir: str) -> set[int]:
    return {int(n[:-5]) for n in folders.names(spark, f"{out_dir}/commits") if n.endswith(".json")}


def read_outboxes(spark, out_dir: str) -> dict[str, DataFrame]:
    """``crawl``, ``monitor`` and ``changes`` rows of all complete batches."""
    done = sorted(_committed(spark, out_dir))
    return {k: spark.read.option("basePath", f"{out_dir}/{k}").parquet(*[f"{out_dir}/{k}/batch_id={b}" for b in done])
            for k in ("crawl", "monitor", "changes")} if done else {}
