"""Extraction on hostile pages, and rules that the fixtures do not reach."""
import pytest

from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.operators import monitor as M

BIG = "x" * 1_000_000


@pytest.mark.parametrize("page, links", [
    ('<a title="see href=foo now" href="/x">t</a><a data-href="no" HREF=\'/y\'>', ["/x", "/y"]),
    ('<svg class="i"/><a href="/after">z</a><svg><a href="/in"></a></svg>', ["/after"]),
    ('<script src="x"/>var<a href="/no"></script><a title="x"href="/adj">', ["/adj"]),
    ("<a href>k</a><a\nhref = \"/n\"\n>", ["/n"]),
    (f'<a {BIG} href="/z">', ["/z"]),
    ("<a " + 'q="1" ' * 170_000 + "href=/w>", ["/w"]),
    ("<a " + '"' * 400_001 + ">", []),
    ("<!--" + BIG, []),
    ("<svg " + BIG, []),
])
def test_links_of_hostile_pages(spark, page, links):
    row = spark.createDataFrame([(page,)], "html string").select(H.page_links("html"), H.page_title("html")).head()
    assert list(row[0]) == links and row[1] == ""


def test_empty_goal_is_no_goal(spark):
    changes = spark.createDataFrame([("m1", "u", "d"), ("m2", "u", "d"), ("m3", "u", "d")], "monitor_id string, url string, diff string")
    monitors = spark.createDataFrame([("m1", ""), ("m2", None), ("m3", "g")], "id string, goal string")
    assert [r.monitor_id for r in M.judge_prompts(changes, monitors).collect()] == ["m3"]
    assert {r.g: r.has for r in monitors.select(F.col("goal").alias("g"), M.has_goal(F.col("goal")).alias("has")).collect()} \
        == {"": False, None: False, "g": True}


def test_deep_nesting_and_large_diffs():
    from webloom.operators.diff import _myers_core
    from webloom.operators.markdown import to_markdown
    assert to_markdown("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert to_markdown("<ol>" + "<li>a</li>" * 3000 + "</ol>").endswith("3000.  a")
    assert to_markdown("a<![weird[x]]>b<p>c") .endswith("c")
    a, b = [f"a{i}" for i in range(20_000)], [f"b{i}" for i in range(20_000)]
    assert _myers_core(a, b) == [("-", t) for t in a] + [("+", t) for t in b]


def test_backoff_stream_waits_for_earlier_pops():
    import pandas as pd

    from webloom.streaming.stream_ops import _backoff_fn

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    def pop(ord_, blocked=False):
        return {"job_id": "j", "ord": ord_, "fetched_at": pd.Timestamp(0) + pd.Timedelta(seconds=11 * ord_), "blocked": blocked}

    state, got = State(), []
    for batch in ([pop(3), pop(1, True)], [pop(4), pop(2)], [pop(2), pop(5)]):
        for out in _backoff_fn(("j",), iter([pd.DataFrame(batch)]), state):
            got += out.values.tolist()
    assert [r[1] for r in got] == [1, 2, 3, 4, 5] and [r[2] for r in got] == [False, True, True, False, False]


def test_named_entities(spark):
    page = "<title>Caf&eacute; &mdash; x &amp;lt; &bogus; &#233;&#xE9; &NotEqualTilde;</title><a href='/a?b=1&amp;c=&copy;'>"
    row = spark.createDataFrame([(page,)], "html string").select(H.page_title("html"), H.page_links("html")).head()
    assert row[0] == "Café — x &lt; &bogus; éé ≂̸" and row[1] == ["/a?b=1&c=©"]


def test_scrape_log_written_and_read_back(spark, tmp_path):
    from webloom.operators import extract as X
    from webloom.operators.sinks import write_scrape_log
    cap = "url string, engine string, http_status int, error string, html string, duration_ms int, fetched_at timestamp_ntz"

    def pages(rows):
        df = spark.createDataFrame(rows, cap.replace("timestamp_ntz", "string"))
        return X.scrape_pages(df.withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz")), keep=("duration_ms", "fetched_at"))

    long = "<p>" + "word " * 60 + "</p>"
    plain = pages([("https://a/1", "fetch", 200, None, "<p>thin</p>", 100, "2024-01-01 23:59:59"),
                   ("https://a/2", "fetch", 200, None, long, 70, "2024-01-02 00:00:01"),
                   ("https://a/3", "fetch", 500, None, None, 30, "2024-01-02 00:00:02")])
    rendered = pages([("https://a/1", "browser", 200, None, long, 900, "2024-01-02 00:00:03"),
                      ("https://a/2", "browser", 200, None, long, 900, "2024-01-02 00:00:04")])
    log = X.scrape_log_rows(X.choose_rendering(plain, rendered, "auto", "scrape"))
    path = str(tmp_path / "log")
    write_scrape_log(log, path)
    got = {r.url: (r.engine, r.status, r.duration_ms, str(r.created_at), str(r.created_date)) for r in spark.read.parquet(path).collect()}
    assert got == {"https://a/1": ("browser", "ok", 1000, "2024-01-02 00:00:03", "2024-01-02"),
                   "https://a/2": ("fetch", "ok", 70, "2024-01-02 00:00:01", "2024-01-02"),
                   "https://a/3": (None, "error", 30, "2024-01-02 00:00:02", "2024-01-02")}
