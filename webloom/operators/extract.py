"""Page extraction over captured responses: S2, X3, X5, X6, X7, K2.

Plan shape: scan (url, status, html, ...) -> native classification,
title and links (JVM) -> one Arrow-batched pandas UDF for the markdown
tree walk (the only Python step) -> narrow projection. No shuffle: every
page is independent, so a 100 TB corpus is processed as many file splits
in parallel; ``spark.sql.execution.arrow.maxRecordsPerBatch`` bounds the
pages a Python worker holds at once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.html import is_thin, page_links, page_title, strip_nodes
from ..functions.text import utf16_length
from ..functions.urls import url_host
from .markdown import to_markdown

TIMEOUT_MESSAGE = "Request timed out"


def classify_response(http_status="http_status", error="error") -> tuple:
    """(status, unchanged, error) columns of a captured fetch.

    timeout/abort transport error -> 'timeout'; other transport error ->
    'error' with its message; 304 -> scraped + unchanged; 404 ->
    not_found; 403/429 -> blocked; other non-2xx -> error 'HTTP n'."""
    s, e = F.col(http_status), F.col(error)
    transport = e.isNotNull()
    timeout = transport & (e.contains("TimeoutError") | e.contains("abort"))
    ok2xx = (s >= 200) & (s < 300)
    status = (F.when(timeout, "timeout").when(transport, "error")
              .when(s == 304, "scraped").when(s == 404, "not_found")
              .when(s.isin(403, 429), "blocked").when(~ok2xx | s.isNull(), "error")
              .otherwise("scraped"))
    err = (F.when(timeout, F.lit(TIMEOUT_MESSAGE)).when(transport, e)
           .when(s == 304, F.lit(None).cast("string"))
           .when(~ok2xx | s.isNull(), F.concat(F.lit("HTTP "), s.cast("string"))))
    return status, F.coalesce(~transport & (s == 304), F.lit(False)), err


@pandas_udf(StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    """Body HTML -> markdown, one Arrow batch at a time."""
    return html.map(lambda h: to_markdown(h) if isinstance(h, str) else None)


def scrape_pages(responses: DataFrame, keep: tuple = (), with_markdown: bool = True) -> DataFrame:
    """Captured responses -> (url, engine, status, unchanged, title,
    markdown, markdown_length, links, error, thin).

    Title and links are native (X2, X4); only the markdown tree walk runs
    in Python, and only for scraped, non-304 rows. ``with_markdown=False``
    skips it (markdown, markdown_length and thin are then null) for
    callers that only route on status and links, such as crawl rounds.
    """
    status, unchanged, err = classify_response()
    base = responses.select(
        "url", "engine", *keep, status.alias("status"), unchanged.alias("unchanged"), err.alias("error"),
        F.col("error").alias("transport_error"), F.col("http_status"),
        strip_nodes("html").alias("_doc"), *(["html"] if with_markdown else []))
    live = (F.col("status") == "scraped") & ~F.col("unchanged")
    md = F.when(live, html_to_markdown(F.col("html"))) if with_markdown else F.lit(None).cast("string")
    out = base.select(
        "url", "engine", *keep, "status", "unchanged", "error", "transport_error", "http_status",
        F.when(live, page_title("_doc", stripped=True)).alias("title"),
        md.alias("markdown"),
        F.when(live, page_links("_doc", stripped=True)).alias("links"))
    return out.withColumn("markdown_length", F.when(live, utf16_length("markdown"))) \
              .withColumn("thin", F.when(live, is_thin("markdown")))


HOST_BUCKETS = 512


def host_bucket(host) -> Column:
    """Bucket of a host in a staged capture store."""
    return F.pmod(F.xxhash64(host), F.lit(HOST_BUCKETS)).cast("int")


def captures_of(captures: DataFrame, urls: DataFrame) -> DataFrame:
    """Captures of the given URLs; in a store of host buckets only those
    buckets are read (partition pruning by the join)."""
    if "bucket" in captures.columns:
        keyed = urls.select("url", host_bucket(url_host("url")).alias("bucket"))
        return captures.join(keyed, ["bucket", "url"], "left_semi")
    return captures.join(urls, "url", "left_semi")


def attach_markdown(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """Markdown for already classified page rows: each distinct scraped
    URL is converted once (late materialisation of the only Python step)."""
    live = (F.col("status") == "scraped") & ~F.coalesce(F.col("unchanged"), F.lit(False))
    urls = pages.where(live).select("url").distinct()
    md = captures_of(responses, urls).select(
        "url", html_to_markdown(F.col("html")).alias("_md")).dropDuplicates(["url"])
    out = pages.join(md, "url", "left")
    return out.withColumn("markdown", F.when(live, F.col("_md"))) \
              .withColumn("markdown_length", F.when(live, utf16_length("markdown"))).drop("_md")


def choose_rendering(plain: DataFrame, rendered: DataFrame, engine: str = "auto",
                     flavour: str = "crawl") -> DataFrame:
    """Pick the plain or the rendered extraction per URL.

    ``browser``: rendered only (no/failed rendering -> error).
    ``fetch``: plain only.
    ``auto``: plain, replaced by the rendering when the plain result is thin
    (``flavour='scrape'``) or thin, blocked or a 304 (``flavour='crawl'``) and a
    successful rendering exists; a failed rendering keeps the plain result.
    Both inputs are outputs of ``scrape_pages``; the join is on url. If both
    keep ``duration_ms`` and ``fetched_at``, the result has the time that all
    requested captures took and the time of the chosen one.
    """
    timed = all(c in df.columns for df in (plain, rendered) for c in ("duration_ms", "fetched_at"))
    times = ["duration_ms", "fetched_at"] if timed else []
    cols = ["status", "unchanged", "title", "markdown", "markdown_length", "links", "error", "thin",
            "transport_error", "http_status"]
    r = rendered.select("url", *[F.col(c).alias("r_" + c) for c in cols + times])
    if engine == "browser":
        j = plain.select("url").join(r, "url", "left")
        ok = F.col("r_status") == "scraped"
        return j.select(
            "url", F.when(ok, "browser").alias("engine"),
            F.when(ok, "scraped").otherwise("error").alias("status"), F.lit(False).alias("unchanged"),
            *[F.when(ok, F.col("r_" + c)).alias(c) for c in ("title", "markdown", "markdown_length", "links")],
            F.when(ok, F.lit(None).cast("string"))
             .otherwise(F.coalesce(F.col("r_error"), F.lit("no rendering captured"))).alias("error"),
            F.when(ok, F.col("r_thin")).alias("thin"),
            F.col("r_transport_error").alias("transport_error"), F.col("r_http_status").alias("http_status"),
            *[F.col("r_" + c).alias(c) for c in times])
    if engine == "fetch":
        return plain.select("url", F.lit("fetch").alias("engine"), *cols, *times)
    j = plain.select("url", *cols, *times).join(r, "url", "left")
    want = F.coalesce(F.col("thin"), F.lit(False)) & (F.col("status") == "scraped") & ~F.col("unchanged")
    if flavour == "crawl":      # a 304 has no content, so it counts as thin
        want = want | (F.col("status") == "blocked") | F.coalesce(F.col("unchanged"), F.lit(False))
    use = want & (F.col("r_status") == "scraped")
    return j.select("url", F.when(use, "browser").otherwise("fetch").alias("engine"),
                    *[F.when(use, F.col("r_" + c)).otherwise(F.col(c)).alias(c) for c in cols],
                    *([(F.col("duration_ms") + F.when(want, F.coalesce("r_duration_ms", F.lit(0))).otherwise(0)).alias("duration_ms"),
                       F.when(use, F.col("r_fetched_at")).otherwise(F.col("fetched_at")).alias("fetched_at")] if timed else []))


def scrape_log_rows(results: DataFrame, requested_engine: str = "auto", source: str = "scrape",
                    id_col: str | None = None) -> DataFrame:
    """K2: one scrape_requests row per request, ok or error.

    A single-page scrape fails on any non-2xx (incl. 304, no conditional
    request is sent) or transport error; a failed ``auto`` request logs
    engine NULL, a failed fetch/browser request logs the requested engine.
    Error texts: ``<url> returned HTTP <n>`` for a status, ``Failed to fetch
    <url>: <message>`` for a transport error, ``Browser scrape failed for
    <url>: <message>`` for a browser-only request whose rendering failed.
    ``duration_ms`` and ``created_at`` come from results that keep
    ``duration_ms`` and ``fetched_at``, else they are null.
    """
    had = set(results.columns)
    ok = (F.col("status") == "scraped") & ~F.col("unchanged")
    failed_engine = F.lit(None).cast("string") if requested_engine == "auto" else F.lit(requested_engine)
    if requested_engine == "browser":
        msg = F.concat(F.lit("Browser scrape failed for "), F.col("url"), F.lit(": "),
                       F.coalesce(F.col("transport_error"), F.col("error"),
                                  F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))))
    else:
        msg = F.when(F.col("transport_error").isNotNull(),
                     F.concat(F.lit("Failed to fetch "), F.col("url"), F.lit(": "), F.col("transport_error"))) \
               .otherwise(F.concat(F.col("url"), F.lit(" returned HTTP "), F.col("http_status").cast("string")))
    return results.select(
        *([id_col] if id_col else []), "url", F.lit(source).alias("source"),
        F.when(ok, F.col("engine")).otherwise(failed_engine).alias("engine"),
        F.when(ok, "ok").otherwise("error").alias("status"),
        (F.col("duration_ms") if "duration_ms" in had else F.lit(None)).cast("int").alias("duration_ms"),
        F.when(ok, F.col("markdown_length")).alias("markdown_length"),
        F.when(ok, F.col("title")).alias("title"),
        F.when(ok, F.lit(None).cast("string")).otherwise(msg).alias("error"),
        (F.col("fetched_at") if "fetched_at" in had else F.lit(None)).cast("timestamp_ntz").alias("created_at"))
