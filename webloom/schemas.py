"""Declared schemas of the operational tables and of our input boundaries.

Column lists follow the reference's relational schema; surrogate serial
ids become explicit keys (``ord`` for a page's position in its crawl).
Timestamps are ``timestamp_ntz`` (the driver tables are), all in UTC.
"""

from __future__ import annotations

JOBS = ("id string, status string, url string, max_depth int, max_pages int, "
        "include_patterns array<string>, exclude_patterns array<string>, webhook_url string, "
        "engine string, pages_discovered int, pages_scraped int, pages_failed int, "
        "started_at timestamp_ntz, completed_at timestamp_ntz, last_heartbeat_at timestamp_ntz, "
        "error string, created_at timestamp_ntz")

JOB_PAGES = ("job_id string, ord long, url string, status string, engine string, markdown string, "
             "title string, error string, duration_ms int, markdown_length int, "
             "scraped_at timestamp_ntz, created_at timestamp_ntz")

MONITORS = ("id string, url string, max_depth int, max_pages int, include_patterns array<string>, "
            "exclude_patterns array<string>, frequency string, webhook_url string, status string, "
            "goal string, last_checked_at timestamp_ntz, last_job_id string, created_at timestamp_ntz")

MONITOR_PAGES = ("monitor_id string, url string, last_content_hash string, last_markdown string, "
                 "last_etag string, last_modified string, last_checked_at timestamp_ntz")

MONITOR_CHECKS = ("check_id string, monitor_id string, job_id string, pages_checked int, "
                  "pages_changed int, checked_at timestamp_ntz")

MONITOR_CHANGES = "check_id string, monitor_id string, url string, diff string, changed_at timestamp_ntz"

SCRAPE_REQUESTS = ("id long, url string, source string, engine string, status string, duration_ms int, "
                   "markdown_length int, title string, error string, created_at timestamp_ntz")

LOGS = ("id long, job_id string, monitor_id string, level string, message string, context string, "
        "created_at timestamp_ntz")

# Input boundaries: captured network responses, sitemap and robots bodies,
# captured LLM completions.
RESPONSES = ("url string, engine string, http_status int, etag string, last_modified string, "
             "html string, error string, fetched_at timestamp_ntz, duration_ms int")
SITEMAPS = "sitemap_url string, xml string"
ROBOTS = "origin string, body string"
COMPLETIONS = "prompt_hash string, attempt int, text string, error string"

OPS_TABLES = {
    "jobs": JOBS, "job_pages": JOB_PAGES, "monitors": MONITORS, "monitor_pages": MONITOR_PAGES,
    "monitor_checks": MONITOR_CHECKS, "monitor_changes": MONITOR_CHANGES,
    "scrape_requests": SCRAPE_REQUESTS, "logs": LOGS,
}
