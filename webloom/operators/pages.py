"""Native page-level operators over a (url, html) corpus: X1, X2, X4, X5, U1 on links.

All of these are projections (narrow, no shuffle). The raw HTML column is
dropped as soon as the derived columns exist, so nothing downstream of
this projection carries page bodies through a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import page_links, page_title, strip_nodes
from ..functions.urls import canonical_parts, normalize_url


def page_facts(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, url, canonical, host, title, links) - one pass over the HTML."""
    doc = pages.select(id_col, "url", strip_nodes("html").alias("_doc"))
    out = doc.select(
        id_col, "url",
        normalize_url("url", "url").alias("canonical"),
        page_title("_doc", stripped=True).alias("title"),
        page_links("_doc", stripped=True).alias("links"),
    )
    return out.withColumn("host", canonical_parts("canonical")["host"])


def page_links_exploded(pages: DataFrame, id_col: str = "page_id", keep: list[str] | None = None) -> DataFrame:
    """X4 + U1: one row per a[href] with its position and canonical target,
    and the columns of ``keep`` (``url``)."""
    doc = pages.select(id_col, "url", page_links(strip_nodes("html"), stripped=True).alias("links"))
    ex = doc.select(id_col, "url", F.posexplode("links").alias("pos", "href"))
    return ex.select(id_col, *(keep or []), "pos", "href", normalize_url("href", "url").alias("link_url"))


def host_summary(pages: DataFrame) -> DataFrame:
    """Flagship: per host - pages, titled pages, links, distinct canonical
    link targets, distinct canonical page URLs - ordered by pages.

    One scan and one projection over the HTML. Every page gives one row for
    itself, one for its canonical URL and one per link; rows are first
    aggregated by (host, kind, value), so a host holding a third of all
    pages still spreads over many tasks, and then by host.
    """
    f = page_facts(pages)
    page, canonical, link = 0, 1, 2
    none = F.lit(False)

    def item(kind, value, titled):
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), titled.alias("titled"))

    items = F.concat(
        F.array(item(page, F.col("page_id").cast("string"), F.coalesce(F.col("title") != "", none)),
                item(canonical, F.col("canonical"), none)),
        F.transform("links", lambda x: item(link, x, none)))
    ex = f.select("host", "url", F.explode(items).alias("i")).select(
        "host", "i.kind", "i.titled",
        F.when(F.col("i.kind") == link, normalize_url("i.value", "url")).otherwise(F.col("i.value")).alias("value"))
    first = ex.where(F.col("value").isNotNull()).groupBy("host", "kind", "value").agg(
        F.count("*").alias("n"), F.max("titled").alias("titled"))
    kind = F.col("kind")
    agg = first.groupBy("host").agg(
        F.count_if(kind == page).alias("n_pages"),
        F.count_if((kind == page) & F.col("titled")).alias("n_titled"),
        F.sum(F.when(kind == link, F.col("n")).otherwise(0)).alias("n_links"),
        F.count_if(kind == link).alias("n_distinct_links"),
        F.count_if(kind == canonical).alias("n_canonical"))
    return agg.select(
        "host", *(F.col(c).cast("long").alias(c)
                  for c in ("n_pages", "n_titled", "n_links", "n_distinct_links", "n_canonical"))
    ).orderBy(F.desc("n_pages"), "host")
