"""Links of list pages, where paging ends, and the URLs not seen before."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeloom.functions import html as H
from gazeloom.functions import text as X

MAX_PAGES = 31


def list_page_urls(seeds: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """list_url, page and page_url of each seed: the first page is the seed; list.htm and list<n>.htm count on; any other URL stays."""
    later = F.regexp_replace("list_url", r"list(\d*)\.htm$", F.concat(F.lit("list"), F.col("page").cast("string"), F.lit(".htm")))
    return seeds.select("list_url", F.explode(F.sequence(F.lit(1), F.lit(max_pages))).alias("page")).withColumn("page_url", F.when(F.col("page") == 1, F.col("list_url")).otherwise(later))


def host_of(c):
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


@F.pandas_udf(T.StringType())
def _decoded(c: pd.Series) -> pd.Series:
    """With HTML entities decoded; Spark has no function for it."""
    import html

    return c.map(lambda x: None if x is None else html.unescape(x))


def extract_links(pages: DataFrame, html: str = "html", list_url: str = "list_url") -> DataFrame:
    """All columns but the HTML, and url: each href, in quotes of either kind, as an absolute URL with its entities decoded. Script links and relative ones without a leading slash go."""
    found = pages.withColumn("href", F.explode(F.regexp_extract_all(html, F.lit("""(?i)\\bhref\\s*=\\s*("[^"]*"|'[^']*')"""), F.lit(1)))).drop(html)
    found = found.withColumn("href", F.substring("href", F.lit(2), F.length("href") - 2))
    found = found.withColumn("href", F.when(F.contains("href", F.lit("&")), _decoded(F.col("href"))).otherwise(F.col("href")))
    href = X.strip(F.col("href"))
    url = F.when(F.lower(href).startswith("javascript:") | (href == ""), None).when(href.rlike("^https?://"), href).when(href.startswith("/"), F.concat(F.lit("https://"), host_of(F.col(list_url)), href))
    return found.withColumn("url", url).where("url is not null").drop("href")


def filter_links(links: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Links in which an include pattern is found (any link if there is none) and no exclude pattern."""
    for pattern in exclude or ():
        links = links.where(~F.col("url").rlike(pattern))
    keep = None
    for pattern in include or ():
        keep = F.col("url").rlike(pattern) if keep is None else keep | F.col("url").rlike(pattern)
    return links if keep is None else links.where(keep)


def pagination_cut(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (list_url, url) of the pages before paging ends.

    pages: list_url, page, success. links: list_url, page, url. A list ends at its first failed page, or at its first page after page 1
    that brings no link that earlier pages lack (first appearances are those over all pages; a page that ends the list adds none).
    """
    first = links.groupBy("list_url", "url").agg(F.min("page").alias("page"))
    new = first.groupBy("list_url", "page").agg(F.count(F.lit(1)).alias("new"))
    ends = pages.join(new, ["list_url", "page"], "left").where(~F.col("success") | ((F.col("page") > 1) & F.col("new").isNull()))
    stop = ends.groupBy("list_url").agg(F.min("page").alias("stop"))
    return first.join(stop, "list_url", "left").where(F.col("stop").isNull() | (F.col("page") < F.col("stop"))).select("list_url", "url", "page")


def incremental_urls(discovered: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(list_url, url) not seen before, and the new seen set."""
    found = discovered.select("list_url", "url").distinct()
    return found.join(seen.select("list_url", "url"), ["list_url", "url"], "left_anti"), found.union(seen.select("list_url", "url")).distinct()


def page_metadata(pages: DataFrame, html: str = "html", title: tuple[str, ...] = H.TITLE_SELECTORS, date: tuple[str, ...] = H.DATE_SELECTORS, author: tuple[str, ...] = H.AUTHOR_SELECTORS) -> DataFrame:
    """Adds title, date and author, each by the first of its selectors that finds text: a tag, .class, or [class*=part]."""
    return pages.withColumn("_m", H.page_metadata(html, title, date, author)).select("*", "_m.title", "_m.date", "_m.author").drop("_m")


def crawl_report(results: DataFrame) -> DataFrame:
    """Per list_url: articles, successes, failures, and the source (its host where none is given)."""
    ok = F.coalesce("success", F.lit(False))
    source = F.coalesce(F.nullif(F.max("source"), F.lit("")), host_of(F.col("list_url")))
    return results.groupBy("list_url").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), source.alias("source"))
