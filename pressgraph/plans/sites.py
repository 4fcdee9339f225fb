"""Site build: front pages to categories, feeds and new article candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgraph.functions import urls as U
from pressgraph.operators import crawl as C
from pressgraph.operators import meta as M
from pressgraph.options import JobOptions


@dataclass(frozen=True)
class SiteBuild:
    categories: DataFrame
    feeds: DataFrame
    articles: DataFrame
    memo: DataFrame
    summary: DataFrame


def build_sites(fronts: DataFrame, fetched: DataFrame, feed_texts: DataFrame,
                seen: DataFrame, options: JobOptions = JobOptions()) -> SiteBuild:
    """Discover the articles of many sites at once.

    ``fronts(page_id, source_url, url, html)`` are the site front pages,
    ``fetched(url, html)`` the stored pages, ``feed_texts(url, rss)`` the
    stored feeds, ``seen(domain, url)`` the memo of earlier runs.
    """
    categories = C.category_urls(fronts)
    # A front page is its own root category, whatever is stored for it.
    stored = fetched.select("url", "html").unionByName(fronts.select("url", "html"))
    pages = C.with_content(categories.join(stored.dropDuplicates(["url"]), "url"))
    feeds = C.feed_urls(pages, options.max_feeds)
    texts = feeds.join(feed_texts, "url").select("source_url", "rss")
    found = C.merge_candidates(C.feed_candidates(texts), C.category_candidates(pages), options.max_candidates)
    keyed = found.withColumn("domain", U.netloc("source_url"))
    articles, memo = keyed, seen
    if options.memoize:
        articles = keyed.join(seen.select("domain", "url"), ["domain", "url"], "left_anti")
        memo = C.updated_memo(keyed, seen, options.max_memo)
    profiles = M.source_profile(fronts.select("page_id", F.col("source_url").alias("url"), "html"))
    return SiteBuild(categories, feeds, articles, memo,
                     C.source_summary(categories, feeds, articles, profiles))
