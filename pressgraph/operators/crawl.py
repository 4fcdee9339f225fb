"""Site discovery and the crawl frontier as set operations.

Nothing is limited unless a caller asks for a limit per source.  A limit is
``row_number() <= k``: Spark keeps the best k rows of every task before it
shuffles, so a source that holds a third of all links still sends at most k
rows per task to its window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressgraph import constants as K
from pressgraph.functions import html as H
from pressgraph.functions import urls as U


def next_frontier(frontier: DataFrame, links: DataFrame, seen: DataFrame,
                  max_depth: int = K.MAX_CRAWL_DEPTH) -> DataFrame:
    """Distinct unseen link targets one step deeper, while depth allows."""
    step = (
        frontier.filter(F.col("depth") < max_depth)
        .join(links, F.col("url") == F.col("src_url"))
        .select(F.col("dst_url").alias("url"), (F.col("depth") + 1).alias("depth"))
        .distinct()
    )
    return step.join(seen.select("url"), "url", "left_anti")


def crawl_frontier(seeds: DataFrame, links: DataFrame,
                   max_depth: int = K.MAX_CRAWL_DEPTH) -> DataFrame:
    """``(url, depth)`` reached from the seeds; every URL at its least depth."""
    edges = links.select("src_url", "dst_url").distinct()
    reached = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    frontier = reached
    for _ in range(max_depth):
        frontier = next_frontier(frontier, edges, reached, max_depth)
        reached = reached.unionByName(frontier)
    return reached


def category_urls(source_pages: DataFrame) -> DataFrame:
    """``(source_url, url)`` of section pages linked from site front pages.

    Needs ``source_url, html``.
    """
    links = source_pages.select(
        "source_url", F.explode_outer(H.open_tags(H.drop_scripts("html"), "a")).alias("a"))
    d = links.select("source_url", H.attribute("a", "href").alias("href")).filter(
        F.col("href") != "").distinct()
    # Fragments are not cut off here, so '#top' is a path.
    d = d.withColumns({
        "scheme": U.scheme("href"), "domain": U.netloc("href"),
        "path": F.regexp_extract("href", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?]*)", 1),
        "site": U.brand("source_url"),
    })
    chunks = F.filter(F.split("path", "/"), lambda x: x != "")
    d = d.withColumn("chunks", chunks)
    at = F.array_position("chunks", "index.html")
    d = d.withColumn("chunks", F.filter("chunks", lambda x, i: (i + 1) != at))
    usable = (
        ((F.col("domain") != "") | (F.col("path") != "")) & ~F.col("path").startswith("#")
        & F.col("scheme").isin("", "http", "https"))
    sub = U.subdomain("href")
    related = F.array_contains(F.split(sub, r"\."), F.col("site")) | (U.brand("href") == F.col("site"))
    own_domain = (F.col("domain") != "") & related & ~sub.isin(K.MOBILE_SUBDOMAINS)
    short_path = (F.col("domain") == "") & (F.size("chunks") == 1) & (
        F.length(F.get("chunks", 0)) < K.MAX_CATEGORY_CHUNK)
    picked = F.when(own_domain, F.concat("scheme", F.lit("://"), "domain")).when(
        short_path, F.col("path"))
    d = d.filter(usable).select("source_url", picked.alias("picked")).filter(
        F.col("picked").isNotNull()).distinct()
    words = "|".join(dict.fromkeys(w.replace("-", r"\-") for w in K.CATEGORY_BAD_WORDS))
    probe = F.lower(F.concat(U.path("picked"), F.lit(" "), F.when(
        U.netloc("picked") == "", "").otherwise(U.subdomain("picked"))))
    d = d.filter(~probe.rlike(words))
    roots = source_pages.select("source_url", F.lit("/").alias("picked")).distinct()
    p = F.col("picked")
    fixed = F.when(p.startswith("://"), F.concat(F.lit("http"), p)).when(
        p.startswith("//"), F.concat(F.lit("http:"), p)).otherwise(p)
    trimmed = F.regexp_replace(fixed, "/$", "")
    return d.unionByName(roots).select(
        "source_url", U.prepare_url(trimmed, "source_url").alias("url")).distinct()


def first_per_source(d: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """The first ``limit`` rows of each source in that order; None keeps all."""
    if limit is None:
        return d
    w = W.partitionBy("source_url").orderBy(*order)
    return d.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).drop("n")


def feed_urls(category_pages: DataFrame, limit: int | None = None) -> DataFrame:
    """``(source_url, url)`` of feeds named by category pages.

    Needs ``source_url, url, html``.
    """
    tags = category_pages.select(
        "source_url", F.col("url").alias("page"),
        F.posexplode_outer(H.elements("html", None, "type", r"application\/rss\+xml")).alias("pos", "e"))
    hrefs = tags.select(
        "source_url", "page", "pos", H.attribute(H.open_tag("e"), "href").alias("href")).filter(
        F.col("href") != "")
    first = first_per_source(hrefs, limit, "page", "pos")
    return first.select("source_url", U.prepare_url("href", "source_url").alias("url")).distinct()


def _article_candidates(found: DataFrame) -> DataFrame:
    d = U.with_url_verdict(found.withColumn("url", U.prepare_url("url", "source_url")))
    return d.filter("is_article_url").drop("url_reason", "is_article_url")


def category_candidates(category_pages: DataFrame) -> DataFrame:
    """``(source_url, url, title)`` article links of category pages.

    The URL rules run before anything else looks at the links.
    """
    anchors = category_pages.select(
        "source_url", F.explode_outer(H.elements(H.drop_scripts("html"), "a")).alias("a"))
    links = anchors.select(
        "source_url", H.attribute(H.open_tag("a"), "href").alias("url"),
        F.regexp_extract("a", r"(?s)^<[^>]*>([^<]*)", 1).alias("title")).filter(F.col("url") != "")
    return _article_candidates(links)


def feed_candidates(feeds: DataFrame) -> DataFrame:
    """``(source_url, url, title)`` article links in feed texts (title is NULL)."""
    with_text = feeds.filter(F.coalesce("rss", F.lit("")) != "")
    links = with_text.select("source_url", F.explode_outer(U.urls_in_text("rss")).alias("url")).filter(
        F.col("url").isNotNull())
    return _article_candidates(links.withColumn("title", F.lit(None).cast("string")))


def fresh_articles(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates, one row per (domain, url), that the memo does not hold."""
    unique = candidates.groupBy("domain", "url").agg(F.max("title").alias("title"))
    return unique.join(seen.select("domain", "url"), ["domain", "url"], "left_anti")


def updated_memo(candidates: DataFrame, seen: DataFrame, limit: int | None = None) -> DataFrame:
    """Memo after a run; with a limit, a domain whose memo has outgrown it starts empty."""
    both = seen.select("domain", "url").unionByName(candidates.select("domain", "url")).distinct()
    if limit is None:
        return both
    full = seen.groupBy("domain").agg(F.count_distinct("url").alias("n")).filter(
        F.col("n") > limit).select("domain")
    touched = candidates.select("domain").distinct()
    overflow = full.join(touched, "domain", "left_semi")
    # Overflowing domains hold > limit URLs each, so they are few by definition;
    # the planner decides how to join them.
    return both.join(overflow, "domain", "left_anti")


def merge_candidates(feed: DataFrame, category: DataFrame,
                     limit: int | None = None) -> DataFrame:
    """Union of both origins, one row per URL (category wins)."""
    both = feed.withColumn("origin", F.lit(0)).unionByName(category.withColumn("origin", F.lit(1)))
    unique = both.groupBy("source_url", "url").agg(
        F.max("origin").alias("origin"), F.max_by("title", "origin").alias("title"))
    return first_per_source(unique, limit, "url").select(
        "source_url", "url", "title", F.when(F.col("origin") == 1, "category").otherwise("feed").alias("origin"))


def run_batch(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """In-site articles of one ingest round."""
    return first_per_source(candidates.filter(U.is_in_site("url", "source_url")), limit, "url")


def split_unreadable(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, quarantined): pages without HTML never stop a run."""
    ok = F.coalesce(F.col("html"), F.lit("")) != ""
    return pages.filter(ok), pages.filter(~ok)


def with_content(pages: DataFrame) -> DataFrame:
    return split_unreadable(pages)[0]


def stage_counts(links: DataFrame, seen: DataFrame, by: str = "source_url") -> DataFrame:
    """Per source: links found, left after the URL rules, left after the memo."""
    judged = U.with_url_verdict(links)
    known = seen.select("url").distinct().withColumn("_seen", F.lit(True))
    d = judged.join(known, "url", "left")
    fresh = F.col("is_article_url") & F.col("_seen").isNull()
    return d.groupBy(by).agg(
        F.count("*").alias("found"), F.count_if("is_article_url").alias("articles"),
        F.count_distinct(F.when(fresh, F.col("url"))).alias("fresh"))


def source_summary(categories: DataFrame, feeds: DataFrame, articles: DataFrame,
                   profiles: DataFrame) -> DataFrame:
    """Counts per site with its brand and its description."""
    c = categories.groupBy("source_url").agg(F.count_distinct("url").alias("n_categories"))
    f = feeds.groupBy("source_url").agg(F.count_distinct("url").alias("n_feeds"))
    a = articles.groupBy("source_url").agg(F.count_distinct("url").alias("n_articles"))
    p = profiles.select(F.col("url").alias("source_url"), "brand", "description")
    zero = F.lit(0).cast("long")
    return (
        p.join(c, "source_url", "left").join(f, "source_url", "left").join(a, "source_url", "left")
        .select("source_url", "brand", "description",
                *[F.coalesce(n, zero).alias(n) for n in ("n_categories", "n_feeds", "n_articles")])
    )


def sample_articles(articles: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` articles of each site: the sample that a summary report shows, not a limit of the data."""
    w = W.partitionBy("source_url").orderBy("url")
    return articles.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)


def fresh_cache(cache: DataFrame, now, max_age: int = K.CATEGORY_CACHE_SECONDS) -> DataFrame:
    """Cached rows younger than ``max_age`` seconds."""
    age = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("fetched_at")
    return cache.filter(age < max_age)


def refresh_cache(cache: DataFrame, recomputed: DataFrame, now, key: str = "source_url",
                  max_age: int = K.CATEGORY_CACHE_SECONDS) -> DataFrame:
    """Valid cached rows plus recomputed rows of keys that have none."""
    valid = fresh_cache(cache, now, max_age)
    stale = recomputed.join(valid.select(key).distinct(), key, "left_anti")
    return valid.unionByName(stale.withColumn("fetched_at", F.lit(now).cast("timestamp")))
