"""Site discovery, frontier and memo queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgraph import constants as K
from pressgraph.functions import urls as U
from pressgraph.operators import crawl as C
from pressgraph.operators import meta as M
from pressgraph.plans import merge as MP
from pressgraph.plans import sites as SB
from pressgraph.registry import register
from pressgraph.registry import inputs as I
from pressgraph.registry.urls import document_urls, _DOC_URL

_HOST = I.host_sql("url")


@register("frontier_depth2", f"""WITH RECURSIVE {I.PAGE_CITES_SQL},
walk(url, depth) AS (
  SELECT page_id, 0 FROM pages WHERE contains(url, 'utm_source=feed')
  UNION
  SELECT dst, depth + 1 FROM walk JOIN page_cites ON src = url WHERE depth < {K.MAX_CRAWL_DEPTH})
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY url""")
def frontier_depth2(spark, sf_dir):
    seeds = I.table(spark, sf_dir, "pages").filter(
        U.query_param("url", "utm_source") == "feed").select(F.col("page_id").alias("url"))
    links = I.page_cites(spark, sf_dir).select(
        F.col("src").alias("src_url"), F.col("dst").alias("dst_url"))
    return C.crawl_frontier(seeds, links)


_BAD = "|".join(dict.fromkeys(w.replace("-", r"\-") for w in K.CATEGORY_BAD_WORDS))


@register("category_urls", rf"""
WITH p AS (SELECT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS source_url, html FROM pages),
l AS (SELECT DISTINCT source_url, unnest(regexp_extract_all(html, '(?s)<a href="([^"]*)"', 1)) AS href FROM p)
SELECT source_url, source_url || href AS url FROM l
WHERE length(href) BETWEEN 2 AND {K.MAX_CATEGORY_CHUNK} AND NOT regexp_matches(lower(href), '{_BAD}')
UNION SELECT source_url, source_url FROM p""")
def category_urls(spark, sf_dir):
    fronts = I.table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1).alias("source_url"), "html")
    return C.category_urls(fronts)


# Section pages and feeds written from documents: each document gives a page
# with a feed tag and two links, and a feed item.
def section_pages(spark, sf_dir):
    L, pid = F.lit, F.col("page_id").cast("string")
    site = F.concat(L("http://www."), "source", L(".example.com"))
    f = I.press_fields(spark, sf_dir)
    return f.select(
        "page_id", site.alias("source_url"), F.concat(site, L("/p/"), pid).alias("url"),
        F.concat(
            L('<html><head><meta name="description" content="All of '), "source",
            L('"><link type="application/rss+xml" href="/feeds/'), pid, L('.xml"></head><body><a href="/2024/03/'),
            pid, L('">'), "headline", L('</a><a href="/about">About</a></body></html>')).alias("html"),
        F.concat(L("<item><title>"), "headline", L("</title><link>"), site, L("/2024/03/"), pid,
                 L("</link><link>"), site, L("/news/"), pid, L(".html</link></item>")).alias("rss"))


_SECTION = I.PRESS_SQL + """,
sec AS (SELECT page_id, 'http://www.' || source || '.example.com' AS source_url, headline, source, lang FROM press)
"""


@register("feed_urls", f"""WITH {_SECTION}
SELECT source_url, source_url || '/feeds/' || page_id || '.xml' AS url FROM sec""")
def feed_urls(spark, sf_dir):
    return C.feed_urls(section_pages(spark, sf_dir))


@register("category_candidates", f"""WITH {_SECTION}
SELECT source_url, source_url || '/2024/03/' || page_id AS url, headline AS title FROM sec""")
def category_candidates(spark, sf_dir):
    return C.category_candidates(section_pages(spark, sf_dir))


@register("feed_candidates", f"""WITH {_SECTION}
SELECT source_url, source_url || '/2024/03/' || page_id AS url FROM sec
UNION ALL SELECT source_url, source_url || '/news/' || page_id || '.html' FROM sec""")
def feed_candidates(spark, sf_dir):
    return C.feed_candidates(section_pages(spark, sf_dir)).select("source_url", "url")


@register("merged_candidates", f"""WITH {_SECTION},
u AS (SELECT source_url, source_url || '/2024/03/' || page_id AS url, headline AS title, 'category' AS origin FROM sec
  UNION ALL SELECT source_url, source_url || '/news/' || page_id || '.html', NULL, 'feed' FROM sec)
SELECT source_url, url, title, origin FROM u""")
def merged_candidates(spark, sf_dir):
    pages = section_pages(spark, sf_dir)
    return C.merge_candidates(C.feed_candidates(pages), C.category_candidates(pages))


@register("run_batch", f"""WITH {_SECTION}
SELECT source_url, source_url || '/2024/03/' || page_id AS url, headline AS title FROM sec""")
def run_batch(spark, sf_dir):
    return C.run_batch(C.category_candidates(section_pages(spark, sf_dir)))


@register("sample_articles", f"""WITH {_SECTION},
r AS (SELECT source_url, source_url || '/2024/03/' || page_id AS url,
        CAST(row_number() OVER (PARTITION BY source_url ORDER BY source_url || '/2024/03/' || page_id) AS INTEGER) AS n FROM sec)
SELECT source_url, url, n FROM r WHERE n <= 10""")
def sample_articles(spark, sf_dir):
    return C.sample_articles(C.category_candidates(section_pages(spark, sf_dir)), 10).select(
        "source_url", "url", "n")


@register("source_summary", f"""WITH {_SECTION}
SELECT source_url, 'example' AS brand, 'All of ' || source AS description,
  count(*) AS n_categories, count(*) AS n_feeds, count(*) AS n_articles
FROM sec GROUP BY source_url, source""")
def source_summary(spark, sf_dir):
    pages = section_pages(spark, sf_dir)
    profiles = M.source_profile(pages.select(
        "page_id", F.col("source_url").alias("url"), "html")).drop("page_id").distinct()
    return C.source_summary(
        pages.select("source_url", "url"), C.feed_urls(pages), C.category_candidates(pages), profiles)


# URLs without arguments are the candidates; those that arrived through a feed
# are what earlier runs have seen.
def _canonical(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select(
        U.host("url").alias("domain"), U.remove_args("url").alias("url"),
        F.coalesce(U.query_param("url", "utm_source") == "feed", F.lit(False)).alias("fed"),
        F.lit(None).cast("string").alias("title"))


_CANON = f"""
c AS (SELECT {_HOST} AS domain, regexp_extract(url, '^([^?#]*)', 1) AS url,
        contains(url, 'utm_source=feed') AS fed FROM pages)
"""


@register("memo_anti_join", f"""WITH {_CANON}
SELECT DISTINCT domain, url FROM c WHERE (domain, url) NOT IN (SELECT (domain, url) FROM c WHERE fed)""")
def memo_anti_join(spark, sf_dir):
    c = _canonical(spark, sf_dir)
    return C.fresh_articles(c, c.filter("fed")).select("domain", "url")


@register("updated_memo", f"""WITH {_CANON} SELECT DISTINCT domain, url FROM c""")
def updated_memo(spark, sf_dir):
    c = _canonical(spark, sf_dir)
    return C.updated_memo(c, c.filter("fed"))


@register("stage_counts", f"""WITH {_DOC_URL}
SELECT source AS source_url, count(*) AS found,
  CAST(sum(CASE WHEN lang IN ('en') OR (lang = 'fr' AND dashes > 4) THEN 1 ELSE 0 END) AS BIGINT) AS articles,
  count(DISTINCT CASE WHEN lang = 'fr' AND dashes > 4 THEN url END) AS fresh
FROM (SELECT d.source, d.lang, u.url, length(u.url) - length(replace(u.url, '-', '')) AS dashes
      FROM documents d JOIN doc_urls u USING (doc_id)) GROUP BY source""")
def stage_counts(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    links = document_urls(spark, sf_dir).join(docs, "doc_id").withColumnRenamed("source", "source_url")
    return C.stage_counts(links, links.filter("lang = 'en'").select("url"))


@register("pages_with_content", """
SELECT substr(url, 1, 5) AS scheme, count(*) AS n FROM pages WHERE html <> '' GROUP BY 1""")
def pages_with_content(spark, sf_dir):
    return C.with_content(I.table(spark, sf_dir, "pages")).groupBy(
        F.left("url", F.lit(5)).alias("scheme")).agg(F.count("*").alias("n"))


@register("category_cache", """
WITH e AS (SELECT user_id, max(ts) AS fetched_at FROM events GROUP BY user_id),
now AS (SELECT max(ts) AS now FROM events)
SELECT user_id AS source_url,
  CASE WHEN epoch(date_trunc('second', now)) - epoch(date_trunc('second', fetched_at)) < 86400
       THEN fetched_at ELSE now END AS fetched_at
FROM e, now""")
def category_cache(spark, sf_dir):
    events = I.table(spark, sf_dir, "events")
    cache = events.groupBy(F.col("user_id").alias("source_url")).agg(F.max("ts").alias("fetched_at"))
    now = events.agg(F.max("ts")).first()[0]
    return C.refresh_cache(cache, cache.select("source_url"), now)


@register("site_build", f"""WITH {_SECTION}
SELECT source_url, source_url || '/2024/03/' || page_id AS url, 'category' AS origin
FROM sec WHERE lang IS DISTINCT FROM 'en'
UNION ALL SELECT source_url, source_url || '/news/' || page_id || '.html', 'feed' FROM sec""")
def site_build(spark, sf_dir):
    """Whole build: front pages name a section for each document, sections name feeds and articles.
    The memo holds the articles of English pages."""
    pages = section_pages(spark, sf_dir)
    pid = F.col("page_id").cast("string")
    fronts = pages.select(
        "page_id", "source_url", F.concat("source_url", F.lit("/front/"), pid).alias("url"),
        F.concat(F.lit('<html><body><a href="/c'), pid, F.lit('">Section</a></body></html>')).alias("html"))
    stored = pages.select(F.concat("source_url", F.lit("/c"), pid).alias("url"), "html")
    feeds = pages.select(F.concat("source_url", F.lit("/feeds/"), pid, F.lit(".xml")).alias("url"), "rss")
    english = I.press_fields(spark, sf_dir).filter("lang = 'en'").select("page_id")
    seen = pages.join(english, "page_id").select(
        U.netloc("source_url").alias("domain"), F.concat("source_url", F.lit("/2024/03/"), pid).alias("url"))
    built = SB.build_sites(fronts, stored, feeds, seen)
    return built.articles.select("source_url", "url", "origin")


@register("merged_pages", f"""WITH {I.PRESS_SQL}
SELECT unnest(['articles', 'domains', 'texts']) AS name,
  unnest([count(*), count(DISTINCT source), count(*)]) AS n FROM press""")
def merged_pages(spark, sf_dir):
    """The whole merge of press pages into an empty graph."""
    pages = I.press_pages(spark, sf_dir)
    from pressgraph import schemas as S

    def empty(schema):
        return spark.createDataFrame([], schema)

    t = MP.merge_pages(pages, empty(S.ARTICLES), empty(S.CITES), empty(S.MENTIONS), empty(S.ARTICLE_TEXT))
    out = None
    for name, df in (("articles", t.articles), ("domains", t.domains), ("texts", t.texts)):
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out
