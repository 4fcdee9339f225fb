"""Whole merge of a batch of pages into the stored graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgraph.functions import urls as U
from pressgraph.operators import crawl as C
from pressgraph.operators import graph as G
from pressgraph.options import JobOptions
from pressgraph.plans import articles as A
from pressgraph.session import materialise
from pressgraph.sources import store as S


@dataclass(frozen=True)
class GraphTables:
    articles: DataFrame
    domains: DataFrame
    cites: DataFrame
    mentions: DataFrame
    texts: DataFrame
    frontier: DataFrame


@dataclass(frozen=True)
class Batch:
    """What a batch of pages brings to the graph; all read one parsed table."""

    vertices: DataFrame  # with the order in which rows of one URL are laid over one another
    links: DataFrame
    mentions: DataFrame
    texts: DataFrame
    targets: DataFrame


def read_batch(pages: DataFrame, options: JobOptions = JobOptions()) -> Batch:
    """Parse pages once; the result is written to the shared checkpoint folder and feeds every output."""
    parsed = materialise(A.parse_articles(pages, options.extra_columns), "parsed")
    vertices = parsed.select(
        F.xxhash64("url").alias("article_id"), "url", "domain", "title", "author", "publish_raw",
        "publish_ts", F.col("page_id").alias("seen"))
    links = A.article_links(parsed)
    rows = parsed.join(pages.select("page_id", "html"), "page_id").select(
        F.xxhash64("url").alias("id"), "url", "text", "html", F.col("html").alias("raw_html"))
    targets = links.select(
        "src_url", U.crawl_target("src_url", "dst_url").alias("dst_url")).filter(F.col("dst_url").isNotNull())
    return Batch(vertices, links, A.article_mentions(parsed), rows, targets)


def merge_into(store: S.Store, pages: DataFrame, depth: int = 0, options: JobOptions = JobOptions(),
               stream: str | None = None, batch: int | None = None) -> bool:
    """Merge a batch of pages into all six stored tables as one commit.

    Only buckets that the batch touches are read and written.  With ``stream``,
    a batch number that the store has seen changes nothing, and False is returned.
    """
    found = read_batch(pages, options)

    def change(c: S.Change) -> None:
        c.upsert("articles", found.vertices, lambda old, new: G.merge_articles(old, new, "seen"))
        c.append_new("domains", G.domain_vertices(found.vertices), ["domain"])
        S.merge_citations(c, found.links, options.stub_domains)
        c.append_new("mentions", found.mentions.select("url", "topic", "score"), ["url", "topic", "score"])
        c.upsert("texts", found.texts, G.upsert_text)
        start = found.vertices.select("url").distinct().withColumn("depth", F.lit(depth))
        wanted = found.targets.select(F.col("dst_url").alias("url")).distinct()
        known = c.read("articles", c.buckets_of("articles", wanted)).filter(F.col("title").isNotNull())
        step = C.next_frontier(start, found.targets, known, options.max_depth)
        c.append_new("frontier", step.select("url", F.col("depth").cast("int").alias("depth")), ["url"])

    return store.commit(change, stream, batch)


def merge_pages(pages: DataFrame, articles: DataFrame, cites: DataFrame, mentions: DataFrame,
                texts: DataFrame, depth: int = 0, options: JobOptions = JobOptions()) -> GraphTables:
    """Parse pages and merge articles, links, topics and texts given as whole tables.

    ``merge_into`` does the same to stored tables and rewrites only what changes.
    """
    found = read_batch(pages, options)
    merged = G.merge_articles(articles, found.vertices, "seen")
    all_articles, all_cites, _ = G.merge_citations(merged, cites, found.links, options.stub_domains)
    all_articles = all_articles.withColumn("article_id", F.coalesce("article_id", F.xxhash64("url")))
    all_mentions = G.merge_mentions(mentions, found.mentions)
    start = found.vertices.select("url").distinct().withColumn("depth", F.lit(depth))
    frontier = C.next_frontier(start, found.targets, all_articles.filter(F.col("title").isNotNull()),
                               options.max_depth)
    with_domain = all_articles if options.stub_domains else merged
    return GraphTables(all_articles, G.domain_vertices(with_domain), all_cites, all_mentions,
                       G.upsert_text(texts, found.texts), frontier)
