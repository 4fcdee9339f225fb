"""Questions asked of the citation graph.

Set-based forms answer for every article, topic or domain at once; the
``*_of`` forms filter to one key first so the filter reaches the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgraph import constants as K

CITED_COLUMNS = ["title", "url", "date", "author", "domain"]


def node_where(nodes: DataFrame, column: str, value) -> DataFrame:
    """First node whose property equals a value."""
    return nodes.filter(F.col(column) == F.lit(value)).limit(1)


def top_nodes(
    nodes: DataFrame,
    order: str,
    limit: int,
    columns: Sequence[str] | None = None,
    predicates: Sequence[Column] = (),
    tie_break: str = "url",
) -> DataFrame:
    """Highest ``limit`` nodes by a known, non-null property (a top-k report)."""
    known = nodes.filter(
        F.col(order).isNotNull() & (F.col(order).cast("string") != K.UNKNOWN)
    )
    for p in predicates:
        known = known.filter(p)
    ranked = known.orderBy(F.col(order).desc(), F.col(tie_break)).limit(limit)
    return ranked.select(*columns) if columns else ranked


def search_nodes(
    nodes: DataFrame,
    field: str,
    term: str,
    limit: int = 100,
    order: str = "date",
    quote: bool = False,
    tie_break: str = "url",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Case-insensitive pattern search on a property, newest first."""
    body = rf"\Q{term}\E" if quote else term
    # Whole-value match of '.*term.*' equals finding the term anywhere.
    return top_nodes(
        nodes, order, limit, columns=columns, tie_break=tie_break,
        predicates=[F.col(field).rlike(f"(?i){body}")],
    )


def article_list(articles: DataFrame, limit: int = 100, order: str = "title") -> DataFrame:
    return top_nodes(
        articles, order, limit, ["title", "date", "author", "domain", "url"]
    )


def _cited(articles: DataFrame) -> DataFrame:
    return articles.select(*CITED_COLUMNS)


def sources(cites: DataFrame, articles: DataFrame) -> DataFrame:
    """What each article cites: distinct (text, target properties)."""
    # Distinct before the join: narrow rows then fill the hash tables.
    a, narrow = _cited(articles).distinct(), cites.select("src_url", "dst_url", "text").distinct()
    return (
        narrow.join(a, F.col("dst_url") == F.col("url"))
        .select(F.col("src_url").alias("article_url"), F.col("text").alias("cite_text"),
                *CITED_COLUMNS)
    )


def citations(cites: DataFrame, articles: DataFrame) -> DataFrame:
    """Who cites each article: distinct (text, citing article properties)."""
    a, narrow = _cited(articles).distinct(), cites.select("src_url", "dst_url", "text").distinct()
    return (
        narrow.join(a, F.col("src_url") == F.col("url"))
        .select(F.col("dst_url").alias("article_url"), F.col("text").alias("cite_text"),
                *CITED_COLUMNS)
    )


def sources_of(cites: DataFrame, articles: DataFrame, url: str) -> DataFrame:
    return sources(cites.filter(F.col("src_url") == url), articles)


def citations_of(cites: DataFrame, articles: DataFrame, url: str) -> DataFrame:
    return citations(cites.filter(F.col("dst_url") == url), articles)


def topics_of(mentions: DataFrame, url: str) -> DataFrame:
    return (
        mentions.filter(F.col("url") == url)
        .select(F.col("score").cast("int").alias("score"), F.col("topic").alias("name"))
        .orderBy(F.col("score").desc(), "name")
    )


def articles_of_topic(mentions: DataFrame, articles: DataFrame, topic: str) -> DataFrame:
    """Articles mentioning a topic, strongest first, then newest."""
    hit = mentions.filter(F.col("topic") == topic).select("url", "score")
    return topic_articles(hit.withColumn("topic", F.lit(topic)), articles).orderBy(
        F.col("score").desc(), F.col("publish_ts").desc_nulls_last(), "url"
    )


def topic_articles(mentions: DataFrame, articles: DataFrame) -> DataFrame:
    props = articles.select("url", "title", "date", "domain", "author", "publish_ts")
    return mentions.select("topic", "url", F.col("score").cast("int").alias("score")).join(
        props, "url"
    )


def topic_counts(mentions: DataFrame) -> DataFrame:
    """Topics with the number of distinct mentions, fewest first."""
    return (
        mentions.groupBy("topic")
        .agg(F.count_distinct("url", "score").alias("articles"))
        .orderBy("articles", "topic")
    )


def domain_articles(articles: DataFrame, domain: str) -> DataFrame:
    return (
        articles.filter((F.col("domain") == domain) & F.col("title").isNotNull())
        .select("title", "date", "domain", "author", "url", "publish_ts")
        .orderBy(F.col("publish_ts").desc_nulls_last(), "url")
    )


def domain_article_counts(from_edges: DataFrame) -> DataFrame:
    """Distinct FROM edges per domain.

    Counting distinct URLs adds the URL to the first shuffle key, so a domain
    holding a third of all articles is spread over every task.
    """
    return from_edges.groupBy("domain").agg(F.count_distinct("url").alias("n_articles"))


def domain_list(from_edges: DataFrame, limit: int = 1000) -> DataFrame:
    return domain_article_counts(from_edges).orderBy(
        F.col("n_articles").desc(), "domain"
    ).limit(limit)


def _domain_pairs(cites: DataFrame, from_edges: DataFrame) -> DataFrame:
    """(src_url, src_domain, dst_url, dst_domain) of every distinct link.

    Link texts are dropped and duplicate links removed before the joins.  Both
    joins look up one row per URL; a target that collects a third of all
    links makes a skewed partition on the link side only, which the adaptive
    skew join splits.
    """
    links = cites.select("src_url", "dst_url").distinct()
    src = from_edges.select(F.col("url").alias("src_url"), F.col("domain").alias("src_domain"))
    dst = from_edges.select(F.col("url").alias("dst_url"), F.col("domain").alias("dst_domain"))
    return links.join(src, "src_url").join(dst, "dst_url")


def cited_domains(cites: DataFrame, from_edges: DataFrame) -> DataFrame:
    """Per domain: the domains its articles cite, by distinct citing articles."""
    return (
        _domain_pairs(cites, from_edges)
        .groupBy(F.col("src_domain").alias("domain"), F.col("dst_domain").alias("cited_domain"))
        .agg(F.count_distinct("src_url").alias("n_articles"))
    )


def citing_domains(cites: DataFrame, from_edges: DataFrame) -> DataFrame:
    """Per domain: the domains citing it, by distinct cited articles."""
    return (
        _domain_pairs(cites, from_edges)
        .groupBy(F.col("dst_domain").alias("domain"), F.col("src_domain").alias("citing_domain"))
        .agg(F.count_distinct("dst_url").alias("n_articles"))
    )


def domain_stats(cites: DataFrame, from_edges: DataFrame, strict: bool = False) -> DataFrame:
    """Combined statistics, one row per (domain, direction, other domain).

    The result stays relational: a domain that cites a million others is a
    million rows, never one array.  Domains without links keep one row with a
    NULL direction unless ``strict`` asks for domains having both directions.
    """
    pairs = _domain_pairs(cites, from_edges)
    # One pass over the joined links feeds both directions.
    both = pairs.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("src_domain").alias("domain"), F.lit("cites").alias("direction"),
                    F.col("dst_domain").alias("other_domain"), F.col("src_url").alias("article"),
                ),
                F.struct(
                    F.col("dst_domain").alias("domain"), F.lit("cited_by").alias("direction"),
                    F.col("src_domain").alias("other_domain"), F.col("dst_url").alias("article"),
                ),
            )
        ).alias("e")
    ).select("e.*")
    counted = both.groupBy("domain", "direction", "other_domain").agg(
        F.count_distinct("article").alias("n_linked")
    )
    if strict:
        complete = (
            counted.groupBy("domain")
            .agg(F.count_distinct("direction").alias("k"))
            .filter("k = 2")
            .select("domain")
        )
        counted = counted.join(complete, "domain", "left_semi")
    return domain_article_counts(from_edges).join(
        counted, "domain", "inner" if strict else "left"
    )


def article_counts(articles: DataFrame, cites: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per article: distinct sources, citations and topics (0 when none)."""
    out = cites.groupBy(F.col("src_url").alias("url")).agg(
        F.count_distinct("dst_url", "text").alias("n_sources")
    )
    inn = cites.groupBy(F.col("dst_url").alias("url")).agg(
        F.count_distinct("src_url", "text").alias("n_citations")
    )
    top = mentions.groupBy("url").agg(F.count("*").alias("n_topics"))
    joined = (
        articles.select("url", "title", "domain")
        .join(out, "url", "left").join(inn, "url", "left").join(top, "url", "left")
    )
    zero = F.lit(0).cast("long")
    return joined.select(
        "url", "title", "domain",
        F.coalesce("n_sources", zero).alias("n_sources"),
        F.coalesce("n_citations", zero).alias("n_citations"),
        F.coalesce("n_topics", zero).alias("n_topics"),
    )


def full_article(
    articles: DataFrame, texts: DataFrame, cites: DataFrame, mentions: DataFrame, url: str
) -> DataFrame:
    """Everything known about one article, as rows of sections.

    Section ``article`` carries the text ('' when missing); ``source``,
    ``citation`` and ``topic`` rows carry the linked items.  Rows instead of
    nested lists keep a heavily cited article from becoming one huge value.
    """
    empty = F.lit(None).cast("string")
    no_score = F.lit(None).cast("int")
    main = (
        articles.filter(F.col("url") == url)
        .join(texts.filter(F.col("url") == url).select("url", "text"), "url", "left")
        .select(
            F.lit("article").alias("section"), "url", "title", "domain",
            F.coalesce("text", F.lit("")).alias("text"), no_score.alias("score"),
        )
    )
    src = sources_of(cites, articles, url).select(
        F.lit("source").alias("section"), "url", "title", "domain",
        F.col("cite_text").alias("text"), no_score.alias("score"))
    cit = citations_of(cites, articles, url).select(
        F.lit("citation").alias("section"), "url", "title", "domain",
        F.col("cite_text").alias("text"), no_score.alias("score"))
    top = topics_of(mentions, url).select(
        F.lit("topic").alias("section"), empty.alias("url"), F.col("name").alias("title"),
        empty.alias("domain"), empty.alias("text"), "score")
    return main.unionByName(src).unionByName(cit).unionByName(top)


def full_topic(mentions: DataFrame, articles: DataFrame, topic: str) -> DataFrame:
    return articles_of_topic(mentions, articles, topic).withColumn("topic", F.lit(topic))


def full_domain(
    articles: DataFrame, cites: DataFrame, from_edges: DataFrame, domain: str
) -> DataFrame:
    """One domain: its articles and its link statistics, as rows of sections."""
    own = from_edges.filter(F.col("domain") == domain).select("url").distinct()
    arts = domain_articles(articles, domain).select(
        F.lit("article").alias("section"), F.col("url").alias("name"), "title",
        F.lit(None).cast("long").alias("n"))
    count = own.agg(F.count("*").alias("n")).select(
        F.lit("n_articles").alias("section"), F.lit(domain).alias("name"),
        F.lit(None).cast("string").alias("title"), "n")
    links = cites.select("src_url", "dst_url").distinct()
    other = from_edges.select("url", F.col("domain").alias("name"))
    cited = (
        links.join(own, links.src_url == own.url, "left_semi")
        .join(other, F.col("dst_url") == F.col("url"))
        .groupBy("name").agg(F.count_distinct("src_url").alias("n"))
        .select(F.lit("source").alias("section"), "name",
                F.lit(None).cast("string").alias("title"), "n"))
    citing = (
        links.join(own, links.dst_url == own.url, "left_semi")
        .join(other, F.col("src_url") == F.col("url"))
        .groupBy("name").agg(F.count_distinct("dst_url").alias("n"))
        .select(F.lit("citer").alias("section"), "name",
                F.lit(None).cast("string").alias("title"), "n"))
    return count.unionByName(arts).unionByName(cited).unionByName(citing)
