"""Building and maintaining the citation graph as keyed tables.

Vertices are ``articles(url, domain, ...)`` and ``domains(domain)``; edges are
``cites(src_url, dst_url, text)`` and ``mentions(url, topic, score)``.  All
merges are joins on the logical key, so a rerun over the same input changes
nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgraph import constants as K
from pressgraph.functions import urls as U


def one_per_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One whole row of each key, the greatest by its other columns (maps do not count).

    Grouped on the key of the join that follows, so both share one shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    rank = [c for c, kind in df.dtypes if c in rest and "map<" not in kind]
    if not rank:
        return df.dropDuplicates(list(key))
    # A row that ranks by all it holds is carried once, not beside its rank.
    best = (F.max(F.struct(*rest)) if rank == rest else F.max_by(F.struct(*rest), F.struct(*rank))).alias("_row")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def laid_over(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Rows of one key laid over one another in ``order``: of each column the last value that is not null."""
    rest = [c for c in df.columns if c not in key and c != order]
    return df.groupBy(*key).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c) for c in rest])


def overlay(old: DataFrame, new: DataFrame, key: Sequence[str], keep_old: Sequence[str] = (),
            order: str | None = None) -> DataFrame:
    """Full outer merge on ``key``: new non-null values win.

    Columns in ``keep_old`` keep the stored value when the row exists already.
    New rows with one key are laid over one another by the column ``order``,
    which is not stored; without it, one of them counts.  One shuffle per side,
    on the key.
    """
    key = list(key)
    new = one_per_key(new, key) if order is None else laid_over(new, key, order)
    columns = list(old.columns) + [c for c in new.columns if c not in old.columns]
    o = old.select(*key, F.struct(*[c for c in old.columns if c not in key]).alias("_old"))
    n = new.select(*key, F.struct(*[c for c in new.columns if c not in key]).alias("_new"))
    joined = o.join(n, key, "full_outer")
    out = []
    for c in columns:
        if c in key:
            out.append(F.col(c))
        elif c not in old.columns:
            out.append(F.col(f"_new.{c}").alias(c))
        elif c not in new.columns:
            out.append(F.col(f"_old.{c}").alias(c))
        elif c in keep_old:
            out.append(
                F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}"))
                .otherwise(F.col(f"_new.{c}")).alias(c)
            )
        else:
            out.append(F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")).alias(c))
    return joined.select(*out)


def merge_articles(stored: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Article vertices merged by URL; incoming properties are laid over, those of one URL by ``order``."""
    return overlay(stored, incoming, ["url"], order=order)


def upsert_text(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert by id; on conflict only ``html`` and ``text`` change, and they
    take the incoming value even when it is NULL.  Of incoming rows with one
    id, one counts."""
    incoming = one_per_key(incoming.select("id", "url", "raw_html", "text", "html"), ["id"])
    s = stored.select("id", F.struct("url", "raw_html", "text", "html").alias("_s"))
    i = incoming.select("id", F.struct("url", "raw_html", "text", "html").alias("_i"))
    joined = s.join(i, "id", "full_outer")

    def pick(first: str, second: str, column: str):
        return F.when(F.col(first).isNotNull(), F.col(f"{first}.{column}")).otherwise(
            F.col(f"{second}.{column}")
        ).alias(column)

    return joined.select(
        "id",
        pick("_s", "_i", "url"),
        pick("_i", "_s", "text"),
        pick("_i", "_s", "html"),
        pick("_s", "_i", "raw_html"),
    )


def domain_vertices(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("domain").isNotNull()).select("domain").distinct()


def from_edges(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("domain").isNotNull()).select("url", "domain").distinct()


def link_edges(links: DataFrame) -> DataFrame:
    """CITES edges of article links: crawlable targets, one edge per text.

    ``links`` has ``src_url``, ``dst_url`` (as written in the page) and ``text``.
    """
    return (
        links.filter(U.is_crawlable("dst_url"))
        .select("src_url", "dst_url", "text")
        .dropDuplicates(["src_url", "dst_url", "text"])
    )


def cited_stubs(articles: DataFrame, cites: DataFrame) -> DataFrame:
    """Targets that are not stored yet, as bare articles with their domain.

    Targets are made distinct first, so a target cited by a third of all edges
    reaches the anti join as one row.
    """
    targets = cites.select(F.col("dst_url").alias("url")).distinct()
    return targets.join(articles.select("url"), "url", "left_anti").select(
        "url", U.netloc("url").alias("domain")
    )


def merge_citations(
    articles: DataFrame, cites: DataFrame, links: DataFrame, stub_domains: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add links to the graph: (articles with stubs, cites, new FROM edges).

    Stubs get no FROM edge unless ``stub_domains`` asks for one.
    """
    edges = link_edges(links)
    stubs = cited_stubs(articles, edges)
    all_articles = articles.unionByName(stubs, allowMissingColumns=True)
    all_cites = cites.unionByName(edges).dropDuplicates(["src_url", "dst_url", "text"])
    stub_from = stubs.select("url", "domain")
    if not stub_domains:
        stub_from = stub_from.limit(0)
    return all_articles, all_cites, stub_from


def merge_mentions(stored: DataFrame, incoming: DataFrame, latest: str | None = None) -> DataFrame:
    """MENTIONS edges, one per (article, topic, score).

    A re-scrape with another score adds an edge; pass the name of an ordering
    column in ``latest`` to keep only the newest score of each pair.
    """
    both = stored.unionByName(incoming)
    if latest is None:
        return both.dropDuplicates(["url", "topic", "score"])
    return both.groupBy("url", "topic").agg(
        F.max_by("score", latest).alias("score"), F.max(latest).alias(latest)
    )


def relabel(articles: DataFrame) -> DataFrame:
    """Set ``kind``: dead links, social media and un-labelled nodes."""
    dead = ~F.col("url").rlike("^http") | (F.col("domain") == "")
    return articles.withColumn(
        "kind",
        F.when(dead, "DeadLink")
        .when(F.col("domain").isin(K.SOCIAL_DOMAINS), "SocialMedia")
        .when(F.col("domain") == K.UNLABELLED_DOMAIN, "Node")
        .otherwise("Article"),
    )
