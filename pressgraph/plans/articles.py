"""Page to article: metadata, body, links and media in one row per page."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgraph.functions import html as H
from pressgraph.functions import text as T
from pressgraph.functions import urls as U
from pressgraph.operators import body as B
from pressgraph.operators import media as V
from pressgraph.operators import meta as M
from pressgraph.operators import structure as S
from pressgraph.operators import topics as P
from pressgraph.session import materialise


def with_language(pages: DataFrame) -> DataFrame:
    """Add ``lang``: the language the page declares, English when it declares none.

    ``doc`` is the page without scripts, with tidy tags, as this step read it.
    """
    d = pages if "doc" in pages.columns else M.cleaned(pages)
    d = d.withColumn("html_attrs", M.html_attrs())
    return d.withColumn("lang", M.effective_language(M.meta_language())).drop("html_attrs", "metas")


def page_links(pages: DataFrame) -> DataFrame:
    """Every link of a page with its text and absolute target."""
    anchors = pages.select("page_id", "url", F.explode_outer(H.elements(H.drop_scripts("html"), "a")).alias("a"))
    d = anchors.select(
        "page_id", "url", H.attribute(H.open_tag("a"), "href").alias("href"),
        H.element_text("a").alias("text"))
    return d.filter(F.col("href") != "").withColumn("target", U.resolve("url", "href"))


def parse_articles(
    pages: DataFrame,
    extra_columns: Sequence[Callable[[DataFrame], DataFrame]] = (),
    spread: bool = True,
    images: DataFrame | None = None,
) -> DataFrame:
    """One row per page; pages without HTML keep a row of empty fields.

    Pages are cleaned and spread by ``page_id`` once; metadata and bodies both
    read that exchange, and only the bodies are shuffled for the join.

    ``images`` (src, bytes, width, height; one row per src) turns the image
    search on: ``top_image`` is then the image of a known container, else the
    best one around the body, else the one that metadata names.  The bodies
    are written to the shared folder first, as the search reads them too.
    """
    tasks = S.page_tasks(pages)
    pages = M.cleaned(pages).select("page_id", "url", "doc", "metas")
    if spread:
        # By a hash of the key, as an exchange like that of the source would be left out and every page be built twice.
        pages = pages.repartition(tasks, F.xxhash64("page_id"))
    known = {"known_image": V.known_image()} if images is not None else {}
    named = pages if images is None else V.with_known_names(pages, V.site_image_classes(pages.sparkSession))
    meta = M.metadata(
        named, tweets=V.tweets("doc"), top_image=V.meta_images(), images=V.image_urls(), **known)
    rows = B.scored(B.blocks(with_language(pages), spread=spread, dealt=spread))
    if images is None:
        out = meta.join(B.page_bodies(B.body_rows(rows)), "page_id", "left")
    else:
        bodies = materialise(B.page_bodies(B.body_rows(B.with_image_levels(rows))), "bodies")
        out = _with_best_image(meta.join(bodies.drop("places"), "page_id", "left"), bodies, images)
    no_links = F.array().cast("array<struct<url:string,text:string>>")
    out = out.withColumns({
        "author": F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ","),
        "cleaned_text": F.coalesce("text", F.lit("")),
        "text": T.sentence_lines(F.coalesce("text", F.lit(""))),
        "links": F.coalesce("links", no_links),
        "videos": F.coalesce("videos", F.array().cast(V.VIDEO)),
    })
    for extra in extra_columns:
        out = out.transform(extra)
    return out


def _with_best_image(articles: DataFrame, bodies: DataFrame, images: DataFrame) -> DataFrame:
    placed = bodies.select("page_id", F.posexplode("places").alias("ord", "_p")).select("page_id", "ord", "_p.*")
    large = V.search_images(placed, images).select("page_id", F.col("src").alias("_large"))

    def named(src: str, kind: str):
        return F.when(F.col(src).isNotNull(), F.struct(
            F.col(src).alias("src"), F.lit(kind).alias("extraction_type")))

    best = F.coalesce(named("known_image", "known"), named("_large", "bigimage"), F.col("top_image"))
    return articles.join(large, "page_id", "left").withColumn("top_image", best).drop("known_image", "_large")


def article_mentions(articles: DataFrame) -> DataFrame:
    """``(url, topic, score)`` from the cleaned text."""
    return P.term_counts(articles, key="url", text="cleaned_text")


def article_links(articles: DataFrame) -> DataFrame:
    """``(src_url, dst_url, text)`` of body links, as written in the page."""
    return articles.select(F.col("url").alias("src_url"), F.explode("links").alias("l")).select(
        "src_url", F.col("l.url").alias("dst_url"), F.col("l.text").alias("text"))


def article_records(articles: DataFrame) -> DataFrame:
    """``(page_id, infos)``: the nested article record."""
    meta = F.struct(
        "description", "lang", "keywords", "favicon", "canonical")
    return articles.select(
        "page_id",
        F.struct(
            meta.alias("meta"), F.col("top_image").alias("image"), "domain", "title",
            "cleaned_text", "opengraph", "tags", "tweets", F.col("videos").alias("movies"), "links",
            "authors", F.col("publish_raw").alias("publish_date")).alias("infos"))


def write_articles(articles: DataFrame, path: str) -> None:
    """JSON export of article records."""
    article_records(articles).select("page_id", "infos.*").write.mode("overwrite").json(path)
