"""Finding and formatting the article body.

``blocks -> scored -> kept -> text``.  Everything after the segment rows is one
walk along the rows of each page (``walk``), so the page text is shuffled once
and no stage joins the rows back onto themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgraph import constants as K
from pressgraph.functions import text as T
from pressgraph.operators import structure as S
from pressgraph.operators import walk as P


def high_link_density(n_words: Column, n_links: Column, link_spaces: Column) -> Column:
    """(link words / words) * links >= 1, false without links."""
    link_words = (link_spaces + 1).cast("double")
    words = F.greatest(n_words, F.lit(1)).cast("double")
    return (n_links > 0) & (link_words / words * n_links >= 1.0)


def add_text_stats(rows: DataFrame, lang: str = "lang") -> DataFrame:
    """Word, stop-word and link counts of ``text``."""
    plain = T.inner_trim("text")
    d = rows.withColumn("plain", plain)
    if lang not in d.columns:
        d = d.withColumn(lang, F.lit(T.DEFAULT_LANGUAGE))
    d = d.withColumn("_words", T.words("plain", lang))
    has_text = F.col("plain") != ""
    stops = T.stop_word_count("_words", lang)
    spaces = F.aggregate("links", F.lit(0), lambda acc, x: acc + T.space_count(x["text"]))
    d = d.withColumns({
        "n_words": F.when(has_text, T.space_count("plain") + 1).otherwise(0),
        "n_stop": F.when(has_text, stops).otherwise(0),
        "n_links": F.size("links"),
        "link_spaces": F.when(F.size("links") > 0, spaces).otherwise(0),
    })
    return d.withColumn(
        "link_dense",
        high_link_density(F.col("n_words"), F.col("n_links"), F.col("link_spaces")),
    ).drop("_words")


def blocks(pages: DataFrame, broad: bool = False, use_known: bool = True, spread: bool = True, dealt: bool = False) -> DataFrame:
    """Cleaned block rows with nesting, paragraph roles and word statistics.

    ``role`` is p, pre or td for candidates; loose text of a div counts as a
    paragraph of that div, and a div holding nothing but text is itself a
    paragraph of its parent.  ``dropped`` marks rows inside boilerplate.
    ``dealt`` says that the pages are spread by ``page_id`` already; rows then
    keep their ``url``, so that others can read the same exchange of pages.
    """
    rows = add_text_stats(S.segments(pages, broad, spread and not dealt, together=spread or dealt, keep_url=dealt))
    return P.follow(P.begin(rows) if spread or dealt else rows, P.blocks(use_known))


def scored(block_rows: DataFrame) -> DataFrame:
    """Add candidate boosts and container scores.

    ``up`` is the score a candidate passes up, ``score`` the total a container
    received, ``top_id``/``top_score`` the winning container of the page.
    """
    return P.follow(block_rows, P.scored())


def top_containers(scored_rows: DataFrame) -> DataFrame:
    """The winning container of each page."""
    return scored_rows.filter(F.col("pos") == F.col("top_id")).select(
        "page_id", F.col("pos").alias("container"), "tag", "depth", "score", "n_nodes")


def body_rows(scored_rows: DataFrame, lenient: bool = False) -> DataFrame:
    """Block rows of pages that have a body, with ``keep``, ``in_top`` and order.

    Earlier siblings of the top container are adopted when they look like
    text; children of the top container that are link lists, hold no real
    paragraph or score too low are left out.  ``lenient`` applies the second
    rule set: siblings are always considered, children only fail on links,
    and few-word paragraphs stay.
    """
    return P.follow(scored_rows, P.body(lenient), [
        "page_id", "pos", "tag", "role", "unit_order", "text", "plain", "n_stop", "n_words",
        "adopted", "keep", "links", "videos", "first_image",
        *[c for c in ("images", "levels") if "levels" in scored_rows.columns],
        *[c for c in ("url",) if c in scored_rows.columns], "in_top"])


def with_image_levels(scored_rows: DataFrame) -> DataFrame:
    """Add ``levels``: where the search for a page's image meets a row, nearest first by value.

    The search starts at the winning container and widens: earlier siblings,
    nearest first, then the parent, its earlier siblings, and so on up to
    IMAGE_MAX_PARENTS + 1 parents.  ``parent_depth`` counts the parents,
    ``sibling`` how far back a sibling lies, 0 for the container itself.
    Siblings are containers and block elements; what lies loose between them
    is met at their parent.  Rows that cleaning removed, rows beyond the last
    parent and all rows of a page without a winner have no level.
    """
    return P.follow(scored_rows, P.levels())


def image_levels(scored_rows: DataFrame) -> DataFrame:
    """``(page_id, ord, src, levels)``: the images of each page in page order."""
    d = P.follow(with_image_levels(scored_rows), P.numbered(), ["page_id", "images", "levels", "ords"])
    d = d.withColumn("_image", F.explode(F.arrays_zip("images", "ords")))
    return d.select("page_id", F.col("_image.images").alias("src"), "levels", F.col("_image.ords").alias("ord"))


def kept_blocks(scored_rows: DataFrame, lenient: bool = False) -> DataFrame:
    """Blocks that make the body, with their output order."""
    return P.follow(body_rows(scored_rows, lenient), P.kept(), [
        "page_id", "pos", "tag", "role", "unit_order", "text", "plain", "n_stop", "n_words", "adopted", "first_image",
        *[c for c in ("images", "levels") if "levels" in scored_rows.columns]])


def _glue(parts: Column) -> Column:
    """Text of ordered (unit_order, pos, text) parts: units apart by a blank line."""
    glued = F.aggregate(
        F.array_sort(parts),
        F.struct(F.lit(None).cast("struct<a:int,b:int,c:int>").alias("u"), F.lit("").alias("t")),
        lambda acc, x: F.struct(
            x["unit_order"].alias("u"),
            F.concat(
                acc["t"],
                F.when(acc["u"].isNull(), "").when(acc["u"] == x["unit_order"], " ").otherwise("\u0003"),
                x["text"]).alias("t")),
        lambda acc: acc["t"],
    )
    # A line break inside a unit separates paragraphs, like the unit ends do.
    return T.unescape(F.replace(
        F.replace(glued, F.lit("\n"), F.lit("\n\n")), F.lit("\u0003"), F.lit("\n\n")))


def body_text(kept: DataFrame) -> DataFrame:
    """``(page_id, text)``: units joined by a blank line, entities decoded."""
    return P.per_page(kept, {"parts": (None, ["unit_order", "pos", "text"])}).select(
        "page_id", _glue(F.col("parts")).alias("text"))


def page_bodies(rows: DataFrame) -> DataFrame:
    """One row per page from ``body_rows``: text, links, videos, first image.

    All of them leave in one pass, so the block rows are computed once.
    Rows of ``with_image_levels`` add ``places``: the page's images in order,
    with the levels on which a search meets them.
    """
    placed = "levels" in rows.columns
    lists = {
        "parts": ("keep", ["unit_order", "pos", "text"]),
        "l": ("in_top&_with_links", ["pos", "links"]),
        "v": ("in_top&_with_videos", ["pos", "videos"]),
        **({"p": ("_pictures", ["pos", "images", "levels"])} if placed else {}),
    }
    d = P.per_page(rows, lists, {"first_image": "in_top&_with_first", **({"url": None} if "url" in rows.columns else {})})
    places = F.flatten(F.transform(F.array_sort("p"), lambda x: F.transform(
        x["images"], lambda src: F.struct(src.alias("src"), x["levels"].alias("levels")))))
    return d.select(
        "page_id",
        F.when(F.size("parts") > 0, _glue(F.col("parts"))).alias("text"),
        F.filter(F.flatten(F.transform(F.array_sort("l"), lambda x: x["links"])),
                 lambda x: x["url"] != "").alias("links"),
        F.flatten(F.transform(F.array_sort("v"), lambda x: x["videos"])).alias("videos"),
        F.col("first_image").alias("body_image"),
        *([places.alias("places")] if placed else []),
    )


def body_links(scored_rows: DataFrame) -> DataFrame:
    """``(page_id, pos, url, text)`` of links inside the top container."""
    d = P.follow(scored_rows, P.inside_top(), ["page_id", "pos", "links"])
    return (
        d.select("page_id", "pos", F.posexplode("links").alias("nth", "l"))
        .filter(F.col("l.url") != "")
        .select("page_id", "pos", "nth", "l.url", "l.text")
    )


def full_text(pages: DataFrame, lenient: bool = True, spread: bool = True) -> DataFrame:
    """Page to body text."""
    rows = scored(blocks(pages, broad=lenient, use_known=not lenient, spread=spread))
    return body_text(kept_blocks(rows, lenient))


def body_validity(articles: DataFrame) -> DataFrame:
    """Add ``body_ok`` and ``body_reason``.

    Needs ``url, title, text, html, og_type``.
    """
    n_words = F.size(F.split("text", " "))
    n_sentences = F.size(F.split("text", r"\."))
    media = F.col("url").rlike("|".join(K.MEDIA_URL_WORDS))
    no_text = F.coalesce(F.col("text"), F.lit("")) == ""
    reason = (
        F.when((F.col("og_type") == "article") & (n_words > K.MIN_WORD_COUNT), "article_type")
        .when(~media & no_text, "no_text")
        .when(F.col("title").isNull() | (F.size(F.split("title", " ")) < 2), "short_title")
        .when(F.coalesce(n_words, F.lit(0)) < K.MIN_WORD_COUNT, "few_words")
        .when(F.coalesce(n_sentences, F.lit(0)) < K.MIN_SENTENCE_COUNT, "few_sentences")
        .when(F.coalesce(F.col("html"), F.lit("")) == "", "no_html")
        .otherwise("default")
    )
    return articles.withColumn("body_reason", reason).withColumn(
        "body_ok", F.col("body_reason").isin("article_type", "default"))
