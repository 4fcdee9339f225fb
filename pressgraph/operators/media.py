"""Images, videos and embedded posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressgraph import constants as K
from pressgraph.functions import html as H
from pressgraph.functions import urls as U
from pressgraph.functions.binding import fixed
from pressgraph.operators import meta as M

VIDEO = (
    "array<struct<embed_type:string,provider:string,width:string,height:string,"
    "embed_code:string,src:string>>"
)


# --- columns on one page -----------------------------------------------------

def image_urls(html: Column | str = "doc", url: Column | str = "url") -> Column:
    """Absolute image addresses of a page, distinct, in page order."""
    base = F.col(url) if isinstance(url, str) else url
    h = F.col(html) if isinstance(html, str) else html
    srcs = F.transform(H.open_tags(h, "img"), lambda t: H.attribute(t, "src"))
    found = F.array_distinct(F.transform(
        F.filter(srcs, lambda s: s != ""), lambda s: U.resolve(base, s)))
    return F.when(h.isNull() | F.lower(h).contains("<img"), found).otherwise(F.array().cast("array<string>"))


def meta_image_url() -> Column:
    """Page image named by metadata, absolute, '' when none is named."""
    link = F.get(F.filter(
        F.col("head_links"), lambda x: F.try_element_at(x, F.lit("rel")).rlike("(?i)img_src")), 0)
    found = F.coalesce(
        F.nullif(M.meta_content("property", "og:image"), F.lit("")),
        F.nullif(F.try_element_at(link, F.lit("href")), F.lit("")),
        F.nullif(M.meta_content("name", "og:image"), F.lit("")))
    return F.coalesce(F.when(found.isNotNull(), U.resolve("url", found)), F.lit(""))


def provider(src: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in reversed(K.VIDEO_PROVIDERS):
        out = F.when(src.contains(name), name).otherwise(out)
    return out


def videos(html: Column | str) -> Column:
    """Videos of known providers in iframe, embed and object tags, in order.

    An object needs a ``movie`` parameter; an embed inside an object belongs
    to the object.  ``video`` tags name no provider and give nothing.
    """
    h = F.col(html) if isinstance(html, str) else html
    marked = F.regexp_replace(h, r"(?i)(<(?:iframe|embed|object)\b)", H.MARK + "$1")
    pieces = F.slice(F.split(marked, H.MARK), F.lit(2), F.lit(1 << 30))
    state = F.struct(
        F.lit(False).alias("open"), F.array().cast(VIDEO).alias("found"))

    def step(acc: Column, p: Column) -> Column:
        kind = F.lower(F.regexp_extract(p, r"^<([a-zA-Z]+)", 1))
        tag = H.open_tag(p)
        movie = F.regexp_extract(p, r"(?is)<param\b[^>]*\bname\s*=\s*[\"']?movie[^>]*>", 0)
        src = F.when(kind == "object", H.attribute(movie, "value")).otherwise(H.attribute(tag, "src"))
        inner = (kind == "embed") & acc["open"]
        code = F.array_join(F.transform(F.split(F.split_part(
            p, F.concat(F.lit("</"), kind), F.lit(1)), "\n"), lambda x: F.trim(x)), "")
        video = F.struct(
            kind.alias("embed_type"), provider(src).alias("provider"),
            H.attribute(tag, "width").alias("width"), H.attribute(tag, "height").alias("height"),
            F.concat(code, F.lit("</"), kind, F.lit(">")).alias("embed_code"), src.alias("src"))
        return F.struct(
            F.when(p.rlike("(?i)</object"), False)
            .when(kind == "object", True).otherwise(acc["open"]).alias("open"),
            F.when(inner | provider(src).isNull(), acc["found"])
            .otherwise(F.concat(acc["found"], F.array(video))).alias("found"))

    found = F.aggregate(pieces, state, step, lambda acc: acc["found"])
    return F.when(h.rlike(r"(?i)<(?:iframe|embed|object)\b"), found).otherwise(F.array().cast(VIDEO))


def movie_urls(found: Column | str) -> Column:
    v = F.col(found) if isinstance(found, str) else found
    return F.filter(F.transform(v, lambda x: x["src"]), lambda s: s != "")


def tweets(html: Column | str) -> Column:
    """Embedded posts as raw HTML."""
    h = F.col(html) if isinstance(html, str) else html
    found = F.transform(
        H.elements(h, "blockquote", "class", "twitter-tweet"), lambda e: F.concat(e, F.lit("</blockquote>")))
    return F.when(h.isNull() | F.lower(h).contains("<blockquote"), found).otherwise(F.array().cast("array<string>"))


def is_bad_image_name(src: Column | str) -> Column:
    s = F.col(src) if isinstance(src, str) else src
    return F.coalesce(s, F.lit("")).rlike(K.BAD_IMAGE_NAMES) | (F.coalesce(s, F.lit("")) == "")


def good_bytes(n_bytes: Column | str) -> Column:
    b = F.col(n_bytes) if isinstance(n_bytes, str) else n_bytes
    return ((b == 0) | (b > K.IMAGE_MIN_BYTES)) & (b < K.IMAGE_MAX_BYTES)


def side_ratio(width: Column | str, height: Column | str) -> Column:
    """Whole-number ratio of the longer to the shorter side."""
    long_side, short_side = F.greatest(width, height), F.least(width, height)
    return F.floor(long_side / F.nullif(short_side, F.lit(0)))


def is_banner(width: Column | str, height: Column | str) -> Column:
    return F.coalesce(side_ratio(width, height) > K.BANNER_RATIO, F.lit(False))


def image_area(src: Column | str, width: Column | str, height: Column | str) -> Column:
    """Area score of an image; 0 for tiny, narrow or stretched ones."""
    s, w = (F.col(c) if isinstance(c, str) else c for c in (src, width))
    h = F.col(height) if isinstance(height, str) else height
    area = w.cast("long") * h
    return (
        F.when(w.isNull() | h.isNull() | (area < K.MIN_IMAGE_AREA), 0)
        .when(w < K.THUMBNAIL_WIDTH, 0)
        .when(side_ratio(w, h) > K.MAX_IMAGE_RATIO, 0)
        .when(F.lower(s).rlike("sprite|logo"), F.floor(area / 10))
        .otherwise(area).cast("long")
    )


# --- relations -----------------------------------------------------------------

def image_candidates(page_images: DataFrame, images: DataFrame, limit: int | None = None) -> DataFrame:
    """Images of a node with good names and sizes, with a limit the first of each node.

    ``page_images``: page_id, level, parent_depth, ord, src.
    """
    sized = page_images.filter(~is_bad_image_name("src")).join(images, "src").filter(good_bytes("bytes"))
    if limit is None:
        return sized
    w = W.partitionBy("page_id", "level").orderBy("ord")
    return sized.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).drop("n")


def fits_level(parent_depth: Column | str = "parent_depth") -> Column:
    """Large enough for its level, no banner: wide ones only count above the first node and its siblings."""
    wide = (F.col(parent_depth) if isinstance(parent_depth, str) else parent_depth) < 1
    return (wide | (F.col("width") > K.IMAGE_OUTER_MIN_WIDTH)) & ~is_banner("width", "height") & (
        F.col("width") > K.IMAGE_MIN_WIDTH)


def rank_images(page_images: DataFrame, images: DataFrame, limit: int | None = None) -> DataFrame:
    """Best image per page: ``src, width, height, score, confidence, level``.

    Images are scored in page order against the first accepted one.  Levels
    are searched outwards: the first level that accepts an image decides.
    """
    return _nearest_best(image_candidates(page_images, images, limit).filter(fits_level()))


def search_images(placed: DataFrame, images: DataFrame) -> DataFrame:
    """Widening search: best image per page, as ``rank_images``, from ``body.image_levels``.

    Each occurrence meets the size table once; only those of a fit size are
    then listed for the levels that hold them.  An image without a size, or
    on no level, is not found.
    """
    sized = placed.filter(~is_bad_image_name("src") & (F.size("levels") > 0)).join(images, "src").filter(
        good_bytes("bytes") & fits_level(F.lit(0)))
    d = sized.withColumn("_at", F.explode("levels")).select(
        "page_id", "ord", "src", "width", "height", "_at.parent_depth",
        (F.shiftleft(F.col("_at.parent_depth").cast("long"), 32) + F.col("_at.sibling")).alias("level"))
    return _nearest_best(d.filter(fits_level()))


def _nearest_best(d: DataFrame) -> DataFrame:
    """Of accepted images of each page, the best scored one of its nearest level."""
    near = W.partitionBy("page_id")
    d = d.withColumn("_near", F.min("level").over(near)).filter(F.col("level") == F.col("_near"))
    order = near.orderBy("ord")
    area = F.col("width").cast("double") * F.col("height")
    d = d.withColumns({
        "k": F.row_number().over(order),
        "base": F.first(area).over(order) * K.IMAGE_BASE_FACTOR,
        "n_scored": F.count("*").over(near),
    })
    d = d.withColumn("score", F.when(F.col("k") == 1, 1.0).otherwise(
        F.lit(1.0) / F.col("k") * (area / F.col("base"))))
    best = d.groupBy("page_id").agg(F.max(F.struct(
        F.col("score"), (-F.col("ord")).alias("early"), F.col("src"), F.col("width"), F.col("height"),
        F.col("level"), F.floor(F.lit(100) / F.col("n_scored")).alias("confidence"))).alias("b"))
    return best.select(
        "page_id", "b.level", "b.src", "b.width", "b.height", "b.score", "b.confidence")


def largest_images(page_images: DataFrame, images: DataFrame) -> DataFrame:
    """Largest image per page by area score, first on ties; none scores 0."""
    d = page_images.join(images, "src").withColumn("area", image_area("src", "width", "height"))
    return (
        d.filter(F.col("area") > 0).groupBy("page_id")
        .agg(F.max(F.struct("area", (-F.col("ord")).alias("early"), "src")).alias("b"))
        .select("page_id", "b.src", "b.area")
    )


def site_image_classes(spark) -> DataFrame:
    """``(domain, css)``: image containers known for a site."""
    rows = [line.split("^") for line in K.SITE_IMAGE_CLASSES.strip().splitlines()]
    table = spark.createDataFrame(rows, "domain string, css string")
    return table.select("domain", F.explode(F.split("css", r"\|")).alias("css"))


def with_known_names(pages: DataFrame, site_classes: DataFrame) -> DataFrame:
    """Add ``known_names``: the pattern of image containers of a page's site.

    General names are part of the pattern; site names come from the
    dimension, joined on the host.
    """
    sites = site_classes.groupBy("domain").agg(
        F.array_join(F.array_sort(F.collect_set("css")), "|").alias("_css"))
    d = pages.withColumn("_site", F.replace(U.host("url"), F.lit("www."), F.lit("")))
    d = d.join(sites.withColumnRenamed("domain", "_site"), "_site", "left")
    general = "|".join(K.KNOWN_IMAGE_NAMES)
    pattern = F.when(F.col("_css").isNull(), F.lit(f"(?i)({general})")).otherwise(
        F.concat(F.lit(f"(?i)({general}|"), F.col("_css"), F.lit(")")))
    return d.withColumn("known_names", pattern).drop("_site", "_css")


def known_image() -> Column:
    """First image inside a known container, by id and then by class; NULL if none.

    Needs ``known_names`` and the columns of ``with_head``.
    """
    def first_src(attr: str) -> Column:
        marked = F.regexp_replace("doc", rf"(?is)(<[a-z][a-z0-9]*\b[^>]*\s{attr}\s*=)", H.MARK + "$1")
        pieces = F.filter(F.split(marked, H.MARK), lambda p, i: i > 0)
        srcs = F.transform(
            F.filter(pieces, lambda p: F.regexp_like(H.attribute(H.open_tag(p), attr), F.col("known_names"))),
            lambda p: H.attribute(F.regexp_extract(p, r"(?is)<img\b[^>]*>", 0), "src"))
        return F.get(F.filter(srcs, lambda s: s != ""), 0)

    possible = F.regexp_like("doc", F.col("known_names"))
    src = F.when(possible, F.coalesce(first_src("id"), first_src("class")))
    return F.when(src.isNotNull(), U.resolve("url", src))


def known_images(pages: DataFrame, site_classes: DataFrame) -> DataFrame:
    """First image inside a known container of each page that has one.

    Needs ``with_head`` columns.
    """
    d = fixed(with_known_names(pages, site_classes), _src=known_image())
    return d.filter(F.col("_src").isNotNull()).select("page_id", F.col("_src").alias("src"), F.lit(90).alias("confidence"))


def meta_images() -> Column:
    """Image named by a link tag, else by OpenGraph, as (src, type); NULL if none."""
    link = F.get(F.filter(
        F.col("head_links"), lambda x: F.try_element_at(x, F.lit("rel")).rlike("(?i)image_src")
        & (F.try_element_at(x, F.lit("href")) != "")), 0)
    href = F.try_element_at(link, F.lit("href"))
    graph = F.nullif(F.try_element_at("og", F.lit("image")), F.lit(""))
    return F.when(href.isNotNull(), F.struct(
        U.resolve("url", href).alias("src"), F.lit("linktag").alias("extraction_type"))).when(
        graph.isNotNull(), F.struct(
            U.resolve("url", graph).alias("src"), F.lit("opengraph").alias("extraction_type")))


def best_images(known: DataFrame, large: DataFrame, metas: DataFrame) -> DataFrame:
    """One image per page: known container, else large, else metadata."""
    cols = ["page_id", "src", "extraction_type", "confidence", "rank"]
    k = known.select("page_id", "src", F.lit("known").alias("extraction_type"),
                     F.lit(90).cast("long").alias("confidence"), F.lit(0).alias("rank"))
    g = large.select("page_id", "src", F.lit("bigimage").alias("extraction_type"),
                     F.col("confidence").cast("long").alias("confidence"), F.lit(1).alias("rank"))
    m = metas.select("page_id", "src", "extraction_type",
                     F.lit(100).cast("long").alias("confidence"), F.lit(2).alias("rank"))
    union = k.select(cols).unionByName(g.select(cols)).unionByName(m.select(cols))
    return union.groupBy("page_id").agg(
        F.min_by(F.struct("src", "extraction_type", "confidence"), "rank").alias("b")
    ).select("page_id", "b.*")


def top_images(metas: DataFrame, body_first: DataFrame, largest: DataFrame, images: DataFrame) -> DataFrame:
    """Second rule set: meta image, else a fit first body image, else the largest.

    ``metas(page_id, src)``, ``body_first(page_id, src)``, ``largest(page_id, src)``.
    """
    fit = body_first.join(images, "src").filter(
        image_area("src", "width", "height") > K.MIN_IMAGE_AREA)
    fit_largest = largest.filter(F.col("area") > K.MIN_IMAGE_AREA)
    union = (
        metas.filter(F.col("src") != "").select("page_id", "src", F.lit(0).alias("rank"))
        .unionByName(fit.select("page_id", "src", F.lit(1).alias("rank")))
        .unionByName(fit_largest.select("page_id", "src", F.lit(2).alias("rank")))
    )
    return union.groupBy("page_id").agg(F.min_by("src", "rank").alias("src"))
