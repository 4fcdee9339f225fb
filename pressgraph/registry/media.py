"""Image and video queries.

Line items are image occurrences on the pages of their order; parts give each
image its size.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressgraph.functions.binding import fixed
from pressgraph.operators import body as B
from pressgraph.operators import media as V
from pressgraph.operators import meta as M
from pressgraph.plans import articles as A
from pressgraph.registry import register
from pressgraph.registry import inputs as I


def images(spark, sf_dir):
    return I.table(spark, sf_dir, "part").select(
        F.concat(F.lit("http://img.example/"), F.replace("p_name", F.lit(" "), F.lit("-")),
                 F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("src"),
        (F.pmod("p_partkey", F.lit(500)) * 40).cast("long").alias("bytes"),
        (F.col("p_size") * 24).cast("int").alias("width"),
        (F.pmod("p_partkey", F.lit(37)) * 20 + 15).cast("int").alias("height"))


def page_images(spark, sf_dir):
    li, part = I.table(spark, sf_dir, "lineitem"), I.table(spark, sf_dir, "part")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    items = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"), F.row_number().over(order).alias("ord"))
    return items.join(part, F.col("k") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("page_id"), "ord",
        F.when(F.col("l_linenumber") <= 2, 0).when(F.col("l_linenumber") <= 4, 1).otherwise(2).alias("level"),
        F.when(F.col("l_linenumber") <= 4, 0).otherwise(1).alias("parent_depth"),
        F.concat(F.lit("http://img.example/"), F.replace("p_name", F.lit(" "), F.lit("-")),
                 F.lit("/"), F.col("k").cast("string"), F.lit(".jpg")).alias("src"))


_SQL = """
img AS (SELECT p_partkey, 'http://img.example/' || replace(p_name, ' ', '-') || '/' || p_partkey || '.jpg' AS src,
   CAST(p_partkey % 500 * 40 AS BIGINT) AS bytes, CAST(p_size * 24 AS INTEGER) AS width,
   CAST(p_partkey % 37 * 20 + 15 AS INTEGER) AS height FROM part),
fi AS (SELECT l_orderkey AS page_id, l_linenumber AS line, l_partkey AS k,
   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS ord FROM lineitem),
occ AS (SELECT page_id, ord, CASE WHEN line <= 2 THEN 0 WHEN line <= 4 THEN 1 ELSE 2 END AS level,
   CASE WHEN line <= 4 THEN 0 ELSE 1 END AS parent_depth, img.* FROM fi JOIN img ON k = p_partkey)
"""


_RANKED = """
ok AS (SELECT *, greatest(width, height) // least(width, height) AS ratio FROM occ
  WHERE (bytes = 0 OR bytes > 4000) AND bytes < 15728640),
nm AS (SELECT * FROM ok WHERE NOT regexp_matches(src, 'button|.gif|.ico|.html|adsatt')
  AND ratio <= 5 AND width > 50 AND (parent_depth < 1 OR width > 300)),
k AS (SELECT *, row_number() OVER w AS k, first_value(width * height) OVER w AS fa,
  count(*) OVER (PARTITION BY page_id, level) AS n FROM nm WINDOW w AS (PARTITION BY page_id, level ORDER BY ord)),
s AS (SELECT *, CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / k * (CAST(width AS DOUBLE) * height / (CAST(fa AS DOUBLE) * 1.48::DOUBLE)) END AS score FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY level, score DESC, ord) AS r FROM s)
"""


@register("image_rank", f"""WITH {_SQL}, {_RANKED}
SELECT page_id, level, src, width, height, round(score, 6) AS score, CAST(100 // n AS BIGINT) AS confidence FROM r WHERE r = 1""")
def image_rank(spark, sf_dir):
    return V.rank_images(page_images(spark, sf_dir), images(spark, sf_dir)).withColumn(
        "score", F.round("score", 6))


@register("image_area", f"""WITH {_SQL},
a AS (SELECT *, CASE WHEN width * height < 5000 OR width < 90
    OR greatest(width, height) // least(width, height) > 16 / 9.0 THEN 0
  WHEN regexp_matches(lower(src), 'sprite|logo') THEN width * height // 10 ELSE width * height END AS area FROM occ),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY area DESC, ord) AS r FROM a WHERE area > 0)
SELECT page_id, src, CAST(area AS BIGINT) AS area FROM r WHERE r = 1""")
def image_area(spark, sf_dir):
    return V.largest_images(page_images(spark, sf_dir), images(spark, sf_dir))


@register("image_checks", f"""WITH {_SQL}
SELECT src, greatest(width, height) // least(width, height) > 5 AS banner,
  (bytes = 0 OR bytes > 4000) AND bytes < 15728640 AS good_size FROM img""")
def image_checks(spark, sf_dir):
    return images(spark, sf_dir).select(
        "src", V.is_banner("width", "height").alias("banner"), V.good_bytes("bytes").alias("good_size"))


@register("top_images", f"""WITH {I.PRESS_SQL}, {_SQL},
l AS (SELECT DISTINCT ON (page_id) page_id, src FROM occ
  WHERE width * height > 5000 AND width >= 90 AND greatest(width, height) // least(width, height) <= 16 / 9.0
  ORDER BY page_id, width * height DESC, ord),
f AS (SELECT page_id, src FROM occ WHERE ord = 1
  AND width * height > 5000 AND width >= 90 AND greatest(width, height) // least(width, height) <= 16 / 9.0)
SELECT coalesce(p.page_id, l.page_id) AS page_id,
  CASE WHEN p.page_id IS NOT NULL THEN 'http://www.' || p.source || '.example.com/img/' || p.page_id || '.jpg'
    ELSE coalesce(f.src, l.src) END AS src
FROM press p FULL JOIN l ON p.page_id = l.page_id LEFT JOIN f ON l.page_id = f.page_id""")
def top_images(spark, sf_dir):
    pages = M.with_head(I.press_pages(spark, sf_dir))
    metas = fixed(pages, src=V.meta_image_url()).select("page_id", "src")
    occ, sizes = page_images(spark, sf_dir), images(spark, sf_dir)
    first = occ.filter("ord = 1").select("page_id", "src")
    return V.top_images(metas, first, V.largest_images(occ, sizes), sizes)


_POSTS = "posts AS (SELECT conv_id || '-' || turn AS page_id, role FROM conversations)"


@register("best_images", f"""WITH {I.PRESS_SQL}, {_SQL}, {_RANKED}, {_POSTS},
big AS (SELECT CAST(page_id AS VARCHAR) AS page_id, src, CAST(100 // n AS BIGINT) AS confidence FROM r WHERE r = 1)
SELECT page_id, 'http://posts.example/pic/' || page_id || '.jpg' AS src, 'known' AS extraction_type,
  CAST(90 AS BIGINT) AS confidence FROM posts
UNION ALL SELECT page_id, src, 'bigimage', confidence FROM big
UNION ALL SELECT CAST(page_id AS VARCHAR), 'http://www.' || source || '.example.com/img/' || page_id || '.jpg',
  'opengraph', CAST(100 AS BIGINT) FROM press WHERE CAST(page_id AS VARCHAR) NOT IN (SELECT page_id FROM big)""")
def best_images(spark, sf_dir):
    """Posts have known containers, orders have large pictures, press pages name one in their metadata."""
    name = F.col("page_id").cast("string").alias("page_id")
    known = V.known_images(M.with_head(post_pages(spark, sf_dir)), V.site_image_classes(spark))
    large = V.rank_images(page_images(spark, sf_dir), images(spark, sf_dir)).select(name, "src", "confidence")
    pages = M.with_head(I.press_pages(spark, sf_dir))
    metas = fixed(pages, m=V.meta_images()).select(name, "m").filter("m is not null").select("page_id", "m.*")
    return V.best_images(known, large, metas)


# Gallery pages written from documents: nine places around the body, each
# holding a picture if the number of the page has its bit set.
_PLACES = {  # place: levels that meet it, as (parent_depth, sibling); none beyond the last parent or in boilerplate
    0: [], 1: [(2, 1), (3, 0)], 2: [(1, 1), (2, 0), (3, 0)], 3: [(0, 2), (1, 0), (2, 0), (3, 0)], 4: [],
    5: [(0, 1), (1, 0), (2, 0), (3, 0)], 6: [(0, 0), (1, 0), (2, 0), (3, 0)], 7: [(1, 0), (2, 0), (3, 0)], 8: [(3, 0)],
}
_GALLERY = (
    '<html><head><meta property="og:image" content="/own.jpg"></head><body><div id="z"><div class="x">@0</div>'
    '<div id="c"><div class="x">@1</div><div id="b"><p>@2</p><div id="a"><div class="x">@3</div>'
    '<div class="navbar">@4</div><p>@5</p><div class="text">@t'
    "<p>this is one of the long lines that we have and it was here for you</p>@6</div>"
    '<div class="x">@7</div></div></div><div class="x">@8</div></div></div></body></html>')


def gallery_pages(spark, sf_dir):
    parts = I.table(spark, sf_dir, "part").count()
    text = F.array_join(F.transform(
        F.split(I._escape(F.coalesce("text", F.lit(""))), "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "\n")
    html = F.lit(_GALLERY)
    for n in _PLACES:
        key = F.pmod((F.col("doc_id") * 9 + n) * 7919, F.lit(parts)) + 1
        picture = F.concat(F.lit('<img src="http://img.example/'), key.cast("string"), F.lit('.jpg">'))
        shown = F.getbit("doc_id", F.lit(n)) == 1
        html = F.replace(html, F.lit(f"@{n}"), F.when(shown, picture).otherwise(F.lit("")))
    return fixed(I.table(spark, sf_dir, "documents"), html=F.replace(html, F.lit("@t"), text)).select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("http://gallery.example/"), F.col("doc_id").cast("string")).alias("url"), "html")


def gallery_images(spark, sf_dir):
    return images(spark, sf_dir).withColumn("src", F.regexp_replace("src", r"example/.*/", "example/"))


_GALLERY_SQL = f"""
places AS (SELECT unnest([{", ".join(str(n) for n in _PLACES)}]) AS place),
levels(place, parent_depth, sibling) AS (VALUES {", ".join(f"({n}, {p}, {s})" for n, v in _PLACES.items() for p, s in v)}),
shown AS (SELECT doc_id AS page_id, place, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS ord,
    (doc_id * 9 + place) * 7919 % (SELECT count(*) FROM part) + 1 AS k
  FROM documents, places WHERE (doc_id >> place) & 1 = 1),
img AS (SELECT p_partkey AS k, 'http://img.example/' || p_partkey || '.jpg' AS src,
   CAST(p_partkey % 500 * 40 AS BIGINT) AS bytes, CAST(p_size * 24 AS INTEGER) AS width,
   CAST(p_partkey % 37 * 20 + 15 AS INTEGER) AS height FROM part),
fit AS (SELECT page_id, ord, parent_depth, sibling, src, width, height FROM shown JOIN img USING (k) JOIN levels USING (place)
  WHERE (bytes = 0 OR bytes > 4000) AND bytes < 15728640 AND greatest(width, height) // least(width, height) <= 5
    AND width > 50 AND (parent_depth < 1 OR width > 300)),
k AS (SELECT *, row_number() OVER w AS k, first_value(width * height) OVER w AS fa,
  count(*) OVER (PARTITION BY page_id, parent_depth, sibling) AS n FROM fit
  WINDOW w AS (PARTITION BY page_id, parent_depth, sibling ORDER BY ord)),
s AS (SELECT *, CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / k * (CAST(width AS DOUBLE) * height / (CAST(fa AS DOUBLE) * 1.48::DOUBLE)) END AS score FROM k),
found AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY parent_depth, sibling, score DESC, ord) AS r FROM s)
"""


@register("page_image_levels", f"""WITH {_GALLERY_SQL}
SELECT page_id, CAST(ord AS INTEGER) AS ord, 'http://img.example/' || k || '.jpg' AS src, CAST(parent_depth AS INTEGER) AS parent_depth,
  CAST(sibling AS BIGINT) AS sibling FROM shown LEFT JOIN levels USING (place)""")
def page_image_levels(spark, sf_dir):
    rows = B.scored(B.blocks(gallery_pages(spark, sf_dir)))
    return B.image_levels(rows).withColumn("_at", F.explode_outer("levels")).select("page_id", "ord", "src", "_at.*")


@register("page_image_search", f"""WITH {_GALLERY_SQL}
SELECT page_id, src, width, height, round(score, 6) AS score, CAST(100 // n AS BIGINT) AS confidence,
  CAST(parent_depth AS BIGINT) * 4294967296 + sibling AS level FROM found WHERE r = 1""")
def page_image_search(spark, sf_dir):
    rows = B.scored(B.blocks(gallery_pages(spark, sf_dir)))
    return V.search_images(B.image_levels(rows), gallery_images(spark, sf_dir)).withColumn("score", F.round("score", 6))


@register("article_images", f"""WITH {_GALLERY_SQL}
SELECT doc_id AS page_id, coalesce(src, 'http://gallery.example/own.jpg') AS src,
  CASE WHEN src IS NULL THEN 'opengraph' ELSE 'bigimage' END AS extraction_type
FROM documents LEFT JOIN found ON page_id = doc_id AND r = 1""")
def article_images(spark, sf_dir):
    """Images of whole articles: found around the body, else named by metadata."""
    found = A.parse_articles(gallery_pages(spark, sf_dir), images=gallery_images(spark, sf_dir))
    return found.select("page_id", "top_image.src", "top_image.extraction_type")


@register("press_videos", f"""WITH {I.PRESS_SQL}
SELECT page_id, 'iframe' AS embed_type, 'youtube' AS provider, '560' AS width, '315' AS height,
  'http://www.youtube.com/embed/' || page_id AS src FROM press""")
def press_videos(spark, sf_dir):
    return I.press_pages(spark, sf_dir).select(
        "page_id", F.explode(V.videos("html")).alias("v")).select(
        "page_id", "v.embed_type", "v.provider", "v.width", "v.height", "v.src")


# Post pages written from conversations: each turn is a quoted post with a
# picture.
def post_pages(spark, sf_dir):
    turns = I.table(spark, sf_dir, "conversations")
    pid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return turns.select(
        pid.alias("page_id"), F.concat(F.lit("http://posts.example/"), pid).alias("url"),
        F.concat(F.lit('<html><body><div id="big_photo"><img src="/pic/'), pid,
                 F.lit('.jpg"></div><blockquote class="twitter-tweet">'), "role",
                 F.lit('</blockquote><img src="b/../c.png"></body></html>')).alias("html"))


@register("post_tweets", f"""WITH {_POSTS}
SELECT page_id, '<blockquote class="twitter-tweet">' || role || '</blockquote>' AS tweet FROM posts""")
def post_tweets(spark, sf_dir):
    return post_pages(spark, sf_dir).select("page_id", F.explode(V.tweets("html")).alias("tweet"))


@register("post_images", f"""WITH {_POSTS}
SELECT page_id, unnest(['http://posts.example/pic/' || page_id || '.jpg', 'http://posts.example/c.png']) AS src
FROM posts""")
def post_images(spark, sf_dir):
    return post_pages(spark, sf_dir).select("page_id", F.explode(V.image_urls("html")).alias("src"))


@register("known_images", f"""WITH {_POSTS}
SELECT page_id, 'http://posts.example/pic/' || page_id || '.jpg' AS src, 90 AS confidence FROM posts""")
def known_images(spark, sf_dir):
    return V.known_images(M.with_head(post_pages(spark, sf_dir)), V.site_image_classes(spark))
