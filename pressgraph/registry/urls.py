"""URL queries over page addresses and page links."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgraph import constants as K
from pressgraph.functions import urls as U
from pressgraph.registry import register
from pressgraph.registry import inputs as I

HOST = I.host_sql("url")
_SCHEME = "lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"
_NETLOC = "regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"
_PATH = "regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def _in(values):
    return ", ".join(f"'{v}'" for v in values)


@register("url_parts", f"""
SELECT page_id, {_SCHEME.format(u='url')} AS scheme, {_NETLOC.format(u='url')} AS domain,
       {HOST} AS host, {_PATH.format(u='url')} AS path,
       regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query,
       regexp_extract(url, '^[^#]*#(.*)$', 1) AS fragment,
       split_part({HOST}, '.', -2) AS brand,
       array_to_string(string_split({HOST}, '.')[:-3], '.') AS subdomain,
       starts_with(url, 'http') AS is_absolute
FROM pages""")
def url_parts(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select(
        "page_id", U.scheme("url").alias("scheme"), U.domain("url").alias("domain"),
        U.host("url").alias("host"), U.path("url").alias("path"), U.query("url").alias("query"),
        U.fragment("url").alias("fragment"), U.brand("url").alias("brand"),
        U.subdomain("url").alias("subdomain"), U.is_absolute("url").alias("is_absolute"))


@register("url_cleaning", """
SELECT page_id,
       split_part(url, '#', 1) AS no_fragment,
       regexp_extract(url, '^([^?#]*)', 1) AS no_args,
       regexp_extract(url, '^([^?#]*)', 1) ||
         CASE WHEN url LIKE '%?ref=%' OR url LIKE '%&ref=%'
              THEN '?ref=' || regexp_extract(url, '[?&]ref=([^&#]*)', 1) ELSE '' END AS ref_only,
       regexp_extract(url, '^([^?#]*)', 1) ||
         CASE WHEN contains(url, '#') THEN '#' || split_part(url, '#', 2) ELSE '' END AS with_fragment,
       nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1),
              '\\.([^./]*)/*$', 1), '') AS file_type,
       replace(url, '#top', '?_escaped_fragment_=top') AS escaped,
       md5(url) AS url_hash, md5(html) AS html_hash,
       regexp_matches(url, '/(video|slide|gallery|powerpoint|fashion|glamour|cloth)') AS is_media,
       starts_with(url, 'http') AND NOT ends_with(url, '.pdf') AS crawlable
FROM pages""")
def url_cleaning(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select(
        "page_id", U.strip_fragment("url").alias("no_fragment"),
        U.remove_args("url").alias("no_args"), U.remove_args("url", ["ref="]).alias("ref_only"),
        U.remove_args("url", keep_fragment=True).alias("with_fragment"),
        U.file_type("url").alias("file_type"),
        U.escaped_fragment(F.replace("url", F.lit("#top"), F.lit("#!top"))).alias("escaped"),
        U.fingerprint("url").alias("url_hash"), U.fingerprint("html").alias("html_hash"),
        U.is_media_url("url").alias("is_media"), U.is_crawlable("url").alias("crawlable"))


# Article addresses written from document fields, so that every rule of the
# article-URL test meets data: dated paths, slugs, bad words, file types.
_DOC_URL = """
doc_urls AS (
  SELECT doc_id, CASE
    WHEN lang = 'en' THEN 'http://' || source || '.example.com/news/' || doc_id || '.html'
    WHEN lang = 'fr' THEN 'http://www.' || source || '.fr/' || lower(regexp_replace(left_words, ' ', '-', 'g'))
    WHEN lang = 'de' THEN 'https://' || source || '.co.uk/2014/03/' || doc_id || '/index.jpg'
    ELSE 'http://shop.' || source || '.com/' || source || '/' || n_chars END AS url
  FROM (SELECT *, array_to_string(string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ')[1:7], ' ')
               AS left_words FROM documents))
"""


def document_urls(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents")
    words = F.array_join(
        F.slice(F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " "), 1, 7), "-")
    doc_id = F.col("doc_id").cast("string")
    return d.select(
        "doc_id",
        F.when(F.col("lang") == "en", F.concat(
            F.lit("http://"), "source", F.lit(".example.com/news/"), doc_id, F.lit(".html")))
        .when(F.col("lang") == "fr", F.concat(
            F.lit("http://www."), "source", F.lit(".fr/"), F.lower(words)))
        .when(F.col("lang") == "de", F.concat(
            F.lit("https://"), "source", F.lit(".co.uk/2014/03/"), doc_id, F.lit("/index.jpg")))
        .otherwise(F.concat(
            F.lit("http://shop."), "source", F.lit(".com/"), "source", F.lit("/"),
            F.col("n_chars").cast("string"))).alias("url"))


@register("article_url_verdicts", "WITH " + _DOC_URL + f""",
u AS (SELECT 'd' || doc_id AS id, url FROM doc_urls UNION ALL SELECT 'p' || page_id, url FROM pages),
a AS (SELECT id, url, {HOST} AS h,
        list_filter(string_split({_PATH.format(u='url')}, '/'), lambda x: x <> '') AS raw FROM u),
b AS (SELECT *, string_split(raw[-1], '.') AS piece,
        CASE WHEN ends_with(h, '.co.uk') THEN split_part(h, '.', -3) ELSE split_part(h, '.', -2) END AS brand,
        regexp_replace(h, '\\.?[^.]+\\.(co\\.uk|[^.]+)$', '') AS sub FROM a),
c AS (SELECT *, CASE WHEN len(piece) > 1 THEN nullif(piece[-1], '') END AS ft,
        list_filter(list_append(raw[:-2], CASE WHEN len(piece) > 1 THEN piece[-2] ELSE piece[-1] END),
                    lambda x: x <> 'index') AS ch FROM b),
d AS (SELECT *, coalesce(ch[-1], '') AS slug FROM c),
e AS (SELECT *, length(slug) - length(replace(slug, '-', '')) AS dash,
        length(slug) - length(replace(slug, '_', '')) AS under FROM d),
f AS (SELECT id, CASE
   WHEN length(url) < 11 THEN 'too_short'
   WHEN NOT regexp_matches(url, 'https?://') THEN 'bad_structure'
   WHEN len(string_split(url, '/')) < 4 THEN 'no_path'
   WHEN ft IS NOT NULL AND ft NOT IN ({_in(K.ALLOWED_FILE_TYPES)}) THEN 'bad_file_type'
   WHEN brand IN ({_in(K.BAD_DOMAINS)}) THEN 'bad_domain'
   WHEN (dash > 4 OR under > 4) AND NOT list_contains(
        string_split(lower(slug), CASE WHEN dash >= under THEN '-' ELSE '_' END), brand) THEN 'slug'
   WHEN len(ch) <= 1 THEN 'few_chunks'
   WHEN list_has_any(ch, [{_in(K.BAD_CHUNKS)}]) OR sub IN ({_in(K.BAD_CHUNKS)}) THEN 'bad_chunk'
   WHEN regexp_matches(url, '{K.URL_DATE_PATTERN}') THEN 'date'
   WHEN list_has_any(list_transform(ch, lambda x: lower(x)), [{_in(K.GOOD_PATHS)}]) THEN 'good_path'
   ELSE 'default' END AS url_reason FROM e)
SELECT id, url_reason, url_reason IN ('slug', 'date', 'good_path') AS is_article_url FROM f""")
def article_url_verdicts(spark, sf_dir):
    docs = document_urls(spark, sf_dir).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "url")
    pages = I.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "url")
    return U.with_url_verdict(docs.union(pages)).select("id", "url_reason", "is_article_url")


@register("resolved_links", """
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<a href="([^"]*)"', 1)) AS href
           FROM pages),
r AS (SELECT page_id, url, href, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root,
             regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*/)', 1) AS dir,
             regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM l)
SELECT DISTINCT page_id, href, root || href AS rooted,
       root || dir || substr(href, 2) AS relative,
       root || regexp_replace(dir, '[^/]+/$', '') || substr(href, 2) AS up_one,
       root || path || '?q=' || substr(href, 2) AS query_only,
       regexp_extract(url, '^[a-z]+:', 0) || '//other.example' || href AS other_host,
       regexp_replace(root || href, '[^\\x00-\\x7F]', '', 'g') AS target
FROM r""")
def resolved_links(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages")
    links = pages.select(
        "page_id", "url",
        F.explode(F.regexp_extract_all("html", F.lit('(?s)<a href="([^"]*)"'), F.lit(1))).alias("href"))
    name = F.substring("href", 2, 1 << 20)
    return links.select(
        "page_id", "href",
        U.resolve("url", "href").alias("rooted"),
        U.resolve("url", name).alias("relative"),
        U.resolve("url", F.concat(F.lit("./../"), name)).alias("up_one"),
        U.resolve("url", F.concat(F.lit("?q="), name)).alias("query_only"),
        U.resolve("url", F.concat(F.lit("//other.example"), "href")).alias("other_host"),
        U.crawl_target("url", "href").alias("target"),
    ).distinct()


@register("redirected_urls", """
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<a href="/([^"]*)"', 1)) AS w
           FROM pages)
SELECT DISTINCT page_id, w,
       'http://real.example/' || w AS foreign_link,
       regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/go?url=http%3A%2F%2Freal.example%2F' AS own_link,
       '' AS missing
FROM l""")
def redirected_urls(spark, sf_dir):
    links = I.table(spark, sf_dir, "pages").select(
        "page_id", "url",
        F.explode(F.regexp_extract_all("html", F.lit('(?s)<a href="/([^"]*)"'), F.lit(1))).alias("w"))
    target = F.concat(F.lit("http://real.example/"), "w")
    return links.select(
        "page_id", "w",
        U.prepare_url(F.concat(F.lit("http://pins.test/x?a=1&url="), F.url_encode(target)), "url")
        .alias("foreign_link"),
        U.prepare_url(F.lit("/go?url=http%3A%2F%2Freal.example%2F"), "url").alias("own_link"),
        U.prepare_url(F.lit(None).cast("string")).alias("missing"),
    ).distinct()
