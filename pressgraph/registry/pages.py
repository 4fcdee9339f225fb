"""Page queries: structure, metadata and body text.

``press_*`` queries read article pages written from ``documents``; what the
extractors must find is then known straight from the document columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgraph.functions import html as H
from pressgraph.functions import text as T
from pressgraph.functions import urls as U
from pressgraph.operators import body as B
from pressgraph.operators import meta as M
from pressgraph.operators import structure as S
from pressgraph.plans import articles as A
from pressgraph.registry import register
from pressgraph.registry import inputs as I

_NO_SCRIPT = r"regexp_replace(html, '(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)', ' ', 'g')"


def _decode(x: str) -> str:
    out = x
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"),
                       ("&gt;", ">"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return out


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '</?[a-zA-Z!?][^>]*>', ' ', 'g')"


# ---- structure ------------------------------------------------------------

_TOK = (r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
        r"|</?[a-z!?](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>|</?[a-z!?][^>]*>|[^<]+|<")
_CONTAINERS = I.quoted(S.CONTAINER_TAGS)
_TOKENS_SQL = f"""
k0 AS (SELECT page_id, regexp_extract_all(html, '{_TOK}') AS l FROM pages),
k1 AS (SELECT page_id, unnest(l) AS tok, generate_subscripts(l, 1) - 1 AS pos FROM k0),
k2 AS (SELECT *, CASE WHEN regexp_matches(tok, '(?i)^<(script|style)') THEN 'script'
   WHEN starts_with(tok, '<!') OR starts_with(tok, '<?') THEN 'comment'
   WHEN starts_with(tok, '</') THEN 'close' WHEN regexp_matches(tok, '(?i)^<[a-z]') THEN 'open'
   ELSE 'text' END AS kind FROM k1),
k3 AS (SELECT *, CASE WHEN kind IN ('open', 'close', 'script')
   THEN lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) END AS tag FROM k2),
k4 AS (SELECT *, CASE WHEN tag IN ({_CONTAINERS}) AND kind = 'open' THEN 1
   WHEN tag IN ({_CONTAINERS}) AND kind = 'close' THEN -1 ELSE 0 END AS step FROM k3),
tokens AS (SELECT *, CAST(sum(step) OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS depth FROM k4)
"""


@register("page_tokens", f"WITH {_TOKENS_SQL} SELECT page_id, CAST(pos AS INTEGER) AS pos, kind, tag, "
          "depth, md5(tok) AS tok_hash FROM tokens")
def page_tokens(spark, sf_dir):
    return S.tokens(I.table(spark, sf_dir, "pages")).select(
        "page_id", "pos", "kind", "tag", "depth", F.md5("tok").alias("tok_hash"))


@register("page_containers", f"""WITH RECURSIVE {_TOKENS_SQL},
opens AS (SELECT page_id, pos, tag, depth FROM tokens WHERE step = 1),
closes AS (SELECT o.page_id, o.pos, min(c.pos) AS close_pos FROM opens o JOIN tokens c
   ON c.page_id = o.page_id AND c.step = -1 AND c.pos > o.pos AND c.depth = o.depth - 1 GROUP BY 1, 2)
SELECT o.page_id, CAST(o.pos AS INTEGER) AS cid, o.tag, CAST(o.depth AS INTEGER) AS depth,
   CAST(max(p.pos) AS INTEGER) AS parent, CAST(any_value(c.close_pos) AS INTEGER) AS close_pos
FROM opens o LEFT JOIN opens p ON p.page_id = o.page_id AND p.pos < o.pos AND p.depth = o.depth - 1
LEFT JOIN closes c ON c.page_id = o.page_id AND c.pos = o.pos GROUP BY 1, 2, 3, 4""")
def page_containers(spark, sf_dir):
    return S.containers(S.tokens(I.table(spark, sf_dir, "pages"))).select(
        "page_id", "cid", "tag", "depth", "parent", "close_pos")


@register("selected_elements", r"""
WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:a|div)\b[^>]*>')) AS t FROM pages)
SELECT page_id, regexp_extract(t, '^<([a-z]+)', 1) AS tag, regexp_extract(t, '(?:href|class)="([^"]*)"', 1) AS value,
       count(*) AS n
FROM e WHERE regexp_matches(t, '(?i)(href="[^"]*(the|de)[^"]*"|class="ad")') GROUP BY 1, 2, 3""")
def selected_elements(spark, sf_dir):
    tokens = S.tokens(I.table(spark, sf_dir, "pages"))
    links = S.select_elements(tokens, ["a"], "href", "the|de").withColumn(
        "value", F.try_element_at("attrs", F.lit("href")))
    ads = S.select_elements(tokens, attr="class", value="ad", exact=True).withColumn(
        "value", F.try_element_at("attrs", F.lit("class")))
    return links.unionByName(ads).groupBy("page_id", "tag", "value").agg(F.count("*").alias("n"))


@register("paragraph_siblings", r"""
WITH s AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|\z)', 1) AS a FROM pages),
p AS (SELECT page_id, len(regexp_extract_all(a, '<(?:p|h1)>')) AS n FROM s)
SELECT page_id, n AS blocks, greatest(n - 1, 0) AS with_previous, greatest(n - 1, 0) AS with_next FROM p WHERE n > 0""")
def paragraph_siblings(spark, sf_dir):
    tokens = S.tokens(I.table(spark, sf_dir, "pages"))
    articles = tokens.filter((F.col("tag") == "article") & (F.col("kind") == "open")).select(
        "page_id", F.col("pos").alias("parent"))
    return S.siblings(tokens).join(articles, ["page_id", "parent"]).groupBy("page_id").agg(
        F.count("*").alias("blocks"), F.count("previous").alias("with_previous"),
        F.count("next").alias("with_next"))


@register("allowed_html", f"""WITH {_TOKENS_SQL}
SELECT page_id, md5(string_agg(tok, '' ORDER BY pos)) AS h FROM tokens
WHERE kind = 'text' OR (kind IN ('open', 'close') AND tag IN ({I.quoted(S.K.ARTICLE_HTML_TAGS)}))
GROUP BY page_id""")
def allowed_html(spark, sf_dir):
    return S.allow_tags(S.tokens(I.table(spark, sf_dir, "pages"))).select(
        "page_id", F.md5("article_html").alias("h"))


@register("page_links", rf"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all({_NO_SCRIPT}, '(?s)<a href="[^"]*">.*?</a>')) AS a FROM pages)
SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href,
       regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_extract(a, 'href="([^"]*)"', 1) AS target,
       {_decode("regexp_extract(a, '(?s)>(.*?)</a>', 1)")} AS text, count(*) AS n
FROM l GROUP BY ALL""")
def page_links(spark, sf_dir):
    return A.page_links(I.table(spark, sf_dir, "pages")).groupBy(
        "page_id", "href", "target", "text").agg(F.count("*").alias("n"))


@register("page_titles", f"""
SELECT page_id, {I.trim_sql(_decode("regexp_extract(html, '(?s)<title>([^<]*)', 1)"))} AS title,
       lower(regexp_extract(html, '<html lang="([a-zA-Z]{{2}})', 1)) AS lang,
       md5({I.trim_sql(_decode(_strip(_NO_SCRIPT)))}) AS text_hash,
       md5(regexp_replace(html, '(?i)</?(?:b|i|strong)\\b[^>]*>', '', 'g')) AS unwrapped
FROM pages""")
def page_titles(spark, sf_dir):
    d = M.with_head(I.table(spark, sf_dir, "pages"))
    return d.select(
        "page_id", F.col("title_text").alias("title"), M.meta_language().alias("lang"),
        F.md5(H.node_text("doc")).alias("text_hash"),
        F.md5(H.unwrap("html", ["b", "i", "strong"])).alias("unwrapped"))


# ---- metadata of press pages ------------------------------------------------

@register("press_metadata", f"""WITH {I.PRESS_SQL}
SELECT page_id, 'www.' || source || '.example.com' AS domain, trim(headline) AS title,
  ['Ann ' || source] AS authors, day || 'T08:30:00Z' AS publish_raw, lang,
  'About "' || headline || '"' AS description, lang || ', ' || source AS keywords,
  '/icons/' || source || '.ico' AS favicon,
  'http://www.' || source || '.example.com/story/' || page_id AS canonical, [lang] AS tags,
  CAST(day AS TIMESTAMP) + INTERVAL 510 MINUTE AS publish_ts
FROM press""")
def press_metadata(spark, sf_dir):
    return M.metadata(I.press_pages(spark, sf_dir)).select(
        "page_id", "domain", "title", "authors", "publish_raw", "lang", "description", "keywords",
        "favicon", "canonical", "tags", "publish_ts")


@register("press_open_graph", f"""WITH {I.PRESS_SQL}
SELECT page_id, unnest(['title', 'site_name', 'type', 'image']) AS key,
  unnest([source || ' - ' || headline, source, 'article', '/img/' || page_id || '.jpg']) AS value
FROM press""")
def press_open_graph(spark, sf_dir):
    # Outer, as else the planner tests the map for emptiness first, which reads every page twice.
    entries = M.with_head(I.press_pages(spark, sf_dir)).select("page_id", F.explode_outer("og").alias("key", "value"))
    return entries.filter("key is not null")


@register("press_meta_tree", f"""WITH {I.PRESS_SQL}
SELECT page_id, unnest(['og:title', 'og:site_name', 'og:type', 'og:image', 'description', 'keywords',
    'article:published_time', 'words']) AS key,
  unnest([source || ' - ' || headline, source, 'article', '/img/' || page_id || '.jpg',
    'About "' || headline || '"', lang || ', ' || source, day || 'T08:30:00Z', CAST(page_id AS VARCHAR)]) AS value,
  unnest([CAST(NULL AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, page_id]) AS number
FROM press""")
def press_meta_tree(spark, sf_dir):
    d = M.with_head(I.press_pages(spark, sf_dir)).withColumn("tree", M.meta_tree())
    d = d.withColumn("numbers", M.meta_numbers("tree"))
    entries = d.select("page_id", "numbers", F.explode_outer("tree").alias("key", "value")).filter("key is not null")
    return entries.select(
        "page_id", "key", "value", F.try_element_at("numbers", F.col("key")).alias("number"))


@register("press_bylines", f"""WITH {I.PRESS_SQL}
SELECT page_id, ['Ann Lee', 'Bo Chan', 'Cy Dee'] AS authors,
  CASE WHEN length(source) >= length(headline) THEN source ELSE trim(headline) END AS title,
  string_split(lang || ', ' || source, ', ') AS keyword_list,
  true AS dated
FROM press""")
def press_bylines(spark, sf_dir):
    d = M.with_head(I.press_pages(spark, sf_dir))
    return d.select(
        "page_id", M.byline_authors().alias("authors"),
        M.split_title().alias("title"),
        M.keyword_list(M.meta_content("name", "keywords")).alias("keyword_list"),
        M.publish_ts().isNotNull().alias("dated"))


@register("press_languages", f"""WITH {I.PRESS_SQL}
SELECT page_id, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'en' END AS lang,
  left(headline, 200) AS title, 'example' AS brand, 'About "' || headline || '"' AS description
FROM press""")
def press_languages(spark, sf_dir):
    pages = I.press_pages(spark, sf_dir)
    d = M.with_head(pages)
    lang = d.select("page_id", M.effective_language(M.meta_language(), ["en", "fr"]).alias("lang"),
                    M.title().alias("title"))
    return M.truncate(lang).join(M.source_profile(pages).drop("url"), "page_id")


# ---- body ------------------------------------------------------------------

_PAGE_PARAS = rf"""
art AS (SELECT page_id, lower(regexp_extract(html, '<html lang="([a-z]+)"', 1)) AS lang,
   regexp_extract({_NO_SCRIPT}, '(?s)<article>(.*?)(?:</article>|\z)', 1) AS a FROM pages),
pp AS (SELECT page_id, lang, unnest(string_split(a, '<p>')[2:]) AS raw,
   unnest(range(1, len(string_split(a, '<p>')))) AS i FROM art),
tx AS (SELECT page_id, lang, i, regexp_replace(regexp_replace(
   {I.trim_sql(_decode(_strip("replace(raw, '<br>', chr(2))")))}, ' ?' || chr(2) || ' ?', chr(10), 'g'), '^ +| +$', '', 'g') AS t FROM pp),
st AS (SELECT page_id, i, t, {I.trim_sql("t")} AS plain, ws FROM tx JOIN stops USING (lang)),
paras AS (SELECT page_id, i, t, plain, {I.count_stops_sql("plain")} AS n_stop FROM st)
"""


@register("page_body_text", f"""WITH {I.stop_word_sql()}, {_PAGE_PARAS}
SELECT page_id, string_agg(replace(t, chr(10), chr(10) || chr(10)), chr(10) || chr(10) ORDER BY i) AS text
FROM paras WHERE plain <> '' AND n_stop >= 3 AND NOT regexp_matches(plain, '^\\(.*\\)$')
GROUP BY page_id""")
def page_body_text(spark, sf_dir):
    pages = A.with_language(I.table(spark, sf_dir, "pages"))
    return B.body_text(B.kept_blocks(B.scored(B.blocks(pages))))


_SCORES = """
g AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY page_id) AS n,
        sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS nb
      FROM bo WHERE n_stop > 2 WINDOW w AS (PARTITION BY page_id ORDER BY i)),
bs AS (SELECT *, CASE WHEN n > 15 AND n - k <= 0.25 * n THEN
          CASE WHEN pow(0.25 * n - (n - k), 2) > 40 THEN 5.0 ELSE -pow(0.25 * n - (n - k), 2) END
        WHEN b THEN 50.0 / nb ELSE 0.0 END AS boost FROM g),
sc AS (SELECT page_id, CAST(sum(CAST(trunc(n_stop + boost) AS BIGINT)) AS BIGINT) AS score, count(*) AS n_nodes
       FROM bs GROUP BY page_id)
"""


@register("page_top_container", f"""WITH {I.stop_word_sql()}, {_PAGE_PARAS},
bo AS (SELECT *, coalesce(max(n_stop) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) > 5, false) AS b
       FROM paras), {_SCORES}
SELECT page_id, 'article' AS tag, score, n_nodes FROM sc""")
def page_top_container(spark, sf_dir):
    pages = A.with_language(I.table(spark, sf_dir, "pages"))
    return B.top_containers(B.scored(B.blocks(pages))).select("page_id", "tag", "score", "n_nodes")


_PRESS_PARAS = f"""
pl AS (SELECT page_id, lang, unnest(string_split(text, chr(10))) AS raw,
   unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM press),
st AS (SELECT page_id, i, {I.trim_sql("raw")} AS plain, ws FROM pl JOIN stops USING (lang)),
paras AS (SELECT page_id, i, plain AS t, plain, {I.count_stops_sql("plain")} AS n_stop FROM st)
"""


@register("press_top_container", f"""WITH {I.PRESS_SQL}, {I.stop_word_sql()}, {_PRESS_PARAS},
bo AS (SELECT *, coalesce(max(n_stop) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) > 5, false) AS b
       FROM paras), {_SCORES}
SELECT page_id, 'div' AS tag, score, n_nodes FROM sc""")
def press_top_container(spark, sf_dir):
    pages = A.with_language(I.press_pages(spark, sf_dir))
    return B.top_containers(B.scored(B.blocks(pages))).select("page_id", "tag", "score", "n_nodes")


@register("press_body_text", f"""WITH {I.PRESS_SQL}, {I.stop_word_sql()}, {_PRESS_PARAS}
SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text
FROM paras WHERE plain <> '' AND n_stop >= 3 AND NOT regexp_matches(plain, '^\\(.*\\)$')
GROUP BY page_id""")
def press_body_text(spark, sf_dir):
    pages = A.with_language(I.press_pages(spark, sf_dir))
    return B.body_text(B.kept_blocks(B.scored(B.blocks(pages))))


@register("press_full_text", f"""WITH {I.PRESS_SQL}, {I.stop_word_sql()}, {_PRESS_PARAS},
ok AS (SELECT DISTINCT page_id FROM paras WHERE n_stop > 2)
SELECT page_id, 'Ann ' || any_value(source) || chr(10) || chr(10)
  || string_agg(t, chr(10) || chr(10) ORDER BY i) AS text
FROM paras JOIN ok USING (page_id) JOIN (SELECT page_id, source FROM press) USING (page_id)
WHERE plain <> '' GROUP BY page_id""")
def press_full_text(spark, sf_dir):
    # The by-line span stands beside the body and is adopted as a paragraph.
    return B.full_text(A.with_language(I.press_pages(spark, sf_dir)), lenient=True)


@register("body_validity", f"""WITH d AS (SELECT doc_id, lang, text,
  CASE WHEN lang = 'en' THEN 'article' ELSE '' END AS og_type,
  CASE WHEN lang = 'de' THEN 'Word' ELSE 'Two Words' END AS title,
  'http://x.example/' || CASE WHEN lang = 'fr' THEN 'video' ELSE 'news' END AS url FROM documents)
SELECT doc_id, CASE
  WHEN og_type = 'article' AND len(string_split(text, ' ')) > 300 THEN 'article_type'
  WHEN text = '' AND lang <> 'fr' THEN 'no_text'
  WHEN title = 'Word' THEN 'short_title'
  WHEN len(string_split(text, ' ')) < 300 THEN 'few_words'
  WHEN len(string_split(text, '.')) < 7 THEN 'few_sentences' ELSE 'default' END AS body_reason
FROM d""")
def body_validity(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("text").alias("html"),
        F.when(F.col("lang") == "en", "article").otherwise("").alias("og_type"),
        F.when(F.col("lang") == "de", "Word").otherwise("Two Words").alias("title"),
        F.concat(F.lit("http://x.example/"), F.when(F.col("lang") == "fr", "video").otherwise("news")).alias("url"))
    return B.body_validity(d).select("doc_id", "body_reason")


# ---- whole articles ----------------------------------------------------------

@register("parsed_articles", f"""WITH {I.PRESS_SQL}, {I.stop_word_sql()}, {_PRESS_PARAS},
body AS (SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text
  FROM paras WHERE plain <> '' AND n_stop >= 3 AND NOT regexp_matches(plain, '^\\(.*\\)$') GROUP BY page_id)
SELECT p.page_id, p.url, 'www.' || source || '.example.com' AS domain, headline AS title,
  'Ann ' || source AS author, CAST(day AS TIMESTAMP) + INTERVAL 510 MINUTE AS publish_ts,
  md5(coalesce(replace(b.text, '. ', '.' || chr(10) || ' '), '')) AS text_hash, CAST(0 AS BIGINT) AS n_links
FROM press p LEFT JOIN body b USING (page_id)""")
def parsed_articles(spark, sf_dir):
    return A.parse_articles(I.press_pages(spark, sf_dir)).select(
        "page_id", "url", "domain", "title", "author", "publish_ts",
        F.md5("text").alias("text_hash"), F.size("links").cast("long").alias("n_links"))


@register("article_records", f"""WITH {I.PRESS_SQL}
SELECT page_id, lang, 'About "' || headline || '"' AS description,
  'http://www.' || source || '.example.com/story/' || page_id AS canonical, headline AS title,
  CAST(0 AS BIGINT) AS n_movies, '/img/' || page_id || '.jpg' AS og_image FROM press""")
def article_records(spark, sf_dir):
    """The nested export, read back from its JSON form."""
    rec = A.article_records(A.parse_articles(I.press_pages(spark, sf_dir))).select(
        "page_id", F.to_json("infos").alias("j"))
    path = "$.meta.{}".format
    return rec.select(
        "page_id", F.get_json_object("j", path("lang")).alias("lang"),
        F.get_json_object("j", path("description")).alias("description"),
        F.get_json_object("j", path("canonical")).alias("canonical"),
        F.get_json_object("j", "$.title").alias("title"),
        F.json_array_length(F.get_json_object("j", "$.movies")).cast("long").alias("n_movies"),
        F.get_json_object("j", "$.opengraph.image").alias("og_image"))
