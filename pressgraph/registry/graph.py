"""Citation-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgraph.functions import urls as U
from pressgraph.operators import graph as G
from pressgraph.operators import graph_queries as Q
from pressgraph.registry import register
from pressgraph.registry import inputs as I

GRAPH = "WITH " + I.ORDER_GRAPH_SQL
HOST = I.host_sql("url")


@register(
    "domain_article_counts",
    f"""SELECT {HOST} AS domain, count(DISTINCT url) AS n_articles FROM pages GROUP BY 1""",
)
def domain_article_counts(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages")
    edges = pages.select("url", U.host("url").alias("domain"))
    return Q.domain_article_counts(edges)


@register("domain_list", GRAPH + """
SELECT domain, count(DISTINCT url) AS n_articles FROM articles GROUP BY domain
ORDER BY n_articles DESC, domain LIMIT 1000""")
def domain_list(spark, sf_dir):
    return Q.domain_list(G.from_edges(I.order_articles(spark, sf_dir)))


@register("article_sources", GRAPH + """
SELECT DISTINCT src_url AS article_url, text AS cite_text, title, url, date, author, domain
FROM cites JOIN articles ON dst_url = url""")
def article_sources(spark, sf_dir):
    return Q.sources(I.order_cites(spark, sf_dir), I.order_articles(spark, sf_dir))


@register("article_citations", GRAPH + """
SELECT DISTINCT dst_url AS article_url, text AS cite_text, title, url, date, author, domain
FROM cites JOIN articles ON src_url = url""")
def article_citations(spark, sf_dir):
    return Q.citations(I.order_cites(spark, sf_dir), I.order_articles(spark, sf_dir))


_PAIRS = """,
pairs AS (SELECT DISTINCT c.src_url, s.domain AS sd, c.dst_url, d.domain AS dd
          FROM cites c JOIN articles s ON c.src_url = s.url JOIN articles d ON c.dst_url = d.url)
"""


@register("cited_domains", GRAPH + _PAIRS + """
SELECT sd AS domain, dd AS cited_domain, count(DISTINCT src_url) AS n_articles
FROM pairs GROUP BY sd, dd""")
def cited_domains(spark, sf_dir):
    articles = I.order_articles(spark, sf_dir)
    return Q.cited_domains(I.order_cites(spark, sf_dir), G.from_edges(articles))


@register("citing_domains", GRAPH + _PAIRS + """
SELECT dd AS domain, sd AS citing_domain, count(DISTINCT dst_url) AS n_articles
FROM pairs GROUP BY dd, sd""")
def citing_domains(spark, sf_dir):
    articles = I.order_articles(spark, sf_dir)
    return Q.citing_domains(I.order_cites(spark, sf_dir), G.from_edges(articles))


@register("domain_stats", GRAPH + _PAIRS + """,
linked AS (
  SELECT sd AS domain, 'cites' AS direction, dd AS other_domain, count(DISTINCT src_url) AS n_linked
  FROM pairs GROUP BY sd, dd
  UNION ALL
  SELECT dd, 'cited_by', sd, count(DISTINCT dst_url) FROM pairs GROUP BY dd, sd)
SELECT d.domain, d.n_articles, l.direction, l.other_domain, l.n_linked
FROM (SELECT domain, count(DISTINCT url) AS n_articles FROM articles GROUP BY domain) d
LEFT JOIN linked l ON d.domain = l.domain""")
def domain_stats(spark, sf_dir):
    articles = I.order_articles(spark, sf_dir)
    return Q.domain_stats(I.order_cites(spark, sf_dir), G.from_edges(articles))


@register("page_domain_stats", "WITH " + I.PAGE_CITES_SQL + f""",
f AS (SELECT page_id, {HOST} AS domain FROM pages),
pairs AS (SELECT src, s.domain AS sd, dst, d.domain AS dd FROM page_cites
          JOIN f s ON src = s.page_id JOIN f d ON dst = d.page_id),
both_ways AS (SELECT domain FROM (SELECT sd AS domain FROM pairs INTERSECT SELECT dd FROM pairs)),
linked AS (
  SELECT sd AS domain, 'cites' AS direction, dd AS other_domain, count(DISTINCT src) AS n_linked
  FROM pairs GROUP BY sd, dd
  UNION ALL
  SELECT dd, 'cited_by', sd, count(DISTINCT dst) FROM pairs GROUP BY dd, sd)
SELECT d.domain, d.n_articles, l.direction, l.other_domain, l.n_linked
FROM (SELECT domain, count(*) AS n_articles FROM f GROUP BY domain) d
JOIN linked l ON d.domain = l.domain JOIN both_ways b ON b.domain = d.domain""")
def page_domain_stats(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages")
    edges = pages.select(F.col("page_id").alias("url"), U.host("url").alias("domain"))
    cites = I.page_cites(spark, sf_dir).select(
        F.col("src").alias("src_url"), F.col("dst").alias("dst_url"))
    return Q.domain_stats(cites, edges, strict=True)


@register("topic_articles", GRAPH + """
SELECT topic, url, score, title, date, domain, author, publish_ts
FROM mentions JOIN articles USING (url)""")
def topic_articles(spark, sf_dir):
    return Q.topic_articles(I.order_mentions(spark, sf_dir), I.order_articles(spark, sf_dir))


@register("topic_mention_counts", GRAPH + """
SELECT topic, count(*) AS articles FROM (SELECT DISTINCT url, topic, score FROM mentions)
GROUP BY topic""")
def topic_mention_counts(spark, sf_dir):
    return Q.topic_counts(I.order_mentions(spark, sf_dir))


@register("article_counts", GRAPH + """
SELECT a.url, a.title, a.domain, coalesce(s.n, 0) AS n_sources, coalesce(c.n, 0) AS n_citations,
       coalesce(m.n, 0) AS n_topics
FROM articles a
LEFT JOIN (SELECT src_url AS url, count(*) AS n FROM (SELECT DISTINCT * FROM cites) GROUP BY 1) s
  ON s.url = a.url
LEFT JOIN (SELECT dst_url AS url, count(*) AS n FROM (SELECT DISTINCT * FROM cites) GROUP BY 1) c
  ON c.url = a.url
LEFT JOIN (SELECT url, count(*) AS n FROM mentions GROUP BY 1) m ON m.url = a.url""")
def article_counts(spark, sf_dir):
    return Q.article_counts(
        I.order_articles(spark, sf_dir), I.order_cites(spark, sf_dir),
        I.order_mentions(spark, sf_dir))


# The single-key questions are asked about the most cited part, the widest
# topic and the largest domain, so the key follows the data at every scale.
_TOP_PART = "(SELECT dst_url FROM cites GROUP BY 1 ORDER BY count(*) DESC, dst_url LIMIT 1)"
_TOP_SRC = "(SELECT src_url FROM cites GROUP BY 1 ORDER BY count(*) DESC, src_url LIMIT 1)"


def _leader(df, column):
    return df.groupBy(column).count().orderBy(F.col("count").desc(), column).first()[0]


@register("full_article", GRAPH + f""",
docs AS (SELECT 'http://orders.example/' || doc_id AS url, text FROM documents),
k AS (SELECT {_TOP_SRC} AS u)
SELECT 'article' AS section, a.url, title, domain, coalesce(d.text, '') AS text,
       CAST(NULL AS INTEGER) AS score
FROM articles a JOIN k ON a.url = k.u LEFT JOIN docs d ON d.url = a.url
UNION ALL
SELECT DISTINCT 'source', a.url, title, domain, text, NULL
FROM cites JOIN k ON src_url = k.u JOIN articles a ON dst_url = a.url
UNION ALL
SELECT DISTINCT 'citation', a.url, title, domain, text, NULL
FROM cites JOIN k ON dst_url = k.u JOIN articles a ON src_url = a.url
UNION ALL
SELECT 'topic', NULL, topic, NULL, NULL, score FROM mentions JOIN k ON url = k.u""")
def full_article(spark, sf_dir):
    cites = I.order_cites(spark, sf_dir)
    texts = I.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("http://orders.example/"), F.col("doc_id").cast("string")).alias("url"),
        "text")
    return Q.full_article(
        I.order_articles(spark, sf_dir), texts, cites, I.order_mentions(spark, sf_dir),
        _leader(cites, "src_url"))


@register("full_topic", GRAPH + """,
k AS (SELECT topic FROM mentions GROUP BY 1 ORDER BY count(*) DESC, topic LIMIT 1)
SELECT m.topic, url, score, title, date, domain, author, publish_ts
FROM mentions m JOIN k ON m.topic = k.topic JOIN articles USING (url)""")
def full_topic(spark, sf_dir):
    mentions = I.order_mentions(spark, sf_dir)
    return Q.full_topic(mentions, I.order_articles(spark, sf_dir), _leader(mentions, "topic"))


@register("full_domain", GRAPH + """,
k AS (SELECT domain AS kd FROM articles GROUP BY 1 ORDER BY count(*) DESC, domain LIMIT 1)
SELECT 'n_articles' AS section, kd AS name, CAST(NULL AS VARCHAR) AS title, count(DISTINCT url) AS n
FROM articles JOIN k ON domain = kd GROUP BY kd
UNION ALL
SELECT 'article', url, title, NULL FROM articles JOIN k ON domain = kd WHERE title IS NOT NULL
UNION ALL
SELECT 'source', d.domain, NULL, count(DISTINCT src_url)
FROM cites JOIN articles s ON src_url = s.url JOIN k ON s.domain = kd
JOIN articles d ON dst_url = d.url GROUP BY d.domain
UNION ALL
SELECT 'citer', s.domain, NULL, count(DISTINCT dst_url)
FROM cites JOIN articles d ON dst_url = d.url JOIN k ON d.domain = kd
JOIN articles s ON src_url = s.url GROUP BY s.domain""")
def full_domain(spark, sf_dir):
    articles = I.order_articles(spark, sf_dir)
    return Q.full_domain(
        articles, I.order_cites(spark, sf_dir), G.from_edges(articles),
        _leader(articles, "domain"))


@register("topk_articles", GRAPH + """
SELECT title, date, author, domain, url FROM articles
WHERE title IS NOT NULL AND title <> 'Unknown' ORDER BY title DESC, url LIMIT 100""")
def topk_articles(spark, sf_dir):
    return Q.article_list(I.order_articles(spark, sf_dir))


@register("search_articles", GRAPH + """
SELECT title, date, author, domain, url FROM articles
WHERE regexp_matches(title, '(?i)urgent.*0[0-9]*7') AND date IS NOT NULL AND date <> 'Unknown'
ORDER BY date DESC, url LIMIT 100""")
def search_articles(spark, sf_dir):
    return Q.search_nodes(
        I.order_articles(spark, sf_dir), "title", "urgent.*0[0-9]*7",
        columns=["title", "date", "author", "domain", "url"])


@register("node_lookup", GRAPH + """
SELECT a.* FROM articles a JOIN (SELECT """ + _TOP_PART + """ AS u) k ON a.url = k.u""")
def node_lookup(spark, sf_dir):
    key = _leader(I.order_cites(spark, sf_dir), "dst_url")
    return Q.node_where(I.order_articles(spark, sf_dir), "url", key)


# ---- building -----------------------------------------------------------

@register("graph_merge", f"""
WITH old AS (SELECT 'http://docs.example/' || doc_id AS url, source AS domain,
                    CAST(NULL AS VARCHAR) AS title, lang FROM documents),
new AS (SELECT 'http://docs.example/' || page_id AS url, {HOST} AS domain,
               regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages)
SELECT coalesce(new.url, old.url) AS url, coalesce(new.domain, old.domain) AS domain,
       coalesce(new.title, old.title) AS title, old.lang AS lang
FROM old FULL JOIN new ON old.url = new.url""")
def graph_merge(spark, sf_dir):
    base = F.lit("http://docs.example/")
    old = I.table(spark, sf_dir, "documents").select(
        F.concat(base, F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("domain"), F.lit(None).cast("string").alias("title"), "lang")
    new = I.table(spark, sf_dir, "pages").select(
        F.concat(base, F.col("page_id").cast("string")).alias("url"),
        U.host("url").alias("domain"),
        F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return G.merge_articles(old, new)


@register("upsert_articles", """
SELECT coalesce(o.id, n.id) AS id,
       CASE WHEN o.id IS NOT NULL THEN o.url ELSE n.url END AS url,
       CASE WHEN n.id IS NOT NULL THEN n.text ELSE o.text END AS text,
       CASE WHEN n.id IS NOT NULL THEN n.html ELSE o.html END AS html,
       CASE WHEN o.id IS NOT NULL THEN o.raw_html ELSE n.raw_html END AS raw_html
FROM (SELECT doc_id AS id, source AS url, text, lang AS html, text AS raw_html FROM documents) o
FULL JOIN (SELECT page_id AS id, url, CAST(NULL AS VARCHAR) AS text, html, html AS raw_html
           FROM pages) n ON o.id = n.id""")
def upsert_articles(spark, sf_dir):
    stored = I.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("url"), "text",
        F.col("lang").alias("html"), F.col("text").alias("raw_html"))
    incoming = I.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), "url", F.lit(None).cast("string").alias("text"), "html",
        F.col("html").alias("raw_html"))
    return G.upsert_text(stored, incoming)


_STUB_SQL = GRAPH + """,
stored AS (SELECT * FROM articles WHERE starts_with(url, 'http://orders.example/')),
stubs AS (SELECT DISTINCT dst_url AS url, 'parts.example' AS domain FROM cites
          WHERE dst_url NOT IN (SELECT url FROM stored))
"""


@register("cited_stubs", _STUB_SQL + "SELECT * FROM stubs")
def cited_stubs(spark, sf_dir):
    stored = I.order_articles(spark, sf_dir).filter(
        F.col("url").startswith("http://orders.example/"))
    return G.cited_stubs(stored, G.link_edges(I.order_cites(spark, sf_dir)))


@register("merged_citations", GRAPH + """
SELECT DISTINCT src_url, dst_url, text FROM cites""")
def merged_citations(spark, sf_dir):
    articles, links = I.order_articles(spark, sf_dir), I.order_cites(spark, sf_dir)
    # Merging the same links on top of themselves must add nothing.
    return G.merge_citations(articles, G.link_edges(links), links)[1]


@register("merged_mentions", GRAPH + """
SELECT url, topic, max(score) AS score, max(score) AS seen FROM mentions GROUP BY url, topic""")
def merged_mentions(spark, sf_dir):
    m = I.order_mentions(spark, sf_dir).withColumn("seen", F.col("score"))
    return G.merge_mentions(m, m, latest="seen")


@register("mention_edges", GRAPH + "SELECT url, topic, score FROM mentions")
def mention_edges(spark, sf_dir):
    m = I.order_mentions(spark, sf_dir)
    return G.merge_mentions(m, m)


@register("relabelled_articles", r"""
WITH links AS (
  SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a href="([^"]*)"', 1)) AS href FROM pages),
nodes AS (
  SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM pages
  UNION SELECT href, '' FROM links
  UNION SELECT 'http://docs.example/' || doc_id,
    CASE lang WHEN 'fr' THEN 'Twitter' WHEN 'de' THEN 'Facebook' WHEN 'es' THEN 'Support' ELSE source END
    FROM documents)
SELECT kind, count(*) AS n FROM (
  SELECT CASE WHEN NOT starts_with(url, 'http') OR domain = '' THEN 'DeadLink'
              WHEN domain IN ('Twitter', 'Facebook') THEN 'SocialMedia'
              WHEN domain = 'Support' THEN 'Node' ELSE 'Article' END AS kind FROM nodes)
GROUP BY kind""")
def relabelled_articles(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages")
    hrefs = pages.select(
        F.explode(F.regexp_extract_all("html", F.lit('(?s)<a href="([^"]*)"'), F.lit(1))).alias("url"),
    ).withColumn("domain", F.lit(""))
    docs = I.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("http://docs.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("lang") == "fr", "Twitter").when(F.col("lang") == "de", "Facebook")
        .when(F.col("lang") == "es", "Support").otherwise(F.col("source")).alias("domain"))
    nodes = pages.select("url", U.netloc("url").alias("domain")).union(hrefs).union(docs).distinct()
    return G.relabel(nodes).groupBy("kind").agg(F.count("*").alias("n"))
