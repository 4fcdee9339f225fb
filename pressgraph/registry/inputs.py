"""Tables the registered queries read, and frames derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgraph.functions.binding import fixed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A citation graph read out of the order tables: orders and parts are the
# articles, line items the citations, customer nations and part brands the
# domains, part types the topics.
def order_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    o = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            F.concat(F.lit("http://orders.example/"), F.col("o_orderkey").cast("string")).alias("url"),
            F.col("n_name").alias("domain"),
            F.concat_ws(" ", "o_orderpriority", "c_name").alias("title"),
            F.col("c_name").alias("author"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
            F.col("o_orderdate").alias("publish_ts"),
        )
    )
    p = table(spark, sf_dir, "part").select(
        F.concat(F.lit("http://parts.example/"), F.col("p_partkey").cast("string")).alias("url"),
        F.col("p_brand").alias("domain"),
        F.col("p_name").alias("title"),
        F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("string").alias("date"),
        F.lit(None).cast("timestamp").alias("publish_ts"),
    )
    return o.unionByName(p)


def order_cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("http://orders.example/"), F.col("l_orderkey").cast("string")).alias("src_url"),
        F.concat(F.lit("http://parts.example/"), F.col("l_partkey").cast("string")).alias("dst_url"),
        F.concat("l_returnflag", "l_linestatus").alias("text"),
    )


def order_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .select(
            F.concat(F.lit("http://orders.example/"), F.col("l_orderkey").cast("string")).alias("url"),
            F.col("p_type").alias("topic"),
            F.col("l_quantity").cast("int").alias("score"),
        )
        .dropDuplicates(["url", "topic", "score"])
    )


ORDER_GRAPH_SQL = """
articles AS (
  SELECT 'http://orders.example/' || o_orderkey AS url, n_name AS domain,
         o_orderpriority || ' ' || c_name AS title, c_name AS author,
         strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderdate AS publish_ts
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 'http://parts.example/' || p_partkey, p_brand, p_name, NULL, NULL, NULL FROM part),
cites AS (
  SELECT 'http://orders.example/' || l_orderkey AS src_url,
         'http://parts.example/' || l_partkey AS dst_url,
         l_returnflag || l_linestatus AS text FROM lineitem),
mentions AS (
  SELECT DISTINCT 'http://orders.example/' || l_orderkey AS url, p_type AS topic,
         CAST(l_quantity AS INTEGER) AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


# Links between pages by a fixed edge rule; the pages themselves only link
# inside their own site.
def page_cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id")
    n = pages.count()
    return pages.select(
        F.col("page_id").alias("src"),
        F.explode(
            F.array((F.col("page_id") * 7 + 3) % n, (F.col("page_id") * 13 + 5) % n)
        ).alias("dst"),
    ).distinct()


PAGE_CITES_SQL = """
n AS (SELECT count(*) AS n FROM pages),
page_cites AS (
  SELECT page_id AS src, (page_id * 7 + 3) % n.n AS dst FROM pages, n
  UNION
  SELECT page_id, (page_id * 13 + 5) % n.n FROM pages, n)
"""

HOST_SQL = (
    "lower(regexp_replace(regexp_replace(regexp_extract({u}, "
    "'^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1), '^[^@]*@', ''), ':[0-9]*$', ''))"
)


def host_sql(u: str) -> str:
    return HOST_SQL.format(u=u)


# --- press pages: article pages written from documents ------------------------
# Lines become paragraphs; title, authors, dates and links are placed in the
# markup the extractors look for, so expected values are known from the tables.
def _escape(c):
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def press_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    # The headline is the first six words, so the rest of the text need not be cut.
    start = F.regexp_extract("text", "^(?:[^A-Za-z]*+[A-Za-z]++){0,6}", 0)
    words = F.filter(
        F.split(F.regexp_replace(start, "[^A-Za-z]+", " "), " "), lambda w: w != "")
    return (
        d.join(c, d.doc_id == c.c_custkey, "left")
        .select(
            F.col("doc_id").alias("page_id"), "text", "lang", "source",
            F.concat(F.lit("http://www."), "source", F.lit(".example.com/2024/03/"),
                     F.col("doc_id").cast("string"), F.lit("/story.html")).alias("url"),
            F.array_join(F.slice(words, 1, 6), " ").alias("headline"),
            F.coalesce(F.col("c_acctbal"), F.lit(0.0)).alias("amount"),
            F.date_format(F.date_add(F.lit("2024-01-01").cast("date"),
                                     F.pmod("doc_id", F.lit(366)).cast("int")), "yyyy-MM-dd").alias("day"),
        )
    )


def untidy(html, number):
    """The same page in one of four styles of markup: tidy, unquoted values, single quotes, signs in values and nested spans."""
    style = F.pmod(number, F.lit(4))
    signs = F.regexp_replace(html, r"<(p|div|span|a|meta|link|h1|iframe|body)([ >])", '<$1 data-note="1 > 0 < <b>"$2')
    return (
        F.when(style == 1, F.regexp_replace(html, r"=\"([^\"'\s<>=`]+)\"", "=$1"))
        .when(style == 2, F.regexp_replace(html, r"=\"([^\"']*)\"", "='$1'"))
        .when(style == 3, F.regexp_replace(signs, r"Ann <b>([^<]*)</b></span>", "Ann <span>$1</span></span>"))
        .otherwise(html))


def press_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = press_fields(spark, sf_dir)
    L = F.lit
    paragraphs = F.array_join(
        F.transform(F.split("escaped", "\n"),
                    lambda x: F.concat(L("<p>"), x, L("</p>"))), "\n")
    pid = F.col("page_id").cast("string")
    html = F.concat(
        L('<!DOCTYPE html>\n<html lang="'), "lang", L('-XX">\n<head><title>'), "source",
        L(" | "), "headline", L('</title>\n<meta property="og:title" content="'), "headline",
        L(" - "), "source", L('">\n<meta property="og:site_name" content="'), "source",
        L('">\n<meta property="og:type" content="article"><meta property="og:title" content="'),
        "source", L(" - "), "headline",
        L('">\n<meta property="og:image" content="/img/'), pid,
        L('.jpg"><meta name="description" content=" About &quot;'), "headline",
        L('&quot; "><meta name="keywords" content="'), "lang", L(", "), "source",
        L('">\n<meta property="article:published_time" content="'), "day",
        L('T08:30:00Z"><meta name="words" content="'), pid,
        L('"><link rel="canonical" href="/story/'), pid,
        L('"><link rel="shortcut icon" href="/icons/'), "source",
        L('.ico">\n<style>p{color:red}</style><script>document.write("<p>no</p>")</script></head>\n<body class="site-footer">'),
        L('<div class="navbar"><p>'), "escaped",
        L('</p></div>\n<div id="main"><h1>'), "headline", L('</h1>\n<span itemprop="name">Ann <b>'),
        "source", L('</b></span><div class="byline">By: Ann '), "source",
        L(' Lee, Bo Chan and Cy Dee</div>\n<div class="text">'), paragraphs,
        L('</div>\n<div class="links-box"><p><a href="/tag/'), "lang", L('">'), "lang",
        L('</a> <a href="http://other.example/'), pid, L('">'), "headline",
        L('</a></p></div></div>\n<iframe src="http://www.youtube.com/embed/'), pid,
        L('" width="560" height="315"></iframe></body></html>'))
    # Extraction is CPU work: a single small input file is spread over the tasks.
    few = table(spark, sf_dir, "documents").rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    spread = f.repartition(spark.sparkContext.defaultParallelism, "page_id") if few else f
    tidy = fixed(fixed(spread, escaped=_escape(F.col("text"))), html=html)
    return fixed(tidy, html=untidy(F.col("html"), F.col("page_id"))).select("page_id", "url", "html")


PRESS_SQL = """
press AS (
  SELECT doc_id AS page_id, text, lang, source,
    'http://www.' || source || '.example.com/2024/03/' || doc_id || '/story.html' AS url,
    array_to_string(list_filter(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' '),
                                lambda w: w <> '')[1:6], ' ') AS headline,
    strftime(DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER), '%Y-%m-%d') AS day
  FROM documents)
"""


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def stop_word_sql() -> str:
    """Stop words of the table languages as a CTE (lang, ws)."""
    from pressgraph.functions.text import stop_words

    return "stops AS (" + " UNION ALL ".join(
        f"SELECT '{lang}' AS lang, [{quoted(stop_words(lang))}] AS ws"
        for lang in ("en", "fr", "de", "es")) + ")"


def trim_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))"


def count_stops_sql(text: str, ws: str = "ws") -> str:
    return (
        f"CASE WHEN {text} = '' THEN 0 ELSE len(list_filter(string_split(lower(regexp_replace({text}, "
        f"'[!-/:-@\\[-`{{-~]', '', 'g')), ' '), lambda w: list_contains({ws}, w))) END"
    )
