"""Column layouts of the stored tables."""

from pyspark.sql import types as T

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

ARTICLES = T.StructType([
    T.StructField("article_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("publish_raw", T.StringType()),
    T.StructField("publish_ts", T.TimestampType()),
])

ARTICLE_TEXT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("raw_html", T.StringType()),
])

CITES = T.StructType([
    T.StructField("src_url", T.StringType()),
    T.StructField("dst_url", T.StringType()),
    T.StructField("text", T.StringType()),
])

MENTIONS = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("score", T.IntegerType()),
])

IMAGES = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
])

SEEN_URLS = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("url", T.StringType()),
])

FRONTIER = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("depth", T.IntegerType()),
])
