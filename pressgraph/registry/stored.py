"""Stored tables in buckets: merged in several commits and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressgraph import schemas
from pressgraph.operators import graph as G
from pressgraph.registry import REGISTRY, register
from pressgraph.registry import graph, streams  # noqa: F401  their SQL is used here
from pressgraph.registry import inputs as I
from pressgraph.sources.store import Store, Table
from pressgraph.streaming import ingest as N


def _store(spark, name, **tables):
    return Store(spark, streams._folder(spark, name), tables)


@register("stored_texts", REGISTRY["upsert_articles"][1])
def stored_texts(spark, sf_dir):
    store = _store(spark, "texts", texts=Table(schemas.ARTICLE_TEXT, "id"))
    docs = I.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("url"), "text",
        F.col("lang").alias("html"), F.col("text").alias("raw_html"))
    pages = I.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), "url", F.lit(None).cast("string").alias("text"), "html", F.col("html").alias("raw_html"))
    for batch in (docs, pages, pages.filter("id % 2 = 0")):  # a part of the pages once more changes nothing
        store.commit(lambda c, batch=batch: c.upsert("texts", batch, G.upsert_text))
        store.vacuum(keep=1)  # nobody reads the state before
    return store.read("texts")


@register("stored_articles", REGISTRY["graph_merge"][1])
def stored_articles(spark, sf_dir):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "domain", "title", "lang")])
    store = _store(spark, "articles", articles=Table(schema, "url"))
    base = F.lit("http://docs.example/")
    old = I.table(spark, sf_dir, "documents").select(
        F.concat(base, F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("domain"), "lang")
    store.commit(lambda c: c.add("articles", old.withColumn("title", F.lit(None).cast("string"))))
    new = I.table(spark, sf_dir, "pages").select(
        F.concat(base, F.col("page_id").cast("string")).alias("url"), graph.U.host("url").alias("domain"),
        F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.col("page_id").alias("seen"))
    store.commit(lambda c: c.upsert("articles", new, lambda stored, more: G.merge_articles(stored, more, "seen")))
    return store.read("articles")


@register("stored_cites", REGISTRY["merged_citations"][1])
def stored_cites(spark, sf_dir):
    store = _store(spark, "cites", cites=Table(schemas.CITES, "src_url"))
    links = G.link_edges(I.order_cites(spark, sf_dir))
    for batch in (links.filter("text < 'N'"), links):
        store.commit(lambda c, batch=batch: c.append_new("cites", batch, schemas.CITES.names))
    return store.read("cites")


@register("stored_mentions", REGISTRY["mention_edges"][1])
def stored_mentions(spark, sf_dir):
    store = _store(spark, "mentions", mentions=Table(schemas.MENTIONS, "url"))
    found = I.order_mentions(spark, sf_dir)
    for batch in (found.filter("score > 25"), found):
        store.commit(lambda c, batch=batch: c.append_new("mentions", batch, schemas.MENTIONS.names))
    return store.read("mentions")


@register("stream_stored_articles",
          f"SELECT DISTINCT url, {I.host_sql('url')} AS domain FROM pages")
def stream_stored_articles(spark, sf_dir):
    out = streams._folder(spark, "stored-stream")
    store = Store(spark, f"{out}/store")
    N.merge_pages_stream(N.table_stream(spark, f"{sf_dir}/pages.parquet", schemas.PAGES), store, f"{out}/checkpoint", once=True).awaitTermination()
    return store.read("articles").select("url", "domain")
