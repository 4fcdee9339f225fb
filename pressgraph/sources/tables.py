"""Reading and writing the tables of the library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgraph import constants as K
from pressgraph import schemas
from pressgraph.functions import urls as U


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages; only the columns a query uses are read."""
    return spark.read.schema(schemas.PAGES).parquet(path)


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of HTML files as pages, one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.xxhash64(F.input_file_name()).alias("page_id"),
        F.input_file_name().alias("url"), F.col("value").alias("html"))


def supplied_or_fetched(candidates: DataFrame, fetched: DataFrame) -> DataFrame:
    """Pages by URL where HTML given with the candidate wins over stored HTML.

    Candidates without any HTML stay, with NULL.
    """
    stored = fetched.select("url", F.col("html").alias("_stored"))
    return candidates.join(stored, "url", "left").withColumn(
        "html", F.coalesce("html", "_stored")).drop("_stored")


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Feed texts, one row per file; empty feeds are dropped."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("url"), F.col("value").alias("rss")).filter("rss != ''")


def seed_sites(spark: SparkSession) -> DataFrame:
    """The fixed list of polled sites, lower-cased host, with scheme."""
    rows = [(s,) for s in K.SEED_SITES]
    return spark.createDataFrame(rows, "site string").select(U.seed_url("site").alias("url"))


def popular_sites(spark: SparkSession, path: str) -> DataFrame:
    """A text file of sites, one per line, with ``http://`` in front."""
    return spark.read.text(path).select(F.concat(F.lit("http://"), F.trim("value")).alias("url"))


def write_articles(articles: DataFrame, path: str) -> None:
    """Article table partitioned by domain bucket.

    Domains are unbounded and uneven, so files are grouped by a hash of the
    domain instead of one folder per domain; rows are spread by URL inside.
    """
    bucketed = articles.withColumn("domain_bucket", F.pmod(F.xxhash64("domain"), F.lit(256)).cast("int"))
    bucketed.write.mode("overwrite").partitionBy("domain_bucket").parquet(path)


def write_snapshot(df: DataFrame, root: str) -> str:
    """Write a new snapshot folder and return it; the old one stays readable."""
    target = f"{root.rstrip('/')}/snapshot={uuid.uuid4().hex}"
    df.write.mode("error").parquet(target)
    return target


def find_text(texts: DataFrame, id: int | None = None, url: str | None = None) -> DataFrame:
    """First stored text row by id, else by URL; nothing without a key."""
    columns = ["id", "url", "text", "html"]
    if id is not None:
        return texts.filter(F.col("id") == id).select(*columns).limit(1)
    if url:
        return texts.filter(F.col("url") == url).select(*columns).limit(1)
    return texts.select(*columns).limit(0)
