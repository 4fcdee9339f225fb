"""Continuous ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pressgraph import constants as K
from pressgraph import schemas
from pressgraph.functions import urls as U
from pressgraph.options import JobOptions
from pressgraph.plans.merge import merge_into
from pressgraph.sources.store import Store


def page_stream(spark: SparkSession, path: str, pattern: str = "*.parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    """Pages as they arrive in a folder."""
    reader = spark.readStream.schema(schemas.PAGES).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def table_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A stream takes a plain path for a folder; a pattern may name a file as well.
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.parquet(f"{folder}/[{name[0]}]{name[1:]}")


def domain_counts(pages: DataFrame) -> DataFrame:
    """Running number of pages per domain; works on streams and tables."""
    return pages.groupBy(U.host("url").alias("domain")).agg(F.count("*").alias("n_articles"))


def new_urls(rows: DataFrame, key: str = "url", time: str = "fetched_at",
             delay: str = "2 days") -> DataFrame:
    """First sight of each key within the watermark delay.

    State is bounded by the delay; without it a URL memo grows for ever.
    """
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def merge_stream(
    pages: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str,
    once: bool = False, every_seconds: int = K.POLL_SECONDS,
) -> StreamingQuery:
    """Run ``merge(batch, batch_id)`` for every micro-batch.

    ``merge`` must be idempotent per batch id: after a failure Spark repeats
    the last batch with the same id.  The graph merges are keyed joins, so
    repeating one changes nothing.
    """
    writer = pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{every_seconds} seconds").start()


def merge_pages_stream(
    pages: DataFrame, store: Store, checkpoint: str, name: str = "pages", options: JobOptions = JobOptions(),
    once: bool = False, every_seconds: int = K.POLL_SECONDS,
) -> StreamingQuery:
    """Merge a stream of pages into all stored tables, one commit a micro-batch.

    The store remembers the last batch of the stream ``name``, so a batch that
    Spark repeats after a failure is not merged twice.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_into(store, batch, options=options, stream=name, batch=batch_id)

    return merge_stream(pages, merge, checkpoint, once, every_seconds)


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Drain a stream into a Parquet folder and wait.

    ``complete`` results replace the folder, ``append`` results add to it.
    """
    def write(batch: DataFrame, _id: int) -> None:
        batch.write.mode("overwrite").parquet(
            target if mode == "complete" else f"{target}/batch={_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
