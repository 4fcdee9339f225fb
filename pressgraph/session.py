"""Session defaults for jobs, tests and benchmarks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    # Call-site capture costs milliseconds for every column function built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int = 8, memory: str = "12g", name: str = "pressgraph") -> SparkSession:
    """Single-machine session.  On a cluster use the session the platform gives."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for materialised intermediates.

    The cluster names it in ``spark.checkpoint.dir``; only a session that has
    none (tests, a laptop) gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pressgraph-ckpt-"))
    return context.getCheckpointDir()


#: Folders that materialise() and bucketed() wrote in this session, and the tables of the latter.
_WRITTEN: list[str] = []
_TABLES: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; ``release`` deletes it."""
    target = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(target)
    return target


def materialise(df, name: str):
    """Cut lineage: write once to the shared folder and read the result back.

    The written files outlive executors, so a lost executor costs one re-read
    and never the whole upstream job.
    """
    spark = df.sparkSession
    target = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def buckets(spark: SparkSession) -> int:
    """As many buckets as a shuffle has partitions; with fewer the planner would shuffle a bucketed table again."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    return max(int(parts), int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or parts))


def bucketed(df, name: str, key: str):
    """Like ``materialise``, in buckets by ``key``: joins on it shuffle their other side only.

    A frame that is not yet spread by ``key`` should be, as each task writes a file for each bucket it meets.
    """
    spark = df.sparkSession
    target = scratch_path(spark, name)
    table = target.rpartition("/")[2].replace("-", "_")
    _TABLES.append(table)
    df.write.bucketBy(buckets(spark), key).option("path", target).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def release(spark: SparkSession) -> int:
    """Delete what ``materialise`` and ``bucketed`` wrote in this session; frames that still read it end with this."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    gone = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone
