"""The stored graph: tables in key-hash buckets, changed together by commits.

A table is a set of buckets by a hash of its key; a bucket is a list of folders,
each written once and never changed.  A commit names, for all tables at once,
the folders of every bucket, and becomes visible by one rename.  So

* an upsert reads and rewrites the buckets that its incoming keys fall into and
  no others, and an append (edges by anti join) adds a folder to such buckets;
* readers see all tables before a commit or all after it;
* a commit remembers the last batch of each stream, and a repeated batch, which
  Spark sends after a failure, changes nothing;
* of two writers that start from the same commit, one fails.

Buckets are found by the keys, at most ``buckets`` numbers; the manifest has one
short line for each bucket with data.  Rows are rebalanced by bucket before they
are written, so a large bucket becomes several files of like size and a small
one does not become many.  A bucket with more than FOLDERS folders is rewritten
as one by the commit that makes it so.  Null keys share a bucket.  Rows with equal
keys among the incoming count once for an upsert (see ``graph.overlay``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressgraph import schemas
from pressgraph.operators import graph as G

BUCKETS, FOLDERS = 64, 16


@dataclass(frozen=True)
class Table:
    schema: T.StructType
    key: str  # of the bucket


TABLES = {
    "articles": Table(schemas.ARTICLES, "url"),
    "domains": Table(T.StructType([T.StructField("domain", T.StringType())]), "domain"),
    "cites": Table(schemas.CITES, "src_url"),
    "mentions": Table(schemas.MENTIONS, "url"),
    "texts": Table(schemas.ARTICLE_TEXT, "id"),
    "frontier": Table(schemas.FRONTIER, "url"),
}


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


class Store:
    """Tables below ``root``; ``tables`` gives their columns and keys."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table] = TABLES, buckets: int = BUCKETS):
        self.spark, self.root, self.tables, self.buckets = spark, root.rstrip("/"), tables, buckets
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(f"{self.root}/_commits"))

    # -- commits -------------------------------------------------------------
    def version(self) -> int:
        """Number of the last commit, 0 before the first."""
        names = [f.getPath().getName() for f in self._files.listStatus(self._path(f"{self.root}/_commits"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """``{"tables": {table: {bucket: [folder, ...]}}, "streams": {stream: last batch}}`` of a commit."""
        version = self.version() if version is None else version
        if not version:
            return {"tables": {name: {} for name in self.tables}, "streams": {}}
        (row,) = self.spark.read.text(f"{self.root}/_commits/{version:012d}", wholetext=True).collect()
        found = json.loads(row.value)
        return {"tables": {name: found["tables"].get(name, {}) for name in self.tables}, "streams": found["streams"]}

    def _publish(self, version: int, manifest: dict) -> None:
        target, draft = f"{self.root}/_commits/{version:012d}", f"{self.root}/_commits/.draft-{uuid.uuid4().hex}"
        out = self._files.create(self._path(draft))
        out.write(json.dumps(manifest).encode())
        out.close()
        # A rename onto a file fails on HDFS; the check serves file systems where it replaces.
        if self._files.exists(self._path(target)) or not self._files.rename(self._path(draft), self._path(target)):
            self._files.delete(self._path(draft), False)
            raise Conflict(f"commit {version} exists")

    # -- reading ---------------------------------------------------------------
    def read(self, name: str, buckets: Sequence[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table, or only the folders of some of its buckets."""
        held = (manifest or self.manifest())["tables"][name]
        wanted = held if buckets is None else [str(b) for b in buckets if str(b) in held]
        paths = [f"{self.root}/{folder}" for b in wanted for folder in held[b]]
        if not paths:
            return self.spark.createDataFrame([], self.tables[name].schema)
        return self.spark.read.schema(self.tables[name].schema).parquet(*paths)

    def find(self, name: str, key) -> DataFrame:
        """Rows with one key: one bucket is read."""
        t = self.tables[name]
        kind = t.schema[t.key].dataType
        row = self.spark.range(1).select(F.lit(key).cast(kind).alias(t.key)).select(_bucket(t.key, self.buckets).alias("b")).first()
        return self.read(name, [row["b"]]).filter(F.col(t.key).eqNullSafe(F.lit(key).cast(kind)))

    # -- writing -----------------------------------------------------------------
    def commit(self, change: Callable[[Change], None], stream: str | None = None, batch: int | None = None) -> bool:
        """Apply ``change`` to all tables as one commit; False if ``stream`` has had this batch already."""
        version = self.version()
        manifest = self.manifest(version)
        if stream is not None and manifest["streams"].get(stream, -1) >= batch:
            return False
        made = Change(self, manifest, version + 1)
        change(made)
        made.compact()
        if stream is not None:
            manifest["streams"][stream] = batch
        self._publish(version + 1, manifest)
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last ``keep`` commits names, and older commits; gives the folders deleted."""
        last = self.version()
        live = {f.split("/bucket=")[0] for v in range(max(1, last - keep + 1), last + 1)
                for t in self.manifest(v)["tables"].values() for folders in t.values() for f in folders}
        gone = 0
        for name in self.tables:
            base = self._path(f"{self.root}/{name}")
            for f in self._files.listStatus(base) if self._files.exists(base) else []:
                if f"{name}/{f.getPath().getName()}" not in live:
                    gone += self._files.delete(f.getPath(), True)
        for f in self._files.listStatus(self._path(f"{self.root}/_commits")):
            n = f.getPath().getName()
            if n.isdigit() and int(n) <= last - keep:
                self._files.delete(f.getPath(), False)
        return gone


class Change:
    """What one commit does; reads see what it has done so far."""

    def __init__(self, store: Store, manifest: dict, version: int):
        self.store, self.manifest, self.version = store, manifest, version
        self.touched: dict[str, set[int]] = {name: set() for name in store.tables}

    def buckets_of(self, name: str, keys: DataFrame, key: str | None = None) -> list[int]:
        """Buckets of table ``name`` that the keys fall into."""
        b = _bucket(key or self.store.tables[name].key, self.store.buckets)
        return sorted(r["b"] for r in keys.select(b.alias("b")).distinct().collect())

    def read(self, name: str, buckets: Sequence[int] | None = None) -> DataFrame:
        return self.store.read(name, buckets, self.manifest)

    def _write(self, name: str, rows: DataFrame) -> dict[int, str]:
        """Write rows to a new folder; gives the folder of each bucket that has rows."""
        t, folder = self.store.tables[name], f"{name}/{self.version:012d}-{uuid.uuid4().hex[:8]}"
        (rows.select(*t.schema.names).withColumn("bucket", _bucket(t.key, self.store.buckets)).hint("rebalance", F.col("bucket"))
         .write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.store.root}/{folder}"))
        made = self.store._files.listStatus(self.store._path(f"{self.store.root}/{folder}"))
        names = [f.getPath().getName() for f in made if f.isDirectory()]
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith("bucket=")}

    def replace(self, name: str, buckets: Sequence[int], rows: DataFrame) -> None:
        """Rows that take the place of all that the buckets hold."""
        made, held = self._write(name, rows), self.manifest["tables"][name]
        for b in buckets:
            if b in made:
                held[str(b)] = [made[b]]
            else:
                held.pop(str(b), None)
        self.touched[name].update(buckets)

    def add(self, name: str, rows: DataFrame) -> None:
        """Rows beside those that are there."""
        held = self.manifest["tables"][name]
        for b, folder in self._write(name, rows).items():
            held.setdefault(str(b), []).append(folder)
            self.touched[name].add(b)

    def upsert(self, name: str, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``merge(stored, incoming)`` of the buckets that the incoming keys fall into."""
        buckets = self.buckets_of(name, incoming)
        if buckets:
            self.replace(name, buckets, merge(self.read(name, buckets), incoming))

    def append_new(self, name: str, incoming: DataFrame, key: Sequence[str]) -> None:
        """Incoming rows, one for each ``key``, that the table lacks: an anti join with the buckets in question."""
        buckets = self.buckets_of(name, incoming)
        if not buckets:
            return
        # Nulls are equal here, as they are for dropDuplicates.
        there = self.read(name, buckets).select(*[F.col(c).alias(f"_{c}") for c in key])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
        self.add(name, incoming.dropDuplicates(list(key)).join(there, same, "left_anti"))

    def compact(self) -> None:
        for name, held in self.manifest["tables"].items():
            crowded = [int(b) for b, folders in held.items() if len(folders) > FOLDERS]
            if crowded:
                self.replace(name, crowded, self.read(name, crowded))


def merge_citations(change: Change, links: DataFrame, stub_domains: bool = False) -> None:
    """CITES edges and bare articles for targets that are not stored; see ``graph.merge_citations``."""
    edges = G.link_edges(links)
    targets = edges.select(F.col("dst_url").alias("url")).distinct()
    stored = change.read("articles", change.buckets_of("articles", targets))
    stubs = G.cited_stubs(stored, edges).select(F.xxhash64("url").alias("article_id"), "url", "domain")
    for f in schemas.ARTICLES.fields[3:]:
        stubs = stubs.withColumn(f.name, F.lit(None).cast(f.dataType))
    change.append_new("articles", stubs, ["url"])
    if stub_domains:
        change.append_new("domains", G.domain_vertices(stubs), ["domain"])
    change.append_new("cites", edges, ["src_url", "dst_url", "text"])
