"""Helpers that several operators share: row keys, scratch tables, frequent values, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgraph.session import materialise

#: White space of the operators: [\x20\x09-\x0D].
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: The frequent-items sketch keeps this many counters; FREQUENT values are read from it.
COUNTERS = 8192
FREQUENT = 2048


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it from being a column of ``df``."""
    own = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in own:
            name = "_" + name
        own.add(name.lower())
        out.append(name)
    return out


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def frequent_values(df: DataFrame, name: str) -> DataFrame:
    """Distinct values of a LONG column that may exceed 1/1024 of all rows, 2048 at most.

    Spark's ``approx_top_k`` is a Misra-Gries summary: each task keeps COUNTERS
    counters and lowers them all when they are used up, and summaries merge.
    Its error is below 1/4000 of the rows, so no value over 1/1024 is missed.
    Values are candidates: callers count them exactly.  Nulls are ignored.
    """
    found = df.filter(F.col(name).isNotNull()).agg(
        F.expr(f"approx_top_k({name}, {FREQUENT}, {COUNTERS})").alias("top"))
    return found.select(F.explode("top").alias("top")).select(F.col("top.item").alias(name))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of undirected ``edges``; root is the least node it reaches.

    Alternating large-star and small-star steps: every node points to the least
    of its neighbours, until all do, which one count over the nodes tells.  A step
    is an aggregate and an equi-join, both of which combine or split hot nodes.
    Each step is written to the shared folder, which cuts the lineage.

    The driver keeps threads of exchanges for a minute, so on small tables each
    step counts, however few its rows.
    """
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u <> v").distinct()
    )
    links = materialise(links, "star")

    def star(links: DataFrame, both: bool) -> DataFrame:
        near = links
        if both:
            near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = near.join(least.hint("merge"), "u")  # a broadcast would pass the driver
        if both:  # large star: larger neighbours point to the least
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # small star: a node and its smaller neighbours point to the least
            out = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        return out.filter("u <> v").distinct()

    def settled(links: DataFrame) -> bool:
        """Every node that points to another does so once, and nothing points to it."""
        ends = links.select("u", F.lit(1).alias("up")).unionByName(links.select(F.col("v").alias("u"), F.lit(0).alias("up")))
        return ends.groupBy("u").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).filter("ups > 0 AND n > 1").isEmpty()

    while not settled(links):
        links = materialise(star(star(links, True), False), "star")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def one_of_equal_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each group with equal ``keys`` (nulls equal), the least by all sortable columns."""
    (rank,) = free_names(df, "_rank_of_equal")
    order = [F.col(c).asc_nulls_last() for c, kind in df.dtypes if c not in keys and not kind.startswith("map")]
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*(order or [F.lit(0)]))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def same(left: DataFrame, right: DataFrame, *pairs: tuple[str, str]):
    """Null-safe equality of columns, for joins."""
    return reduce(lambda x, y: x & y, (left[a].eqNullSafe(right[b]) for a, b in pairs))
