"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

A Misra-Gries summary of the digests finds those that many rows share.  Their
exact counts and winners are a small table with a proven bound, which is
broadcast, so that their rows are decided where they are and never shuffled.
All other digests go through an ordinary shuffle; none of these is frequent.

Defined cases: a null text counts as empty; null document ids sort last, so a
row with an id wins over one without; rows with equal id and equal text are
one row for ``deduplicate``, which keeps the least of them by its other
columns, while ``duplicate_groups`` lists each of them; an empty table gives an
empty table; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressgraph.llm import common as C
from pressgraph.session import materialise


def normalised(text: str = "text"):
    """Each run of white space becomes one space."""
    return F.regexp_replace(C.text_or_empty(text), C.SPACE, " ")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the normalised text in UTF-8, 32 bytes."""
    return df.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(normalised(text_col).cast("binary"), 256)).alias("digest"),
    )


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for every row."""
    rows = materialise(
        digests(df, id_col, text_col).withColumn("short", F.xxhash64("digest")), "digests")
    hot = F.broadcast(C.frequent_values(rows, "short"))
    # Exact counts of the candidates: combined before the shuffle, 2048 values at most
    # unless 64-bit hashes of digests collide.
    winners = materialise(
        rows.join(hot, "short", "left_semi").groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1").withColumn("hot", F.lit(True)), "winners")
    marked = rows.join(F.broadcast(winners), "digest", "left")
    cold = Window.partitionBy("digest")
    decided = marked.filter("hot").select("doc_id", "keep_id", "group_size", "digest")
    others = marked.filter("hot IS NULL").select(
        "doc_id", F.min("doc_id").over(cold).alias("keep_id"),
        F.count("*").over(cold).alias("group_size"), "digest")
    return decided.unionByName(others).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one for each normalised text."""
    own, keep, digest, n = C.free_names(df, "_own", "_keep", "_digest", "_rows")
    kept = (
        duplicate_groups(df, id_col, text_col).filter("kept")
        .groupBy(F.col("doc_id").alias(keep), F.col("digest").alias(digest))
        .agg(F.count("*").alias(n))
    )
    keyed = df.withColumn(own, F.unhex(F.sha2(normalised(text_col).cast("binary"), 256)))
    joined = keyed.join(kept, keyed[id_col].eqNullSafe(kept[keep]) & (keyed[own] == kept[digest]))
    single = joined.filter(F.col(n) == 1).select(*[joined[c] for c in df.columns])
    repeated = C.one_of_equal_rows(
        joined.filter(F.col(n) > 1).select(*[joined[c] for c in df.columns], own), [id_col, own]).drop(own)
    return single.unionByName(repeated)
