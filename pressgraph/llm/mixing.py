"""Mixing sources to target weights (DataFrame functions only).

Efraimidis-Spirakis sampling without replacement: a document with quality
weight w gets the exponential key -ln(u) / w, where u is uniform and drawn from
a hash of the document, so that reruns agree.  Sorting a source by key and
taking documents until the budget is met is a weighted sample.

A source's target is met by complete epochs (every document once) first; the
rest is a fraction of an epoch, taken in key order.  The prefix sums need no
sort of a whole source: sizes are summed in SLOTS ranges of the key, the one
range in which the budget ends is split again, and only the rows of the last
range are sorted.  Earlier ranges are taken whole and later ones not at all.

Defined cases: a null or empty text has size 0 and is never taken; a null
source is a source of its own, the last; a null, negative, NaN or infinite
weight counts as 1 and a weight of 0 as the least weight; rows with equal id,
text and weight tie and are ranked one after the other; an empty table gives an
empty table; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgraph.llm import common as C
from pressgraph.session import materialise

#: Source weights by code point order of the source, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Share of all sizes that the mix takes, and the most epochs of a source.
SHARE = 1.5
MOST_EPOCHS = 2.0
#: Ranges of the key in each of the two levels.
SLOTS = 256
LEAST_WEIGHT = 1e-6


def word_count(text: str = "text") -> Column:
    return F.regexp_count(C.text_or_empty(text), F.lit(C.WORD)).cast("long")


def uniform(*parts) -> Column:
    """In (0, 1], from a hash of the parts: 52 bits of an MD5."""
    joined = F.concat_ws(":", *parts)
    return (F.conv(F.substring(F.md5(joined.cast("binary")), 1, 13), 16, 10).cast("double") + 1) / float(2**52)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source.

    Weighted shares of the whole budget; a target stops at ``most`` times its
    source's size and the excess is shared again by weight.  With sources
    sorted by cap over weight those that stop come first, so the level that
    the others reach follows from running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn(
        "weight", F.element_at(listed, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("cap", most * F.col("source_size"))
    rise = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = rise.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn(
        "level",
        (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))),
    )
    # The first source whose cap is not below its level fixes the level of all after it.
    fixed = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(
        (F.col("cap") / F.col("weight")).alias("ratio"), "level"))).over(every)
    return s.select(
        "source", "source_size",
        F.when(fixed.isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap"), fixed["level"] * F.col("weight"))).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        quality: DataFrame | None = None, seed: str = "mix", weights=WEIGHTS, share: float = SHARE,
        most: float = MOST_EPOCHS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, epochs) for every row.

    ``quality`` is a table (doc_id, weight) of document weights; of several
    weights of a document the mean counts, and without one it is 1.  ``taken``
    counts the words the mix takes of the row, ``epochs`` how often it is taken.
    """
    rows = df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
        (-F.log(uniform(F.lit(seed), F.col(id_col).cast("string"), F.md5(C.text_or_empty(text_col).cast("binary"))))
         ).alias("draw"))
    w = F.lit(1.0)
    if quality is not None:  # joined to rows that no longer carry their text
        q = quality.groupBy("doc_id").agg(F.avg(F.col("weight").cast("double")).alias("weight"))
        rows = rows.join(q, "doc_id", "left")
        w = F.coalesce("weight", F.lit(1.0))
    w = F.when(F.isnan(w) | (w < 0) | (w > 1e300), 1.0).otherwise(F.greatest(w, F.lit(LEAST_WEIGHT)))
    rows = rows.select("doc_id", "source", "size", (F.col("draw") / w).alias("key"))
    # 1 - exp(-key) spreads keys evenly over [0, 1) and keeps their order.
    place = F.least((1 - F.exp(-F.col("key"))) * SLOTS, F.lit(SLOTS - 1e-9))
    rows = rows.withColumn("slot", F.floor(place).cast("int")).withColumn(
        "sub", F.least(F.floor((place - F.floor(place)) * SLOTS), F.lit(SLOTS - 1)).cast("int"))
    rows = materialise(rows, "mix-rows")

    slots = materialise(rows.groupBy("source", "slot").agg(F.sum("size").alias("words")), "mix-slots")
    sizes = slots.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).withColumn(
        "full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    targets = materialise(targets, "mix-targets")

    def where(parts: DataFrame, part: str, base: Column) -> DataFrame:
        """The part of each source in which its rest ends, and the words before that part."""
        before = F.sum("words").over(
            Window.partitionBy("source").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
        held = parts.withColumn("before", base + F.coalesce(before, F.lit(0)))
        return held.filter("before <= rest AND rest < before + words").select("source", part, "before")

    t = targets.select("source", "rest")
    first = where(slots.join(t, C.same(slots, t, ("source", "source"))).drop(t["source"]), "slot", F.lit(0))
    first = materialise(first.withColumnRenamed("before", "base"), "mix-first")
    inner = rows.join(first, C.same(rows, first, ("source", "source"), ("slot", "slot"))).select(
        rows["source"], "sub", "size", "base")
    subs = inner.groupBy("source", "sub").agg(F.sum("size").alias("words"), F.max("base").alias("base"))
    subs = subs.join(t, C.same(subs, t, ("source", "source"))).drop(t["source"])
    second = where(subs, "sub", F.col("base")).withColumnsRenamed({"before": "at", "sub": "cut_sub"})
    f = first.select(F.col("source").alias("_source"), F.col("slot").alias("cut_slot"))
    cuts = materialise(
        second.join(f, second["source"].eqNullSafe(f["_source"])).drop("_source"), "mix-cuts")
    c = cuts.withColumnRenamed("source", "_cut")
    # One row for each source, read back from its files: the planner broadcasts it by its size, or splits hot sources.
    plan = targets.join(c, targets["source"].eqNullSafe(c["_cut"]), "left").drop("_cut").withColumnRenamed(
        "source", "_source")
    marked = rows.join(plan, rows["source"].eqNullSafe(plan["_source"])).drop("_source").withColumn(
        "side", F.when(F.col("cut_slot").isNull(), 1)  # the rest is nothing: no document more
        .when(F.col("slot") != F.col("cut_slot"), F.signum(F.col("slot") - F.col("cut_slot")).cast("int"))
        .otherwise(F.signum(F.col("sub") - F.col("cut_sub")).cast("int")))
    whole = marked.filter("side <> 0").withColumn("extra", F.when(F.col("side") < 0, 1).otherwise(0))
    run = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(
        Window.unboundedPreceding, -1)
    edge = marked.filter("side = 0").withColumn("ahead", F.col("at") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    # The document on which the budget ends is taken if that comes nearer to it.
    edge = edge.withColumn("extra", F.when(F.col("ahead") + F.col("size") / 2 < F.col("rest"), 1).otherwise(0)).drop("ahead")
    epochs = (F.col("full") + F.col("extra")).cast("long")
    return whole.unionByName(edge).select(
        "doc_id", "size", "source_size", "target", (epochs * F.col("size")).alias("taken"), "source",
        epochs.alias("epochs"))
