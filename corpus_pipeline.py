"""The corpus pipeline: documents through five stages to a mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  A stage first deletes
the scratch tables of the one before, so write its result before calling the
next.  Null texts and texts without a letter end at the first stage; other
nulls, repeated rows, empty tables and extra columns are treated as the
operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgraph.llm import decontaminate, exact, langid, minhash, mixing
from pressgraph.llm.queries import quality_weights, table
from pressgraph.session import checkpoint_dir, release

#: A text that no language model codes below this many bits a byte is in none of the languages.
MOST_BITS = 8.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter and texts that all languages code no better than raw bytes."""
    release(spark)
    lang, _, rate = langid.result_names(docs)
    found = langid.identify(docs)
    known = (F.col(lang) != langid.UNDETERMINED) & (F.col(rate) < MOST_BITS)
    return found.filter(known).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each normalised text stays."""
    release(spark)
    return exact.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays."""
    release(spark)
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    release(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken and how often each is taken."""
    release(spark)
    return mixing.mix(docs, quality=quality_weights(spark, sf_dir)).filter("epochs > 0")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
]

#: Language models and MinHash cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        out = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
