"""Topics of a text: proper-noun phrases, normalised and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgraph import constants as K
from pressgraph.functions import text as T


def tokens(text: Column | str) -> Column:
    """Abbreviations, hyphen words, amounts, ellipses and marks, in order."""
    return F.regexp_extract_all(text, F.lit(K.TOKEN_PATTERN), F.lit(0))


def phrases(text: Column | str) -> Column:
    """Maximal runs of capitalised words."""
    return F.regexp_extract_all(text, F.lit(K.PHRASE_PATTERN), F.lit(0))


def normalise(phrase: str, lemmas: dict[str, str] | None = None) -> Column:
    """Distinct accepted words of a phrase column, lower case, in order.

    ``lemmas`` is an optional word -> base form dictionary (a small constant).
    """
    listed = ", ".join("'" + w.replace("'", "\\'") + "'" for w in T.stop_words("en"))
    kept = F.expr(
        f"array_distinct(filter(split(lower({phrase}), ' '), w -> length(w) BETWEEN "
        f"{K.MIN_TERM_WORD} AND {K.MAX_TERM_WORD} AND w NOT IN ({listed})))")
    if lemmas:
        table = F.create_map(*[F.lit(x) for pair in lemmas.items() for x in pair])
        kept = F.array_distinct(
            F.transform(kept, lambda w: F.coalesce(F.try_element_at(table, w), w)))
    return kept


def term_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lemmas: dict[str, str] | None = None
) -> DataFrame:
    """``(key, topic, score)``: kept terms with their counts per document.

    Terms are counted on the map side first, where all rows of a document
    are, so the shuffle carries one row per distinct term and never the text.
    """
    rows = docs.select(key, F.explode_outer(phrases(text)).alias("phrase"))
    terms = rows.select(key, F.array_join(normalise("phrase", lemmas), " ").alias("term"))
    counted = (
        terms.filter(F.col("term") != "").groupBy(key, "term")
        .agg(F.count("*").cast("int").alias("score"))
    )
    kept = counted.filter(
        (F.col("term").contains(" ") | (F.col("score") > 1))
        & (F.length("term") > K.MIN_TERM_CHARS))
    return kept.select(key, T.title_case("term").alias("topic"), "score")
