"""Topic and stop-word queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgraph.functions import text as T
from pressgraph.operators import graph as G
from pressgraph.operators import topics as P
from pressgraph.registry import register
from pressgraph.registry import inputs as I

_PHRASE = r"\p{Lu}[\p{L}\p{N}_\-]*(?: \p{Lu}[\p{L}\p{N}_\-]*)*"
_TOKEN = (
    r"[A-Z](?:\.[A-Z])+\.?|[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*|\$?\d+(?:\.\d+)?%?"
    r"|\.\.\.|[\]\[.,;\"''?():-_`]"
)


def _terms_sql(key: str, table: str) -> str:
    return f"""
ph AS (SELECT {key}, unnest(regexp_extract_all(text, '{_PHRASE}')) AS phrase FROM {table}),
w0 AS (SELECT {key}, list_filter(string_split(lower(phrase), ' '),
         lambda w: length(w) BETWEEN 2 AND 40 AND NOT list_contains(ws, w)) AS w
       FROM ph, (SELECT ws FROM stops WHERE lang = 'en')),
tm AS (SELECT {key}, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS term FROM w0),
tc AS (SELECT {key}, term, CAST(count(*) AS INTEGER) AS score FROM tm WHERE term <> '' GROUP BY {key}, term),
topics AS (SELECT {key}, array_to_string(list_transform(regexp_extract_all(term, '\\p{{L}}+|[^\\p{{L}}]+'),
             lambda r: upper(r[1]) || lower(r[2:])), '') AS topic, score
           FROM tc WHERE (contains(term, ' ') OR score > 1) AND length(term) > 3)
"""


@register("topic_terms", f"WITH {I.stop_word_sql()}, {_terms_sql('doc_id', 'documents')} "
          "SELECT doc_id, topic, score FROM topics")
def topic_terms(spark, sf_dir):
    return P.term_counts(I.table(spark, sf_dir, "documents"))


@register("turn_topics", f"""WITH {I.stop_word_sql()},
turns AS (SELECT conv_id || ':' || turn AS id, text FROM conversations),
{_terms_sql('id', 'turns')} SELECT topic, CAST(sum(score) AS BIGINT) AS mentions, count(*) AS turns
FROM topics GROUP BY topic""")
def turn_topics(spark, sf_dir):
    turns = I.table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "text")
    return P.term_counts(turns, key="id").groupBy("topic").agg(
        F.sum("score").alias("mentions"), F.count("*").alias("turns"))


@register("topic_totals", f"""WITH {I.stop_word_sql()}, {_terms_sql('doc_id', 'documents')}
SELECT topic, count(DISTINCT (doc_id, score)) AS articles FROM topics GROUP BY topic""")
def topic_totals(spark, sf_dir):
    from pressgraph.operators import graph_queries as Q

    m = P.term_counts(I.table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "url")
    return Q.topic_counts(G.merge_mentions(m, m))


@register("text_tokens", f"""
WITH t AS (SELECT lang, unnest(regexp_extract_all(text, '{_TOKEN}')) AS token FROM documents)
SELECT lang, token, count(*) AS n FROM t GROUP BY lang, token""")
def text_tokens(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    return docs.select("lang", F.explode(P.tokens("text")).alias("token")).groupBy(
        "lang", "token").agg(F.count("*").alias("n"))


_TRIMMED = I.trim_sql("text")


@register("stopword_stats", f"""
WITH {I.stop_word_sql()}, d AS (SELECT doc_id, lang, {_TRIMMED} AS t FROM documents)
SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS INTEGER) AS n_words,
       CAST({I.count_stops_sql('t')} AS INTEGER) AS n_stop
FROM d JOIN stops USING (lang)""")
def stopword_stats(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select(
        "doc_id", "lang", T.inner_trim("text").alias("t"))
    d = d.withColumn("w", T.words("t"))
    return d.select(
        "doc_id", T.word_count("t").cast("int").alias("n_words"),
        F.when(F.col("t") == "", 0).otherwise(T.stop_word_count("w", "lang")).alias("n_stop"))


@register("stopword_usage", f"""
WITH {I.stop_word_sql()},
words AS (SELECT lang, unnest(ws) AS word FROM stops),
w AS (SELECT lang, unnest(string_split(lower(regexp_replace({_TRIMMED}, '[!-/:-@\\[-`{{-~]', '', 'g')), ' ')) AS word
      FROM documents)
SELECT lang, word, count(*) AS n FROM w JOIN words USING (lang, word) GROUP BY lang, word""")
def stopword_usage(spark, sf_dir):
    """The relational form: a small dimension joined to exploded words."""
    stops = T.stop_word_table(spark)
    d = I.table(spark, sf_dir, "documents").select("lang", F.explode(T.words(T.inner_trim("text"))).alias("word"))
    counted = d.groupBy("lang", "word").agg(F.count("*").alias("n"))
    return counted.join(stops, ["lang", "word"])


@register("sentence_lines", """
SELECT doc_id, len(replace(text, '. ', '.' || chr(10) || ' ')) AS n_chars,
       md5(replace(text, '. ', '.' || chr(10) || ' ')) AS h,
       md5(replace(replace(text, chr(10), chr(10) || chr(10)), chr(9), '')) AS tab_hash
FROM documents""")
def sentence_lines(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select(
        "doc_id", F.length(T.sentence_lines("text")).cast("long").alias("n_chars"),
        F.md5(T.sentence_lines("text")).alias("h"), F.md5(T.tab_lines("text")).alias("tab_hash"))


@register("languages", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def languages(spark, sf_dir):
    """Documents per available language."""
    known = T.available_languages(T.stop_word_table(spark))
    docs = I.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return docs.join(known, "lang", "left_semi")
