"""Text column functions: white space, entities, word statistics."""

from __future__ import annotations

import glob
import os
import zipfile
from functools import cache
from html.entities import name2codepoint

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgraph import constants as K
from pressgraph.functions.binding import let

#: White space that is not one single space already.
SPACE = r"[\t\n\x0B\f\r][ \t\n\x0B\f\r]*+| [ \t\n\x0B\f\r]++"
PUNCTUATION = r"[!-/:-@\[-`{-~]++"

# Language codes of the stop-word lists that ship with Spark.
STOP_WORD_LISTS = {
    "da": "danish", "de": "german", "en": "english", "es": "spanish", "fi": "finnish",
    "fr": "french", "hu": "hungarian", "it": "italian", "nb": "norwegian", "nl": "dutch",
    "nn": "norwegian", "no": "norwegian", "pt": "portuguese", "ru": "russian", "sv": "swedish",
    "tr": "turkish",
}
LANGUAGES = tuple(sorted({*STOP_WORD_LISTS, *K.OWN_STOP_WORDS}))
DEFAULT_LANGUAGE = "en"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def inner_trim(text: Column | str) -> Column:
    """White space folded to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(_col(text), SPACE, " "))


def _code_point(cp: Column) -> Column:
    valid = cp.between(1, 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    safe = F.when(valid, cp).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(safe.cast("long")), 8, "0")), "UTF-32")


def _entity_table() -> Column:
    """Named entities as one constant map; folded to a literal by the planner."""
    pairs = "\u0002".join(f"{n}\u0001{chr(c)}" for n, c in name2codepoint.items())
    return F.str_to_map(F.lit(pairs), F.lit("\u0002"), F.lit("\u0001"))


def unescape(text: Column | str) -> Column:
    """Decode named and numeric HTML entities."""
    return let(_col(text), lambda t: F.when(t.contains("&"), _decoded(t)).otherwise(t))


def _decoded(text: Column) -> Column:
    names = _entity_table()
    pieces = F.regexp_extract_all(
        text, F.lit(r"&#[xX]?[0-9a-fA-F]{1,7};|&[a-zA-Z][a-zA-Z0-9]*;|[^&]+|&"), F.lit(0)
    )

    def one(p: Column) -> Column:
        body = F.regexp_extract(p, r"^&#?[xX]?([0-9a-zA-Z]+);$", 1)
        return (
            F.when(~p.startswith("&") | (p == "&"), p)
            .when(p.rlike("^&#[xX]"), _code_point(F.conv(body, 16, 10).cast("long")))
            .when(p.rlike("^&#[0-9]+;$"), _code_point(body.try_cast("long")))
            .otherwise(F.coalesce(F.try_element_at(names, body), p))
        )

    return F.array_join(F.transform(pieces, one), "")


def replace_all(text: Column | str, *pairs: tuple[str, str]) -> Column:
    """Literal replacements applied in order."""
    out = _col(text)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def tab_lines(text: Column | str) -> Column:
    """Newlines doubled, tabs removed."""
    return replace_all(text, ("\n", "\n\n"), ("\t", ""))


def sentence_lines(text: Column | str) -> Column:
    return replace_all(text, (". ", ".\n "))


def title_case(text: Column | str) -> Column:
    """First letter after any non-letter upper, the rest lower."""
    runs = F.regexp_extract_all(_col(text), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                             F.lower(F.substring(r, 2, 1 << 20)))), "")


# --- words and stop words --------------------------------------------------

@cache
def stop_words(lang: str) -> tuple[str, ...]:
    """The public list of a language, else the package's own; an unknown language has none.

    The public lists are resources of Spark's ML jar and are read from it directly,
    so they are available before a session exists.
    """
    name = STOP_WORD_LISTS.get(lang)
    if name is None:
        return tuple(sorted(set(K.OWN_STOP_WORDS.get(lang, "").split())))
    for home in (os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)):
        for jar in glob.glob(f"{home}/jars/spark-mllib_*.jar") if home else ():
            with zipfile.ZipFile(jar) as z:
                raw = z.read(f"org/apache/spark/ml/feature/stopwords/{name}.txt").decode()
            return tuple(sorted({w.strip().lower() for w in raw.splitlines() if w.strip()}))
    from pyspark.ml.feature import StopWordsRemover

    return tuple(sorted({w.lower() for w in StopWordsRemover.loadDefaultStopWords(name)}))


def stop_word_table(spark: SparkSession) -> DataFrame:
    """Dimension ``(lang, word)``; a few thousand rows whatever the data size."""
    rows = [(lang, w) for lang in LANGUAGES for w in stop_words(lang)]
    return spark.createDataFrame(rows, "lang string, word string")


def available_languages(table: DataFrame) -> DataFrame:
    return table.select("lang").distinct()


def strip_punctuation(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), PUNCTUATION, "")


def words(text: Column | str, lang: Column | str | None = None) -> Column:
    """Candidate words: punctuation removed, lower case, cut at single spaces.

    Chinese, which has no spaces, is cut into its characters, other scripts
    within it into runs.  Arabic loses its vowel signs and keeps punctuation
    marks apart from words.  Every other language uses the plain cut.
    """
    t = _col(text)
    plain = F.split(F.lower(strip_punctuation(t)), " ")
    if lang is None:
        return plain
    code = _col(lang)
    signs = F.regexp_extract_all(F.lower(t), F.lit(r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))
    bare = F.regexp_replace(t, "[\u0640\u064B-\u0652]", "")
    marks = F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"), F.lit(0))
    return F.when(code == "zh", signs).when(code == "ar", marks).otherwise(plain)


def _is_stop_word(lang: str) -> str:
    """SQL test of a word ``w``: listed, or listed once what the script joins to it is cut off.

    Korean particles end a word and are listed themselves; Arabic conjunctions
    of one letter begin it.
    """
    listed = "(" + ", ".join("'" + w.replace("'", "\\'") + "'" for w in stop_words(lang)) + ")"
    if lang == "ko":
        return f"w IN {listed} OR (length(w) > 2 AND right(w, 2) IN {listed}) OR (length(w) > 1 AND right(w, 1) IN {listed})"
    if lang == "ar":
        return f"w IN {listed} OR (left(w, 1) IN ('و', 'ف') AND substr(w, 2) IN {listed})"
    return f"w IN {listed}"


@cache
def _stop_word_case(words_column: str, lang_column: str, languages: tuple[str, ...]) -> str:
    cases = []
    for name in languages:
        cases.append(f"WHEN '{name}' THEN filter({words_column}, w -> {_is_stop_word(name)})")
    return f"CASE {lang_column} {' '.join(cases)} ELSE CAST(array() AS array<string>) END"


def stop_words_found(
    words_column: str, lang_column: str, languages: tuple[str, ...] = LANGUAGES
) -> Column:
    """Words of a list column that are stop words of ``lang`` (none when unknown).

    The lists are constants of the plan and the test runs inside the
    projection, so counting needs neither a join nor an explode of the text.
    """
    return F.expr(_stop_word_case(words_column, lang_column, languages))


def stop_word_count(
    words_column: str, lang_column: str, languages: tuple[str, ...] = LANGUAGES
) -> Column:
    return F.size(stop_words_found(words_column, lang_column, languages))


def word_count(text: Column | str) -> Column:
    """Pieces at single spaces; 0 for empty text."""
    t = _col(text)
    return F.when(t.isNull() | (t == ""), F.lit(0)).otherwise(F.size(F.split(t, " ")))


def space_count(text: Column | str) -> Column:
    t = _col(text)
    return F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
