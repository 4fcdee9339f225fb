"""Quality rules by distribution divergence from language references.

Every language has a reference made of all its documents: the histogram of
character classes, and that of its common words (each at least COMMON of the
language's words) with one bin for all others.  A document is compared with the
reference of its own language by the Jensen-Shannon distance of both histograms
and is rejected if either exceeds its bound; without a language, or with one
that has no reference, it is kept if any reference accepts it.

Length guards: the characters are judged from LEAST_CHARS characters on, the
words from LEAST_WORDS words on; a language has a reference from LEAST_REFERENCE
words on.  Short texts stray from any histogram by chance: n drawn items in k
bins add about k / (8 n ln 2) to the divergence, and NOISE times that is added
to the square of a bound.

Three passes over the texts, none of which shuffles text.  The first gives class
counts and candidates: each task hands on the words that hold COMMON / 2 of what
it has gathered, so what it drops is less than that share of all, and at most
2 / COMMON words a language can reach COMMON.  The second counts these exactly.
References, a few kB a language, are broadcast to the third.

Base rules on words of anything but white space run beside this: too few words,
or too many in repeated three-word windows.

Defined cases: a null or empty text has no words and fails the base rules; null
and repeated ids are rows of their own; documents without a language are in no
reference; without any reference the length guards keep what the base rules keep;
an empty table gives an empty table; other columns do not matter; texts are read
whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgraph.session import materialise

#: Base rules: least words, and the greatest share of words in repeated windows.
LEAST, REPEATED = 50, 0.5
#: Share of a language's words from which a word is common; words a reference needs.
COMMON, LEAST_REFERENCE = 0.01, 1000
#: Length guards, and the greatest distances that are kept.
LEAST_CHARS, LEAST_WORDS = 200, 50
CHAR_DISTANCE, WORD_DISTANCE, NOISE = 0.25, 0.2, 3.0
#: Distinct words that a task gathers before it hands on the frequent ones.
GATHER = 300_000

#: Character classes: ASCII ones by their characters, the others by ranges of code points with one first byte in UTF-8.
ASCII_CLASSES = {
    "space": b" \t\n\x0b\x0c\r", "lower": bytes(range(0x61, 0x7B)), "upper": bytes(range(0x41, 0x5B)), "digit": b"0123456789",
    "stop": b".,;:!?", "quote": b"'\"()-", "sign": b"#*$%&|<>/@[]^_`{}~+=\\", "control": bytes([*range(9), *range(0x0E, 0x20), 0x7F]),
}
RANGE_CLASSES = {
    "latin": (0x80, 0x27F), "phonetic": (0x280, 0x37F), "greek": (0x380, 0x3FF), "cyrillic": (0x400, 0x4FF), "semitic": (0x500, 0x7FF),
    "indic": (0x800, 0xFFF), "asian": (0x1000, 0x1FFF), "symbol": (0x2000, 0x2FFF), "kana": (0x3000, 0x3FFF), "han": (0x4000, 0x9FFF),
    "hangul": (0xA000, 0xDFFF), "special": (0xE000, 0xFFFF), "astral": (0x10000, 0x10FFFF),
}
CLASSES = [*ASCII_CLASSES, *RANGE_CLASSES]
SYMBOLS = list(b"#*$%&|<>")

_CLASS_OF_BYTE = np.full(256, len(CLASSES), np.int64)  # bytes that continue a character belong to none
for _n, _chars in enumerate(ASCII_CLASSES.values()):
    _CLASS_OF_BYTE[list(_chars)] = _n
for _n, (_lo, _hi) in enumerate(RANGE_CLASSES.values(), len(ASCII_CLASSES)):
    # First bytes that no earlier range has; a range above U+FFFF starts with 0xF0 to 0xF4.
    _CLASS_OF_BYTE[chr(_lo).encode("utf-8", "surrogatepass")[0] : chr(_hi).encode("utf-8", "surrogatepass")[0] + 1] = _n
#: Lower-cases A-Z and blanks all ASCII but letters and digits.
_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 or c >= 0x80 else 0x20 for c in range(256))


def classes_of(raw: bytes) -> np.ndarray:
    """Characters of each class."""
    return np.bincount(_CLASS_OF_BYTE, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), len(CLASSES) + 1)[:-1].astype(np.int64)


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TERMS).split()


class Base(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text holds at least twice."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    window, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)[1:]
    again = np.flatnonzero(times[window] > 1)
    hit = np.zeros(len(words), bool)
    for shift in range(3):
        hit[again + shift] = True
    return int(hit.sum())


def base_of(raw: bytes, classes: np.ndarray) -> Base:
    words = raw.split()
    lines = raw.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        dup = sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.split(None, 1))
    n, again = len(words), repeat_words(words)
    symbols = sum(raw.count(s) for s in SYMBOLS)
    return Base(n, int(classes[1:].sum()), symbols, dup, again, n < LEAST or again > REPEATED * n)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors, 0 to 1; 0 if one of them is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def against(x):
        own = x > 0
        return (x[own] * np.log2(x[own] / m[own])).sum()

    return float(np.sqrt(max(0.0, (against(p) + against(q)) / 2)))


def bound(least: float, bins: int, n: int) -> float:
    """Greatest distance that is kept for ``n`` items in so many bins."""
    return float(np.sqrt(least * least + NOISE * bins / (8 * n * np.log(2))))


class Reference(NamedTuple):
    """Histograms of one language; the last of ``counts`` is all other words."""

    classes: np.ndarray
    words: list[bytes]
    counts: np.ndarray

    def distances(self, classes: np.ndarray, terms: Counter, n_terms: int) -> tuple[float, float]:
        own = [terms[w] for w in self.words]
        return distance(classes, self.classes), distance(np.array([*own, n_terms - sum(own)]), self.counts)


def _texts(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(lang_col).cast("string").alias("lang"), F.encode(F.col(text_col), "utf-8").alias("raw"))


def references(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, kind, word, n) of every language with a reference: kind ``class`` (word is the class), ``word`` or ``all``."""
    texts = _texts(df, lang_col, text_col).filter("lang IS NOT NULL AND raw IS NOT NULL")
    schema = "lang string, kind string, word string, n long"

    def rows(found):
        cols = list(zip(*found, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, [pa.string()] * 3 + [pa.int64()], strict=True)], ["lang", "kind", "word", "n"])

    def gather(batches):
        classes, words = defaultdict(lambda: np.zeros(len(CLASSES), np.int64)), defaultdict(Counter)

        def out():
            found = [(g, "class", c, int(n)) for g, x in classes.items() for c, n in zip(CLASSES, x, strict=True)]
            for g, x in words.items():
                total = x.total()
                found.append((g, "all", None, total))
                found += [(g, "word", w.decode("utf-8", "replace"), n) for w, n in x.items() if n >= COMMON / 2 * total]
            classes.clear()
            words.clear()
            return rows(found)

        for batch in batches:
            for lang, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                classes[lang] += classes_of(raw)
                words[lang].update(terms_of(raw))
            if sum(map(len, words.values())) > GATHER:
                yield out()
        yield out()

    found = materialise(texts.mapInArrow(gather, schema).groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")), "histograms")
    total = found.filter("kind = 'all'").select("lang", F.col("n").alias("total")).filter(F.col("total") >= LEAST_REFERENCE)
    likely = found.filter("kind = 'word'").join(total, "lang").filter(F.col("n") >= F.lit(COMMON / 2) * F.col("total"))
    wanted = defaultdict(set)  # at most 2 / COMMON words a language
    for r in likely.select("lang", "word").toLocalIterator():
        wanted[r["lang"]].add(r["word"].encode())
    wanted = df.sparkSession.sparkContext.broadcast(dict(wanted))

    def count(batches):
        exact = defaultdict(Counter)
        for batch in batches:
            for lang, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own := wanted.value.get(lang):
                    exact[lang].update(filter(own.__contains__, terms_of(raw)))
        yield rows([(g, "word", w.decode("utf-8", "replace"), n) for g, x in exact.items() for w, n in x.items()])

    words = texts.mapInArrow(count, schema).groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    common = words.join(total, "lang").filter(F.col("n") >= F.lit(COMMON) * F.col("total")).drop("total")
    return materialise(found.filter("kind <> 'word'").join(total.select("lang"), "lang", "left_semi").unionByName(common), "references")


def collected(found: DataFrame) -> dict[str, Reference]:
    """The references as they are broadcast: for each language some twenty classes and at most 1 / COMMON words."""
    by = defaultdict(lambda: {"class": {}, "word": {}, "all": {}})
    for r in found.toLocalIterator():
        by[r["lang"]][r["kind"]][r["word"]] = r["n"]
    out = {}
    for lang, x in by.items():
        words = sorted(x["word"])
        counts = [x["word"][w] for w in words]
        out[lang] = Reference(
            np.array([x["class"].get(c, 0) for c in CLASSES]), [w.encode() for w in words],
            np.array([*counts, x["all"][None] - sum(counts)]))
    return out


def judge(df: DataFrame, found: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(doc_id, base counts, base_failed, char_distance, word_distance, kept); distances to the nearest reference in question, null where a guard holds."""
    known = df.sparkSession.sparkContext.broadcast(collected(found))
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                      F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("raw"))
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
    names = [*Base._fields, "char_distance", "word_distance", "kept"]

    def one(lang, raw):
        classes = classes_of(raw)
        base = base_of(raw, classes)
        terms = terms_of(raw)
        n, counts = len(terms), Counter(terms)
        refs = [known.value[lang]] if lang in known.value else known.value.values()
        chars = int(classes.sum())
        long_chars, long_words = chars >= LEAST_CHARS, n >= LEAST_WORDS
        best = None
        for ref in refs:
            c, w = ref.distances(classes, counts, n)
            worst = max(c / bound(CHAR_DISTANCE, len(CLASSES), chars) if long_chars else 0,
                        w / bound(WORD_DISTANCE, len(ref.counts), n) if long_words else 0)
            if best is None or worst < best[0]:
                best = worst, c if long_chars else None, w if long_words else None
        best = best or (0.0, None, None)
        return (*base, best[1], best[2], not base.base_failed and best[0] <= 1)

    def score(batches):
        for batch in batches:
            rows = [one(*x) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", *names])

    id_type = df.schema[id_col].dataType.simpleString()
    return texts.mapInArrow(score, f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                   "n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean")


def quality(df: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``judge`` against the references of ``df`` itself."""
    return judge(df, references(df, lang_col, text_col), id_col, lang_col, text_col)
