"""Quality rules: base counts and distances against plain definitions; cases of all kinds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pressgraph.llm import quality as Q

GOOD = "the cat and the dog of the house went to the market and bought bread for the children of the town. " * 4
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(i):
    rng = random.Random(i)
    little, nouns = ["the", "and", "of", "to", "in", "a"], ["cat", "dog", "house", "market", "river", "child", "bread", "tree"]
    return " ".join(rng.choice(little if j % 2 else nouns) + (f"{rng.randrange(400)}" if j % 2 == 0 else "") + "." * (j % 9 == 8) for j in range(140))


DOCS = [(i, prose(i), "en") for i in range(40)] + [
    (100, " ".join(f"{w}### {w}$$$ &&&" for w in prose(3).split()), "en"), (101, prose(5).upper(), "en"),
    (102, " ".join(f"x{i}y{i % 7}" for i in range(900)), "en"), (103, GOOD, "en"), (104, "short text", "en"), (105, None, "en"), (106, "", None),
    (107, prose(9), None), (108, prose(10), "tlh"), (None, prose(11), "en"), (None, prose(11), "en"),
    (109, "数学 " * 300, "en"), (110, "a b c\na b c\n\n  \nd\nd\nd", "en"), (111, prose(2) + " z" * 50_000, None),
]


def by_force(text):
    text = text or ""
    words = WORDS.findall(text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = Counter(x for x in text.split("\n") if WORDS.search(x))
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(lines.values()) - len(lines), len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string").repartition(3)
    for clash in ("kind", "word", "n", "total", "raw", "kept", "n_words"):
        df = df.withColumn(clash, F.lit("own"))
    return df


def test_rules(docs):
    got = {}
    for r in Q.quality(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[None]) == 2
    for doc_id, text, _ in DOCS:
        assert tuple(got[doc_id][0])[1:7] == by_force(text), doc_id
    kept = {d: r[0].kept for d, r in got.items()}
    assert all(kept[i] for i in range(40))
    assert not any(kept[i] for i in (100, 101, 102, 103, 104, 105, 106, 109))
    assert kept[107] and kept[108] and kept[None]  # no language, one without a reference: any reference may accept


def test_empty_and_without_references(spark, docs):
    assert Q.quality(docs.limit(0)).count() == 0
    few = spark.createDataFrame([(1, prose(1), "en"), (2, prose(2), None)], "doc_id long, text string, lang string")
    assert all(r.kept == (not r.base_failed) and r.char_distance is None for r in Q.quality(few).collect())


def test_references_are_whole_counts(docs, monkeypatch):
    monkeypatch.setattr(Q, "GATHER", 10)
    found = Q.collected(Q.references(docs))
    texts = [t.encode() for _, t, g in DOCS if g == "en" and t]
    words = Counter(w for t in texts for w in Q.terms_of(t))
    assert set(found) == {"en"}
    assert found["en"].classes.tolist() == sum(Q.classes_of(t) for t in texts).tolist()
    want = {w: n for w, n in words.items() if n >= Q.COMMON * words.total()}
    assert dict(zip(found["en"].words, found["en"].counts.tolist())) == want
    assert found["en"].counts.sum() == words.total()


def test_distance():
    p, q = np.array([3, 0, 1]), np.array([1, 1, 2])

    def kl(x, y):
        return sum(a * math.log2(a / b) for a, b in zip(x, y, strict=True) if a)

    x, y = p / 4, q / 4
    m = (x + y) / 2
    assert Q.distance(p, q) == pytest.approx(math.sqrt((kl(x, m) + kl(y, m)) / 2))
    assert Q.distance(np.array([1, 0]), np.array([0, 5])) == pytest.approx(1) and Q.distance(p, 0 * p) == 0


def test_classes_cover_every_character():
    assert Q.classes_of("aZ5 .'#\0é΢Ӏאह中가\U0001f600ʀሀ☃か﻿".encode()).tolist() == [1] * len(Q.CLASSES)
    for name, (lo, hi) in Q.RANGE_CLASSES.items():
        for c in (lo, hi):
            if not 0xD800 <= c <= 0xDFFF:
                assert Q.classes_of(chr(c).encode()).tolist().index(1) == Q.CLASSES.index(name)
