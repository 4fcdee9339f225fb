"""Ranked search: the treap against its grid, and ranks against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from pressgraph.llm import ranked as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in TERM.findall(text or "")]


def by_force(docs, items, k=20):
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n_docs, n_terms = len(found), sum(c.total() for _, c in found)
    df = Counter(w for _, c in found for w in c)
    w = {x: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for x, n in df.items()}
    out = []
    for item, text in items:
        scores = []
        for d, c in found:
            m = 75 + 25 * c.total() * n_docs // n_terms
            s = sum(w[x] * (10**9 * c[x] // (1000 * c[x] + 12 * m)) for x in terms(text) if x in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, **more):
    df = spark.createDataFrame([(d, t, "own", 1) for d, t in docs], "doc_id long, text string, item_id string, score int").repartition(4)
    q = spark.createDataFrame([(i, t, "own") for i, t in items], "item_id long, text string, doc_id string")
    return sorted(map(tuple, R.search(df, q, **more).collect()), key=repr)


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    return [(i, " ".join(words[j] for j in np.minimum(rng.zipf(1.4, rng.integers(0, 90)), 399))) for i in range(n)]


@pytest.mark.parametrize(("rows", "cols", "cells"), [(1, 1, 1), (1, 50, 20), (300, 9, 400), (70, 130, 3000), (33, 33, 1089)])
def test_treap_keeps_its_grid(rows, cols, cells):
    rng = np.random.default_rng(rows)
    at = rng.choice(rows * cols, cells, replace=False)
    value = rng.integers(1, 50, cells)
    t = R.Treap.build(at // cols, at % cols, value)
    assert len(t.row) == cells  # a node for each cell
    assert sorted(zip(t.row * cols + t.col, t.value)) == sorted(zip(at, value))
    again = R.Treap.load(t.dump())
    assert all((getattr(t, x) == getattr(again, x)).all() for x in ("row", "col", "value", "quarters", "first"))
    assert (t.value[t.parents()] >= t.value[1:]).all()
    grid = np.zeros((rows, cols), np.int64)
    grid[at // cols, at % cols] = value
    for k in (1, 3, cols + 1):
        queries = [(own := rng.choice(rows, min(rows, 6), replace=False), rng.integers(1, 9, len(own))) for _ in range(5)]
        q, col, score = t.best(queries, cols, k, np.ones(5, np.int64))
        for i, (own, w) in enumerate(queries):
            all_scores = w @ grid[own]
            cut = max(1, np.sort(all_scores)[::-1][min(k, cols) - 1])
            want = {c: s for c, s in enumerate(all_scores.tolist()) if s >= cut}
            assert dict(zip(col[q == i].tolist(), score[q == i].tolist())) == want


ITEMS = [(1, "w1 w2 w3 w50 w50 W399"), (2, "w7"), (2, "w7"), (None, "nowhere w0 w9, w11"), (3, None), (4, ""), (5, "nowhere"), (6, "é W5")]


@pytest.mark.parametrize(("split", "docs", "block", "group"), [(256, 1 << 13, 10**6, 1 << 18), (2, 20, 5, 50)])
def test_ranks(spark, monkeypatch, split, docs, block, group):
    for name, value in (("SPLIT", split), ("SHARD_DOCS", docs), ("BLOCK", block), ("BLOCK_BYTES", 10 * block), ("GROUP", group)):
        monkeypatch.setattr(R, name, value)
    odd = [(900, None), (901, ""), (902, "...é É w5"), (903, "W1 w1 " * 3000), (None, "w7 w9"), (None, "w7 w9"), (904, "w7"), (904, "w7")]
    texts = corpus(150) + odd + [(i, "w2 w3 w50") for i in range(1000, 1030)]  # ties beyond the k-th
    got = run(spark, texts, ITEMS)
    assert got == by_force(texts, ITEMS)
    assert run(spark, texts, ITEMS, k=3) == by_force(texts, ITEMS, 3)


def test_empty_tables(spark):
    assert run(spark, corpus(5), []) == [] and run(spark, [], ITEMS) == []
