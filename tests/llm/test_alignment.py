"""Alignment of two tokenizers against whole encodings and all overlaps."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pressgraph.llm import alignment as A
from pressgraph.llm import queries as Q

PATHS = (Q.tokenizer_path(), Q.tokenizer_path("piece_bpe_32k.model"))
ODD = [
    "", None, " ", "\n", "\nfoo", "a\n", "  two  spaces ", "x \n y\n\nz\tq\r\n", "<|endoftext|> <s> </s> <unk>", "has ▁ inside", "▁",
    "naïve Käse 数学 \U0001f600 ½Ａ", "a\0b\x1c c\x85 d e f　g", "it's we'll I'D  don't", "word " * 40, "word\nword " * 30,
    "x" * 300, "数" * 90, "a \n\n  b", "{\n    return 1;\r\n}\n",
]


@pytest.fixture(scope="module")
def tools():
    return A.Tools(*PATHS)


def tokens(t, text):
    """[(id, begin, end)] of A and of B from whole encodings, or None if the bytes differ."""
    out = []
    raw = (" " + text).encode()
    for ids, table in ((t.a.encode(" " + text, add_special_tokens=False).ids, t.bytes_a), (t.b.encode(text), t.bytes_b)):
        if b"".join(table[i] for i in ids) != raw:
            return None
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at + len(table[i])))
            at += len(table[i])
        out.append(spans)
    return out


def by_force(t, texts):
    docs = []
    for text in texts:
        found = tokens(t, text) if text else None
        if not found:
            docs.append((0, 0, [], []))
            continue
        a, b = found
        both = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, at = [], 0
        for e in both:
            groups.append([",".join(str(i) for i, x, y in s if at < y <= e) for s in (a, b)])
            at = e
        linked = [(i, j) for i, x, y in a for j, u, v in b if x < v and u < y]
        docs.append((len(a), len(b), groups, linked))
    count = Counter(p for d in docs for p in d[3])
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [(
        n_a, n_b, len(groups), len(linked), sum(count[p] == best[p[1]] for p in linked), sum(count[p] for p in linked),
        hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if n_a else "",
    ) for n_a, n_b, groups, linked in docs]


def run(spark, texts, **more):
    df = spark.createDataFrame([(i, x, "own") for i, x in enumerate(texts)], "doc_id long, text string, row string").repartition(3)
    got = A.token_alignment(df, *PATHS, **more).collect()
    return [tuple(r)[1:] for r in sorted(got, key=lambda r: r.doc_id)]


def test_units_give_what_whole_texts_give(tools):
    assert tools.divisible
    for text in filter(None, ODD):
        keys = tools.units(text)
        whole = "".join(k if k[0] in " \n" else " " + k for k in keys)
        assert whole == " " + text
        a, _, b, _, ok = tools.encode(keys)
        assert a.tolist() == tools.a.encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:
            assert b.tolist() == tools.b.encode(text) and ok.all()
        else:
            assert not ok.all()


@pytest.mark.parametrize("size", [7, 64, A.CHUNK])
def test_odd_texts(spark, tools, size, monkeypatch):
    monkeypatch.setattr(A, "FANIN", 3)
    assert run(spark, ODD, size=size) == by_force(tools, ODD)


@pytest.mark.parametrize(("size", "known"), [(1000, 50), (A.CHUNK, A.KNOWN)])
def test_documents(spark, tools, size, known, monkeypatch):
    monkeypatch.setattr(A, "KNOWN", known)
    monkeypatch.setattr(A, "FANIN", 4)
    texts = [r.text[:6000] if r.text else r.text for r in Q.table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").limit(60).collect()]
    assert run(spark, texts, size=size) == by_force(tools, texts)


def test_query(spark, tools):
    got = Q.op13(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in Q.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    short = [r for r in got if len(docs[r.doc_id] or "") < 3000][:40]
    want = {r.doc_id: w for r, w in zip(short, by_force(tools, [docs[r.doc_id] for r in short]), strict=True)}
    for r in short:
        w = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (*w[:4], w[6])
    everything = [tokens(tools, x) for x in docs.values() if x]
    assert sum(r.n_a for r in got) == sum(len(a) for a, _ in everything) and sum(r.n_b for r in got) == sum(len(b) for _, b in everything)


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert A.token_alignment(df.limit(0), *PATHS).count() == 0
    got = A.token_alignment(df, *PATHS).collect()
    assert sorted((r.doc_id is None, r.n_a) for r in got) == [(False, 0), (True, 2), (True, 2)]


def test_composition_is_associative(tools):
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(2, 40)
        ends = [np.array(sorted({*rng.sample(range(1, n), rng.randint(0, n - 1)), n})) for _ in "ab"]
        ids = [np.arange(len(e)) for e in ends]
        stream = (ids[0], ends[0], ids[1], ends[1])
        borders = [0, *sorted(rng.sample(range(1, n), min(n - 1, 3))), n]
        parts = []
        for c, (s, e) in enumerate(zip(borders, borders[1:], strict=False)):
            frag, closed, begin = A.fragment(A._between(stream, s, e), c)
            parts.append((frag, [closed] if len(closed[0]) else []))

        def join(x, y):
            frag, seam = A.compose(x[0], y[0])
            return frag, x[1] + ([seam] if seam else []) + y[1]

        def told(x):
            frag, closed = x
            return [[y.tolist() for y in g] for g in (frag.head, *closed, frag.tail)]

        left = parts[0]
        for p in parts[1:]:
            left = join(left, p)
        right = parts[-1]
        for p in reversed(parts[:-1]):
            right = join(p, right)
        assert told(left) == told(right) and left[0].cut == right[0].cut
        whole, closed, _ = A.fragment(stream, 0)
        assert left[0].head[0].tolist() == whole.head[0].tolist() and not len(left[0].tail[0])
        assert sum(len(g[0]) for g in left[1]) == len(closed[0])
