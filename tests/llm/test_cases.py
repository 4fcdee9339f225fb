"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import gzip

import numpy as np
import pytest

from pressgraph.llm import chat, common, decontaminate, exact, langid, minhash, mixing, repeats, tokens, toxicity, warc
from pressgraph.llm import queries as Q
from tests.llm.test_queries import near_by_force

LONG = " ".join(f"word{i % 977} and{i}" for i in range(40_000))
TEXTS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a"), (2, "alpha  beta\tgamma delta epsilon zeta", "en", "a"),
    (2, "alpha  beta\tgamma delta epsilon zeta", "en", "a"), (3, None, None, None), (4, "", "en", None), (5, "  \n ", "de", "b"),
    (None, "alpha beta gamma delta epsilon zeta", "en", "b"), (None, None, None, None), (6, LONG, "en", "c"), (7, LONG, "en", "c"),
    (8, "12 34 !!", "fr", "b"), (9, "Käse  <|endoftext|> 数 ok\x1c՘", "de", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string")
    for clash in ("k", "n", "digest", "keep_id", "size", "key", "score", "label", "row", "spans", "a", "b", "id", "taken",
                  "_rows", "_keep", "_n", "_own", "_digest", "_keep_k", "_bytes_to_code", "lang_pred", "bits_per_byte", "_rank_of_equal"):
        df = df.withColumn(clash, F.lit(f"own {clash}"))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_exact(docs, none):
    got = exact.duplicate_groups(docs).collect()
    assert len(got) == len(TEXTS)
    first = [r for r in got if r.doc_id in (1, 2)]
    assert all(r.keep_id == 1 and r.group_size == 4 for r in first)
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 8, 9]
    assert exact.duplicate_groups(none).count() == exact.deduplicate(none).count() == 0


def test_exact_repeated_row_stays_once(spark):
    df = spark.createDataFrame([(2, "x y"), (2, "x y"), (3, "x  y")], "doc_id long, text string")
    assert [tuple(r) for r in exact.deduplicate(df).collect()] == [(2, "x y")]


def test_near(docs, none):
    got = minhash.near_duplicates(docs, size=2).collect()
    assert len(got) == len(TEXTS)
    assert {r.component_id for r in got if r.n_shingles == 5} == {1}
    assert all(r.component_id == 6 for r in got if r.doc_id in (6, 7))
    assert all(r.component_id == r.doc_id and r.n_shingles == 0 for r in got if r.doc_id in (3, 4, 5))
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == [1, 3, 4, 5, 6, 8, 9]
    assert minhash.near_duplicates(none).count() == minhash.deduplicate(none).count() == 0


def test_near_repeated_ids_keep_every_group(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "e f g h"), (2, "a b c d"), (None, "i j k l"), (None, "m n o p")], "doc_id long, text string")
    kept = sorted(r.text for r in minhash.deduplicate(df, size=2).collect())
    assert kept == ["a b c d", "e f g h", "i j k l", "m n o p"]


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(3)
    for size in (0, 1, 40, 3000):
        x = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        y = np.concatenate([x[size // 5 :], rng.integers(0, 1 << 63, size // 7, np.uint64)])
        bits = sum(int(b).bit_count() for b in (minhash.parities(x) ^ minhash.parities(y)).view(np.uint64))
        assert bits <= len(np.setxor1d(x, y)) and not (minhash.parities(x) ^ minhash.parities(x[::-1])).any()


@pytest.mark.parametrize("rounds", [0, 3])
def test_near_copies_of_one_text_lose_no_link(spark, monkeypatch, rounds):
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    rng = np.random.default_rng(4)
    base, texts = [f"w{i}" for i in range(40)], []
    for i in range(90):
        words = list(base)
        for at in rng.integers(0, 40, i % 6):
            words[at] = f"x{rng.integers(0, 3)}"
        texts.append((i, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), size=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_by_force(texts, 2)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize(("edges", "writes"), [
    ([], 1), ([(1, 2), (5, 4), (5, 4), (7, 7)], 1), ([(9, 1), (9, 2), (9, 3)], 2), ([(2, 1), (3, 1), (3, 2)], 2),
])
def test_components_stop_once_all_nodes_point_to_the_least(spark, monkeypatch, edges, writes):
    """A step is some ten exchanges, each with a thread of the driver: none is taken to see that nothing changes."""
    written = []
    monkeypatch.setattr(common, "materialise", lambda df, name: written.append(name) or df.localCheckpoint())
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    least = {}
    for a, b in edges:
        if a != b:
            low = min(least.get(a, a), least.get(b, b))
            least |= {x: low for x, y in [*least.items(), (a, a), (b, b)] if y in (least.get(a, a), least.get(b, b))}
    assert got == least and len(written) == writes


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS)
    sizes = {r.source: (r.source_size, r.target) for r in got}
    total = sum(s for s, _ in sizes.values())
    assert sum(t for _, t in sizes.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s for s, t in sizes.values()) and sizes[None] == (0, 0.0)
    assert mixing.mix(none).count() == 0


def test_tokens(docs, none):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(Q.tokenizer_path())
    want = sorted((len((t or "").encode()), len(tool.encode(t or "", add_special_tokens=False).ids)) for _, t, *_ in TEXTS)
    assert sorted((r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, Q.tokenizer_path()).collect()) == want
    assert tokens.count_tokens(none, Q.tokenizer_path()).count() == 0


def test_languages(docs, none):
    got = langid.identify(docs, prefix="p_").collect()
    assert len(got) == len(TEXTS)
    assert all((r.p_lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) for r in got)
    assert langid.identify(none).count() == 0


@pytest.mark.parametrize("n", [2, 64])
def test_few_words_and_many_languages(spark, n):
    """Two rows to learn from, and more languages than one automaton holds."""
    rng = np.random.default_rng(n)
    rows, held = [(0, "hello world", "en"), (1, "hallo welt", "de")], []
    if n > 2:
        rows = []
        for g in range(n):
            words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(120)]
            texts = [" ".join(rng.choice(words, 60)) for _ in range(9)]
            rows += [(len(rows) + i, t, f"l{g:02d}") for i, t in enumerate(texts[:8])]
            held.append((texts[8], f"l{g:02d}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = df.unionByName(spark.createDataFrame([(10_000 + i, t, None) for i, (t, _) in enumerate(held)], df.schema)) if held else df
    got = {r.doc_id: r.lang_pred for r in langid.identify(asked).collect()}
    assert len(got) == len(rows) + len(held)
    assert all(got[i] == g for i, _, g in rows)
    assert sum(got[10_000 + i] == g for i, (_, g) in enumerate(held)) >= 0.95 * len(held)


def test_code_lengths_equal_plain_ppm():
    """Recursive PPM over the counts of one language, byte by byte."""
    from collections import defaultdict

    sample = [("x", b"abracadabra abba " * 20), ("y", b"zyx abba zyx " * 25)]
    trees = langid.train(sample, least=3)
    text = b"abba zyx abracadabra q"
    got = langid.code_lengths(trees, [text])[0]
    data = {lang: b"\n" + b for lang, b in sample}
    total = defaultdict(int)  # contexts of all languages decide which are known
    for b in data.values():
        for d in range(1, langid.ORDER + 1):
            for i in range(len(b) - d + 1):
                total[b[i : i + d]] += 1

    def chances(b, context):
        """Of all 256 bytes after a context, by plain recursion."""
        n = np.zeros(256)
        for i in range(len(b) - len(context)):
            if b[i : i + len(context)] == context:
                n[b[i + len(context)]] += 1
        kinds = (n > 0).sum()
        if not context:
            return np.where(n > 0, n, kinds / (256 - kinds)) / (n.sum() + kinds)
        shorter = known(b, context[1:])
        if not kinds:
            return shorter
        return np.where(n > 0, n, kinds * shorter / shorter[n == 0].sum()) / (n.sum() + kinds)

    def known(b, context):
        while context and total[context] < 3:
            context = context[1:]
        return chances(b, context)

    for i, (lang, b) in enumerate(data.items()):
        bits = sum(-np.log2(known(b, (b"\n" + text[:at])[-langid.ORDER :])[c]) for at, c in enumerate(text))
        assert got[i] == pytest.approx(bits, rel=1e-3)


def test_code_lengths_are_exact():
    import numpy as np

    trees = langid.train([("x", b"abab abab abba " * 30), ("y", b"zyx zyx yyz " * 30)], least=2)
    mass = 2.0 ** -trees.bits.reshape(len(trees.step), trees.width, 2).astype(float)
    mass[:, -1] *= 256 - (trees.width - 1)  # the last symbol stands for all bytes never seen
    assert np.allclose(mass.sum(1), 1, atol=1e-3)
    text = b"abba zyx " * 200  # segments give what one walk gives
    state, bits = trees.start, np.zeros(2)
    for c in text:
        cell = state * trees.width + trees.symbol[c]
        bits += trees.bits[cell]
        state = trees.step.ravel()[cell]
    assert np.allclose(langid.code_lengths(trees, [b"", text])[1], bits, rtol=1e-4)


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame(
        [(10, "Alpha BETA gamma, delta"), (11, None), (12, ""), (13, "word1 and1 word2 and2 word3 and3 word4 and4 word5 and5 word6 nothere"), (13, "x")],
        "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert got[(1, 6)]["items"] == ["10"] and got[(6, 80_000)]["items"] == ["13"] and got[(3, 0)]["items"] is None
    assert decontaminate.contaminated(docs, bench).count() == len(TEXTS)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.filter("doc_id IS NOT NULL").collect()) == [3, 4, 5, 8, 9]
    assert decontaminate.contaminated(docs, bench.limit(0)).filter("spans IS NOT NULL").count() == 0
    assert decontaminate.contaminated(none, bench).count() == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"word{j} and{j}" for j in range(i, i + 6))) for i in range(30)], "item_id long, text string")
    one = [tuple(r) for r in decontaminate.contaminated(docs, bench).select("doc_id", "n_words", "spans", "items").collect()]
    monkeypatch.setattr(decontaminate, "BLOCK", 20)
    many = [tuple(r) for r in decontaminate.contaminated(docs, bench).select("doc_id", "n_words", "spans", "items").collect()]
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_repeats(docs, none):
    from tests.llm.test_queries import repeats_by_force

    want = repeats_by_force([(t or "").encode() for _, t, *_ in TEXTS])
    got = repeats.remove_repeats(docs).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_partial_and_crowded(spark, monkeypatch):
    from tests.llm.test_queries import repeats_by_force

    core = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(330))
    texts = [f"{i:03d}{'xyz' * (i % 5)}{core[i % 7 :]}{i * 7919}" * (1 + i % 2) for i in range(40)] + ["ab" * 500, "\0" * 450]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(repeats_by_force([t.encode() for t in texts])))
    for crowd, shard in ((repeats.CROWD, repeats.SHARD), (3, 300), (3, repeats.SHARD)):
        monkeypatch.setattr(repeats, "CROWD", crowd)
        monkeypatch.setattr(repeats, "SHARD", shard)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df).collect()}
        assert got == want


def test_repeats_far_apart_in_one_text():
    rng = np.random.default_rng(9)
    text = bytearray(rng.integers(97, 123, 18_000_000, np.uint8).tobytes())
    passage = bytes(rng.integers(97, 123, 1000, np.uint8))
    places = (1000, 17_000_000)
    for p in places:
        text[p : p + 1000] = passage
    _, start, windows, anchor, _ = repeats.contexts([bytes(text)])
    near = [set(anchor[(start >= p) & (start + windows + 199 <= p + 1000)].tolist()) for p in places]
    assert near[0] and near[0] == near[1] and windows.sum() == len(text) - 199


def test_repeats_in_pieces(spark, monkeypatch):
    from tests.llm.test_queries import repeats_by_force

    monkeypatch.setattr(repeats, "SIDE", 700)
    core = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(900))
    texts = [f"{core[i * 37 :]}{i}{'abcde' * i}{core[: 200 + i * 31]}" for i in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(repeats_by_force([t.encode() for t in texts])))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df).collect()} == want


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (None, 1), (9, None)], "doc_id long, label int")
    machine = toxicity.fit(*toxicity.sample(docs.select("doc_id", "text"), labels))
    got = toxicity.score(docs, machine).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, toxicity.fit([])).count() == 0


def test_factorization_learns_terms_that_tell_only_in_pairs():
    """Label 1 if one of two terms is there but not both: neither tells anything alone."""
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(3000):
        a, b = (int(x) for x in rng.integers(0, 2, 2))
        others = {int(x) for x in rng.integers(100, 400, 20)}
        rows.append((sorted(others | ({7} if a else set()) | ({9} if b else set())), a ^ b))
    m = toxicity.fit(rows[:2000])
    items, owner = toxicity._flat([t for t, _ in rows[2000:]])
    at = m.place[items]
    margin = m.margin(at[at > 0], owner[at > 0], 1000)
    assert ((margin > 0) == np.array([y for _, y in rows[2000:]])).mean() >= 0.9


def test_factorization_learns_pairs():
    """Two terms that are harmless alone and toxic together."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append((sorted([1] * a + [2] * b + [int(rng.integers(10, 30))]), int(a and b)))
    m = toxicity.fit(sorted(rows))
    z = [m.margin(m.place[np.array(t)][m.place[np.array(t)] > 0], np.zeros((m.place[np.array(t)] > 0).sum(), int), 1)[0] for t in ([1], [2], [1, 2])]
    assert z[0] < 0 and z[1] < 0 and z[2] > 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a/ b", "x" * 100), (2, None, "x" * 100), (2, None, "x" * 100), (3, "http://c", None), (4, "http://d", "WARC/1.0\r\n\r\n\r\n\r\n"),
         (None, "http://e", "x" * 100), (5, "http://f", "é\0\n" * 80), (6, "u", "")], "page_id long, url string, html string").repartition(2)
    got = warc.round_trip(pages).collect()
    assert len(got) == 8 and all(r.intact and r.error is None for r in got)
    again = [r for r in got if r.record_type == "revisit"]
    assert len(again) == 3 and all(r.refers_key == "1" and r.payload_bytes == 100 for r in again)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_keeps_urls(spark):
    urls = ["http://h/é?q=数", "http://h/plain", "http://h/a b", None]
    got = warc.round_trip(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string")).collect()
    assert {r.uri for r in got} >= {*urls[:2], "http://h/a%20b"}


def test_arc_versions_and_faults(spark, tmp_path):
    two = b"2 0 me\n" + warc.FIELDS[2].encode() + b"\n"
    good = b"filedesc://t.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 t.arc %d\n" % len(two) + two + b"\n"
    good += b"http://h/ 1.2.3.4 20010203040506 text/html 200 - - 99 t.arc 5\nab\ncd\n"
    (tmp_path / "good.arc.gz").write_bytes(gzip.compress(good[:50]) + gzip.compress(good[50:]))
    (tmp_path / "cut.arc").write_bytes(good + b"http://i/ 1.2.3.4 20010203040506 text/html 200 - - 99 t.arc 500\nab")
    got = warc.read_arc(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.payload) for r in got if r.kind == "record" and not r.error) == [b"ab\ncd"] * 2
    assert [r.error for r in got if r.error] == ["500 bytes declared, 2 there"]


def test_viterbi_in_parts_is_viterbi(spark):
    import random

    random.seed(3)
    turn = [("User: hi there?", "user", True), ("more words", "user", False), ("Bot: Yes.", "assistant", True), ("Hm.", "assistant", False)]
    talk = [turn * 5 for _ in range(20)]
    model = chat.fit(talk)
    lines = [random.choice(["User: hi?", "Bot: Yes.", "more words", "Hm?", ""]) for _ in range(60)]
    scores = model.scores(lines)
    parts = [scores[i : i + 7] for i in range(0, 60, 7)]
    best = model.start + scores[0]
    for row in parts[0][1:]:
        best = (best[:, None] + model.step).max(0) + row
    ends = chat.borders(model, best, [chat.through(model, p) for p in parts[1:]])
    joined = [s for i, p in enumerate(parts) for s in chat.trace(model, p, ends[i - 1] if i else None, ends[i])]

    def likelihood(path):  # paths may tie, so their scores are compared
        return model.start[path[0]] + scores[0, path[0]] + sum(
            model.step[a, b] + scores[i + 1, b] for i, (a, b) in enumerate(zip(path, path[1:], strict=False)))

    assert likelihood(joined) == pytest.approx(likelihood(chat.trace(model, scores, None, None)))
    df = spark.createDataFrame([("c", i // 7, i, x) for i, x in enumerate(lines)], "conv string, part long, pos long, line string")
    assert chat.turns(df, model).count() == sum(s % 2 == 0 for s in joined)
    odd = spark.createDataFrame([(None, 0, 0, None), (None, 0, 0, None), ("d", 0, 1, "x" * 50_000)], "conv string, part long, pos long, line string")
    assert sum(r.n_lines for r in chat.turns(odd, chat.fit([])).collect()) == 3
    assert chat.turns(odd.limit(0), model).count() == 0
