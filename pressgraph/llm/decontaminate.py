"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of WINDOW consecutive words (an item with
fewer words is one window).  A window is the set of its shingles of SHINGLE
words; a document contains the window only if it contains all of them, so with
the shingles ordered by rarity in the corpus the necessary prefix is the one
rarest shingle.  Documents are joined on that token only.  A meeting fixes
where the window would begin; the positional bounds ask that it lies inside
the document, the length bound that the document is long enough, and then all
its words are compared.

The join is a map-side join of the documents with the windows in blocks of
BLOCK windows, each broadcast in turn, so what is broadcast has a bound however
large the benchmark is, and no document is shuffled with its text.

Defined cases: a null or empty text, or one without words, has no windows and
is hit by none; repeated items count once; items without id count as the id '';
repeated document rows each get the result of their text; an empty benchmark
hits nothing; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressgraph.llm import common as C
from pressgraph.session import materialise

WINDOW, SHINGLE, BLOCK = 10, 3, 100_000
#: Bytes of text that are compared side by side.
SIDE = 8_000_000

#: Words are runs of these bytes after A-Z became a-z: digits, letters and all of non-ASCII.
_WORDY = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(c if c in _WORDY else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: The same words for counting: capitals are words already before they are lowered.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Tables (wid, window) of distinct windows and (wid, item_id) of the items that have them."""
    def cut(batches):
        for batch in batches:
            ids, out = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(text)
                for i in range(max(1, len(w) - size + 1) if w else 0):
                    ids.append(item)
                    out.append(b" ".join(w[i : i + size]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())], ["item_id", "window"])

    pairs = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"),
        F.encode(C.text_or_empty(text_col), "utf-8").alias("text"),
    ).mapInArrow(cut, "item_id string, window string").distinct()
    pairs = materialise(pairs, "item-windows")
    windows = materialise(
        pairs.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    return windows, pairs.join(windows, "window").select("wid", "item_id")


class Block:
    """Windows of one block as word numbers, and their shingles."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.wid = np.array([r[0] for r in rows], np.int64)
        split = [r[1].encode().split(b" ") for r in rows]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for ws in split for w in ws}))}
        if len(self.vocabulary) >= 1 << 21:
            raise ValueError("a block has too many distinct words to number them in 21 bits")
        self.length = np.array([len(ws) for ws in split], np.int64)
        self.words = np.zeros((len(rows), int(self.length.max())), np.int64)
        for i, ws in enumerate(split):
            self.words[i, : len(ws)] = [self.vocabulary[w] for w in ws]
        self.widths = sorted({min(SHINGLE, n) for n in self.length.tolist()})
        # (window, offset, shingle) of every shingle
        places = [(i, o, self.pack(self.words[i], min(SHINGLE, n))[o])
                  for i, n in enumerate(self.length.tolist()) for o in range(n - min(SHINGLE, n) + 1)]
        self.places = np.array(places, np.int64)
        self.shingles = np.unique(self.places[:, 2])
        self.by_token = None

    @staticmethod
    def pack(numbers: np.ndarray, width: int) -> np.ndarray:
        """Shingles of ``width`` words, 21 bits a word; 0 where a word is unknown."""
        n = len(numbers) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out, whole = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(width):
            part = numbers[i : i + n]
            out = (out << 21) | part
            whole &= part > 0
        # Numbers begin at 1, so shingles of fewer words are smaller than any of more words.
        return np.where(whole, out, 0)

    def order(self, seen: np.ndarray) -> None:
        """Choose of each window the rarest shingle, by ``seen`` per shingle; ties by the shingle itself."""
        rare = seen[np.searchsorted(self.shingles, self.places[:, 2])]
        rank = np.lexsort((self.places[:, 1], self.places[:, 2], rare, self.places[:, 0]))
        first = np.unique(self.places[rank, 0], return_index=True)[1]
        chosen = self.places[rank[first]]
        by = np.argsort(chosen[:, 2], kind="stable")
        self.chosen = chosen[by]
        self.tokens, self.token_at = np.unique(self.chosen[:, 2], return_index=True)
        self.token_end = np.append(self.token_at[1:], len(by))
        self.places = self.shingles = None

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts with a 0 after each, and where each text begins."""
        get, out, starts = self.vocabulary.get, [], [0]
        for t in texts:
            out += [get(w, 0) for w in words(t)]
            out.append(0)
            starts.append(len(out))
        return np.array(out, np.int64), np.array(starts, np.int64)

    def meet(self, numbers: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index in ``known``) of the shingles that are in ``known``."""
        at, which = [], []
        for width in self.widths:
            s = self.pack(numbers, width)
            p = np.flatnonzero(s)
            s = s[p]
            k = np.minimum(np.searchsorted(known, s), len(known) - 1)
            hit = known[k] == s
            at.append(p[hit])
            which.append(k[hit])
        return np.concatenate(at), np.concatenate(which)

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, window) of all windows that occur."""
        at, token = self.meet(numbers, self.tokens)
        n = self.token_end[token] - self.token_at[token]
        pick = np.repeat(self.token_at[token], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window, offset = self.chosen[pick, 0], self.chosen[pick, 1]
        begin, size = np.repeat(at, n) - offset, self.length[window]
        fits = (begin >= 0) & (begin + size <= len(numbers))  # positional and length bounds
        begin, window, size = begin[fits], window[fits], size[fits]
        same = np.ones(len(begin), bool)
        for i in range(self.words.shape[1]):
            inside = i < size
            same &= ~inside | (numbers[np.minimum(begin + i, len(numbers) - 1)] == self.words[window, i])
        return begin[same], window[same]


def _side_by_side(texts: list[bytes]):
    """Runs of texts of about SIDE bytes: (first, last)."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > SIDE or i == len(texts) - 1:
            yield first, i + 1
            first, held = i + 1, 0


def _rarity(docs: DataFrame, block: Block) -> np.ndarray:
    """How often each shingle of the block occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches):
        b = shared.value
        seen = np.zeros(len(b.shingles), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in _side_by_side(texts):
                seen += np.bincount(b.meet(b.numbers(texts[i:j])[0], b.shingles)[1], minlength=len(seen))
        k = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(seen[k])], ["shingle", "n"])

    rows = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(len(block.shingles), np.int64)  # as many as the block has
    seen[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return seen


def matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, k, spans, wids) of the documents that contain windows.

    ``docs`` has doc_id, k, text (bytes); spans are runs [first, end) of hit
    words of one block of windows.
    """
    spark = docs.sparkSession
    n_blocks = -(-windows.count() // BLOCK) or 1
    kind = docs.schema["doc_id"].dataType
    span = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("k", T.LongType()), T.StructField("spans", span),
        T.StructField("wids", T.ArrayType(T.LongType()))])
    found = []
    for number in range(n_blocks):
        rows = windows.filter(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == number).select("wid", "window").toArrow()
        if not len(rows):
            continue
        block = Block(sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)))
        block.order(_rarity(docs, block))
        shared = spark.sparkContext.broadcast(block)

        def join(batches, shared=shared):
            b = shared.value
            for batch in batches:
                texts, take, spans, wids = batch.column(2).to_pylist(), [], [], []
                for i, j in _side_by_side(texts):
                    numbers, starts = b.numbers(texts[i:j])
                    begin, window = b.hits(numbers)
                    step = np.zeros(len(numbers) + 1, np.int64)
                    np.add.at(step, begin, 1)
                    np.add.at(step, begin + b.length[window], -1)
                    hit = np.concatenate([[0], np.cumsum(step) > 0, [0]])
                    turn = np.diff(hit.astype(np.int8))
                    a, e = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
                    span_doc = np.searchsorted(starts, a, "right") - 1
                    window_doc = np.searchsorted(starts, begin, "right") - 1
                    for d in np.unique(span_doc).tolist():
                        take.append(i + d)
                        m = span_doc == d
                        spans.append([{"a": x, "b": y} for x, y in zip((a[m] - starts[d]).tolist(), (e[m] - starts[d]).tolist(), strict=True)])
                        wids.append(np.unique(b.wid[window[window_doc == d]]).tolist())
                at = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at),
                     pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                     pa.array(wids, pa.list_(pa.int64()))], ["doc_id", "k", "spans", "wids"])

        found.append(docs.select("doc_id", "k", "text").mapInArrow(join, schema))
    return C.union_all(found) if found else spark.createDataFrame([], schema)


def merged(spans):
    """Runs of the union of spans, as an array of [a, b)."""
    def add(runs, s):
        last = F.try_element_at(runs, F.lit(-1))
        grown = F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(
            F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when(last.isNull() | (s["a"] > last["b"]), F.concat(runs, F.array(s))).otherwise(grown)

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), add)


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """(doc_id, k, n_words, spans, items) for every row; k is a hash of its text, items are sorted as strings."""
    docs = df.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("k"),
        F.encode(C.text_or_empty(text_col), "utf-8").alias("text"),
        F.regexp_count(C.text_or_empty(text_col), F.lit(WORD_PATTERN)).cast("long").alias("n_words"))
    windows, owners = item_windows(benchmark, item_col, item_text, size)
    found = materialise(matches(docs.select("doc_id", "k", "text"), windows), "matches")
    spans = found.groupBy("doc_id", "k").agg(F.flatten(F.collect_list("spans")).alias("spans")).withColumn(
        "spans", merged(F.col("spans")))
    items = (
        found.select("doc_id", "k", F.explode("wids").alias("wid")).join(owners, "wid")
        .groupBy("doc_id", "k").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    both = spans.join(items, C.same(spans, items, ("doc_id", "doc_id"), ("k", "k"))).select(
        spans["doc_id"].alias("_id"), spans["k"].alias("_k"), "spans", "items")
    rows = docs.select("doc_id", "k", "n_words")
    return rows.join(both, rows["doc_id"].eqNullSafe(both["_id"]) & (rows["k"] == both["_k"]), "left").drop("_id", "_k")


def n_hit():
    return F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"]), F.lit(0))


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that no window hits, with all their columns."""
    bad = contaminated(df, benchmark, id_col, text_col).filter("spans IS NOT NULL").select(
        F.col("doc_id").alias("_bad"), F.col("k").alias("_bad_k")).distinct()
    return df.join(bad, df[id_col].eqNullSafe(bad["_bad"]) & (F.xxhash64(df[text_col]) == bad["_bad_k"]), "left_anti")
