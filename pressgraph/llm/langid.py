"""Language identification by prediction by partial matching (PPM).

One byte context tree per language, of variable order: a context of up to ORDER
bytes is a node if it was seen often enough.  A byte seen after a context has
probability n / (N + q), where N counts the context and q its distinct bytes;
the escape probability q / (N + q) is shared among all other bytes as the next
shorter context foretells them, seen bytes excluded.  So each context gives a
full distribution and -log2 is an exact code length.  Statistics are frozen:
scoring never learns.  A text gets the language whose trees code it shortest.

Because the statistics are frozen, the trees are a finite automaton: a state is
the longest known context, and a table holds next state and code lengths of all
languages of a group.  Texts are coded in segments, many side by side; a segment
first reads the ORDER bytes before it, which fix its state, so cutting changes
nothing.

Training reads a bounded sample (parameter): about CHUNKS pieces of CHUNK
characters a language, drawn by hash from whole texts.  GROUP languages by name
share an automaton of at most CELLS cells, so memory is bounded for each group
and the contexts of a language do not depend on how many groups there are; a task
codes its texts with one group after the other and holds one at a time.  Scoring
reads every byte of every text.

Defined cases: a null text or one without a letter is ``und`` with score 0;
null labels are not learned; null or repeated ids and other columns do not
matter; ties go to the first language by name; with nothing to learn from,
every text is ``und``; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressgraph.llm import common as C

ORDER = 4
CHUNK, CHUNKS = 2048, 256
#: Languages of a group; cells of its automaton (states x symbols x languages) at most, and the least count of a context.
GROUP, CELLS, LEAST = 8, 12_000_000, 6
#: Contexts that training handles at once.
ROWS = 2048
#: Bytes that are coded side by side at once, and bytes of a segment.
BLOCK, SEGMENT = 4_000_000, 256
UNDETERMINED = "und"


@dataclass
class Trees:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol
    step: np.ndarray  # state x symbol -> state
    bits: np.ndarray  # (state x symbol) x language -> code length
    start: int

    @property
    def width(self) -> int:
        return self.step.shape[1]


def training_sample(df: DataFrame, label: Column, text_col: str, learn: Column, chunks: int = CHUNKS) -> list[tuple[str, bytes]]:
    """About ``chunks`` pieces of text a language, drawn by a hash of text and place."""
    rows = df.select(label.alias("lang"), F.col(text_col).alias("text")).filter(
        learn & F.col("lang").isNotNull() & (F.length("text") > 0))
    n = F.ceil(F.length("text") / CHUNK).cast("int")
    sizes = rows.groupBy("lang").agg(F.sum(n).alias("n")).select(F.col("lang").alias("of"), (F.lit(float(chunks)) / F.col("n")).alias("share"))
    drawn = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.pmod(F.xxhash64("text", i), F.lit(1 << 30)) < F.lit(float(1 << 30)) * F.col("share"))
    cut = rows.join(F.broadcast(sizes), F.col("lang") == F.col("of")).select("lang", F.explode(F.transform(
        drawn, lambda i: F.substring(F.col("text"), i * CHUNK + 1, F.lit(CHUNK)))).alias("piece"))
    found = cut.select("lang", F.encode("piece", "utf-8").alias("piece")).toArrow()
    return sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))


def coded(seen: np.ndarray, shorter: np.ndarray | None, rare: int) -> np.ndarray:
    """Code lengths of all symbols after some contexts, from counts and the code lengths after the next shorter contexts.

    The last symbol stands for ``rare`` bytes, each of its probability.
    """
    total, kinds = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
    back = np.ones((1, seen.shape[1])) if shorter is None else 2.0 ** -shorter.astype(np.float64)
    mass = back.copy()
    mass[:, -1] *= max(1, rare)
    open_mass = np.where(seen > 0, 0.0, mass).sum(1, keepdims=True)
    escape = np.where(open_mass > 1e-12, kinds / np.maximum(1, total + kinds), 0.0)
    p = np.where(seen > 0, seen / np.maximum(1, total) * (1 - escape), escape * back / np.maximum(open_mass, 1e-12))
    if shorter is not None:
        p = np.where(total > 0, p, back)
    elif not total.any():
        p = back / open_mass
    return -np.log2(np.maximum(p, 2.0**-40))


def train(sample: list[tuple[str, bytes]], order: int = ORDER, cells: int = CELLS, least: int = LEAST) -> Trees | None:
    if not sample:
        return None
    languages = sorted({lang for lang, _ in sample})
    data = [np.frombuffer(b"\n" + b"\n".join(p for lang, p in sample if lang == name), np.uint8) for name in languages]
    present = np.zeros(256, bool)
    present[10] = True
    for x in data:
        present[x] = True
    rare = int(256 - present.sum())  # bytes never seen share the last symbol
    symbol = np.full(256, present.sum(), np.int64)
    symbol[present] = np.arange(present.sum())
    width = int(present.sum()) + 1
    texts = [symbol[x] for x in data]

    def grams(x: np.ndarray, n: int) -> np.ndarray:
        key = np.zeros(max(0, len(x) - n + 1), np.int64)
        for i in range(n):
            key = key * width + x[i : len(x) - n + 1 + i]
        return key

    # Contexts of all languages; the least count rises until the automaton fits.
    counted = [np.unique(np.concatenate([grams(x, d) for x in texts]), return_counts=True) for d in range(1, order + 1)]
    room = max(1, cells // (width * len(languages)))
    while sum(int((c >= least).sum()) for _, c in counted) > room:
        least = least + max(1, least // 4)
    nodes = [np.zeros(1, np.int64)] + [k[c >= least] for k, c in counted]
    first = np.concatenate([[0], np.cumsum([len(k) for k in nodes])])
    states = int(first[-1])

    def place(keys: np.ndarray, d: int) -> np.ndarray:
        """State of the longest suffix (of at most d symbols) that is a node."""
        out = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for o in range(d, 0, -1):
            k = keys[left] % width**o
            at = np.searchsorted(nodes[o], k)
            hit = nodes[o][np.minimum(at, len(nodes[o]) - 1)] == k if len(nodes[o]) else np.zeros(len(k), bool)
            out[left[hit]] = first[o] + at[hit]
            left = left[~hit]
        return out

    step = np.zeros((states, width), np.int32)
    bits = np.zeros((len(languages), states, width), np.float32)
    every = np.arange(width)
    for o, keys in enumerate(nodes):
        after = [np.unique(grams(x, o + 1), return_counts=True) for x in texts]
        for lo in range(0, len(keys), ROWS):
            some = keys[lo : lo + ROWS]
            here = slice(first[o] + lo, first[o] + lo + len(some))
            longer = (some[:, None] * width + every[None, :]).ravel()
            step[here] = place(longer, min(order, o + 1)).reshape(len(some), width)
            shorter = place(some, o - 1) if o else None
            for i, (k, n) in enumerate(after):
                a, z = np.searchsorted(k, [some[0] * width, (some[-1] + 1) * width])
                k, n = k[a:z], n[a:z]
                at = np.searchsorted(some, k // width)
                ok = some[np.minimum(at, len(some) - 1)] == k // width
                seen = np.zeros((len(some), width))
                seen[at[ok], k[ok] % width] = n[ok]
                bits[i, here] = coded(seen, None if shorter is None else bits[i, shorter], rare)
    start = int(step[0, symbol[10]])
    return Trees(languages, symbol.astype(np.uint8), step, np.ascontiguousarray(bits.transpose(1, 2, 0)).reshape(-1, len(languages)), start)


def train_groups(sample: list[tuple[str, bytes]]) -> list[Trees]:
    """The trees of each GROUP languages by name."""
    languages = sorted({lang for lang, _ in sample})
    groups = [set(languages[i : i + GROUP]) for i in range(0, len(languages), GROUP)]
    return [train([x for x in sample if x[0] in group]) for group in groups]


def code_lengths(trees: Trees, texts: list[bytes]) -> np.ndarray:
    """Bits of each text in each language, coded segment by segment side by side."""
    out = np.zeros((len(texts), len(trees.languages)))
    sizes = np.array([len(t) for t in texts], np.int64)
    sym = trees.symbol[np.frombuffer(b"".join(texts), np.uint8)]
    pieces = (sizes + SEGMENT - 1) // SEGMENT
    owner = np.repeat(np.arange(len(texts)), pieces)
    if not len(owner):
        return out
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(np.cumsum(sizes) - sizes, pieces) + number * SEGMENT
    length = np.minimum(SEGMENT, sizes[owner] - number * SEGMENT)
    rank = np.argsort(-length, kind="stable")
    owner, number, begin, length = owner[rank], number[rank], begin[rank], length[rank]
    step, width = trees.step.ravel(), trees.width
    state = np.zeros(len(owner), np.int64)
    inner = number > 0
    for back in range(ORDER, 0, -1):
        state[inner] = step[state[inner] * width + sym[begin[inner] - back]]
    state[~inner] = trees.start
    total = np.zeros((len(owner), len(trees.languages)), np.float32)
    active = np.searchsorted(-length, -np.arange(SEGMENT), side="left")
    for i in range(int(length.max())):
        n = active[i]
        cell = state[:n] * width + sym[begin[:n] + i]
        total[:n] += np.take(trees.bits, cell, axis=0)
        state[:n] = step[cell]
    for j in range(total.shape[1]):
        out[:, j] = np.bincount(owner, total[:, j], len(texts))
    return out


def result_names(df: DataFrame, prefix: str = "") -> list[str]:
    """Names of lang_pred, score and bits_per_byte: after ``prefix``, and after underscores where ``df`` has such a column."""
    return C.free_names(df, *(prefix + x for x in ("lang_pred", "score", "bits_per_byte")))


def identify(df: DataFrame, lang_col: str = "lang", text_col: str = "text", learn: Column | None = None,
             prefix: str = "") -> DataFrame:
    """All columns of ``df`` and lang_pred, score, bits_per_byte, named as ``result_names`` says.

    ``learn`` marks the rows whose labels may be learned (None: all).
    """
    spark = df.sparkSession
    sample = training_sample(df, F.col(lang_col), text_col, F.lit(True) if learn is None else learn)
    shared = [spark.sparkContext.broadcast(trees) for trees in train_groups(sample)]
    names = result_names(df, prefix)
    fields = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.DoubleType())]

    def label(texts: list[bytes]) -> tuple[list, list, list]:
        languages, found = [], []
        for group in shared:
            languages += group.value.languages
            found.append(code_lengths(group.value, texts))
            if len(shared) > 1:  # one automaton at a time; the next use reads the broadcast file again
                vars(group).pop("_value", None)
        bits = np.concatenate(found, 1)
        best = bits.argmin(1)
        size = np.maximum(1, [len(t) for t in texts])
        gap = (bits - bits.min(1, keepdims=True)) / np.sqrt(size)[:, None]
        score = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
        return [languages[b] for b in best], score.tolist(), (bits.min(1) / size).tolist()

    def score(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()  # None: undetermined
            langs, scores, rates = [UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if shared:
                todo, held = [], 0
                for i, t in enumerate([*texts, None]):
                    if t is not None:
                        todo.append(i)
                        held += len(t)
                    if todo and (held > BLOCK or i == len(texts)):
                        for k, a, b, c in zip(todo, *label([texts[k] for k in todo]), strict=True):
                            langs[k], scores[k], rates[k] = a, b, c
                        todo, held = [], 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())],
                [*batch.schema.names[:-1], *names])

    (work,) = C.free_names(df, "_bytes_to_code")
    readable = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    out = T.StructType([*df.schema.fields, *fields])
    return df.withColumn(work, F.when(readable, F.encode(F.col(text_col), "utf-8"))).mapInArrow(score, out)
