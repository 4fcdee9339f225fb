"""Toxicity score by a factorization machine over hashed terms.

A text is the set of its words, each hashed into one of BUCKETS buckets.  The
machine scores w0 + sum w_i + sum over pairs <v_i, v_j>, so that two terms
together (an insult and a group) can weigh more than both alone; the pair sum
takes linear time, half of (sum v)^2 - sum v^2.  The score is the logistic of
that.

It is fitted (logistic loss, AdaGrad, L2) on a bounded sample of labelled rows,
at most about POSITIVE and NEGATIVE rows, drawn by a hash of the id; the
intercept is then corrected for the rates at which the classes were drawn.
Every term in at least LEAST sampled texts takes part, so that terms which tell
nothing alone can tell in pairs.  The factors of a term are drawn to 0 together
(by PAIRS); one whose factors are 0 after an epoch is out.  Terms that tell alone
(chi-square against the label above CHI) are free of that pull.  SPREAD and PAIRS were
chosen by cross-validation within the rows that are learned from; EPOCHS, RATE, L2 and
CHI are older than that and came from held-out labels.  Scoring reads every word of
every text.

Defined cases: a null or empty text has no terms and gets the logistic of the
intercept; several labels of an id count as their maximum; null labels and ids
are not learned; with one class or none to learn from, the score is the smoothed
share of label 1; an empty table gives an empty table; columns of the table
other than id and text are neither read nor clash.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressgraph.llm import common as C
from pressgraph.llm.decontaminate import words

BUCKETS, FACTORS, LEAST, CHI = 1 << 20, 8, 4, 10.8
POSITIVE, NEGATIVE = 4096, 12288
EPOCHS, BATCH, RATE, L2 = 25, 64, 0.1, 1e-5
#: First spread of the factors, and the pull that a text's worth of noise must overcome.
SPREAD, PAIRS = 0.2, 1.5
#: Terms scored side by side.
SIDE = 4_000_000


def terms(text: bytes) -> list[int]:
    """Buckets of the distinct words of a text."""
    return sorted({zlib.crc32(w) % BUCKETS for w in set(words(text))})


@dataclass
class Machine:
    place: np.ndarray  # bucket -> 1 + its row of parameters, or 0
    w: np.ndarray
    v: np.ndarray
    w0: float

    def margin(self, rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Scores before the logistic: ``rows`` are parameter rows, ``owner`` their text."""
        linear = np.bincount(owner, self.w[rows], n)
        pairs = np.zeros(n)
        for f in range(self.v.shape[1]):
            x = self.v[rows, f]
            pairs += np.bincount(owner, x, n) ** 2 - np.bincount(owner, x * x, n)
        return self.w0 + linear + pairs / 2


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(x) for x in lists]
    return np.array([t for x in lists for t in x], np.int64), np.repeat(np.arange(len(lists)), sizes)


def frequent(items: np.ndarray, owner: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in at least LEAST texts; which of them have a share of label 1 unlike that of all texts (chi-square above CHI)."""
    n = np.bincount(items, minlength=BUCKETS).astype(np.float64)
    pos = np.bincount(items, y[owner], BUCKETS)
    share = y.mean()
    chi = (pos - n * share) ** 2 / np.maximum(1e-9, n * share * (1 - share) * (1 - n / (len(y) + 1)))
    kept = np.flatnonzero(n >= LEAST)
    return kept, chi[kept] > CHI


def fit(samples: list[tuple[list[int], int]], correction: float = 0.0, seed: int = 7) -> Machine:
    """``correction`` is added to the intercept: log of (rate of negatives drawn / rate of positives)."""
    y = np.array([label for _, label in samples], np.float64)
    place = np.zeros(BUCKETS, np.int32)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Machine(place, np.zeros(1), np.zeros((1, FACTORS)), float(np.log(share / (1 - share))))
    items, owner = _flat([t for t, _ in samples])
    kept, telling = frequent(items, owner, y)
    free = np.append(True, telling)
    place[kept] = np.arange(1, len(kept) + 1)
    rng = np.random.default_rng(seed)
    m = Machine(place, np.zeros(len(kept) + 1), rng.normal(0, SPREAD, (len(kept) + 1, FACTORS)), float(np.log(y.mean() / (1 - y.mean()))))
    rows = place[items]
    owner, rows = owner[rows > 0], rows[rows > 0]
    pull = PAIRS * BATCH / np.sqrt(len(y))
    gw, gv, g0 = np.full(m.w.shape, 1e-2), np.full(m.v.shape, 1e-2), 1.0
    for _ in range(EPOCHS):
        alive = (free | m.v.any(1))[rows]
        owner, rows = owner[alive], rows[alive]
        start = np.searchsorted(owner, np.arange(len(y) + 1))
        turn = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            part = turn[at : at + BATCH]
            size = start[part + 1] - start[part]
            own = np.repeat(np.arange(len(part)), size)
            r = rows[np.repeat(start[part], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            x = m.v[r]
            sums = np.stack([np.bincount(own, x[:, f], len(part)) for f in range(FACTORS)], 1)
            squares = np.bincount(own, (x * x).sum(1), len(part))
            z = m.w0 + np.bincount(own, m.w[r], len(part)) + ((sums**2).sum(1) - squares) / 2
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            u, back = np.unique(r, return_inverse=True)
            dw = np.bincount(back, e[own], len(u)) + L2 * BATCH * m.w[u]
            push = e[own, None] * (sums[own] - x)
            dv = np.stack([np.bincount(back, push[:, f], len(u)) for f in range(FACTORS)], 1) + L2 * BATCH * m.v[u]
            gw[u] += dw**2
            gv[u] += dv**2
            g0 += e.sum() ** 2
            m.w[u] -= RATE * dw / np.sqrt(gw[u])
            m.v[u] -= RATE * dv / np.sqrt(gv[u])
            m.w0 -= RATE * e.sum() / np.sqrt(g0)
            by = np.where(free[u], 0, RATE * pull / np.sqrt(gv[u].mean(1)))
            m.v[u] *= np.maximum(0, 1 - by / np.maximum(np.sqrt((m.v[u] ** 2).sum(1)), 1e-12))[:, None]
            m.w[u[~free[u] & ~m.v[u].any(1)]] = 0
    out = ~free & ~m.v.any(1)
    m.w[out] = 0
    m.w0 += correction
    return m


def sample(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE):
    """[(terms, label)] of a bounded sample, and the correction of the intercept.

    ``docs`` has doc_id and text, ``labels`` doc_id and label (0 or 1).
    """
    known = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    count = {bool(r["label"]): r["n"] for r in known.groupBy((F.col("label") > 0).alias("label")).agg(F.count("*").alias("n")).collect()}
    rate = {k: min(1.0, bound / max(1, count.get(k, 0))) for k, bound in ((True, positive), (False, negative))}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.filter(draw < F.when(F.col("label") > 0, rate[True]).otherwise(rate[False]))
    # At most about positive + negative ids: their bound is a parameter.
    rows = docs.join(F.broadcast(chosen), "doc_id").select("label", F.encode(C.text_or_empty(), "utf-8").alias("text"))

    def featurise(batches):
        for b in batches:
            found = [terms(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["label", "terms"])

    table = rows.mapInArrow(featurise, "label int, terms array<int>").toArrow()
    pairs = sorted((t, int(y > 0)) for y, t in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
    return pairs, float(np.log(rate[False] / rate[True]))


def score(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(machine)
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        m = shared.value
        for b in batches:
            out, lists, held = [], [], 0

            def flush(lists=lists, out=out, m=m):
                items, owner = _flat(lists)
                rows = m.place[items]
                z = m.margin(rows[rows > 0], owner[rows > 0], len(lists))
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                lists.clear()

            for t in b.column(1).to_pylist():
                lists.append(terms(t))
                held += len(lists[-1])
                if held > SIDE:
                    flush()
                    held = 0
            if lists:
                flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return df.select(F.col(id_col).alias("doc_id"), F.encode(C.text_or_empty(text_col), "utf-8").alias("text")).mapInArrow(run, schema)
