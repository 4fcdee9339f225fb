"""Removal of repeated passages by an enhanced suffix array, sharded by anchors.

Every string of LENGTH bytes that starts at two or more places of the corpus is
a repeat, and each byte that a repeat covers is removed.

Sharding: of the GRAM-byte strings inside a window of LENGTH bytes the least by
hash (the leftmost of equals) is the window's anchor.  It follows from the
window alone, so equal windows have equal anchors, and windows are compared
only within an anchor.  Consecutive windows with one anchor form a context.
Contexts that occur as a whole at several places are repeats throughout; they
are found by counting hashes and never compared byte by byte.

The distinct contexts of an anchor go to one shard.  There all suffixes that
start a window are sorted, neighbours' common prefixes are measured, and a scan
with a stack yields the tree of common-prefix intervals.  An interval with at
least LENGTH common bytes whose occurrences differ in the byte before them (or
start a context) is a maximal repeat group; all its occurrences are given.

Anchors with more than CROWD distinct contexts would fill a shard: their windows
are dealt out by hash to as many groups as they fill shards, and equal hashes are
counted there.  A context's windows in one group travel as one row, and come back
as one, so rows grow with contexts and not with windows.

Texts travel compressed.  Defined cases: a null text is empty; texts shorter
than LENGTH repeat nothing; rows with equal id and text are two places, so both
lose their text; null ids are ids like any other; an empty table gives an empty
table; other columns do not matter; no text is cut, whatever its length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressgraph.llm import common as C
from pressgraph.llm.decontaminate import merged
from pressgraph.llm.minhash import _BASE, _BYTE, _INVERSE, mix
from pressgraph.session import materialise

LENGTH, GRAM = 200, 32
CROWD = 2000
#: Suffixes of a shard, and bytes of text hashed side by side.
SHARD, SIDE = 100_000, 1_000_000
_LOW = np.uint64(0xFFFFFF)


class Hashes:
    """Hashes of all substrings of some bytes, by prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            power = np.full(len(data) + 1, _BASE, np.uint64)
            power[0] = 1
            np.cumprod(power, out=power)
            self.run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:-1], dtype=np.uint64)])
            self.back = np.full(len(data) + 1, _INVERSE, np.uint64)
            self.back[0] = 1
            np.cumprod(self.back, out=self.back)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.run[end] - self.run[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive numbers, from running minima of blocks."""
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(texts: list[bytes], length: int = LENGTH):
    """(text, first window, windows, anchor, context) of each context of the texts; hashes are signed.

    Texts are cut into pieces that overlap by less than a window, and the pieces are
    hashed in buffers of little more than SIDE bytes, whatever the length of a text.
    """
    found, held, size = [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), SIDE):
            held.append((i, a, t[a : a + SIDE + length - 1]))
            size += len(held[-1][2])
            if size > SIDE:
                found.append(_contexts(held, length))
                held, size = [], 0
    found.append(_contexts(held, length))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _contexts(pieces: list[tuple[int, int, bytes]], length: int):
    """``contexts`` of pieces (text, offset, bytes) that are hashed side by side; 2^24 bytes at most."""
    gram = min(GRAM, length)
    data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    size = np.array([len(p) for _, _, p in pieces], np.int64)
    begin = np.cumsum(size) - size
    hashes = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = hashes.of(at, at + gram)
    least = sliding_min((grams & ~_LOW) | (at.astype(np.uint64) & _LOW), length - gram + 1)
    start = np.arange(len(least))
    owner = np.searchsorted(begin, start, "right") - 1
    valid = start + length <= begin[owner] + size[owner]
    anchor = np.where(valid, (least & _LOW).astype(np.int64), -1)
    turn = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    windows = np.diff(np.append(turn, len(anchor)))
    keep = anchor[turn] >= 0
    s, m = turn[keep], windows[keep]
    a = anchor[s]
    with np.errstate(over="ignore"):
        whole = mix(hashes.of(s, s + m - 1 + length) + (a - s).astype(np.uint64))
    of = owner[s]
    text, shift = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    return text[of], s - begin[of] + shift[of], m, grams[a].view(np.int64), whole.view(np.int64)


def _batches(texts: list[bytes]):
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > SIDE or i == len(texts) - 1:
            yield first, i + 1
            first, held = i + 1, 0


def _typed(df_schema, id_col: str, *fields: str) -> T.StructType:
    head = [T.StructField("doc_id", df_schema[id_col].dataType), T.StructField("k", T.LongType())]
    kinds = {"long": T.LongType(), "binary": T.BinaryType(), "longs": T.ArrayType(T.LongType()), "string": T.StringType()}
    return T.StructType(head + [T.StructField(n, kinds[k]) for n, k in (f.split(":") for f in fields)])


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("k"),
        F.encode(C.text_or_empty(text_col), "utf-8").alias("text"))


def _packed(keyed: DataFrame) -> DataFrame:
    """(doc_id, k, text) with compressed texts."""
    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([squeeze(t) for t in b.column(2).to_pylist()], pa.binary())], ["doc_id", "k", "text"])

    return keyed.mapInArrow(pack, _typed(keyed.schema, "doc_id", "text:binary"))


def repeated_contexts(keyed: DataFrame, length: int) -> DataFrame:
    """(doc_id, k, start, windows, anchor, context, n, first, n_contexts) of contexts whose anchor is at several places."""
    def scan(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, j in _batches(texts):
                t, s, m, a, c = contexts(texts[i:j], length)
                at = pa.array(t + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(s), pa.array(m), pa.array(a), pa.array(c)],
                    ["doc_id", "k", "start", "windows", "anchor", "context"])

    found = materialise(keyed.mapInArrow(
        scan, _typed(keyed.schema, "doc_id", "start:long", "windows:long", "anchor:long", "context:long")), "contexts")
    hot = F.broadcast(C.frequent_values(found, "anchor"))
    each = Window.partitionBy("anchor", "context")
    one = Window.partitionBy("anchor")
    place = [F.col(c).asc_nulls_last() for c in ("doc_id", "k", "start")]
    cold = (
        found.join(hot, "anchor", "left_anti")
        .withColumn("places", F.count("*").over(one)).filter("places > 1").drop("places")
        .withColumn("n", F.count("*").over(each))
        .withColumn("first", F.row_number().over(each.orderBy(*place)) == 1)
        .withColumn("n_contexts", F.sum(F.col("first").cast("long")).over(one))
    )
    # Frequent anchors: counts are combined before the shuffle, and the joins can be split.
    warm = found.join(hot, "anchor", "left_semi")
    classes = materialise(warm.groupBy("anchor", "context").agg(
        F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "start")).alias("best")), "hot-contexts")
    sizes = classes.groupBy("anchor").agg(F.count("*").alias("n_contexts"), F.sum("n").alias("places")).filter("places > 1")
    warm = warm.join(classes, ["anchor", "context"]).join(F.broadcast(sizes.drop("places")), "anchor").withColumn(
        "first", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("k") == F.col("best.k")) & (F.col("start") == F.col("best.start")))
    return materialise(cold.unionByName(warm.select(cold.columns)), "repeated")


def intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of all common-prefix intervals of a suffix array.

    ``common[i]`` is the common prefix of suffixes i - 1 and i (common[0] is 0).
    The stack holds the open intervals from the shallowest to the deepest.
    """
    out, stack = [], []
    for i, depth in enumerate([*common.tolist(), 0]):
        left = i - 1
        while stack and stack[-1][0] > depth:
            top, left = stack.pop()
            out.append((top, left, i - 1))
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))
    return out


def repeat_groups_of(blocks: list[bytes], windows: list[int], length: int):
    """Maximal repeat groups of some contexts.

    Returns (group, common prefix, block, offset) per occurrence, deepest groups
    only, as arrays: an occurrence of an outer group that also belongs to an
    inner one is given with the inner one.  Group -1: not left-maximal there.
    """
    width = max(len(b) for b in blocks)
    block = np.repeat(np.arange(len(blocks)), windows)
    offset = np.concatenate([np.arange(m) for m in windows])
    size = np.array([len(b) for b in blocks])
    padded = np.zeros((len(blocks), 2 * width), np.uint8)
    for i, b in enumerate(blocks):
        padded[i, : len(b)] = np.frombuffer(b, np.uint8)
    suffixes = np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)[block, offset]
    room = size[block] - offset
    order = np.argsort(suffixes.view(f"S{width}").ravel(), kind="stable")
    sorted_ = suffixes[order]
    unlike = sorted_[1:] != sorted_[:-1]
    common = np.where(unlike.any(1), unlike.argmax(1), width)
    common = np.concatenate([[0], np.minimum(common, np.minimum(room[order][1:], room[order][:-1]))])
    # Left extension: the byte before the suffix; none at the start of a context, which counts as unlike all others.
    before = np.where(offset > 0, padded[block, np.maximum(offset - 1, 0)].astype(np.int64), -1)[order]
    differ = np.cumsum(np.concatenate([[0], (before[1:] != before[:-1]) | (before[1:] < 0)]))
    border = np.cumsum(np.concatenate([[0], before < 0]))
    group = np.full(len(order), -1, np.int64)
    depth = np.zeros(len(order), np.int64)
    # Inner intervals are closed before outer ones, so each occurrence keeps its deepest.
    for number, (d, a, z) in enumerate(intervals(np.where(common >= length, common, 0), length)):
        own = depth[a : z + 1] == 0
        depth[a : z + 1][own] = d
        if differ[z] > differ[a] or border[z + 1] > border[a]:
            group[a : z + 1][own] = number
    hit = group >= 0
    return group[hit], depth[hit], block[order][hit], offset[order][hit]


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, k, a, b): stretches [a, b) of bytes that repeats cover, several per row of text."""
    keyed = _keyed(df, id_col, text_col)
    found = repeated_contexts(keyed, length)
    reach = F.col("start") + F.col("windows") - 1 + length
    whole = found.filter("n > 1").select("doc_id", "k", F.col("start").alias("a"), reach.alias("b"))

    # Contexts to compare: one of each, of anchors that have several.
    chosen = found.filter("first AND n_contexts > 1").withColumn("crowded", F.col("n_contexts") > CROWD)
    wanted = chosen.groupBy(F.col("doc_id").alias("_id"), F.col("k").alias("_k")).agg(
        F.collect_list(F.struct("anchor", "context", "start", "windows", "n", "crowded")).alias("cuts"))
    packed = _packed(keyed)
    joined = packed.join(wanted, packed["doc_id"].eqNullSafe(wanted["_id"]) & (packed["k"] == wanted["_k"])).select(
        "doc_id", "k", "text", "cuts")

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            take, rows = [], []
            for i, (text, cuts) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                text = unpack(text)
                hashes = None
                for c in cuts:
                    take.append(i)
                    part = of_windows = None
                    if c["crowded"]:
                        hashes = hashes or Hashes(np.frombuffer(text, np.uint8))
                        at = c["start"] + np.arange(c["windows"])
                        of_windows = hashes.of(at, at + length).view(np.int64).tolist()
                    else:
                        part = text[c["start"] : c["start"] + c["windows"] - 1 + length]
                    rows.append((c["anchor"], c["start"], c["windows"], c["n"], part, of_windows))
            at = pa.array(take, pa.int64())
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                ["doc_id", "k", "anchor", "start", "windows", "n", "bytes", "hashes"])

    parts = materialise(joined.mapInArrow(cut, _typed(
        keyed.schema, "doc_id", "anchor:long", "start:long", "windows:long", "n:long", "bytes:binary", "hashes:longs")).dropDuplicates(
        ["doc_id", "k", "anchor", "start"]), "parts")

    total = parts.filter("bytes IS NOT NULL").agg(F.sum("windows")).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    schema = _typed(keyed.schema, "doc_id", "a:long", "b:long")

    def shard(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        blocks, windows = table.column("bytes").to_pylist(), table.column("windows").to_pylist()
        _, depth, block, offset = repeat_groups_of(blocks, windows, length)
        start, n = table.column("start").to_numpy(), table.column("n").to_numpy()
        single = n[block] == 1  # all places of the others are whole repeats already
        block, a = block[single], start[block[single]] + offset[single]
        at = pa.array(block)
        return pa.table([table.column("doc_id").take(at), table.column("k").take(at), pa.array(a), pa.array(a + depth[single])],
                        names=["doc_id", "k", "a", "b"])

    numbered = parts.filter("bytes IS NOT NULL").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    compared = numbered.groupBy("shard").applyInArrow(shard, schema)

    return whole.unionByName(compared).unionByName(crowded_spans(parts.filter("hashes IS NOT NULL"), length))


def crowded_spans(parts: DataFrame, length: int) -> DataFrame:
    """(doc_id, k, a, b): runs of windows whose hash another context of their anchor, or a copy, has too."""
    busy = parts.groupBy("anchor").agg(F.ceil(F.sum("windows") / SHARD).cast("int").alias("groups"))
    dealt_schema = _typed(parts.schema, "doc_id", "anchor:long", "start:long", "n:long", "part:long", "at:longs", "hash:longs")

    def deal(batches):
        for b in batches:
            take, rows = [], []
            for i, r in enumerate(b.select(["anchor", "start", "n", "hashes", "groups"]).to_pylist()):
                hashes = np.array(r["hashes"], np.int64)
                part = hashes.view(np.uint64) % np.uint64(r["groups"])
                for p in np.unique(part).tolist():
                    at = np.flatnonzero(part == p)
                    take.append(i)
                    rows.append((r["anchor"], r["start"], r["n"], p, at, hashes[at]))
            at = pa.array(take, pa.int64())
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(at), b.column("k").take(at), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                dealt_schema.names)

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sizes = np.array(table.column("hash").combine_chunks().value_lengths())
        hashes = table.column("hash").combine_chunks().flatten().to_numpy()
        owner, at = np.repeat(np.arange(len(sizes)), sizes), table.column("at").combine_chunks().flatten().to_numpy()
        # A hash that one context has twice repeats as well; contexts with copies are whole repeats already.
        _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        single = table.column("n").to_numpy()[owner] == 1
        hit = np.flatnonzero((times[which] > 1) & single)
        rows, first = np.unique(owner[hit], return_index=True)
        places = np.split(at[hit], first[1:]) if len(rows) else []
        take = pa.array(rows)
        return pa.table([table.column("doc_id").take(take), table.column("k").take(take), table.column("start").take(take),
                         pa.array(places, pa.list_(pa.int64()))], names=["doc_id", "k", "start", "at"])

    dealt = parts.join(busy, "anchor").mapInArrow(deal, dealt_schema)
    found = dealt.groupBy("anchor", "part").applyInArrow(count, _typed(parts.schema, "doc_id", "start:long", "at:longs"))
    # A context's windows are LENGTH - GRAM + 1 at most, so a run list is short.
    windows = F.array_sort(F.flatten(F.collect_list("at")))
    return found.groupBy("doc_id", "k", "start").agg(windows.alias("_at")).select(
        "doc_id", "k", F.explode(merged(F.transform("_at", lambda x: F.struct(
            (F.col("start") + x).alias("a"), (F.col("start") + x + length).alias("b"))))).alias("run")).select(
        "doc_id", "k", "run.a", "run.b")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row; ``kept`` are the remaining bytes."""
    keyed = _keyed(df, id_col, text_col)
    runs = spans(df, id_col, text_col, length).groupBy("doc_id", "k").agg(
        merged(F.collect_set(F.struct("a", "b"))).alias("runs"))
    runs = materialise(runs, "runs").select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), "runs")
    packed = _packed(keyed)
    joined = packed.join(runs, packed["doc_id"].eqNullSafe(runs["_id"]) & (packed["k"] == runs["_k"]), "left").select(
        "doc_id", "k", "text", "runs")

    def strip(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for text, cuts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                text, cuts, at, left = unpack(text), cuts or [], 0, []
                for c in cuts:
                    left.append(text[at : c["a"]])
                    at = c["b"]
                left.append(text[at:])
                kept = b"".join(left)
                rows.append((len(text), len(text) - len(kept), len(cuts), kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                ["doc_id", "k", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return joined.mapInArrow(strip, _typed(
        keyed.schema, "doc_id", "n_bytes:long", "n_removed:long", "n_spans:long", "kept:binary", "kept_sha256:string")).drop("k")
