"""Ranked search on K2-treaps over grids of terms and documents.

A shard's grid has a row for each of its terms and a column for each document
that has terms; a cell holds the impact of the term on the document.  The K2-treap
stores it as a quadtree over Morton codes: each node keeps the cell with its
greatest impact and passes all others on to its four children, so there are as
many nodes as cells that are not empty.  A node takes one byte for its children,
the place of its cell within the node (as few bytes as the level needs) and the
difference of its impact to its parent's; empty quarters take nothing.

A query descends from the root along the row paths of all its terms at once.  A
state is a range of columns with one node for each term that has cells left
there; its bound is the greatest score found so far in the range plus what the
nodes can add.  The states with the greatest bounds are split first; scores found
so far are lower bounds, so their k-th greatest closes all states below it.

Documents are indexed by the shard of their task, so texts are never shuffled.
Terms are numbered by falling frequency and documents by length, which puts
alike impacts into the same quarters.  The queries go to the shards in blocks of
bounded size; a task gives its k best of a query, and the best of all are chosen
in two steps, the first of which spreads a query over SPREAD groups.

Scores are integers, fixed by the corpus (N documents with terms, L terms in all)
and the frequency df of a term: w = floor(1000 ln((2N+2) / (2df+1))), m = 75 +
25nN div L, impact 10^9 tf div (1000 tf + 12 m), and a score sums w times impact.

Defined cases: a null or empty text has no terms and is found by nothing; null
and repeated ids are documents and items of their own; an item without terms or
without a hit gives no row; equal scores rank by id, nulls last; empty tables
give an empty result; other columns do not matter; texts are read whole.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressgraph.session import materialise

#: Documents and cells of a shard; one document more may go beyond the second.
SHARD_DOCS, SHARD_CELLS = 1 << 13, 1_500_000
#: States that are split at once, and groups that a query's candidates are spread over.
SPLIT, SPREAD = 256, 16
#: Distinct terms of a block of queries, and the bytes of text from which queries are cut into more blocks.
BLOCK, BLOCK_BYTES = 2_000_000, 16_000_000
#: Scores of queries times documents that one descent holds.
GROUP = 1 << 18

#: Lower-cases A-Z and blanks all ASCII but letters and digits.
_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 or c >= 0x80 else 0x20 for c in range(256))
_LIMIT = np.iinfo(np.int64).max


def terms_of(raw: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII; A-Z in lower case."""
    return raw.translate(_TERMS).split()


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """``n`` is the length of each cell's document."""
    m = 75 + np.array([25 * x * n_docs // n_terms for x in n.tolist()], np.int64) if len(n) else n
    return m if not len(n) else 10**9 * tf // (1000 * tf + 12 * m)


def morton(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Interleaved bits, the row's above the column's; both below 2^31."""
    def spread(x):
        x = x.astype(np.uint64)
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = (x | (x << np.uint64(shift))) & np.uint64(mask)
        return x

    return (spread(row) << np.uint64(1)) | spread(col)


def unmorton(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def gather(x):
        x = x & np.uint64(0x5555555555555555)
        for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
            x = (x | (x >> np.uint64(shift))) & np.uint64(mask)
        return x.astype(np.int64)

    return gather(code >> np.uint64(1)), gather(code)


def _width(bits: int) -> type:
    return next(t for t, b in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if bits <= b)


class Treap:
    """Nodes in level order: ``quarters`` (bit q: child q), ``first`` child, and each node's cell and impact."""

    def __init__(self, height: int, quarters, row, col, value):
        self.height, self.quarters, self.row, self.col, self.value = height, quarters, row, col, value
        bits = np.unpackbits(quarters[:, None], axis=1).sum(1, dtype=np.int64)
        self.first = 1 + np.cumsum(bits) - bits

    @classmethod
    def build(cls, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> Treap:
        """Of distinct cells, one at least."""
        height = max(int(row.max()), int(col.max()), 1).bit_length()
        code = morton(row, col)
        order = np.argsort(code)
        code, value = code[order], value[order]
        levels = []
        for level in range(height + 1):
            node = code >> np.uint64(2 * (height - level))
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            size = np.diff(np.append(first, len(code)))
            most = np.flatnonzero(value == np.repeat(np.maximum.reduceat(value, first), size))
            owner = np.searchsorted(first, most, "right") - 1
            most = most[np.concatenate([[True], owner[1:] != owner[:-1]])]
            left = np.ones(len(code), bool)
            left[most] = False
            levels.append([node[first], code[most], value[most], None])
            code, value = code[left], value[left]
            if level:
                parent = np.searchsorted(levels[-2][0], node[first] >> np.uint64(2))
                quarters = np.zeros(len(levels[-2][0]), np.uint8)
                np.bitwise_or.at(quarters, parent, np.uint8(1) << (node[first] & np.uint64(3)).astype(np.uint8))
                levels[-2][3] = quarters
            if not len(code):
                break
        levels[-1][3] = np.zeros(len(levels[-1][0]), np.uint8)
        rows, cols = unmorton(np.concatenate([x[1] for x in levels]))
        return cls(height, np.concatenate([x[3] for x in levels]), rows, cols, np.concatenate([x[2] for x in levels]))

    def levels(self) -> list[tuple[int, int]]:
        """(first node, last node + 1) of each level."""
        out, lo, hi = [], 0, 1
        while lo < hi:
            out.append((lo, hi))
            lo, hi = hi, int(self.first[hi]) if hi < len(self.first) else len(self.first)
        return out

    def parents(self) -> np.ndarray:
        """Of all nodes but the root."""
        return np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(self.first))))

    def dump(self) -> bytes:
        """Height and sizes, children, places within the nodes by level, and differences to the parents' impacts."""
        code = morton(self.row, self.col)
        out = [np.array([self.height, len(code), int(self.value[0])], np.int64).tobytes(), self.quarters.tobytes()]
        for level, (lo, hi) in enumerate(self.levels()):
            bits = 2 * (self.height - level)
            out.append((code[lo:hi] & np.uint64((1 << bits) - 1)).astype(_width(bits)).tobytes())
        out.append((self.value[self.parents()] - self.value[1:]).astype(np.uint32).tobytes())
        return b"".join(out)

    @classmethod
    def load(cls, blob: bytes) -> Treap:
        height, n, top = np.frombuffer(blob, np.int64, 3).tolist()
        quarters = np.frombuffer(blob, np.uint8, n, 24)
        out = cls(height, quarters, None, None, None)
        parent, at = out.parents(), 24 + n
        code, value, node = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.uint64)
        quarter = np.flatnonzero(np.unpackbits(quarters[:, None], axis=1, bitorder="little").ravel()) % 8
        levels, places = out.levels(), []
        for level, (lo, hi) in enumerate(levels):
            kind = _width(2 * (height - level))
            places.append(np.frombuffer(blob, kind, hi - lo, at))
            at += (hi - lo) * np.dtype(kind).itemsize
        less = np.frombuffer(blob, np.uint32, n - 1, at)
        value[0] = top
        for level, (lo, hi) in enumerate(levels):
            if level:
                up = parent[lo - 1 : hi - 1]
                node[lo:hi] = (node[up] << np.uint64(2)) | quarter[lo - 1 : hi - 1].astype(np.uint64)
                value[lo:hi] = value[up] - less[lo - 1 : hi - 1]
            code[lo:hi] = (node[lo:hi] << np.uint64(2 * (height - level))) | places[level].astype(np.uint64)
        out.row, out.col = unmorton(code)
        out.value = value
        return out

    def best(self, queries: list[tuple[np.ndarray, np.ndarray]], n_cols: int, k: int, floors: np.ndarray):
        """(query, column, score) of all columns that score at least the query's floor and its k-th best score, in no order.

        A query is the rows of its terms and their weights; ``floors`` are 1 at least.
        """
        owner = np.repeat(np.arange(len(queries)), [len(r) for r, _ in queries])
        rows, weights = (np.concatenate([q[i] for q in queries]) for i in (0, 1))
        score = np.zeros(len(queries) * n_cols, np.int64)  # found so far
        by_query = score.reshape(len(queries), n_cols)
        height, floors = self.height, floors.copy()

        def met(term, node):
            """Take the cells of nodes that lie in their term's row."""
            hit = np.flatnonzero(self.row[node] == rows[term])
            at = owner[term[hit]] * n_cols + self.col[node[hit]]
            np.add.at(score, at, weights[term[hit]] * self.value[node[hit]])

        # A state's terms and their nodes lie at start .. start + size of the held pairs.
        held_term, held_node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        used = len(rows)
        met(held_term, held_node)
        query, start, size = np.unique(owner, return_index=True, return_counts=True)
        level, begin = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
        bounds = np.full(len(query), _LIMIT)
        while True:
            if n_cols > k:
                floors = np.maximum(floors, np.partition(by_query, n_cols - k, 1)[:, n_cols - k])
            alive = np.flatnonzero(bounds >= floors[query])
            if not len(alive):
                break
            query, start, size, level, begin, bounds = (x[alive] for x in (query, start, size, level, begin, bounds))
            # The best states of each query are split, the others wait.
            order = np.lexsort((-bounds, query))
            first = np.flatnonzero(np.concatenate([[True], query[order][1:] != query[order][:-1]]))
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            take, rest = order[rank < SPLIT], order[rank >= SPLIT]
            n = size[take]
            at = np.repeat(start[take] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            term, node = held_term[at], held_node[at]
            state = np.repeat(np.arange(len(take)), n)
            # The column's next bit splits the state; the bit of its own row leads each node on.
            lower = height - 1 - level[take][state]
            quarters, half = self.quarters[node], 2 * ((rows[term] >> lower) & 1)
            children = []
            for right in (0, 1):
                has = np.flatnonzero((quarters >> (half + right)) & 1)
                earlier = quarters[has] & ((1 << (half[has] + right)) - 1)
                children.append((2 * state[has] + right, term[has], self.first[node[has]] + _ONES[earlier]))
            state, term, child = (np.concatenate(x) for x in zip(*children, strict=True))
            met(term, child)
            # A node whose quarters on the row are empty has no more to give.
            lower = np.maximum(height - 2 - level[take][state >> 1], 0)
            more = np.flatnonzero((self.quarters[child] >> (2 * ((rows[term] >> lower) & 1))) & 3)
            more = more[np.argsort(state[more], kind="stable")]
            state, term, child = state[more], term[more], child[more]
            first = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1]])) if len(state) else np.zeros(0, np.int64)
            parent, right = take[state[first] >> 1], state[first] & 1
            new_level = level[parent] + 1
            new_begin = begin[parent] + (right << (height - new_level))
            new_query, new_size = query[parent], np.diff(np.append(first, len(state)))
            new_bounds = np.add.reduceat(weights[term] * self.value[child], first) if len(first) else np.zeros(0, np.int64)
            if len(first):
                stop = np.minimum(new_begin + (1 << (height - new_level)), n_cols)
                new_bounds += _range_max(score, new_query * n_cols + new_begin, new_query * n_cols + stop)
            keep = new_bounds >= floors[new_query]
            if used + len(term) > len(held_term):
                room = max(2 * len(held_term), used + len(term))
                held_term, held_node = (np.concatenate([x, np.zeros(room - len(x), np.int64)]) for x in (held_term, held_node))
            held_term[used : used + len(term)], held_node[used : used + len(term)] = term, child
            query, start, size, level, begin, bounds = (np.concatenate([x[rest], y[keep]]) for x, y in (
                (query, new_query), (start, used + first), (size, new_size), (level, new_level), (begin, new_begin), (bounds, new_bounds)))
            used += len(term)
        found = np.flatnonzero(score >= np.repeat(floors, n_cols))
        return found // n_cols, found % n_cols, score[found]


_ONES = np.array([b.bit_count() for b in range(16)])


def _range_max(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Greatest of x[begin:end] for each pair; ranges are not empty."""
    order = np.argsort(begin)
    at = np.stack([begin[order], end[order]], 1).ravel()
    out = np.empty(len(begin), x.dtype)
    out[order] = np.maximum.reduceat(np.append(x, x.dtype.type(0)), at)[::2]
    return out


def grid(texts: list[list[bytes]], n_docs: int, n_terms: int):
    """(terms by falling frequency, documents of each, order of the texts as columns, treap) of texts that have terms."""
    number: dict[bytes, int] = {}
    for x in texts:
        for w in x:
            if w not in number:
                number[w] = len(number)
    n = np.array([len(x) for x in texts])
    columns = np.argsort(n, kind="stable")
    ids = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(texts[i] for i in columns)), np.int64, n.sum())
    doc = np.repeat(np.arange(len(texts)), n[columns])
    cell, tf = np.unique(doc * len(number) + ids, return_counts=True)
    col, row = cell // len(number), cell % len(number)
    counts = np.bincount(row, minlength=len(number))
    order = np.argsort(-counts, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    names = list(number)
    value = impact(tf, n[columns][col], n_docs, n_terms)
    return [names[i] for i in order.tolist()], counts[order], columns, Treap.build(place[row], col, value)


def totals(df: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with terms, terms in all)."""
    def count(batches):
        for batch in batches:
            n = [len(terms_of(x)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, n))]), pa.array([sum(n)])], ["docs", "terms"])

    texts = df.select(F.encode(F.col(text_col), "utf-8").alias("raw")).filter("raw IS NOT NULL")
    row = texts.mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """(shards, N, L); a shard is a row (ids, terms, counts, treap) of a written table."""
    n_docs, n_terms = totals(df, text_col)
    id_type = df.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("terms", T.BinaryType()),
        T.StructField("counts", T.BinaryType()), T.StructField("treap", T.BinaryType())])

    def build(batches):
        ids, texts, cells = [], [], 0
        arrow = _arrow(schema)

        def out():
            terms, counts, columns, treap = grid(texts, n_docs, n_terms)
            row = {"ids": [ids[i] for i in columns.tolist()], "terms": b" ".join(terms),
                   "counts": counts.astype(np.uint32).tobytes(), "treap": treap.dump()}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for doc_id, raw in zip(batch.column(0), batch.column(1), strict=True):
                found = terms_of(raw.as_py())
                if not found:
                    continue
                ids.append(doc_id.as_py())
                texts.append(found)
                cells += len(found)
                if len(ids) >= SHARD_DOCS or cells >= 2 * SHARD_CELLS:
                    yield out()
                    ids, texts, cells = [], [], 0
        if ids:
            yield out()

    texts = df.select(F.col(id_col).alias("doc_id"), F.encode(F.col(text_col), "utf-8").alias("raw")).filter("raw IS NOT NULL")
    return materialise(texts.mapInArrow(build, schema), "treaps"), n_docs, n_terms


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def query_blocks(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, item, item_id, terms, times): the items' terms, in blocks of at most BLOCK terms or one item.

    ``item`` numbers the rows, as ids may repeat or be null.
    """
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("item", T.LongType()), T.StructField("item_id", items.schema[id_col].dataType),
        T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def cut(batches):
        base = TaskContext.get().partitionId() << 40
        item, block, held = base, base, 0
        for batch in batches:
            rows = []
            for item_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                times = Counter(terms_of(raw))
                if held and held + len(times) > BLOCK:
                    block, held = block + 1, 0
                held += len(times)
                rows.append({"block": block, "item": item, "item_id": item_id, "terms": list(times), "times": list(times.values())})
                item += 1
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(schema))

    texts = items.select(F.col(id_col), F.encode(F.col(text_col), "utf-8").alias("raw")).filter("raw IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    return materialise(texts.repartition(1 + size // BLOCK_BYTES).mapInArrow(cut, schema), "queries")


def frequencies(shards: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """Documents that hold each of the given terms; one row for each of them."""
    wanted = shards.sparkSession.sparkContext.broadcast(set(terms))

    def count(batches):
        found = Counter()
        for batch in batches:
            for names, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, n in zip(names.split(b" "), np.frombuffer(counts, np.uint32).tolist(), strict=True):
                    if w in wanted.value:
                        found[w] += n
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["term", "df"])

    counted = shards.select("terms", "counts").mapInArrow(count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in counted.toLocalIterator()}


def _search_block(shards: DataFrame, block: list, n_docs: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best of every query, and all that tie with the last of them."""
    df = frequencies(shards, list({w for r in block for w in r["terms"]}))
    weights = {w: int(x) for w, x in zip(df, weight(n_docs, np.array(list(df.values()), np.float64)), strict=True)} if df else {}
    queries = [(r["item"], [(bytes(w), weights[bytes(w)] * n) for w, n in zip(r["terms"], r["times"], strict=True) if weights.get(bytes(w))])
               for r in block]
    sent = shards.sparkSession.sparkContext.broadcast([q for q in queries if q[1]])
    schema = T.StructType([
        T.StructField("item", T.LongType()), T.StructField("doc_id", shards.schema["ids"].dataType.elementType), T.StructField("score", T.LongType())])

    def search(batches):
        best = {item: [] for item, _ in sent.value}  # heaps of (score, id) are not needed: few stay

        def keep(item, found):
            held = best[item] + found
            held.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
            best[item] = held[:k]

        for batch in batches:
            for row in range(len(batch)):
                ids, names = batch.column(0)[row].as_py(), batch.column(1)[row].as_py().split(b" ")
                place, treap = {w: i for i, w in enumerate(names)}, Treap.load(batch.column(2)[row].as_py())
                group = max(1, GROUP // len(ids))
                asked = []
                for item, terms in sent.value:
                    own = [(place[w], x) for w, x in terms if w in place]
                    if own:
                        asked.append((item, *(np.array(x, np.int64) for x in zip(*own, strict=True))))
                for lo in range(0, len(asked), group):
                    part = asked[lo : lo + group]
                    floors = np.array([best[item][-1][0] if len(best[item]) == k else 1 for item, *_ in part])
                    q, col, score = treap.best([x[1:] for x in part], len(ids), k, floors)
                    for i in range(len(part)):
                        own = np.flatnonzero(q == i)
                        keep(part[i][0], [(s, ids[c]) for s, c in zip(score[own].tolist(), col[own].tolist(), strict=True)])
        rows = [{"item": item, "doc_id": d, "score": s} for item, found in best.items() for s, d in found]
        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(schema))

    return shards.select("ids", "terms", "treap").mapInArrow(search, schema)


def search(
    df: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each item that score above 0."""
    shards, n_docs, _ = build_index(df, id_col, text_col)
    queries = query_blocks(items, item_id_col, item_text_col)
    found = None
    for (block,) in queries.select("block").distinct().orderBy("block").toLocalIterator():
        rows = queries.filter(F.col("block") == block).select("item", "terms", "times").collect()  # BLOCK terms at most
        here = materialise(_search_block(shards, rows, n_docs, k), "ranked")
        found = here if found is None else found.unionByName(here)
    if found is None:
        found = shards.sparkSession.createDataFrame([], "item long, score long").withColumn(
            "doc_id", F.lit(None).cast(shards.schema["ids"].dataType.elementType))
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))
    near = found.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*best)))
    top = near.filter(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best)))
    return top.filter(F.col("rank") <= k).join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
