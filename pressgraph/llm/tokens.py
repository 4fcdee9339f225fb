"""Token counts without token ids.

The text is cut into pre-tokens, which no merge crosses.  Each distinct
pre-token of the corpus is given to the tokenizer once, which yields the
number of its pieces.  A document's count is the sum of piece counts over its
pre-token frequencies: an equi-join on the pre-token.  The most frequent
pre-tokens (at most KNOWN of them) are looked up where the document is, so
common words never travel; all others go through the join.

For byte-level BPE files of the ``tokenizers`` library.  Special strings inside
a text are one token each, as in that library.

Defined cases: a null or empty text has 0 bytes and 0 tokens; null and repeated
ids are counted row by row; an empty table gives an empty table; other columns
do not matter; texts are read whole, whatever their length.
"""

from __future__ import annotations

import json
import os
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressgraph.llm import common as C
from pressgraph.session import materialise

#: Fixed value: the pattern of byte-level BPE that cuts text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes are alike in all Unicode versions that the libraries carry.
SETTLED = "[^" + "".join(
    f"{chr(a)}-{chr(b)}" for a, b in ((0x0, 0x52F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x3001, 0x3029))) + "]"
#: Bound of the table of frequent pre-tokens that each task holds.
KNOWN = 400_000
#: Distinct pre-tokens that a task gathers before it hands them on.
GATHER = 300_000


class PreTokenizer:
    """Cuts a text as the tokenizer file says; only byte-level BPE without a normalizer."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normalizer or added prefix is counted by pre-tokens")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.find = regex.compile(PATTERN).findall
        self.unsettled = regex.compile(SETTLED).search
        special = [x["content"] for x in spec.get("added_tokens", [])]
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None

    def cut(self, text: str) -> list[str]:
        if self.special:
            parts = self.special(text)
            if len(parts) > 1:  # odd places hold the special strings
                return [t for i, x in enumerate(parts) if x for t in ([x] if i % 2 else self._cut(x))]
        return self._cut(text)

    def _cut(self, text: str) -> list[str]:
        if self.unsettled(text):  # the library's own classes decide
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(tokens, add_special_tokens=False)]


_CACHE: dict[str, PreTokenizer] = {}


def _tool(path: str) -> PreTokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _CACHE:
        _CACHE[path] = PreTokenizer(path)
    return _CACHE[path]


def distinct_pre_tokens(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(pretoken, freq, pieces): every distinct pre-token of the corpus with its pieces."""
    def gather(batches):
        tool, seen = _tool(path), Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["pretoken", "freq"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(tool.cut(text.as_py()))
                if len(seen) > GATHER:
                    yield out()
                    seen.clear()
        yield out()

    def count(batches):
        tool = _tool(path)
        for batch in batches:
            n = pa.array(tool.pieces(batch.column(0).to_pylist()), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["pretoken", "freq", "pieces"])

    texts = df.select(F.col(text_col).alias("text")).filter("text IS NOT NULL AND text <> ''")
    found = texts.mapInArrow(gather, "pretoken string, freq long").groupBy("pretoken").agg(F.sum("freq").alias("freq"))
    return found.mapInArrow(count, "pretoken string, freq long, pieces int")


def frequent_pieces(pieces: DataFrame, most: int = KNOWN) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens: those at or above a power of two, at most ``most``."""
    level = F.floor(F.log2("freq")).cast("int")
    sizes = pieces.groupBy(level.alias("level")).count().collect()  # one row for each power of two
    total, cut = 0, 64
    for row in sorted(sizes, key=lambda r: -r["level"]):
        total += row["count"]
        if total > most:
            break
        cut = row["level"]
    table = pieces.filter(level >= cut).select("pretoken", "pieces").toArrow()
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row."""
    pieces = materialise(distinct_pre_tokens(df, path, text_col), "pieces")
    known = df.sparkSession.sparkContext.broadcast(frequent_pieces(pieces))
    kind = df.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()),
        T.StructField("pretoken", T.StringType()), T.StructField("freq", T.LongType())])

    def frequencies(batches):
        tool, table, row = _tool(path), known.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, sizes = batch.column(0), batch.column(2)
            rows, takes, tokens, freqs = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                here = 0
                for token, n in Counter(tool.cut(text)).items():
                    k = table.get(token)
                    if k is None:
                        rows.append(row)
                        takes.append(None)
                        tokens.append(token)
                        freqs.append(n)
                    else:
                        here += k * n
                rows.append(row)
                takes.append(i)
                tokens.append(None)
                freqs.append(here)
                row += 1
            at = pa.array(takes, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), ids.take(at), sizes.take(at), pa.array(tokens, pa.string()),
                 pa.array(freqs, pa.int64())], ["row", "doc_id", "n_bytes", "pretoken", "freq"])

    text = C.text_or_empty(text_col)
    per_doc = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")
                        ).mapInArrow(frequencies, schema)
    # A document's own row has no pre-token; a key of its own keeps such rows apart in the join.
    keyed = per_doc.withColumn("key", F.coalesce("pretoken", F.concat(F.lit("\0"), F.col("row").cast("string"))))
    p = pieces.select(F.col("pretoken").alias("key"), "pieces")
    return (
        keyed.join(p, "key", "left").groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
             F.sum(F.col("freq") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
        .drop("row")
    )
