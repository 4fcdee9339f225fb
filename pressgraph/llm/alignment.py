"""Alignment of the tokens of two tokenizers over whole texts.

Tokenizer A (byte-level BPE) reads a space and the text; tokenizer B (piece BPE
with byte fallback) reads the text and adds that space itself.  Byte offsets at
which a token of A and a token of B both end cut the text into groups.

Fragments: any byte range of a text yields a fragment: an open head (tokens that
end in the range, up to the first common end), its closed groups, and an open
tail (tokens after the last common end).  Two neighbouring fragments compose to
one: the left tail and the right head become a group, a *seam*, or stay open if
one of the two has no common end.  Composition is associative and the empty
fragment is neutral, so long texts are cut into byte ranges of CHUNK bytes that
go to different tasks, and a tree of FANIN fragments a step puts them together.
Only heads, tails and counts climb the tree; group texts stay where they are and
are read in order when a text's digest is taken.

Both tokenizers can be applied to *units*: a cut before a space or a line feed
that no token of either crosses (``Tools`` checks the files for that; other
tokenizers get the whole text as one unit).  A task tokenizes and aligns each
distinct unit once and keeps at most UNITS of them.

Defined cases: null and empty texts, and texts whose joined token bytes differ
from space+text, have no tokens: zeros and an empty digest; their tokens count
nowhere.  Null and repeated ids are rows of their own; an empty table gives an
empty table; other columns do not matter; texts are read whole; a unit longer
than CHUNK (a text without a space) stays with one task for its tokens.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressgraph.session import materialise

#: Bytes of a text that one task aligns; longer texts are spread over tasks.
CHUNK = 1 << 16
#: Fragments that one step of the tree composes.
FANIN = 64
#: Distinct units that a task keeps, and bytes of texts among them.
UNITS, UNIT_BYTES = 400_000, 24_000_000
#: Bound of the table of frequent id pairs that each task holds; the others are joined.
KNOWN = 1_000_000

#: Texts that ``str.split`` cuts into units: single spaces and line feeds, each before a character that is no space.
_UNPLAIN = re.compile("[^\\S \\n]|[ \\n][ \\n]|[ \\n]\\Z|▁").search
_CUTS = re.compile("(?<![ ▁]) (?=\\S)|\\n(?=\\S)").finditer
_SPACES = re.compile("\\s\\s").search
#: Units that one call of tokenizer A gets, if they can be joined.
JOINED = 128
_NONE = np.zeros(0, np.int64)


def _bytes_of_a(spec: dict) -> dict[int, bytes]:
    """Token bytes of a byte-level vocabulary: printable bytes stand for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    code = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in code):
        code[b] = chr(256 + n)
    byte = {c: b for b, c in code.items()}
    return {i: bytes(byte.get(c, 0) for c in token) for token, i in spec["model"]["vocab"].items()}


class Tools:
    """Both tokenizers, their token bytes, and whether texts may be cut into units."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        own = _bytes_of_a(spec)
        self.bytes_a = [own.get(i, b"") for i in range(max(own) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        pre = spec.get("pre_tokenizer") or {}
        self.space = pieces.index("▁") if "▁" in pieces else -1
        self.divisible = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not spec.get("normalizer") and self.space >= 0
            and not any("\n" in p or re.search("[^▁]▁", p) for p in pieces)
            and self.b.encode("\nx  y ", out_type=str) == ["▁", "<0x0A>", *self.b.encode("\nx  y ", out_type=str)[2:]]
            and b"".join(self.bytes_b[i] for i in self.b.encode("\nx  y ½Ａ")) == " \nx  y ½Ａ".encode())
        # Ids as text with each separator: comma or bar after an id of A, comma or semicolon after one of B.
        self.said = np.array([f"{i}{c}" for n, ends in ((len(own), ",|"), (len(pieces), ",;")) for c in ends for i in range(n)], object)
        self.said_b = 2 * len(own)

    def units(self, text: str) -> list[str]:
        """Keys of the units of space+text; a key stands for itself if it begins with white space, else for space+key."""
        if not self.divisible:
            return [" " + text]
        if not _UNPLAIN(text, 0) and text[0] not in " \n":
            return text.replace("\n", " \n").split(" ")
        whole = " " + text
        at = [0, *(m.start() for m in _CUTS(whole) if m.start() > 1), len(whole)]
        pieces = [whole[x:y] for x, y in itertools.pairwise(at)]
        return [p[1:] if p[0] == " " and p[1:2] not in ("", " ", "\n") else p for p in pieces]

    def encode(self, keys: list[str]):
        """(ids of A, tokens of A a unit, ids of B, tokens of B a unit, which units are whole)."""
        whole = [k if k[:1] in (" ", "\n") else " " + k for k in keys]
        ids_a, n_a = self._encode_a(whole)
        # A unit that begins with a line feed gets B's space like any other; it is not in the text.
        b = self.b.encode([w if w[0] == "\n" else w[1:] for w in whole], num_threads=1)
        b = [x[1:] if w[0] == "\n" else x for w, x in zip(whole, b, strict=True)]
        ids_b, n_b = _flat(b)
        raw = "".join(whole).encode("utf-8", "surrogatepass")
        ok = np.ones(len(keys), bool)
        for ids, n, table in ((ids_a, n_a, self.bytes_a), (ids_b, n_b, self.bytes_b)):
            if b"".join(map(table.__getitem__, ids.tolist())) != raw:
                ends = np.cumsum(n)
                ok &= np.fromiter((
                    b"".join(map(table.__getitem__, ids[z - m : z].tolist())) == w.encode("utf-8", "surrogatepass")
                    for w, m, z in zip(whole, n.tolist(), ends.tolist(), strict=True)), bool, len(keys))
        return ids_a, n_a, ids_b, n_b, ok

    def _encode_a(self, whole: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, tokens a unit).  Units side by side are one call, unless white space meets white space there."""
        calls = []
        for lo in range(0, len(whole), JOINED):
            part = whole[lo : lo + JOINED]
            joined = "".join(part)
            calls += part if _SPACES(joined) else [joined]
        ids, _ = _flat([e.ids for e in self.a.encode_batch(calls, add_special_tokens=False)])
        sizes = np.fromiter((len(w.encode("utf-8", "surrogatepass")) for w in whole), np.int64, len(whole))
        ends = np.searchsorted(np.cumsum(self.size_a[ids]), np.cumsum(sizes), "right")
        return ids, np.diff(ends, prepend=0)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))


_TOOLS: dict[tuple[str, str], Tools] = {}


def _tools(paths: tuple[str, str]) -> Tools:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if paths not in _TOOLS:
        _TOOLS[paths] = Tools(*paths)
    return _TOOLS[paths]


def pair_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << 32) | b


def links(ids_a, ends_a, ids_b, ends_b, begin: int = 0):
    """(index of A, index of B) of all tokens whose byte ranges overlap; both streams start at ``begin`` and end together."""
    starts = np.concatenate([[begin], ends_a[:-1]]) if len(ends_a) else _NONE
    first = np.searchsorted(ends_b, starts, "right")
    n = np.searchsorted(ends_b, ends_a, "left") - first + 1
    at = np.repeat(np.arange(len(ends_a)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Fragment(NamedTuple):
    """Open tokens (ids and end offsets of A and B) around closed groups; without a common end all are in ``head``."""

    head: tuple
    tail: tuple
    cut: bool
    first: int  # chunk of the first common end


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, tuple | None]:
    """The fragment of both ranges, and the tokens of the seam that closes between them."""
    def joined(x, y):
        return tuple(np.concatenate([p, q]) for p, q in zip(x, y, strict=True))

    if not right.cut:
        if left.cut:
            return left._replace(tail=joined(left.tail, right.head)), None
        return left._replace(head=joined(left.head, right.head)), None
    if not left.cut:
        return right._replace(head=joined(left.head, right.head)), None
    return Fragment(left.head, right.tail, True, left.first), joined(left.tail, right.head)


class Alignment(NamedTuple):
    """Closed groups of a token stream: counts, links as id pairs, and the groups' text."""

    n_a: int
    n_b: int
    n_groups: int
    pairs: np.ndarray
    text: str


class _Places(dict):
    """Numbers keys as they are first asked for and notes them as pending."""

    def __init__(self, pending: list[str]):
        self.pending = pending

    def __missing__(self, key: str) -> int:
        at = self[key] = len(self)
        self.pending.append(key)
        return at


class Units:
    """The distinct units that a task has met, aligned; arrays are by unit."""

    def __init__(self, tools: Tools, texts: bool, known=None):
        self.tools, self.texts, self.known = tools, texts, known
        self.clear()

    def clear(self) -> None:
        self.pending: list[str] = []
        self.places = _Places(self.pending)
        self.held = 0
        self.ok = np.zeros(0, bool)
        self.sums = np.zeros((0, 6), np.int64)  # the counts, as they are returned
        self.missed, self.pairs, self.said = _NONE, _NONE, []

    def index(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.places.__getitem__, keys), np.int64, len(keys))

    def read(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bool]]:
        """(units of each text, whether it has tokens)."""
        found = [self.index(self.tools.units(x)) if x else _NONE for x in texts]
        self.align()
        return found, [bool(len(x)) and bool(self.ok[x].all()) for x in found]

    def align(self) -> None:
        """Align the pending units as one stream: every unit's end is a common end."""
        if not self.pending:
            return
        t = self.tools
        for lo in range(0, len(self.pending), 50_000):
            ids_a, n_a, ids_b, n_b, ok = t.encode(self.pending[lo : lo + 50_000])
            if not ok.all():  # such units get no tokens; texts that hold one get none either
                ids_a, ids_b = ids_a[np.repeat(ok, n_a)], ids_b[np.repeat(ok, n_b)]
                n_a, n_b = n_a * ok, n_b * ok
            ends_a, ends_b = np.cumsum(t.size_a[ids_a]), np.cumsum(t.size_b[ids_b])
            at_a, at_b = links(ids_a, ends_a, ids_b, ends_b)
            unit_a = np.repeat(np.arange(len(ok)), n_a)
            last_a, last_b, group_a, _ = _groups(ends_a, ends_b)
            pairs = pair_of(ids_a[at_a], ids_b[at_b])
            of = unit_a[at_a]
            n_groups = np.bincount(unit_a[last_a], minlength=len(ok))
            n_links = np.bincount(of, minlength=len(ok))
            sums = np.zeros((len(ok), 6), np.int64)
            sums[:, :4] = np.stack([n_a, n_b, n_groups, n_links], 1)
            if self.known is not None:
                count, best = self.known.look_up(pairs)
                sums[:, 4], sums[:, 5] = _sum(of, best, len(ok)), _sum(of, count, len(ok))
                self.missed = np.concatenate([self.missed, _sum(of, count == 0, len(ok))])
            if self.texts:
                said = _say(t, ids_a, last_a, ids_b, last_b, group_a)
                stops = np.cumsum(n_a + n_b).tolist()
                self.said += ["".join(said[x:y]) for x, y in zip([0, *stops[:-1]], stops, strict=True)]
            self.ok = np.concatenate([self.ok, ok])
            self.sums = np.concatenate([self.sums, sums])
            self.pairs = np.concatenate([self.pairs, pairs])
        self.held += sum(map(len, self.pending))
        self.pending.clear()

    def full(self) -> bool:
        return len(self.places) > UNITS or self.held > UNIT_BYTES

    def pairs_of(self, units: np.ndarray):
        """Links of the given units, and the place of each link's unit among them."""
        links_of = self.sums[:, 3]
        n = links_of[units]
        first = (np.cumsum(links_of) - links_of)[units]
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.pairs[at], np.repeat(np.arange(len(units)), n)


def _sum(of: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of integers by owner, exact."""
    run = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    ends = np.cumsum(np.bincount(of, minlength=n))
    return np.diff(np.concatenate([[0], run[ends]]))


def _groups(ends_a: np.ndarray, ends_b: np.ndarray):
    """(last token of A in a group, same for B, group of each token of A, of B)."""
    last_a, last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
    return last_a, last_b, np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b


def _say(t: Tools, ids_a, last_a, ids_b, last_b, group_a) -> list[str]:
    """The groups' text as one piece for each token: ``1,`` ``2|`` ``7;`` in the order of the digest."""
    n = len(t.bytes_a)
    out = np.empty(len(ids_a) + len(ids_b), np.int64)
    in_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])  # tokens of B before each group
    in_a = np.flatnonzero(last_a) + 1  # tokens of A to the end of each group
    out[np.arange(len(ids_a)) + in_b[group_a]] = ids_a + n * last_a
    group_b = np.cumsum(last_b) - last_b
    out[np.arange(len(ids_b)) + in_a[group_b]] = t.said_b + ids_b + len(t.bytes_b) * last_b
    return t.said[out].tolist()


def align(t: Tools, tokens: tuple, begin: int, text: bool) -> Alignment:
    """Closed groups of tokens (ids and ends of A, then of B) that start at ``begin`` and end together."""
    ids_a, ends_a, ids_b, ends_b = tokens
    at_a, at_b = links(ids_a, ends_a, ids_b, ends_b, begin)
    last_a, last_b, group_a, _ = _groups(ends_a, ends_b)
    said = "".join(_say(t, ids_a, last_a, ids_b, last_b, group_a)) if text and len(ids_a) else ""
    return Alignment(len(ids_a), len(ids_b), int(last_a.sum()), pair_of(ids_a[at_a], ids_b[at_b]), said)


def fragment(tokens: tuple, chunk: int) -> tuple[Fragment, tuple, int]:
    """Split the tokens that end in a byte range: (open parts, closed tokens, where these begin)."""
    ids_a, ends_a, ids_b, ends_b = tokens
    last_a = np.flatnonzero(np.isin(ends_a, ends_b, assume_unique=True))
    if not len(last_a):
        return Fragment(tokens, (_NONE,) * 4, False, -1), (_NONE,) * 4, 0
    last_b = np.flatnonzero(np.isin(ends_b, ends_a, assume_unique=True))
    (x, y), (u, v) = (last_a[[0, -1]] + 1).tolist(), (last_b[[0, -1]] + 1).tolist()
    parts = [(ids_a[p:q], ends_a[p:q], ids_b[r:s], ends_b[r:s]) for p, q, r, s in (
        (0, x, 0, u), (x, y, u, v), (y, len(ids_a), v, len(ids_b)))]
    return Fragment(parts[0], parts[2], True, chunk), parts[1], int(ends_a[x - 1])


def chunks_of(t: Tools, text: str, size: int):
    """(chunk, begin, end, offset of the part, part, ends at a cut) of a long text: byte ranges in the units around them.

    Borders lie at multiples of ``size`` whether a token ends there or not, but a
    unit that holds several of them keeps the first alone.
    """
    whole = " " + text
    starts = [0]
    for key in t.units(text):
        n = len(key.encode("utf-8", "surrogatepass")) + (key[:1] not in (" ", "\n"))
        starts.append(starts[-1] + n)
    starts, raw = np.array(starts), whole.encode("utf-8", "surrogatepass")
    borders = np.arange(size, len(raw), size)
    unit = np.searchsorted(starts, borders, "right") - 1
    borders = borders[np.concatenate([[True], unit[1:] != unit[:-1]])] if len(borders) else borders
    borders = np.concatenate([[0], borders, [len(raw)]])
    for c, (s, e) in enumerate(itertools.pairwise(borders.tolist())):
        lo = int(starts[np.searchsorted(starts, s, "right") - 1])
        hi = int(starts[np.searchsorted(starts, e, "left")])
        yield c, s, e, lo, raw[lo:hi].decode("utf-8", "surrogatepass")


def unit_tokens(t: Tools, key: str, begin: int):
    """(ids of A, their ends, ids of B, their ends) of one unit that starts at byte ``begin``, and whether it is whole."""
    ids_a, _, ids_b, _, ok = t.encode([key])
    return (ids_a, begin + np.cumsum(t.size_a[ids_a]), ids_b, begin + np.cumsum(t.size_b[ids_b])), bool(ok[0])


def _between(tokens: tuple, s: int, e: int) -> tuple:
    ids_a, ends_a, ids_b, ends_b = tokens
    p, q = np.searchsorted(ends_a, [s, e], "right")
    r, u = np.searchsorted(ends_b, [s, e], "right")
    return ids_a[p:q], ends_a[p:q], ids_b[r:u], ends_b[r:u]


def read_chunk(units: Units, chunk: int, s: int, e: int, lo: int, part: str):
    """(fragment, whole units, alignments of the cut units' closed groups in order, ok) of one byte range.

    The list holds None where the whole units stand.
    """
    t = units.tools
    keys = t.units(part[1:]) if lo == 0 else _inner_units(t, part)
    sizes = np.array([len(k.encode("utf-8", "surrogatepass")) + (k[:1] not in (" ", "\n")) for k in keys])
    ends = lo + np.cumsum(sizes)
    begins = ends - sizes
    inner = (begins >= s) & (ends <= e)
    whole = [k for k, i in zip(keys, inner, strict=True) if i]
    at = units.index(whole)
    left = right = None
    ok = True
    state, closed = Fragment((_NONE,) * 4, (_NONE,) * 4, False, -1), []
    for i in np.flatnonzero(~inner).tolist():
        tokens, fine = unit_tokens(t, keys[i], int(begins[i]))
        ok &= fine
        if not fine:
            continue
        frag, between, begin = fragment(_between(tokens, s, e), chunk)
        if begins[i] < s:
            left = (frag, between, begin)
        else:
            right = (frag, between, begin)
    if left:
        state = left[0]
        if len(left[1][0]):
            closed.append(align(t, left[1], left[2], units.texts))
    elif s == lo:  # the range begins at a unit, which is a common end
        state = Fragment((_NONE,) * 4, (_NONE,) * 4, True, chunk)
    closed.append(None)
    if right:
        begin = int(begins[np.flatnonzero(~inner)[-1]])
        head = right[0].head if right[0].cut else (_NONE,) * 4
        if len(head[0]):  # the unit's first group begins at the unit
            closed.append(align(t, head, begin, units.texts))
        if len(right[1][0]):
            closed.append(align(t, right[1], right[2], units.texts))
        state = state._replace(tail=right[0].tail if right[0].cut else right[0].head)
    return state, at, closed, ok


def _inner_units(t: Tools, part: str) -> list[str]:
    """Units of a part that begins at a unit inside a text."""
    if not t.divisible:
        return [part]
    at = [0, *(m.start() for m in _CUTS(part) if m.start() > 0), len(part)]
    pieces = [part[x:y] for x, y in itertools.pairwise(at)]
    return [p[1:] if p[0] == " " and p[1:2] not in ("", " ", "\n") else p for p in pieces]


class Pairs:
    """Corpus counts of the most frequent id pairs, and whether a pair is the best of its id of B."""

    def __init__(self, pair: np.ndarray, count: np.ndarray, best: np.ndarray):
        order = np.argsort(pair)
        self.pair, self.count, self.best = pair[order], count[order], best[order].astype(np.int64)

    def look_up(self, pairs: np.ndarray):
        """(counts, bests); a pair that is not held counts 0."""
        if not len(self.pair):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        at = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
        hit = self.pair[at] == pairs
        return np.where(hit, self.count[at], 0), np.where(hit, self.best[at], 0)


def _dump(tokens: tuple) -> bytes:
    return np.concatenate([[len(tokens[0])], *tokens]).astype(np.int64).tobytes()


def _load(blob: bytes) -> tuple:
    x = np.frombuffer(blob, np.int64)
    n = int(x[0])
    rest = x[1 + 2 * n :]
    m = len(rest) // 2
    return x[1 : 1 + n], x[1 + n : 1 + 2 * n], rest[:m], rest[m:]


def _weighed(pairs: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and the sums of their weights."""
    order = np.argsort(pairs)
    pairs, weight = pairs[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else _NONE
    return pairs[first], np.add.reduceat(weight, first) if len(first) else _NONE


_FRAGMENT = "row long, chunk long, at long, cut boolean, head binary, tail binary, ok boolean, seam boolean"
_CHUNK = ["row", "chunk", "s", "e", "lo", "part"]


def _table(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    cols = list(zip(*rows, strict=True)) or [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)


def _long(df: DataFrame, size: int, inverse: bool = False) -> DataFrame:
    long = F.octet_length("text") >= size
    return df.filter(~F.coalesce(long, F.lit(False)) if inverse else long)


def split_long(texts: DataFrame, paths: tuple[str, str], size: int) -> DataFrame:
    """(row, doc_id, chunk, s, e, lo, part) of the byte ranges of long texts."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", texts.schema["doc_id"].dataType), *(
        T.StructField(n, T.LongType()) for n in ("chunk", "s", "e", "lo")), T.StructField("part", T.StringType())])

    def cut(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                rows = [(row, doc_id.as_py(), *c) for c in chunks_of(_tools(paths), text.as_py(), size)]
                yield _table(rows, schema)
                row += 1

    return _long(texts, size).mapInArrow(cut, schema)


def pair_counts(df: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(pair, n) in parts: links of whole texts, or of the closed groups of chunks with their fragments."""
    chunked = "chunk" in df.columns
    schema = T._parse_datatype_string(f"pair long, n long, {_FRAGMENT}")

    def gather(batches):
        units = Units(_tools(paths), False)
        times = np.zeros(0, np.int64)

        def out():
            found = np.flatnonzero(times)
            pairs, of = units.pairs_of(found)
            pairs, n = _weighed(pairs, times[found][of])
            yield from emit(pairs, n)

        def emit(pairs, n):
            for lo in range(0, len(pairs), 100_000):
                m = len(pairs[lo : lo + 100_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[lo : lo + m]), pa.array(n[lo : lo + m]), *nulls(m)], schema=_arrow(schema))

        def nulls(m):
            return [pa.nulls(m, f.type) for f in _arrow(schema)][2:]

        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            if chunked:
                rows, extra = [], []
                for row, chunk, s, e, lo, part in zip(*(columns[c].to_pylist() for c in _CHUNK), strict=True):
                    state, at, closed, ok = read_chunk(units, chunk, s, e, lo, part)
                    units.align()
                    ok = ok and bool(units.ok[at].all())
                    times = _grown(times, len(units.places)) + np.bincount(at, minlength=len(units.places))
                    extra += [x.pairs for x in closed if x]
                    rows.append((None, None, row, chunk, state.first, state.cut, _dump(state.head), _dump(state.tail), ok, False))
                yield _table(rows, schema)
                if extra:
                    pairs = np.concatenate(extra)
                    yield from emit(*_weighed(pairs, np.ones(len(pairs), np.int64)))
            else:
                found, whole = units.read(columns["text"].to_pylist())
                good = np.concatenate([_NONE, *itertools.compress(found, whole)])
                times = _grown(times, len(units.places)) + np.bincount(good, minlength=len(units.places))
            if units.full():
                yield from out()
                units.clear()
                times = np.zeros(0, np.int64)
        yield from out()

    return df.mapInArrow(gather, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([x, np.zeros(n - len(x), x.dtype)]) if len(x) < n else x


def composed(fragments: DataFrame) -> DataFrame:
    """Fragments of whole texts and the seams between chunks: one more level of the tree until one fragment a row is left."""
    schema = T._parse_datatype_string(_FRAGMENT)

    def level(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        state, seams, ok = None, [], True
        for r in rows:
            ok &= r["ok"]
            here = Fragment(_load(r["head"]), _load(r["tail"]), r["cut"], r["at"])
            if state is None:
                state = here
                continue
            state, seam = compose(state, here)
            if seam and len(seam[0]):
                seams.append((r["row"], here.first, here.first, True, _dump(seam), b"", True, True))
        first = rows[0]
        out = (first["row"], first["chunk"] // FANIN, state.first, state.cut, _dump(state.head), _dump(state.tail), ok, False)
        return pa.Table.from_batches([_table([out, *seams], schema)])

    fragments = fragments.select(*schema.names)
    seams, most = [], fragments.agg(F.max("chunk")).first()[0] or 0
    while most > 0:
        grouped = fragments.groupBy("row", F.floor(F.col("chunk") / FANIN).alias("_above")).applyInArrow(level, schema)
        done = materialise(grouped, "fragments")
        seams.append(done.filter("seam"))
        fragments, most = done.filter("NOT seam"), most // FANIN
    for more in seams:
        fragments = fragments.unionByName(more)
    return fragments


_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def token_alignment(
    df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row."""
    paths, spark = (path_a, path_b), df.sparkSession
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    short = _long(texts, size, inverse=True)
    chunks = materialise(split_long(texts, paths, size), "chunks")
    spread = chunks.select("row", *_CHUNK[1:]).repartition("row", "chunk")

    found = materialise(pair_counts(spread, paths), "fragments")
    tree = materialise(composed(found.filter("row IS NOT NULL")), "tree")
    bad = tree.filter("NOT ok").select("row").distinct()
    good = tree.join(bad, "row", "left_anti")

    # A text that holds a byte out of place has no tokens: what its chunks gave is taken back.
    undone = pair_counts(spread.join(bad, "row", "left_semi"), paths).select("pair", (-F.col("n")).alias("n"))
    counted = (
        pair_counts(short.filter("text <> ''").select("text"), paths).select("pair", "n")
        .unionByName(found.select("pair", "n")).unionByName(undone)
        .unionByName(_read_tree(good, paths, None).select("pair", "n"))
        .filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 0")
    )
    counted = materialise(counted, "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counted.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # one row for each id of B
    table = materialise(
        counted.join(F.broadcast(most), b == most["b"]).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-table")
    known = spark.sparkContext.broadcast(_frequent(table))

    whole = _read_texts(short, paths, known)
    closed = _read_chunks(spread, paths, known).unionByName(_read_tree(good, paths, known).drop("pair", "n"))
    sums = _totals(whole.unionByName(
        _digest(closed, chunks, bad)), table)
    return sums.select("doc_id", *_COUNTS, "groups_sha256")


def _frequent(table: DataFrame) -> Pairs:
    """The most frequent pairs: those at or above a power of two, at most KNOWN."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = table.groupBy(level.alias("level")).count().collect()  # one row for each power of two
    total, cut = 0, 64
    for r in sorted(sizes, key=lambda r: -r["level"]):
        total += r["count"]
        if total > KNOWN:
            break
        cut = r["level"]
    found = table.filter(level >= cut).select("pair", "n", "best").toArrow()
    return Pairs(*(found.column(i).to_numpy() for i in range(3)))


_PART = "row long, chunk long, place long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", text string, missed long, times long"


def _part(doc_type=None) -> T.StructType:
    schema = T._parse_datatype_string(_PART)
    return T.StructType([T.StructField("doc_id", doc_type), *schema.fields]) if doc_type is not None else schema


def _read_texts(short: DataFrame, paths: tuple[str, str], known) -> DataFrame:
    """A row for each text with its counts and digest, and one for each distinct pair that ``known`` lacks."""
    schema = _part(short.schema["doc_id"].dataType)

    def read(batches):
        units, row = Units(_tools(paths), True, known.value), (1 << 62) + (TaskContext.get().partitionId() << 40)
        for batch in batches:
            out = []
            found, whole = units.read(batch.column(1).to_pylist())
            for doc_id, at, ok in zip(batch.column(0).to_pylist(), found, whole, strict=True):
                row += 1
                if not ok:
                    out.append((doc_id, row, 0, 0, 0, 0, 0, 0, 0, 0, "", None, None))
                    continue
                said = "".join([units.said[i] for i in at.tolist()])[:-1]
                out.append((doc_id, row, 0, 0, *_unit_sums(units, at), hashlib.sha256(said.encode()).hexdigest(), None, None))
                out += [(doc_id, row, 0, 0, 0, 0, 0, 0, 0, 0, None, p, n) for p, n in _missed(units, at)]
            yield _table(out, schema)
            if units.full():
                units.clear()

    return short.mapInArrow(read, schema)


def _unit_sums(units: Units, at: np.ndarray) -> tuple[int, ...]:
    return tuple(units.sums[at].sum(0).tolist())


def _missed(units: Units, at: np.ndarray):
    at = at[units.missed[at] > 0]
    if not len(at):
        return []
    pairs, _ = units.pairs_of(at)
    pairs = pairs[units.known.look_up(pairs)[0] == 0]
    return zip(*(x.tolist() for x in np.unique(pairs, return_counts=True)), strict=True)


def _closed_sums(known: Pairs, x: Alignment) -> tuple[tuple[int, ...], list]:
    count, best = known.look_up(x.pairs)
    rest = np.unique(x.pairs[count == 0], return_counts=True)
    return (x.n_a, x.n_b, x.n_groups, len(x.pairs), int(best.sum()), int(count.sum())), list(zip(*(y.tolist() for y in rest), strict=True))


def _read_chunks(spread: DataFrame, paths: tuple[str, str], known) -> DataFrame:
    """Counts and group text of the closed groups of each chunk, in place order, and the pairs that ``known`` lacks."""
    schema = _part()

    def read(batches):
        units = Units(_tools(paths), True, known.value)
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for row, chunk, s, e, lo, part in zip(*(columns[c].to_pylist() for c in _CHUNK), strict=True):
                _, at, closed, _ = read_chunk(units, chunk, s, e, lo, part)
                units.align()
                out = []
                for place, x in enumerate(closed, 1):
                    if x is None:
                        sums, rest, said = _unit_sums(units, at), _missed(units, at), "".join([units.said[i] for i in at.tolist()])
                    else:
                        (sums, rest), said = _closed_sums(units.known, x), x.text
                    out.append((row, chunk, place, *sums, said, None, None))
                    out += [(row, chunk, place, 0, 0, 0, 0, 0, 0, None, p, n) for p, n in rest]
                yield _table(out, schema)
                if units.full():
                    units.clear()

    return spread.mapInArrow(read, schema)


def _read_tree(tree: DataFrame, paths: tuple[str, str], known) -> DataFrame:
    """Groups that the tree closed: (pair, n) of their links without ``known``, else counts and text."""
    schema = T.StructType([*_part().fields, *T._parse_datatype_string("pair long, n long").fields])

    def read(batches):
        t = _tools(paths)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                head, tail = _load(r["head"]), _load(r["tail"]) if r["tail"] else (_NONE,) * 4
                # Of a whole text the tail is empty: its end is a common end.
                for place, tokens in ((0, head), (1 << 40, tail)):
                    if not len(tokens[0]):
                        continue
                    begin = int(min(tokens[1][0] - t.size_a[tokens[0][0]], tokens[3][0] - t.size_b[tokens[2][0]]))
                    x = align(t, tokens, begin, known is not None)
                    if known is None:
                        pairs, n = np.unique(x.pairs, return_counts=True)
                        out += [(None,) * 12 + (p, m) for p, m in zip(pairs.tolist(), n.tolist(), strict=True)]
                        continue
                    sums, rest = _closed_sums(known.value, x)
                    out.append((r["row"], r["at"], place, *sums, x.text, None, None, None, None))
                    out += [(r["row"], r["at"], place, 0, 0, 0, 0, 0, 0, None, p, m, None, None) for p, m in rest]
            yield _table(out, schema)

    return tree.select("row", "at", "head", "tail").mapInArrow(read, schema)


def _digest(parts: DataFrame, chunks: DataFrame, bad: DataFrame) -> DataFrame:
    """One row for each long text: sums, and the digest of its group texts read in order; missed pairs pass through."""
    owner = chunks.filter("chunk = 0").select("row", "doc_id")
    schema = _part()
    ordered = parts.filter("text IS NOT NULL").join(bad, "row", "left_anti").repartition("row").sortWithinPartitions("row", "chunk", "place")

    def read(batches):
        row, sums, digest, held = None, [0] * 6, None, ""

        def out():
            if held:
                digest.update(held[:-1].encode())
            return _table([(row, 0, 0, *sums, digest.hexdigest(), None, None)], schema)

        for batch in batches:
            for r in batch.to_pylist():
                if r["row"] != row:
                    if row is not None:
                        yield out()
                    row, sums, digest, held = r["row"], [0] * 6, hashlib.sha256(), ""
                sums = [x + r[c] for x, c in zip(sums, _COUNTS, strict=True)]
                if r["text"]:
                    digest.update(held.encode())
                    held = r["text"]
        if row is not None:
            yield out()

    none = F.lit(0).cast("long")
    read_rows = ordered.mapInArrow(read, schema).unionByName(
        parts.filter("missed IS NOT NULL").join(bad, "row", "left_anti"))
    zeros = bad.select(
        "row", none.alias("chunk"), none.alias("place"), *(none.alias(c) for c in _COUNTS), F.lit("").alias("text"),
        F.lit(None).cast("long").alias("missed"), F.lit(None).cast("long").alias("times"))
    return read_rows.unionByName(zeros).join(owner, "row")


def _totals(parts: DataFrame, table: DataFrame) -> DataFrame:
    """Sums a row, with the missed pairs looked up by a join; a text's own row has a key of its own there."""
    keyed = parts.withColumn("key", F.coalesce("missed", -F.col("row") - 1))
    pairs = table.select(F.col("pair").alias("key"), F.col("n").alias("pair_n"), F.col("best").cast("long").alias("pair_best"))
    here = keyed.join(pairs, "key", "left")
    extra = F.coalesce("times", F.lit(0))
    sums = {
        "n_best": F.sum(F.col("n_best") + extra * F.coalesce("pair_best", F.lit(0))),
        "count_sum": F.sum(F.col("count_sum") + extra * F.coalesce("pair_n", F.lit(0))),
    }
    return here.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *(sums.get(c, F.sum(c)).alias(c) for c in _COUNTS), F.max("text").alias("groups_sha256"))
