"""Near-duplicate groups by MinHash with a signature-coordinate inverted join.

A document is its set of word shingles, each hashed to 64 bits.  Documents with
the same set are one class.  A class has a signature of COORDINATES minima; it
is posted under each pair (coordinate, value).  Two classes whose sets have a
Jaccard similarity of at least SIMILARITY agree in about that share of the
coordinates and, but for a chance below one in a million, in at least AGREE.

Finding pairs that agree in AGREE coordinates is a count over merged posting
lists, which prefix and skip make small: with each class's pairs ordered from
the shortest list to the longest, two classes that agree AGREE times share one
of their COORDINATES - AGREE + 1 shortest lists, so the longer lists are
skipped and only probed by comparing signatures.  Lists of one class hold no
pair, so they are dropped before anything is ordered, and classes with fewer
than AGREE shared lists have no partner at all.

Candidates that agree often enough are confirmed on the full sets.  Where whole
lists are compared, two sketches of BITS bits go with each class, so that pairs
too far apart are left out of the join itself.  The parity sketch adds up, modulo
two, one bit for each shingle: sets differ in at least as many shingles as their
sketches do in bits, which loses no link and decides nearly all pairs of short
texts.  For long texts, whose parities are random, the second sketch has one bit of
each of BITS further minima: two bits agree with probability (1 + similarity) / 2,
and pairs that differ in more than DIFFER bits are left out, with a chance below
one in a million to miss a link.  Pairs within a long list are not all compared: each list has a hub in each of ROUNDS
rounds, every class is compared with the hub that it meets in most of its lists,
and classes that are linked become one component.  A last round then compares, in each list, the
classes that still belong to different components, all of them, so no link
between components is lost.

Defined cases: a null or empty text, or one without words, has an empty set and
is linked with nothing; with fewer words than a shingle needs the whole
sequence is the one shingle; ties: the least id represents; null ids are never
representatives unless all ids of a component are null; repeated rows are
members like any other; an empty table gives an empty table; other columns do
not matter.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressgraph.llm import common as C
from pressgraph.session import bucketed, buckets, materialise

SHINGLE, SIMILARITY = 5, (80, 100)
COORDINATES, AGREE, ROUNDS = 64, 34, 3
#: At similarity 0.8 a tenth of the bits differ, 51 with a standard deviation of 6.8; DIFFER is five of these above.
BITS, DIFFER = 512, 85
#: Bytes of text hashed side by side.
SIDE = 1_000_000

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_A = (_RNG.integers(0, 1 << 31, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, COORDINATES, np.uint64).astype(np.uint32)
_A_BITS = (_RNG.integers(0, 1 << 31, BITS, np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_B_BITS = _RNG.integers(0, 1 << 32, BITS, np.uint64).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lowered, and the text of each."""
    joined = b" ".join(texts).lower()
    data = np.frombuffer(joined, np.uint8)
    word = np.concatenate([[False], ~_SPACE[data], [False]])
    turn = np.diff(word.astype(np.int8))
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    with np.errstate(over="ignore"):
        power = np.full(len(data) + 1, _BASE, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:-1], dtype=np.uint64)])
        back = np.full(len(data) + 1, _INVERSE, np.uint64)
        back[0] = 1
        np.cumprod(back, out=back)
        h = mix((run[end] - run[begin]) * back[begin] + (end - begin).astype(np.uint64))
    limits = np.cumsum([len(t) + 1 for t in texts])
    return h, np.searchsorted(limits, begin, "right")


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, owner = word_hashes(texts)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    with np.errstate(over="ignore"):
        for i in range(len(texts)):
            w = h[at[i] : at[i + 1]]
            n = min(size, len(w))
            if not n:
                out.append(np.zeros(0, np.uint64))
                continue
            s = np.full(len(w) - n + 1, n, np.uint64)
            for j in range(n):
                s = mix(s * np.uint64(0xD1342543DE82EF95) + w[j : len(w) - n + 1 + j])
            out.append(np.unique(s))
    return out


def signature(shingles: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """Minima of multiply-add permutations of 32 bits of the hashes."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(h), 1024):
            np.minimum(least, (h[i : i + 1024, None] * a + b).min(0), out=least)
    return least


def sketch(shingles: np.ndarray) -> np.ndarray:
    """BITS bits, one of each further minimum, as 64-bit numbers."""
    with np.errstate(over="ignore"):
        least = signature(shingles, _A_BITS, _B_BITS).astype(np.uint64) + (np.arange(BITS, dtype=np.uint64) << np.uint64(32))
        return np.packbits((mix(least) >> np.uint64(63)).astype(bool)).view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """BITS bits as 64-bit numbers: whether an odd number of shingles falls on each."""
    with np.errstate(over="ignore"):
        at = (mix(shingles + _BASE) % np.uint64(BITS)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=BITS) % 2 == 1).view(np.int64)


def _side_by_side(texts: list[bytes]):
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > SIDE or i == len(texts) - 1:
            yield first, i + 1
            first, held = i + 1, 0


def signatures(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc_id, k, n, s1, s2, sig): set size, two sums that name the set, and the signature; k hashes the text."""
    kind = df.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            texts, rows = batch.column(2).to_pylist(), []
            for i, j in _side_by_side(texts):
                for s in shingle_sets(texts[i:j], size):
                    with np.errstate(over="ignore"):
                        one, two = s.sum(dtype=np.uint64), mix(s + _BASE).sum(dtype=np.uint64)
                    rows.append((len(s), one.view(np.int64), two.view(np.int64), signature(s).tobytes() if len(s) else None))
            n, s1, s2, sig = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(np.array(s1, np.int64)),
                 pa.array(np.array(s2, np.int64)), pa.array(sig, pa.binary())], ["doc_id", "k", "n", "s1", "s2", "sig"])

    schema = T.StructType([
        T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("k", "n", "s1", "s2")),
        T.StructField("sig", T.BinaryType())])
    return df.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("k"),
        F.encode(C.text_or_empty(text_col), "utf-8").alias("text")).mapInArrow(run, schema)


def postings(classes: DataFrame) -> DataFrame:
    """(id, n, tokens, company): the shortest shared lists of each class; a token is a coordinate with its value.

    ``company`` is the length of all shared lists of the class: the more, the nearer it is to the middle of its group.
    """
    def post(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            token = (sig.astype(np.int64) | (np.arange(COORDINATES, dtype=np.int64) << 32)).ravel()
            ids = np.repeat(batch.column(0).to_numpy(), COORDINATES)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(token)], ["id", "token"])

    posts = classes.select("id", "n", "sig").mapInArrow(post, "id long, token long")
    sizes = posts.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1")
    shared = posts.join(sizes, "token").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("size", "token"))).alias("lists"))  # COORDINATES at most
    prefix = F.slice("lists", 1, F.size("lists") - AGREE + 1)
    company = F.aggregate("lists.size", F.lit(0).cast("long"), lambda x, y: x + y)
    chosen = shared.filter(F.size("lists") >= AGREE).select("id", company.alias("company"), prefix["token"].alias("tokens"))
    return chosen.join(classes.select("id", "n"), "id")


def hub_pairs(posts: DataFrame, seed: int) -> DataFrame:
    """(a, b), a < b: each class with one hub of another component, the one that it meets in most of its lists.

    The hub of a list is in the first round the class in the most company, later it is drawn by hash.
    """
    rank = F.struct(-F.col("company"), "id") if seed == 0 else F.struct(F.xxhash64("id", F.lit(seed)), "id")
    first = F.min_by(F.struct("id", "n", "comp"), rank).alias("hub")
    hubs = posts.groupBy("token").agg(first, F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    met = posts.join(hubs, "token").filter((F.col("comp") != F.col("hub.comp")) & similar_sizes(F.col("n"), F.col("hub.n")))
    likeliest = met.groupBy("id").agg(F.mode("hub.id", True).alias("hub"))  # COORDINATES hubs at most
    return likeliest.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def sketches(texts: DataFrame, size: int) -> DataFrame:
    """(id, p0, p1, ..., w0, w1, ...): the parities and the sketch of each class in ``texts``."""
    names = [f"{kind}{i}" for kind in "pw" for i in range(BITS // 64)]

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            packed = [unpack(t) for t in batch.column(1).to_pylist()]
            words = [np.concatenate([parities(s), sketch(s)]) for i, j in _side_by_side(packed) for s in shingle_sets(packed[i:j], size)]
            table = np.array(words, np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, i]) for i in range(len(names)))], ["id", *names])

    return texts.mapInArrow(run, "id long, " + ", ".join(f"{n} long" for n in names))


def all_pairs(posts: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, b), a < b: classes of one list that are still in different components and whose sketches let them be similar.

    A pair leaves the join at the least token that both share and no other: each posting has 32-bit hashes of its class's
    lesser tokens.  Hashes of different tokens are equal by chance for fewer than one pair in a million.
    """
    split = posts.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("token")
    open_ = materialise(posts.join(split, "token").select("token", "id", "n", "comp"), "split")
    drawn = materialise(sketches(texts.join(open_.select("id").distinct(), "id").select("id", "text"), size), "sketches")
    names = [c for c in drawn.columns if c != "id"]
    hashed = F.struct("token", F.hash("token").alias("hash"))
    tokens = open_.groupBy("id").agg(
        F.min("n").alias("n"), F.min("comp").alias("comp"), F.sort_array(F.collect_list(hashed)).alias("tokens"))  # COORDINATES at most
    met = tokens.join(drawn, "id").select("id", "n", "comp", *names, "tokens", F.posexplode("tokens").alias("at", "one"))
    lesser = F.slice(F.col("tokens.hash"), F.lit(1), F.col("at"))
    p = met.select("one.token", "id", "n", "comp", lesser.alias("lesser"), *names)
    x, y = p.alias("x"), p.alias("y")

    def differ(kind: str):
        return reduce(lambda s, t: s + t, (
            F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in names if c.startswith(kind)))

    n, m, (part, whole) = F.col("x.n"), F.col("y.n"), SIMILARITY
    near = similar_sizes(n, m) & ((whole + part) * differ("p") <= (whole - part) * (n + m)) & (differ("w") <= DIFFER)
    first = ~F.arrays_overlap("x.lesser", "y.lesser")
    apart = (F.col("x.id") < F.col("y.id")) & (F.col("x.comp") != F.col("y.comp"))
    return x.join(y, (F.col("x.token") == F.col("y.token")) & apart & near & first).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def similar_sizes(n, m, similarity: tuple[int, int] = SIMILARITY):
    """The length bound: the smaller set is at least that share of the larger."""
    part, whole = similarity
    return whole * F.least(n, m) >= part * F.greatest(n, m)


def agreeing(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in AGREE coordinates."""
    def count(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, COORDINATES) for i in (2, 3))
            keep = pa.array((x == y).sum(1) >= AGREE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    s = signed.select("id", "sig")
    both = pairs.join(s.withColumnsRenamed({"id": "a", "sig": "x"}), "a").join(s.withColumnsRenamed({"id": "b", "sig": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(count, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The pairs whose full shingle sets are similar enough; ``texts`` has (id, text), compressed."""
    part, whole = similarity

    def check(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = shingle_sets([unpack(x), unpack(y)], size)
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(whole * common >= part * (len(s) + len(t) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "x"}), "a").join(
        texts.withColumnsRenamed({"id": "b", "text": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def packed_texts(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): compressed texts of the classes in ``wanted`` (id, doc_id, k), one each."""
    kind = df.schema[id_col].dataType

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([squeeze(t) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["doc_id", "k", "text"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("k", T.LongType()), T.StructField("text", T.BinaryType())])
    docs = df.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("k"),
        F.encode(C.text_or_empty(text_col), "utf-8").alias("text")).mapInArrow(pack, schema)
    w = wanted.withColumnRenamed("doc_id", "_id")
    return docs.join(w, docs["doc_id"].eqNullSafe(w["_id"]) & (docs["k"] == w["k"])).groupBy("id").agg(
        F.first("text").alias("text"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, k, n, comp, component_id) for every row: its group, null without words, and the least id of the group.

    ``k`` hashes the text.  Ids may repeat, so ``comp`` and not ``component_id`` tells groups apart.
    """
    rows = materialise(signatures(df, id_col, text_col, size), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("rep")
    classes = materialise(
        rows.filter("n > 0").groupBy("s1", "s2", "n").agg(least, F.first("sig").alias("sig"))
        .select(F.monotonically_increasing_id().alias("id"), "s1", "s2", "n", "rep.doc_id", "rep.k", "sig"), "classes")
    posts = materialise(postings(classes), "postings")
    # Signatures and texts lie in buckets by class, so that a round shuffles pairs and not these.
    shared = classes.join(posts.select("id"), "id")
    texts = bucketed(packed_texts(df, shared.select("id", "doc_id", "k"), id_col, text_col), "texts", "id")
    signed = bucketed(shared.select("id", "sig").repartition(buckets(df.sparkSession), "id"), "signed", "id")
    found = None
    for turn in range(ROUNDS + 1):
        comp, labelled = F.col("id"), posts
        if found is not None:
            comp, labelled = F.coalesce("root", "id"), posts.join(found, posts["id"] == found["node"], "left")
        labelled = materialise(labelled.select(
            "id", "n", "company", comp.alias("comp"), F.explode("tokens").alias("token")), "labelled")
        pairs = hub_pairs(labelled, turn) if turn < ROUNDS else all_pairs(labelled, texts, size)
        new = materialise(confirmed(materialise(agreeing(pairs, signed), "agreeing"), texts, size), "links")
        # What was found stands for the links that it was found by.
        links = new if found is None else new.unionByName(
            found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        found = materialise(C.components(links), "components")
    member = classes.join(found, classes["id"] == found["node"], "left").select(
        "s1", "s2", "n", F.coalesce("root", "id").alias("comp"), F.col("doc_id").alias("own"))
    smallest = member.groupBy("comp").agg(F.min("own").alias("component_id"))
    of_class = member.join(smallest, "comp").select("s1", "s2", "n", "comp", "component_id")
    grouped = rows.filter("n > 0").drop("sig").join(of_class, ["s1", "s2", "n"])
    alone = rows.filter("n = 0").drop("sig").withColumn("component_id", F.col("doc_id")).withColumn("comp", F.lit(None).cast("long"))
    return grouped.unionByName(alone).select("doc_id", "k", "n", "comp", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, k, n_shingles, component_id, kept) for every row; k hashes the text."""
    return groups(df, id_col, text_col, size).select(
        "doc_id", "k", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row of each group of near duplicates, with all its columns, and every row without words.

    Of a group stays the row with the least id, nulls last; of rows with that id the one whose text has the least hash;
    of equal texts the least row by its other columns.
    """
    keep, k, words, own = C.free_names(df, "_keep", "_keep_k", "_words", "_own")
    member = groups(df, id_col, text_col, size)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("rep")
    first = member.filter("n > 0").groupBy("comp").agg(least).select(
        F.col("rep.doc_id").alias(keep), F.col("rep.k").alias(k), F.lit(True).alias(words))
    empty = member.filter("n = 0").select(F.col("doc_id").alias(keep), F.col("k").alias(k), F.lit(False).alias(words)).distinct()
    stay = first.unionByName(empty)
    keyed = df.withColumn(own, F.xxhash64(F.col(text_col)))
    joined = keyed.join(stay, keyed[id_col].eqNullSafe(stay[keep]) & (keyed[own] == stay[k]))
    repeated = C.one_of_equal_rows(joined.filter(F.col(words)).select(*[joined[c] for c in df.columns], own), [id_col, own]).drop(own)
    return joined.filter(~F.col(words)).select(*[joined[c] for c in df.columns]).unionByName(repeated)
