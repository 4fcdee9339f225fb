"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgraph.llm import alignment, chat, decontaminate, exact, langid, minhash, mixing, quality, ranked, repeats, tokens, toxicity, warc

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def held_out(doc_id: str = "doc_id"):
    """The fold that is never learned from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


@query("op8_exact_dedup", rf"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE_CLASS}', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.duplicate_groups(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight 3 for documents labelled good, 1/2 for bad ones; others have none, which counts as 1."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") > 0, 3.0).when(F.col("quality") <= 0, 0.5).alias("weight"))


@query("op3_mix_sources", rf"""
WITH q AS (SELECT doc_id, avg(CASE WHEN quality > 0 THEN 3.0 WHEN quality <= 0 THEN 0.5 END) AS w
           FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_CLASS}')) AS size,
       -ln((CAST(('0x' || substr(md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13)) AS BIGINT) + 1)
           / 4503599627370496.0::DOUBLE) / coalesce(w, 1.0)::DOUBLE AS key
      FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
       [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w
      FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
       (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM s WINDOW b AS (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size,
       least(cap, coalesce((SELECT arg_min(level, cap / w) FROM r WHERE level * w <= cap) * w, cap)) AS target FROM r),
p AS (SELECT d.*, source_size, target,
       CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS full_epochs,
       coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (full_epochs + CASE WHEN ahead + size / 2 < target - full_epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), quality=quality_weights(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    found = langid.identify(docs, learn=~F.col("held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


WORDS_OF = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op5_decontaminate", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{WORDS_OF}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '{WORDS_OF}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[p:p + least(len(w), 10) - 1] AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, p, w[p:p + n - 1] AS win
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, p, n, item_id FROM dw JOIN iw USING (n, win)),
hit AS (SELECT r, count(DISTINCT h) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS h FROM m) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), F.col("spans").isNotNull().alias("contaminated"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    machine = toxicity.fit(*toxicity.sample(docs.filter(~held_out()).select("doc_id", "text"), labels))
    scores = toxicity.score(docs, machine)
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_warc_from_arc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_key").cast("long").alias("refers_to"))


@query("op7_minhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op6_repeated_passages")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Speaker markers of the four transcript styles: user, assistant, others.
STYLES = (("User: ", "Assistant: ", "System: "), ("Human> ", "AI> ", "[system] "), ("Q. ", "A. ", "Note. "), ("**Me:** ", "**Bot:** ", "# "))


def raw_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines (conv, part, pos, line, role, begins) of transcripts written from ``conversations``.

    The style is one of four by conversation; one turn in eight has no marker.  Lines
    stand by turn; rows with one turn number follow one another whole, by a hash.
    """
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conv"), F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    style = F.pmod(F.xxhash64("conv"), F.lit(len(STYLES)))

    def of(place: int):
        return F.element_at(F.array(*[F.lit(s[place]) for s in STYLES]), (style + 1).cast("int"))

    marker = F.when(F.pmod(F.xxhash64("conv", "turn", F.lit("bare")), F.lit(8)) == 0, "").when(
        F.col("role") == "user", of(0)).when(F.col("role") == "assistant", of(1)).otherwise(of(2))
    whole = c.withColumns({"marker": marker, "order": F.xxhash64("role", "text"), "row": F.monotonically_increasing_id()})
    lines = whole.select("*", F.posexplode(F.split("text", "\n")).alias("i", "piece"))
    return lines.select(
        "conv", F.floor(F.col("turn") / 256).cast("long").alias("part"),
        F.struct("turn", "order", "row", "i").alias("pos"),
        F.when(F.col("i") == 0, F.concat("marker", "piece")).otherwise(F.col("piece")).alias("line"), "role",
        (F.col("i") == 0).alias("begins"))


@query("op2_chat_turns")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw_transcripts(spark, sf_dir)
    model = chat.learn(lines.filter(~held_out("conv")))
    found = chat.turns(lines.select("conv", "part", "pos", "line"), model)
    return found.select(F.col("conv").alias("conv_id"), held_out("conv").alias("held_out"), "turn", "role", "n_lines", "text", "rendered")


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.token_alignment(
        table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def _escaped(low: int, high: int | None = None) -> str:
    return f"\\x{{{low:X}}}" + (f"-\\x{{{high:X}}}" if high else "")


#: Regular expressions of the character classes, by name.
CLASS_SETS = {n: "".join(map(_escaped, c)) for n, c in quality.ASCII_CLASSES.items()} | {
    n: _escaped(*r) for n, r in quality.RANGE_CLASSES.items()}


def _divergence(p: str, q: str) -> str:
    """Sum over bins of what one bin adds to the Jensen-Shannon divergence of shares p and q."""
    def half(x):
        return f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"

    return f"sqrt(greatest(0, sum({half(p)} + {half(q)}) / 2))"


def _bound(least: float, bins: str, n: str) -> str:
    return f"sqrt({least * least!r}::DOUBLE + {quality.NOISE!r}::DOUBLE * {bins} / (8 * {n} * ln(2)))"


@query("op12_quality_rules", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '{WORD_CLASS}') AS w, regexp_extract_all({LOWER}, '{WORDS_OF}') AS terms
           FROM documents),
tri AS (SELECT r, p, w[p:p + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) > 2)),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (
          SELECT r, unnest(range(p, p + 3)) AS q FROM tri JOIN (SELECT r, g FROM tri GROUP BY r, g HAVING count(*) > 1) USING (r, g))
        GROUP BY r),
dup AS (SELECT r, sum(n - 1) AS n FROM (
          SELECT r, l, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '{WORD_CLASS}') GROUP BY r, l)
        GROUP BY r),
base AS (SELECT r, doc_id, lang, len(terms) AS n_terms, length(t) AS n_chars, len(w) AS n_words,
           length(regexp_replace(t, '{SPACE_CLASS}', '', 'g')) AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
         FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
cls AS (SELECT r, lang, unnest({list(CLASS_SETS)!r}) AS c,
               unnest([{", ".join(f"length(regexp_replace(t, '[^{x}]', '', 'g'))" for x in CLASS_SETS.values())}]) AS n FROM d),
total AS (SELECT lang, sum(n_terms) AS total FROM base WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n_terms) >= {quality.LEAST_REFERENCE}),
ref_cls AS (SELECT lang, c, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cls JOIN total USING (lang) GROUP BY lang, c),
term AS (SELECT r, lang, x, count(*) AS n FROM (SELECT r, lang, unnest(terms) AS x FROM d) GROUP BY r, lang, x),
common AS (SELECT lang, x, n / total AS q FROM (SELECT lang, x, sum(n) AS n FROM term GROUP BY lang, x) JOIN total USING (lang)
           WHERE n >= {quality.COMMON!r} * total),
pair AS (SELECT r, total.lang AS ref, n_terms, n_chars FROM base JOIN total ON base.lang = total.lang
         UNION ALL
         SELECT r, total.lang, n_terms, n_chars FROM base, total
         WHERE base.lang IS NULL OR base.lang NOT IN (SELECT lang FROM total)),
by_char AS (SELECT r, ref, {_divergence("p", "q")} AS far FROM (
              SELECT pair.r, ref, cls.n / n_chars::DOUBLE AS p, q
              FROM pair JOIN cls ON cls.r = pair.r JOIN ref_cls ON ref_cls.lang = ref AND ref_cls.c = cls.c WHERE n_chars > 0)
            GROUP BY r, ref),
bins AS (SELECT pair.r, ref, n_terms, common.x, coalesce(term.n, 0) / n_terms::DOUBLE AS p, q
         FROM pair JOIN common ON common.lang = ref LEFT JOIN term ON term.r = pair.r AND term.x = common.x WHERE n_terms > 0),
by_word AS (SELECT r, ref, count(*) AS bins, {_divergence("p", "q")} AS far FROM (
              SELECT r, ref, p, q FROM bins
              UNION ALL
              SELECT pair.r, pair.ref, 1 - coalesce(sum(p), 0), 1 - coalesce(sum(q), 0)
              FROM pair LEFT JOIN bins ON bins.r = pair.r AND bins.ref = pair.ref WHERE pair.n_terms > 0 GROUP BY pair.r, pair.ref)
            GROUP BY r, ref),
verdict AS (SELECT r, bool_or(
              (n_chars < {quality.LEAST_CHARS} OR by_char.far <= {_bound(quality.CHAR_DISTANCE, str(len(quality.CLASSES)), "n_chars")})
              AND (n_terms < {quality.LEAST_WORDS} OR by_word.far <= {_bound(quality.WORD_DISTANCE, "bins", "n_terms")})) AS near
            FROM pair LEFT JOIN by_char USING (r, ref) LEFT JOIN by_word USING (r, ref) GROUP BY r),
judged AS (SELECT *, n_words < {quality.LEAST} OR 100 * n_repeat_words > {round(100 * quality.REPEATED)} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(near, true) AS kept
FROM judged LEFT JOIN verdict USING (r)
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.Base._fields, "kept")


@query("op11_ranked_search", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{WORDS_OF}') AS w FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT i, item_id, x, count(*) AS times FROM (
        SELECT i, item_id, unnest(regexp_extract_all({LOWER}, '{WORDS_OF}')) AS x
        FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)) GROUP BY i, item_id, x),
p AS (SELECT r, doc_id, n, x, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS x FROM d)
      WHERE x IN (SELECT x FROM q) GROUP BY r, doc_id, n, x),
t AS (SELECT x, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s GROUP BY x),
scored AS (SELECT i, item_id, r, doc_id,
             sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
           FROM q JOIN t USING (x) JOIN p USING (x), s GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
