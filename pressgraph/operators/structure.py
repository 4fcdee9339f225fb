"""Pages as relations: tokens, segments and container nesting.

A page becomes rows, one per token or per block-level segment, in page order.
Nesting is computed by windows over *container* tags only; tags whose close
is optional (p, li, br, b ...) never count towards depth, so unclosed markup
cannot shift the structure.

All windows are keyed by ``page_id`` first.  Pages are spread by that key
once, before the rows are multiplied, and every later window and aggregate
reuses that distribution: one shuffle of the page text in all.  A source that
is already bucketed by ``page_id`` needs none (``spread=False``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressgraph import constants as K
from pressgraph.functions import html as H
from pressgraph.functions import text as T
from pressgraph.functions import urls as U
from pressgraph.operators import media as V

CONTAINER_TAGS = [
    "html", "head", "body", "div", "article", "section", "header", "footer", "nav", "main",
    "aside", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "td", "th",
    "blockquote", "form", "fieldset", "figure", "center", "object", "noscript", "details",
]
BLOCK_TAGS = CONTAINER_TAGS + [
    "p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "hr", "title", "option",
    "figcaption", "caption", "summary", "legend", "address",
]
_TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
    r"|</?[a-z!?](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-z!?][^>]*>|[^<]+|<"
)
_FLAG = H.attribute_pattern(["id", "class", "name"], K.BOILERPLATE_PATTERN.split("|"))
_FLAG_BROAD = H.attribute_pattern(["id", "class", "name"], K.BOILERPLATE_PATTERN_BROAD.split("|"))
_WIDGET = H.attribute_pattern(["id", "class"], K.WIDGET_PATTERNS)


_MEDIA = r"(?i)<(iframe|embed|object)\b"

PAGE_BYTES_PER_TASK = 32 << 20
UNKNOWN_BYTES = 1 << 60


def page_tasks(pages: DataFrame) -> int:
    """Number of page partitions: by scanned bytes, at least the shuffle setting.

    Cutting a page into rows costs far more CPU than its bytes suggest, so
    partitions are kept smaller than the usual file split and are not merged
    by the adaptive planner.
    """
    spark = pages.sparkSession
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Sizes of the scans, not of the plan: estimates above a join multiply.  A
    # source that cannot tell its size reports a huge default and is left out.
    leaves = pages._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < UNKNOWN_BYTES)
    return max(floor, min(size // PAGE_BYTES_PER_TASK, 1_000_000))


def spread_pages(pages: DataFrame, spread: bool = True) -> DataFrame:
    kept = pages.filter(F.col("html").isNotNull()) if "html" in pages.columns else pages
    return kept.repartition(page_tasks(kept), "page_id") if spread else kept


def tokens(pages: DataFrame, spread: bool = True) -> DataFrame:
    """``(page_id, pos, tok, kind, tag, attrs, depth, ...)``, one row per token.

    ``kind`` is open, close, text, script or comment.
    """
    rows = spread_pages(pages, spread).select(
        "page_id", F.posexplode_outer(F.regexp_extract_all(H.tidy("html"), F.lit(_TOKEN), F.lit(0))).alias("pos", "tok"))
    # Outer explodes here and elsewhere keep the planner from testing the array
    # for emptiness first, which would cut every page twice.
    rows = rows.filter(F.col("tok").isNotNull())
    t = F.col("tok")
    kind = (
        F.when(t.rlike("(?i)^<(script|style)"), "script")
        .when(t.startswith("<!") | t.startswith("<?"), "comment")
        .when(t.startswith("</"), "close")
        .when(t.rlike("(?i)^<[a-z]"), "open")
        .otherwise("text")
    )
    rows = rows.withColumn("kind", kind).withColumn(
        "tag",
        F.when(F.col("kind").isin("open", "close", "script"),
               F.lower(F.regexp_extract("tok", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))))
    rows = rows.withColumn(
        "attrs", F.when((F.col("kind") == "open") & t.contains("="), H.attributes("tok")))
    return nest(rows)


def nest(rows: DataFrame) -> DataFrame:
    """Add ``depth``, ``elem``, ``holder``, ``parent`` to ordered page rows.

    Needs ``page_id, pos, kind, tag``.  For every row

    * ``step``    +1 on a container open, -1 on a matched close, else 0
    * ``depth``   open containers after the row
    * ``holder``  position of the innermost open container after the row
    * ``elem``    the container a row opens, closes or lies in
    * ``parent``  on container opens, the enclosing container

    Stray closes at the top are ignored, so depth never falls below zero.
    """
    page = W.partitionBy("page_id").orderBy("pos")
    before = page.rowsBetween(W.unboundedPreceding, -1)
    container = F.col("tag").isin(CONTAINER_TAGS)
    raw_step = (
        F.when(container & (F.col("kind") == "open"), 1)
        .when(container & (F.col("kind") == "close"), -1)
        .otherwise(0)
    )
    d = rows.withColumn("_step", raw_step)
    d = d.withColumn("_sum", F.sum("_step").over(page))
    d = d.withColumn("_low", F.least(F.coalesce(F.min("_sum").over(before), F.lit(0)), F.lit(0)))
    stray = (F.col("_step") == -1) & (F.col("_sum") < F.col("_low"))
    d = d.withColumn("step", F.when(stray, 0).otherwise(F.col("_step")))
    d = d.withColumn("depth", (F.col("_sum") - F.least("_low", "_sum")).cast("int"))
    d = d.drop("_step", "_sum", "_low")
    opens = F.col("step") == 1
    level = F.col("depth") + F.when(F.col("step") == -1, 1).otherwise(0)
    d = d.withColumn("level", level)
    by_depth = W.partitionBy("page_id", "depth").orderBy("pos")
    by_level = W.partitionBy("page_id", "level").orderBy("pos")
    d = d.withColumn("holder", F.last(F.when(opens, F.col("pos")), True).over(by_depth))
    d = d.withColumn("elem", F.last(F.when(opens, F.col("pos")), True).over(by_level))
    return d.withColumn("parent", F.when(opens, F.lag("holder").over(page))).drop("level")


def containers(nested: DataFrame) -> DataFrame:
    """``(page_id, cid, tag, parent, depth, close_pos)`` of every container."""
    opened = F.col("step") == 1
    return (
        nested.filter(F.col("step") != 0)
        .groupBy("page_id", F.col("elem").alias("cid"))
        .agg(
            F.max(F.when(opened, F.col("tag"))).alias("tag"),
            F.max(F.when(opened, F.col("parent"))).alias("parent"),
            F.max(F.when(opened, F.col("depth"))).alias("depth"),
            F.max(F.when(~opened, F.col("pos"))).alias("close_pos"),
        )
    )


def select_elements(
    token_rows: DataFrame,
    tags: list[str] | None = None,
    attr: str | None = None,
    value: str | None = None,
    exact: bool = False,
) -> DataFrame:
    """Open tokens by tag list and/or attribute pattern (case-insensitive).

    An attribute without a value does not filter.
    """
    out = token_rows.filter(F.col("kind") == "open")
    if tags:
        out = out.filter(F.col("tag").isin(tags))
    if attr and value:
        v = F.try_element_at("attrs", F.lit(attr))
        out = out.filter((v == value) if exact else v.rlike(f"(?i){value}"))
    return out


def siblings(nested: DataFrame) -> DataFrame:
    """Open block rows with the positions of their neighbours in the same container."""
    rows = nested.filter(F.col("kind") == "open")
    home = F.when(F.col("step") == 1, F.col("parent")).otherwise(F.col("holder"))
    rows = rows.filter(F.col("tag").isin(BLOCK_TAGS)).withColumn("parent", home)
    w = W.partitionBy("page_id", "parent").orderBy("pos")
    return rows.select(
        "page_id", "pos", "tag", "parent",
        F.lag("pos").over(w).alias("previous"), F.lead("pos").over(w).alias("next"))


def allow_tags(token_rows: DataFrame, allowed=tuple(K.ARTICLE_HTML_TAGS)) -> DataFrame:
    """Page HTML reduced to allowed tags and text, in page order."""
    kept = token_rows.filter(
        (F.col("kind") == "text")
        | (F.col("kind").isin("open", "close") & F.col("tag").isin(list(allowed))))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "tok")))
    return kept.groupBy("page_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["tok"]), "").alias("article_html"))


# --- segments ----------------------------------------------------------------

_SEGMENT_START = rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})\b"
#: What a flagged inline element holds: elements of its own name are passed over whole, three deep.
_HELD = r"(?:[^<]++|<(?!/?\1\b))*+"
for _ in range(3):
    _HELD = rf"(?:[^<]++|<(?!/?\1\b)|<\1\b[^>]*+>{_HELD}</\1\s*+>)*+"
_INLINE_FLAGGED = (
    r"(?is)<(span|a|em|i|b|strong|small|time|cite|font|label|u)\b[^>]*?(?:"
    + _FLAG.replace("(?is)", "") + "|" + _WIDGET.replace("(?is)", "") + rf")[^>]*>{_HELD}</\1\s*>"
)


def segments(pages: DataFrame, broad: bool = False, spread: bool = True, together: bool = False,
             keep_url: bool = False) -> DataFrame:
    """One row per block-level boundary with the text that follows it.

    Scripts, styles and comments are dropped first.  ``text`` keeps a newline
    for each ``<br>``; ``links`` holds the anchors of the segment;
    ``images`` the addresses of its images, absolute if pages have a ``url``;
    ``flagged`` says that the tag itself matches a boilerplate rule.  Pages of
    ``with_language`` bring their cleaned form as ``doc``.  ``together`` sorts the
    pages of each task, so that rows of one ``page_id`` stand together.  Pages
    that have ``doc`` only, and no ``html``, give no rows where it is NULL.
    """
    base = spread_pages(pages, spread)
    base = base.sortWithinPartitions("page_id") if together else base
    carried = [c for c in ("lang", "url") if c in pages.columns]
    doc = F.col("doc") if "doc" in pages.columns else H.drop_scripts("html")
    cleaned = F.replace(doc, F.lit(H.MARK), F.lit(""))
    marked = F.regexp_replace(H.tidy_inline(cleaned), _SEGMENT_START, f"{H.MARK}$0")
    rows = base.select(
        "page_id", *carried,
        F.posexplode_outer(F.split(marked, H.MARK)).alias("pos", "seg"))
    # The close of a non-container with nothing after it bounds nothing.
    inner = [t for t in BLOCK_TAGS if t not in CONTAINER_TAGS]
    rows = rows.filter(~(F.col("seg").startswith("</") & F.col("seg").rlike(rf"(?i)^</(?:{'|'.join(inner)})\s*>\s*$")))
    s = F.col("seg")
    rows = rows.withColumn("opener", H.open_tag("seg"))
    opener = F.col("opener")
    tag = F.lower(F.regexp_extract(opener, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    flag = opener.contains("=") & (opener.rlike(_FLAG_BROAD if broad else _FLAG) | opener.rlike(_WIDGET))
    rows = rows.withColumns({
        "tag": F.when(tag.isin(BLOCK_TAGS), tag).otherwise(F.lit("text")),
        "kind": F.when(opener == "", "text").when(opener.startswith("</"), "close").otherwise("open"),
        "body": F.substr(s, F.length(opener) + 1),
    })
    # Most segments are text behind one tag: patterns that begin with a tag are not tried on them.
    rows = rows.withColumn("markup", F.col("body").contains("<"))
    markup = F.col("markup")
    rows = rows.withColumn(
        "body", F.when(markup, F.regexp_replace("body", _INLINE_FLAGGED, " ")).otherwise(F.col("body")))
    # body and article tags are exempt: a chance match would empty the page.
    exempt = F.col("tag").isin("html", "body", "article")
    known = F.lit(None).cast("int")
    for i, (t, a, v) in reversed(list(enumerate(K.KNOWN_ARTICLE_CONTAINERS))):
        rule = (F.col("tag") == t) if t else opener.rlike(H.attribute_pattern([a], [v]))
        known = F.when(rule, i).otherwise(known)
    exact = F.col("tag") == "article"
    for t, a, v in K.KNOWN_ARTICLE_CONTAINERS:
        if a:
            exact = exact | opener.rlike(H.attribute_pattern([a], [f"^{v}$"]))
    is_container = F.col("tag").isin(CONTAINER_TAGS)
    has_link = markup & F.col("body").rlike(r"(?i)<a\b")
    links = F.transform(
        H.elements("body", "a"),
        lambda e: F.struct(
            H.attribute(H.open_tag(e), "href").alias("url"), H.element_text(e).alias("text")),
    )
    no_links = F.array().cast("array<struct<url:string,text:string>>")
    images = F.filter(F.transform(H.open_tags("body", "img"), lambda t: H.attribute(t, "src")), lambda x: x != "")
    if "url" in carried:
        images = F.transform(images, lambda x: U.resolve(F.col("url"), x))
    rows = rows.withColumns({
        "flagged": (F.col("kind") == "open") & ~exempt & flag,
        "known_rule": F.when((F.col("kind") == "open") & is_container, known),
        "known_exact": (F.col("kind") == "open") & is_container & exact,
        "links": F.when(has_link, links).otherwise(no_links),
        "videos": F.when((markup | opener.rlike(_MEDIA)) & F.col("seg").rlike(_MEDIA), V.videos("seg"))
        .otherwise(F.array().cast(V.VIDEO)),
        "first_image": F.when(markup, F.nullif(H.attribute(F.regexp_extract(
            "body", r"(?is)<img\b[^>]*>", 0), "src"), F.lit(""))),
        "images": F.when(markup & F.col("body").rlike(r"(?i)<img\b"), images),
        "has_media": markup & F.col("body").rlike(r"(?i)<(img|object|embed)\b"),
        "raw_text": T.inner_trim(T.unescape(F.when(
            markup, H.strip_tags(F.regexp_replace("body", r"(?i)<br\b[^>]*>", "\u0002"))).otherwise(F.col("body")))),
    })
    # The ends of a folded text are bare, but for what stands before a last line sign.
    raw = F.col("raw_text")
    cut = raw.contains("\u0002")
    for sign in ("\u0085", "\u2028", "\u2029"):
        cut = cut | raw.endswith(sign)
    text = F.trim(F.regexp_replace(F.regexp_replace(raw, " ?\u0002 ?", "\n"), "^ +| +$", ""))
    rows = rows.withColumn("text", F.when(cut, text).otherwise(raw))
    return rows.drop("seg", "opener", "body", "markup", "raw_text", *([] if keep_url else ["url"]))
