"""Metadata of a page: one projection per page, no shuffle.

Head tags are pulled out of the HTML once (``with_head``) into small arrays;
every extractor reads those arrays or guarded element searches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgraph import constants as K
from pressgraph.functions import dates as D
from pressgraph.functions import html as H
from pressgraph.functions import text as T
from pressgraph.functions import urls as U
from pressgraph.functions.binding import fixed, let

NO_STRINGS = "array<string>"


def _empty() -> Column:
    return F.array().cast(NO_STRINGS)


def _clean(html: Column | str) -> Column:
    return H.drop_scripts(html)


_MARKED_VALUES = sorted(
    {v.lower() for _, v, _ in K.PUBLISH_DATE_RULES + K.PUBLISH_DATE_META_RULES}
    | {v for _, v in K.AUTHOR_RULES} | set(K.BYLINE_VALUES) | {"tag"}
)
_MARK = (
    r"(?is)(<[a-z][a-z0-9]*\b[^>]*\s(?:property|name|itemprop|class|rel|id)\s*=\s*[\"']?[^\"'>]*(?:"
    + "|".join(v.replace(".", r"\.") for v in _MARKED_VALUES)
    + r")|<a\b[^>]*\shref\s*=\s*[\"']?[^\"'>]*(?:"
    + "|".join(x.replace("?", r"\?") for x in K.TAG_HREF_PARTS) + r"))"
)


def cleaned(pages: DataFrame) -> DataFrame:
    """Add ``doc``, the page without scripts and with tidy tags, and the attribute maps of its ``metas``."""
    d = fixed(pages, doc=_clean("html"))
    return d.withColumn("metas", F.transform(H.open_tags("doc", "meta"), H.attributes))


def html_attrs() -> Column:
    """Attributes of the first html tag."""
    return H.attributes(H.first_open_tag("doc", "html"))


def with_head(pages: DataFrame) -> DataFrame:
    """Add the head of each page as columns.

    ``metas`` and ``head_links`` are arrays of attribute maps; ``nodes`` holds
    every element whose markup may carry an author, a date or a tag, found in
    one pass over the page.  Pages of ``cleaned`` bring the first of these.
    """
    d = pages if "doc" in pages.columns else cleaned(pages)

    pieces = F.split(F.regexp_replace("doc", _MARK, H.MARK + "$1"), H.MARK)
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))

    d = d.withColumns({
        "head_links": F.transform(H.open_tags("doc", "link"), H.attributes),
        "html_attrs": html_attrs(),
        "nodes": F.transform(H.elements_at(pieces), lambda e: let(H.open_tag(e), lambda o: F.struct(
            o.alias("open"), F.lower(o).alias("low"), e.alias("element")))),
        "title_text": H.element_text(F.nullif(F.regexp_extract(
            "doc", rf"(?is)<title\b.*?(?=</?title\b|{H.MARK}|\z)", 0), F.lit(""))),
    })
    entries = F.transform(F.col("metas"), lambda m, i: F.struct(
        F.trim(F.coalesce(F.nullif(_at(m, "property"), F.lit("")), _at(m, "name"))).alias("key"),
        F.trim(F.coalesce(F.nullif(_at(m, "content"), F.lit("")), _at(m, "value"))).alias("value"),
        i.alias("at")))
    return d.withColumns({
        "og": open_graph(),
        "meta_entries": F.filter(entries, lambda e: (e["key"] != "") & (e["value"] != "")),
    })


def _at(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def _nodes(attr: str, value: str) -> Column:
    """Marked elements whose attribute contains a value, in page order."""
    pattern = H.attribute_pattern([attr], [value.replace(".", r"\.")])
    # The plain search spares most nodes the pattern.
    return F.filter("nodes", lambda n: n["low"].contains(value.lower()) & n["open"].rlike(pattern))


def _last_wins(entries: Column) -> Column:
    """MAP from (key, value) structs, the last entry of a key wins."""
    return F.aggregate(
        entries, F.create_map().cast("map<string,string>"),
        lambda acc, e: F.map_concat(
            F.map_filter(acc, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))


def open_graph() -> Column:
    found = F.filter(F.col("metas"), lambda m: _at(m, "property").startswith("og:")
                     & (_at(m, "content") != ""))
    return _last_wins(F.transform(found, lambda m: F.struct(
        F.get(F.split(_at(m, "property"), ":"), F.lit(1)).alias("key"),
        _at(m, "content").alias("value"))))


def _first_meta(test) -> Column:
    return F.get(F.filter(F.col("metas"), test), 0)


def meta_content(attr: str, value: str) -> Column:
    """Trimmed content of the first meta with this exact name, else ''."""
    return F.coalesce(
        F.trim(_at(_first_meta(lambda m: _at(m, attr) == value), "content")), F.lit(""))


def _first_link(rel: str) -> Column:
    first = F.get(F.filter(F.col("head_links"), lambda x: _at(x, "rel").rlike(f"(?i){rel}")), 0)
    return _at(first, "href")


def favicon() -> Column:
    return F.coalesce(_first_link("icon"), F.lit(""))


def canonical_link(fallback: bool = True) -> Column:
    href = F.trim(_first_link("canonical"))
    root = F.concat(U.scheme("url"), F.lit("://"), U.host("url"))
    full = F.when(U.host(href) == "", U.resolve(root, href)).otherwise(href)
    default = F.col("url") if fallback else F.lit("")
    return F.when(F.coalesce(href, F.lit("")) == "", default).otherwise(full)


def meta_language() -> Column:
    """Two-letter page language, NULL when unknown."""
    own = _at(F.col("html_attrs"), "lang")
    equiv = _first_meta(lambda m: _at(m, "http-equiv").rlike("(?i)content-language"))
    named = _first_meta(lambda m: _at(m, "name").rlike("(?i)lang"))
    raw = (
        F.when(own.isNotNull(), own)
        .when(equiv.isNotNull(), _at(equiv, "content"))
        .otherwise(_at(named, "content"))
    )
    two = F.left(raw, F.lit(2))
    return F.when(two.rlike("^[A-Za-z]{2}$"), F.lower(two))


def effective_language(lang: Column, allowed: Sequence[str] | None = None,
                       default: str = T.DEFAULT_LANGUAGE) -> Column:
    known = lang if allowed is None else F.when(lang.isin(list(allowed)), lang)
    return F.coalesce(known, F.lit(default))


def _rule_values(rules) -> Column:
    """One value per rule that matches an element: that of its first element."""
    hits = []
    for attr, value, where in rules:
        first = F.slice(_nodes(attr, value), 1, 1)
        hits.append(F.transform(first, lambda n: H.element_text(n["element"]) if where == "text"
                                else H.attribute(n["open"], where)))
    return F.concat(*hits)


def publish_raw() -> Column:
    """Date text of the first matching rule, even when its value is missing."""
    return F.get(_rule_values(K.PUBLISH_DATE_RULES), 0)


def publish_ts() -> Column:
    """URL date first, then metadata rules; unreadable values fall through."""
    texts = F.concat(F.array(U.url_date("url")), _rule_values(K.PUBLISH_DATE_META_RULES))
    return F.get(F.filter(D.parse_dates(texts), lambda t: t.isNotNull()), 0)


def clean_title(title: Column, site_name: Column, domain: Column) -> Column:
    """Site name and domain removed, one splitter stripped from each end."""
    nothing = F.lit("\u0000")
    t = F.trim(F.replace(title, F.coalesce(F.nullif(site_name, F.lit("")), nothing), F.lit("")))
    pattern = F.when(domain.rlike(r"^[a-z0-9.\-]+$"), F.concat(F.lit("(?i)"), domain))
    t = T.inner_trim(F.regexp_replace(t, F.coalesce(pattern, nothing), F.lit("")))
    edges = "|".join(f"\\{x}" if x in "|-" else x for x in K.TITLE_EDGE_SPLITTERS)
    t = F.regexp_replace(t, rf"^(?:{edges})(?: |$)", "")
    return F.trim(F.regexp_replace(t, rf"(?:^| )(?:{edges})$", ""))


def title() -> Column:
    """og:title, else the headline meta, else the title tag, cleaned."""
    headline = _first_meta(lambda m: _at(m, "name").rlike("(?i)headline"))
    raw = F.coalesce(
        F.try_element_at("og", F.lit("title")), _at(headline, "content"), F.col("title_text"))
    site = F.try_element_at("og", F.lit("site_name"))
    return F.coalesce(clean_title(raw, site, U.host("url")), F.lit(""))


def split_title_text(raw: Column | str) -> Column:
    """Longest piece after the first splitter that applies."""
    t = F.col(raw) if isinstance(raw, str) else raw

    def longest(x: Column, pattern: str) -> Column:
        best = F.aggregate(
            F.split(x, pattern), F.lit(""),
            lambda acc, p: F.when(F.length(p) > F.length(acc), p).otherwise(acc))
        return F.trim(T.replace_all(best, ("&raquo;", ""), ("»", "")))

    def later(x: Column) -> Column:
        return (
            F.when(x.contains("/"), longest(x, "/"))
            .when(x.contains("»"), longest(x, "»"))
            .when(x.contains(":"), longest(x, ":"))
            .otherwise(x)
        )

    picked = (
        F.when(t.contains("|"), longest(t, r"\|"))
        .when(t.contains("-"), longest(t, " - "))
        .when(t.contains("_"), later(longest(t, "_")))
        .otherwise(later(t))
    )
    return F.coalesce(F.replace(picked, F.lit("&#65533;"), F.lit("")), F.lit(""))


def split_title() -> Column:
    return split_title_text("title_text")


def authors() -> Column:
    """Names by author markup; the last rule that matches replaces the others."""
    by_rule = [F.transform(_nodes(a, v), lambda n: H.element_text(n["element"]))
               for a, v in K.AUTHOR_RULES]
    first, last = by_rule
    return F.array_sort(F.array_distinct(F.when(F.size(last) > 0, last).otherwise(first)))


def parse_byline(line: Column | str) -> Column:
    """Names in a by-line: 'By: Ann Lee, Bo Chan and ...' -> [Ann Lee, Bo Chan]."""
    t = F.col(line) if isinstance(line, str) else line
    t = F.regexp_replace(t, r"<[^<]+?>", "")
    t = F.trim(F.regexp_replace(t, r"[bB][yY][\:\s]|[fF]rom[\:\s]", ""))
    parts = F.transform(F.split(t, r"[^\w'\-]"), lambda x: F.trim(x))
    start = F.struct(_empty().alias("done"), _empty().alias("cur"))

    def step(acc: Column, token: Column) -> Column:
        stop = token.isin("and", "")
        full = stop & (F.size(acc["cur"]) == 2)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["cur"], " "))))
            .otherwise(acc["done"]).alias("done"),
            F.when(full, _empty())
            .when(stop | token.rlike(r"\d"), acc["cur"])
            .otherwise(F.concat(acc["cur"], F.array(token))).alias("cur"))

    def finish(acc: Column) -> Column:
        return F.when(
            F.size(acc["cur"]) >= 2,
            F.concat(acc["done"], F.array(F.array_join(acc["cur"], " ")))).otherwise(acc["done"])

    return F.aggregate(parts, start, step, finish)


def byline_authors() -> Column:
    """Names from author and byline markup, unique, each word capitalised."""
    pattern = H.attribute_pattern(K.BYLINE_ATTRIBUTES, K.BYLINE_VALUES)
    found = F.filter("nodes", lambda n: n["open"].rlike(pattern))
    lines = F.transform(found, lambda n: F.coalesce(
        F.when(n["open"].rlike("(?i)^<meta"), H.attribute(n["open"], "content"))
        .otherwise(T.unescape(F.regexp_extract(n["element"], r"(?s)^<[^>]*>([^<]*)", 1))),
        F.lit("")))
    filled = F.filter(lines, lambda x: x != "")
    names = F.array_distinct(
        F.transform(F.flatten(F.transform(filled, parse_byline)), F.lower))
    cased = F.transform(names, lambda n: F.array_join(
        F.transform(F.split(n, " "), lambda w: F.concat(
            F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 20))), " "))
    return F.array_sort(cased)


def tags() -> Column:
    """Texts of tag links, else of links whose address looks like a tag."""
    part = "|".join(x.replace("?", r"\?") for x in K.TAG_HREF_PARTS)
    anchors = F.filter("nodes", lambda n: n["open"].rlike(r"(?i)^<a\s"))
    by_rel = F.filter(anchors, lambda n: n["open"].rlike(H.attribute_pattern(["rel"], ["^tag$"])))
    by_href = F.filter(anchors, lambda n: n["open"].rlike(rf"(?is)\shref\s*=\s*[\"']?[^\"'>]*(?:{part})"))
    chosen = F.when(F.size(by_rel) > 0, by_rel).otherwise(by_href)
    texts = F.transform(chosen, lambda n: H.element_text(n["element"]))
    return F.array_sort(F.array_distinct(F.filter(texts, lambda x: x != "")))


def keyword_list(keywords: Column | str) -> Column:
    k = F.col(keywords) if isinstance(keywords, str) else keywords
    return F.transform(F.split(k, ","), lambda x: F.trim(x))


def meta_tree() -> Column:
    """MAP(path -> value) of all metas, paths being 'a:b:c'.

    A scalar met before longer paths below it moves one step down (under its
    own head, or ``identifier`` when nested); a scalar met after them replaces
    them; the last value of a path wins.
    """
    def arrange(known: Column) -> Column:
        def gone(e: Column) -> Column:
            return F.exists(known, lambda o: (o["at"] > e["at"]) & (
                (o["key"] == e["key"]) | e["key"].startswith(F.concat(o["key"], F.lit(":")))))

        def below(e: Column) -> Column:
            return F.exists(known, lambda o: (o["at"] > e["at"]) & o["key"].startswith(
                F.concat(e["key"], F.lit(":"))))

        moved = F.transform(F.filter(known, lambda e: ~gone(e)), lambda e: F.struct(
            F.when(below(e), F.concat(
                e["key"], F.lit(":"),
                F.when(e["key"].contains(":"), F.lit("identifier")).otherwise(e["key"])))
            .otherwise(e["key"]).alias("key"), e["value"].alias("value")))
        return _last_wins(moved)

    return let(F.col("meta_entries"), arrange)


def meta_numbers(tree: Column | str) -> Column:
    """The part of a meta tree whose values are whole numbers."""
    t = F.col(tree) if isinstance(tree, str) else tree
    return F.transform_values(
        F.map_filter(t, lambda k, v: v.rlike("^[0-9]{1,18}$")), lambda k, v: v.try_cast("long"))


def truncate(df: DataFrame) -> DataFrame:
    """Apply the length limits to whichever of the columns are present."""
    limits = {
        "title": F.left("title", F.lit(K.MAX_TITLE)),
        "text": F.left("text", F.lit(K.MAX_TEXT)),
        "summary": F.left("summary", F.lit(K.MAX_SUMMARY)),
        "keywords": F.slice("keywords", 1, K.MAX_KEYWORDS),
        "authors": F.slice("authors", 1, K.MAX_AUTHORS),
    }
    present = {k: v for k, v in limits.items() if k in df.columns}
    return df.withColumns(present) if present else df


def metadata(pages: DataFrame, **extra: Column) -> DataFrame:
    """All page-level metadata, one narrow row per page.

    ``extra`` names further columns to compute from the same head columns.
    """
    d = with_head(pages)
    return d.select(
        *[c.alias(n) for n, c in extra.items()],
        "page_id", "url", U.host("url").alias("domain"), title().alias("title"),
        authors().alias("authors"), publish_raw().alias("publish_raw"),
        meta_language().alias("lang"), meta_content("name", "description").alias("description"),
        meta_content("name", "keywords").alias("keywords"), favicon().alias("favicon"),
        canonical_link().alias("canonical"), F.col("og").alias("opengraph"), tags().alias("tags"),
    ).withColumn("publish_ts", D.parse_date("publish_raw"))


def source_profile(source_pages: DataFrame) -> DataFrame:
    """Description and brand of site front pages."""
    d = with_head(source_pages)
    return d.select(
        "page_id", "url", U.brand("url").alias("brand"), meta_content("name", "description").alias("description"))
