"""Column functions on raw HTML: tags, attributes, in-row element selection.

These work on one page at a time inside the scan stage.  Quantifiers over
attribute text are possessive, so the matcher neither backtracks nor recurses
on long or broken tags.

Pages come with quoted, single-quoted and unquoted attribute values, and with
``<`` and ``>`` inside them.  ``tidy`` reads tags by one grammar, in which a quote
counts only after an equals sign, and writes every value in double quotes with
those signs as entities.  All other functions see tidy tags only.  Pages that
are tidy already, which one scan tells, are not rewritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressgraph.functions.binding import let
from pressgraph.functions.text import inner_trim, unescape

_IN_TAG = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
ATTRIBUTE = r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
SCRIPTS = (
    r"(?is)<(?:script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)|!--.*?(?:-->|\z))"
)
MARK = "\u0001"
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)"
_OPEN_TAG = rf"<[a-zA-Z][^\s>]*+(?:[^>\"'=]++|=\s*+{_VALUE}?+|[\"'])*+>"
#: Scripts, styles and comments whole, tags, and the text between; together they are the page.
_PIECE = rf"(?s)(?i:{SCRIPTS.removeprefix('(?is)')})|{_OPEN_TAG}|[^<]++|<"
_UNTIDY = r"<[a-zA-Z](?![^<>\"'=]*+(?:=\s*+\"[^\"<>]*+\"[^<>\"'=]*+)*+>)"
_PAIR = rf"[^\s=/>\"'][^\s=/>]*+(?:\s*+=\s*+{_VALUE})?"
#: Elements that hold nothing, that hold none of their own name, and that end without a close.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
NEVER_NESTED = ["a", "title", "button", "textarea", "select"]
OPTIONAL_CLOSE = ["p", "li", "dt", "dd", "td", "th", "tr", "option"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def drop_scripts(html: Column | str) -> Column:
    """Remove scripts, styles and comments; each leaves one space.  Tags are tidy after this."""
    return let(F.regexp_replace(_col(html), SCRIPTS, " "), tidy)


def _tidy_pair(pair: Column) -> Column:
    name = F.regexp_extract(pair, r"^[^\s=]+", 0)
    value = F.regexp_extract(pair, r"(?s)^[^\s=]+\s*=\s*(.*)$", 1)
    bare = F.regexp_replace(value, r"(?s)^([\"'])(.*)\1$", "$2")
    for sign, entity in (('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        bare = F.replace(bare, F.lit(sign), F.lit(entity))
    return F.when(pair.contains("="), F.concat(F.lit(" "), name, F.lit('="'), bare, F.lit('"'))).otherwise(
        F.concat(F.lit(" "), name))


def tidy(html: Column | str) -> Column:
    """The page with every attribute value in double quotes and without ``<`` or ``>`` in values."""
    def fix(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^<[a-zA-Z][^\s>/]*", 0)
        inside = F.regexp_replace(F.substr(piece, F.length(name) + 1), r"/?\s*>$", "")
        pairs = F.transform(F.regexp_extract_all(inside, F.lit(_PAIR), F.lit(0)), _tidy_pair)
        return F.when(piece.rlike("^" + _UNTIDY) & piece.endswith(">"), F.concat(
            name, F.array_join(pairs, ""), F.when(piece.endswith("/>") & ~piece.rlike(r"=\s*[^\s\"'>]*/>$"), "/>").otherwise(">"),
        )).otherwise(piece)

    h = _col(html)
    scripts = r"(?i)^<(?:script|style)\b"
    pieces = F.regexp_extract_all(h, F.lit(_PIECE), F.lit(0))
    # Text between tags, which is most of a page, goes past the patterns.
    rebuilt = F.array_join(F.transform(
        pieces, lambda x: F.when(~x.startswith("<") | x.rlike(scripts), x).otherwise(fix(x))), "")
    return F.when(h.rlike(_UNTIDY), rebuilt).otherwise(h)


def elements_at(pieces: Column) -> Column:
    """The element that each piece begins: its open tag and what it holds, without its close.

    ``pieces`` is a page from some open tag on, cut before open tags.  The end is
    the close that matches: opens and closes of the same tag are counted.  Tags
    that hold nothing or whose close may be left out end with the piece or at
    their first close, and so does an element without a matching close.
    """
    return let(pieces, lambda all_: F.transform(all_, lambda p, i: _element(p, all_, i)))


def _element(piece: Column, pieces: Column, i: Column) -> Column:
    name = F.lower(F.regexp_extract(piece, r"^<([a-zA-Z][a-zA-Z0-9]*)", 1))
    # Patterns that are no literals are compiled for each value, so plain searches come first.
    return let(F.struct(name.alias("name"), F.lower(piece).alias("low")), lambda x: let(
        F.struct(x["name"].alias("name"), x["low"].alias("low"), F.position(F.concat(F.lit("</"), x["name"]), x["low"]).alias("at")),
        lambda y: _ending(piece, pieces, i, y["name"], y["low"], y["at"])))


def _ending(piece: Column, pieces: Column, i: Column, name: Column, low: Column, at: Column) -> Column:
    close = F.concat(F.lit("(?i)</"), name, F.lit(r"\b"))
    sure = (at > 0) & F.substr(low, at + F.length(name) + 2, F.lit(1)).isin(">", " ", "\n")
    first = F.when(sure, F.substr(piece, F.lit(1), at - 1)).otherwise(F.get(F.split(piece, close, 2), 0))
    again = F.position(F.concat(F.lit("<"), name), F.substr(low, F.lit(2))) > 0
    again = again & (F.position(F.concat(F.lit("<"), name), F.substr(low, F.lit(2))) < F.when(sure, at).otherwise(F.length(low)))
    open_ended = ~sure & ~F.regexp_like(piece, close)
    rest = F.array_join(F.slice(pieces, i + 1, F.size(pieces)), "")
    parts = F.split(rest, F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"\b)")))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"), F.lit(False).alias("done"))

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.when(part.startswith("</"), -1).otherwise(1)
        done = acc["done"] | (depth <= 0)
        return F.struct(depth.alias("depth"), F.when(done, acc["text"]).otherwise(F.concat(acc["text"], part)).alias("text"), done.alias("done"))

    whole = F.aggregate(parts, start, step, lambda acc: F.when(acc["done"], acc["text"]).otherwise(first))
    plain = name.isin(VOID_TAGS + OPTIONAL_CLOSE) | ~(again | open_ended)
    return F.when(plain, first).otherwise(whole)


def strip_tags(html: Column | str) -> Column:
    """All tags replaced by a space."""
    return F.regexp_replace(_col(html), r"</?[a-zA-Z!?][^>]*>", " ")


def node_text(html: Column | str) -> Column:
    """Text of a fragment: pieces joined by a space, folded and trimmed."""
    return inner_trim(unescape(strip_tags(html)))


def unwrap(html: Column | str, tags: Sequence[str]) -> Column:
    """Remove the open and close forms of some tags, keep what they hold."""
    return F.regexp_replace(_col(html), rf"(?i)</?(?:{'|'.join(tags)})\b[^>]*>", "")


def tidy_inline(html: Column | str) -> Column:
    """Unwrap emphasis without pictures, drop caps and spans in paragraphs."""
    def emphasis(h: Column) -> Column:
        bare = F.regexp_replace(h, r"(?is)<em\b[^>]*>((?:[^<]|<(?!img|/em))*+)</em\s*>", "$1")
        return F.when(F.lower(h).contains("<em"), bare).otherwise(h)

    def caps(h: Column) -> Column:
        bare = F.regexp_replace(
            h, r"(?is)<span\b[^>]*\bclass\s*=\s*[\"'][^\"']*\bdrop_?cap\b[^\"']*[\"'][^>]*>([^<]*+)</span\s*>",
            "$1")
        return F.when(F.lower(h).contains("drop"), bare).otherwise(h)

    return let(let(_col(html), emphasis), caps)


def attribute(tag: Column | str, name: str) -> Column:
    """Value of an attribute of an open tag, entities decoded; NULL if absent."""
    pairs = F.regexp_extract_all(_col(tag), F.lit(ATTRIBUTE), F.lit(0))
    hit = F.get(F.filter(pairs, lambda p: p.rlike(rf"(?i)^{name}\s*=")), 0)
    return unescape(F.regexp_extract(hit, r"(?s)^[^\s=]+\s*=\s*[\"']?(.*?)[\"']?$", 1))


def attributes(tag: Column | str) -> Column:
    """All attributes of an open tag as MAP(name -> value), first one wins."""
    pairs = F.regexp_extract_all(_col(tag), F.lit(ATTRIBUTE), F.lit(0))

    def add(acc: Column, p: Column) -> Column:
        key = F.lower(F.regexp_extract(p, r"^([^\s=]+)", 1))
        value = unescape(F.regexp_extract(p, r"(?s)^[^\s=]+\s*=\s*[\"']?(.*?)[\"']?$", 1))
        return F.when(F.map_contains_key(acc, key), acc).otherwise(
            F.map_concat(acc, F.create_map(key, value)))

    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), add)


def open_tags(html: Column | str, tag: str) -> Column:
    """All open tags of one name, in page order, as raw text."""
    return F.regexp_extract_all(
        _col(html), F.lit(rf"(?is)<{tag}\b(?:{_IN_TAG}|[^>]*>)"), F.lit(0)
    )


def first_open_tag(html: Column | str, tag: str) -> Column:
    """The first of ``open_tags``, '' if there is none; what follows it is not read."""
    return F.regexp_extract(_col(html), rf"(?is)<{tag}\b(?:{_IN_TAG}|[^>]*>)", 0)


def elements(
    html: Column | str,
    tag: str | None = None,
    attr: str | None = None,
    value: str | None = None,
    exact: bool = False,
) -> Column:
    """Elements by tag and/or attribute pattern, as raw text in page order.

    Each item is the open tag and what follows up to the matching close
    (``elements_at``).  ``value`` is searched case-insensitively inside the attribute
    (``exact`` asks for equality); without a value the attribute is ignored.
    """
    name = tag or r"[a-zA-Z][a-zA-Z0-9]*"
    need = rf"[^>]*\b{attr}\s*=" if attr and value else ""
    h = _col(html)
    marked = F.regexp_replace(h, rf"(?is)(<{name}\b{need})", f"{MARK}$1")
    pieces = F.split(marked, MARK)
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))
    if tag in NEVER_NESTED:
        found = F.transform(pieces, lambda p: F.get(F.split(p, rf"(?i)</{tag}\b", 2), 0))
    else:
        found = elements_at(pieces)
    if attr and value:
        def keep(p: Column) -> Column:
            v = attribute(open_tag(p), attr)
            return (v == value) if exact else v.rlike(f"(?i){value}")

        found = F.filter(found, keep)
        # Pages that never name the attribute skip the marking pass.
        found = F.when(F.lower(h).contains(attr.lower()), found).otherwise(
            F.array().cast("array<string>"))
    return found


def open_tag(element: Column | str) -> Column:
    # A tag without quotes ends at the first sign; the pattern reads what follows it, too.
    e = _col(element)
    first = F.concat(F.substring_index(e, ">", 1), F.lit(">"))
    plain = e.contains(">") & ~first.contains('"') & ~first.contains("'")
    return F.when(~e.startswith("<"), "").when(plain, first).otherwise(
        F.regexp_extract(e, rf"(?s)^<(?:{_IN_TAG}|[^>]*>)", 0))


def element_text(element: Column | str) -> Column:
    return node_text(element)


def attribute_pattern(attrs: Sequence[str], patterns: Sequence[str]) -> str:
    """One pattern over a whole open tag: any of ``attrs`` matching any pattern.

    '^' and '$' of a pattern refer to the attribute value, so they are turned
    into its quotes.
    """
    def quoted(q: str) -> str:
        alternatives = []
        for p in patterns:
            start = "" if p.startswith("^") else f"[^{q}]*"
            body = p.lstrip("^")
            if body.endswith("$"):
                end, body = "", body[:-1]
            else:
                end = f"[^{q}]*"
            alternatives.append(f"{start}{body.replace('.*', f'[^{q}]*')}{end}")
        return f"{q}(?:{'|'.join(alternatives)}){q}"

    dq, sq = quoted('"'), quoted("'")
    return rf"(?is)\s(?:{'|'.join(attrs)})\s*=\s*(?:{dq}|{sq})"
