"""Nesting, scoring and selection of the rows of a page in one pass over them.

Segment rows of a page stand together and in order, so what a row needs of the
rows around it is kept in a few lists while the page goes by.  ``follow`` adds
a step to a frame; steps on one another's results run in one pass over the rows
the first began with.  Only narrow columns become Python values: texts, links
and images stay Arrow columns, of which rows are taken.  A frame that did not
come from here is dealt out by page and sorted first.

Rows of a page that share a position (``page_id`` may repeat) are peers, as in
a window ordered by it: what runs along the page includes all of them.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pressgraph.constants import (
    BOOST_BASE, BOOST_STEPS, BOOST_STOP_WORDS, CHILD_SCORE_SHARE, FEW_WORDS, IMAGE_MAX_PARENTS, MIN_PARAGRAPH_CHARS,
    MIN_STOP_WORDS, SIBLING_DEFAULT_BASE, SIBLING_SHARE, TAIL_FALLBACK, TAIL_LIMIT, TAIL_MIN_NODES, TAIL_SHARE,
)
from pressgraph.operators.structure import CONTAINER_TAGS

# Workers get this code with the job and need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CONTAINERS = frozenset(CONTAINER_TAGS)

#: Narrow columns that are read off wide ones before the walk.
DERIVED: dict[str, Callable[[], Column]] = {
    "_chars": lambda: F.coalesce(F.length("plain"), F.lit(0)),
    "_bracketed": lambda: F.coalesce(F.col("plain").rlike(r"^\(.*\)$"), F.lit(False)),
    "_pictures": lambda: F.coalesce(F.size("images"), F.lit(0)),
    "_with_links": lambda: F.size("links") > 0,
    "_with_videos": lambda: F.size("videos") > 0,
    "_with_first": lambda: F.col("first_image").isNotNull(),
}
#: Columns that the steps make.
TYPES = {
    "step": "int", "depth": "int", "holder": "int", "elem": "int", "parent": "int", "in_body": "boolean",
    "dropped": "boolean", "role": "string", "score_parent": "int", "score_grandparent": "int", "good": "boolean",
    "boostable": "boolean", "up": "int", "score": "long", "n_nodes": "long", "top_id": "int", "top_score": "long",
    "levels": "array<struct<parent_depth:int,sibling:long>>", "unit_order": "struct<a:int,b:int,c:int>",
    "adopted": "boolean", "keep": "boolean", "in_top": "boolean", "ords": "array<int>",
}


class Step(NamedTuple):
    """``run`` adds ``gives`` to the lists of a page; a false ``rows`` column then leaves rows out."""

    run: Callable[[dict], None]
    needs: tuple[str, ...]
    gives: tuple[str, ...]
    rows: str | None = None


class Walk(NamedTuple):
    rows: DataFrame
    steps: tuple[Step, ...] = ()


def _walk_of(df: DataFrame) -> Walk:
    """The walk that a frame came from, else one that begins with the frame."""
    found = df.__dict__.get("_walk")
    if found is not None:
        return found
    placed = W.partitionBy("page_id").orderBy("pos")
    return Walk(df.withColumn("_place", F.row_number().over(placed)))


def begin(df: DataFrame) -> DataFrame:
    """Say of rows that those of a page stand together already, each part of the page in order."""
    df.__dict__["_walk"] = Walk(df)
    return df


def follow(df: DataFrame, step: Step, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with what the step gives, or those ``columns`` of them."""
    walk = _walk_of(df)
    steps = (*walk.steps, step)
    made = {name for s in steps for name in s.gives}
    if columns is None:
        columns = [*(c for c in df.columns if c not in step.gives), *step.gives]
    out = _mapped(walk.rows, steps, [c for c in columns if c not in made], [c for c in columns if c in made], _rows_out)
    out = out.select(*columns)
    out.__dict__["_walk"] = Walk(walk.rows, steps)
    return out


def per_page(df: DataFrame, lists: dict[str, tuple[str | None, Sequence[str]]], first: dict[str, str | None] | None = None) -> DataFrame:
    """One row a page: lists of structs of columns, of rows where a column is true; ``first`` takes a single value so."""
    walk = _walk_of(df)
    steps = walk.steps
    fields = list(dict.fromkeys([c for _, cs in lists.values() for c in cs] + list(first or ())))
    made = {name for s in steps for name in s.gives}
    wheres = {w for w in (*(w for w, _ in lists.values()), *(first or {}).values()) if w}
    return _mapped(walk.rows, steps, [c for c in fields if c not in made], [c for c in fields if c in made], _pages_out,
                   lists=lists, first=first or {}, wheres=wheres)


def _mapped(rows: DataFrame, steps: tuple[Step, ...], passed: list[str], made: list[str], out: Callable, **how) -> DataFrame:
    """Run the steps; ``passed`` columns are taken along, ``made`` ones written."""
    given = {name for s in steps for name in s.gives}
    tests = {t for w in how.get("wheres", ()) for t in w.split("&")}
    needs = {c for s in steps for c in s.needs} | tests | {"page_id", "pos"}
    narrow = sorted(needs - given)
    columns = list(dict.fromkeys([*passed, *narrow]))
    order = [c for c in ("_place",) if c in rows.columns]
    source = rows.select(*[DERIVED[c]().alias(c) if c in DERIVED and c not in rows.columns else F.col(c) for c in columns], *order)
    kinds = {f.name: f.dataType for f in source.schema.fields} | {c: T._parse_datatype_string(TYPES[c]) for c in made}
    if out is _rows_out:
        schema = T.StructType([T.StructField(c, kinds[c]) for c in [*passed, *made]])
    else:
        schema = T.StructType([T.StructField("page_id", kinds["page_id"])] + [
            T.StructField(name, T.ArrayType(T.StructType([T.StructField(c, kinds[c]) for c in cs])))
            for name, (_, cs) in how["lists"].items()] + [T.StructField(c, kinds[c]) for c in how["first"]])
    arrow = {c: to_arrow_type(kinds[c]) for c in made}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_pages(batches):
            yield from out(table, _walked(table, narrow, steps), passed, arrow, how)

    return source.mapInArrow(run, schema)


# --- in the workers -----------------------------------------------------------

def _whole_pages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole pages: the last page of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index("page_id")).to_pylist()
        if held and keys[0] != key:
            yield pa.Table.from_batches(held)
            held = []
        key, cut = keys[-1], len(keys) - 1
        while cut and keys[cut - 1] == key:
            cut -= 1
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _walked(table: pa.Table, narrow: list[str], steps: tuple[Step, ...]) -> list[dict]:
    """The pages of a table, as lists by column; ``at`` holds the places of their rows in the table."""
    columns = {c: table.column(c).to_pylist() for c in narrow}
    keys = columns["page_id"]
    pages, low = [], 0
    for high in range(1, len(keys) + 1):
        if high < len(keys) and keys[high] == keys[low]:
            continue
        page = {c: v[low:high] for c, v in columns.items()}
        at, pos = list(range(low, high)), page["pos"]
        page["spans"] = None
        if any(a >= b for a, b in zip(pos, pos[1:])):
            order = sorted(range(len(pos)), key=pos.__getitem__)
            page = {c: v and [v[i] for i in order] for c, v in page.items()}
            at = [at[i] for i in order]
            page["spans"] = _spans(page["pos"])
        page["at"], page["n"], page["key"] = at, high - low, keys[low]
        low = high
        for step in steps:
            step.run(page)
            if step.rows:
                kept = page[step.rows]
                if not all(kept):
                    n = page["n"]
                    page = {c: [x for x, k in zip(v, kept) if k] if isinstance(v, list) and len(v) == n and c != "spans" else v
                            for c, v in page.items()}
                    page["n"] = len(page["at"])
                    page["spans"] = page["spans"] and _spans(page["pos"])
        if page["n"]:
            pages.append(page)
    return pages


def _spans(pos: list[int]) -> list[tuple[int, int]]:
    ends = [i for i in range(1, len(pos)) if pos[i] != pos[i - 1]]
    return list(zip([0, *ends], [*ends, len(pos)]))


def _rows_out(table: pa.Table, pages: list[dict], passed: list[str], arrow: dict, how: dict) -> Iterator[pa.RecordBatch]:
    at = [i for p in pages for i in p["at"]]
    taken = table.select(passed)
    if len(at) != table.num_rows or any(i != k for k, i in enumerate(at)):
        taken = taken.take(pa.array(at, pa.int64()))
    for name, kind in arrow.items():
        taken = taken.append_column(name, pa.array([x for p in pages for x in p[name]], kind))
    yield from taken.combine_chunks().to_batches()


def _true(page: dict, where: str | None) -> list[bool]:
    tests = [page[t] for t in where.split("&")] if where else []
    return [all(x) for x in zip(*tests)] if tests else [True] * page["n"]


def _pages_out(table: pa.Table, pages: list[dict], passed: list[str], arrow: dict, how: dict) -> Iterator[pa.RecordBatch]:
    if not pages:
        return
    ids = table.column("page_id").take(pa.array([p["at"][0] for p in pages], pa.int64())).combine_chunks()
    columns, names = [ids], ["page_id"]
    for name, (where, fields) in how["lists"].items():
        chosen = [[i for i, t in enumerate(_true(p, where)) if t] for p in pages]
        at = pa.array([p["at"][i] for p, c in zip(pages, chosen) for i in c], pa.int64())
        values = []
        for field in fields:
            if field in arrow:
                values.append(pa.array([p[field][i] for p, c in zip(pages, chosen) for i in c], arrow[field]))
            else:
                values.append(_joined(table.column(field).take(at)))
        ends = pa.array([0, *accumulate(len(c) for c in chosen)], pa.int32())
        columns.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(values, list(fields))))
        names.append(name)
    for name, where in how["first"].items():
        at = [next((p["at"][i] for i, t in enumerate(_true(p, where)) if t), None) for p in pages]
        columns.append(_joined(table.column(name).take(pa.array(at, pa.int64()))))
        names.append(name)
    yield pa.RecordBatch.from_arrays([_joined(c) for c in columns], names)


def _joined(column) -> pa.Array:
    if not isinstance(column, pa.ChunkedArray):
        return column
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


# --- what runs along a page ----------------------------------------------------

def _running(values: list[int], spans) -> list[int]:
    """Sums up to each row, its peers included."""
    sums = list(accumulate(values))
    return sums if spans is None else [sums[high - 1] for low, high in spans for _ in range(low, high)]


def _last(events: list, spans) -> list:
    """The last event up to each row, its peers included; None is no event."""
    out, now = [], None
    for low, high in spans or ((i, i + 1) for i in range(len(events))):
        for i in range(low, high):
            if events[i] is not None:
                now = events[i]
        out.extend([now] * (high - low))
    return out


def _inside(page: dict, node: int | None) -> list[bool]:
    """True from the rows where a container opens up to the row before its close."""
    if node is None:
        return [False] * page["n"]
    steps = [1 if pos == node else -1 if step == -1 and elem == node else 0
             for pos, step, elem in zip(page["pos"], page["step"], page["elem"])]
    return [s > 0 for s in _running(steps, page["spans"])]


def _dense(words: int, links: int, spaces: int) -> bool:
    return links > 0 and float(spaces + 1) / float(max(words, 1)) * links >= 1.0


# --- steps ----------------------------------------------------------------------

def _nest(page: dict) -> tuple[list, list]:
    """``structure.nest``; gives for each row the places of the containers it stands in and belongs to."""
    pos, spans, n = page["pos"], page["spans"], page["n"]
    raw = [(1 if kind == "open" else -1 if kind == "close" else 0) if tag in _CONTAINERS else 0
           for kind, tag in zip(page["kind"], page["tag"])]
    sums = _running(raw, spans)
    step, depth, low = [], [], 0
    for s, total in zip(raw, sums):
        step.append(0 if s == -1 and total < low else s)
        depth.append(total - min(low, total))
        low = min(low, total)
    level = [d + 1 if s == -1 else d for d, s in zip(depth, step)]
    at_depth: dict[int, int] = {}
    hold, own = [], []
    for low, high in spans or ((i, i + 1) for i in range(n)):
        for i in range(low, high):
            if step[i] == 1:
                at_depth[depth[i]] = i
        for i in range(low, high):
            hold.append(at_depth.get(depth[i]))
            own.append(at_depth.get(level[i]))
    holder = [None if h is None else pos[h] for h in hold]
    page["step"], page["depth"], page["holder"] = step, depth, holder
    page["elem"] = [None if e is None else pos[e] for e in own]
    page["parent"] = [holder[i - 1] if i and step[i] == 1 else None for i in range(n)]
    return hold, own


def blocks(use_known: bool) -> Step:
    """Nesting, boilerplate regions and paragraph roles; see ``body.blocks``."""
    def run(page: dict) -> None:
        hold, own = _nest(page)
        pos, spans, n, tag, step = page["pos"], page["spans"], page["n"], page["tag"], page["step"]
        flagged, elem, parent = page["flagged"], page["elem"], page["parent"]
        # Boilerplate: containers open and close a region, other tags hold one row.
        flags = _running([
            1 if s == 1 and f else -1 if s == -1 and o is not None and flagged[o] else 0
            for s, f, o in zip(step, flagged, own)], spans)
        known = min(((rule, pos[i], flags[i] - (1 if flagged[i] else 0)) for i, rule in enumerate(page["known_rule"])
                     if rule is not None), default=None) if use_known else None
        in_body = [True] * n if known is None else _inside(page, known[1])
        page["in_body"] = in_body
        page["dropped"] = [
            f - (known[2] if known is not None and b else 0) > 0 or bool(g and s == 0)
            for f, b, g, s in zip(flags, in_body, flagged, step)]
        roles, parents, grandparents = [], [], []
        for i in range(n):
            s, t, h, is_open = step[i], tag[i], hold[i], page["kind"][i] == "open"
            # A div that holds nothing but text; of one that ends the page this is not known.
            leaf = False
            if s == 1 and t == "div" and page["n_links"][i] == 0 and not page["has_media"][i]:
                leaf = step[i + 1] == -1 if i + 1 < n else None
            above = hold[i - 1] if s == 1 and i else None
            cell = s == 1 and t == "td"
            if is_open and s == 0 and t in ("p", "pre"):
                role = t
            elif cell:
                role = "td"
            elif leaf:
                role = "p"
            elif leaf is False and h is not None and tag[h] == "div" and page["_chars"][i] > 1 and (s == 1 or not is_open):
                role = "p"
            else:
                role = None
            home = above if leaf or cell else h
            roles.append(role)
            parents.append(None if home is None else pos[home])
            grandparents.append(None if home is None else parent[home])
        page["role"], page["score_parent"], page["score_grandparent"] = roles, parents, grandparents

    return Step(run, ("kind", "tag", "flagged", "known_rule", "n_links", "has_media", "_chars"), (
        "step", "depth", "holder", "elem", "parent", "in_body", "dropped", "role", "score_parent", "score_grandparent"))


def _scored(page: dict) -> None:
    n, pos, role, n_stop, homes = page["n"], page["pos"], page["role"], page["n_stop"], page["score_parent"]
    good, boostable, up = [], [], [None] * n
    near: dict[int | None, list[int]] = {}
    for i in range(n):
        live = not page["dropped"][i]
        good.append(live and page["in_body"][i] and role[i] is not None and page["_chars"][i] > 0
                    and n_stop[i] > MIN_STOP_WORDS and not page["link_dense"][i])
        # Strong paragraph among the three nearest earlier paragraphs.
        strong = False
        if live and role[i] == "p":
            earlier = near.setdefault(homes[i], [])
            strong = any(x > BOOST_STOP_WORDS for x in earlier[-BOOST_STEPS:])
            earlier.append(n_stop[i])
        boostable.append(strong)
    ranks = {"p": 0, "pre": 1}
    among = sorted((i for i in range(n) if good[i]), key=lambda i: (ranks.get(role[i], 2), pos[i]))
    k, count, tail = 0, len(among), len(among) * TAIL_SHARE
    scores: dict[int | None, list[int]] = {}  # container: score, nodes, first feed
    for i, row in enumerate(among):
        boost = 0.0
        if boostable[row]:
            k += 1
            boost = float(BOOST_BASE) / k
        if count > TAIL_MIN_NODES and count - i <= tail:
            penalty = -((tail - (count - i)) ** 2)
            boost = float(TAIL_FALLBACK) if abs(penalty) > TAIL_LIMIT else penalty
        up[row] = value = int(n_stop[row] + boost)
        feeds = [(homes[row], value, i * 2)]
        if page["score_grandparent"][row] is not None:
            feeds.append((page["score_grandparent"][row], value // 2, i * 2 + 1))
        for home, x, nth in feeds:
            if home in scores:
                scores[home][0] += x
                scores[home][1] += 1
            else:
                scores[home] = [x, 1, nth]
    page["good"], page["boostable"], page["up"] = good, boostable, up
    own = [scores.get(p) if s == 1 else None for p, s in zip(pos, page["step"])]
    page["score"] = [s and s[0] for s in own]
    page["n_nodes"] = [s[1] if s else 0 for s in own]
    top = max(scores, key=lambda c: (max(scores[c][0], 0), -scores[c][2]), default=None)
    page["top_id"] = [top] * n
    page["top_score"] = [scores[top][0] if scores else None] * n


def scored() -> Step:
    """Candidate boosts and container scores; see ``body.scored``."""
    return Step(_scored, ("step", "dropped", "in_body", "role", "_chars", "n_stop", "link_dense", "score_parent", "score_grandparent"),
                ("good", "boostable", "up", "score", "n_nodes", "top_id", "top_score"))


def _children(page: dict, home: int | None) -> list[int | None]:
    """The row of the direct child container of ``home`` that each row lies in; -1 after its close."""
    if home is None:
        return [None] * page["n"]
    return _last([
        i if s == 1 and p == home else -1 if s == -1 and h == home else None
        for i, (s, p, h) in enumerate(zip(page["step"], page["parent"], page["holder"]))], page["spans"])


def _placed(page: dict) -> None:
    n, pos, spans = page["n"], page["pos"], page["spans"]
    steps = IMAGE_MAX_PARENTS + 1
    nodes = [page["top_id"][0]]
    for _ in range(steps):
        found = [q for p, q in zip(pos, page["parent"]) if p == nodes[-1] and q is not None] if nodes[-1] is not None else []
        nodes.append(max(found, default=None))
    inside = [_inside(page, node) for node in nodes]
    live = [not d or not b for d, b in zip(page["dropped"], page["in_body"])]
    back: list[list] = [[None] * n]
    for k in range(1, steps + 1):
        node, inner, far = nodes[k], nodes[k - 1], [None] * n
        back.append(far)
        if node is None or inner is None:
            continue
        child = [alive and kind == "open" and (parent if s == 1 else holder) == node for alive, kind, s, parent, holder in zip(
            live, page["kind"], page["step"], page["parent"], page["holder"])]
        nth = _running([1 if c else 0 for c in child], spans)
        # The child a row lies in: loose rows of the node end it.
        mine = _last([x if c else -1 if h == node else None for c, x, h in zip(child, nth, page["holder"])], spans)
        start = max((x for x, p in zip(nth, pos) if p == inner), default=None)
        if start is None:
            continue
        for i in range(n):
            if inside[k][i] and pos[i] < inner and mine[i] is not None and mine[i] >= 0:
                far[i] = start - mine[i]
    levels = []
    for i in range(n):
        here = []
        if live[i]:
            here = [(k, 0) for k in range(steps + 1) if inside[k][i]]
            here += [(k - 1, back[k][i]) for k in range(1, steps + 1) if back[k][i] is not None and not inside[k - 1][i]]
        levels.append([{"parent_depth": k, "sibling": x} for k, x in sorted(here)])
    page["levels"] = levels


def levels() -> Step:
    """Where the search for an image meets a row; see ``body.with_image_levels``."""
    return Step(_placed, ("kind", "step", "dropped", "in_body", "parent", "holder", "elem", "top_id"), ("levels",))


def _numbered(page: dict) -> None:
    sizes = [max(x, 0) for x in page["_pictures"]]
    places = sorted(((pos, nth, i) for i, (pos, size) in enumerate(zip(page["pos"], sizes)) for nth in range(size)))
    ords: list[list[int]] = [[] for _ in sizes]
    for ord_, (_, _, i) in enumerate(places, 1):
        ords[i].append(ord_)
    page["ords"] = ords
    page["_pictured"] = [size > 0 for size in sizes]


def numbered() -> Step:
    """Numbers of the images of a row within its page; rows without an image are left out."""
    return Step(_numbered, ("_pictures",), ("ords",), "_pictured")


def body(lenient: bool) -> Step:
    """What rows make the body and in which order; see ``body.body_rows``."""
    def run(page: dict) -> None:
        n, pos, step, role, chars = page["n"], page["pos"], page["step"], page["role"], page["_chars"]
        top, top_score = page["top_id"][0], page["top_score"][0]
        page["_found"] = [top is not None] * n
        if top is None:
            for name in ("unit_order", "adopted", "keep", "in_top"):
                page[name] = [None] * n
            return
        at_top = [i for i in range(n) if pos[i] == top]
        outer = max((page["parent"][i] for i in at_top if page["parent"][i] is not None), default=None)
        exact = any(page["known_exact"][i] for i in at_top) if at_top else None
        in_top, in_outer = _inside(page, top), _inside(page, outer)
        child, uncle = _children(page, top), _children(page, outer)
        n_stop, homes = page["n_stop"], page["score_parent"]
        live = [not d for d in page["dropped"]]
        is_p = [a and r == "p" and c > 0 for a, r, c in zip(live, role, chars)]
        # Sibling baseline: mean stop words of good paragraphs in the top container.
        counted = [n_stop[i] for i in range(n) if is_p[i] and in_top[i] and n_stop[i] > MIN_STOP_WORDS and not page["link_dense"][i]]
        base = sum(counted) // len(counted) if counted else SIBLING_DEFAULT_BASE
        beside = [outer is not None and h == outer for h in homes]
        adopted = [
            is_p[i] and in_outer[i] and pos[i] < top
            and (beside[i] or (n_stop[i] > base * SIBLING_SHARE and not page["link_dense"][i]))
            and (lenient or exact is False) for i in range(n)]
        # The unit a row belongs to: itself, or the child container around it.
        in_child = [
            in_top[i] and child[i] is not None and child[i] >= 0 and (role[i] is None or (homes[i] is not None and homes[i] != top))
            for i in range(n)]
        unit = [pos[child[i]] if in_child[i] else pos[i] for i in range(n)]
        units: dict[tuple[int, bool], list[int]] = {}
        for i in range(n):
            u = units.setdefault((unit[i], in_child[i]), [0, 0, 0, 0, 0])
            if live[i]:
                u[1] += page["n_links"][i]
                u[2] += page["link_spaces"][i]
                if chars[i] > 0:
                    u[0] += page["n_words"][i]
                    u[4] += n_stop[i]
            if is_p[i] and chars[i] >= MIN_PARAGRAPH_CHARS:
                u[3] += 1
        keep, order = [], []
        for i in range(n):
            is_element = page["kind"][i] == "open" and step[i] == 0
            own_p = homes[i] == top and role[i] == "p"
            if in_child[i]:
                words, links, spaces, paras, stops = units[unit[i], True]
                score = page["score"][child[i]]
                fit = not _dense(words, links, spaces) and not (score is not None and score < 1)
                if not lenient:
                    weak = paras == 0 or (score or 0) < top_score * CHILD_SCORE_SHARE
                    fit = fit and (page["tag"][child[i]] == "td" or not weak) and stops >= FEW_WORDS
            else:
                fit = own_p or (lenient and is_element and not page["link_dense"][i])
            row_ok = True
            if not lenient and (is_element or role[i] is not None):
                short = role[i] == "p" and chars[i] < MIN_PARAGRAPH_CHARS and in_child[i]
                row_ok = ((n_stop[i] >= FEW_WORDS and not page["_bracketed"][i]) or page["has_media"][i]) and not short
            keep.append(bool(chars[i] > 0 and row_ok and ((in_top[i] and live[i] and fit) or adopted[i])))
            # Adopted siblings come first, far to near; inside one sibling the
            # order of adoption is reversed.
            if not adopted[i]:
                order.append((1, unit[i], 0))
            elif beside[i]:
                order.append((0, pos[i], 0))
            else:
                order.append((0, pos[uncle[i]] if uncle[i] is not None and uncle[i] >= 0 else pos[i], -pos[i]))
        if lenient:
            # A trailing child container of three or more units is not content.
            kept = {o for o, k in zip(order, keep) if k}
            if len(kept) >= 3:
                last = max(kept)
                keep = [k and not (o == last and c) for k, o, c in zip(keep, order, in_child)]
        page["unit_order"] = [{"a": a, "b": b, "c": c} for a, b, c in order]
        page["adopted"], page["keep"] = adopted, keep
        page["in_top"] = [a and b for a, b in zip(in_top, live)]

    return Step(run, (
        "kind", "tag", "step", "holder", "elem", "parent", "known_exact", "dropped", "role", "_chars", "_bracketed", "has_media", "n_stop",
        "n_words", "n_links", "link_spaces", "link_dense", "score_parent", "score", "top_id", "top_score"),
        ("unit_order", "adopted", "keep", "in_top"), "_found")


def _within(page: dict) -> None:
    top = page["top_id"][0]
    page["_within"] = [a and not d for a, d in zip(_inside(page, top), page["dropped"])]


def inside_top() -> Step:
    """Leaves out what does not lie in the top container."""
    return Step(_within, ("step", "elem", "dropped", "top_id"), (), "_within")


def kept() -> Step:
    """Leaves out what does not make the body."""
    return Step(lambda page: None, ("keep",), (), "keep")
