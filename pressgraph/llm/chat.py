"""Chat transcripts to canonical turns with a hidden Markov model.

A transcript is lines.  A hidden state is a role with a flag: the line starts a
turn of that role or goes on with it.  A line shows a speaker marker (a short
word or sign before a colon, bracket, dot or angle), whether it ends as a
question, whether it is blank, its length and whether it begins with a capital.
Start, transition and emission probabilities are smoothed counts over a bounded
sample of transcripts with known roles.  Viterbi gives the likeliest states;
turns are then rendered in one canonical form, markers removed.

Long transcripts are handled in parts of bounded length.  Each part yields the
best score from every entry state to every exit state; these matrices are
combined in order (a max-plus product is associative), which fixes the states
at the borders, and every part is then traced alone.  The result is as likely as
that of one Viterbi run over the whole (equally likely paths may differ), and no
task holds a whole transcript.

Defined cases: null lines are blank lines; a null conversation id is an id like
any other; equal positions are ordered by their text; repeated lines are lines;
``<|im_`` inside a text gets a space in the rendered form, so a text ends no turn;
a marker that a role does not use stays in the text;
with nothing to learn from, all states are alike and every line belongs to one
turn of the role ``user``; an empty table gives no turns; other columns do not
matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressgraph.llm import common as C
from pressgraph.session import materialise

#: Lines of a part, transcripts of the sample, and distinct markers that are told apart.
PART, SAMPLE, MARKERS = 4096, 2000, 500
#: A marker is taken from a turn's text if at least that share of the role's turns begins with it.
MARKED = 0.02
_MARKER = re.compile(r"^\s*([\[<(*#|]{0,3}\s*[^\W\d_]{1,12}\s*[\])*|]{0,3}\s*[:>.\])-]{1,2}\*{0,3}|[>$#*-]{1,3})\s+")


def split_marker(line: str) -> tuple[str, str]:
    """The speaker marker of a line in lower case ('' if none) and the rest."""
    m = _MARKER.match(line)
    return ("".join(m[1].lower().split()), line[m.end():]) if m else ("", line)


def features(line: str) -> tuple[str, ...]:
    marker, rest = split_marker(line)
    bare = rest.strip()
    return (marker, "?" if bare.endswith("?") else "blank" if not bare else "", str(min(6, len(bare).bit_length() // 2)),
            "A" if bare[:1].isupper() else "a")


@dataclass
class Model:
    roles: list[str]
    start: np.ndarray
    step: np.ndarray
    emit: list[dict[str, np.ndarray]]
    other: list[np.ndarray]
    markers: list[set[str]]  # by state, those that are no part of the text

    @property
    def states(self) -> int:
        return 2 * len(self.roles)

    def scores(self, lines: list[str]) -> np.ndarray:
        """Log probability of each line in each state; state 2r starts a turn of role r, 2r + 1 goes on."""
        out = np.zeros((len(lines), self.states))
        for i, line in enumerate(lines):
            for f, value in enumerate(features(line)):
                out[i] += self.emit[f].get(value, self.other[f])
        return out


def fit(transcripts: list[list[tuple[str, str, bool]]], whole: list[bool] | None = None) -> Model:
    """``transcripts``: lists of (line, role, starts a turn); ``whole`` tells those that begin with a transcript (None: all)."""
    roles = sorted({r for t in transcripts for _, r, _ in t}) or ["user"]
    n = 2 * len(roles)
    number = {r: 2 * i for i, r in enumerate(roles)}
    start, step = np.full(n, 0.5), np.full((n, n), 0.1)
    counts: list[dict[str, np.ndarray]] = [{} for _ in features("")]
    for t, from_start in zip(transcripts, whole or [True] * len(transcripts), strict=True):
        before = None
        for line, role, first in t:
            s = number[role] + (not first)
            if before is None:
                start[s] += from_start
            else:
                step[before, s] += 1
            before = s
            for f, value in enumerate(features(line)):
                counts[f].setdefault(value, np.zeros(n))[s] += 1
    step[:, 1::2] = [[step[a, b] if a // 2 == b // 2 else 1e-9 for b in range(1, n, 2)] for a in range(n)]  # one goes on with its own role
    start[1::2] = 1e-9
    emit, other = [], []
    for table in counts:
        common = dict(sorted(table.items(), key=lambda kv: (-kv[1].sum(), kv[0]))[:MARKERS])
        total = sum(common.values(), np.zeros(n)) + 0.5 * (len(common) + 1)
        emit.append({v: np.log((c + 0.5) / total) for v, c in common.items()})
        other.append(np.log(0.5 / total))
    begun = sum(counts[0].values(), np.zeros(n))
    markers = [{v for v, c in counts[0].items() if v and c[s] >= MARKED * begun[s] and c[s]} for s in range(n)]
    return Model(roles, np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), emit, other, markers)


def without_marker(model: Model, line: str, state: int) -> str:
    """The line without its speaker marker, if the state's role is known to speak with it."""
    marker, rest = split_marker(line)
    return rest if marker in model.markers[state] else line


def through(model: Model, scores: np.ndarray) -> np.ndarray:
    """Best score from each state before the part to each state at its end."""
    best = model.step + scores[0]
    for row in scores[1:]:
        best = (best[:, :, None] + model.step[None]).max(1) + row
    return best


def trace(model: Model, scores: np.ndarray, entry: int | None, leave: int | None) -> np.ndarray:
    """States of a part, given the state before it (None: the transcript's start) and at its end (None: free)."""
    best = (model.start if entry is None else model.step[entry]) + scores[0]
    back = []
    for row in scores[1:]:
        ways = best[:, None] + model.step
        back.append(ways.argmax(0))
        best = ways.max(0) + row
    state = [int(best.argmax()) if leave is None else leave]
    for b in reversed(back):
        state.append(int(b[state[-1]]))
    return np.array(state[::-1])


def borders(model: Model, first: np.ndarray, matrices: list[np.ndarray]) -> list[int]:
    """States at the ends of all parts: ``first`` scores the end of part one, matrices lead through the others."""
    best, back = first, []
    for m in matrices:
        ways = best[:, None] + m
        back.append(ways.argmax(0))
        best = ways.max(0)
    state = [int(best.argmax())]
    for b in reversed(back):
        state.append(int(b[state[-1]]))
    return state[::-1]


def _parts(batches):
    """(key, rows) of each run of rows with equal conv and part; rows are sorted."""
    key, rows = None, []
    for b in batches:
        for row in b.to_pylist():
            now = (row["conv"], row["part"])
            if now != key and rows:
                yield rows
                rows = []
            key = now
            rows.append(row)
    if rows:
        yield rows


def _chunks(rows, schema, most: int = 5000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def transcript_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(conv, part, pos, line) of transcripts that are one text each."""
    lines = df.select(F.col(id_col).alias("conv"), F.posexplode(F.split(C.text_or_empty(text_col), "\n")).alias("pos", "line"))
    return lines.select("conv", F.floor(F.col("pos") / PART).cast("long").alias("part"), F.col("pos").cast("long").alias("pos"), "line")


def _sorted(lines: DataFrame) -> DataFrame:
    return lines.select("conv", "part", "pos", F.coalesce("line", F.lit("")).alias("line"), *[
        c for c in ("entry", "leave") if c in lines.columns]).repartition("conv", "part").sortWithinPartitions("conv", "part", "pos", "line")


def turns(lines: DataFrame, model: Model) -> DataFrame:
    """(conv, turn, role, text, rendered): the recovered turns of each transcript."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = lines.sparkSession.sparkContext.broadcast(model)
    conv = T.StructField("conv", lines.schema["conv"].dataType)

    def lead(batches):
        m = shared.value

        def rows():
            for part in _parts(batches):
                s = m.scores([r["line"] for r in part])
                best = m.start + s[0]
                for row in s[1:]:
                    best = (best[:, None] + m.step).max(0) + row
                yield {"conv": part[0]["conv"], "part": part[0]["part"], "alone": best.tolist(), "way": through(m, s).ravel().tolist()}

        yield from _chunks(rows(), to_arrow_schema(lead_schema))

    doubles = T.ArrayType(T.DoubleType())
    lead_schema = T.StructType([conv, T.StructField("part", T.LongType()), T.StructField("alone", doubles), T.StructField("way", doubles)])
    led = materialise(_sorted(lines).mapInArrow(lead, lead_schema), "chat-parts")

    def join(batches):
        m = shared.value

        def rows():
            key, held = object(), []

            def done():
                ends = borders(m, np.array(held[0]["alone"]), [np.array(r["way"]).reshape(m.states, -1) for r in held[1:]])
                for i, r in enumerate(held):
                    yield {"conv": r["conv"], "part": r["part"], "entry": ends[i - 1] if i else None, "leave": ends[i]}

            for b in batches:
                for r in b.to_pylist():
                    if held and r["conv"] != key:
                        yield from done()
                        held.clear()
                    key = r["conv"]
                    held.append(r)
            if held:
                yield from done()

        yield from _chunks(rows(), to_arrow_schema(edge_schema))

    edge_schema = T.StructType([conv, *(T.StructField(c, T.LongType()) for c in ("part", "entry", "leave"))])
    # One row for each PART lines of a transcript.
    edges = materialise(led.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(join, edge_schema), "chat-borders")
    both = lines.join(edges, C.same(lines, edges, ("conv", "conv"), ("part", "part"))).select(
        lines["conv"], lines["part"], "pos", "line", "entry", "leave")

    def follow(batches):
        m = shared.value

        def rows():
            for part in _parts(batches):
                states = trace(m, m.scores([r["line"] for r in part]), part[0]["entry"], part[0]["leave"])
                local = 0
                for i, (r, s) in enumerate(zip(part, states.tolist(), strict=True)):
                    begins = s % 2 == 0
                    local += begins
                    yield {"conv": r["conv"], "part": r["part"], "at": i, "local": local, "role": m.roles[s // 2],
                           "line": without_marker(m, r["line"], s) if begins else r["line"]}

        yield from _chunks(rows(), to_arrow_schema(line_schema))

    line_schema = T.StructType([conv, *(T.StructField(c, T.LongType()) for c in ("part", "at", "local")),
                                T.StructField("role", T.StringType()), T.StructField("line", T.StringType())])
    traced = materialise(_sorted(both).mapInArrow(follow, line_schema), "chat-lines")
    # Turns are numbered through: starts in earlier parts, then starts in the own part.
    from pyspark.sql import Window

    starts = traced.groupBy("conv", "part").agg(F.max("local").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = starts.select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    numbered = traced.join(offset, traced["conv"].eqNullSafe(offset["_conv"]) & traced["part"].eqNullSafe(offset["_part"]))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "line"))), lambda x: x["line"]), "\n")
    whole = numbered.groupBy("conv", (F.col("ahead") + F.col("local") - 1).alias("turn")).agg(
        F.first("role").alias("role"), F.count("*").alias("n_lines"), F.trim(text).alias("text"))
    return whole.withColumn("rendered", F.concat(
        F.lit("<|im_start|>"), "role", F.lit("\n"), F.replace("text", F.lit("<|im_"), F.lit("<| im_")), F.lit("<|im_end|>\n")))


def learn(lines: DataFrame) -> Model:
    """Fit on a sample of labelled lines (conv, part, pos, line, role, begins): about SAMPLE parts, drawn by hash."""
    parts = lines.select("conv", "part").distinct()
    share = min(1.0, SAMPLE / max(1, parts.count()))
    chosen = parts.filter(F.pmod(F.xxhash64("conv", "part"), F.lit(1 << 30)) < share * (1 << 30)).select(
        F.col("conv").alias("_conv"), F.col("part").alias("_part"))
    rows = lines.join(F.broadcast(chosen), F.col("conv").eqNullSafe(F.col("_conv")) & F.col("part").eqNullSafe(F.col("_part"))).select(
        "conv", "part", "pos", "line", "role", "begins").toArrow().to_pylist()
    rows.sort(key=lambda r: (str(r["conv"]), r["part"], tuple(r["pos"].values()) if isinstance(r["pos"], dict) else r["pos"]))
    found: dict = {}
    for r in rows:
        found.setdefault((r["conv"], r["part"]), []).append((r["line"] or "", r["role"] or "user", r["begins"]))
    return fit(list(found.values()), [part <= 0 for _, part in found])

