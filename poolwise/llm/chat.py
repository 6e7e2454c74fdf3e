"""Transcript parsing: roles recovered by a hidden Markov model.

A transcript is a sequence of lines. The hidden state of a line is its role and
whether it opens a turn; what is seen of it is its speaker marker, whether it
is blank, ends in a question mark, and how long it is. Transition and emission
chances are counted from transcripts whose roles are known; Viterbi recovers
the states; turns are then rendered in one canonical form.

Viterbi runs in chunks, so no transcript has to fit a task: for each chunk the
best-path scores from every state before it to every state at its end form a
matrix, matrices are combined in a tree (max-plus products, ``FAN`` at a time),
and on the way down each part learns the states at its two ends. Inside a
chunk the path between known ends is the ordinary one. The result is exactly
that of Viterbi over the whole transcript.

Defined cases: null lines count as blank; null transcript ids are one
transcript of their own; ties in the order are broken by the line and its
marker, equal lines being interchangeable; ties between paths go to the earlier
state in ``STATES``; turns of over ``PART`` lines are given in parts; without
training lines all roles are equally likely and markers decide; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import rank_within
from .common import written

ROLES = ("system", "user", "assistant")
#: (role, opens a turn)
STATES = [(r, first) for r in ROLES for first in (True, False)]
S = len(STATES)
CHUNK, FAN, PART = 256, 256, 2048
MARKERS = ("none", "system", "user", "assistant", "other")
NAMES = {"user": "user", "human": "user", "customer": "user", "q": "user", "prompter": "user",
         "assistant": "assistant", "ai": "assistant", "bot": "assistant", "agent": "assistant", "a": "assistant",
         "model": "assistant", "system": "system", "instructions": "system"}
_MARKED = re.compile(r"\s*(?:(?P<open>\*\*|###? |<\|?|\[))?\s*(?P<name>[A-Za-z][A-Za-z0-9_]{0,19})\s*"
                     r"(?P<close>\*\*:?|\|?>|\]|:)?(?P<colon>:)?\s*")


def marker_of(line: str) -> tuple[int, int]:
    """The line's marker (an index of MARKERS) and where the text after it
    begins. A name counts as a marker if something closes it, or if a heading
    sign opens it and the line ends with it."""
    m = _MARKED.match(line)
    if not m:
        return 0, 0
    opened, closed = m["open"] or "", m["close"] or ""
    if not closed and not (opened.startswith("#") and m.end() == len(line)):
        return 0, 0
    if opened.startswith(("<", "[", "**")) and closed in ("", ":"):
        return 0, 0
    if not opened and closed != ":":
        return 0, 0
    role = NAMES.get(m["name"].lower())
    return (MARKERS.index(role) if role else 4), m.end()


def observe(lines: list[str | None]) -> np.ndarray:
    """(n, 4): marker, blank, question, length class of every line."""
    out = np.zeros((len(lines), 4), dtype=np.int64)
    for i, line in enumerate(lines):
        line = line or ""
        body = line.strip()
        out[i] = (marker_of(line)[0], not body, body.endswith("?"), min(3, len(body).bit_length() // 3))
    return out


SIZES = (len(MARKERS), 2, 2, 4)


@dataclass
class Hmm:
    start: np.ndarray  # (S,)
    move: np.ndarray  # (S, S)
    emit: list[np.ndarray]  # per feature (S, values)

    @classmethod
    def from_counts(cls, counts: dict[tuple[str, int, int], float]) -> "Hmm":
        """Add-one estimates; a transcript can't begin within a turn, nor a
        turn go on in another role."""
        start, move = np.ones(S), np.ones((S, S))
        emit = [np.ones((S, n)) * 0.5 for n in SIZES]
        for s, (role, _) in enumerate(STATES):  # the meaning of the markers, as a weak prior
            if STATES[s][1]:
                emit[0][s, MARKERS.index(role)] += 4
        for (kind, a, b), n in counts.items():
            if kind == "start":
                start[a] += n
            elif kind == "move":
                move[a, b] += n
            else:
                emit[int(kind)][a, b] += n
        for s, (role, first) in enumerate(STATES):
            if not first:
                start[s] = 0
                for before, (other, _) in enumerate(STATES):
                    if other != role:
                        move[before, s] = 0
        with np.errstate(divide="ignore"):
            return cls(np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)),
                       [np.log(e / e.sum(1, keepdims=True)) for e in emit])

    def seen(self, obs: np.ndarray) -> np.ndarray:
        return sum(e[:, obs[:, k]] for k, e in enumerate(self.emit)).T

    def _from(self) -> np.ndarray:
        """(S + 1, S): the moves, and at row S the start."""
        return np.vstack([self.move, self.start])

    def transfer(self, obs: np.ndarray) -> np.ndarray:
        """(S + 1, S): best score from each state before the lines (S: none)
        to each state of the last line."""
        score = self.seen(obs)
        best = self._from() + score[0]
        for t in range(1, len(obs)):
            best = (best[:, :, None] + self.move[None]).max(axis=1) + score[t]
        return best

    def path(self, obs: np.ndarray, before: int = S, end: int = -1) -> np.ndarray:
        """Best states of the lines, given the state before them and, unless
        negative, the state of the last one."""
        score = self.seen(obs)
        best = self._from()[before] + score[0]
        back = np.zeros((len(obs), S), dtype=np.int64)
        for t in range(1, len(obs)):
            every = best[:, None] + self.move
            back[t] = every.argmax(axis=0)
            best = every.max(axis=0) + score[t]
        out = np.zeros(len(obs), dtype=np.int64)
        out[-1] = best.argmax() if end < 0 else end
        for t in range(len(obs) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of transfers: a, then b."""
    return (a[:, :, None] + b[None, :S]).max(axis=1)


def ends(parts: list[np.ndarray], before: int, end: int) -> list[tuple[int, int]]:
    """For consecutive transfers: the states before and at the end of each on
    the best way from ``before`` to ``end`` (negative: the best end)."""
    reach = [parts[0][before]]
    for m in parts[1:]:
        reach.append((reach[-1][:, None] + m[:S]).max(axis=0))
    last = int(reach[-1].argmax()) if end < 0 else end
    out = [0] * len(parts)
    for i in range(len(parts) - 1, -1, -1):
        out[i] = last
        if i:
            last = int((reach[i - 1] + parts[i][:S, last]).argmax())
    return list(zip([before, *out[:-1]], out))


# -- on Spark ---------------------------------------------------------------

def conversation_lines(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of a table (conv_id, turn, role, text): the lines of
    each turn under one of six marker styles, chosen by the conversation. In a
    tenth of the turns the marker is lost; half of the conversations
    put a blank line between turns. Role and the opening line stay beside them
    as the truth for training and tests."""
    style = F.crc32(F.encode(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "UTF-8")) % 6
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit("")))
    lost = F.crc32(F.encode(key, "UTF-8")) % 10 == 0
    role = F.coalesce("role", F.lit("other"))
    alias = F.when(role == "user", "Human").when(role == "assistant", "AI").otherwise(F.initcap(role))
    name = F.initcap(role)
    text = F.coalesce("text", F.lit(""))
    marked = (F.when(lost, text).when(style == 0, F.concat(name, F.lit(": "), text)).when(style == 1, F.concat(alias, F.lit(": "), text))
              .when(style == 2, F.concat(F.lit("### "), name, F.lit("\n"), text)).when(style == 3, F.concat(F.lit("<|"), role, F.lit("|>\n"), text))
              .when(style == 4, F.concat(F.lit("["), role, F.lit("] "), text)).otherwise(F.concat(F.lit("**"), name, F.lit("**: "), text)))
    blank = F.crc32(F.encode(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "UTF-8")) % 2 == 0
    whole = F.when(blank, F.concat(marked, F.lit("\n"))).otherwise(marked)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                role.alias("role"), F.posexplode(F.split(whole, "\n")).alias("no", "line"))


def numbered(lines: DataFrame) -> DataFrame:
    """Lines (conv_id, turn, no, line, ...) with their 0-based place ``n`` in
    the transcript and its ``chunk``; written."""
    order = [F.col("turn").asc_nulls_first(), F.col("no").asc(), F.coalesce("line", F.lit("")).asc(),
             F.monotonically_increasing_id()]
    keyed = lines.withColumn("_tie", order.pop())
    ranked = rank_within(keyed, [*order, F.col("_tie").asc()], by=["conv_id"], name="n", groups_bounded=False).drop("_tie")
    return written(ranked.withColumn("n", F.col("n") - 1).withColumn("chunk", F.floor(F.col("n") / CHUNK)), "transcript-lines")


def per_chunk(lines: DataFrame, fn, schema: str) -> DataFrame:
    """Apply ``fn`` (a frame of one chunk's lines, in order -> a frame) to every
    chunk. Chunks are dealt out by key and come sorted, so a task walks through
    many of them with one frame in memory."""
    def applied(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf).assign(_none=bool(pdf["_none"].iloc[0]))

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            keys = np.stack([pdf[c].to_numpy().astype(np.int64) for c in ("conv_id", "_none", "chunk")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
            done = [applied(pdf.iloc[a:b]) for a, b in zip(cuts, cuts[1:])]
            if done:
                yield pd.concat(done, ignore_index=True)
            rest = pdf.iloc[cuts[-1]:].reset_index(drop=True)
        if rest is not None:
            yield applied(rest)

    # null ids travel as a flag: a null would turn pandas' integers into floats
    safe = lines.withColumn("_none", F.col("conv_id").isNull()).withColumn("conv_id", F.coalesce("conv_id", F.lit(0)).cast("long"))
    dealt = safe.repartition("conv_id", "_none", "chunk").sortWithinPartitions("conv_id", "_none", "chunk", "n")
    out = dealt.mapInPandas(run, f"{schema}, _none boolean")
    if "conv_id" in out.columns:
        out = out.withColumn("conv_id", F.when(~F.col("_none"), F.col("conv_id")))
    return out.drop("_none")


def train(lines: DataFrame) -> Hmm:
    """Count starts, moves and emissions of numbered lines with their true
    ``role``, chunk by chunk (moves across chunk borders aside)."""
    known = lines.filter(F.col("role").isin(*ROLES))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        obs = observe(pdf["line"].tolist())
        state = np.array([STATES.index((r, k == 0)) for r, k in zip(pdf["role"], pdf["no"])])
        rows = [("start", int(state[0]), 0)] if pdf["n"].iloc[0] == 0 else []
        n = pdf["n"].to_numpy()
        rows += [("move", int(a), int(b)) for a, b, gap in zip(state[:-1], state[1:], np.diff(n)) if gap == 1]
        rows += [(str(k), int(s), int(o[k])) for s, o in zip(state, obs) for k in range(len(SIZES))]
        found = Counter(rows)
        return pd.DataFrame([(*key, n) for key, n in found.items()], columns=["kind", "a", "b", "n"])

    summed = (per_chunk(known.select("conv_id", "chunk", "n", "no", "role", "line"), count, "kind string, a int, b int, n long")
              .groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))  # at most a few hundred rows
    return Hmm.from_counts({(r.kind, r.a, r.b): float(r.n) for r in summed.collect()})


def boundaries(lines: DataFrame, hmm: Hmm, fan: int = FAN) -> DataFrame:
    """(conv_id, chunk, before, end): the states around every chunk on its
    transcript's best path."""
    def transfers(pdf: pd.DataFrame) -> pd.DataFrame:
        m = hmm.transfer(observe(pdf["line"].tolist()))
        return pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]], "at": [int(pdf["chunk"].iloc[0])], "m": [m.ravel().tolist()]})

    def matrix(values) -> np.ndarray:
        return np.asarray(values, dtype=np.float64).reshape(S + 1, S)

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        out = matrix(pdf["m"].iloc[0])
        for m in pdf["m"].iloc[1:]:
            out = product(out, matrix(m))
        return pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]], "at": [int(pdf["at"].iloc[0]) // fan], "m": [out.ravel().tolist()]})

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        pairs = ends([matrix(m) for m in pdf["m"]], int(pdf["before"].iloc[0]), int(pdf["end"].iloc[0]))
        return pd.DataFrame({"conv_id": pdf["conv_id"], "at": pdf["at"], "before": [a for a, _ in pairs], "end": [b for _, b in pairs]})

    schema = "conv_id long, at long, m array<double>"
    levels = [written(per_chunk(lines.select("conv_id", "chunk", "n", "line"), transfers, schema), "transfers")]
    group = F.floor(F.col("at") / fan).alias("up")
    while (levels[-1].agg(F.max("at")).first()[0] or 0) >= fan:
        levels.append(written(levels[-1].groupBy("conv_id", group).applyInPandas(combine, schema), "transfers"))
    known = levels[-1].select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("up"),
                                                           F.lit(S).alias("before"), F.lit(-1).alias("end"))
    for level in reversed(levels):
        parts = level.withColumn("up", group)
        joined = parts.join(known.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))
                            & (parts["up"] == known["up"])).select("conv_id", "at", "m", parts["up"], "before", "end")
        down = joined.groupBy("conv_id", "up").applyInPandas(descend, "conv_id long, at long, before int, end int")
        known = written(down, "chunk-ends").withColumnRenamed("at", "up")
    return known.withColumnRenamed("up", "chunk")


def decode(lines: DataFrame, hmm: Hmm, fan: int = FAN) -> DataFrame:
    """Numbered lines with the recovered ``role``, whether the line opens a
    turn, and the text after its marker; written. A transcript of one chunk
    has nothing before it and no given end."""
    several = written(lines.filter("chunk > 0").select(F.col("conv_id").alias("_m")).distinct(), "long-transcripts")
    long = lines.join(several, F.col("conv_id").eqNullSafe(F.col("_m")), "left_semi")
    sides = boundaries(long, hmm, fan).withColumnRenamed("conv_id", "_c").withColumnRenamed("chunk", "_chunk")
    joined = lines.select("conv_id", "chunk", "n", "line").join(
        sides, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_chunk")), "left").select(
        "conv_id", "chunk", "n", "line", F.coalesce("before", F.lit(S)).alias("before"), F.coalesce("end", F.lit(-1)).alias("end"))

    def paths(pdf: pd.DataFrame) -> pd.DataFrame:
        lines_here = [x or "" for x in pdf["line"]]
        path = hmm.path(observe(lines_here), int(pdf["before"].iloc[0]), int(pdf["end"].iloc[0]))
        first = [STATES[s][1] for s in path]
        body = [x[marker_of(x)[1]:] if f else x for x, f in zip(lines_here, first)]
        return pd.DataFrame({"conv_id": pdf["conv_id"], "chunk": pdf["chunk"], "n": pdf["n"],
                             "role": [STATES[s][0] for s in path], "opens": first, "body": body})

    return written(per_chunk(joined, paths, "conv_id long, chunk long, n long, role string, opens boolean, body string"),
                   "decoded-lines")


def turns(decoded: DataFrame, part: int = PART) -> DataFrame:
    """Canonical turns: (conv_id, turn, part, role, n_lines, text, rendered).
    The parts of a turn, joined, are the turn."""
    per = decoded.groupBy("conv_id", "chunk").agg(F.sum(F.col("opens").cast("long")).alias("opened"),
                                                 F.max(F.when(F.col("opens"), F.col("n"))).alias("last"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    per = per.select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_chunk"),
                     F.coalesce(F.sum("opened").over(before), F.lit(0)).alias("turns_before"),
                     F.max("last").over(before).alias("open_since"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # one chunk
    placed = (decoded.withColumn("_in", F.sum(F.col("opens").cast("long")).over(inside))
              .withColumn("_since", F.max(F.when(F.col("opens"), F.col("n"))).over(inside))
              .join(per, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_chunk"))))
    placed = placed.select("conv_id", (F.col("_in") + F.col("turns_before") - 1).alias("turn"), "role", "n", "body",
                           F.floor((F.col("n") - F.coalesce("_since", "open_since")) / part).cast("int").alias("part"))
    rows = placed.groupBy("conv_id", "turn", "part").agg(
        F.first("role").alias("role"), F.count(F.lit(1)).alias("n_lines"),
        F.array_sort(F.collect_list(F.struct("n", "body"))).alias("lines"))
    # narrow rows say which part is a turn's last; the lines stay spread by part
    lasts = placed.filter("part > 0").groupBy(F.col("conv_id").alias("_c"), F.col("turn").alias("_t")).agg(F.max("part").alias("_p"))
    rows = rows.join(lasts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t")), "left").withColumn(
        "_last", F.coalesce("_p", F.lit(0)))
    text = F.array_join(F.col("lines.body"), "\n")
    text = F.when(F.col("part") == 0, F.regexp_replace(text, r"^\n+", "")).otherwise(F.concat(F.lit("\n"), text))
    text = F.when(F.col("part") == F.col("_last"), F.regexp_replace(text, r"\n+$", "")).otherwise(text)
    head = F.when(F.col("part") == 0, F.concat(F.lit("<|"), "role", F.lit("|>\n"))).otherwise(F.lit(""))
    tail = F.when(F.col("part") == F.col("_last"), F.lit("\n<|end|>\n")).otherwise(F.lit(""))
    return rows.withColumn("text", text).select("conv_id", "turn", "part", "role", "n_lines", "text",
                                                F.concat(head, "text", tail).alias("rendered"))


def training_part(conv_id: Column) -> Column:
    """Four fifths of the conversations, by a checksum of the id."""
    return F.crc32(F.encode(F.coalesce(conv_id.cast("string"), F.lit("")), "UTF-8")) % 5 != 1


def parsed_transcripts(conversations: DataFrame) -> DataFrame:
    """Write the conversations as raw transcripts and parse them back."""
    lines = numbered(conversation_lines(conversations))
    hmm = train(lines.filter(training_part(F.col("conv_id"))))
    return turns(decode(lines, hmm))
