"""Conversation structure repair by depth-first branch and bound.

A conversation is well formed if its roles read: perhaps a system turn, then
user and assistant in turn, ending with the assistant; or nothing at all.
Edits: Keep a row (0), Rerole it to user or assistant (2), Delete it (3; a must
for blank and duplicate rows), Insert an empty user or assistant turn anywhere
(2); a truncated row that stays adds 1. Wanted is the cheapest list of edits,
of those the one whose initials are least in ASCII.

A search node is (row, state), the state saying what may follow: 0 nothing yet,
1 after system, 2 after user, 3 after assistant. The search keeps an explicit
stack, a lower bound on the cost of every suffix, the incumbent (cost, audit),
and a table per node of the best prefix that came there: a prefix that is not
better in (cost, audit) is dropped. Equal costs at a node mean equally many
insertions, so no audit there is a prefix of another and the order of prefixes
is that of the whole audits. The search ends when no stacked prefix can beat
the incumbent, which proves it optimal.

Rows are ranked within their conversation on narrow keys, and packed into
chunks of ``CHUNK`` one-letter codes (role, fault). A conversation of one chunk
is solved at once. A longer one, however long, is solved in three passes over
its chunks: the least cost from each state before a chunk to each state behind
it; the exact least cost of what follows each chunk, folded from the last chunk
to the first (16 numbers a chunk); then each chunk's own search from every
state, with those costs behind it. Insertions stand before the chunk whose row
follows them, so the chunks' audits join to that of the whole.

The repaired rows are written out by one pass over texts that are sorted within
their conversation; a task streams them and holds a conversation's audit (one
letter a row), never its texts. The digest of a conversation is one hash over
its whole text, so one task reads a conversation from its first row to its
last.

Defined cases: nulls in role and text are one space; a null conv_id is a
conversation of its own; a null turn comes first and counts in no gap; rows of
one turn are ordered by role, then by a hash of (role, text); an empty role has
no initial and can't stay as it is; repeated rows are duplicates; a
conversation that lost all rows has zeros and an empty audit; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..operators.ranking import rank_within
from .common import written

#: Rows of a chunk.
CHUNK = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
INF = 1 << 60
SPACE = " \t\n\x0b\x0c\r"
#: state -> {initial: next state}; the role that an edit can put here and the state behind it
STAY = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = ("user", "user", "assistant", "user")
AHEAD = (2, 2, 3, 2)
#: Costs behind the last row before trailing insertions: only an empty or a closed conversation is well formed.
CLOSED = (0, INF, INF, 0)
PAIRS = ("su", "ua", "au")
#: Codes of rows: initial (s, u, a, other) x (whole, truncated, to be deleted).
CODES = "".join(chr(65 + k) for k in range(12))


# ---- one chunk -----------------------------------------------------------------------------------------------------

def _row_edits(code: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row."""
    initial, fault = divmod(ord(code) - 65, 3)
    out = [("D", DELETE, state)]
    if fault < 2:
        more = TRUNCATED if fault == 1 else 0
        to = STAY[state].get("sua "[initial])
        if to is not None:
            out.append(("K", KEEP + more, to))
        out.append(("R", REROLE + more, AHEAD[state]))
    return out


#: code -> (letter, cost) of the edits that some state allows
COSTS = {code: sorted({(x, c) for s in range(4) for x, c, _ in _row_edits(code, s)}) for code in CODES}
EDITS = {(code, state): _row_edits(code, state) for code in CODES for state in range(4)}


def _with_insertions(costs) -> list[int]:
    """Least costs from each state when insertions may come first."""
    out = list(costs)
    for _ in range(3):
        out = [min(c, INSERT + out[AHEAD[s]]) for s, c in enumerate(out)]
    return out


def suffix_bounds(codes: str, behind, last: bool) -> list[list[int]]:
    """For every row and state the least cost of the rows from there on,
    ``behind`` (a cost a state) included."""
    bounds = [_with_insertions(behind) if last else list(behind)]
    for code in reversed(codes):
        after = bounds[-1]
        bounds.append(_with_insertions([min(c + after[to] for _, c, to in EDITS[code, s]) for s in range(4)]))
    return bounds[::-1]


def _audit(node) -> str:
    out = []
    while node:
        out.append(node[0])
        node = node[1]
    return "".join(reversed(out))


def search(codes: str, start: int = 0, behind=CLOSED, last: bool = True) -> tuple[int, str, int] | None:
    """(cost with what is behind, audit, final state) of the best edits of a
    chunk that is entered in state ``start``; None if there are none."""
    n, bounds = len(codes), suffix_bounds(codes, behind, last)
    best_cost, best_audit, best_state = INF, None, None
    reached: dict[tuple[int, int], tuple[int, tuple | None]] = {}
    stack = [(bounds[0][start], 0, start, 0, None)]
    while stack:
        bound, row, state, cost, node = stack.pop()
        if bound > best_cost or bound >= INF:
            continue
        if bound == best_cost:
            prefix = _audit(node)
            if prefix > best_audit[:len(prefix)]:
                continue
        seen = reached.get((row, state))
        if seen is not None and (seen[0] < cost or (seen[0] == cost and _audit(seen[1]) <= _audit(node))):
            continue
        reached[row, state] = cost, node
        if row == n and cost + behind[state] < INF:
            audit = _audit(node)
            if best_audit is None or (cost + behind[state], audit) < (best_cost, best_audit):
                best_cost, best_audit, best_state = cost + behind[state], audit, state
        moves = []
        if row < n:
            moves = [(letter, c, row + 1, to) for letter, c, to in EDITS[codes[row], state]]
        if row < n or last:
            moves.append(("I", INSERT, row, AHEAD[state]))
        todo = sorted((cost + c + bounds[at][to], letter, cost + c, at, to) for letter, c, at, to in moves)
        for bound, letter, total, at, to in reversed(todo):  # the most promising is popped first
            if bound <= best_cost:
                stack.append((bound, at, to, total, (letter, node)))
    return None if best_audit is None else (best_cost, best_audit, best_state)


def crossing_costs(codes: str, last: bool) -> list[list[int]]:
    """Least costs from each state before a chunk to each state behind it
    (for the last chunk: to a well-formed end)."""
    if last:
        return [[c] for c in suffix_bounds(codes, CLOSED, True)[0]]
    to = [suffix_bounds(codes, [0 if s == e else INF for s in range(4)], False)[0] for e in range(4)]
    return [[min(to[e][s], INF) for e in range(4)] for s in range(4)]


def costs_behind(crossings: list[list[list[int]]]) -> list[list[int]]:
    """The exact costs behind each chunk of a conversation, by state."""
    out = [list(CLOSED)]
    after = [c[0] for c in crossings[-1]]
    for chunk in reversed(crossings[:-1]):
        out.append(after)
        after = [min(min(c + a, INF) for c, a in zip(costs, after)) for costs in chunk]
    return out[::-1]


def cost_of(codes: str, audit: str) -> int:
    """What the edits of an audit cost on a chunk."""
    rows = iter(codes)
    return sum(INSERT if letter == "I" else next(c for x, c in COSTS[next(rows)] if x == letter) for letter in audit)


def illegal_pairs(codes: str) -> int:
    initials = ["sua "[(ord(c) - 65) // 3] for c in codes]
    return sum(a + b not in PAIRS for a, b in zip(initials, initials[1:]))


# ---- on Spark ------------------------------------------------------------------------------------------------------

def _key(conv_id):
    """A key that tells null from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with the damage that a hash of (conv_id, turn) names:
    rows (conv_id, turn, role, text, copy)."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), h.alias("_h")).filter("_h <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _ident():
    """What tells (role, text) apart."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("ident")


def _order():
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("ident").asc(), F.col("copy").asc()]


def coded_rows(rows: DataFrame) -> DataFrame:
    """A narrow row per row of a conversation: key, turn, place (from 1), size
    (of the conversation), blank, duplicate, truncated, code."""
    stripped = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = rows.select(_key("conv_id").alias("key"), "turn", "role", _ident(), "copy", (stripped == "").alias("blank"),
                         (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("cut"), kind.alias("kind"))
    ranked = rank_within(narrow, _order(), by=["key"], name="place", size_name="size")
    firsts = ranked.groupBy("key", "ident").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    marked = ranked.join(firsts.select("key", "ident", "first"), ["key", "ident"], "left")
    again = F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    marked = marked.withColumn("duplicate", ~F.col("blank") & again).withColumn("truncated", ~F.col("blank") & ~again & F.col("cut"))
    fault = F.when(F.col("blank") | F.col("duplicate"), 2).when(F.col("truncated"), 1).otherwise(0)
    return marked.select("key", "turn", "place", "size", "blank", "duplicate", "truncated",
                         F.char(F.lit(65) + F.col("kind") * 3 + fault).alias("code"))


def _per_row(rows: DataFrame, schema: str, function) -> DataFrame:
    """Map Arrow rows of small strings and numbers to rows of ``schema``."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([function(r) for r in batch.to_pylist()], schema=arrow)

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return rows.mapInArrow(run, schema)


def solved_chunks(coded: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, chunk, audit, cost, illegal, ends) of every chunk of every
    conversation; ``illegal`` counts the pairs inside the chunk, ``ends`` holds
    its first and last code."""
    number = F.floor((F.col("place") - 1) / chunk).cast("long")
    packed = coded.withColumn("chunk", number).groupBy("key", "chunk").agg(
        F.expr("concat_ws('', transform(array_sort(collect_list(struct(place, code))), x -> x.code))").alias("codes"),
        F.max("size").alias("size"))
    packed = written(packed.withColumn("last", F.col("chunk") == F.floor((F.col("size") - 1) / chunk)), "conversation-chunks")
    kept = {}

    def whole(r):
        codes = r["codes"]
        if codes not in kept:
            if len(kept) > 50_000:
                kept.clear()
            audit = search(codes)[1]
            kept[codes] = {"audit": audit, "cost": cost_of(codes, audit), "illegal": illegal_pairs(codes), "ends": codes[0] + codes[-1]}
        return {"key": r["key"], "chunk": r["chunk"], **kept[codes]}

    short = F.col("size") <= chunk
    one = _per_row(packed.filter(short).select("key", "chunk", "codes"),
                   "key string, chunk long, audit string, cost long, illegal long, ends string", whole)
    many = packed.filter(~short)
    if many.isEmpty():
        return one

    def crossing(r):
        return {"key": r["key"], "chunk": r["chunk"], "costs": crossing_costs(r["codes"], r["last"])}

    def fold(r):
        return {"key": r["key"], "behind": costs_behind([c["costs"] for c in sorted(r["chunks"], key=lambda c: c["chunk"])])}

    crossed = _per_row(many, "key string, chunk long, costs array<array<long>>", crossing)
    chunks = crossed.groupBy("key").agg(F.collect_list(F.struct("chunk", "costs")).alias("chunks"))  # 16 numbers a chunk
    behind = _per_row(chunks, "key string, behind array<array<long>>", fold).select("key", F.posexplode("behind").alias("chunk", "behind"))

    def searched(r):
        codes = r["codes"]
        got = [search(codes, s, r["behind"], r["last"]) for s in range(4)]
        return {"key": r["key"], "chunk": r["chunk"], "audits": [g and g[1] for g in got], "states": [g and g[2] for g in got],
                "costs": [g and cost_of(codes, g[1]) for g in got], "illegal": illegal_pairs(codes), "ends": codes[0] + codes[-1]}

    found = written(_per_row(many.join(behind.withColumn("chunk", F.col("chunk").cast("long")), ["key", "chunk"]),
                             "key string, chunk long, audits array<string>, states array<int>, costs array<long>, illegal long, ends string",
                             searched), "chunk-searches")

    def walk(r):
        entered, at = [], 0
        for c in sorted(r["chunks"], key=lambda c: c["chunk"]):
            entered.append(at)
            at = c["states"][at]
        return {"key": r["key"], "entered": entered}

    steps = found.groupBy("key").agg(F.collect_list(F.struct("chunk", "states")).alias("chunks"))  # 4 numbers a chunk
    entered = _per_row(steps, "key string, entered array<int>", walk).select("key", F.posexplode("entered").alias("chunk", "entered"))
    joined = found.join(entered.withColumn("chunk", F.col("chunk").cast("long")), ["key", "chunk"])
    return one.unionByName(joined.select("key", "chunk", F.expr("audits[entered]").alias("audit"), F.expr("costs[entered]").alias("cost"),
                                         "illegal", "ends"))


class Replay:
    """Applies an audit to the rows of a conversation, one after the other."""

    def __init__(self):
        self.audit, self.at, self.state = [], 0, 0

    def add(self, audit: str) -> None:
        self.audit.append(audit)

    def _letters(self):
        if len(self.audit) != 1:
            self.audit = ["".join(self.audit)]
        return self.audit[0]

    def insertions(self):
        """(I, role, text) of the insertions that stand here."""
        audit = self._letters()
        while self.at < len(audit) and audit[self.at] == "I":
            yield "I", ROLE[self.state], b""
            self.state, self.at = AHEAD[self.state], self.at + 1

    def row(self, role: str, text: bytes):
        """(letter, role, text) of the rows that come of one row."""
        yield from self.insertions()
        letter = self._letters()[self.at]
        self.at += 1
        if letter == "K":
            yield letter, role, text
            self.state = STAY[self.state][role[0]]
        elif letter == "R":
            yield letter, ROLE[self.state], text
            self.state = AHEAD[self.state]


def _sorted_for_replay(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """A conversation's audits, then its rows in order, in one partition."""
    texts = rows.select(_key("conv_id").alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("chunk"), "turn", "role",
                        _ident(), "copy", F.col("text").cast("binary").alias("text"))
    audits = solved.select("key", F.lit(0).alias("kind"), "chunk", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                           F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("ident"),
                           F.lit(None).cast("int").alias("copy"), F.col("audit").cast("binary").alias("text"))
    both = texts.unionByName(audits).repartition("key").sortWithinPartitions("key", "kind", "chunk", *_order())
    return both.select("key", "kind", "role", "text")


def _conversations(batches):
    """(key, replay) per conversation and (key, None, role, text) per row of a
    sorted partition; (key, None, None, None) after its last row."""
    key, replay = None, None
    for batch in batches:
        for k, kind, role, text in zip(*(batch.column(c) for c in ("key", "kind", "role", "text"))):
            k = k.as_py()
            if k != key:
                if key is not None:
                    yield key, replay, None, None
                key, replay = k, Replay()
            if kind.as_py() == 0:
                replay.add(text.as_py().decode())
            else:
                yield key, replay, role.as_py(), text.as_py()
    if key is not None:
        yield key, replay, None, None


def repaired_rows(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repaired conversations: conv_key, place (from 0), edit (K, R or I),
    role, text; ``conv_key`` is ``=`` and the conv_id, or empty for null."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                                F.lit(0).alias("copy"))
    return _repaired(rows, solved_chunks(coded_rows(rows), chunk))


def _repaired(rows: DataFrame, solved: DataFrame) -> DataFrame:
    def run(batches):
        out, key, place = [], None, 0

        def full():
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                                             names=["conv_key", "place", "edit", "role", "text"])
            out.clear()
            return got

        for k, replay, role, text in _conversations(batches):
            place = place if k == key else 0
            key = k
            for letter, r, t in (replay.insertions() if role is None else replay.row(role, text)):
                out.append((k, place, letter, r, t.decode()))
                place += 1
            if len(out) >= 1000:
                yield full()
        if out:
            yield full()

    return _sorted_for_replay(rows, solved).mapInArrow(run, "conv_key string, place long, edit string, role string, text string")


def _digests(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """(key, repaired_sha256): the hash of the repaired ``role:text`` lines."""
    def run(batches):
        out, sha, lines = [], hashlib.sha256(), 0
        for key, replay, role, text in _conversations(batches):
            for _, r, t in (replay.insertions() if role is None else replay.row(role, text)):
                sha.update((b"\n" if lines else b"") + r.encode() + b":" + t)
                lines += 1
            if role is None:
                out.append((key, sha.hexdigest()))
                sha, lines = hashlib.sha256(), 0
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["key", "repaired_sha256"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["key", "repaired_sha256"])

    return _sorted_for_replay(rows, solved).mapInArrow(run, "key string, repaired_sha256 string")


def repair_report(originals: DataFrame, rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per conv_id of ``originals`` the faults of its ``rows`` (conv_id, turn,
    role, text, copy), the cheapest repair and its digest."""
    coded = written(coded_rows(rows), "conversation-codes")
    solved = written(solved_chunks(coded, chunk), "conversation-audits")
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    turns = coded.groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).cast("long").alias("gaps"))
    faults = coded.groupBy("key").agg(count("blank"), count("duplicate"), count("truncated"))
    initial = lambda code: F.translate(code, CODES, "".join(x * 3 for x in "sua "))
    before = F.lag("ends").over(Window.partitionBy("key").orderBy("chunk"))  # a row a chunk
    pair = F.concat(initial(F.substring("before", 2, 1)), initial(F.substring("ends", 1, 1)))
    border = F.when(F.col("before").isNotNull() & ~pair.isin(*PAIRS), 1).otherwise(0)
    costs = solved.withColumn("before", before).groupBy("key").agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda c: c["audit"])).alias("audit"),
        F.sum("cost").alias("cost"), F.sum(F.col("illegal") + border).alias("illegal"))
    ids = originals.select("conv_id", _key("conv_id").alias("key")).groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    out = ids.join(faults, "key", "left").join(turns, "key", "left").join(costs, "key", "left").join(_digests(rows, solved), "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged_and_repaired(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Damage all conversations, repair them and report on each."""
    return repair_report(conversations, damaged(conversations), chunk)
