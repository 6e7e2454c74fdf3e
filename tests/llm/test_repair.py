"""Conversation repair: the search against all edit lists, chunks against the
whole, the query against a plain version, and the defined cases."""
import hashlib
import random
import re
import zlib

import pytest

from poolwise.llm import repair

SF = "/root/testdata/sf0.001"


def slow_audit(rows):
    """(cost, audit, lines) of rows (role, text, must, cut) by trying all edit
    lists, prefixes of one place and ending compared by their whole content."""
    level = {0: (0, "", ())}  # state by what the roles so far end with: 0 nothing, 1 s, 2 u, 3 a

    def inserted(level):
        best = dict(level)
        for _ in range(4):
            for st, (c, a, t) in list(best.items()):
                role, to = ("assistant", 3) if st == 2 else ("user", 2)
                new = (c + 2, a + "I", (*t, f"{role}:"))
                best[to] = min(best.get(to, new), new)
        return best

    for role, text, must, cut in rows:
        after = {}
        for st, (c, a, t) in inserted(level).items():
            moves = [(st, c + 3, "D", ())]
            if not must:
                allowed = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
                if (st, role[:1]) in allowed:
                    moves.append((allowed[st, role[:1]], c + cut, "K", (f"{role}:{text}",)))
                new, to = ("assistant", 3) if st == 2 else ("user", 2)
                moves.append((to, c + 2 + cut, "R", (f"{new}:{text}",)))
            for to, cost, letter, line in moves:
                cand = (cost, a + letter, t + line)
                after[to] = min(after.get(to, cand), cand)
        level = after
    return min(v for st, v in inserted(level).items() if st in (0, 3))


def slow_report(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = {}
    for conv, group in by.items():
        kept = []
        for _, turn, role, text in group:
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if h == 0:
                continue
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            role = "user" if h == 4 else role
            kept += [(turn, role, text)] * (2 if h == 3 else 1)
        ident = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], ident(r)))
        seen, rowed, counts = set(), [], [0, 0, 0]
        for _, role, text in kept:
            bare = re.sub("[ \t\n\x0b\x0c\r]+$", "", text)
            again = (role, text) in seen
            seen.add((role, text))
            fault = 0 if not bare else 1 if again else 2 if bare[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            rowed.append((role, text, fault in (0, 1), fault == 2))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rowed, rowed[1:]))
        cost, audit, lines = slow_audit(rowed)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def rows_of(codes):
    return [({0: "s", 1: "u", 2: "a", 3: "x"}[(ord(c) - 65) // 3], "t", (ord(c) - 65) % 3 == 2, (ord(c) - 65) % 3 == 1) for c in codes]


@pytest.mark.parametrize("seed", range(8))
def test_search_is_optimal(seed):
    rng = random.Random(seed)
    for _ in range(60):
        codes = "".join(rng.choice(repair.CODES if seed % 2 else "ABDEGHFC") for _ in range(rng.randint(1, 9)))
        cost, audit, state = repair.search(codes)
        assert (cost, audit) == slow_audit(rows_of(codes))[:2] and state in (0, 3)
        assert repair.cost_of(codes, audit) == cost


def test_chunks_join_to_the_whole():
    rng = random.Random(9)
    for _ in range(100):
        codes, k = "".join(rng.choice(repair.CODES) for _ in range(rng.randint(1, 60))), rng.randint(1, 7)
        parts = [codes[i:i + k] for i in range(0, len(codes), k)]
        last = [i == len(parts) - 1 for i in range(len(parts))]
        behind = repair.costs_behind([repair.crossing_costs(c, z) for c, z in zip(parts, last)])
        at, audit = 0, ""
        for c, b, z in zip(parts, behind, last):
            _, part, at = repair.search(c, at, b, z)
            audit += part
        assert audit == repair.search(codes)[1]


def test_long_chunks_of_ties_end():
    for codes in ("D" * 1023, "F" * 1024, "DDG" * 341, "C" * 1024):
        assert len(repair.search(codes)[1]) >= len(codes)


@pytest.mark.parametrize("chunk", [2, 3, repair.CHUNK])
def test_conversations_against_plain_version(spark, chunk):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    want = slow_report([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert found(repair.damaged_and_repaired(table.repartition(3), chunk)) == want


def test_defined_cases(spark):
    rng = random.Random(4)
    rows = [(None, 0, "user", "Hi."), (None, None, None, None), (1, None, "", "x."), (1, 3, "user", "y" * 300_000), (1, 3, "user", "y" * 300_000),
            (2, None, "user", "a?"), (2, None, "assistant", "b!  \n"), (3, 5, "tool", " \t"), (4, 5, "", "")]
    rows += [(7, t, rng.choice(["user", "assistant", "system", "Uncle", None]), rng.choice(["ok.", "no", "", None, "yes!", f"{t}."])) for t in range(400)]
    rows += [(c, 0, "user", "gone.") for c in range(20, 60)]  # some of these are dropped whole
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, place int")
    want = slow_report(rows)
    assert any(v[6] == "" and v[7] == hashlib.sha256(b"").hexdigest() for v in want.values())
    for chunk in (16, repair.CHUNK):
        assert found(repair.damaged_and_repaired(table.withColumnRenamed("place", "copy"), chunk)) == want
    assert found(repair.damaged_and_repaired(table.limit(0))) == {}


def test_repaired_rows_are_well_formed(spark):
    rows = [(1, 0, "system", "Be nice."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi"), (2, 0, "user", "Alone?"), (3, 0, "user", " ")]
    got = {}
    for r in sorted(repair.repaired_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(),
                    key=lambda r: (r.conv_key, r.place)):
        got.setdefault(r.conv_key, []).append((r.edit, r.role, r.text))
    assert set(got) == {"=1", "=2"}
    for turns in got.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in turns))
    assert got["=2"] == [("K", "user", "Alone?"), ("I", "assistant", "")]
