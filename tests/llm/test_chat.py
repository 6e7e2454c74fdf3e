"""Transcripts: chunked Viterbi against the plain one and against all paths;
recovered roles against the known ones."""
import itertools
import random

import numpy as np
import pytest

from poolwise.llm import chat


def some_hmm(seed=0):
    rng = np.random.default_rng(seed)
    counts = {("move", a, b): rng.integers(0, 30) for a in range(chat.S) for b in range(chat.S)}
    counts |= {("start", a, 0): rng.integers(0, 9) for a in range(chat.S)}
    counts |= {(str(k), s, v): rng.integers(0, 40) for k, n in enumerate(chat.SIZES) for s in range(chat.S) for v in range(n)}
    return chat.Hmm.from_counts(counts)


def score(hmm, obs, path):
    seen = hmm.seen(obs)
    return hmm.start[path[0]] + seen[0][path[0]] + sum(
        hmm.move[a, b] + seen[t + 1][b] for t, (a, b) in enumerate(zip(path, path[1:])))


def test_viterbi_is_the_best_of_all_paths():
    hmm, rng = some_hmm(), np.random.default_rng(3)
    for n in (1, 2, 5):
        obs = np.stack([rng.integers(0, m, n) for m in chat.SIZES], axis=1)
        best = max(score(hmm, obs, p) for p in itertools.product(range(chat.S), repeat=n))
        assert np.isclose(score(hmm, obs, hmm.path(obs)), best)


@pytest.mark.parametrize("fan", [2, 3, 256])
def test_chunked_viterbi_is_exact(spark, monkeypatch, fan):
    monkeypatch.setattr(chat, "CHUNK", 4)
    rnd = random.Random(fan)
    marks = ["User: hi?", "AI: yes", "", "plain text", "### System", "Bob: hello there", "[assistant] ok", "<|user|>", None]
    rows = [(c, 0, k, rnd.choice(marks), "user") for c, n in ((1, 1), (2, 4), (3, 70), (None, 9), (5, 33)) for k in range(n)]
    lines = chat.numbered(spark.createDataFrame(rows, "conv_id long, turn long, no int, line string, role string"))
    hmm = some_hmm(fan)
    got = {}
    for r in chat.decode(lines, hmm, fan).collect():
        got.setdefault(r.conv_id, {})[r.n] = (r.role, r.opens)
    for c in (1, 2, 3, None, 5):
        obs = chat.observe([r[3] for r in rows if r[0] == c])
        mine = [chat.STATES.index(got[c][k]) for k in range(len(obs))]
        assert np.isclose(score(hmm, obs, mine), score(hmm, obs, hmm.path(obs)))


def test_markers():
    m = lambda s: chat.MARKERS[chat.marker_of(s)[0]]
    assert [m(s) for s in ("User: hi", "### Assistant", "<|system|>", "[user] x", "**AI**: y", "Bob: z", "A: q")] == [
        "user", "assistant", "system", "user", "assistant", "other", "assistant"]
    assert [m(s) for s in ("", "plain words here", "user", "the user said", "[user", "<html x")] == ["none"] * 6
    line = "**Human**:  hello"
    assert line[chat.marker_of(line)[1]:] == "hello"


def conversations(n):
    rnd = random.Random(9)
    out = []
    for c in range(n):
        turn = 0
        if c % 5 == 0:
            out.append((c, turn, "system", "Be kind and brief.\nAlways."))
            turn += 1
        for k in range(rnd.randint(2, 8)):
            role = "user" if k % 2 == 0 else "assistant"
            text = ("what is " + "x " * rnd.randint(1, 6) + "?") if role == "user" else "\n".join(
                "it is " + "word " * rnd.randint(5, 30) for _ in range(rnd.randint(1, 4)))
            out.append((c, turn, role, text))
            turn += 1
    return out


def test_roles_are_recovered(spark):
    conv = conversations(300)
    df = spark.createDataFrame(conv, "conv_id long, turn long, role string, text string")
    lines = chat.numbered(chat.conversation_lines(df))
    hmm = chat.train(lines.filter(chat.training_part(lines["conv_id"])))
    held = lines.filter(~chat.training_part(lines["conv_id"]))
    truth = {(r.conv_id, r.n): r.role for r in held.collect()}
    got = {(r.conv_id, r.n): r.role for r in chat.decode(held, hmm).collect()}
    assert truth.keys() == got.keys()
    assert np.mean([truth[k] == got[k] for k in truth]) > 0.95


def test_turns_and_parts(spark):
    df = spark.createDataFrame([(1, 0, 0, "user", True, "a"), (1, 0, 1, "user", False, "b"), (1, 0, 2, "user", False, ""),
                                (1, 0, 3, "assistant", True, ""), (1, 0, 4, "assistant", False, "c"), (1, 1, 5, "assistant", False, "d"),
                                (1, 1, 6, "assistant", False, "e"), (None, 0, 0, "system", True, "s")],
                               "conv_id long, chunk long, n long, role string, opens boolean, body string")
    rows = chat.turns(df, part=2).orderBy("conv_id", "turn", "part").collect()
    whole = {}
    for r in rows:
        whole[(r.conv_id, r.turn)] = whole.get((r.conv_id, r.turn), "") + r.rendered
    assert whole == {(None, 0): "<|system|>\ns\n<|end|>\n", (1, 0): "<|user|>\na\nb\n<|end|>\n",
                     (1, 1): "<|assistant|>\nc\nd\ne\n<|end|>\n"}
    assert [(r.part, r.n_lines) for r in rows if r.turn == 1] == [(0, 2), (1, 2)]


def test_odd_rows_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string, line string"
    rows = [(1, 0, "user", "hi", "q"), (1, 0, "user", "hi", "q"), (1, None, None, None, None), (None, 1, "tool", "x", ""),
            (2, 0, "user", "word " * 50_000, "")]
    out = chat.parsed_transcripts(spark.createDataFrame(rows, schema)).collect()
    assert {r.conv_id for r in out} == {1, None, 2}
    assert chat.parsed_transcripts(spark.createDataFrame([], schema)).collect() == []
