import itertools
import random
import re

import numpy as np

from tokentally.llm import chat


def _model(rng):
    return chat.Markov(rng.integers(0, 9, 6), rng.integers(0, 9, (6, 6)), [rng.integers(0, 9, (6, n)) for n in chat.SHOWN])


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(20):
        model, seen = _model(rng), np.stack([rng.integers(0, n, 4) for n in chat.SHOWN], axis=1)
        emission = model.emission(seen)
        value = lambda p: model.first[p[0]] + sum(model.steps[a, b] for a, b in zip(p, p[1:])) + sum(emission[i, s] for i, s in enumerate(p))
        best = max(value(p) for p in itertools.product(range(6), repeat=4))
        path = model.decode(seen, None, None)
        assert abs(value(path) - best) < 1e-9
        # The same score through the table of a chunk.
        start = model.first + emission[0]
        assert abs((start[:, None] + model.summary(seen[1:])).max() - best) < 1e-9


def test_markers():
    assert [chat.marker(x)[0] for x in ("User: hi", "**Assistant:** x", "### Response: y", "<|system|> z", "[user] a", "Bob: hi", "plain text", "a b", "A: yes", "")] == [2, 3, 3, 1, 2, 4, 0, 0, 3, 0]


def _conversations(spark):
    rng = random.Random(6)
    rows = []
    for c in range(60):
        roles = ["system"] * (c % 3 == 0) + ["user", "assistant"] * rng.choice([1, 2, 6])
        for t, role in enumerate(roles):
            text = "\n".join(" ".join(rng.choice(["some", "words", "of", "talk"]) for _ in range(rng.randint(6, 12))) + ("?" if role == "user" else ".") for _ in range(rng.randint(1, 3)))
            rows.append((c, t, role, text))
    return rows


def _told(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.conv_id, r.turn)):
        found.setdefault(r.conv_id, []).append((r.role, r.text))
    return found


def test_turns_come_back(spark):
    rows = _conversations(spark)
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS chunk", "'x' AS line")
    lines = chat.transcript_lines(conversations)
    model = chat.fit(lines.where("conv_id % 2 = 0"), chat.SPAN)
    found = _told(chat.turns(lines, model, chat.SPAN))
    expected = {}
    for c, _, role, text in rows:
        expected.setdefault(c, []).append((role, text))
    held_out = [c for c in expected if c % 2]
    assert sum(found[c] == expected[c] for c in held_out) >= 0.9 * len(held_out)
    # Chunks of three lines give the same states as whole transcripts.
    assert _told(chat.turns(lines, model, 3)) == found


def test_awkward_lines(spark):
    model = chat.fit(chat.transcript_lines(spark.createDataFrame(_conversations(spark), "conv_id long, turn long, role string, text string")), chat.SPAN)
    rows = [(1, 0, "User: a question?"), (1, 1, None), (1, 2, "Assistant: " + "long " * 5000), (1, 2, "Assistant: " + "long " * 5000), (None, 0, "x"), (2, None, "y"), (3, 0, ""), (4, 0, "no marker")]
    lines = spark.createDataFrame(rows, "conv_id long, line_no long, line string").selectExpr("*", "1 AS state", "2 AS chunk", "3 AS before", "'t' AS turn", "'r' AS role")
    found = {c: t for c, t in _told(chat.turns(lines, model)).items()}
    assert found[1][0] == ("user", "a question?") and found[1][1][0] == "assistant" and set(found) == {1, 3, 4}
    assert [t for _, t in found[3]] == [""] and found[4][0][1] == "no marker"
    assert chat.turns(lines.where("false"), model).collect() == []


def written(rows):
    """Transcripts as lists of lines, turn by turn, in plain Python; markers of styles are taken from the module."""
    out = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or 0, (r[2] or "").strip(), r[3] or "")):
        out.setdefault(conv, []).append((turn or 0, (role or "").strip(), (text or "").split("\n")))
    return out


def test_every_turn_is_written_line_by_line(spark):
    rows = [(1, 0, "user", "first line\nsecond line"), (1, 0, "assistant", "reply one\nreply two"), (1, 1, "tool", "42\n43"), (1, 2, None, "no role"), (1, 2, None, "no role"), (None, 0, "user", "y"), (2, None, "user", None)]
    rows += [(3, t, random.Random(t).choice(["user", "assistant", "function", "system"]), f"text {t}\nmore") for t in range(300)] + [(4, 5, "user", "x\n" * 3000), (4, 6, "assistant", "end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS block", "2 AS n", "3 AS line_no", "'b' AS body")
    found = {}
    for r in sorted(chat.transcript_lines(df).collect(), key=lambda r: (r.conv_id, r.line_no)):
        found.setdefault(r.conv_id, []).append(r)
    expected = written(rows)
    assert set(found) == set(expected)
    for conv, lines in found.items():
        assert [r.line_no for r in lines] == list(range(len(lines)))
        at = 0
        for turn, role, body in expected[conv]:
            if lines[at].line == "" and body != [""]:
                at += 1  # a blank line in front of a turn without a marker
            assert lines[at].line.endswith(body[0]) and [r.line for r in lines[at + 1 : at + len(body)]] == body[1:]
            assert (lines[at].state is None) == (role not in chat.ROLES)
            if role and role not in chat.ROLES:
                assert lines[at].line == f"{role.capitalize()}: {body[0]}"
            at += len(body)
        assert at == len(lines)
    # All of their words come back as the text of some turn.
    model = chat.fit(chat.transcript_lines(df), chat.SPAN)
    told = {c: " ".join(t for _, t in turns) for c, turns in _told(chat.turns(chat.transcript_lines(df), model)).items()}
    assert "42\n43" in told[1] and told[1].count("no role") == 2 and "second line" in told[1] and told[3].count("text ") == 300


def test_turns_equal_plain_python(spark):
    """Turns put together from the states, against a plain walk over the lines."""
    rng = random.Random(9)
    rows = [(c, i, rng.choice(["User: hi", "AI: yes", "", "plain", "System: be kind?", "Bob: x", "  "])) for c in range(20) for i in range(rng.randint(1, 30))]
    lines = spark.createDataFrame(rows, "conv_id long, line_no long, line string")
    rng2 = np.random.default_rng(5)
    model = _model(rng2)
    states = {(r.conv_id, r.line_no): r.state for r in chat.states(lines, model, 4).collect()}
    expected = {}
    for conv, number, line in rows:
        turns = expected.setdefault(conv, [])
        state = states[conv, number]
        if state % 2 == 0:
            turns.append([chat.ROLES[state // 2], [line[chat.marker(line)[1] :]]])
        else:
            turns[-1][1].append(line)
    clean = {c: [(r, re.sub(r"\A(?:[ \t\r]*\n)+|\s+\Z", "", "\n".join(t))) for r, t in turns] for c, turns in expected.items()}
    assert _told(chat.turns(lines, model, 4)) == clean
    seen = {c: chat.shown([l for d, _, l in rows if d == c], None) for c in expected}
    for c, s in seen.items():
        assert [states[c, i] for i in range(len(s))] == model.decode(s, None, None).tolist()
