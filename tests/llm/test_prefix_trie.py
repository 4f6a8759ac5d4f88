import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tokentally.llm import prefix_trie as pt
from tokentally.llm import queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    """All prefixes as tuples, with sums over every pair of a prefix and one it starts."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - c % 100, [])[:h] + v[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved = defaultdict(int), defaultdict(int)
    for prefix, convs in members.items():
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += prefix not in children
            saved[prefix[:d]] += (len(convs) - 1) * len(prefix[-1][1]) if prefix else 0
    return {
        (convs[0], len(p), members[p[:-1]][0] if p else None, len(convs), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in convs if len(whole[c]) == len(p)).encode()).hexdigest())
        for p, convs in members.items()
    }


def table_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("conv_id", "turn", "role", "text", "1 AS conv", "'a' AS `depth`", "2 AS chunk", "'z' AS part", "0 AS i", "9 AS h1")


def check(spark, monkeypatch, rows):
    monkeypatch.setattr(queries, "table", lambda *_: table_of(spark, rows))
    found = queries.op12_prefix_trie(spark, "").select(*COLUMNS).collect()
    expected = plain_trie(rows)
    assert len(found) == len(expected)
    assert {tuple(r) for r in found} == expected


def conversation(rng, conv, letters, most):
    return [(conv, t, rng.choice(["user", "assistant"]), rng.choice(letters)) for t in range(rng.randint(1, most))]


AWKWARD = [
    (200, None, None, None), (200, 0, "user", ""), (200, 0, "user", ""), (200, 0, "user", "b"), (200, 3, None, "é😀"), (201, 1, "user", None), (None, 1, "user", "x"),
    (305, 7, "user", "only"), (-150, 1, "user", "a"), (-150, 2, "", "long " * 4000), (-100, 1, "user", "a"), (400, 0, "user", "b"), (400, 0, "user", "a"), (1 << 61, 0, "user", "a"),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain_python(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = [r for c in rng.sample(range(700), 120) for r in conversation(rng, c, ["a", "b", "ccc"] if seed == 1 else ["a"], 9)]
    rows += AWKWARD
    rng.shuffle(rows)
    check(spark, monkeypatch, rows)


def test_long_conversations_and_hot_nodes_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 4)
    monkeypatch.setattr(pt, "HOT", 10)
    monkeypatch.setattr(pt, "PIECE", 3)
    rng = random.Random(3)
    rows = [(0, t, "user", "ab"[t % 2]) for t in range(60)]
    for c in range(1, 40):
        rows += [(c, t, "user", "ab"[t % 2]) for t in range(rng.randint(1, 60))] + [(c, 99, "user", rng.choice("xyz"))]
    rows += [(c, t, "user", f"own {t}") for c in range(100, 140) for t in range(6, 9)]
    rows += [(c, 0, "user", f"first {c}") for c in range(300, 340)]
    check(spark, monkeypatch, rows)


def test_no_conversations(spark):
    assert pt.prefix_trie(*pt.grafted(pt.ordered_turns(table_of(spark, [])))).collect() == []
    assert pt.prefix_trie(*pt.grafted(pt.ordered_turns(table_of(spark, [(None, 1, "user", "x")])))).collect() == []
