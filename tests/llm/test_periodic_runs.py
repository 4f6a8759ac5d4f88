import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from helpers import LONG, frame, words
from hypothesis import given, settings
from hypothesis import strategies as st

from tokentally.llm import periodic_runs as pr
from tokentally.llm.common import U64, mix


def plain_runs(w, exponent=4, least=6):
    """Runs by comparing each word with the one a period later, for each period."""
    found = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def rebuilt(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(doc_id, text):
    w = rebuilt(doc_id, words(text))
    runs = plain_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (
        doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)),
        sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def runs(texts, **limits):
    hashed = mix(np.array([x for t in texts for x in t], U64) + U64(7))
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    row, *columns = pr.runs_of(hashed, first, **limits)
    out = [[] for _ in texts]
    for r, *values in zip(row.tolist(), *[c.tolist() for c in columns]):
        out[r].append(tuple(values))
    return out


def periodic(rng, letters):
    """A text of repeated pieces, nested and cut off at random."""
    out = []
    while len(out) < rng.randint(5, 150):
        piece = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.4:
            piece = piece * rng.randint(2, 5) + [rng.randrange(letters)]
        made = piece * rng.randint(1, 7)
        out += made[: rng.randint(1, len(made))]
    return out


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_of_periodic_texts(letters):
    rng = random.Random(letters)
    texts = [periodic(rng, letters) for _ in range(400)]
    assert runs(texts) == [plain_runs(t) for t in texts]
    assert runs(texts, exponent=5, least=1) == [plain_runs(t, 5, 1) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5))
def test_runs_of_any_texts(texts):
    assert runs(texts) == [plain_runs(t) for t in texts]


def test_all_short_texts_of_two_words():
    texts = [[int(b) for b in f"{n:012b}"] for n in range(4096)]
    assert runs(texts) == [plain_runs(t) for t in texts]


def test_long_text():
    text = [0] * 3000 + list(range(1, 700)) * 5 + [0] * 3000
    assert runs([text]) == [[(0, 3000, 1), (3000, 3495, 699), (6495, 3000, 1)]]


def test_rows_equal_plain_python(spark, monkeypatch):
    from tokentally.llm import queries

    rng = random.Random(5)
    rows = [(i, " ".join("ab cd ef".split()[x % 3] + "é" * (x // 3) for x in periodic(rng, 7))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, LONG), (203, LONG), (203, "a b " * 6), (None, "x " * 9), (None, None), (-5, "q " * 40), (204, "a b " * 8)]
    monkeypatch.setattr(queries, "table", lambda *_: frame(spark, rows))
    found = [tuple(r) for r in queries.op11_periodic_runs(spark, "").collect()]
    assert sorted(map(str, found)) == sorted(map(str, [plain_row(d, t) for d, t in rows]))


def test_empty_table(spark):
    assert pr.find_runs(pr.with_periods(frame(spark, []))).collect() == []
