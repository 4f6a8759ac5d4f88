import collections
import random

import numpy as np

from helpers import LONG, contained, frame, words

from tokentally.llm import decontaminate
from tokentally.llm.decontaminate import mark_contaminated


def _case():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 5, 8, 15, 30, 57])))) for i in range(30)]
    items += [(90, ""), (91, None), (92, "a a a a a a a a a a"), (93, "only"), (94, items[3][1])]
    docs = []
    for i in range(200):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            x = (rng.choice(items)[1] or "").split()
            if x and rng.random() < 0.6:
                x[rng.randrange(len(x))] = "Q"
            if x and rng.random() < 0.3:
                del x[rng.randrange(len(x))]
            p = rng.randint(0, len(w))
            w[p:p] = [y.upper() if rng.random() < 0.3 else y for y in x]
        docs.append((i, "  ".join(w)))
    docs += [(500, None), (501, ""), (502, "a " * 30), (503, LONG + " Only one"), (7, docs[7][1])]
    return docs, items


def _told(marked):
    return {(r.doc_id, h.item_id, h.start_word, h.n_words, round(h.similarity, 9)) for r in marked.collect() for h in r.benchmark_hits}


def test_best_windows(spark, monkeypatch):
    docs, items = _case()
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    marked = mark_contaminated(frame(spark, docs).selectExpr("*", "'old' AS benchmark_hits"), benchmark)
    assert marked.count() == len(docs) and marked.columns[:3] == ["doc_id", "text", "length"]
    expected = contained(docs, items)
    assert len(expected) > 50 and _told(marked) == expected
    # Items in several passes.
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 2000)
    assert _told(mark_contaminated(frame(spark, docs), benchmark)) == expected


def _short_texts_in(docs, items, similarity=0.8):
    """What ``contained`` tells, and texts of fewer words than an item as one window."""
    found = contained(docs, items, similarity)
    for d, t in docs:
        w = words(t, fold=True)
        for i, item in items:
            x = words(item, fold=True)
            k = min(5, len(x))
            if k <= len(w) < len(x):
                mine, own = (collections.Counter(tuple(y[j : j + k]) for j in range(len(y) - k + 1)) for y in (w, x))
                value = sum((mine & own).values()) / sum((mine | own).values())
                if value >= similarity:
                    found.add((d, i, 0, len(w), round(value, 9)))
    return found


def test_texts_shorter_than_an_item(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([3, 5, 6, 7, 16, 16, 30, 40, 59, 59])]
    items += [(20, "a a a a a a a a a a"), (21, items[9][1].upper()), (22, items[8][1] + " more words")]
    docs = []
    for i, (_, item) in enumerate(items):
        w = item.split()
        cuts = [w[:-1], w[1:], w[:-4], w[2:-2], w[: len(w) * 8 // 10], w[: len(w) // 2], w[:-2][:5] + ["Q"] + w[:-2][6:], w]
        docs += [(100 * i + j, " ".join(c)) for j, c in enumerate(cuts)]
    docs += [(5000, items[9][1] + " and a text that is longer"), (5001, " ".join(items[9][1].split()[:55])), (5002, "w1"), (5003, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = _short_texts_in(docs, items)
    assert (5001, 9, 0, 55, round(51 / 55, 9)) in expected and len(expected - contained(docs, items)) > 20
    assert _told(mark_contaminated(frame(spark, docs), benchmark)) == expected
    monkeypatch.setattr(decontaminate, "SPAN", 100)
    assert _told(mark_contaminated(frame(spark, docs), benchmark)) == expected


def test_empty_tables(spark):
    docs, items = _case()
    none = spark.createDataFrame([], "item_id long, text string")
    assert _told(mark_contaminated(frame(spark, docs), none)) == set()
    assert mark_contaminated(frame(spark, []), none).collect() == []


def test_radius_holds_similar_windows():
    import numpy as np

    rng = np.random.default_rng(1)
    far = 0
    for _ in range(400):
        a = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
        b = a.copy()
        b[:4] = rng.integers(0, 1 << 62, 4, dtype=np.uint64)  # 36 / 44 > 0.8
        prints = [decontaminate.simhash(decontaminate._bits(x).sum(axis=0, keepdims=True, dtype=np.int64), np.array([40])) for x in (a, b)]
        d = int(decontaminate.distance(prints[0], prints[1])[0])
        far += d > decontaminate.RADIUS
        sized = decontaminate.Sized(44, np.array([0]), prints[0])
        assert len(sized.within_radius(prints[1])[0]) == (d <= decontaminate.RADIUS)
    assert far == 0


def test_lookup_finds_all_pairs_within_the_radius(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(decontaminate, "CANDIDATES", 700)
    items = rng.integers(0, 256, (300, 8), dtype=np.uint8)
    near = items[rng.integers(0, 300, 200)] ^ np.packbits(rng.random((200, 64)) < rng.random((200, 1)) * 0.5, axis=1)
    prints = np.concatenate([near, rng.integers(0, 256, (50, 8), dtype=np.uint8), items[:3]])
    w, m = decontaminate.Sized(9, np.arange(300), items).within_radius(prints)
    expected = np.argwhere(decontaminate.distance(prints[:, None], items[None]) <= decontaminate.RADIUS)
    assert sorted(zip(w.tolist(), m.tolist())) == [tuple(p) for p in expected.tolist()]
    assert decontaminate.Sized(9, np.arange(300), items).within_radius(prints[:0])[0].tolist() == []


def test_many_short_items():
    """30,000 items of eight words against a thousand windows, in bounded memory and time."""
    rng = np.random.default_rng(5)
    items = rng.integers(0, 256, (30_000, 8), dtype=np.uint8)
    w, m = decontaminate.Sized(8, np.arange(30_000), items).within_radius(items[:1000] ^ np.packbits(rng.random((1000, 64)) < 0.05, axis=1))
    assert {(i, i) for i in range(1000)} <= set(zip(w.tolist(), m.tolist()))
