import random

from helpers import frame, removed_words

from tokentally.llm import substring_dedup as sd


def check(spark, rows, size=13):
    found = sd.dedup_substrings(frame(spark, rows), size).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, removed_words(rows, size)))


def texts(rng, n, words, length):
    """Texts that share passages, some at the same place with other words around them."""
    passages = [" ".join(rng.choice(words) for _ in range(18)) for _ in range(40)]
    return [" ".join([" ".join(rng.choice(words) for _ in range(4)), rng.choice(passages), rng.choice(passages[:3])][: rng.randint(1, 3)] + [rng.choice(words) for _ in range(length)]) for _ in range(n)]


def test_thousands_of_texts_with_one_id(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = [(5, t) for t in texts(rng, 6000, words, 5)] + [(1, t) for t in texts(rng, 200, words, 9)] + [(9, t) for t in texts(rng, 300, words, 9)]
    rows += [(5, rows[0][1]), (5, None), (None, rows[1][1]), (None, rows[1][1])]
    check(spark, rows)


def test_one_id_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT_ROWS", 50)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    # Copies that differ in one word around the same seven words.
    base = texts(rng, 30, words, 12)
    edited = [" ".join(rng.choice(words) if rng.random() < 0.08 else w for w in t.split()) for t in base * 8]
    check(spark, [(rng.choice([2, 2, 2, 7, 8]), t) for t in base + edited])
    check(spark, [(rng.choice([2, 2, 2, 7, 8]), t) for t in base + edited], 6)
