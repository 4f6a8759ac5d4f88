"""Plain Python versions of the operators, and awkward tables."""

from __future__ import annotations

import collections
import re

import public_tokenizers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = "long " * 3000 + "tail"


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def frame(spark, rows, extra=True):
    """doc_id and text, with columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if not extra:
        return df
    return df.selectExpr("doc_id", "text", "'x' AS length", "1 AS `start`", "'y' AS `id`", "2.0 AS `key`", "'z' AS `spot`", "'p' AS `print`", "7 AS `shard`", "'a b' AS `size of`", "null AS score")


def words(text, fold=False):
    found = WORD.findall(text or "")
    return [w.encode().lower() for w in found] if fold else found


def removed_words(rows, size):
    """(doc_id, n_words, n_removed, kept) of rows (doc_id, text)."""
    first = {}
    split = [(d, words(t)) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - size + 1 if d is not None else 0):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1 if d is not None else 0):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingles(text, size=5):
    w = words(text)
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([("short", *w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def classes(rows, similarity=0.8):
    """Set of (doc_id, class_id) of rows (doc_id, text)."""
    by_set = collections.defaultdict(list)
    for d, t in rows:
        if shingles(t):
            by_set[shingles(t)].append(d)
    sets = list(by_set)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if n / (len(s) + len(sets[j]) - n) >= similarity:
                parent[root(i)] = root(j)
        for x in s:
            holders[x].append(i)
    members = collections.defaultdict(list)
    for i, s in enumerate(sets):
        members[root(i)] += by_set[s]
    least = {s: min(members[root(i)]) for i, s in enumerate(sets)}
    return {(d, least.get(shingles(t), d)) for d, t in rows}


def contained(docs, items, similarity=0.8):
    """Set of (doc_id, item_id, start_word, n_words, similarity) of the best windows."""
    found = set()
    for d, t in docs:
        w = words(t, fold=True)
        for i, item in items:
            x = words(item, fold=True)
            k, n = min(5, len(x)), len(x)
            if not x:
                continue
            own = collections.Counter(tuple(x[j : j + k]) for j in range(n - k + 1))
            best = None
            for s in range(len(w) - n + 1):
                other = collections.Counter(tuple(w[s + j : s + j + k]) for j in range(n - k + 1))
                shared = sum((own & other).values())
                value = shared / (2 * (n - k + 1) - shared)
                if value >= similarity and (best is None or value > best[1]):
                    best = (s, value)
            if best:
                found.add((d, i, best[0], n, round(best[1], 9)))
    return found


def near_copies(random, words_of, bases, rows, length):
    """Rows (doc_id, text) that repeat a few texts with small changes."""
    base = [" ".join(random.choice(words_of) for _ in range(length)) for _ in range(bases)]
    out = []
    for i in range(rows):
        w = random.choice(base).split()
        for _ in range(random.randint(0, 3)):
            w[random.randrange(len(w))] = f"x{random.randrange(50)}"
        out.append((i, " ".join(w)))
    return out
