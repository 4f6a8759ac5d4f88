import collections
import math
import random

import numpy as np
import pytest
from helpers import LONG, classes, frame, near_copies, removed_words

from tokentally.llm import embed_dedup, minhash
from tokentally.llm.substring_dedup import dedup_substrings


@pytest.mark.parametrize("size,vocabulary,count", [(13, ["the"], 30), (13, ["a", "b"], 50), (5, list("abcd"), 60), (13, [f"w{i}" for i in range(300)], 120)])
def test_removed_words(spark, size, vocabulary, count):
    rng = random.Random(size + len(vocabulary))
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(count // 3)]
    rows = []
    for i in range(count):
        w = rng.choice(base).split()
        if w and rng.random() < 0.5:
            w[rng.randrange(len(w))] = "zz"
        w += rng.choice(base).split() if rng.random() < 0.3 else []
        rows.append((rng.choice([i, i, i // 2, None]), rng.choice([" ", "\n", "  \t"]).join(w) if rng.random() < 0.95 else None))
    rows += [(7, "x"), (7, "x"), (-5, base[0]), (None, None), (3000, LONG), (3001, LONG)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        found = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in dedup_substrings(frame(spark, rows), size).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(found, key=str) == sorted(removed_words(rows, size), key=str)


def test_removal_from_nothing_and_carried_columns(spark):
    assert dedup_substrings(frame(spark, [])).collect() == []
    rows = dedup_substrings(frame(spark, [(1, "a b"), (2, None)]), carry=["length", "size of"]).collect()
    assert sorted((r.doc_id, r.text, r.rest["length"], r.rest["size of"]) for r in rows) == [(1, "a b", "x", "a b"), (2, None, "x", "a b")]
    with pytest.raises(ValueError):
        dedup_substrings(frame(spark, []), size=40)


def test_classes_of_near_copies(spark, monkeypatch):
    rng = random.Random(2)
    rows = near_copies(rng, [f"w{i}" for i in range(200)], 6, 250, 120)
    rows += [(1000, ""), (1001, None), (1002, "a b"), (1003, "a  b"), (1004, " \n"), (5, rows[5][1]), (1005, LONG), (1006, LONG + " end"), (1007, rows[3][1])]
    expected = classes(rows)
    found = minhash.near_duplicates(frame(spark, rows + [(None, rows[0][1])]))
    told = {(r.doc_id, r.class_id, r.kept) for r in found.collect()}
    assert {(d, c) for d, c, _ in told if d is not None} == expected
    assert (None, None, True) in told
    assert {d for d, _, kept in told if kept} >= {c for _, c in expected}
    # Groups that are dealt to several tasks.
    monkeypatch.setattr(minhash, "TASK_SHINGLES", 3000)
    assert {(r.doc_id, r.class_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()} == expected
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def test_no_task_holds_a_group_that_stays_open(spark, monkeypatch):
    """Texts from one template at a similarity of about 0.7, and a few pairs and chains of near copies among them."""
    rng = random.Random(6)
    template = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(template)
        at = rng.randrange(137)
        w[at : at + 13] = [f"x{i}_{j}" for j in range(13)]
        rows.append((i, " ".join(w)))
        if i % 10 == 0:
            for j in range(rng.randint(1, 4)):
                w = list(w)
                w[rng.randrange(len(w))] = f"y{i}_{j}"
                rows.append((1000 + 10 * i + j, " ".join(w)))
    expected = classes(rows)
    assert len({c for _, c in expected}) > 80
    task = 6000
    monkeypatch.setattr(minhash, "TASK_SHINGLES", task)
    seen, placed = [], minhash._placed

    def watched(*args):
        out = placed(*args)
        sizes = out.selectExpr("centre", "chunk", "length(shingles) / 4 AS n").groupBy("centre", "chunk").sum("n")
        seen.append(tuple(sizes.selectExpr("count(*)", "max(`sum(n)`)").first()))
        return out

    monkeypatch.setattr(minhash, "_placed", watched)
    assert {(r.doc_id, r.class_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()} == expected
    assert len(seen) == 2 and seen[1][0] > 3
    assert max(n for _, n in seen) < 1.7 * task, seen


def test_one_document_of_each_class_stays(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (2, text), (2, text), (3, "other words that stay here"), (3, "other words that stay here"), (None, text), (4, None), (5, "")]
    left = minhash.without_near_duplicates(frame(spark, rows))
    assert sorted(map(str, [(r.doc_id, r.text) for r in left.collect()])) == sorted(map(str, [(1, text), (3, "other words that stay here"), (None, text), (4, None), (5, "")]))


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 62, 80, dtype=np.uint64), rng.integers(0, 1 << 62, 20, dtype=np.uint64)
    elements = np.concatenate([a, a[:60], b])
    weights = np.concatenate([rng.uniform(0.2, 3, 80), rng.uniform(0.2, 3, 60), rng.uniform(0.2, 3, 20)])
    signatures = minhash.dart_signatures(elements, np.array([0, 80, 160, 160]), 2000, weights)
    shared = np.minimum(weights[:60], weights[80:140]).sum()
    expected = shared / (weights.sum() - shared)
    assert abs((signatures[0] == signatures[1]).mean() - expected) < 5 * math.sqrt(expected / 2000)
    assert (signatures[2] == np.uint64((1 << 64) - 1)).all()


def _links(rows):
    n = len(rows)
    degree, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = collections.defaultdict(list)
    for i, (_, e, label) in enumerate(rows):
        if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            by[label, len(e)].append(i)
    for group in by.values():
        x = np.array([rows[i][1] for i in group], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= 0.93)):
            if a != b:
                degree[group[a]] += 1
                parent[root(group[a])] = root(group[b])
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), 1 << 60), rows[i][0])
    return sorted((rows[i][0], degree[i], least[root(i)], rows[i][0] == least[root(i)]) for i in range(n))


def test_links_of_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(5, 20))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 5] + rng.normal(size=20) * [0, 0.05, 0.3][i // 5 % 3]], i % 3) for i in range(200)]
    rows += [(900, None, 1), (901, [0.0] * 20, 1), (902, [math.nan] * 20, 1), (903, rows[0][1], None), (904, rows[0][1], 0), (904, rows[0][1], 0)]
    rows += [(905, [], 0), (906, [1.0, None], 0), (907, [1.0], 0), (908, [2.0], 0), (909, [-1.0], 0), (910, [math.inf] * 20, 0)]
    make = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS uid", "1 AS weight", "2 AS key")
    told = lambda df: sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(df).collect())
    assert told(make(rows)) == _links(rows)
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", 16)
    assert told(make(rows)) == _links(rows)
    assert told(make([])) == []


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    u = rng.normal(size=(3000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.93 * u + math.sqrt(1 - 0.93**2) * w
    a, b = embed_dedup.buckets(u), embed_dedup.buckets(v)
    met = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1)
    assert met.mean() > 0.99
