import random
import re

import numpy as np
import pyarrow as pa
from helpers import LONG, frame
from pyspark.sql import functions as F

from tokentally.llm.common import _BYTE, _PLACE, U64, mix, span_hashes, text_buffers
from tokentally.llm.quality import AGAIN, Model, counts, features, fit, sample, score

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = fit(documents, labels.where(~held_out))
    rows = score(documents, model).join(labels.where(held_out), "doc_id").select("score", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert len(good) > 50 and len(bad) > 5
    assert np.mean([s >= 0.5 for s in good]) > 0.98 and np.mean([s < 0.5 for s in bad]) > 0.9
    again = fit(documents, labels.where(~held_out))
    assert np.array_equal(model.vectors, again.vectors)


def test_features_stay_inside_words_and_rows():
    texts = ["abcd abcd", "", "xyz", None, "a  a A", "é" * 3]
    feature, row = features(*text_buffers(pa.array(texts)))
    n = np.bincount(row, minlength=len(texts)).tolist()
    # Two forms of each word, words that repeat the one before, 3-grams and 4-grams of characters.
    assert n == [2 * 2 + 1 + 2 * 2 + 2 * 1, 0, 2 + 1, 0, 2 * 3 + 2, 2 + 1]
    alone = features(*text_buffers(pa.array(["xyz"])))[0]
    assert sorted(alone) == sorted(feature[row == 2])
    r, f, c = counts(feature, row, 1 << 16)
    assert c.sum() == len(feature) and (np.diff(r) >= 0).all()


def test_awkward_rows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["good", "fine", "clear"]) if i % 2 else rng.choice(["BAD!!", "JUNK!!"]) for _ in range(20))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, LONG), (None, "good fine"), (3, rows[3][1]), (3, rows[3][1])]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(5, 0), (6, None), (None, 1), (7, 9), (99, 1)], "doc_id long, quality int")
    model = fit(frame(spark, rows), labels)
    found = score(frame(spark, rows), model)
    assert found.count() == len(rows) and found.columns.count("score") == 1
    told = {r.doc_id: r.score for r in found.collect()}
    assert all((told[i] >= 0.5) == (i % 2 == 1) for i in range(60)) and 0 <= told[100] == told[101] <= 1
    empty = fit(frame(spark, rows), labels.where("false"))
    assert {r.score for r in score(frame(spark, rows), empty).collect()} == {0.5}
    assert score(frame(spark, []), model).collect() == []


def test_sample_takes_six_thousand_texts(spark):
    docs = spark.range(6500).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    assert sample(docs, labels).count() == 6000


def test_sample_is_bounded_in_rows_and_bytes(spark):
    rows = [(1, f"text {i}") for i in range(3000)] + [(2, "x " * 40_000), (2, "short"), (3, None), (3, "")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    found = sample(frame(spark, rows), labels).collect()
    assert sorted((r.doc_id, r.label) for r in found) == [(1, 1), (2, 0), (3, 0)]
    assert {r.text for r in found if r.doc_id == 2} == {"short"}


def plain_features(text, buckets=1 << 16):
    """Features of one text, word by word and character by character, through hashes of single spans."""
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text)]

    def of(parts, fold=False):
        data = np.frombuffer("\n".join(parts).encode(), np.uint8)
        ends = np.cumsum([len(p.encode()) + 1 for p in parts]) - 1
        starts = ends - np.array([len(p.encode()) for p in parts])
        return span_hashes(data, starts, ends, fold)

    found = []
    if words:
        low = [int(h) for h in of(words, True)]
        found += low + [int(h) ^ 0x5BD1E995 for h in of(words)] + [int(AGAIN) for a, b in zip(low, low[1:]) if a == b]
    one = lambda c: int(mix(np.array([sum(int(_BYTE[b]) * int(_PLACE[j]) for j, b in enumerate(c.encode())) % 2**64], U64))[0])
    for n in (3, 4):
        for w in words:
            for i in range(len(w) - n + 1):
                total = (sum(one(c) * int(_PLACE[j]) for j, c in enumerate(w[i : i + n])) + n) % 2**64
                found.append(int(mix(np.array([total], U64))[0]))
    return sorted((h * 0x9E3779B97F4A7C15 % 2**64) >> 48 for h in found)


def test_features_and_scores_equal_plain_python(spark):
    texts = ["Ab ab", "", "naïve élève naïve", "日本語です x", "a\tbcd\n efgh", " 😀😀😀 "]
    for text in texts:
        feature, row = features(*text_buffers(pa.array([text])))
        assert sorted(feature.tolist()) == plain_features(text)
    rng = np.random.default_rng(4)
    model = Model(rng.normal(size=(1 << 16, 4)).astype(np.float32), rng.normal(size=(2, 4)).astype(np.float32), np.array([0.1, -0.2], np.float32))
    for r in score(frame(spark, list(enumerate(texts))), model).collect():
        vectors = [model.vectors[f] for f in plain_features(r.text)]
        logits = model.weights @ (np.mean(vectors, 0) if vectors else np.zeros(4)) + model.biases
        assert abs(r.score - np.exp(logits[1]) / np.exp(logits).sum()) < 1e-5
