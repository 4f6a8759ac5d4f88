import random

import pyarrow as pa
from helpers import BYTE_BPE, frame, library
from hypothesis import given, settings
from hypothesis import strategies as st

from tokentally.llm import token_counts as tc
from tokentally.llm.common import blocks

AWKWARD = ["", None, "a", "<|endoftext|>", "x<|endoftext|>  y <|endoftext|>", "it's we'll 've 's 'sab ''s '", "a  b\n\n c \t d   ", "don't 'T '\n's", "é́ ½ ① 三 abc三 ١٢ x y 　z ", "a" * 5000, "ab" * 3000 + " " * 700 + "x", "!?" * 2000, "\n" * 1300, "x 's", "12 345's"]
LIBRARY = library(BYTE_BPE)
COUNTER = tc.Counter(BYTE_BPE, tc.class_runs(BYTE_BPE))


def counted(texts, counter=COUNTER, limit=1 << 20):
    return [n for *_, data, offsets in blocks(pa.array(texts, pa.string()), limit) for n in counter(data, offsets).tolist()]


def expected(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_awkward_texts():
    assert counted(AWKWARD) == expected(AWKWARD)
    assert counted(AWKWARD, limit=50) == expected(AWKWARD)


def test_states_are_made_anew_when_too_many():
    small = tc.Counter(BYTE_BPE, tc.class_runs(BYTE_BPE), states=50)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeth in's lr'dmve\n  \t.,!éß中1 2") for _ in range(80)) for _ in range(300)]
    assert counted(texts, small, 500) == expected(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aeins '\n\t.1ltdrvm", max_size=60)), max_size=8))
def test_any_text(texts):
    assert counted(texts) == expected(texts)


def test_rows(spark):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(1, "twice"), (1, "twice"), (None, "no id")]
    found = tc.token_counts(frame(spark, rows), BYTE_BPE, limit=3).collect()
    assert sorted(map(str, [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found])) == sorted(
        map(str, [(d, len((t or "").encode()), n, n > 3) for (d, t), n in zip(rows, expected([t for _, t in rows]))])
    )
    assert tc.token_counts(frame(spark, []), BYTE_BPE).collect() == []
