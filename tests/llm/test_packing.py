import random
import zlib

import numpy as np
import pyarrow as pa
from helpers import LONG, WORD_BPE, frame, library
from hypothesis import given, settings
from hypothesis import strategies as st

from tokentally.llm.common import text_buffers
from tokentally.llm.packing import pack, place, placements
from tokentally.llm.tokens import WordEncoder
from tokentally.llm.token_output import packed_sequences, position_ids

AWKWARD = ["", None, "<|endoftext|>a b<|startoftext|>", "É́ é ́x ǅ İ Σς ΑΣ", "a b   c'll 's  don't ''s 12 ½.", "  ", "\x01 a \x01", "THE the The", "x.y,z!? 'tis", LONG]


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 70).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(1, w), max_size=120))))
def test_counts_pack_like_single_pieces(case):
    window, lengths = case
    counts = {n: lengths.count(n) for n in set(lengths)}
    table, windows = placements(counts, window)
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(window - n)
    assert windows == len(free)
    spans = {}
    for n, k in counts.items():
        for s, o in zip(*place(table, np.full(k, n), np.arange(k))):
            spans.setdefault(int(s), []).append((int(o), n))
    for parts in spans.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
    assert sorted(window - sum(n for _, n in p) for p in spans.values()) == sorted(free)


def test_ids_are_those_of_the_library():
    for keep in (1_000_000, 3):
        encode = WordEncoder(WORD_BPE, keep)
        for _ in range(2):
            ids, at = encode(*text_buffers(pa.array(AWKWARD)))
            expected = encode.library.encode_batch([t or "" for t in AWKWARD], add_special_tokens=False)
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [e.ids for e in expected]


def _expected(rows):
    lib = library(WORD_BPE)
    return [(d, lib.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]


def test_pack_is_whole_and_gapless(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma.", "d"]) for _ in range(rng.choice([1, 5, 40])))) for i in range(200)]
    rows += [(500 + i, t) for i, t in enumerate(AWKWARD)] + [(7, "same"), (7, "same"), (None, "no id")]
    places, pieces = pack(frame(spark, rows), WORD_BPE, window=64)
    found = places.collect()
    texts = sorted(_expected(rows), key=str)
    whole = sorted(((d, ids) for d, ids in texts), key=str)
    ids_of = {}
    for p in pieces.collect():
        ids_of.setdefault((p.doc_id, p.start, zlib.crc32(p.ids)), []).append(np.frombuffer(p.ids, "<u4").tolist())
    joined = {}
    for p in found:
        own = ids_of[p.doc_id, p.start, p.ids_crc32].pop()
        assert len(own) == p.length
        joined.setdefault(p.doc_id, []).append((p.start, own, p.doc_tokens))
    # Each id lies in one piece; repeated rows have pieces of their own.
    assert sorted(i for parts in joined.values() for _, own, _ in parts for i in own) == sorted(i for _, ids in whole for i in ids)
    for d, ids in whole:
        if d not in (7, None):
            assert [i for _, own, _ in sorted(joined[d]) for i in own] == ids
            assert {n for *_, n in joined[d]} == {len(ids)}
    windows = {}
    for p in found:
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in windows.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 64
    assert len(windows) <= 1.05 * sum(p.length for p in found) / 64 + 1


def test_pack_of_nothing(spark):
    places, _ = pack(frame(spark, []), WORD_BPE)
    assert places.collect() == []
    assert packed_sequences(frame(spark, []), WORD_BPE, 49_408).collect() == []


def test_matrices_round_trip(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma."]) for _ in range(rng.randint(0, 90)))) for i in range(300)] + [(900 + i, t) for i, t in enumerate(AWKWARD)]
    for vocabulary, kind in ((49_408, "<u2"), (100_000, "<u4")):
        found = packed_sequences(frame(spark, rows), WORD_BPE, vocabulary, window=128).collect()
        joined = {}
        for r in found:
            ids = np.frombuffer(r.ids, kind)
            assert len(ids) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 2).all()
            assert r.position_resets == r.cu_seqlens[:-1]
            assert position_ids(r.cu_seqlens).tolist() == [i for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]) for i in range(b - a)]
            for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
                joined.setdefault(d, []).append((s, ids[a:b].tolist()))
        assert len({r.sequence_id for r in found}) == len(found)
        assert {d: [i for _, p in sorted(parts) for i in p] for d, parts in joined.items()} == dict(_expected(rows))
        assert sum(r.n_tokens for r in found) > 0.95 * 128 * (len(found) - 1)
