import collections
import random
import zlib

from helpers import LONG, frame

from tokentally.llm.sharding import shard


def _check(df, rows, shards):
    found = shard(df, shards).collect()
    size = lambda t: len((t or "").encode()) + 8
    expected = [(d, size(t), zlib.crc32((t or "").encode())) for d, t in rows]
    assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32) for r in found))) == sorted(map(str, expected))
    slots, load, homes, members = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set), collections.Counter()
    for r in found:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        homes[r.text_crc32, r.size].add(r.shard)
        members[r.text_crc32, r.size] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load, homes, members


def test_even_shards_keep_copies_together(spark):
    rng = random.Random(1)
    rows = [(i, f"text {i} " * 20) for i in range(1500)] + [(5000 + i, f"copy {rng.randrange(120)} " * 15) for i in range(400)]
    rows += [(None, None), (1, ""), (1, None), (2, LONG), (2, LONG)]
    load, homes, members = _check(frame(spark, rows), rows, 8)
    mean = sum(load.values()) / 8
    assert len(load) == 8 and all(abs(v - mean) <= len(LONG) + 8 for v in load.values())
    split = sum(len(homes[k]) > 1 for k in members)
    assert split <= 8


def test_a_group_above_a_shard(spark):
    rows = [(i, "hot text " * 20) for i in range(600)] + [(1000 + i, f"text {i} " * 25) for i in range(1000)]
    load, homes, _ = _check(frame(spark, rows), rows, 8)
    assert max(load.values()) - min(load.values()) <= 2 * 260
    assert max(map(len, homes.values())) <= 5


def test_small_tables(spark):
    assert shard(frame(spark, [])).collect() == []
    assert [(r.shard in range(24), r.slot) for r in shard(frame(spark, [(5, "x")])).collect()] == [(True, 0)]
