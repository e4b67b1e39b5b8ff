import hashlib
import random
import zlib

from kgspark.llm import sharding

from .conftest import EDGES


def smallest(sizes, shards):
    """The minimax capacity by plain search over all sums of neighbours."""
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, n = (low + high) // 2, 0, 1
        for s in sizes:
            if used + s > mid:
                used, n = 0, n + 1
            used += s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


def check(rows, got, shards):
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i is not None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    groups = {}
    for _, t in rows:
        key = hashlib.sha256((t or "").encode()).digest()
        groups[key] = groups.get(key, 0) + len((t or "").encode()) + 8
    load = {}
    for r in got:
        load.setdefault(r.shard, []).append((r.slot, r.size))
    assert set(load) <= set(range(shards))
    assert max(sum(s for _, s in x) for x in load.values()) == smallest([groups[k] for k in sorted(groups)], shards)
    for x in load.values():
        assert sorted(s for s, _ in x) == list(range(len(x)))
    crc = {}
    for r in got:
        assert crc.setdefault((r.text_crc32, r.size), r.shard) == r.shard


def test_edges(edges):
    check(EDGES, sharding.shard(edges, 5).collect(), 5)


def test_random_with_a_hot_group(docs, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 8)  # many finer looks
    monkeypatch.setattr(sharding, "FINER", 4)
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else "x" * rng.randrange(200) + str(rng.randrange(300))) for i in range(700)]
    check(rows, sharding.shard(docs(rows), 24).collect(), 24)


def test_fewer_rows_than_shards_and_empty(docs):
    rows = [(1, "a"), (2, "b")]
    check(rows, sharding.shard(docs(rows), 24).collect(), 24)
    assert sharding.shard(docs([]), 24).count() == 0
