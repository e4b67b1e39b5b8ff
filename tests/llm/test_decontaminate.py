import random

import numpy as np

from kgspark.llm import decontaminate as d

from .conftest import EDGES
from .plain import contaminated

ITEMS = "text string, item_id long, doc_id long"


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def found(frame, items, spark, **kw):
    bench = spark.createDataFrame([(t, i, 0) for i, t in items], ITEMS)
    return [(r.doc_id, [x.item_id for x in r.items]) for r in d.contamination(frame, bench, **kw).collect()]


def test_planted_passages(spark, docs):
    rng = random.Random(9)
    items = [(i, words(rng, rng.randrange(10, 60))) for i in range(40)]
    rows, want = [], {}
    for k in range(400):
        text = words(rng, rng.randrange(5, 400))
        if k % 4 == 0:
            i, passage = items[rng.randrange(len(items))]
            passage = list(passage)
            for j in rng.sample(range(len(passage)), len(passage) // 12):  # substitutions
                passage[j] = "other"
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() + "," if rng.random() < 0.2 else w for w in passage]
            want[k] = i
        rows.append((k, " ".join(text)))
    bench = [(i, " ".join(t)) for i, t in items] + [(90, None), (91, ""), (92, "too short"), (None, "x " * 30), (93, "")]
    whole = found(docs(rows), bench, spark)
    for k, ids in whole:
        assert not ids or ids == [want.get(k)]
    assert sum(bool(x) for _, x in whole) >= 0.97 * len(want)
    # a small filter lets more pass; the join drops it
    assert sorted(found(docs(rows), bench, spark)) == sorted(whole)


def test_against_a_plain_version(spark, docs, monkeypatch):
    rng = random.Random(2)
    small = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    items = [(i % 17 if i % 6 else None, " ".join(small(rng.choice([1, 2, 5, 7, 8, 9, 11, 12, 15, 20, 24, 41, 60])))) for i in range(30)]
    rows = []
    for k in range(200):
        text = small(rng.randrange(0, 60))
        passage = rng.choice(items)[1].split()
        for j in rng.sample(range(len(passage)), rng.randrange(0, max(1, len(passage) // 3))):
            passage[j] = "other"
        at = rng.randrange(len(text) + 1)
        text[at:at] = passage[rng.randrange(3) if len(passage) > 20 else 0 :]
        rows.append((k, " ".join(text)))
    want = {k: {i if i is not None else -1 for i, t in items if contaminated(text, t)} for k, text in rows}
    assert sum(map(bool, want.values())) > 60
    for bits in (29, 16):
        monkeypatch.setattr(d, "FILTER_BITS", bits)
        got = {k: {i if i is not None else -1 for i in ids} for k, ids in found(docs(rows), items, spark)}
        assert all(got[k] <= want[k] for k in want)
        assert sum(len(got[k]) for k in want) >= 0.98 * sum(len(want[k]) for k in want)


def test_recall_by_length_and_substitutions():
    """A passage that the rule calls contaminated has a hit, and is found by comparing around it."""
    rng = random.Random(3)
    for n, most in ((1, 0), (5, 0), (7, 0), (8, 2), (10, 2), (12, 3), (15, 3), (16, 4), (20, 5), (24, 6), (32, 8), (39, 9), (40, 10), (60, 15)):
        for subs in {0, most // 2, most}:
            hits = 0
            for _ in range(200):
                item = d.Words()(" ".join(words(rng, n)))
                passage = item.copy()
                passage[rng.sample(range(n), subs)] = rng.randrange(1 << 60)
                seeds = any((d.seed_hashes(d.multiplied(item), m) == d.seed_hashes(d.multiplied(passage), m)).any() for m in d.masks_of(n))
                hits += seeds and d.overlap(passage == item, n, d.LEAST) is not None
            assert hits >= 0.97 * 200, (n, subs, hits)


def test_recall_of_passages_inside_items():
    """Sixteen matching tokens in a stretch, anywhere in an item, with substitutions between."""
    rng = random.Random(5)
    for n in (17, 24, 60, 200):
        for size, subs in ((16, 0), (17, 1), (18, 2), (19, 3), (20, 4), (21, 5), (22, 5), (22, 6), (23, 6), (24, 6)):
            hits = tried = 0
            while tried < 150 and size <= n:
                at = rng.randrange(n - size + 1)
                match = np.zeros(n, bool)
                match[at : at + size] = True
                match[[at + k for k in rng.sample(range(size), subs)]] = False
                if d.overlap(match, n, d.LEAST) is None:
                    continue
                tried += 1
                hits += any(all(match[p + j] for j, bit in enumerate(m) if bit == "1") for m in d.masks_of(n) for p in range(n - len(m) + 1))
            assert hits >= 0.99 * tried, (n, size, subs, hits, tried)


def test_edges(spark, docs, edges):
    got = found(edges, [(1, "long " * 30), (2, "the very same words and more of them in a passage of the benchmark")], spark)
    assert sorted((i or 0, x) for i, x in got) == sorted((i or 0, [1] if i in (7, 8) else []) for i, _ in EDGES)
    assert all(not x for _, x in found(edges, [], spark)) and len(found(edges, [], spark)) == len(EDGES)
    assert found(docs([]), [(1, "long " * 30)], spark) == []


def test_repeated_and_null_ids(spark, docs):
    passage = " ".join(f"t{k}" for k in range(30))
    rows = [(1, "a b " + passage), (1, "a b " + passage), (1, "clean"), (None, passage + " x"), (None, "clean too")]
    bench = spark.createDataFrame([("other " * 20, 4, 0), (passage, 4, 0), (passage, None, 0)], ITEMS)
    got = sorted((r.doc_id or 0, [(x.item_id, x.matches, x.start, x.end) for x in r.items]) for r in d.contamination(docs(rows), bench).collect())
    both = lambda a: [(None, 30, a, a + 30), (4, 30, a, a + 30)]
    assert got == [(0, []), (0, both(0)), (1, []), (1, both(2)), (1, both(2))]
    frame = docs(rows).withColumnRenamed("lang", "th").withColumnRenamed("source", "gone_id")
    kept = d.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and sorted(r.text for r in kept.collect()) == ["clean", "clean too"]
