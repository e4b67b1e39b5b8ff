import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgspark.llm import simhash

from .conftest import EDGES


def plain(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(fps):
    """index -> smallest index reachable at 3 or fewer bits."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@settings(max_examples=100, deadline=None)
@given(st.text("ab \té É", max_size=40))
def test_fingerprint(text):
    import pyarrow as pa
    import pyarrow.compute as pc

    low = pc.ascii_lower(pa.array([text])).cast(pa.large_binary())[0].as_py()
    assert simhash.fingerprint(low) == plain(text)


def test_long_text_in_runs(monkeypatch):
    text = " ".join(str(i % 977) for i in range(3000))
    want = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "RUN", 100)
    assert simhash.fingerprint(text.encode()) == want == plain(text)


def test_links_keep_every_connection(spark, monkeypatch):
    rng = random.Random(4)
    fps = []
    for _ in range(12):  # chains and dense balls
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.append(x)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
    x = rng.getrandbits(64)
    fps += [x ^ (1 << i) ^ (1 << j) for i in range(8) for j in range(i)] + [0, 7, 2**64 - 1, (2**64 - 1) ^ (7 << 61)]
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    for owned, crowd in ((6000, simhash.CROWD), (3, simhash.CROWD), (6000, 3000)):
        monkeypatch.setattr(simhash, "OWNED", owned)
        monkeypatch.setattr(simhash, "CROWD", crowd)
        distinct = spark.createDataFrame([(f,) for f in signed], "fp long")
        found = simhash.links(distinct, len(fps)).collect()
        assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 3 for r in found)
        roots = {r.node: r.root for r in simhash.components(spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long")).collect()}
        want = groups(fps)
        mine = {}
        for f, g in zip(signed, want, strict=True):
            mine.setdefault(g, set()).add(roots.get(f, f))
        assert all(len(x) == 1 for x in mine.values())
        assert len(set().union(*mine.values())) == len(mine)


def test_an_owner_of_many_is_split(spark, monkeypatch):
    """Fingerprints that agree in their low bits: no task gets more variants than it may, and no link is lost."""
    rng = random.Random(6)
    fps = sorted({(rng.getrandbits(64) & ~0xFFFFF) | 0x5A5A5 for _ in range(900)})
    fps = sorted({*fps, *(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps[:300])})
    monkeypatch.setattr(simhash, "CROWD", 60_000)
    routed = spark.createDataFrame([(f,) for f in np.array(fps, np.uint64).view(np.int64).tolist()], "fp long")
    found = simhash.links(routed, len(fps)).collect()
    got = {frozenset((r.a & (2**64 - 1), r.b & (2**64 - 1))) for r in found}
    near = {frozenset((a, b)) for k, a in enumerate(fps) for b in fps[:k] if bin(a ^ b).count("1") <= 3}
    assert got <= near and len(near) >= 290
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in map(sorted, got):
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(f) for f in fps] == [fps[k] for k in groups(fps)]


def test_edges_and_copies(spark, docs, edges):
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_groups(edges).collect()))
    fps = [plain(t) for _, t in EDGES]
    ids = [i for i, _ in EDGES]
    want = []
    for i, f, g in zip(ids, fps, groups(fps), strict=True):
        members = [ids[k] for k, x in enumerate(groups(fps)) if x == g and ids[k] is not None]
        want.append((i is not None, i or 0, f, min(members) if members else None))
    assert got == sorted(want)
    assert simhash.near_groups(docs([])).count() == 0


def alike(rows, least=0.8, width=5):
    """index -> smallest index reachable over pairs of that similarity, by plain sets of word tuples."""
    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    own = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            every = len(own[i] | own[j])
            if every == 0 or len(own[i] & own[j]) / every >= least:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(rows))]


def test_similar_documents_leave_one(docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioutnrs") for _ in range(rng.randrange(2, 8)))
    rows = []
    for k in range(40):
        words = [word() for _ in range(rng.choice([8, 30, 120, 500, 1500]))]
        rows.append((100 * k, "a line that very many of these documents share " * (k % 2) + " ".join(words)))
        for c in range(1, rng.randrange(1, 6)):  # copies with some words changed
            copy = list(words)
            for _ in range(max(1, len(copy) // rng.choice([60, 90, 200]))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((100 * k + c, "a line that very many of these documents share " * (k % 2) + " ".join(copy)))
    groups_of = alike(rows)
    kept = sorted(r.doc_id for r in simhash.drop_near_copies(docs(rows)).collect())
    want = sorted(rows[i][0] for i in set(groups_of))
    assert kept == want


def test_similar_documents_edges(docs, edges):
    kept = sorted(r.doc_id for r in simhash.drop_near_copies(edges).collect() if r.doc_id is not None)
    assert kept == [1, 3, 5, 6, 7, 9] and simhash.drop_near_copies(edges).columns == edges.columns
    assert simhash.drop_near_copies(docs([])).count() == 0


def stays(docs, rows):
    kept = sorted(r.doc_id for r in simhash.drop_near_copies(docs(rows)).collect())
    assert kept == sorted(rows[i][0] for i in set(alike(rows)))
    return kept


def test_hundreds_of_edits_of_one_text(docs):
    rng = random.Random(31)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for k in range(500):
        copy = list(base)
        for j in rng.sample(range(100), 2):
            copy[j] = f"x{k}y{j}"
        rows.append((k, " ".join(copy)))
    assert 100 < len(stays(docs, rows)) < 450


def test_texts_that_differ_in_repetition(docs):
    rng = random.Random(32)
    rows = []
    for k in range(30):
        words = [f"k{k}w{i}" for i in range(rng.choice([330, 640]))]
        twice = words + words
        for j in rng.sample(range(len(twice)), len(twice) // 100):
            twice[j] = f"k{k}x{j}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(twice))]
    assert len(stays(docs, rows)) < 60


def test_short_texts_at_the_limit(docs):
    rng = random.Random(33)
    rows = []
    for k in range(300):
        words = [f"k{k}w{i}" for i in range(rng.randrange(5, 13))]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join([*words, "more"])), (3 * k + 2, " ".join([words[0]] * rng.randrange(5, 9)))]
    rows += [(2000, "a a a a a a"), (2001, "a a a a a a a a a"), (2002, "a b"), (2003, "A  b")]
    assert stays(docs, rows)


def test_near_copies_are_suggested_by_fingerprints(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(words).upper() + " ", " ".join(reversed(words)), None, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select(simhash.row_key("doc_id", "text").alias("uid"), F.coalesce("text", F.lit("")).alias("text"))
    uid = {r.doc_id: r.uid for r in docs.select("doc_id", simhash.row_key("doc_id", "text").alias("uid")).collect()}
    at = {i: simhash.fingerprint((t or "").lower().encode()) for i, t in enumerate(texts)}
    found = {frozenset((r.a, r.b)) for r in simhash.fingerprint_pairs(rows).collect()}
    assert all(any((at[i] ^ at[j]).bit_count() <= 3 and {uid[i], uid[j]} == set(p) for i in at for j in at if i != j) for p in found)
    assert {frozenset((uid[0], uid[2])), frozenset((uid[4], uid[5]))} <= found
    # The pairs of the prefix search left out, fingerprints alone find these copies.
    monkeypatch.setattr(simhash, "_room", lambda least: F.lit(False))
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect())[:1] == [0]
    assert not {2, 5} & {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
