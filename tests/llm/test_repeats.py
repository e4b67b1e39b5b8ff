import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kgspark.llm import repeats
from kgspark.llm.suffix_sort import Disk, suffixes

from .conftest import EDGES


def order_of(text, depth, disk):
    """Suffixes in order, and the common prefix of each with the next one."""
    out, prefix = [], []

    def emit(items, own):
        out.extend(items.tolist())
        prefix.extend(own.tolist())

    suffixes(np.array(text, np.uint8), depth, emit, disk)
    return out[::-1], prefix[::-1]


def common(text, a, b, depth):
    n = 0
    while n < depth and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
        n += 1
    return n


def check_order(text, depth, disk):
    got, prefix = order_of(text, depth, disk)
    disk.close()
    want = sorted(range(len(text)), key=lambda i: text[i : i + depth])
    assert sorted(got) == list(range(len(text)))
    assert [text[i : i + depth] for i in got] == [text[i : i + depth] for i in want]
    assert prefix[-1] == 0 and prefix[:-1] == [common(text, a, b, depth) for a, b in zip(got, got[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=200), st.sampled_from([1 << 20, 7]), st.sampled_from([1 << 20, 64]), st.sampled_from([3, 17, 60_000]))
def test_suffix_order_and_common_prefixes(chars, chunk, memory, depth):
    check_order([*chars, 0], depth, Disk(memory, chunk))


def test_suffix_order_of_runs_and_long_repeats():
    rng = random.Random(1)
    part = [rng.randrange(1, 200) for _ in range(3000)]
    text = [5] * 2000 + part + [7] * 999 + part + part[::-1] + [0]
    for disk in (Disk(), Disk(4096, 500)):
        check_order(text, 400, disk)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=12, max_size=300))
def test_owned_runs_cover_all_starts(values):
    data = np.array(values, np.uint8)
    at, n, key, places = repeats.owned_runs(data, 12, 4)
    assert len(places) == len(at) and (places >= 1).all()
    assert n.sum() == len(data) - 11 and (at == np.concatenate(([0], np.cumsum(n)[:-1]))).all()
    owner = {}
    for a, m, k in zip(at.tolist(), n.tolist(), key.tolist()):
        for s in range(a, a + m):
            assert owner.setdefault(bytes(data[s : s + 12]), k) == k


def brute(rows, length):
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i or 0, len(t), len(t) - len(kept), int((gone[:-1] & ~gone[1:]).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the ", "é", "abc", "zz", "ô ", "line\n"])
    passages = ["".join(word() for _ in range(40)) for _ in range(6)]
    out = []
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.3 else "".join(word() + str(rng.randrange(999)) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(5))]
        out.append((i, "".join(parts)))
    return [*out, *out[:5], (900, "ab" * 300), (901, "x" * 500), (902, "x" * 40)]


@pytest.mark.parametrize("at_once", [1 << 20, 300])
def test_against_brute_force(docs, at_once, monkeypatch):
    monkeypatch.setattr(repeats, "STARTS", 64)
    frame = docs(rows())
    got = repeats.report(repeats.cut_repeats(frame, 50, 12, at_once)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows(), 50)


def test_external_shard_is_the_same():
    texts = [t.encode() for _, t in rows(8) if len(t.encode()) >= 50]
    counts = [1 + (k % 7 == 0) for k in range(len(texts))]
    plain = [x.tolist() for x in repeats.repeated_starts(texts, counts, 50)]
    assert [x.tolist() for x in repeats.repeated_starts(texts, counts, 50, Disk(2000, 128))] == plain
    assert any(plain)


def test_edges(docs, edges):
    got = repeats.report(repeats.cut_repeats(edges)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == sorted((i or 0, len((t or "").encode()), len(t) if i in (7, 8) else 0) for i, t in EDGES)
    assert repeats.cut_repeats(docs([])).count() == 0


def crowded_rows():
    """A line in many texts, each time between others; another that is longer than any gram but the last."""
    rng = random.Random(5)
    line, long_line = "the same line in many texts, ", "x1y2z3 w4v5u6 and so on to the end, "
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 60)))
    out = [(i, noise() + rng.choice([line, long_line, line + long_line]) + noise()) for i in range(120)]
    return [*out, *[(200 + i, line + long_line + "tail") for i in range(5)], (300, line * 30), (301, "z" * 700 + line)]


@pytest.mark.parametrize("crowd", [1, 8, 500])
def test_crowded_owners_against_brute_force(docs, crowd):
    got = repeats.report(repeats.cut_repeats(docs(crowded_rows()), 40, 10, 2000, crowd)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(crowded_rows(), 40)
    assert all(r.has_repeats == (r.n_removed > 0) and sum(s.end - s.start for s in r.removed_spans or []) == r.n_removed for r in got)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 60)), min_size=1, max_size=5))
def test_shortened_regions_have_the_same_strings(parts):
    data = "".join(p * n for p, n in parts).encode()
    length, gram = 12, 4
    strings = lambda b: {b[i : i + length] for i in range(len(b) - length + 1)}
    for at, n, key, _ in zip(*(x.tolist() for x in repeats.owned_runs(np.frombuffer(data, np.uint8), length, gram))):
        region = data[at : at + n + length - 1]
        short, cuts = repeats.shortened(region, key, length, gram)
        assert strings(short) == strings(region) and len(short) + sum(c["gone"] for c in cuts) == len(region)
        back = short
        for c in reversed(cuts):  # what is left out repeats what stands before it
            back = back[: c["at"]] + b"?" * c["gone"] + back[c["at"] :]
        assert len(back) == len(region) and all(x == y or x == ord("?") for x, y in zip(back, region))


def test_a_megabyte_of_one_byte(docs):
    rows = [(1, "x" * 1_000_000), (2, "a" + "x" * 1000 + "b"), (3, "ab" * 300_000 + "c"), (4, "unlike the others")]
    tracemalloc.start()
    data = np.frombuffer(rows[0][1].encode(), np.uint8)
    at, n, key, _ = repeats.owned_runs(data, 400, 100)
    short, cuts = repeats.shortened(rows[0][1].encode(), int(key[0]), 400, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(at) == 1 and len(short) < 1000 and len(short) + cuts[0]["gone"] == 1_000_000 and peak < 200 << 20
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(repeats.cut_repeats(docs(rows))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (1_000_000, 1, sha("")), 2: (1000, 1, sha("ab")), 3: (600_000, 1, sha("c")), 4: (0, 0, sha("unlike the others"))}


def test_a_shard_ten_times_its_memory():
    rng = np.random.default_rng(7)
    regions = [bytes(rng.integers(97, 105, 600, dtype=np.uint8)) for _ in range(3500)]
    regions += [b"q" * 30 + r[100:580] for r in regions[::50]]
    peaks = []
    for disk in (Disk(), Disk(210_000, 1 << 15)):
        shard = repeats.Shard(disk)
        tracemalloc.start()
        for r in regions:
            shard.add(r, 1)
        held = {k for k, (_, at) in enumerate(shard.repeated(400)) if len(at)}
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert held == {*range(0, 3500, 50), *range(3500, len(regions))}
    assert sum(map(len, regions)) > 10 * disk.memory
    assert peaks[1] < disk.memory + 40 * 8 * disk.chunk and peaks[1] * 10 < peaks[0], peaks  # its share and the chunks at work


def texts_batch(rng, n):
    texts = ["".join(rng.choice(["ab", "é", "c ", "line\n"]) for _ in range(rng.choice([0, 3, 30, 200]))) for _ in range(n)]
    return pa.RecordBatch.from_pydict({"doc_id": pa.array([i if i % 5 else None for i in range(n)], pa.int64()), "th": pa.array(range(n), pa.int64()), "text": texts})


@pytest.mark.parametrize("starts,grouped", [(1 << 20, 1 << 15), (64, 1 << 15), (1 << 20, 500)])
def test_texts_of_a_batch_are_handled_together(starts, grouped, monkeypatch):
    monkeypatch.setattr(repeats, "STARTS", starts)
    monkeypatch.setattr(repeats, "GROUPED", grouped)
    rng = random.Random(11)
    batch = texts_batch(rng, 60).slice(3)
    texts = batch.column("text").to_pylist()
    # The runs leave in one batch, not in one for each document, and are those of each document alone.
    (got,) = repeats._runs(12, 4)(iter([batch]))
    want = [(i, th, *x) for i, th, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text"))) for x in zip(*(y.tolist() for y in repeats.owned_runs(np.frombuffer(t.encode(), np.uint8), 12, 4)))]
    assert [(r["doc_id"], r["th"], r["at"], r["n"], r["key"] % 2**64, r["places"]) for r in got.to_pylist()] == want
    # So do regions, copies of a row's runs as one.
    runs = [[{"at": a, "n": n, "key": (k + 2**63) % 2**64 - 2**63} for _, h, a, n, k, _ in want if h == th] * 2 for th in batch.column("th").to_pylist()]
    kind = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64()), ("key", pa.int64())]))
    (regions,) = repeats._regions(12, 4)(iter([pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, kind)], names=["doc_id", "th", "text", "runs"])]))
    own = {th: t.encode() for th, t in zip(batch.column("th").to_pylist(), texts)}
    parts = [repeats.shortened(own[th][a : a + n + 11], k, 12, 4)[0] for _, th, a, n, k, _ in want]
    assert regions.column("region").to_pylist() == parts and regions.column("th").to_pylist() == [x[1] for x in want]
    # And what is left of the texts: spans that overlap or touch are one, but not across documents.
    spans = [None if k % 3 == 0 else [{"start": 0, "end": len(t.encode())}, *[{"start": a, "end": a + 5} for a in range(0, len(t.encode()) - 5, 7)]][k % 2 :] if t else [] for k, t in enumerate(texts)]
    (cut,) = repeats._cut(iter([pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(spans, repeats.SPANS)], names=["doc_id", "text", "spans"])]))
    for r, t, found in zip(cut.to_pylist(), texts, spans, strict=True):
        data = t.encode()
        gone = np.zeros(len(data) + 1, bool)
        for x in found or []:
            gone[x["start"] : x["end"]] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(int))).tolist()
        assert r["kept"] == bytes(b for b, g in zip(data, gone) if not g) and r["n_bytes"] == len(data)
        assert [y for s in r["spans"] for y in (s["start"], s["end"])] == edge


def test_shards_close_between_owners_inside_a_batch():
    rng = random.Random(4)
    made = [[(k, bytes(rng.choice(b"abcd") for _ in range(20))) for _ in range(rng.randrange(1, 4))] for k in range(40)]
    made = [[*x, (k, x[0][1][3:] + b"xyz")] if k % 2 else x for k, x in enumerate(made)]
    flat = [(k, hashlib.md5(b"%d %d" % (k, j)).digest(), r, 1 + (k % 9 == 0)) for k, x in enumerate(made) for j, (_, r) in enumerate(x)]
    names, want = ["key", "digest", "region", "count"], {}
    for x in made:
        regions, counts = [r for _, r in x], [c for k, _, _, c in flat if k == x[0][0]]
        for (_, d, _, _), at in zip([y for y in flat if y[0] == x[0][0]], repeats.repeated_starts(regions, counts, 12)):
            if len(at):
                want[d] = sorted({b for a in at.tolist() for b in range(a, a + 12)})
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat[a : a + 33]), (pa.int64(), pa.binary(), pa.binary(), pa.int64()))], names=names) for a in range(0, len(flat), 33)]
    got = [r for b in repeats._sorted(12, 25)(iter(batches)) for r in b.to_pylist()]
    assert len(got) == len(want) and {r["digest"]: [b for s in r["spans"] for b in range(s["start"], s["end"])] for r in got} == want
