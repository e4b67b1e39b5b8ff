import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kgspark.llm import recompression as rc

from .conftest import EDGES


def brute(rows, window):
    """n_words, n_removed, kept_sha256 of each row, by all windows."""
    texts = [(rc.NO_ID if i is None else i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    least = {}
    for i, w in texts:
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for (own, _), (i, w) in zip(rows, texts):
        gone = {k for a in range(len(w) - window + 1) if least[tuple(w[a : a + window])] < i for k in range(a, a + window)}
        out.append((own, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=repr)


def found(frame, window):
    return sorted((tuple(r)[:4] for r in rc.report(rc.cut_passages(frame, window)).collect()), key=repr)


def keys_of(words, window):
    names = rc.mixed(np.array(words, np.uint64))
    first = np.zeros(len(names), bool)
    first[0] = True
    return rc.phrases(names, first, np.arange(len(names) - window + 1), window)


@settings(max_examples=400, deadline=None)
@given(st.data(), st.sampled_from([3, 8, 50]), st.sampled_from([2, 5, 1000]))
def test_phrases_depend_on_the_window_alone(data, window, letters):
    word = st.integers(0, letters)
    own = data.draw(st.lists(word, min_size=window, max_size=window + 20))
    around = [data.draw(st.lists(word, max_size=30)) for _ in range(4)]
    one, two = keys_of([*around[0], *own, *around[1]], window), keys_of([*around[2], *own, *around[3]], window)
    n = len(own) - window + 1
    assert (one[len(around[0]) :][:n] == two[len(around[2]) :][:n]).all()


def test_periodic_windows_share_phrases_too():
    for own in ([7] * 120, [1, 2] * 60, [1, 2, 3, 4, 5, 6, 7] * 20, [1] * 60 + [2] * 60):
        a, b = keys_of([9, 8, *own, 8], 50), keys_of([7, 7, 7, 7, 7, *own, 1, 2, 3], 50)
        n = len(own) - 49
        assert (a[2 : 2 + n] == b[5 : 5 + n]).all()


def test_words_don_t_cross_texts():
    data, offsets = np.frombuffer(b"ab cd" b"" b"ef" b" " b"\x0bgh\x0c", np.uint8), np.array([0, 5, 5, 7, 8, 12])
    assert [x.tolist() for x in rc.words_of(data, offsets)] == [[0, 3, 5, 9], [2, 5, 7, 11]]
    assert [x.tolist() for x in rc.words_of(np.zeros(0, np.uint8))] == [[], []]


def passages(seed, n, window):
    """Documents that share passages with each other, in part by copying, some of them periodic."""
    rng = random.Random(seed)
    shared = [[f"s{k}-{j}" for j in range(window + 13)] for k in range(4)] + [["a", "b"] * window, ["c"] * (3 * window)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(6)):
            part = rng.choice(shared)
            a = rng.randrange(len(part) // 3)
            words += [rng.choice("xyz") for _ in range(rng.randrange(4))] + part[a : len(part) - rng.randrange(12)]
        words += [f"w{rng.randrange(6)}" for _ in range(rng.randrange(2 * window))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(n + k, rows[rng.randrange(n)][1]) for k in range(5)] + [(3, rows[5][1]), (3, rows[3][1])]
    rng.shuffle(rows)
    return rows


def test_removed_words_are_those_of_brute_force(docs):
    for window in (50, 8):
        rows = passages(window, 60, window)
        want = brute(rows, window)
        assert found(docs(rows).repartition(3), window) == want and sum(r[2] for r in want) > 1000


def test_small_blocks_change_nothing(docs, monkeypatch):
    rows = [r for r in passages(3, 12, 20)]
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for _, t in rows])))

    def phrase_of_start():
        text, at, n, key, *_ = rc.regions_of(data, offsets, 20)
        return {(t, a + k): x for t, a, m, x in zip(text.tolist(), at.tolist(), n.tolist(), key.tolist()) for k in range(m)}

    whole = phrase_of_start()
    monkeypatch.setattr(rc, "BLOCK", 64)
    assert phrase_of_start() == whole


def test_edges(docs):
    rows = [*EDGES, (None, "no id"), (12, " ".join(f"q{k}" for k in range(60))), (None, " ".join(f"q{k}" for k in range(70))), (11, "\x0b".join(f"q{k}" for k in range(5, 58)))]
    short = [(i, t if t is None or len(t) < 9999 else "long " * 200) for i, t in rows]
    assert found(docs(short), 50) == brute(short, 50)
    got = {(r[0], r[1]): r[2] for r in found(docs(rows), 50)}
    assert got[7, 60_000] == 0 and got[8, 60_000] == 60_000
    assert found(docs([]), 50) == []
