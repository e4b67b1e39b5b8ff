import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kgspark.llm import runs

from .conftest import EDGES


def brute(words, length=6, exponent=4):
    """Runs by their definition: for each period the maximal stretches, unless a smaller period holds."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            z = i
            while z + p < n and words[z] == words[z + p]:
                z += 1
            if z + p - i >= 2 * p:
                found.setdefault((i, z + p - i), p)
            i = z
    return sorted(((a, m, p) for (a, m), p in found.items() if m >= max(length, exponent * p)), key=lambda r: (r[0], r[2]))


def report(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    own = brute(words)
    gone = {k for a, m, p in own for k in range(a + p, a + m)}
    top = min(own, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(own), *top, top[1] * 1000 // top[2] if own else None, sha("".join(f"{a},{m},{p}\n" for a, m, p in own).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(2, 2), (6, 4), (1, 3)]))
def test_runs_are_those_of_the_definition(values, least):
    words = [b"%d" % v for v in values]
    assert runs.runs_of(words, *least) == brute(words, *least)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)), max_size=6))
def test_nested_repetitions(parts):
    words = [b"%d" % v for own, k in parts for v in own * k]
    assert runs.runs_of(words) == brute(words) and runs.runs_of(words * 2, 2, 2) == brute(words * 2, 2, 2)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=80))
def test_next_smaller_suffixes(w):
    after, agree, _ = runs.next_smaller(w)
    for i in range(len(w)):
        j = next((k for k in range(i + 1, len(w)) if w[k:] < w[i:]), len(w))
        assert after[i] == j
        if j < len(w):
            k = 0
            while j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            assert agree[i] == k


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("name", ["equal", "fibonacci", "thue", "random", "periodic", "powers", "broken"])
def test_words_are_compared_a_linear_number_of_times(name):
    rng, n = random.Random(7), 20_000
    w = {
        "equal": lambda: [1] * n,
        "fibonacci": lambda: fibonacci(n),
        "thue": lambda: [bin(i).count("1") % 2 for i in range(n)],
        "random": lambda: [rng.randrange(2) for _ in range(n)],
        "periodic": lambda: [rng.randrange(3) for _ in range(701)] * (n // 701),
        "powers": lambda: [(i & -i).bit_length() for i in range(1, n)],
        "broken": lambda: [0 if i % 97 else rng.randrange(2) for i in range(n)],
    }[name]()
    for own in (w, [-x for x in w], w[::-1]):
        assert runs.next_smaller(own)[2] <= 2 * len(own)


def test_edges_against_the_definition(docs):
    rows = EDGES + [(k, "a b c d e f g h " * 9 + "x y " * k) for k in range(20, 60)] + [(5, "\x0ba\x0ca\ta\ra\na a"), (60, "ü ü ü ü ü ü ß")]
    rows = [(i, t if t is None or len(t) < 9999 else "long " * 300) for i, t in rows]
    got = runs.report(runs.periodic_runs(runs.planted(docs(rows)))).select(NAMES).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((report(i, t) for i, t in rows), key=repr)


def test_a_very_long_text_and_an_empty_table(docs):
    r = runs.report(runs.periodic_runs(docs([(1, "long " * 300_000 + "end")]))).first()
    assert (r.n_runs, r.start, r.length, r.period, r.n_words) == (1, 0, 300_000, 1, 300_001)
    assert runs.report(runs.periodic_runs(docs([]))).count() == 0
