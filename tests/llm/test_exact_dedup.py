import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kgspark.llm.exact_dedup import drop_copies, exact_groups, golomb_decode, golomb_encode

from .conftest import EDGES


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**44 - 1), max_size=300))
def test_golomb_round_trip(values):
    own = np.array(sorted(values), np.uint64)
    assert golomb_decode(golomb_encode(own, 2**44)).tolist() == own.tolist()


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_edges_against_brute_force(edges):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(edges).collect()]
    groups = {}
    for i, t in EDGES:
        groups.setdefault(lowered(t), []).append(i)
    key = lambda i: -1 if i is None else i
    want = [(i, max(groups[lowered(t)], key=key), len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in EDGES]
    order = lambda x: (key(x[0]), x[-1])
    assert sorted([g[:3] + g[4:] for g in got], key=order) == sorted(want, key=order)
    # one row of each group stays, also where the row with the largest id is repeated
    stay = [g[4] for g in got if g[3]]
    assert sorted(stay) == sorted({g[4] for g in got})
    assert all(g[0] == g[1] for g in got if g[3])


def test_drop_copies_keeps_columns_and_one_row(edges):
    kept = drop_copies(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [2, 4, 5, 6, 8, 9]


@pytest.mark.parametrize("copies", [3000])
def test_large_group(docs, copies):
    got = exact_groups(docs([(i, "a hot text") for i in range(copies)] + [(copies + i, f"other {i}") for i in range(50)])).collect()
    assert sorted(r.doc_id for r in got if r.kept) == list(range(copies - 1, copies + 50))
    assert {r.group_size for r in got} == {copies, 1}


def test_empty(docs):
    assert exact_groups(docs([])).count() == 0
