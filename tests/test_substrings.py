import random
import time
from operator import itemgetter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kgspark.functions import substrings
from kgspark.functions.substrings import take_all, take_any

ROW = st.fixed_dictionaries({"page": st.integers(1, 2), "text": st.text("ab ", max_size=5), "norm": st.text("ab", max_size=3)})
PAGE, FIELDS = itemgetter("page"), [("text", "text", False), ("norm", "norm", True)]


def within(a, b):
    return a in b or b in a


def greedy(predicted, gold, fits):
    taken, out = set(), []
    for p in predicted:
        k = next((k for k, g in enumerate(gold) if k not in taken and fits(p, g)), None)
        out.append(k)
        taken.add(k)
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(ROW, max_size=12), st.lists(ROW, max_size=12), st.sampled_from([0, 10**9]))
def test_every_rule_takes_what_the_loop_takes(p, g, few):
    before, substrings.FEW = substrings.FEW, few
    try:
        norm = lambda a, b: bool(b["norm"]) and within(b["norm"], a["norm"])
        assert take_any(p, g, FIELDS, PAGE) == greedy(p, g, lambda a, b: a["page"] == b["page"] and (within(a["text"], b["text"]) or norm(a, b)))
        assert take_any(p, g, FIELDS[:1], PAGE) == greedy(p, g, lambda a, b: a["page"] == b["page"] and within(a["text"], b["text"]))
        assert take_any(p, g, [("text", "text", False), ("text", "norm", True)]) == greedy(p, g, lambda a, b: within(a["text"], b["text"]) or bool(b["norm"]) and within(b["norm"], a["text"]))
        assert take_all(p, g, [("text", "text"), ("norm", "norm")]) == greedy(p, g, lambda a, b: within(a["text"], b["text"]) and within(a["norm"], b["norm"]))
    finally:
        substrings.FEW = before


@pytest.mark.parametrize("kind", ["own", "equal", "inside", "around", "nothing"])
def test_a_group_of_a_hundred_thousand(kind):
    n, rng = 100_000, random.Random(2)
    gold = [{"page": 1, "text": {"equal": "x", "inside": f"long text {k} here", "around": "x"}.get(kind, f"text {k:06d}"), "norm": f"n{k}"} for k in range(n)]
    own = [{"page": 1, "text": {"equal": "x", "inside": "text", "around": f"{k} x {k}", "nothing": f"none {k}"}.get(kind, f"a text {k:06d} more"), "norm": f"m{k}"} for k in range(n)]
    rng.shuffle(own)
    began = time.perf_counter()
    found = take_any(own, gold, FIELDS, PAGE)
    assert time.perf_counter() - began < 30
    if kind == "own":
        assert all(gold[k]["text"] in p["text"] for p, k in zip(own, found))
    else:
        assert found == ([None] * n if kind == "nothing" else list(range(n)))
