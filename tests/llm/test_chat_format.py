import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from kgspark.llm import chat_format as c

CONV = "role string, n_tokens long, text string, conv_id long, window long, turn long"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("<>/turn \\\nassistant#é", max_size=12), st.text("<>/turn \\\n#é", max_size=30)), max_size=5))
def test_round_trip(turns):
    assert list(c.read_turns("".join(c.format_turn(r, t)[0] for r, t in turns))) == turns
    for r, t in turns:
        turn, a, b = c.format_turn(r, t)
        assert c.unescape(turn[a:b]) == t


def brute(rows):
    """conv_id -> (turns, turns_sha256, loss_chars, loss_sha256)"""
    order = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(r, -1, t, i, -1, k) for i, k, r, t in rows], CONV)


def rows(n=40):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["word", "</turn>", "\\", "<turn assistant>", "é", "\n", "### Assistant:"]) for _ in range(rng.randrange(60)))
    out = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"), (None, 0, None, None), (1, None, "user", "no turn"), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, 0, "assistant", "long " * 3000), (2, 1, "system", "late system")]
    for conv in range(10, 10 + n):
        out += [(conv, k, ("system" if k == 0 and conv % 3 == 0 else ("user", "assistant")[k % 2]), text()) for k in range(rng.randrange(1, 30))]
    return out


def test_against_brute_force(spark):
    for budget, history in ((2048, 512), (150, 40), (1, 0)):
        got = c.read_back(c.format_conversations(frame(spark, rows()), budget, history)).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows())


def test_windows(spark):
    windows = c.format_conversations(frame(spark, rows()), 300, 80).collect()
    many = {}
    for w in windows:
        many.setdefault(w.conv_id, []).append(w)
        turns = list(c.read_turns(w.text))
        assert len(turns) == w.n_repeated + w.n_new
        assert w.over_budget == (w.n_tokens > 300) and (not w.over_budget or w.n_new == 1)
    for conv, own in many.items():
        own.sort(key=lambda w: w.window)
        first = next(c.read_turns(own[0].text))
        for before, w in zip(own, own[1:]):
            turns = list(c.read_turns(w.text))
            if first[0] == "system":
                assert turns[0] == first
            rest = turns[(first[0] == "system") : w.n_repeated]
            assert not rest or rest == list(c.read_turns(before.text))[-len(rest) :] or len(rest) > before.n_new  # the nearest turns


def test_one_hot_conversation(spark):
    own = [(5, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(5000)]
    got = c.read_back(c.format_conversations(frame(spark, own), 200, 50)).collect()
    assert [(r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got] == [brute(own)[5]]


def test_empty(spark):
    assert c.read_back(c.format_conversations(frame(spark, []))).count() == 0


def greedy(sizes, system, budget, history):
    """(repeated turns, new turns, tokens) of each window, turn by turn."""
    out, past, new = [], [], []

    def head():
        return (sizes[0] if system and out else 0) + sum(sizes[k] for k in past)

    def close():
        out.append(([0] * bool(system and out) + past, list(new), head() + sum(sizes[k] for k in new)))
        past.extend(k for k in new if k or not system)
        while past and sum(sizes[k] for k in past) > history:
            past.pop(0)
        new.clear()

    for k, n in enumerate(sizes):
        if new and head() + sum(sizes[j] for j in new) + n > budget:
            close()
        while past and not new and head() + n > budget:
            past.pop(0)
        new.append(k)
    if new:
        close()
    return out


def test_windows_are_those_of_turn_by_turn():
    rng = random.Random(9)
    for trial in range(600):
        sizes = [rng.choice([0, 1, 3, 7, 20, 60]) + rng.randrange(4) for _ in range(rng.randrange(30))]
        system, budget = rng.random() < 0.5, rng.choice([10, 40, 100])
        history = rng.randrange(budget + 1)
        turns = [("system" if system and not k else "user", str(k)) for k in range(len(sizes))]
        own, got, k = c.Windows(1, budget, history), [], 0
        while k < len(sizes):
            z = k + rng.randrange(1, 9)
            got += own.feed(turns[k:z], sizes[k:z], False)
            k = z
        got += own.feed([], [], True)
        want = greedy(sizes, system, budget, history)
        seen = [([int(t) for _, t in c.read_turns(w["text"])], w["n_repeated"], w["n_new"], w["n_tokens"], w["over_budget"]) for w in got]
        assert seen == [(a + b, len(a), len(b), n, n > budget) for a, b, n in want], (trial, sizes, system, budget, history)
