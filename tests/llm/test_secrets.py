import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kgspark.llm import secrets
from kgspark.llm.secrets import Rule, trigram_query

from .conftest import EDGES

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [x[2] for x in sorted(out)]


def check(rows, found):
    for (_, text), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), sorted(found, key=lambda r: (r.doc_id is not None, r.doc_id or 0)), strict=True):
        want = brute(text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r.spans.split(","))


def test_edges(edges):
    check(EDGES, secrets.report(secrets.scan(edges)).collect())


def test_random_against_brute_force(docs):
    rng = random.Random(3)
    bits = ["password", "PassWd", "api_key", "APIkey", "ToKen", ' = "', ":", "'", "abc123", "x" * 7, "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "0f", " ", "é", "ſecret=abcdefgh", "token=ab token=abcdef", "\n", "🙂"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(400)]
    check(rows, secrets.report(secrets.scan(docs(rows))).collect())


def test_more_rules_and_empty(docs):
    token = "ghp_" + "a1B2" * 9
    spans = secrets.report(secrets.scan(docs([(1, f"x {token} -----BEGIN RSA PRIVATE KEY-----")]))).first().spans
    assert f"forge:2:{2 + len(token)}" in spans and "pem:" in spans
    assert secrets.scan(docs([])).count() == 0


def test_queries():
    assert trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert trigram_query("[0-9a-f]{24,}") is None
    assert trigram_query("(abcd|xyz)?q") is None
    assert secrets.trigrams(trigram_query("(abc|xyz)+")) == {"abc", "xyz"}


@settings(max_examples=80, deadline=None)
@given(st.text("abcdABCD", max_size=30), st.sampled_from(["abc", "ab+c", "(abc|bcd)d?", "a[bc]{2}d", "(ab|cd){2}", "a.cd", "[ab]cd(a|b)"]))
def test_query_holds_for_every_match(text, pattern):
    import numpy as np

    query = trigram_query(pattern)
    wanted = sorted(secrets.trigrams(query))
    index = secrets.Index(wanted)
    data = np.frombuffer(text.encode(), np.uint8)
    asked = index.ask(query, index.build(data, np.array([0, len(data)])))[0]
    assert asked or not list(Rule("x", pattern, any_case=True).compiled().finditer(text))
