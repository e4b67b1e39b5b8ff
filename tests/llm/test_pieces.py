import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from kgspark.llm import pieces
from kgspark.llm.shared import file_bytes, tokenizer_path

from .conftest import EDGES

MODEL = file_bytes(tokenizer_path(pieces.MODEL))


@pytest.fixture(scope="module")
def own():
    return pieces.vocabulary(MODEL)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdethinr  .\né漢☃▁0", max_size=60))
def test_lattice_is_the_library(text):
    own = pieces.vocabulary(MODEL)
    whole = pieces.marked(text)
    last = own.walk(whole, None, 0, len(whole))
    assert own.to_ids(whole, own.trace(last, 0, len(whole))) == own.library.encode(text)
    assert own.decode(own.library.encode(text)) == text.replace("▁", " ")


def check(frame, rows, spark, chunk):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    want = sorted((i or 0, hashlib.sha256(np.array(library.encode(t or ""), "<i4").tobytes()).hexdigest(), len(library.encode(t or "")), hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest(), "▁" not in (t or "")) for i, t in rows)
    got = pieces.report(frame, chunk).collect()
    assert sorted((r.doc_id or 0, r.ids_sha256, r.n_tokens, r.text_sha256, r.exact) for r in got) == want
    return got


def test_chunks_of_any_size(spark, docs):
    rng = random.Random(6)
    bits = ["the", " ", "  ", "ing", "Thntblere", "aaaaaaa", "é", "漢字", "☃", "\n", ".", "    ", "internationalization", "0123", "▁"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(120)))) for i in range(120)] + [(200, "a" * 700), (201, " " * 500), (202, "thethethe" * 90)]
    for chunk in (7, 23, 64, 1000):
        got = check(docs(rows), rows, spark, chunk)
    assert max(r.n_chunks for r in got) == 1


def test_products_form_a_tree(spark, docs, monkeypatch):
    rng = random.Random(8)
    bits = ["the", " ", "ing", "Thntblere", "aaaaaaa", "漢字", "internationalization", "▁"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(20, 90)))) for i in range(12)] + [(200, "a" * 500), (201, "thethethe" * 60)]
    monkeypatch.setattr(pieces, "CHUNK", 9)
    for fan in (2, 3):
        monkeypatch.setattr(pieces, "FAN", fan)
        check(docs(rows), rows, spark, 9)


def test_edges(spark, docs, edges):
    got = check(edges, EDGES, spark, pieces.CHUNK)
    assert max(r.n_chunks for r in got) == 19
    assert pieces.report(docs([])).count() == 0
