import numpy as np

from kgspark.llm import token_counts, tokens
from kgspark.llm.shared import file_bytes, tokenizer_path

from .conftest import EDGES


def lengths(texts):
    return np.array(tokens.counts(tokens.encoding(file_bytes(tokenizer_path(tokens.VOCABULARY))), [t or "" for t in texts]))


def test_edges_against_brute_force(edges, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 4)  # several blocks
    n = lengths([t for _, t in EDGES])
    sums = token_counts.suffix_sums(token_counts.histogram(edges))
    got = {r.n_tokens: r for r in sums.collect()}
    assert sorted(got) == sorted(set(n.tolist()))
    for k, r in got.items():
        assert (r.docs, r.docs_ge, r.tokens_ge) == ((n == k).sum(), (n >= k).sum(), n[n >= k].sum())
        assert (r.docs_total, r.tokens_total, r.truncated_tokens) == (len(n), n.sum(), np.minimum(n, k).sum())
        assert r.share_le == (n <= k).mean()
    limits = [0, 1, 2, 5, 59_999, 60_001, 10**9]
    for r in token_counts.at_limits(sums, limits).collect():
        assert (r.docs_over, r.truncated_tokens) == ((n > r.limit).sum(), np.minimum(n, r.limit).sum())
    for share in (0.1, 0.5, 0.9, 1.0):
        assert token_counts.quantile(sums, share).first().n_tokens == np.sort(n)[int(np.ceil(share * len(n) - 1e-9)) - 1]


def test_empty(docs):
    assert token_counts.suffix_sums(token_counts.histogram(docs([]))).count() == 0
