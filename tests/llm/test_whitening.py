import math
import random
from fractions import Fraction

import numpy as np
import pytest

from kgspark.llm import whitening

SCHEMA = "label int, embedding array<float>, n long, vec_id long, component int, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(0, v, 5, i, 1, "x") for i, v in rows], SCHEMA)


def plain(rows, most=32):
    """The same from fractions: ids, n, sums, covariance."""
    own = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(own), len(own[0][1])
    s = [sum(x[k] for _, x in own) for k in range(d)]
    v = [[float(Fraction(n * sum(x[a] * x[b] for _, x in own) - s[a] * s[b], n * n)) for b in range(d)] for a in range(d)]
    return own, n, s, np.array(v)


def held_against_plain(got, rows, most=32):
    own, n, s, v = plain(rows)
    values = np.linalg.eigvalsh(v)[::-1]
    k = min(most, int((values > values[0] * len(s) * np.finfo(float).eps).sum()))
    assert len(got) == len(own) * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    w = np.array([[by[i][c].whitened for c in range(1, k + 1)] for i, _ in own])
    for i, x in own:
        r = by[i][1]
        assert (r.n, r.deviation) == (n, sum((n * a - b) ** 2 for a, b in zip(x, s)))
        assert sorted(by[i]) == list(range(1, k + 1))
    centred = w - w.mean(axis=0)
    error = np.abs(centred.T @ centred / n - np.eye(k)).max()
    assert error < 1e-9 and abs(got[0].identity_error - error) < 1e-9
    for c in range(k):
        assert got[0].identity_error <= 1e-4 and math.isclose(by[own[0][0]][c + 1].explained, values[c] / v.trace(), rel_tol=1e-9)
    # The components that the values come from are eigenvectors: projecting centred rows on them gives the values back.
    x = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(row, s)] for _, row in own])
    components = np.linalg.lstsq(x, w * np.sqrt(values[:k]), rcond=None)[0]
    assert np.allclose(v @ components, components * values[:k], atol=1e-8 * values[0]) and np.allclose(x @ components, w * np.sqrt(values[:k]))


def test_whitening_equals_fractions(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + k) + 10 * k for k in range(6)]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1])]
    odd = [(400, None), (401, [None] * 6), (402, [1.0, 2.0, float("nan"), 1.0, 1.0, 1.0]), (403, [float("inf")] + [1.0] * 5), (404, []), (405, [1.0, 2.0])]
    got = whitening.whiten(frame(spark, rows + odd).repartition(5)).collect()
    held_against_plain(got, rows)
    assert len(whitening.whiten(frame(spark, rows), 2).collect()) == 2 * len(rows)


def test_far_from_zero_and_on_few_directions(spark):
    rng = random.Random(4)
    rows = [(i, [float(4_000_000 + rng.randrange(3)), float(rng.randrange(3)), 7.0]) for i in range(50)]
    rows = [(i, [a, b, c]) for i, (a, b, c) in rows]
    got = whitening.whiten(frame(spark, rows)).collect()
    held_against_plain(got, rows)
    assert {r.component for r in got} == {1, 2}  # the third direction has no variance


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (None, [1.0, 2.0])]])
def test_without_variance_there_are_no_rows(spark, rows):
    got = whitening.whiten(frame(spark, rows))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_null_ids_and_huge_entries(spark):
    rows = [(None, [3e38, 1.0]), (1, [-3e38, 2.0]), (1, [0.5, 3.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 3 * len({r.component for r in got}) and all(math.isfinite(r.whitened) for r in got) and {r.deviation for r in got} >= {None}


def test_scatter_is_exact_beyond_doubles():
    rng = random.Random(5)
    rows = [[rng.randrange(-(1 << 61), 1 << 61) for _ in range(3)] for _ in range(50)] + [[5, -7, 1 << 61]]
    s = whitening.Scatter(3)
    s.add(np.array(rows[:20], np.int64))
    s.add(np.array(rows[20:], np.int64))
    assert s.sums.tolist() == [sum(r[k] for r in rows) for k in range(3)]
    assert s.products.tolist() == [[sum(r[a] * r[b] for r in rows) for b in range(3)] for a in range(3)]
    totals = {}
    for i, j, k, x in s.pieces():
        totals[i, j] = totals.get((i, j), 0) + (x << 32 * k)
    assert all(totals.get((i, j), 0) == s.products[i, j] for i in range(3) for j in range(i, 3)) and totals[-1, -1] == len(rows)
