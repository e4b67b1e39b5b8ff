import random

import pytest

from kgspark.operators import intervals


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_are_those_of_all_pairs(spark, seed):
    rng = random.Random(seed)

    def spans(n):
        out = []
        for i in range(n):
            s = rng.randrange(-5_000, 5_000)
            out.append((i, rng.choice(["x", "y", None]), s, s + rng.choice([0, 1, rng.randrange(60), rng.randrange(600), rng.randrange(9_000), 64, 512])))
        return [*out, (n, "x", -(10**9), 10**9), (n + 1, "y", 0, None), (n + 2, "x", 5, 4)]

    a, b = spans(150), spans(150)
    got = intervals.overlap_join(spark.createDataFrame(a, "i long, k string, s long, e long"), spark.createDataFrame(b, "j long, k string, t long, f long"), ["k"], ("s", "e"), ("t", "f"))
    assert got.columns == ["i", "k", "s", "e", "j", "t", "f"]
    found = sorted((r.i, r.j) for r in got.collect())
    fine = lambda r: r[3] is not None and r[2] < r[3]
    assert found == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[1] and fine(x) and fine(y) and x[2] < y[3] and y[2] < x[3])


def test_places_at_most_so_far_apart(spark):
    rng = random.Random(4)
    a, b = ([(i, "x", rng.randrange(400)) for i in range(120)] for _ in range(2))
    got = intervals.near_join(spark.createDataFrame(a, "i long, k string, s int"), spark.createDataFrame(b, "j long, k string, t int"), ["k"], "s", "t", 5)
    assert got.columns == ["i", "k", "s", "j", "t"]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((x[0], y[0]) for x in a for y in b if abs(x[2] - y[2]) <= 5)


def test_a_long_span_takes_few_rows(spark):
    rows = spark.createDataFrame([(1, 0, 10**7), (2, 3, 4)], "i long, s long, e long")
    assert intervals._laid_out(rows, "s", "e").count() <= 2 * 2 * intervals.LEVELS


def test_rows_are_laid_out_only_where_the_other_side_has_something_to_meet(spark):
    rows = spark.createDataFrame([(k, 1_000 * k, 1_000 * k + 9) for k in range(50)], "i long, s long, e long")
    short, long = (spark.createDataFrame([("k", 0, n)], "k string, s long, e long") for n in (20, 10**9))
    places = lambda others: intervals._laid_out(rows, "s", "e", others).count()
    levels = lambda *sides: intervals._levels(sides[0] if len(sides) == 1 else sides[0].union(sides[1]), ["k"], "s", "e")
    assert places(levels(short)) <= 55 and places(levels(short, long)) <= 110
    assert places(levels(short.where("false"))) == 0
