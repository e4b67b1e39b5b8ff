"""Joins on intervals: each interval meets those it overlaps, without meeting all others of its group.

An interval of up to WIDTH * GROWTH ** k has level k, and lies in two bins of that width at most. It is laid out in its bins of
its own and every coarser level, so a very long one takes no more rows than a short one. Two intervals meet at the coarser of
their levels, in the one bin where the later of the two begins, so no pair comes twice. Levels at which the other side has
nothing to meet are left out: which ones it has is asked first, so that most rows are shuffled once or twice, not once a level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A pair that is compared in vain costs far less than a row that is shuffled, so the narrowest bins aren't very narrow.
WIDTH, GROWTH, LEVELS = 512, 8, 7


def _level(length: Column) -> Column:
    """The first level wide enough; the last one for all that are longer, which have as many bins there as they need."""
    return reduce(lambda out, k: F.when(length <= WIDTH * GROWTH**k, k).otherwise(out), reversed(range(LEVELS - 1)), F.lit(LEVELS - 1))


def _width(level: Column) -> Column:
    return F.pow(F.lit(GROWTH), level).cast("long") * WIDTH


def _span(start: str, end: str) -> tuple[Column, Column]:
    return F.col(start).cast("long"), F.col(end).cast("long")


def _levels(rows: DataFrame, on: list[str], start: str, end: str) -> DataFrame:
    """One row: the levels that there are. Rows are those of the join, so that shuffles below are made once for both."""
    s, e = _span(start, end)
    return rows.dropna(subset=on).where(s < e).agg(F.collect_set(_level(e - s)).alias("_others"))


def _place(level: Column, bin: Column) -> Column:
    return bin * LEVELS + level


def _laid_out(rows: DataFrame, start: str, end: str, others: DataFrame | None = None) -> DataFrame:
    """Rows at each of their places, a level and a bin in one number. others: levels of the other side, all if it isn't given."""
    s, e = _span(start, end)
    # floor and not div, for places may be negative
    first = lambda x, k: F.floor(x / _width(k)).cast("long")
    places = lambda k: F.transform(F.sequence(first(s, k), first(e - 1, k)), lambda b: _place(k, b))
    level, rows = _level(e - s), rows.where(s < e)
    at = F.sequence(level, F.lit(LEVELS - 1))
    if others is not None:
        rows = rows.crossJoin(F.broadcast(others))  # one row
        at = F.filter(at, lambda k: F.exists("_others", lambda o: (o == k) | ((o < k) & (k == level))))
    return rows.withColumn("_place", F.explode(F.flatten(F.transform(at, places)))).drop("_others")


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Rows of both sides with equal `on` whose spans [start, end) overlap; columns of left, then those of right but for `on`.

    But for `on` the sides share no column names. Empty spans, and null ones or null keys, overlap nothing.
    """
    a, b = _laid_out(left, *left_span, _levels(right, on, *right_span)), _laid_out(right, *right_span, _levels(left, on, *left_span))
    # Keys begin with their hash, which sorts faster than texts do.
    key = [*on, "_place"]
    a, b = (x.withColumn("_meet", F.xxhash64(*key)) for x in (a, b))
    (s, e), (t, f) = _span(*left_span), _span(*right_span)
    level = F.greatest(_level(e - s), _level(f - t))
    there = F.col("_place") == _place(level, F.floor(F.greatest(s, t) / _width(level)).cast("long"))
    rows = a.join(b, ["_meet", *key]).where((s < f) & (t < e) & there)
    return rows.select(*[F.col(c) for c in left.columns], *[F.col(c) for c in right.columns if c not in on])


def near_join(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, most: int) -> DataFrame:
    """Rows of both sides with equal `on` whose places are at most so far apart."""
    a = left.withColumn("_from", F.col(left_at).cast("long")).withColumn("_to", F.col("_from") + 1)
    b = right.withColumn("_low", F.col(right_at).cast("long") - most).withColumn("_high", F.col("_low") + 2 * most + 1)
    return overlap_join(a, b, on, ("_from", "_to"), ("_low", "_high")).drop("_from", "_to", "_low", "_high")
