"""Sharding by a minimax contiguous partition, on DataFrame functions only.

Rows are ordered by the digest of their text, so equal texts are neighbours and form atomic groups. A row's place and the
running sum of sizes come from a range sort: partition numbers and places inside partitions are written down once, and a
table of partition totals (one row per partition) carries the sums over. The smallest feasible capacity is then found by
binary search with a greedy check over the group ends. The driver never sees all ends: it holds counts of ends in a grid,
and asks for finer cells only where a look-up of the search falls into a cell with several ends, until no look-up does.
Within that capacity each cut goes to the group end nearest to an equal share of what is left.

Null and empty texts are one group of size 8 a row. Repeated rows are separate rows of one group. An empty table gives no
rows. A group larger than an equal share fills a shard alone; the others share the rest. Very long texts are measured and
digested where they are read, never shuffled. Extra columns are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import texts_of, written

#: Cells of the first grid, and parts of a cell that is looked at closer.
CELLS, FINER = 4096, 64


class Ends:
    """Group ends as far as they are known: cells (low, high, first end, last end, ends)."""

    def __init__(self, ends: DataFrame, total: int) -> None:
        self.ends, self.total = ends, total
        # Powers of two: a finer cell starts at a multiple of its own width.
        self.cells = self._cells(ends, 1 << (total // CELLS).bit_length())
        self.rough: set[tuple[int, int]] = set()

    def _cells(self, ends: DataFrame, width: int) -> list[tuple[int, int, int, int, int]]:
        cell = F.floor(F.col("cum") / F.lit(width)).cast("long")
        found = ends.groupBy(cell.alias("cell")).agg(F.min("cum").alias("a"), F.max("cum").alias("b"), F.count_distinct("cum").alias("n")).collect()
        return sorted((r.cell * width, (r.cell + 1) * width, r.a, r.b, r.n) for r in found)

    def index(self) -> None:
        self.lows, self.firsts, self.lasts = [c[0] for c in self.cells], [c[2] for c in self.cells], [c[3] for c in self.cells]

    def at_most(self, x: int) -> int:
        """The largest end <= x (0 if none); the cell is noted where it isn't known, and its first end returned."""
        k = bisect.bisect_right(self.firsts, x) - 1
        if k < 0:
            return 0
        low, high, first, last, n = self.cells[k]
        if x >= last:
            return last
        if n > 2:
            self.rough.add((low, high))
        return first

    def at_least(self, x: int) -> int:
        """The smallest end >= x; the total if there is none."""
        if x <= 0:
            return 0
        k = bisect.bisect_left(self.lasts, x)
        if k >= len(self.cells):
            return self.total
        low, high, first, last, n = self.cells[k]
        if x <= first:
            return first
        if n > 2:
            self.rough.add((low, high))
        return last

    def refine(self) -> None:
        """Replace the noted cells by finer ones; one query for each width among them."""
        for width in sorted({h - lo for lo, h in self.rough}):
            picked = {lo for lo, h in self.rough if h - lo == width}
            fine = max(1, width // FINER)
            part = F.floor((F.col("cum") % F.lit(width)) / F.lit(fine)).cast("long")
            base = F.floor(F.col("cum") / F.lit(width)).cast("long")
            found = self.ends.where(base.isin([lo // width for lo in picked])).groupBy(base.alias("base"), part.alias("part")).agg(F.min("cum").alias("a"), F.max("cum").alias("b"), F.count_distinct("cum").alias("n")).collect()
            self.cells = [c for c in self.cells if not (c[0] in picked and c[1] - c[0] == width)]
            for r in found:
                lo = r.base * width + r.part * fine
                self.cells.append((lo, lo + fine, r.a, r.b, r.n))
        self.cells.sort()
        self.rough = set()


def _greedy(ends: Ends, capacity: int, shards: int) -> bool:
    at = 0
    for _ in range(shards):
        if at >= ends.total:
            return True
        to = ends.at_most(at + capacity)
        if to <= at:
            return False
        at = to
    return at >= ends.total


def _search(ends: Ends, shards: int, largest: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the cuts within it."""
    low = max(largest, -(-ends.total // shards))
    high = low + largest
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _greedy(ends, mid, shards) else (mid + 1, high)
    capacity, least = low, [0] * (shards + 1)
    least[shards] = ends.total
    for j in range(shards - 1, 0, -1):  # from the right: the first place from which the rest still fits
        least[j] = ends.at_least(least[j + 1] - capacity)
    cuts, at = [], 0
    for j in range(1, shards):
        want = at + (ends.total - at) / (shards - j + 1)
        below, above = ends.at_most(int(want)), ends.at_least(int(want) + 1)
        cut = below if want - below <= above - want else above
        at = max(min(max(cut, least[j]), ends.at_most(at + capacity)), at)
        cuts.append(at)
    return capacity, cuts


def minimax_cuts(ends: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Capacity and the running sizes at which shards end. ends: cum (running size at a group's end), size (the group's)."""
    top = ends.agg(F.max("cum").alias("total"), F.max("size").alias("largest")).first()
    if not top or top.total is None:
        return 0, [0] * (shards - 1)
    known = Ends(ends, int(top.total))
    while True:
        known.index()
        capacity, cuts = _search(known, shards, int(top.largest))
        if not known.rough:
            return capacity, cuts
        known.refine()


def _sorted_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = texts_of(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length("text") + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2("text", 256)).alias("key"),
    )
    place = F.monotonically_increasing_id()
    return written(
        rows.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").withColumn("part", F.spark_partition_id()).withColumn("place", place.bitwiseAND(F.lit((1 << 33) - 1))),
        "shard-rows",
    )


def running_sums(rows: DataFrame) -> DataFrame:
    """rows (part, place, size) with cum and index over the whole order; nothing but partition totals meets in one task."""
    inside = Window.partitionBy("part").orderBy("place")
    parts = rows.groupBy("part").agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_rows"), F.min_by("key", "place").alias("part_key"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.lead("part_key").over(Window.orderBy("part")).alias("next_key"),
    )
    # One row per partition of the sort: the bound that makes this broadcast safe.
    return rows.join(F.broadcast(parts), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        "key",
        (F.col("size_before") + F.sum("size").over(inside)).alias("cum"),
        (F.col("rows_before") + F.col("place") + 1).alias("nth"),
        (~F.coalesce(F.lead("key").over(inside), F.col("next_key")).eqNullSafe(F.col("key"))).alias("is_end"),
    )


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: equal texts together, the largest shard as small as it can be."""
    rows = written(running_sums(_sorted_rows(docs, id_col, text_col)), "shard-sums")
    sizes = rows.groupBy("key").agg(F.sum("size").alias("size"), F.max("cum").alias("cum"))
    ends = written(sizes.select("cum", "size"), "shard-ends")
    _, cuts = minimax_cuts(ends, shards)
    nth = {r.cum: r.nth for r in rows.where(F.col("is_end") & F.col("cum").isin(sorted(set(cuts)))).select("cum", "nth").collect()}
    number: Column = F.lit(0)
    first: Column = F.lit(0).cast("long")
    for j, cut in enumerate(cuts, start=1):
        beyond = F.col("cum") > F.lit(cut)
        number = F.when(beyond, F.lit(j)).otherwise(number)
        first = F.when(beyond, F.lit(nth.get(cut, 0)).cast("long")).otherwise(first)
    return rows.select("doc_id", "size", "text_crc32", number.cast("int").alias("shard"), (F.col("nth") - 1 - first).alias("slot"))
