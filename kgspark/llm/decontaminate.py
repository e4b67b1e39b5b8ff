"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over neighbouring tokens: its hash covers the tokens under a 1 and ignores those under a 0, so a
substituted token hides only the positions where it falls under a 1. Hashes of the benchmark's positions are joined with
those of the documents' positions; around each hit the passage is compared with the item token by token on its diagonal,
substitutions allowed.

A document is contaminated by an item if the best stretch of the diagonal (a match counts 1, a mismatch -2) has at least
`least` matching tokens, or if three quarters of the item's tokens match on the diagonal. Short items have masks of less
weight, so that nearly every such passage has a hit; those of long items are light enough for a short passage inside one; items of fewer tokens than the least such mask needs must stand in the
document whole. Tokens are lower-cased words without punctuation at their ends.

1. The benchmark is tokenised and hashed by tasks; its hashes are written.
2. A filter of bits that tells whether a hash can be the benchmark's is sent to all tasks: 2 ** FILTER_BITS at most, whatever the
   benchmark's size. A full one lets more hashes pass, which the join then drops.
3. Of a document with hashes that pass, these and its tokens are written; all other documents are read once and left.
4. These hashes are joined with the benchmark's by shuffles; a candidate is a document, an item and a diagonal. The item and
   the document's tokens under it come together by joins, and are compared.

Null and empty texts have no overlap. Repeated rows get a result each. Items with one id and several texts are searched each,
and count as one; a null id is an id like any other. Very long texts are hashed whole; a hit takes 16 bytes. An empty table
of documents gives no rows; without items nothing is contaminated. Extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_names, prepare, sliced, texts_of, written

# Masks by the least length of their items, chosen so that a passage with a quarter of its tokens substituted
# anywhere has a hit, and so has one inside a longer item that is LEAST matching tokens long. Shorter items have one mask that
# covers them whole.
FAMILIES = {
    8: ("1011", "100011"),
    12: ("1101011", "11100101", "1100000111", "10110011", "111011"),
    16: ("111111", "1101111", "111010011", "1100101011", "1110001101", "101011100001"),
}
LEAST, SHORTEST = 16, min(FAMILIES)
#: The filter of the benchmark's hashes: bits for each, 2 ** FILTER_BITS in all at most (64 MB), and how many a hash sets.
BITS_EACH, FILTER_BITS, SLOTS = 256, 29, 4
#: Words whose hashes a task remembers.
REMEMBERED = 200_000


class Words:
    """Token hashes, remembered for frequent words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().split()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w.strip(string.punctuation) or w, 7)
            out.append(h)
        return np.array(out, np.uint64)


def masks_of(n: int) -> tuple[str, ...]:
    """The masks of items of n tokens."""
    if n < SHORTEST:
        return ("1" * n,) if n else ()
    return FAMILIES[max(k for k in FAMILIES if k <= n)]


def multiplied(h: np.ndarray) -> list[np.ndarray]:
    """Token hashes times an odd number for each place of a mask."""
    return [h * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 2**64)) for j in range(max(SHORTEST, *(len(m) for f in FAMILIES.values() for m in f)))]


def seed_hashes(by_place: list[np.ndarray], mask: str) -> np.ndarray:
    """A mask's hash at each position where it fits: the sum over its tokens, mixed. by_place: multiplied()."""
    n = len(by_place[0]) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, xxhash.xxh64_intdigest(mask, 3), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            out += by_place[j][j : j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return out


def best_stretch(match: np.ndarray) -> tuple[int, int, int]:
    """(matches, start, end) of the stretch with the largest sum of 1 for a match and -2 for a mismatch."""
    total = np.concatenate(([0], np.cumsum(np.where(match, 1, -2))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return int(match[start:end].sum()), start, end


def overlap(match: np.ndarray, n: int, least: int) -> tuple[int, int, int] | None:
    """(matches, start, end) in the part of the diagonal that lies in the document, if that contaminates; n: the item's tokens."""
    m, start, end = best_stretch(match)
    if m >= least:
        return m, start, end
    m = int(match.sum())
    if m < (n if n < SHORTEST else -(-3 * n // 4)):
        return None
    at = np.flatnonzero(match)
    return m, int(at[0]), int(at[-1]) + 1


ITEM_DDL = "item long, item_id long, n int, tokens binary"


def _items(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])
    for b in sliced(rows, 2):
        h = [words(t) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int64()), pa.array([len(x) for x in h], pa.int32()), pa.array([x.tobytes() for x in h], pa.binary())], schema=schema)


def _seeds(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("hash", pa.int64()), ("item", pa.int64()), ("at", pa.int32())])
    for b in rows:
        for item, tokens in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
            h = np.frombuffer(tokens, np.uint64)
            by_place = multiplied(h)
            for mask in masks_of(len(h)):
                own = seed_hashes(by_place, mask)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array([item] * len(own), pa.int64()), pa.array(np.arange(len(own), dtype=np.int32))], schema=schema)


def slot(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """A hash's k-th bit of the filter."""
    return ((h & np.uint64(0xFFFFFFFF)) + np.uint64(k) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64((1 << bits) - 1)


def _filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """The filter's bytes. Tasks put bits together to words; as many words as the filter has come to the driver at most."""
    low, step = F.col("hash").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("hash", 32).bitwiseOR(1)
    every = seeds.select(F.explode(F.array(*[(low + step * k).bitwiseAND((1 << bits) - 1) for k in range(SLOTS)])).alias("slot"))
    words = every.groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits")).toArrow()
    out = np.zeros(max(1, 1 << bits >> 5), np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


HIT_DDL = "doc_id long, th long, tokens binary, hits array<struct<hash:long,place:int>>"


def _hits(packed, masks: list[str], bits: int):
    hits_type = pa.list_(pa.struct([("hash", pa.int64()), ("place", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("tokens", pa.binary()), ("hits", hits_type)])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words = packed.value, Words()
        has = lambda s: (table[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1
        for b in sliced(rows):
            docs = [words(t) for t in b.column(1).to_pylist()]
            flat = np.concatenate([*docs, np.zeros(0, np.uint64)])
            ends = np.cumsum([len(d) for d in docs])
            places, hashes, by_place = [], [], multiplied(flat)
            for mask in masks:
                h = seed_hashes(by_place, mask)
                at = np.flatnonzero(has(slot(h, 0, bits)))
                for k in range(1, SLOTS):
                    at = at[has(slot(h[at], k, bits)) == 1]
                at = at[at + len(mask) <= ends[np.searchsorted(ends, at, side="right")]]  # inside one document
                places.append(at)
                hashes.append(h[at])
            place, h = np.concatenate([*places, np.zeros(0, np.int64)]), np.concatenate([*hashes, np.zeros(0, np.uint64)])
            if not len(place):
                continue
            order = np.argsort(place, kind="stable")
            place, h = place[order], h[order].view(np.int64)
            own = np.searchsorted(ends, place, side="right")
            held, first, count = np.unique(own, return_index=True, return_counts=True)
            inside = (place - np.concatenate(([0], ends))[own]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(h), pa.array(inside)], names=["hash", "place"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, first[-1] + count[-1]).astype(np.int32)), pairs).cast(hits_type)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()).take(pa.array(held)), b.column(2).take(pa.array(held)), pa.array([docs[d].tobytes() for d in held.tolist()], pa.binary()), lists], schema=schema)

    return run


def _compare(least: int):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("item_id", pa.int64()), ("matches", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out = []
            for r in b.to_pylist():
                item, own = np.frombuffer(r["item_tokens"], np.uint64), np.frombuffer(r["window"], np.uint64)
                first = max(0, r["shift"])
                skip = first - r["shift"]  # the item begins before the document
                found = overlap(own == item[skip : skip + len(own)], len(item), least)
                if found:
                    out.append({"doc_id": r["doc_id"], "th": r["th"], "item_id": r["item_id"], "matches": found[0], "start": first + found[1], "end": first + found[2]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, th, item_id, matches, start, end: the best overlap of each item with each document that it contaminates.
    docs: doc_id, text, th (a hash of the text)."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = written(items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").mapInArrow(_items, ITEM_DDL), "items")
    seeds = written(items.mapInArrow(_seeds, "hash long, item long, at int"), "seeds")
    # At most as many lengths as there are families and items below them.
    lengths = [r.n for r in items.select(F.least("n", F.lit(max(FAMILIES))).alias("n")).distinct().collect()]
    masks = sorted({m for n in lengths for m in masks_of(n)}, key=lambda m: (len(m), m))
    bits = max(16, min(FILTER_BITS, int(seeds.count() * BITS_EACH).bit_length()))
    packed = spark.sparkContext.broadcast(_filter(seeds, bits))
    hits = written(docs.select("doc_id", "text", "th").mapInArrow(_hits(packed, masks, bits), HIT_DDL).dropDuplicates(["doc_id", "th"]), "hits")
    asked = hits.select("doc_id", "th", F.explode("hits").alias("hit")).select("doc_id", "th", "hit.*")
    candidates = written(asked.join(seeds.hint("merge"), "hash").select("doc_id", "th", "item", (F.col("place") - F.col("at")).alias("shift")).distinct(), "candidates")
    tokens = hits.select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), "tokens")
    both = candidates.join(items.select("item", "item_id", "n", F.col("tokens").alias("item_tokens")), "item").join(tokens, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")))
    first = F.greatest("shift", F.lit(0))
    window = F.substr("tokens", first * 8 + 1, (F.col("shift") + F.col("n") - first) * 8)
    found = both.select("doc_id", "th", "item_id", "shift", "item_tokens", window.alias("window")).mapInArrow(_compare(least), "doc_id long, th long, item_id long, matches long, start long, end long")
    best = found.groupBy("doc_id", "th", "item_id").agg(F.max(F.struct("matches", (-F.col("start")).alias("start"), "end")).alias("best"))
    return written(best.select("doc_id", "th", "item_id", "best.matches", (-F.col("best.start")).alias("start"), "best.end"), "overlaps")


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, items (item_id, matches, start, end in tokens) for each row of docs."""
    rows = texts_of(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    found = overlaps(rows, benchmark, least).groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("item_id", "matches", "start", "end"))).alias("items"))
    found = found.select(F.col("doc_id").alias("found_id"), F.col("th").alias("found_th"), "items")
    none = F.array().cast("array<struct<item_id:long,matches:long,start:long,end:long>>")
    both = rows.select("doc_id", "th").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("th") == F.col("found_th")), "left")
    return both.select("doc_id", F.coalesce("items", none).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that no item of the benchmark contaminates."""
    rows = texts_of(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    own_th, gone_id, gone_th = free_names(docs, "th", "gone_id", "gone_th")
    gone = overlaps(rows, benchmark, least).select(F.col("doc_id").alias(gone_id), F.col("th").alias(gone_th)).distinct()
    marked = docs.withColumn(own_th, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return marked.join(gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(own_th) == F.col(gone_th)), "left_anti").drop(own_th)
